"""Joins with sides that grow with the tables are shuffled, however small the planner takes them for."""

import pytest
from pyspark.sql import functions as F

from stonewatch.functions.grouped import looked_up, reached
from stonewatch.operators import geometry, rendering, rules, stock

SEGMENT = (
    "inline(transform(sequence(0, 5), i -> named_struct('id', plot * 10 + i, 'building_id', plot div 3, 'floor',"
    " cast(plot % 3 as smallint), 'x1', cast(i as decimal(5,2)), 'y1', cast(0 as decimal(5,2)), 'x2',"
    " cast(i + 1 as decimal(5,2)), 'y2', cast(0 as decimal(5,2)), 'kind', 'Porta')))"
)


@pytest.fixture(scope="module")
def walls(spark):
    return spark.range(40).withColumnRenamed("id", "plot").selectExpr(SEGMENT)


def numbered(rows):
    return rows.withColumn("seq", F.col("id"))


def faces(walls):
    return walls.select(F.col("id").alias("room_id"), F.col("id").alias("wall_id"), F.col("id").alias("seq"))


def targets(walls):
    null = F.lit(None).cast("long")
    return walls.select(
        F.col("id").alias("job_id"), F.col("id").alias("seq"), F.lit("wall").alias("target"),
        F.when(F.col("id") % 10 == 0, F.col("id")).alias("wall_id"), null.alias("room_id"),
    )


def interventions(walls):
    rooms = walls.select("id", "building_id")
    jobs, stages, projects = (
        walls.selectExpr("id", f"id AS {name}") for name in ("stage_id", "project_id", "building_id")
    )
    rows = targets(walls)
    return rules.check_interventions(rows.filter("seq % 7 = 0"), rows, jobs, stages, projects, rooms, rooms)


OPERATORS = {
    "floor_plan_svg": lambda w: rendering.floor_plans(w, w, w.selectExpr("*", "x1 AS x", "y1 AS y")),
    "rule_openings": lambda w: rules.check_openings(w.filter("id % 7 = 0"), numbered(w), w),
    "shared_vertices": geometry.shared_vertices,
    "duplicate_segments": geometry.duplicate_segments,
    "floor_area": lambda w: geometry.floor_area(w, faces(w)),
    "rule_walls": lambda w: rules.check_walls(w.filter("id % 7 = 3"), numbered(w.filter("id % 7 <> 3"))),
    "rule_faces": lambda w: rules.check_faces(faces(w).filter("seq % 3 = 0"), faces(w), w, w),
    "rule_interventions": interventions,
    "opening_containment": lambda w: geometry.containing_wall(w, w),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_growing_side_is_broadcast(walls, name):
    plan = OPERATORS[name](walls)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert "Broadcast" not in plan


def test_rows_without_a_key_are_dealt_out(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") < 10, F.col("id").cast("int")).alias("key"))
    facts = spark.range(8).selectExpr("id AS key", "id * 2 AS fact").union(spark.sql("SELECT 3L, 7L"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = looked_up(rows, facts, "key").withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = [(i, i, 2 * i) for i in range(8)] + [(3, 3, 7), (8, 8, None), (9, 9, None)]
    assert sorted((r.id, r.key, -1 if r.fact is None else r.fact) for r in got if r.key is not None) == sorted(
        (i, k, -1 if f is None else f) for i, k, f in want
    )
    empty = [r.part for r in got if r.key is None]
    assert len(empty) == 3990
    assert max(empty.count(p) for p in set(empty)) < 2000


def test_chains_of_single_pointers_are_followed(spark):
    nodes = spark.range(300).selectExpr("id AS node", "id = 5 AS seed", "if(id > 0, id - 1, NULL) AS a", "cast(NULL AS long) AS b")
    got = {r.node: r.reached for r in reached(nodes).collect()}
    assert got == {i: i >= 5 for i in range(300)}


def test_lots_are_read_once_when_served(spark, tmp_path):
    """What follows reads the written lots and verdicts, not the tables they come from."""
    spark.range(12).selectExpr(
        "id % 3 AS material_id", "id", "date_add(DATE '2020-01-01', cast(id as int)) AS purchased", "5L AS available"
    ).write.parquet(f"{tmp_path}/lots")
    spark.range(9).selectExpr("id AS job_id", "id % 3 AS material_id", "id AS seq", "8L AS quantity").write.parquet(
        f"{tmp_path}/requests"
    )
    lots, requests = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("lots", "requests"))
    judged, drawn, after = stock.serve(requests, lots)
    for frame in (judged, drawn, after):
        assert not any(str(tmp_path) in path for path in frame.inputFiles())
    assert sorted((r.seq, r.reason) for r in judged.collect() if r.reason) == [(i, "insufficient stock") for i in (6, 7, 8)]
    assert sum(r.quantity for r in drawn.collect()) == 48
    assert sorted((r.id, r.available) for r in after.collect()) == [(i, 0 if i < 9 else 4) for i in range(12)]
