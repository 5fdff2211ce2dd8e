"""Business rules for new rows: `candidates` plus `reason`, NULL = accepted.

Candidates carry `seq`, the order in which they are added; a candidate meets the
existing rows and the candidates accepted before it. Auditing a whole table is
judging all its rows as candidates with no existing ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonewatch.functions.exprs import first_reason, segment_key, shift_minutes
from stonewatch.functions.grouped import (
    carried_previous,
    cut_lineage,
    greedy_accept,
    looked_up,
    previous_max,
    reached,
    seq_chunk,
    settle,
    shuffled,
    sliced,
)
from stonewatch.operators.geometry import FLOOR, containing_wall, wall_ends

OPEN_ENDED = "9999-12-31"


def _first_of(rows: DataFrame, key: Sequence[str], ok: Column) -> DataFrame:
    """Per key, the `seq` of the first row for which `ok` holds."""
    return rows.filter(ok).groupBy(*key).agg(F.min("seq").alias("_first"))


def _known(rows: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    return rows.select(*key).distinct().withColumn(flag, F.lit(True))


def _later() -> Column:
    return F.col("_first") < F.col("seq")


def check_walls(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """A wall is the first of its floor, or shares an end with one there and repeats none.

    Once a wall at a point is connected, every later wall at the point is. So a wall is connected if
    it is the first of its floor, touches an existing wall, or the wall before it at either
    of its ends is connected: links to two earlier walls at most, followed by jumping.
    """
    old_floors = _known(existing, FLOOR, "_old")
    firsts = candidates.groupBy(*FLOOR).agg(F.min("seq").alias("_first"))
    rows = (
        candidates.join(shuffled(old_floors), FLOOR, "left")
        .join(shuffled(firsts), FLOOR, "left")
        .withColumn("_key", segment_key())
        .withColumn("_alone", F.col("_old").isNull() & F.coalesce(F.col("_first") == F.col("seq"), F.lit(True)))
    )
    rows = cut_lineage(rows.drop("_old", "_first"))
    point = [*FLOOR, "x", "y"]
    ends = wall_ends(rows.withColumn("id", F.col("seq"))).select(*point, F.col("id").alias("seq")).distinct()
    old_ends = wall_ends(existing).select(*point).distinct()
    touching = ends.join(shuffled(old_ends), point, "left_semi").select("seq").distinct().withColumn("_touch", F.lit(True))
    linked = carried_previous(sliced(ends, point, ["seq"]), point, "seq", "_before").groupBy("seq").agg(
        F.min("_before").alias("a"), F.max("_before").alias("b")
    )
    nodes = (
        rows.select("seq", "_alone")
        .join(shuffled(touching), "seq", "left")
        .join(shuffled(linked), "seq", "left")
        .select(
            F.col("seq").alias("node"),
            (F.col("_alone") | F.coalesce("_touch", F.lit(False))).alias("seed"),
            "a",
            F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("b")).alias("b"),
        )
    )
    found = reached(nodes).select(F.col("node").alias("seq"), F.col("reached").alias("_in"))
    judged = cut_lineage(rows.join(shuffled(found), "seq"))
    segment = [*FLOOR, "_key"]
    drawn = existing.select(*FLOOR, segment_key().alias("_key"), F.lit(-1).cast("long").alias("seq"))
    drawn = drawn.unionByName(judged.filter("_in").select(*segment, F.col("seq").cast("long")))
    same = drawn.groupBy(*segment).agg(F.min("seq").alias("_same"))
    return judged.join(shuffled(same), segment, "left").withColumn(
        "reason",
        F.when(
            ~F.col("_alone"),
            first_reason(
                (~F.col("_in"), "no end in common with a wall of the floor"),
                (F.col("_same") < F.col("seq"), "repeats a wall of the floor"),
            ),
        ),
    ).select(*candidates.columns, "reason")


def check_faces(
    existing: DataFrame, candidates: DataFrame, walls: DataFrame, rooms: DataFrame, per_wall: int = 2
) -> DataFrame:
    """A face joins a wall and a room of one building and floor; a wall has at most two."""
    of_wall = walls.select(F.col("id").alias("wall_id"), F.col("building_id").alias("_wb"), F.col("floor").alias("_wf"))
    of_room = rooms.select(F.col("id").alias("room_id"), F.col("building_id").alias("_rb"), F.col("floor").alias("_rf"))
    held = existing.groupBy("wall_id").agg(F.count(F.lit(1)).alias("_held"))
    placed = (
        candidates.join(shuffled(of_wall), "wall_id", "left")
        .join(shuffled(of_room), "room_id", "left")
        .withColumn(
            "_alone",
            first_reason(
                (F.col("_wb") != F.col("_rb"), "wall and room in different buildings"),
                (F.col("_wf") != F.col("_rf"), "wall and room on different floors"),
            ),
        )
    )
    rank = F.row_number().over(Window.partitionBy("wall_id").orderBy("seq"))
    admitted = (
        placed.filter(F.col("_alone").isNull())
        .select("wall_id", "seq")
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= per_wall)
        .join(shuffled(held), "wall_id", "left")
        .filter(F.col("_rank") + F.coalesce("_held", F.lit(0)) <= per_wall)
        .select("seq", F.lit(True).alias("_in"))
    )
    full = F.when(F.col("_in").isNull(), F.lit("wall already has two faces"))
    return (
        placed.join(shuffled(admitted), "seq", "left")
        .withColumn("reason", F.coalesce("_alone", full))
        .select(*candidates.columns, "reason")
    )


def check_openings(existing: DataFrame, candidates: DataFrame, walls: DataFrame) -> DataFrame:
    """An opening lies on a wall and repeats no other opening."""
    on_wall = containing_wall(candidates, walls).select(F.col("opening_id").alias("id"), "wall_id")
    key = [*FLOOR, "_key"]
    held = _known(existing.withColumn("_key", segment_key()), key, "_held")
    rows = (
        candidates.join(shuffled(on_wall), "id")
        .withColumn("_key", segment_key())
        .join(shuffled(held), key, "left")
        .withColumn(
            "_alone",
            first_reason(
                (F.col("wall_id").isNull(), "not within a wall"),
                (F.col("_held"), "repeats an opening"),
            ),
        )
    )
    first = _first_of(rows, key, F.col("_alone").isNull())
    again = F.when(_later(), F.lit("repeats an opening"))
    return (
        rows.join(shuffled(first), key, "left")
        .withColumn("reason", F.coalesce("_alone", again))
        .select(*candidates.columns, "reason")
    )


def check_material_class(bricks: DataFrame, tiles: DataFrame, candidates: DataFrame) -> DataFrame:
    """A material is a brick or a tile, not both. Candidates have material_id and class."""
    brick, tile = F.lit("brick"), F.lit("tile")
    old = bricks.select("material_id", F.lit(True).alias("_is_brick")).unionByName(
        tiles.select("material_id", F.lit(False).alias("_is_brick"))
    )
    old = old.groupBy("material_id").agg(F.max("_is_brick").alias("_old"))

    def first(name: str) -> Column:
        return F.min(F.when(F.col("class") == name, F.col("seq")))

    came = candidates.groupBy("material_id").agg(first("brick").alias("_b"), first("tile").alias("_t"))
    tile_first = F.coalesce(F.col("_t") < F.col("_b"), F.col("_b").isNull())
    taken = F.when(F.coalesce(F.col("_old"), ~tile_first), brick).otherwise(tile)
    return (
        candidates.join(old, "material_id", "left")
        .join(came, "material_id")
        .withColumn(
            "reason", F.when(F.col("class") != taken, F.concat(F.lit("already a "), taken))
        )
        .select(*candidates.columns, "reason")
    )


def check_projects(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """One project per building at a time: none while another has no cost yet."""
    running = _known(existing.filter(F.col("cost").isNull()), ["building_id"], "_open")
    first = _first_of(candidates, ["building_id"], F.col("cost").isNull())
    busy = F.coalesce(F.col("_open"), _later(), F.lit(False))
    return (
        candidates.join(running, "building_id", "left")
        .join(first, "building_id", "left")
        .withColumn("reason", F.when(busy, F.lit("another project still open for the building")))
        .select(*candidates.columns, "reason")
    )


def check_stages(existing: DataFrame, candidates: DataFrame, projects: DataFrame) -> DataFrame:
    """Stages of a project do not overlap and start once it is approved.

    A stage without an end, or ending after the new one starts, overlaps it.
    """
    until = F.coalesce("ended", F.lit(OPEN_ENDED).cast("date"))
    held = existing.groupBy("project_id").agg(F.max(until).alias("_held"))
    approval = projects.select(F.col("id").alias("project_id"), "approved")
    base = candidates.join(held, "project_id", "left").join(approval, "project_id", "left")

    def judge(rows: DataFrame) -> DataFrame:
        seen = (
            rows.withColumn("_until", F.when(F.col("previous").isNull(), until))
            .withColumn("_chunk", seq_chunk("seq"))
        )
        before = previous_max(seen, ["project_id"], ["_chunk"], ["seq"], "_until", "_before")
        busy = F.greatest("_held", "_before") > F.col("started")
        return before.withColumn(
            "reason",
            first_reason(
                (busy, "overlaps another stage"),
                (F.col("approved").isNull(), "project not approved"),
                (F.col("approved") > F.col("started"), "starts before the approval"),
            ),
        ).drop("_until", "_chunk", "_before")

    return settle(base, judge, groups=["project_id"]).select(*candidates.columns, "reason")


def check_closings(closings: DataFrame, jobs: DataFrame) -> DataFrame:
    """A stage (id, ended) closes once all its jobs are done."""
    pending = _known(jobs.filter(~F.col("done")).withColumnRenamed("stage_id", "_s"), ["_s"], "_open")
    return (
        closings.join(pending.withColumnRenamed("_s", "id"), "id", "left")
        .withColumn(
            "reason",
            F.when(F.col("_open") & F.col("ended").isNotNull(), F.lit("jobs of the stage not done")),
        )
        .drop("_open")
    )


def all_job_targets(job_walls: DataFrame, job_rooms: DataFrame, job_faces: DataFrame) -> DataFrame:
    """Interventions on walls, rooms and faces as (job_id, target, wall_id, room_id)."""

    def of(rows: DataFrame, target: str) -> DataFrame:
        return rows.withColumn("target", F.lit(target))

    return (
        of(job_walls, "wall")
        .unionByName(of(job_rooms, "room"), allowMissingColumns=True)
        .unionByName(of(job_faces, "face"), allowMissingColumns=True)
    )


def check_interventions(
    existing: DataFrame,
    candidates: DataFrame,
    jobs: DataFrame,
    stages: DataFrame,
    projects: DataFrame,
    walls: DataFrame,
    rooms: DataFrame,
) -> DataFrame:
    """A job works on one room, face or wall, in the building of its project."""
    site = (
        jobs.select(F.col("id").alias("job_id"), "stage_id")
        .join(shuffled(stages.select(F.col("id").alias("stage_id"), "project_id")), "stage_id")
        .join(
            shuffled(projects.select(F.col("id").alias("project_id"), F.col("building_id").alias("_site"))), "project_id"
        )
        .select("job_id", "_site")
    )
    of_wall = walls.select(F.col("id").alias("wall_id"), F.col("building_id").alias("_wb"))
    of_room = rooms.select(F.col("id").alias("room_id"), F.col("building_id").alias("_rb"))
    place = F.when(F.col("target") == "room", F.col("_rb")).otherwise(F.col("_wb"))
    rows = (
        looked_up(looked_up(candidates, of_wall, "wall_id"), of_room, "room_id")
        .join(shuffled(site), "job_id", "left")
        .join(shuffled(_known(existing, ["job_id"], "_held")), "job_id", "left")
        .withColumn(
            "_alone",
            first_reason(
                (F.col("_held"), "job already has an intervention"),
                (F.col("_site") != place, "not in the building of the project"),
            ),
        )
    )
    first = _first_of(rows, ["job_id"], F.col("_alone").isNull())
    again = F.when(_later(), F.lit("job already has an intervention"))
    return (
        rows.join(shuffled(first), "job_id", "left")
        .withColumn("reason", F.coalesce(again, "_alone"))
        .select(*candidates.columns, "reason")
    )


def check_managers(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """Managers are active staff; unknown people pass, as references are checked elsewhere."""
    staff = people.select(F.col("id").alias("person_id"), F.col("active").alias("_active"))
    return (
        candidates.join(staff, "person_id", "left")
        .withColumn("reason", F.when(~F.col("_active"), F.lit("manager not active")))
        .select(*candidates.columns, "reason")
    )


def check_contributions(
    existing: DataFrame, candidates: DataFrame, jobs: DataFrame, shifts: DataFrame
) -> DataFrame:
    """Hours go to open jobs of the shift's stage, in all no more than the shift lasts.

    Whether job and shift exist is for the reference checks: where the shift is unknown,
    nothing can be compared with it and the row passes.
    """
    of_job = jobs.select(F.col("id").alias("job_id"), F.col("done").alias("_done"), F.col("stage_id").alias("_js"))
    of_shift = shifts.select(
        F.col("id").alias("shift_id"),
        F.col("stage_id").alias("_ss"),
        F.round(shift_minutes().cast("decimal(12,0)") / 60, 1).alias("_length"),
    )
    worked = existing.groupBy("shift_id").agg(F.sum("hours").alias("_worked"))
    rows = (
        candidates.join(of_job, "job_id", "left")
        .join(of_shift.drop("_length"), "shift_id", "left")
        .withColumn(
            "_alone",
            first_reason(
                (F.col("_done"), "job already done"),
                (F.col("_js") != F.col("_ss"), "job and shift in different stages"),
            ),
        )
    )
    room = of_shift.join(worked, "shift_id", "left").select(
        "shift_id", (F.col("_length") - F.coalesce("_worked", F.lit(0))).alias("room")
    )
    weighed = F.col("_alone").isNull() & F.col("_ss").isNotNull()
    served = greedy_accept(rows.filter(weighed), room, ["shift_id"], "seq", "hours")
    over = F.when(~F.col("accepted"), F.lit("more hours than the shift has"))
    return (
        served.withColumn("reason", over)
        .drop("accepted", "room_left")
        .unionByName(rows.filter(~weighed).withColumn("reason", F.col("_alone")))
        .select(*candidates.columns, "reason")
    )


def check_threshold_changes(old: DataFrame, new: DataFrame, measurements: DataFrame) -> DataFrame:
    """A threshold stays as it is once its sensor has readings."""
    before = old.select("id", F.col("threshold").alias("_before"))
    rows = new.join(before, "id", "left").withColumn("_moved", F.col("threshold") != F.col("_before"))
    moved = rows.filter(F.col("_moved")).select(F.col("id").alias("sensor_id"))
    read = measurements.select("sensor_id").join(moved, "sensor_id", "left_semi").distinct()
    fixed = read.select(F.col("sensor_id").alias("id"), F.lit(True).alias("_read"))
    return (
        rows.join(fixed, "id", "left")
        .withColumn("reason", F.when(F.col("_moved") & F.col("_read"), F.lit("sensor has readings")))
        .select(*new.columns, "reason")
    )


def check_sensors(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """No two sensors of a kind at one point."""
    point = [*FLOOR, "x", "y", "z", "kind"]
    rows = candidates.join(_known(existing, point, "_held"), point, "left")
    first = _first_of(rows, point, F.col("_held").isNull())
    taken = F.coalesce(F.col("_held"), _later(), F.lit(False))
    return (
        rows.join(first, point, "left")
        .withColumn("reason", F.when(taken, F.lit("a sensor of this kind is at this point")))
        .select(*candidates.columns, "reason")
    )
