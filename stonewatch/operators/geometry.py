"""Walls and openings: outlines, areas, containment, shared points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonewatch.functions.exprs import segment_key
from stonewatch.functions.grouped import cut_lineage, shuffled

FLOOR = ["building_id", "floor"]


def external_walls(walls: DataFrame, faces: DataFrame) -> DataFrame:
    """Walls with exactly one face."""
    single = faces.groupBy("wall_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    single = shuffled(single.select(F.col("wall_id").alias("id")))
    return walls.join(single, "id", "left_semi").select(*walls.columns)


def wall_ends(walls: DataFrame) -> DataFrame:
    """Both end points of every wall."""
    ends = F.array(
        F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")),
    )
    return walls.select("id", *FLOOR, F.explode(ends).alias("_p")).select("id", *FLOOR, "_p.x", "_p.y")


def outlined_floors(outer: DataFrame) -> DataFrame:
    """Floors with outer walls, with a reason where these leave an end unmatched."""
    points = wall_ends(outer).groupBy(*FLOOR, "x", "y").agg((F.count(F.lit(1)) % 2).alias("_odd"))
    return points.groupBy(*FLOOR).agg(
        F.when(F.max("_odd") == 1, F.lit("open outline")).alias("reason")
    )


def floor_area(walls: DataFrame, faces: DataFrame) -> DataFrame:
    """Area inside the outer walls of every floor; NULL with a reason for open outlines.

    The floor is cut into slabs at every wall end. Within a slab the crossing
    walls, sorted by height, alternate between entering and leaving the inside, so
    neither the order nor the direction of walls matters, and courtyards and
    several outlines come out right. Slabs per floor are bounded by the two-decimal
    coordinates; a wall meets only the slabs it crosses.
    """
    outer = cut_lineage(external_walls(walls, faces))
    ends = wall_ends(outer)
    order = Window.partitionBy(*FLOOR).orderBy("x")
    slabs = (
        ends.select(*FLOOR, "x")
        .distinct()
        .select(*FLOOR, F.col("x").alias("_left"), F.lead("x").over(order).alias("_right"), F.row_number().over(order).alias("_i"))
    )
    reach = (
        ends.join(shuffled(slabs.select(*FLOOR, F.col("_left").alias("x"), "_i")), [*FLOOR, "x"])
        .groupBy("id")
        .agg(F.min("_i").alias("_from"), F.max("_i").alias("_to"))
        .filter("_from < _to")
    )
    crossing = (
        outer.join(shuffled(reach), "id")
        .withColumn("_i", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))
        .join(shuffled(slabs), [*FLOOR, "_i"])
    )
    x1, y1, x2, y2, left, right = (
        F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2", "_left", "_right")
    )
    height = y1 + (y2 - y1) * ((left + right) / 2 - x1) / (x2 - x1)
    ranked = crossing.withColumn("_y", height).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*FLOOR, "_i").orderBy("_y", "id"))
    )
    signed = (right - left) * F.col("_y") * F.when(F.col("_rank") % 2 == 0, 1).otherwise(-1)
    areas = ranked.groupBy(*FLOOR).agg(F.sum(signed).cast("decimal(12,2)").alias("_area"))
    return (
        outlined_floors(outer)
        .join(shuffled(areas), FLOOR, "left")
        .select(
            *FLOOR,
            F.when(F.col("reason").isNull(), F.coalesce("_area", F.lit(0))).alias("area"),
            "reason",
        )
    )


def building_area(areas: DataFrame) -> DataFrame:
    """Area of all floors; NULL with a reason when a floor has none."""
    return areas.groupBy("building_id").agg(
        F.when(F.max("reason").isNull(), F.sum("area")).alias("area"), F.max("reason").alias("reason")
    )


def metre_columns(x1: str, x2: str) -> Column:
    """The metre-wide columns a segment reaches, to meet others nearby only."""
    return F.explode(
        F.sequence(F.floor(F.least(x1, x2)).cast("int"), F.floor(F.greatest(x1, x2)).cast("int"))
    )


def containing_wall(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """The wall each opening lies on (lowest id), NULL when on none.

    An opening lies on a wall when it is within its box and both its ends are on
    its line; the line test is an exact decimal product, also for oblique walls.
    """
    o = openings.select(
        F.col("id").alias("opening_id"),
        *FLOOR,
        *(F.col(c).alias(f"o{c}") for c in ("x1", "y1", "x2", "y2")),
    ).withColumn("_column", F.floor(F.least("ox1", "ox2")).cast("int"))
    w = walls.select(F.col("id").alias("wall_id"), *FLOOR, "x1", "y1", "x2", "y2").withColumn(
        "_column", metre_columns("x1", "x2")
    )

    def inside(a: str) -> Column:
        lo, hi = F.least(f"{a}1", f"{a}2"), F.greatest(f"{a}1", f"{a}2")
        return (F.least(f"o{a}1", f"o{a}2") >= lo) & (F.greatest(f"o{a}1", f"o{a}2") <= hi)

    def on_line(px: str, py: str) -> Column:
        return (F.col("x2") - F.col("x1")) * (F.col(py) - F.col("y1")) == (
            F.col("y2") - F.col("y1")
        ) * (F.col(px) - F.col("x1"))

    found = (
        o.join(shuffled(w), [*FLOOR, "_column"])
        .filter(inside("x") & inside("y") & on_line("ox1", "oy1") & on_line("ox2", "oy2"))
        .groupBy("opening_id")
        .agg(F.min("wall_id").alias("wall_id"))
    )
    return openings.select(F.col("id").alias("opening_id"), *FLOOR).join(shuffled(found), "opening_id", "left")


def duplicate_segments(segments: DataFrame) -> DataFrame:
    """Segments equal, in either direction, to one with a lower id on their floor."""
    keyed = segments.select("id", *FLOOR, segment_key().alias("_key"))
    first = keyed.groupBy(*FLOOR, "_key").agg(
        F.min("id").alias("duplicate_of"), F.count(F.lit(1)).alias("_n")
    )
    return (
        keyed.join(shuffled(first.filter("_n > 1").drop("_n")), [*FLOOR, "_key"])
        .filter(F.col("id") > F.col("duplicate_of"))
        .select("id", *FLOOR, "duplicate_of")
    )


def shared_vertices(walls: DataFrame) -> DataFrame:
    """Whether each wall has an end in common with another wall of its floor."""
    ends = wall_ends(walls)
    common = ends.groupBy(*FLOOR, "x", "y").agg((F.min("id") != F.max("id")).alias("_common"))
    return (
        ends.join(shuffled(common), [*FLOOR, "x", "y"])
        .groupBy("id", *FLOOR)
        .agg(F.max("_common").alias("shares_vertex"))
    )
