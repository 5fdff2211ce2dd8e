"""Floor plans as HTML with inline SVG, one text per floor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonewatch.config import DEFAULT, Config
from stonewatch.functions.grouped import shuffled

FLOOR = ["building_id", "floor"]

# The page around the drawing.
PAGE_START = """<!DOCTYPE html>
<html>
<body>
<head>
    <style>
    p {
        font-family:'Segoe UI';
        font-size: 1.2rem;
    }
    </style>
</head>
<div align=center>
<p>Edificio: """
PAGE_FLOOR = " | Piano: "
PAGE_SVG = '</p>\r<svg style="padding:5px; margin:5px; transform:scaleY(-1)" width="'
PAGE_END = "\n</svg>\n</div>\n</body>\n</html>"


def plan_scale(walls: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pixels per metre of every floor, and the size of its drawing."""
    whole = (
        walls.groupBy(*FLOOR)
        .agg(
            F.round(F.max(F.greatest("x1", "x2")), 0).cast("int").alias("_x"),
            F.round(F.max(F.greatest("y1", "y2")), 0).cast("int").alias("_y"),
        )
        .withColumn(
            "scale",
            F.round(F.try_divide(F.lit(float(config.svg_side)), F.greatest("_x", "_y")), 0).cast("int"),
        )
    )
    edge = 2 * config.svg_offset
    return whole.select(
        *FLOOR,
        "scale",
        (F.col("_x") * F.col("scale") + edge).alias("width"),
        (F.col("_y") * F.col("scale") + edge).alias("height"),
    )


def _text(parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# The text of the drawn pieces, here and in `floor_plans`.
def _line(at, colour: Column) -> Column:
    return _text(
        [
            '<line x1="', at("x1"), '" y1="', at("y1"), '" x2="', at("x2"), '" y2="', at("y2"),
            '" stroke="', colour, '" stroke-width="3px"/>',
        ]
    )


def floor_plans(
    walls: DataFrame, openings: DataFrame, sensors: DataFrame, config: Config = DEFAULT
) -> DataFrame:
    """The plan of every floor with walls: walls, then openings, then sensors, each by id."""
    scales = shuffled(plan_scale(walls, config))

    def at(c: str) -> Column:
        return (F.col(c) * F.col("scale") + config.svg_offset).cast("decimal(20,2)")

    def drawn(rows: DataFrame, layer: int, shape: Column) -> DataFrame:
        return rows.join(scales, FLOOR).select(
            *FLOOR, F.struct(F.lit(layer).alias("layer"), "id", shape.alias("svg")).alias("_e")
        )

    colour = F.lit(config.other_opening_colour)
    for kind, value in config.opening_colours.items():
        colour = F.when(F.col("kind") == kind, F.lit(value)).otherwise(colour)
    dot = _text(
        ['<circle cx="', at("x"), '" cy="', at("y"), '" r="5" fill="', F.lit(config.sensor_colour), '"/>']
    )
    elements = (
        drawn(walls, 0, _line(at, F.lit("black")))
        .unionByName(drawn(openings, 1, _line(at, colour)))
        .unionByName(drawn(sensors, 2, dot))
    )
    drawing = (
        elements.groupBy(*FLOOR)
        .agg(F.array_sort(F.collect_list("_e")).alias("_all"))
        .select(*FLOOR, F.concat(F.lit("\r"), F.array_join("_all.svg", "\r")).alias("_drawing"))
    )
    page = _text(
        [
            PAGE_START, F.col("building_id"), PAGE_FLOOR, F.col("floor"), PAGE_SVG, F.col("width"),
            '" height="', F.col("height"), '">', F.col("_drawing"), PAGE_END,
        ]
    )
    return scales.join(drawing, FLOOR).select(*FLOOR, page.alias("html"))
