"""Area risk, building risk and condition, and territory trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonewatch.config import DEFAULT, Config
from stonewatch.functions.exprs import as_date, days_before, health, percent_change
from stonewatch.functions.grouped import cut_lineage, previous_max
from stonewatch.operators.sensors import (
    day_parts,
    day_spans,
    merged_readings,
    part_bins,
    part_sums,
    sensor_health,
)


def one_per_date(risk: DataFrame, tie: str | None) -> DataFrame:
    """One coefficient per area, kind and date: the one with the highest `tie`.

    Without `tie` the history is taken to have one already, as its key says.
    """
    if tie is None:
        return risk.select("area", "kind", "measured", "coefficient")
    return risk.groupBy("area", "kind", "measured").agg(
        F.max_by("coefficient", tie).alias("coefficient")
    )


def risk_in_force(risk: DataFrame, as_of, tie: str | None = None) -> DataFrame:
    """The latest coefficient per area and kind measured on or before a date."""
    return (
        one_per_date(risk.filter(F.col("measured") <= as_date(as_of)), tie)
        .groupBy("area", "kind")
        .agg(
            F.max_by("coefficient", "measured").alias("coefficient"),
            F.max("measured").alias("measured"),
        )
    )


def risk_on_dates(requests: DataFrame, risk: DataFrame, tie: str | None = None) -> DataFrame:
    """The coefficient in force for each (area, kind, date) asked for."""
    history = one_per_date(risk, tie)
    asked = requests.select("area", "kind", "date").distinct()
    both = history.select(
        "area", "kind", F.col("measured").alias("date"), F.lit(0).alias("_asks"), "measured"
    ).unionByName(asked.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    found = previous_max(
        both.withColumn("_month", F.trunc("date", "month")),
        ["area", "kind"],
        ["_month"],
        ["date", "_asks"],
        "measured",
        "_latest",
    )
    answers = (
        found.filter((F.col("_asks") == 1) & F.col("_latest").isNotNull())
        .select("area", "kind", "date", F.col("_latest").alias("measured"))
        .join(history, ["area", "kind", "measured"])
        .drop("measured")
    )
    return requests.join(answers, ["area", "kind", "date"], "left")


def _class_of(config: Config) -> Column:
    out = F.lit(None).cast("string")
    for c in config.risk_classes:
        out = F.when(F.col("kind").isin(*c.kinds), F.lit(c.name)).otherwise(out)
    return out


def _area_kind(config: Config) -> Column:
    out = F.lit(None).cast("string")
    for c in config.risk_classes:
        out = F.when(F.col("class") == c.name, F.lit(c.area_kind)).otherwise(out)
    return out


def _sensor_risk(health_rows: DataFrame, keys: list[str], config: Config) -> DataFrame:
    """Mean distance from full health per class of sensors."""
    return (
        health_rows.withColumn("class", _class_of(config))
        .filter(F.col("class").isNotNull())
        .groupBy(*keys, "class", "period")
        .agg(F.avg(F.lit(10).cast("decimal(5,2)") - F.col("health")).cast("decimal(5,2)").alias("sensor_risk"))
    )


def _scaled() -> Column:
    return ((F.col("coefficient") + 1).cast("decimal(5,2)") * F.col("sensor_risk")).cast("decimal(9,2)")


def building_risk(
    measurements: DataFrame,
    sensors: DataFrame,
    buildings: DataFrame,
    risk: DataFrame,
    as_of,
    config: Config = DEFAULT,
    tie: str | None = None,
) -> DataFrame:
    """Risk per building, class and period on one date."""
    spans = day_spans(as_of, config.risk_periods)
    sensor_risk = _sensor_risk(sensor_health(measurements, sensors, spans), ["building_id"], config)
    ends = {name: days_before(as_date(as_of), getattr(config.risk_periods, name)[1]) for name in spans}
    wanted = [c.area_kind for c in config.risk_classes]
    known = (
        one_per_date(
            risk.filter(F.col("kind").isin(*wanted) & (F.col("measured") <= F.greatest(*ends.values()))), tie
        )
        .groupBy("area", F.col("kind").alias("area_kind"))
        .agg(
            *(
                F.max_by("coefficient", F.when(F.col("measured") <= end, F.col("measured"))).alias(name)
                for name, end in ends.items()
            )
        )
    )
    coefficient = F.when(F.col("period") == "new", F.col("new")).otherwise(F.col("old"))
    homes = buildings.select(F.col("id").alias("building_id"), "area")
    return (
        sensor_risk.join(homes, "building_id")
        .withColumn("area_kind", _area_kind(config))
        .join(known, ["area", "area_kind"], "left")
        .withColumn("coefficient", coefficient)
        .select("building_id", "class", "period", "sensor_risk", "coefficient", _scaled().alias("risk"))
    )


def building_risk_on_dates(
    measurements: DataFrame,
    sensors: DataFrame,
    buildings: DataFrame,
    risk: DataFrame,
    requests: DataFrame,
    config: Config = DEFAULT,
    tie: str | None = None,
) -> DataFrame:
    """Risk per building, class and period for each (building_id, as_of) asked for.

    Readings are reduced once, to sums and histograms per sensor and day; the windows of all dates
    are merged from those. Readings are not multiplied by the dates whose windows hold them.
    """
    asked = requests.select("building_id", "as_of").distinct()
    spans = [
        F.struct(
            F.lit(name).alias("period"),
            days_before(F.col("as_of"), a).alias("from_day"),
            days_before(F.col("as_of"), b).alias("to_day"),
        )
        for name, (a, b) in (("new", config.risk_periods.new), ("old", config.risk_periods.old))
    ]
    windows = cut_lineage(asked.withColumn("_w", F.explode(F.array(*spans))).select("building_id", "as_of", "_w.*"))
    wanted = sensors.select(F.col("id").alias("sensor_id"), "building_id", "kind").filter(_class_of(config).isNotNull())
    days = windows.select("building_id", F.explode(F.sequence("from_day", "to_day")).alias("_day")).distinct()
    here = wanted.join(days, "building_id").select("sensor_id", "kind", "_day")
    day = (F.col("day") if "day" in measurements.columns else F.to_date("ts")).alias("_day")
    parts = day_parts(
        measurements.select("sensor_id", "ts", "x", "y", "z", day).join(here, ["sensor_id", "_day"]).drop("_day")
    )
    keys = ["sensor_id", "as_of", "period"]
    each = wanted.join(windows, "building_id").select(*keys, "from_day", "to_day")
    sums, bins = cut_lineage(part_sums(parts)), cut_lineage(part_bins(parts))
    readings = merged_readings(parts, sums, bins, each, keys)
    health_rows = (
        sensors.select(F.col("id").alias("sensor_id"), "building_id", "kind", "threshold")
        .join(windows, "building_id")
        .join(readings, ["sensor_id", "as_of", "period"], "left")
        .withColumn("health", health("kind", "reading", "threshold"))
    )
    sensor_risk = _sensor_risk(health_rows, ["building_id", "as_of", "to_day"], config)
    homes = buildings.select(F.col("id").alias("building_id"), "area")
    placed = sensor_risk.join(homes, "building_id").withColumn("kind", _area_kind(config))
    return risk_on_dates(placed.withColumnRenamed("to_day", "date"), risk, tie).select(
        "building_id", "as_of", "class", "period", "sensor_risk", "coefficient", _scaled().alias("risk")
    )


def building_state(risk_rows: DataFrame, keys: Sequence[str] = ("building_id",)) -> DataFrame:
    """Condition 0..100 of a building from its risks; NULL when any is unknown."""

    def of(name: str, period: str) -> Column:
        return F.max(F.when((F.col("class") == name) & (F.col("period") == period), F.col("risk")))

    wide = risk_rows.groupBy(*keys).agg(
        *(of(c, p).alias(f"_{c}_{p}") for c in ("environmental", "structural") for p in ("new", "old"))
    )

    def expected(c: str) -> Column:
        new, old = F.col(f"_{c}_new"), F.col(f"_{c}_old")
        factor = F.when(new > old, F.lit("1.15").cast("decimal(3,2)")).otherwise(
            F.lit("0.85").cast("decimal(3,2)")
        )
        return (new * factor).cast("decimal(9,2)")

    total = expected("environmental") + expected("structural")
    left = F.lit(100).cast("decimal(10,2)") - total
    return wide.select(
        *keys, F.round(F.when(left < 0, F.lit(0)).otherwise(left), 0).cast("smallint").alias("state")
    )


def area_risk_mean(risk: DataFrame, as_of, tie: str | None = None) -> DataFrame:
    """Mean over kinds of the coefficients in force in each area."""
    return (
        risk_in_force(risk, as_of, tie)
        .groupBy("area")
        .agg(F.avg(F.col("coefficient").cast("decimal(5,0)")).cast("decimal(4,2)").alias("mean_risk"))
    )


# Texts of the territory report.
RISK_STABLE = "Negli ultimi 6 mesi la media dei coefficienti di rischio dell'area geografica specificata è rimasta stabile"
RISK_MOVED = (
    "Negli ultimi 6 mesi la media dei coefficienti di rischio dell'area geografica specificata è passata da ",
    " a ",
    ", una diminuzione del ",
    ", un aumento del ",
    "%",
)
ALERTS_EQUAL = "Le allerte generate dai sensori presenti negli edifici appartenenti all'area geografica specificata sono state esattamente uguali alle aspettative"
ALERTS_DIFFER = (
    "Le allerte generate dai sensori presenti negli edifici appartenenti all'area geografica specificata (",
    ") sono state ",
    "inferiori",
    "superiori",
    " del ",
    "% rispetto alle aspettative (",
    ")",
)


def risk_trend(
    risk: DataFrame, areas: DataFrame, as_of, months: int = 6, tie: str | None = None
) -> DataFrame:
    """Mean risk of each area now and some months before, with the trend in words."""
    day = as_date(as_of)
    now = area_risk_mean(risk, day, tie).withColumnRenamed("mean_risk", "_now")
    then = area_risk_mean(risk, F.add_months(day, -months), tie).withColumnRenamed("mean_risk", "_then")
    new, old = F.col("risk_now"), F.col("risk_before")
    start, to, down, up, end = (F.lit(t) for t in RISK_MOVED)
    moved = F.concat(
        start,
        old.cast("string"),
        to,
        new.cast("string"),
        F.when(new < old, down).otherwise(up),
        percent_change(new, old).cast("string"),
        end,
    )
    return (
        areas.select(F.col("postcode").alias("area"))
        .join(now, "area", "left")
        .join(then, "area", "left")
        .select(
            "area",
            F.col("_now").cast("decimal(2,1)").alias("risk_now"),
            F.col("_then").cast("decimal(2,1)").alias("risk_before"),
        )
        .withColumn("trend", F.when(new == old, F.lit(RISK_STABLE)).when(new.isNotNull() & old.isNotNull(), moved))
    )


def alert_trend(expected: DataFrame) -> DataFrame:
    """Alerts against expectation per area, in words."""
    got, want = F.col("alerts"), F.col("expected")
    start, were, below, above, by, rest, end = (F.lit(t) for t in ALERTS_DIFFER)
    differ = F.concat(
        start,
        got.cast("string"),
        were,
        F.when(got < want, below).otherwise(above),
        by,
        percent_change(got, want).cast("string"),
        rest,
        want.cast("string"),
        end,
    )
    return expected.withColumn(
        "trend", F.when(got == want, F.lit(ALERTS_EQUAL)).when(want.isNotNull(), differ)
    )


def territory_report(risk_rows: DataFrame, alert_rows: DataFrame) -> DataFrame:
    """Both trends of every area; equal texts of an area collapse into one row."""
    return risk_rows.select("area", "trend").unionByName(alert_rows.select("area", "trend")).distinct()
