"""Sensor health, advice, ranking and alerts, for all sensors at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonewatch.config import ADVICE_RULES, CRACK, DEFAULT, HIGH_RATE, NO_ADVICE, Config
from stonewatch.functions.exprs import (
    as_date,
    as_ntz,
    days_before,
    health,
    is_low_rate,
    magnitude,
    midnight,
    threshold_exceeded,
    whole_days,
)
from stonewatch.functions.grouped import binned_parts, merged_top_percent_mean, top_percent_mean
from stonewatch.operators.geometry import metre_columns

Span = tuple[Column, Column]


def day_spans(as_of, periods) -> dict[str, Span]:
    """Closed `new` and `old` windows, in whole days back from `as_of`.

    Ends are midnights: readings later on the last day are outside.
    """
    day = as_date(as_of)
    return {
        name: tuple(midnight(days_before(day, back)) for back in getattr(periods, name))
        for name in ("new", "old")
    }


def readings_of(measurements: DataFrame, *columns: str) -> DataFrame:
    """The columns asked for, and the day where the readings are stored by day."""
    return measurements.select(*columns, *(c for c in ("day",) if c in measurements.columns))


def on_days(rows: DataFrame, first, last) -> DataFrame:
    """Rows between two times, by their stored days: folders outside are not read."""
    if "day" not in rows.columns:
        return rows
    return rows.filter(F.col("day").between(F.to_date(first), F.to_date(last))).drop("day")


def tag_periods(measurements: DataFrame, spans: Mapping[str, Span]) -> DataFrame:
    """Readings inside any span, once per span, with its name in `period`."""
    ts = F.col("ts")
    names = [F.when(ts.between(a, b), F.lit(name)) for name, (a, b) in spans.items()]
    inside = None
    for a, b in spans.values():
        inside = ts.between(a, b) if inside is None else inside | ts.between(a, b)
    earliest = F.least(*(a for a, _ in spans.values())) if len(spans) > 1 else next(iter(spans.values()))[0]
    latest = F.greatest(*(b for _, b in spans.values())) if len(spans) > 1 else next(iter(spans.values()))[1]
    return (
        on_days(measurements, earliest, latest).filter(ts.between(earliest, latest) & inside)
        .withColumn("period", F.explode(F.array_compact(F.array(*names))))
    )


def low_rate_mean(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Mean x of low-rate sensors per key."""
    return (
        readings.filter(is_low_rate())
        .groupBy(*keys)
        .agg(F.avg("x").cast("decimal(18,6)").alias("reading"))
    )


def high_rate_peak(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the top 1 % magnitudes of high-rate sensors per key."""
    high = readings.filter(F.col("kind").isin(*HIGH_RATE)).withColumn("m", magnitude())
    return top_percent_mean(high, keys, "m", "_peak").select(
        *keys, F.col("_peak").cast("decimal(18,6)").alias("reading")
    )


def window_readings(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The reading each sensor is judged by: mean or peak, by its kind."""
    return low_rate_mean(readings, keys).unionByName(high_rate_peak(readings, keys))


PART = ("sensor_id", "day", "opening")


def day_parts(readings: DataFrame) -> DataFrame:
    """Readings (with kind) with the part they belong to: a sensor's day, or the instant that opens it.

    Windows are closed and end at a midnight, so they are days and one opening instant.
    """
    day = F.to_date("ts")
    return readings.withColumn("day", day).withColumn("opening", F.col("ts") == midnight(day))


def part_sums(parts: DataFrame) -> DataFrame:
    """Sum and count of low-rate readings per part."""
    low = parts.filter(is_low_rate()).groupBy(*PART)
    return low.agg(F.sum("x").alias("total"), F.count("x").alias("n"))


def part_bins(parts: DataFrame) -> DataFrame:
    """Histogram of the magnitudes of high-rate readings per part."""
    return binned_parts(_magnitudes(parts), PART, "m")


def _magnitudes(parts: DataFrame) -> DataFrame:
    return parts.filter(F.col("kind").isin(*HIGH_RATE)).withColumn("m", magnitude())


def members_of(windows: DataFrame) -> DataFrame:
    """The parts of windows (sensor_id, from_day, to_day and others): whole days, and the last one's opening."""
    days = windows.withColumn("day", F.explode(F.sequence("from_day", "to_day")))
    both = F.array(F.lit(True), F.lit(False))
    first = F.when(F.col("day") < F.col("to_day"), both).otherwise(F.array(F.lit(True)))
    return days.withColumn("opening", F.explode(first))


def merged_readings(
    parts: DataFrame, sums: DataFrame, bins: DataFrame, windows: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """`window_readings` of windows from partial results per part, whatever number of windows share a part.

    `sums` and `bins` are `part_sums` and `part_bins` of `parts`, or were stored when the
    readings came. The readings themselves are met only where a window's top 1 % ends.
    """
    members = members_of(windows).select(*dict.fromkeys([*keys, *PART]))
    added = sums.join(members, list(PART)).groupBy(*keys).agg(F.sum("total").alias("_t"), F.sum("n").alias("_n"))
    # rounded as a mean of decimals is: four more digits first
    mean = F.try_divide(F.col("_t"), F.col("_n")).cast("decimal(28,10)").cast("decimal(18,6)")
    low = added.select(*keys, mean.alias("reading"))
    high = merged_top_percent_mean(_magnitudes(parts), bins, members, PART, keys, "m", "_peak")
    return low.unionByName(high.select(*keys, F.col("_peak").cast("decimal(18,6)").alias("reading")))


def with_kind(measurements: DataFrame, sensors: DataFrame, *extra: str) -> DataFrame:
    """Readings with their sensor's kind (and other chosen columns)."""
    side = sensors.select(F.col("id").alias("sensor_id"), "kind", *extra)
    return measurements.join(side, "sensor_id")


def sensor_health(measurements: DataFrame, sensors: DataFrame, spans: Mapping[str, Span]) -> DataFrame:
    """Health of every sensor in every span; NULL without (enough) readings."""
    tagged = with_kind(
        tag_periods(readings_of(measurements, "sensor_id", "ts", "x", "y", "z"), spans), sensors
    )
    readings = window_readings(tagged, ["sensor_id", "period"])
    names = F.array(*(F.lit(name) for name in spans))
    wanted = sensors.select(
        F.col("id").alias("sensor_id"), "building_id", "kind", "threshold", F.explode(names).alias("period")
    )
    return wanted.join(readings, ["sensor_id", "period"], "left").withColumn(
        "health", health("kind", "reading", "threshold")
    )


def health_table(
    measurements: DataFrame, sensors: DataFrame, as_of, config: Config = DEFAULT
) -> DataFrame:
    """Health now and before, one row per sensor."""
    spans = day_spans(as_of, config.advice_periods)
    return health_pairs(sensor_health(measurements, sensors, spans))


def health_pairs(rows: DataFrame) -> DataFrame:
    """Health of both periods, one row per sensor."""

    def of(period: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col("health"))).cast("decimal(4,2)")

    return rows.groupBy("sensor_id", "building_id", "kind").agg(
        of("new").alias("health_now"), of("old").alias("health_before")
    )


def wall_of_sensor(sensors: DataFrame, walls: DataFrame) -> DataFrame:
    """The wall a sensor sits on: its point lies in the wall's bounding box.

    One row per sensor that is on a wall; the lowest wall id when on several.
    """
    s = sensors.select(
        F.col("id").alias("sensor_id"), "building_id", "floor", "x", "y", F.floor("x").cast("int").alias("_column")
    )
    w = walls.select(
        F.col("id").alias("wall_id"), "building_id", "floor", "x1", "y1", "x2", "y2",
        metre_columns("x1", "x2").alias("_column"),
    )
    return (
        s.join(w, ["building_id", "floor", "_column"])
        .filter(
            F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2"))
            & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
        )
        .groupBy("sensor_id")
        .agg(F.min("wall_id").alias("wall_id"))
    )


def _advice(kind: str, text: bool) -> Column:
    rule = ADVICE_RULES[kind]
    now, before = F.col("health_now"), F.col("health_before")
    limit = before - F.lit("0.3").cast("decimal(2,1)") * before
    dropped = now <= limit if rule.inclusive_drop else now < limit
    mild, severe, none = (
        (rule.mild_text, rule.severe_text, NO_ADVICE)
        if text
        else (rule.mild_importance, rule.severe_importance, 0)
    )
    return (
        F.when(dropped & (now >= rule.limit), F.lit(mild))
        .when(now < rule.limit, F.lit(severe))
        .otherwise(F.lit(none))
    )


def _by_kind(pick) -> Column:
    out = F.lit(None)
    for kind in ADVICE_RULES:
        out = F.when(F.col("kind") == kind, pick(kind)).otherwise(out)
    return out


def advice(health_rows: DataFrame, sensors: DataFrame, walls: DataFrame) -> DataFrame:
    """Advice text, importance and label for each health row, needed or not."""
    cracks = sensors.filter(F.col("kind") == CRACK)
    named = health_rows.join(wall_of_sensor(cracks, walls), "sensor_id", "left")
    subject = F.when(F.col("kind") == CRACK, F.col("wall_id")).otherwise(F.col("sensor_id"))
    return named.select(
        "sensor_id",
        "building_id",
        "kind",
        F.concat(_by_kind(lambda k: F.lit(ADVICE_RULES[k].prefix)), subject.cast("string")).alias("label"),
        _by_kind(lambda k: _advice(k, text=True)).alias("advice"),
        _by_kind(lambda k: _advice(k, text=False)).alias("importance"),
    )


def interventions(
    health_rows: DataFrame, sensors: DataFrame, walls: DataFrame, strictness: int
) -> DataFrame:
    """Advised interventions for sensors at or below a health, most important first."""
    ill = health_rows.filter(F.col("health_now") <= strictness)
    return (
        advice(ill, sensors, walls)
        .filter(F.col("importance") != 0)
        .orderBy(F.desc("importance"), "sensor_id")
    )


def deviation_ranking(measurements: DataFrame, sensors: DataFrame, at, top: int = 5) -> DataFrame:
    """Low-rate sensors by how far their highest readings of 24 hours exceed the threshold."""
    at = as_ntz(at)
    before = at - F.expr("INTERVAL 24 HOURS")
    day = on_days(readings_of(measurements, "sensor_id", "ts", "x"), before, at).filter(F.col("ts").between(before, at))
    low = sensors.filter(is_low_rate()).select(
        F.col("id").alias("sensor_id"), "building_id", "kind", "threshold", "importance"
    )
    highest = _top_rows(day.join(low, "sensor_id", "left_semi"), ["sensor_id"], F.desc("x"), top)
    mean = highest.groupBy("sensor_id").agg(F.avg("x").alias("_mean"))
    gap = F.try_divide(F.col("_mean") - F.col("threshold"), F.col("threshold").cast("decimal(9,6)"))
    return (
        mean.join(low, "sensor_id")
        .select("sensor_id", "building_id", "kind", F.round(gap, 2).alias("deviation"), "importance")
        .orderBy(F.desc("deviation"), "sensor_id")
    )


def _top_rows(df: DataFrame, keys: list[str], order: Column, k: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def alerts(measurements: DataFrame, sensors: DataFrame) -> DataFrame:
    """One alert per reading at or over its sensor's threshold (batch or stream)."""
    return (
        with_kind(measurements.select("sensor_id", "ts", "x", "y", "z"), sensors, "threshold")
        .filter(threshold_exceeded())
        .select("sensor_id", "ts")
    )


def _sensor_areas(sensors: DataFrame, buildings: DataFrame) -> DataFrame:
    homes = buildings.select(F.col("id").alias("building_id"), "area")
    return sensors.select(F.col("id").alias("sensor_id"), "building_id", "kind").join(homes, "building_id")


def alert_summary(
    alert_rows: DataFrame,
    sensors: DataFrame,
    buildings: DataFrame,
    areas: DataFrame,
    kinds: tuple[str, ...] | None = None,
) -> DataFrame:
    """First alert and number of alerts per area, areas without alerts included.

    All kinds of sensor count unless `kinds` names some.
    """
    placed = _sensor_areas(sensors, buildings)
    if kinds:
        placed = placed.filter(F.col("kind").isin(*kinds))
    per_sensor = alert_rows.groupBy("sensor_id").agg(
        F.min("ts").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    found = (
        per_sensor.join(placed, "sensor_id")
        .groupBy("area")
        .agg(F.min("_first").alias("first_alert"), F.sum("_n").alias("alerts"))
    )
    return (
        areas.select(F.col("postcode").alias("area"))
        .join(found, "area", "left")
        .withColumn("alerts", F.coalesce("alerts", F.lit(0)))
    )


def expected_alerts(
    summary: DataFrame, sensors: DataFrame, buildings: DataFrame, as_of
) -> DataFrame:
    """Alerts expected per area: one per high-rate sensor and day since the first alert."""
    counts = (
        _sensor_areas(sensors, buildings)
        .filter(F.col("kind").isin(*HIGH_RATE))
        .groupBy("area")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    days = whole_days("first_alert", midnight(as_date(as_of)))
    return summary.join(counts, "area", "left").select(
        *summary.columns, (F.coalesce("_n", F.lit(0)) * days).alias("expected")
    )
