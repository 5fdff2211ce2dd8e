"""Disasters: buildings hit, ground motion, intensity and damage."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.config import ACCEL, DEFAULT, GYRO, HIGH_RATE, Config
from stonewatch.functions.exprs import attenuation, distance_km, intensity_at, magnitude, mercalli
from stonewatch.functions.grouped import top_percent_mean

GROUND_FLOORS = (0, 1, 2)
TOTAL_LOSS = 10
NO_LOSS = 4


def hit_buildings(disasters: DataFrame, disaster_areas: DataFrame, buildings: DataFrame) -> DataFrame:
    """Buildings in the areas a disaster touched, with their distance from its centre."""
    centre = disasters.select(
        F.col("ts").alias("disaster_ts"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")
    )
    homes = buildings.select(F.col("id").alias("building_id"), "area", "lat", "lon")
    return (
        disaster_areas.select("area", "disaster_ts")
        .distinct()
        .join(centre, "disaster_ts")
        .join(homes, "area")
        .select("disaster_ts", "building_id", distance_km("lat", "lon", "_lat", "_lon").alias("distance_km"))
    )


def peak_motion(measurements: DataFrame, sensors: DataFrame, hits: DataFrame) -> DataFrame:
    """Peak ground acceleration and rotation per disaster and building.

    Readings within a minute of the disaster, both ends included, meet it by sensor
    and clock minute; each sensor counts with its top 1 %, less 10 % per floor.
    """
    minute = F.expr("INTERVAL 1 MINUTE")
    at = F.col("disaster_ts")
    clock = F.array(*(F.date_trunc("minute", t) for t in (at - minute, at, at + minute)))
    placed = (
        sensors.filter(F.col("kind").isin(*HIGH_RATE) & F.col("floor").isin(*GROUND_FLOORS))
        .select(F.col("id").alias("sensor_id"), "building_id", "kind", "floor")
        .join(hits.select("disaster_ts", "building_id"), "building_id")
        .withColumn("_minute", F.explode(clock))
    )
    by_day = ["day"] if "day" in measurements.columns else []
    if by_day:  # stored days without a disaster are pruned by the join
        placed = placed.withColumn("day", F.to_date("_minute"))
    near = (
        measurements.select("sensor_id", "ts", magnitude().alias("m"), *by_day)
        .withColumn("_minute", F.date_trunc("minute", "ts"))
        .join(placed, [*by_day, "sensor_id", "_minute"])
        .filter(F.col("ts").between(at - minute, at + minute))
    )
    per_sensor = top_percent_mean(
        near,
        ["disaster_ts", "building_id", "sensor_id", "kind", "floor"],
        "m",
        "_peak",
        value=lambda m: F.when(F.col("kind") == ACCEL, F.abs(m - 1)).otherwise(m),
    )
    damped = F.col("_peak") * (F.lit(1.0) - F.lit(0.1) * F.col("floor"))

    def of(kind: str):
        return F.avg(F.when(F.col("kind") == kind, damped)).cast("decimal(9,6)")

    return per_sensor.groupBy("disaster_ts", "building_id").agg(
        of(ACCEL).alias("pga"), of(GYRO).alias("pgr")
    )


def hit_statistics(measurements: DataFrame, sensors: DataFrame, hits: DataFrame) -> DataFrame:
    """Distance and Mercalli degrees felt, per disaster and building hit."""
    motion = peak_motion(measurements, sensors, hits)
    pgv = ((F.col("pga") + F.col("pgr")) * F.lit(Decimal("0.5"))).cast("decimal(9,6)")
    return hits.join(motion, ["disaster_ts", "building_id"], "left").select(
        "disaster_ts", "building_id", "distance_km", mercalli(pgv).alias("mercalli")
    )


def new_hits(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Hits of disasters not estimated before: each disaster is estimated once."""
    return hits.join(known.select("disaster_ts").distinct(), "disaster_ts", "left_anti")


def estimate_new(measurements: DataFrame, sensors: DataFrame, hits: DataFrame, known: DataFrame) -> DataFrame:
    """Statistics of the disasters without any so far, to be added to the known ones."""
    return hit_statistics(measurements, sensors, new_hits(hits, known))


def epicentre_intensity(statistics: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Intensity at the centre: what buildings felt, with the attenuation undone."""
    at_centre = F.col("mercalli").cast("double") * attenuation("distance_km", config)
    return statistics.groupBy("disaster_ts").agg(
        F.avg(at_centre).cast("decimal(18,6)").cast("decimal(9,2)").alias("intensity")
    )


def felt_intensity(intensities: DataFrame, radius_km, config: Config = DEFAULT) -> DataFrame:
    """Intensity felt at a distance (a number or a column) from the centre."""
    radius = F.lit(radius_km) if isinstance(radius_km, (int, float)) else F.col(radius_km)
    return intensities.withColumn("felt", intensity_at("intensity", radius, config))


def building_value(projects: DataFrame) -> DataFrame:
    """What was spent on each building; projects still open count nothing."""
    return projects.groupBy("building_id").agg(
        F.sum(F.coalesce("cost", F.lit(0).cast("decimal(10,2)"))).alias("value")
    )


def damage(statistics: DataFrame, states: DataFrame, values: DataFrame) -> DataFrame:
    """Share destroyed and loss per disaster and building.

    `states` has building_id, as_of (the day before the disaster) and state.
    Buildings without a felt intensity get a reason instead of a number.
    """
    felt, state = F.col("mercalli"), F.col("state")
    partial = (
        F.lit(0.02)
        * F.pow((felt - 3).cast("double"), F.lit(2))
        * (200 - state)
        / 100
    )
    share = (
        F.when(felt <= NO_LOSS, F.lit(0.0))
        .when(felt >= TOTAL_LOSS, F.lit(1.0))
        .when(felt.isNotNull(), partial)
        .cast("decimal(4,2)")
    )
    whole = F.round("value", 0).cast("bigint")
    return (
        statistics.withColumn("as_of", F.date_sub(F.to_date("disaster_ts"), 1))
        .join(states, ["building_id", "as_of"], "left")
        .join(values, "building_id", "left")
        .withColumn("share", share)
        .select(
            "disaster_ts",
            "building_id",
            "mercalli",
            "state",
            "share",
            F.round(whole.cast("decimal(18,0)") * F.col("share"), 0).cast("bigint").alias("damage"),
            F.when(felt.isNull(), F.lit("building not hit")).alias("reason"),
        )
    )
