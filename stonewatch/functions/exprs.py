"""Scalar domain functions: Column in, Column out."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from stonewatch.config import ACCEL, DEFAULT, HEALTH_WEIGHT, LOW_RATE, Config

EARTH_RADIUS_KM = 6371
UNKNOWN = "unknown seniority"
OUT_OF_RANGE = "date out of range"

# Ground velocity to Mercalli degrees, below and above the knee.
MERCALLI_KNEE = Decimal("0.234686")
MERCALLI_LOW = (9.0, 0.17)
MERCALLI_HIGH = (9.4, 0.2)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_date(value: dt.date | str | Column) -> Column:
    """A date literal, or the column itself."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("date")


def as_ntz(value: dt.datetime | dt.date | str | Column) -> Column:
    """A zone-free timestamp literal, or the column itself."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def days_before(date: Column, n: int) -> Column:
    return F.date_sub(date, n)


def midnight(date: Column) -> Column:
    """A date taken as a point in time: readings later that day lie after it."""
    return date.cast("timestamp_ntz")


def magnitude(x="x", y="y", z="z") -> Column:
    """Length of the (x, y, z) vector; NULL when any axis is missing."""
    x, y, z = (col(c).cast("double") for c in (x, y, z))
    return F.sqrt(x * x + y * y + z * z)


def is_low_rate(kind="kind") -> Column:
    return col(kind).isin(*LOW_RATE)


def health_weight(kind="kind") -> Column:
    out = F.lit(None).cast("decimal(9,6)")
    for name, weight in HEALTH_WEIGHT.items():
        out = F.when(col(kind) == name, F.lit(weight).cast("decimal(9,6)")).otherwise(out)
    return out


def health(kind, reading, threshold) -> Column:
    """Health 0..10 of a sensor from its window reading.

    Accelerometers are judged without gravity: one unit comes off both the
    threshold and the reading.
    """
    kind, x, s = col(kind), col(reading), col(threshold)
    moving = kind == ACCEL
    s = F.when(moving, s - 1).otherwise(s).cast("decimal(9,6)")
    x = F.when(moving, F.abs(x - 1)).otherwise(x).cast("decimal(18,6)")
    p = health_weight(kind)
    fall = (x - p * s).cast("double") / F.nullif((s - p * x).cast("double"), F.lit(0.0))
    return (
        F.when(x <= p * s, F.lit(10.0))
        .when(x >= s, F.lit(0.0))
        .otherwise(F.lit(10.0) - F.lit(10.0) * fall)
        .cast("decimal(5,2)")
    )


def threshold_exceeded(kind="kind", threshold="threshold") -> Column:
    """Whether a reading raises an alert; NULL axes never do."""
    low = col("x") >= col(threshold)
    high = magnitude() >= col(threshold).cast("double")
    return F.coalesce(F.when(is_low_rate(kind), low).otherwise(high), F.lit(False))


def _radians(degrees: Column) -> Column:
    return (degrees.cast("double") * F.pi() / 180).cast("decimal(9,6)")


def distance_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in whole kilometres; radians keep six decimals."""
    lat1, lon1, lat2, lon2 = (_radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin((lat2 - lat1).cast("double") / 2)
    half_lon = F.sin((lon2 - lon1).cast("double") / 2)
    chord = half_lat * half_lat + (
        F.cos(lat1.cast("double")) * F.cos(lat2.cast("double")) * half_lon * half_lon
    )
    return F.round(F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.sqrt(chord)), 0).cast("int")


def mercalli(pgv) -> Column:
    """Mercalli degrees felt for a peak ground velocity."""
    pgv = col(pgv)
    x = pgv.cast("double")
    low = MERCALLI_LOW[0] * F.pow(x, F.lit(MERCALLI_LOW[1]))
    high = MERCALLI_HIGH[0] * F.pow(x, F.lit(MERCALLI_HIGH[1]))
    return (
        F.when(pgv <= 0, F.lit(0.0))
        .when(pgv <= F.lit(MERCALLI_KNEE), low)
        .otherwise(high)
        .cast("decimal(4,2)")
    )


def attenuation(distance, config: Config = DEFAULT) -> Column:
    """How many times weaker an event is felt at a distance than at its centre."""
    step = col(distance).cast("double") / config.attenuation_km + 1
    return step * step


def intensity_at(intensity, distance, config: Config = DEFAULT) -> Column:
    """Intensity left at a distance from the centre."""
    return (col(intensity).cast("double") / attenuation(distance, config)).cast("decimal(9,2)")


def whole_years(start, end) -> Column:
    """Completed years from start to end, negative when end comes first."""
    return F.timestamp_diff("YEAR", col(start), col(end))


def whole_days(start, end) -> Column:
    """Completed days between two zone-free times."""
    return F.extract(F.lit("DAY"), col(end) - col(start))


def shift_minutes(start="start", end="end") -> Column:
    """Completed minutes between two zone-free times."""
    gap = col(end) - col(start)
    hours = F.extract(F.lit("DAY"), gap) * 24 + F.extract(F.lit("HOUR"), gap)
    return (hours * 60 + F.extract(F.lit("MINUTE"), gap)).cast("long")


def hourly_pay(seniority, on_date, as_of, config: Config = DEFAULT) -> Column:
    """Pay a worker had on a date; NULL (see `pay_reason`) when it cannot be told."""
    years = col(seniority) - whole_years(on_date, as_date(as_of))
    pay = (F.lit(config.base_pay) + years * F.lit(config.yearly_raise)).cast("decimal(10,2)")
    return F.when(pay >= F.lit(config.base_pay), pay)


def supervision_capacity(seniority, on_date, as_of, config: Config = DEFAULT) -> Column:
    """How many workers one could supervise on a date; NULL when it cannot be told."""
    years = col(seniority) - whole_years(on_date, as_date(as_of))
    extra = F.round(years.cast("decimal(10,0)") * F.lit(config.yearly_crew), 0).cast("int")
    crew = F.lit(config.base_crew) + extra
    return F.when(crew >= config.base_crew, crew)


def seniority_reason(seniority, result) -> Column:
    """Why pay or capacity is NULL."""
    return (
        F.when(col(seniority).isNull(), F.lit(UNKNOWN))
        .when(col(result).isNull(), F.lit(OUT_OF_RANGE))
    )


def percent_change(new, old) -> Column:
    """new relative to old in percent, one decimal; NULL when old is zero."""
    new, old = (col(c).cast("decimal(18,1)") for c in (new, old))
    share = F.try_divide((new - old) * F.lit(100).cast("decimal(3,0)"), old)
    return F.round(share, 1).cast("decimal(20,1)")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The text of the first check that is true; NULL when none is."""
    out = F.lit(None).cast("string")
    for cond, text in reversed(checks):
        out = F.when(cond, F.lit(text)).otherwise(out)
    return out


def segment_key(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    """A segment as its two ends in a fixed order, whatever its direction."""
    a = F.struct(col(x1).alias("x"), col(y1).alias("y"))
    b = F.struct(col(x2).alias("x"), col(y2).alias("y"))
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
