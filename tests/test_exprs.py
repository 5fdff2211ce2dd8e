from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from stonewatch.config import SENSOR_KINDS
from stonewatch.functions import exprs as e


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def dec(text, kind="decimal(9,6)"):
    return F.lit(text).cast(kind)


def test_distance_is_whole_kilometres_and_symmetric(spark):
    a, b = ("10.236771", "44.069816"), ("10.388135", "43.720942")
    there = one(spark, e.distance_km(*(F.lit(v) for v in a + b)))
    back = one(spark, e.distance_km(*(F.lit(v) for v in b + a)))
    assert there == back == 42
    assert one(spark, e.distance_km(*(F.lit(v) for v in a + a))) == 0


@pytest.mark.parametrize(
    "pgv, degrees",
    [("0", "0.00"), ("-1", "0.00"), ("0.234686", "7.03"), ("0.234687", "7.03"), ("0.103024", "6.12"), ("1", "9.40")],
)
def test_mercalli(spark, pgv, degrees):
    assert one(spark, e.mercalli(dec(pgv))) == D(degrees)


def test_mercalli_of_unknown_is_unknown(spark):
    assert one(spark, e.mercalli(F.lit(None).cast("decimal(9,6)"))) is None


@pytest.mark.parametrize(
    "kind, reading, threshold, health",
    [
        ("Termometro", "28", "40", "10.00"),  # exactly at the weight
        ("Termometro", "40", "40", "0.00"),  # exactly at the threshold
        ("Termometro", "32.6", "40", "7.32"),
        ("Fessurimetro", "7.4", "9", "3.07"),
        ("Accelerometro", "0.98", "1.115", "10.00"),  # gravity off, absolute
        ("Accelerometro", "1.115", "1.115", "0.00"),
        ("Giroscopio", None, "0.115", None),
    ],
)
def test_health(spark, kind, reading, threshold, health):
    got = one(spark, e.health(F.lit(kind), dec(reading, "decimal(18,6)"), dec(threshold)))
    assert got == (None if health is None else D(health))


def test_every_kind_has_a_weight(spark):
    for kind in SENSOR_KINDS:
        assert one(spark, e.health_weight(F.lit(kind))) is not None


def test_pay_and_capacity(spark):
    day = F.lit("2020-12-02").cast("date")
    assert one(spark, e.hourly_pay(F.lit(4), day, "2023-02-01")) == D("12.00")
    assert one(spark, e.hourly_pay(F.lit(4), day, "2023-12-02")) == D("11.00")
    assert one(spark, e.hourly_pay(F.lit(4), day, "2025-12-02")) is None  # below base pay
    assert one(spark, e.supervision_capacity(F.lit(9), day, "2023-02-01")) == 12  # 3.5 rounds up
    assert one(spark, e.supervision_capacity(F.lit(2), day, "2023-02-01")) == 8
    assert one(spark, e.supervision_capacity(F.lit(1), day, "2023-02-01")) is None  # -0.5 goes to -1
    assert one(spark, e.supervision_capacity(F.lit(None).cast("int"), day, "2023-02-01")) is None


def test_supervision_capacity_below_base_is_unknown(spark):
    day = F.lit("2020-12-02").cast("date")
    assert one(spark, e.supervision_capacity(F.lit(0), day, "2023-12-03")) is None


@pytest.mark.parametrize("new, old, text", [("2.0", "3.5", "-42.9"), ("8", "60", "-86.7"), ("1", "0", None)])
def test_percent_change(spark, new, old, text):
    got = one(spark, e.percent_change(F.lit(new), F.lit(old)))
    assert got == (None if text is None else D(text))


@pytest.mark.parametrize("zone", ["UTC", "Europe/Rome"])
def test_times_ignore_clock_changes(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        def ntz(text):
            return F.lit(text).cast("timestamp_ntz")

        night = e.shift_minutes(ntz("2020-03-29 01:00:00"), ntz("2020-03-29 04:30:59"))
        assert one(spark, night) == 210
        assert one(spark, e.shift_minutes(ntz("2020-03-29 04:00:00"), ntz("2020-03-29 03:00:00"))) == -60
        assert one(spark, e.shift_minutes(ntz("2020-03-28 22:00:00"), ntz("2020-03-30 06:00:00"))) == 1920
        assert one(spark, e.whole_days(ntz("2020-03-28 12:00:00"), ntz("2020-03-29 12:00:00"))) == 1
        assert one(spark, e.whole_days(ntz("2020-03-28 12:00:01"), ntz("2020-03-29 12:00:00"))) == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_segment_key_ignores_direction(spark):
    a = e.segment_key(F.lit(1), F.lit(2), F.lit(3), F.lit(0))
    b = e.segment_key(F.lit(3), F.lit(0), F.lit(1), F.lit(2))
    assert one(spark, a == b)
