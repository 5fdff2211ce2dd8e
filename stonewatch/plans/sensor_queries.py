"""Registered queries of sensor health, advice, ranking and alerts."""

import uuid

from pyspark.sql import functions as F

from stonewatch.config import DEFAULT
from stonewatch.functions.exprs import magnitude
from stonewatch.functions.grouped import shared_folder, top_percent_mean
from stonewatch.operators import sensors as op
from stonewatch.plans.registry import Roles, query
from stonewatch.plans.roles import CALC_DATE
from stonewatch.sources import tables as store
from stonewatch.plans.sqltext import (
    ADVICE_SELECT,
    HEALTH_PAIR,
    HIGH,
    LOW,
    MAGNITUDE,
    ON_WALL,
    health_ctes,
    mean6,
    ratio,
)

P = DEFAULT.advice_periods
HEALTH = health_ctes(CALC_DATE, P.new, P.old)
#: The same over readings as stored: one per sensor and time, the smallest values.
ONCE = {
    "once": "SELECT sensor_id, ts, v.x AS x, v.y AS y, v.z AS z FROM (SELECT sensor_id, ts, MIN({'x': x, 'y': y, 'z': z}) AS v"
    " FROM measurement GROUP BY 1, 2)",
    **{name: sql.replace("measurement", "once") for name, sql in HEALTH.items()},
}
RANKING_AT = "2024-01-29 23:59:59"


@query(
    "vector_magnitude",
    "event_id:l m:d",
    "measurement",
    f"SELECT event_id, round({MAGNITUDE}, 6) AS m FROM measurement",
)
def vector_magnitude(r: Roles):
    return r.measurement.select("event_id", F.round(magnitude(), 6).alias("m"))


@query(
    "low_rate_mean",
    "sensor_id:l reading:d",
    "measurement sensor",
    f"SELECT sensor_id, {mean6('m.x')} AS reading FROM measurement m JOIN sensor s ON s.id = m.sensor_id"
    f" WHERE kind IN {LOW} GROUP BY sensor_id",
)
def low_rate_mean(r: Roles):
    return op.low_rate_mean(op.with_kind(r.measurement, r.sensor), ["sensor_id"])


@query(
    "top_percent_magnitude",
    "sensor_id:l peak:d",
    "measurement",
    "SELECT sensor_id, round(AVG(m), 4) AS peak FROM (SELECT sensor_id, m, ROW_NUMBER() OVER (PARTITION BY sensor_id"
    f" ORDER BY m DESC) AS rn, COUNT(*) OVER (PARTITION BY sensor_id) AS n FROM (SELECT sensor_id, {MAGNITUDE} AS m"
    " FROM measurement)) WHERE rn * 100 <= n GROUP BY sensor_id",
)
def top_percent_magnitude(r: Roles):
    rows = r.measurement.withColumn("m", magnitude())
    return top_percent_mean(rows, ["sensor_id"], "m", "peak").withColumn("peak", F.round("peak", 4))


@query(
    "sensor_health",
    "sensor_id:l building_id:l kind:s threshold:d period:s reading:d health:d",
    "measurement sensor",
    "SELECT * FROM h",
    **HEALTH,
)
def sensor_health(r: Roles):
    return op.sensor_health(r.measurement, r.sensor, op.day_spans(CALC_DATE, P))


@query(
    "sensor_health_periods",
    "sensor_id:l building_id:l kind:s health_now:d health_before:d",
    "measurement sensor",
    HEALTH_PAIR,
    **HEALTH,
)
def sensor_health_periods(r: Roles):
    return op.health_table(r.measurement, r.sensor, CALC_DATE)


@query(
    "maintained_health",
    "sensor_id:l building_id:l kind:s health_now:d health_before:d",
    "measurement sensor",
    HEALTH_PAIR,
    **ONCE,
)
def maintained_health(r: Roles):
    """Readings are stored, those of the last two days appended; health comes from the parts kept of each day."""
    root = f"{shared_folder(r.spark)}/health-{uuid.uuid4().hex}"
    rows = r.measurement.select("sensor_id", "ts", "x", "y", "z")
    last = F.date_sub(F.to_date(F.lit(CALC_DATE)), 2)
    store.append_with_parts(r.spark, root, rows.filter(F.to_date("ts") < last), r.sensor)
    store.append_with_parts(r.spark, root, rows.filter(F.to_date("ts") >= last), r.sensor)
    return store.stored_health(r.spark, root, r.sensor, CALC_DATE)


@query("sensor_wall_match", "sensor_id:l wall_id:l", "sensor wall", ON_WALL)
def sensor_wall_match(r: Roles):
    return op.wall_of_sensor(r.sensor, r.wall)


def _rule_query(name: str, kind: str):
    @query(
        name,
        "sensor_id:l building_id:l kind:s label:s advice:s importance:l",
        "measurement sensor wall",
        f"SELECT * FROM ({ADVICE_SELECT}) WHERE kind = '{kind}'",
        **HEALTH,
        hp=HEALTH_PAIR,
        ow=ON_WALL,
    )
    def run(r: Roles):
        table = op.health_table(r.measurement, r.sensor.filter(F.col("kind") == kind), CALC_DATE)
        return op.advice(table, r.sensor, r.wall)


_rule_query("advice_crack", "Fessurimetro")
_rule_query("advice_rain", "Pluviometro")
_rule_query("advice_temperature", "Termometro")
_rule_query("advice_humidity", "Igrometro")
_rule_query("advice_acceleration", "Accelerometro")
_rule_query("advice_rotation", "Giroscopio")


def recommend(r: Roles, strictness: int):
    table = op.health_table(r.measurement, r.sensor, CALC_DATE)
    return op.interventions(table, r.sensor, r.wall, strictness)


def _recommend_query(name: str, strictness: int):
    @query(
        name,
        "sensor_id:l building_id:l kind:s label:s advice:s importance:l",
        "measurement sensor wall",
        f"SELECT * FROM ({ADVICE_SELECT} WHERE health_now <= {strictness}) WHERE importance <> 0"
        " ORDER BY importance DESC, sensor_id",
        **HEALTH,
        hp=HEALTH_PAIR,
        ow=ON_WALL,
    )
    def run(r: Roles):
        return recommend(r, strictness)


_recommend_query("intervention_recommendations", 10)
_recommend_query("intervention_recommendations_strict", 2)


@query(
    "sensor_deviation_ranking",
    "sensor_id:l building_id:l kind:s deviation:d importance:d",
    "measurement sensor",
    "SELECT sensor_id, building_id, kind, importance, "
    + ratio("CAST((sm * 1000000 - n * threshold * 1000000) AS HUGEINT)", "CAST(n * threshold * 1000000 AS HUGEINT)", 2)
    + " AS deviation FROM (SELECT sensor_id, building_id, kind, importance, threshold, SUM(x) AS sm, COUNT(*) AS n FROM ("
    "SELECT m.sensor_id, m.x, s.building_id, s.kind, s.importance, s.threshold, ROW_NUMBER() OVER (PARTITION BY"
    " m.sensor_id ORDER BY m.x DESC) AS rn FROM measurement m JOIN sensor s ON s.id = m.sensor_id WHERE"
    f" s.kind IN {LOW} AND m.ts BETWEEN TIMESTAMP '{RANKING_AT}' - INTERVAL 24 HOUR AND TIMESTAMP '{RANKING_AT}')"
    " WHERE rn <= 5 GROUP BY 1, 2, 3, 4, 5)",
)
def sensor_deviation_ranking(r: Roles):
    return op.deviation_ranking(r.measurement, r.sensor, RANKING_AT)


ALERT_SQL = (
    "SELECT m.sensor_id, m.ts FROM (SELECT *, " + MAGNITUDE + " AS m FROM measurement) m JOIN sensor s"
    f" ON s.id = m.sensor_id WHERE CASE WHEN s.kind IN {LOW} THEN m.x >= s.threshold ELSE m.m >="
    " CAST(s.threshold AS DOUBLE) END"
)


@query("threshold_alerts", "sensor_id:l ts:t", "measurement sensor", ALERT_SQL)
def threshold_alerts(r: Roles):
    return op.alerts(r.measurement, r.sensor)


SUMMARY_SQL = (
    "SELECT a.postcode AS area, MIN(p.ts) AS first_alert, COUNT(p.ts) AS alerts FROM area a LEFT JOIN (SELECT b.area, al.ts"
    " FROM al JOIN sensor s ON s.id = al.sensor_id JOIN building b ON b.id = s.building_id) p ON p.area = a.postcode GROUP BY 1"
)
EXPECTED_SQL = (
    "SELECT su.*, coalesce(c.n, 0) * (date_diff('microsecond', su.first_alert, TIMESTAMP '{day} 00:00:00') // 86400000000)"
    " AS expected FROM su LEFT JOIN (SELECT b.area, COUNT(*) AS n FROM sensor s JOIN building b ON b.id = s.building_id"
    f" WHERE s.kind IN {HIGH} GROUP BY 1) c ON c.area = su.area"
).replace("{day}", CALC_DATE)


@query(
    "alerts_by_area",
    "area:s first_alert:t alerts:l",
    "measurement sensor building area",
    SUMMARY_SQL,
    al=ALERT_SQL,
)
def alerts_by_area(r: Roles):
    return op.alert_summary(op.alerts(r.measurement, r.sensor), r.sensor, r.building, r.area)


@query(
    "expected_alerts",
    "area:s first_alert:t alerts:l expected:l",
    "measurement sensor building area",
    EXPECTED_SQL,
    al=ALERT_SQL,
    su=SUMMARY_SQL,
)
def expected_alerts(r: Roles):
    summary = op.alert_summary(op.alerts(r.measurement, r.sensor), r.sensor, r.building, r.area)
    return op.expected_alerts(summary, r.sensor, r.building, CALC_DATE)
