"""Registered queries of risk, building state, trends and disasters."""

import uuid

from pyspark.sql import functions as F

from stonewatch.config import DEFAULT
from stonewatch.functions.exprs import distance_km, mercalli
from stonewatch.functions.grouped import cut_lineage, shared_folder
from stonewatch.operators import disaster, risk
from stonewatch.operators import sensors as sensor_op
from stonewatch.plans.registry import Roles, query
from stonewatch.plans.roles import CALC_DATE
from stonewatch.plans.sensor_queries import ALERT_SQL, EXPECTED_SQL, SUMMARY_SQL
from stonewatch.plans.sqltext import MAGNITUDE, health_ctes, quoted, ratio
from stonewatch.sources import tables as store

RISK_DATE = "2001-06-30"
EARLIER = "2000-12-30"
TIE = "risk_id"
P = DEFAULT.risk_periods


def in_force_sql(day: str) -> str:
    return (
        "SELECT area, kind, coefficient, measured FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY area, kind ORDER BY"
        f" measured DESC, risk_id DESC) AS rn FROM risk WHERE measured <= DATE '{day}') WHERE rn = 1"
    )


def mean_sql(source: str, to: int = 2) -> str:
    four = ratio("CAST(SUM(coefficient) AS HUGEINT)", "COUNT(*)", 4)
    return f"SELECT area, CAST(round({four}, {to}) AS DECIMAL(4,{to})) AS mean_risk FROM {source} GROUP BY 1"


@query("risk_in_force", "area:s kind:s coefficient:l measured:D", "risk", in_force_sql(RISK_DATE))
def risk_in_force(r: Roles):
    return risk.risk_in_force(r.risk, RISK_DATE, TIE)


@query(
    "risk_on_dates",
    "stage_id:l area:s kind:s date:D coefficient:l",
    "stage building risk",
    "SELECT a.*, k.coefficient FROM asked a ASOF LEFT JOIN (SELECT * FROM risk QUALIFY ROW_NUMBER() OVER (PARTITION BY area,"
    " kind, measured ORDER BY risk_id DESC) = 1) k ON k.area = a.area AND k.kind = a.kind AND k.measured <= a.date",
    asked="SELECT s.id AS stage_id, b.area, 'Sismico' AS kind, s.ended AS date FROM stage s JOIN building b"
    " ON b.id = s.project_id WHERE s.ended IS NOT NULL",
)
def risk_on_dates(r: Roles):
    asked = (
        r.stage.filter(F.col("ended").isNotNull())
        .join(r.building.select(F.col("id").alias("project_id"), "area"), "project_id")
        .select(F.col("id").alias("stage_id"), "area", F.lit("Sismico").alias("kind"), F.col("ended").alias("date"))
    )
    return risk.risk_on_dates(asked, r.risk, TIE)


@query("avg_risk", "area:s mean_risk:d", "risk", mean_sql("f"), f=in_force_sql(RISK_DATE))
def avg_risk(r: Roles):
    return risk.area_risk_mean(r.risk, RISK_DATE, TIE)


def _percent(new: str, old: str) -> str:
    return f"CAST(CAST({ratio(f'CAST(({new} - {old}) * 1000 AS HUGEINT)', f'nullif(CAST({old} * 10 AS HUGEINT), 0)', 1)} AS DECIMAL(20,1)) AS VARCHAR)"


T = risk.RISK_MOVED
RISK_TREND_SQL = (
    "SELECT area, risk_now, risk_before, CASE WHEN risk_now = risk_before THEN "
    + quoted([risk.RISK_STABLE])
    + f" ELSE {quoted([T[0]])} || CAST(risk_before AS VARCHAR) || {quoted([T[1]])} || CAST(risk_now AS VARCHAR) ||"
    f" CASE WHEN risk_now < risk_before THEN {quoted([T[2]])} ELSE {quoted([T[3]])} END || "
    + _percent("risk_now", "risk_before")
    + f" || {quoted([T[4]])} END AS trend FROM (SELECT a.postcode AS area, CAST(round(n.mean_risk, 1) AS DECIMAL(2,1)) AS"
    " risk_now, CAST(round(o.mean_risk, 1) AS DECIMAL(2,1)) AS risk_before FROM area a LEFT JOIN mn n ON n.area = a.postcode"
    " LEFT JOIN mo o ON o.area = a.postcode)"
)
RISK_TREND_CTES = {
    "fn": in_force_sql(RISK_DATE),
    "fo": in_force_sql(EARLIER),
    "mn": mean_sql("fn"),
    "mo": mean_sql("fo"),
}


@query(
    "risk_trend",
    "area:s risk_now:d risk_before:d trend:s",
    "risk area",
    RISK_TREND_SQL,
    **RISK_TREND_CTES,
)
def risk_trend(r: Roles):
    return risk.risk_trend(r.risk, r.area, RISK_DATE, tie=TIE)


A = risk.ALERTS_DIFFER
ALERT_TREND_SQL = (
    f"SELECT area, alerts, expected, CASE WHEN alerts = expected THEN {quoted([risk.ALERTS_EQUAL])} ELSE {quoted([A[0]])} ||"
    f" CAST(alerts AS VARCHAR) || {quoted([A[1]])} || CASE WHEN alerts < expected THEN {quoted([A[2]])} ELSE {quoted([A[3]])}"
    f" END || {quoted([A[4]])} || "
    + _percent("alerts", "expected")
    + f" || {quoted([A[5]])} || CAST(expected AS VARCHAR) || {quoted([A[6]])} END AS trend FROM ex"
)
ALERT_CTES = {"al": ALERT_SQL, "su": SUMMARY_SQL, "ex": EXPECTED_SQL}


def alert_trend_rows(r: Roles):
    summary = sensor_op.alert_summary(
        sensor_op.alerts(r.measurement, r.sensor), r.sensor, r.building, r.area
    )
    return risk.alert_trend(sensor_op.expected_alerts(summary, r.sensor, r.building, CALC_DATE))


@query(
    "alert_trend",
    "area:s alerts:l expected:l trend:s",
    "measurement sensor building area",
    ALERT_TREND_SQL,
    **ALERT_CTES,
)
def alert_trend(r: Roles):
    return alert_trend_rows(r)


@query(
    "territory_report",
    "area:s trend:s",
    "measurement sensor building area risk",
    "SELECT area, trend FROM rt UNION SELECT area, trend FROM altr",
    **RISK_TREND_CTES,
    rt=RISK_TREND_SQL,
    **ALERT_CTES,
    altr=ALERT_TREND_SQL,
)
def territory_report(r: Roles):
    return risk.territory_report(
        risk.risk_trend(r.risk, r.area, RISK_DATE, tie=TIE), alert_trend_rows(r)
    )


CLASS_SQL = (
    "CASE WHEN kind IN ('Termometro', 'Pluviometro', 'Igrometro') THEN 'environmental' ELSE 'structural' END"
)


def risk_ctes(day: str) -> dict[str, str]:
    end_old = f"(SELECT CAST(DATE '{day}' - {P.old[1]} AS DATE))"
    mean = ratio("CAST(SUM(10 - health) * 100 AS HUGEINT)", "(100 * COUNT(health))", 6)
    return {
        **health_ctes(day, P.new, P.old),
        "sr": f"SELECT building_id, {CLASS_SQL} AS class, period, CASE WHEN COUNT(health) > 0 THEN CAST(round({mean}, 2)"
        " AS DECIMAL(5,2)) END AS sensor_risk FROM h GROUP BY 1, 2, 3",
        "co": "SELECT area, kind, 'new' AS period, coefficient FROM (" + in_force_sql(day) + ") UNION ALL SELECT area, kind,"
        " 'old', coefficient FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY area, kind ORDER BY measured DESC, risk_id DESC)"
        f" AS rn FROM risk WHERE measured <= {end_old}) WHERE rn = 1",
        "br": "SELECT sr.building_id, sr.class, sr.period, sr.sensor_risk, co.coefficient, CAST((co.coefficient + 1) *"
        " sr.sensor_risk AS DECIMAL(9,2)) AS risk FROM sr JOIN building b ON b.id = sr.building_id LEFT JOIN co ON"
        " co.area = b.area AND co.period = sr.period AND co.kind = CASE sr.class WHEN 'environmental' THEN 'Idrogeologico'"
        " ELSE 'Sismico' END",
    }


def state_sql(source: str, keys: str) -> str:
    def of(c, p):
        return f"MAX(CASE WHEN class = '{c}' AND period = '{p}' THEN risk END)"

    def expected(c):
        return (
            f"CAST(round({c}_new * CASE WHEN {c}_new > {c}_old THEN CAST(1.15 AS DECIMAL(3,2)) ELSE CAST(0.85 AS DECIMAL(3,2))"
            " END, 2) AS DECIMAL(9,2))"
        )

    cols = ", ".join(f"{of(c, p)} AS {c[:3]}_{p}" for c in ("environmental", "structural") for p in ("new", "old"))
    return (
        f"SELECT {keys}, round(CASE WHEN left_over < 0 THEN 0 ELSE left_over END, 0) AS state FROM (SELECT {keys}, 100 -"
        f" ({expected('env')} + {expected('str')}) AS left_over FROM (SELECT {keys}, {cols} FROM {source} GROUP BY {keys}))"
    )


@query(
    "building_risk",
    "building_id:l class:s period:s sensor_risk:d coefficient:l risk:d",
    "measurement sensor building risk",
    "SELECT * FROM br",
    **risk_ctes(CALC_DATE),
)
def building_risk(r: Roles):
    return risk.building_risk(r.measurement, r.sensor, r.building, r.risk, CALC_DATE, tie=TIE)


@query(
    "building_state",
    "building_id:l state:l",
    "measurement sensor building risk",
    state_sql("br", "building_id"),
    **risk_ctes(CALC_DATE),
)
def building_state(r: Roles):
    rows = risk.building_risk(r.measurement, r.sensor, r.building, r.risk, CALC_DATE, tie=TIE)
    return risk.building_state(rows)


def _rad(c: str) -> str:
    return f"CAST(CAST({c} AS DOUBLE) * pi() / 180 AS DECIMAL(9,6))"


DISTANCE_SQL = (
    "SELECT *, CAST(round(12742.0 * asin(sqrt(sin(CAST(r3 - r1 AS DOUBLE) / 2) * sin(CAST(r3 - r1 AS DOUBLE) / 2) +"
    " cos(CAST(r1 AS DOUBLE)) * cos(CAST(r3 AS DOUBLE)) * sin(CAST(r4 - r2 AS DOUBLE) / 2) * sin(CAST(r4 - r2 AS DOUBLE) / 2))), 0) AS BIGINT) AS distance_km"
    f" FROM (SELECT da.disaster_ts, b.id AS building_id, {_rad('b.lat')} AS r1, {_rad('b.lon')} AS r2, {_rad('d.lat')} AS r3,"
    f" {_rad('d.lon')} AS r4 FROM disaster_area da JOIN disaster d ON d.ts = da.disaster_ts JOIN building b ON b.area = da.area)"
)


def hits(r: Roles):
    return disaster.hit_buildings(r.disaster, r.disaster_area, r.building)


@query(
    "hit_buildings",
    "disaster_ts:t building_id:l distance_km:l",
    "disaster disaster_area building",
    DISTANCE_SQL,
)
def hit_buildings(r: Roles):
    return hits(r)


@query(
    "haversine_distance",
    "building_id:l distance_km:l",
    "building",
    "SELECT building_id, distance_km FROM (" + DISTANCE_SQL + ")",
    disaster="SELECT TIMESTAMP '2024-01-31' AS ts, 43.720942 AS lat, 10.388135 AS lon",
    disaster_area="SELECT DISTINCT area, TIMESTAMP '2024-01-31' AS disaster_ts FROM building",
)
def haversine_distance(r: Roles):
    return r.building.select(
        F.col("id").alias("building_id"),
        distance_km("lat", "lon", F.lit("43.720942"), F.lit("10.388135")).alias("distance_km"),
    )


MOTION_SQL = (
    "SELECT disaster_ts, building_id, CAST(AVG(CASE WHEN kind = 'Accelerometro' THEN pgm END) AS DECIMAL(9,6)) AS pga,"
    " CAST(AVG(CASE WHEN kind = 'Giroscopio' THEN pgm END) AS DECIMAL(9,6)) AS pgr FROM (SELECT disaster_ts, building_id,"
    " sensor_id, kind, AVG(CASE WHEN kind = 'Accelerometro' THEN abs(m - 1) ELSE m END) * (1.0 - CAST(0.1 AS DOUBLE) * floor) AS pgm FROM ("
    "SELECT hi.disaster_ts, hi.building_id, s.id AS sensor_id, s.kind, s.floor, t.m, ROW_NUMBER() OVER (PARTITION BY"
    " hi.disaster_ts, s.id ORDER BY t.m DESC) AS rn, COUNT(*) OVER (PARTITION BY hi.disaster_ts, s.id) AS n FROM hi JOIN"
    f" tremor_sensor s ON s.building_id = hi.building_id JOIN (SELECT *, {MAGNITUDE} AS m FROM tremor) t ON t.sensor_id = s.id"
    " AND t.ts BETWEEN hi.disaster_ts - INTERVAL 1 MINUTE AND hi.disaster_ts + INTERVAL 1 MINUTE WHERE s.kind IN"
    " ('Accelerometro', 'Giroscopio') AND s.floor IN (0, 1, 2)) WHERE rn * 100 <= n GROUP BY 1, 2, 3, 4, floor) GROUP BY 1, 2"
)
MERCALLI_SQL = (
    "CAST(CASE WHEN {v} <= 0 THEN 0.0 WHEN {v} <= 0.234686 THEN 9.0 * pow(CAST({v} AS DOUBLE), CAST(0.17 AS DOUBLE)) ELSE 9.4"
    " * pow(CAST({v} AS DOUBLE), CAST(0.2 AS DOUBLE)) END AS DECIMAL(4,2))"
)
STATS_SQL = (
    "SELECT hi.disaster_ts, hi.building_id, hi.distance_km, "
    + MERCALLI_SQL.format(v="pgv")
    + " AS mercalli FROM hi LEFT JOIN (SELECT *, CAST(round((pga + pgr) * CAST(0.5 AS DECIMAL(2,1)), 6) AS DECIMAL(9,6)) AS"
    " pgv FROM mo) mo ON mo.disaster_ts = hi.disaster_ts AND mo.building_id = hi.building_id"
)
EPI_SQL = (
    "SELECT disaster_ts, CAST(CAST(AVG(CAST(mercalli AS DOUBLE) * pow(CAST(distance_km AS DOUBLE) / 600 + 1, 2)) AS"
    " DECIMAL(18,6)) AS DECIMAL(9,2)) AS intensity FROM st GROUP BY 1"
)
TREMOR_ROLES = "tremor tremor_sensor disaster disaster_area building"


@query(
    "peak_ground_motion",
    "disaster_ts:t building_id:l pga:d pgr:d",
    TREMOR_ROLES,
    MOTION_SQL,
    hi=DISTANCE_SQL,
)
def peak_ground_motion(r: Roles):
    return disaster.peak_motion(r.tremor, r.tremor_sensor, hits(r))


@query(
    "mercalli_degrees",
    "event_id:l degrees:d",
    "measurement",
    "SELECT event_id, " + MERCALLI_SQL.format(v="v") + " AS degrees FROM (SELECT event_id, CAST(CAST(x AS DOUBLE) / 1000 AS DECIMAL(9,6)) AS v FROM measurement)",
)
def mercalli_degrees(r: Roles):
    v = (F.col("x").cast("double") / 1000).cast("decimal(9,6)")
    return r.measurement.select("event_id", mercalli(v).alias("degrees"))


def statistics(r: Roles):
    return disaster.hit_statistics(r.tremor, r.tremor_sensor, hits(r))


@query(
    "felt_intensity",
    "disaster_ts:t building_id:l distance_km:l mercalli:d",
    TREMOR_ROLES,
    STATS_SQL,
    hi=DISTANCE_SQL,
    mo=MOTION_SQL,
)
def felt_intensity(r: Roles):
    return statistics(r)


@query(
    "epicentre_intensity",
    "disaster_ts:t intensity:d",
    TREMOR_ROLES,
    EPI_SQL,
    hi=DISTANCE_SQL,
    mo=MOTION_SQL,
    st=STATS_SQL,
)
def epicentre_intensity(r: Roles):
    return disaster.epicentre_intensity(statistics(r))


@query(
    "intensity_at_radius",
    "disaster_ts:t building_id:l felt:d",
    TREMOR_ROLES,
    "SELECT hi.disaster_ts, hi.building_id, CAST(CAST(intensity AS DOUBLE) / ((CAST(distance_km AS DOUBLE) / 600 + 1) *"
    " (CAST(distance_km AS DOUBLE) / 600 + 1)) AS DECIMAL(9,2)) AS felt FROM hi JOIN ep ON ep.disaster_ts = hi.disaster_ts",
    hi=DISTANCE_SQL,
    mo=MOTION_SQL,
    st=STATS_SQL,
    ep=EPI_SQL,
)
def intensity_at_radius(r: Roles):
    centre = disaster.epicentre_intensity(statistics(r))
    return disaster.felt_intensity(hits(r).join(centre, "disaster_ts"), "distance_km")


@query(
    "new_events_only",
    "disaster_ts:t building_id:l distance_km:l",
    "disaster disaster_area building",
    "SELECT * FROM hi WHERE disaster_ts NOT IN (SELECT MAX(ts) FROM disaster)",
    hi=DISTANCE_SQL,
)
def new_events_only(r: Roles):
    known = r.disaster.agg(F.max("ts").alias("disaster_ts"))
    return disaster.new_hits(hits(r), known)


@query(
    "estimated_events",
    "disaster_ts:t building_id:l distance_km:l mercalli:d",
    TREMOR_ROLES,
    STATS_SQL,
    hi=DISTANCE_SQL,
    mo=MOTION_SQL,
)
def estimated_events(r: Roles):
    """Statistics are stored for one disaster, then for the others, and a third run adds nothing."""
    root = f"{shared_folder(r.spark)}/estimates-{uuid.uuid4().hex}"
    first = r.disaster.agg(F.max("ts").alias("disaster_ts"))
    known = r.disaster.select(F.col("ts").alias("disaster_ts")).join(first, "disaster_ts", "left_anti")
    for _ in range(3):
        store.append_hit_statistics(disaster.estimate_new(r.tremor, r.tremor_sensor, hits(r), known), root)
        known = store.read_hit_statistics(r.spark, root)
    return known


DAMAGE_DAY = "2024-01-30"


@query(
    "damage_estimate",
    "disaster_ts:t building_id:l mercalli:d state:l share:d damage:l reason:s",
    TREMOR_ROLES + " measurement sensor risk project",
    "SELECT *, CAST(round(CAST(round(value, 0) AS DECIMAL(18,0)) * share, 0) AS BIGINT) AS damage, CASE WHEN mercalli IS NULL"
    " THEN 'building not hit' END AS reason FROM (SELECT st.*, ss.state, v.value, CAST(CASE WHEN mercalli <= 4 THEN 0.0 WHEN"
    " mercalli >= 10 THEN 1.0 WHEN mercalli IS NOT NULL THEN CAST(0.02 AS DOUBLE) * pow(CAST(mercalli - 3 AS DOUBLE), 2) *"
    " (200 - CAST(state AS DOUBLE)) / 100 END AS DECIMAL(4,2)) AS share FROM st LEFT JOIN ss ON ss.building_id = st.building_id LEFT JOIN"
    " (SELECT building_id, SUM(coalesce(cost, 0)) AS value FROM project GROUP BY 1) v ON v.building_id = st.building_id)",
    hi=DISTANCE_SQL,
    mo=MOTION_SQL,
    st=STATS_SQL,
    **risk_ctes(DAMAGE_DAY),
    ss=state_sql("br", "building_id"),
)
def damage_estimate(r: Roles):
    # the statistics are stored once estimated; damage is a later job on them
    stats = cut_lineage(statistics(r))
    asked = stats.select("building_id", F.date_sub(F.to_date("disaster_ts"), 1).alias("as_of"))
    risks = risk.building_risk_on_dates(r.measurement, r.sensor, r.building, r.risk, asked, tie=TIE)
    states = risk.building_state(risks, ("building_id", "as_of"))
    return disaster.damage(stats, states, disaster.building_value(r.project))


@query(
    "building_value",
    "building_id:l value:d",
    "project",
    "SELECT building_id, SUM(coalesce(cost, 0)) AS value FROM project GROUP BY 1",
)
def building_value(r: Roles):
    return disaster.building_value(r.project)
