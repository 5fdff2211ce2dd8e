"""Registered queries of data quality, business rules, upkeep and streaming."""

import uuid

from pyspark.sql import functions as F

from stonewatch.config import DOOR, WINDOW
from stonewatch.functions.grouped import shared_folder
from stonewatch.operators import maintenance, quality, rules
from stonewatch.operators import sensors as sensor_op
from stonewatch.plans.registry import Roles, query
from stonewatch.plans.roles import projected, table
from stonewatch.plans.sensor_queries import ALERT_SQL
from stonewatch.sources import tables as store
from stonewatch.streaming import alerts as streaming

VIOLATION = "rule:s table:s key:s reason:s"


def _broken(source: str, name: str, key: str, group: str, named: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{group}' AS rule, '{name}' AS \"table\", CAST({key} AS VARCHAR) AS key, '{text}' AS reason FROM {source}"
        f" WHERE NOT ({cond})"
        for text, cond in named.items()
    )


@query(
    "dq_nulls",
    VIOLATION,
    "person",
    _broken("person", "person", "id", "missing", {f"{c} missing": f"{c} IS NOT NULL" for c in ("id", "active", "seniority")}),
)
def dq_nulls(r: Roles):
    return quality.row_rules(
        r.person, "person", ["id"], {"missing": quality.null_rules(["id", "active", "seniority"])}
    )


@query(
    "dq_duplicate_keys",
    VIOLATION,
    body="SELECT 'key' AS rule, 'lineitem' AS \"table\", l_orderkey || '|' || l_linenumber AS key, COUNT(*) ||"
    " ' rows with this key' AS reason FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1",
)
def dq_duplicate_keys(r: Roles):
    return quality.duplicate_keys(table(r.spark, r.sf_dir, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])


@query(
    "dq_orphans",
    VIOLATION,
    "measurement sensor project building risk area stage",
    "SELECT 'reference' AS rule, 'event' AS \"table\", CAST(event_id AS VARCHAR) AS key, 'no such supplier' AS reason FROM"
    " events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'reference', 'risk', CAST(risk_id AS"
    " VARCHAR), 'no such area' FROM risk WHERE area NOT IN (SELECT postcode FROM area)",
)
def dq_orphans(r: Roles):
    events, suppliers = table(r.spark, r.sf_dir, "events"), table(r.spark, r.sf_dir, "supplier")
    return quality.orphans(
        events, "event", ["event_id"], ["user_id"], suppliers, "supplier", ["s_suppkey"]
    ).unionByName(quality.orphans(r.risk, "risk", ["risk_id"], ["area"], r.area, "area", ["postcode"]))


RANGES = {
    "coefficient in range": "coefficient BETWEEN 0 AND 4",
    "coefficient not even": "coefficient % 2 = 1",
}


@query("dq_ranges", VIOLATION, "risk", _broken("risk", "risk", "risk_id", "value", RANGES))
def dq_ranges(r: Roles):
    return quality.row_rules(r.risk, "risk", ["risk_id"], {"value": RANGES})


KINDS = {"kind known": f"kind IN ('{WINDOW}', '{DOOR}')"}


@query("dq_enums", VIOLATION, "opening", _broken("opening", "opening", "id", "value", KINDS))
def dq_enums(r: Roles):
    return quality.row_rules(r.opening, "opening", ["id"], {"value": KINDS})


PRICES = {
    "discount covers tax": "l_discount >= l_tax",
    "price covers quantity": "l_extendedprice >= l_quantity * 100",
}


@query(
    "dq_cross_column",
    VIOLATION,
    body=_broken(
        "lineitem", "lineitem", "l_orderkey || '|' || l_linenumber || '|' || l_partkey", "value", PRICES
    ),
)
def dq_cross_column(r: Roles):
    return quality.row_rules(
        table(r.spark, r.sf_dir, "lineitem"),
        "lineitem",
        ["l_orderkey", "l_linenumber", "l_partkey"],
        {"value": PRICES},
    )


LENGTHS = {"p_name too long": "length(p_name) <= 9", "p_type too long": "length(p_type) <= 5"}


@query("dq_lengths", VIOLATION, body=_broken("part", "part", "p_partkey", "length", LENGTHS))
def dq_lengths(r: Roles):
    return quality.row_rules(
        table(r.spark, r.sf_dir, "part"),
        "part",
        ["p_partkey"],
        {"length": quality.length_rules({"p_name": 9, "p_type": 5})},
    )


@query(
    "dq_candidate_rows",
    "risk_id:l reason:s",
    "risk area",
    "SELECT c.risk_id, CASE WHEN coefficient > 5 THEN 'coefficient in range' WHEN a.postcode IS NULL THEN 'no such area' WHEN"
    " EXISTS (SELECT 1 FROM risk e WHERE e.risk_id % 2 = 0 AND e.area = c.area AND e.kind = c.kind AND e.measured = c.measured)"
    " OR EXISTS (SELECT 1 FROM risk e WHERE e.risk_id % 2 = 1 AND e.risk_id < c.risk_id AND e.area = c.area AND e.kind ="
    " c.kind AND e.measured = c.measured) THEN 'key exists' END AS reason FROM risk c LEFT JOIN area a ON a.postcode = c.area"
    " WHERE c.risk_id % 2 = 1",
)
def dq_candidate_rows(r: Roles):
    old, new = r.risk.filter("risk_id % 2 = 0"), r.risk.filter("risk_id % 2 = 1")
    return quality.check_rows("risk", old, new.withColumn("seq", F.col("risk_id")), {"area": r.area})


# walls come in plot by plot, the inner wall of a plot first
WALL_SEQ = "id - id % 10 + id % 10 % 6 AS seq"


@query(
    "rule_walls",
    "id:l reason:s",
    "crowded_wall",
    "SELECT id, reason FROM walk WHERE rn > 0",
    ends="SELECT *, x1 || ',' || y1 AS p1, x2 || ',' || y2 AS p2, least(x1 || ',' || y1, x2 || ',' || y2) || ';' ||"
    " greatest(x1 || ',' || y1, x2 || ',' || y2) AS sg FROM crowded_wall",
    sq="SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id, floor ORDER BY id - id % 10 + id % 10 % 6) AS rn FROM ends"
    " WHERE id % 7 <> 3",
    held="SELECT building_id, floor, list(p1) || list(p2) AS pts, list(sg) AS sgs FROM ends WHERE id % 7 = 3 GROUP BY 1, 2",
    walk="SELECT f.building_id, f.floor, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS reason,"
    " coalesce(h.pts, []) AS pts, coalesce(h.sgs, []) AS sgs FROM (SELECT DISTINCT building_id, floor FROM ends) f LEFT JOIN"
    " held h ON h.building_id = f.building_id AND h.floor = f.floor"
    " UNION ALL SELECT q.building_id, q.floor, q.rn, q.id, CASE WHEN len(w.pts) = 0 THEN NULL WHEN NOT"
    " (list_contains(w.pts, q.p1) OR list_contains(w.pts, q.p2)) THEN 'no end in common with a wall of the floor' WHEN"
    " list_contains(w.sgs, q.sg) THEN 'repeats a wall of the floor' END, CASE WHEN len(w.pts) = 0 OR list_contains(w.pts, q.p1)"
    " OR list_contains(w.pts, q.p2) THEN list_distinct(w.pts || [q.p1, q.p2]) ELSE w.pts END, CASE WHEN len(w.pts) = 0 OR"
    " list_contains(w.pts, q.p1) OR list_contains(w.pts, q.p2) THEN list_distinct(w.sgs || [q.sg]) ELSE w.sgs END FROM walk w"
    " JOIN sq q ON q.building_id = w.building_id AND q.floor = w.floor AND q.rn = w.rn + 1",
)
def rule_walls(r: Roles):
    walls = r.crowded_wall
    return rules.check_walls(walls.filter("id % 7 = 3"), walls.filter("id % 7 <> 3").selectExpr("*", WALL_SEQ))


FACE_COPIES = (
    "SELECT room_id, wall_id, room_id * 10 + wall_id % 10 AS seq FROM {f} UNION ALL SELECT room_id + 10, wall_id,"
    " 1000000000000000 + room_id * 10 + wall_id % 10 FROM {f} UNION ALL SELECT room_id, wall_id, 2000000000000000 + room_id *"
    " 10 + wall_id % 10 FROM {f}"
)


@query(
    "rule_faces",
    "seq:l room_id:l wall_id:l reason:s",
    "wall room wall_face",
    "SELECT seq, room_id, wall_id, CASE WHEN alone IS NOT NULL THEN alone WHEN ROW_NUMBER() OVER (PARTITION BY wall_id, alone"
    " IS NULL ORDER BY seq) + held > 2 THEN 'wall already has two faces' END AS reason FROM (SELECT f.*, CASE WHEN w.building_id <>"
    " r.building_id THEN 'wall and room in different buildings' WHEN w.floor <> r.floor THEN 'wall and room on different floors'"
    " END AS alone, (SELECT COUNT(*) FROM wall_face x WHERE x.wall_id = f.wall_id AND x.room_id % 3 = 0) AS held FROM fc f LEFT"
    " JOIN wall w ON w.id = f.wall_id LEFT JOIN room r ON r.id = f.room_id)",
    fc=FACE_COPIES.format(f="wall_face"),
)
def rule_faces(r: Roles):
    faces = r.spark.sql(FACE_COPIES.format(f="{f}"), f=r.wall_face)
    return rules.check_faces(r.wall_face.filter("room_id % 3 = 0"), faces, r.wall, r.room)


@query(
    "rule_openings",
    "id:l reason:s",
    "opening wall",
    "SELECT o.id, CASE WHEN NOT EXISTS (SELECT 1 FROM wall w WHERE w.building_id = o.building_id AND w.floor = o.floor AND"
    " least(o.x1, o.x2) >= least(w.x1, w.x2) AND greatest(o.x1, o.x2) <= greatest(w.x1, w.x2) AND least(o.y1, o.y2) >="
    " least(w.y1, w.y2) AND greatest(o.y1, o.y2) <= greatest(w.y1, w.y2) AND (w.x2 - w.x1) * (o.y1 - w.y1) = (w.y2 - w.y1) *"
    " (o.x1 - w.x1) AND (w.x2 - w.x1) * (o.y2 - w.y1) = (w.y2 - w.y1) * (o.x2 - w.x1)) THEN 'not within a wall' WHEN o.kind ="
    " 'Porta' THEN 'repeats an opening' END AS reason FROM opening o",
)
def rule_openings(r: Roles):
    return rules.check_openings(
        r.opening.filter(F.col("kind") == DOOR), r.opening.withColumn("seq", F.col("id")), r.wall
    )


@query(
    "rule_material_class",
    "seq:l material_id:l class:s reason:s",
    body="WITH c AS (SELECT p_partkey AS seq, p_partkey // 4 AS material_id, CASE WHEN p_size % 2 = 0 THEN 'brick' ELSE 'tile'"
    " END AS class FROM part), o AS (SELECT p_partkey // 4 AS material_id, MIN(CASE WHEN p_size > 47 THEN 'brick' ELSE 'tile'"
    " END) AS t FROM part WHERE p_size > 47 OR p_size < 3 GROUP BY 1), k AS (SELECT c.*, coalesce(o.t, FIRST_VALUE(class) OVER"
    " (PARTITION BY c.material_id ORDER BY seq)) AS t FROM c LEFT JOIN o ON o.material_id = c.material_id) SELECT seq,"
    " material_id, class, CASE WHEN class <> t THEN 'already a ' || t END AS reason FROM k",
)
def rule_material_class(r: Roles):
    parts = table(r.spark, r.sf_dir, "part")
    material = "p_partkey div 4 AS material_id"
    candidates = parts.selectExpr(
        "p_partkey AS seq", material, "CASE WHEN p_size % 2 = 0 THEN 'brick' ELSE 'tile' END AS class"
    )
    bricks = parts.filter("p_size > 47").selectExpr(material)
    tiles = parts.filter("p_size < 3").selectExpr(material)
    return rules.check_material_class(bricks, tiles, candidates)


@query(
    "rule_projects",
    "seq:l building_id:l reason:s",
    "project",
    "SELECT o_orderkey AS seq, o_custkey // 3 AS building_id, CASE WHEN EXISTS (SELECT 1 FROM project p WHERE p.building_id //"
    " 3 = o_custkey // 3 AND p.cost IS NULL) OR coalesce(MIN(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) OVER"
    " (PARTITION BY o_custkey // 3) < o_orderkey, false) THEN 'another project still open for the building' END AS reason FROM"
    " orders",
)
def rule_projects(r: Roles):
    existing = r.project.selectExpr("building_id div 3 AS building_id", "cost")
    candidates = table(r.spark, r.sf_dir, "orders").selectExpr(
        "o_orderkey AS seq",
        "o_custkey div 3 AS building_id",
        "CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS cost",
    )
    return rules.check_projects(existing, candidates)


@query(
    "rule_stages",
    "seq:l project_id:l started:D ended:D reason:s",
    body="WITH RECURSIVE o AS (SELECT o_orderkey AS seq, o_custkey AS project_id, CAST(o_orderdate AS DATE) AS started, CASE"
    " WHEN o_orderkey % 8 <> 0 THEN CAST(o_orderdate AS DATE) + 90 END AS ended FROM orders), c AS (SELECT o.*, ROW_NUMBER() OVER"
    " (PARTITION BY project_id ORDER BY seq) AS rn, CASE WHEN c_acctbal >= 0 THEN DATE '1995-01-01' + CAST(c_custkey % 1000 AS"
    " INTEGER) END AS approved FROM o LEFT JOIN customer ON c_custkey = project_id WHERE seq % 5 <> 1), ex AS (SELECT project_id,"
    " MAX(coalesce(ended, DATE '9999-12-31')) AS held FROM o WHERE seq % 5 = 1 AND started < DATE '1994-01-01' GROUP BY 1), walk"
    " AS (SELECT CAST(NULL AS BIGINT) AS seq, p.project_id, CAST(NULL AS DATE) AS started, CAST(NULL AS DATE) AS ended, CAST(0 AS"
    " BIGINT) AS rn, CAST(NULL AS DATE) AS approved, CAST(NULL AS VARCHAR) AS reason, ex.held FROM (SELECT DISTINCT project_id"
    " FROM c) p LEFT JOIN ex ON ex.project_id = p.project_id UNION ALL SELECT c.*, CASE WHEN w.held >"
    " c.started THEN 'overlaps another stage' WHEN c.approved IS NULL THEN 'project not approved' WHEN c.approved > c.started"
    " THEN 'starts before the approval' END, CASE WHEN w.held > c.started OR c.approved IS NULL OR c.approved > c.started THEN"
    " w.held ELSE greatest(coalesce(w.held, DATE '1000-01-01'), coalesce(c.ended, DATE '9999-12-31')) END FROM walk w JOIN c ON"
    " c.project_id = w.project_id AND c.rn = w.rn + 1) SELECT seq, project_id, started, ended, reason FROM walk WHERE rn > 0",
)
def rule_stages(r: Roles):
    candidates = table(r.spark, r.sf_dir, "orders").selectExpr(
        "o_orderkey AS seq",
        "o_custkey AS project_id",
        "CAST(o_orderdate AS DATE) AS started",
        "CASE WHEN o_orderkey % 8 <> 0 THEN date_add(CAST(o_orderdate AS DATE), 90) END AS ended",
    )
    projects = table(r.spark, r.sf_dir, "customer").selectExpr(
        "c_custkey AS id",
        "CASE WHEN c_acctbal >= 0 THEN date_add(DATE '1995-01-01', CAST(c_custkey % 1000 AS INT)) END AS approved",
    )
    existing = candidates.filter("seq % 5 = 1 AND started < DATE '1994-01-01'")
    return rules.check_stages(existing, candidates.filter("seq % 5 <> 1"), projects)


@query(
    "rule_closings",
    "id:l reason:s",
    "stage",
    "SELECT id, CASE WHEN ended IS NOT NULL AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'R')"
    " THEN 'jobs of the stage not done' END AS reason FROM stage",
)
def rule_closings(r: Roles):
    jobs = table(r.spark, r.sf_dir, "lineitem").selectExpr(
        "l_orderkey AS stage_id", "l_returnflag <> 'R' AS done"
    )
    return rules.check_closings(r.stage.select("id", "ended"), jobs)


# lines numbered within their order line number, to tell repeated ones apart
LINE_SEQ = (
    "l_orderkey * 10000 + l_linenumber * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey,"
    " l_suppkey, l_shipdate, l_quantity) AS seq"
)
TARGETS = [
    "l_orderkey AS job_id",
    LINE_SEQ,
    "CASE l_linenumber % 3 WHEN 0 THEN 'wall' WHEN 1 THEN 'room' ELSE 'face' END AS target",
    "CASE WHEN l_linenumber % 3 <> 1 THEN l_partkey * 10 + 1 END AS wall_id",
    "CASE WHEN l_linenumber % 3 <> 0 THEN l_partkey * 10 + 1 END AS room_id",
]


@query(
    "rule_interventions",
    "seq:l job_id:l target:s reason:s",
    "job stage wall room",
    "SELECT seq, job_id, target, CASE WHEN coalesce(MIN(CASE WHEN alone IS NULL THEN seq END) OVER (PARTITION BY job_id) < seq,"
    " false) THEN 'job already has an intervention' ELSE alone END AS reason FROM (SELECT c.*, CASE WHEN c.job_id % 9 = 0 THEN"
    " 'job already has an intervention' WHEN s.project_id // 50 <>"
    " CASE WHEN target = 'room' THEN r.building_id ELSE w.building_id END // 20 THEN 'not in the building of the project' END"
    " AS alone FROM cd c LEFT JOIN job j ON j.id = c.job_id LEFT JOIN stage s ON s.id = j.stage_id LEFT JOIN wall w ON w.id ="
    " c.wall_id LEFT JOIN room r ON r.id = c.room_id)",
    cd="SELECT " + ", ".join(TARGETS) + " FROM lineitem",
)
def rule_interventions(r: Roles):
    candidates = table(r.spark, r.sf_dir, "lineitem").selectExpr(*TARGETS)
    projects = r.project.selectExpr("id", "id div 50 AS building_id")
    blocks = "building_id div 20 AS building_id"
    return rules.check_interventions(
        candidates.filter("job_id % 9 = 0"),
        candidates,
        r.job,
        r.stage,
        projects,
        r.wall.selectExpr("id", blocks),
        r.room.selectExpr("id", blocks),
    )


@query(
    "rule_managers",
    "project_id:l person_id:s fee:d reason:s",
    "management person",
    "SELECT m.*, CASE WHEN NOT p.active THEN 'manager not active' END AS reason FROM management m LEFT JOIN person p ON p.id ="
    " m.person_id",
)
def rule_managers(r: Roles):
    return rules.check_managers(r.management, r.person)


HOURS = ["l_partkey AS job_id", "l_orderkey AS shift_id", "CAST(l_quantity / 10 AS DECIMAL(3,1)) AS hours", LINE_SEQ]


@query(
    "rule_contributions",
    "seq:l job_id:l shift_id:l hours:d reason:s",
    body="WITH RECURSIVE cd AS (SELECT "
    + ", ".join(HOURS)
    + " FROM lineitem), k AS (SELECT cd.*, CASE WHEN p_size > 45 THEN 'job already done' WHEN p_partkey % 2 <> o_orderkey % 2"
    " THEN 'job and shift in different stages' END AS alone, CAST(round((o_custkey % 480) / 60, 1) AS DECIMAL(4,1)) -"
    " coalesce((SELECT SUM(x.hours) FROM cd x WHERE x.shift_id = cd.shift_id AND x.seq % 7 = 0), 0) AS room FROM cd LEFT JOIN"
    " part ON p_partkey = job_id LEFT JOIN orders ON o_orderkey = shift_id AND o_orderkey % 11 <> 0 WHERE cd.seq % 7 <> 0), g"
    " AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY shift_id ORDER BY seq) AS rn FROM k WHERE alone IS NULL AND room IS NOT"
    " NULL), walk AS (SELECT g.*, hours <="
    " room AS taken, room - CASE WHEN hours <= room THEN hours ELSE 0 END AS rest FROM g WHERE rn = 1 UNION ALL SELECT g.*,"
    " g.hours <= w.rest, w.rest - CASE WHEN g.hours <= w.rest THEN g.hours ELSE 0 END FROM walk w JOIN g ON g.shift_id ="
    " w.shift_id AND g.rn = w.rn + 1) SELECT seq, job_id, shift_id, hours, CASE WHEN NOT taken THEN 'more hours than the shift"
    " has' END AS reason FROM walk UNION ALL SELECT seq, job_id, shift_id, hours, alone FROM k WHERE alone IS NOT NULL"
    " OR room IS NULL",
)
def rule_contributions(r: Roles):
    candidates = table(r.spark, r.sf_dir, "lineitem").selectExpr(*HOURS)
    jobs = table(r.spark, r.sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_partkey % 2 AS stage_id", "p_size > 45 AS done"
    )
    shifts = table(r.spark, r.sf_dir, "orders").selectExpr(
        "o_orderkey AS id",
        "o_orderkey % 2 AS stage_id",
        "o_orderdate AS start",
        "timestampadd(MINUTE, CAST(o_custkey % 480 AS INT), o_orderdate) AS end",
    ).filter("id % 11 <> 0")
    old, new = candidates.filter("seq % 7 = 0"), candidates.filter("seq % 7 <> 0")
    return rules.check_contributions(old, new, jobs, shifts)


@query(
    "rule_thresholds",
    "id:l threshold:d reason:s",
    "sensor measurement",
    "SELECT s.id, s.threshold + s.id % 2 AS threshold, CASE WHEN s.id % 2 = 1 AND EXISTS (SELECT 1 FROM measurement m WHERE"
    " m.sensor_id = s.id) THEN 'sensor has readings' END AS reason FROM sensor s",
)
def rule_thresholds(r: Roles):
    changed = r.sensor.withColumn("threshold", F.col("threshold") + F.col("id") % 2)
    return rules.check_threshold_changes(r.sensor, changed, r.measurement)


@query(
    "rule_sensor_unique",
    "id:l reason:s",
    "sensor",
    "SELECT a.id, CASE WHEN EXISTS (SELECT 1 FROM sensor b WHERE b.building_id // 10 = a.building_id // 10 AND b.floor = a.floor"
    " AND b.x = a.x AND b.y = a.y AND b.z = a.z AND b.kind = a.kind AND (b.id % 5 = 0 OR b.id < a.id)) THEN"
    " 'a sensor of this kind is at this point' END AS reason FROM sensor a WHERE a.id % 5 <> 0",
)
def rule_sensor_unique(r: Roles):
    all_sensors = r.sensor.withColumn("building_id", F.expr("building_id div 10"))
    return rules.check_sensors(
        all_sensors.filter("id % 5 = 0"), all_sensors.filter("id % 5 <> 0").withColumn("seq", F.col("id"))
    )


KEPT_FROM = "2024-02-10"


@query(
    "retention",
    "event_id:l sensor_id:l ts:t",
    "measurement",
    f"SELECT * FROM measurement WHERE ts >= TIMESTAMP '{KEPT_FROM}' - INTERVAL 1 MONTH",
)
def retention(r: Roles):
    return maintenance.keep_recent(r.measurement, KEPT_FROM)


@query(
    "retention_alerts",
    "sensor_id:l ts:t",
    "measurement sensor",
    f"SELECT * FROM al WHERE ts >= TIMESTAMP '{KEPT_FROM}' - INTERVAL 1 MONTH",
    al=ALERT_SQL,
)
def retention_alerts(r: Roles):
    _, kept = maintenance.retention(r.measurement, sensor_op.alerts(r.measurement, r.sensor), KEPT_FROM)
    return kept


@query(
    "seniority_increment",
    "id:s active:b seniority:l",
    "person",
    "SELECT id, active, CASE WHEN active THEN seniority + 1 ELSE seniority END AS seniority FROM person",
)
def seniority_increment(r: Roles):
    return maintenance.add_year_of_seniority(r.person)


@query(
    "update_stock",
    "id:l available:l",
    "priced_lot lot_use",
    "SELECT p.id, coalesce(100000 - u.q, 100000) AS available FROM priced_lot p LEFT JOIN (SELECT lot_id, SUM(quantity) AS q FROM"
    " lot_use GROUP BY 1) u ON u.lot_id = p.id",
)
def update_stock(r: Roles):
    lots = r.priced_lot.withColumn("available", F.lit(100000).cast("bigint"))
    drawn = r.lot_use.groupBy(F.col("lot_id").alias("id")).agg(
        (F.lit(100000) - F.sum("quantity")).alias("available")
    )
    return maintenance.update_columns(lots, drawn, ["id"], ["available"])


def filled(df, name: str):
    """A role's columns as those of a stored table; the others are unknown."""
    fields = store.TABLES[name].schema
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).alias(f.name) for f in fields))


def _folder(r: Roles, name: str) -> str:
    return f"{shared_folder(r.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "append_measurements",
    "sensor_id:l ts:t x:d y:d z:d",
    "measurement",
    "SELECT sensor_id, ts, v.x AS x, v.y AS y, v.z AS z FROM (SELECT sensor_id, ts, coalesce(MIN({'x': x, 'y': y, 'z': z})"
    " FILTER (WHERE event_id % 2 = 0), MIN({'x': x, 'y': y, 'z': z})) AS v FROM measurement GROUP BY 1, 2)",
)
def append_measurements(r: Roles):
    root = _folder(r, "measurements")
    first = r.measurement.filter("event_id % 2 = 0").groupBy("sensor_id", "ts")
    first = first.agg(F.min(F.struct("x", "y", "z")).alias("v")).select("sensor_id", "ts", "v.*")
    store.write_table(first, root, "measurement")
    store.append_measurements(r.spark, root, r.measurement)
    return store.read_table(r.spark, root, "measurement")


@query(
    "audit_tables",
    "rule:s table:s key:s reason:s",
    "risk area building",
    "SELECT 'key' AS rule, 'risk' AS \"table\", key, COUNT(*) || ' rows with this key' AS reason FROM au GROUP BY key HAVING"
    " COUNT(*) > 1 UNION ALL SELECT 'reference', 'risk', key, 'no such area' FROM au WHERE area = 'A3' UNION ALL SELECT 'value',"
    " 'risk', key, 'coefficient in range' FROM au WHERE coefficient > 5 UNION ALL SELECT 'type', 'risk', key, 'coefficient out of"
    " range' FROM au WHERE coefficient > 32767 UNION ALL SELECT 'reference', 'building', CAST(id AS VARCHAR), 'no such area' FROM"
    " building WHERE area = 'A3' UNION ALL SELECT 'value', 'building', CAST(id AS VARCHAR), 'latitude in range' FROM building"
    " WHERE abs(lat * 120) > 90 UNION ALL SELECT 'value', 'building', CAST(id AS VARCHAR), 'longitude in range' FROM building WHERE"
    " abs(lon * 120) > 180",
    au="SELECT area, coefficient + CASE WHEN risk_id % 97 = 0 THEN 40000 WHEN risk_id % 97 = 1 THEN 10 ELSE 0 END AS coefficient,"
    " area || '|' || kind || '|' || CAST(measured AS VARCHAR) AS key FROM risk",
)
def audit_tables(r: Roles):
    """Areas, buildings and risks, with an area missing, numbers out of range and repeated keys."""
    wrong = F.expr("CASE WHEN risk_id % 97 = 0 THEN 40000 WHEN risk_id % 97 = 1 THEN 10 ELSE 0 END")
    risks = r.risk.withColumn("coefficient", F.col("coefficient") + wrong)
    far = [(F.col(c) * 120).cast("decimal(12,6)").alias(c) for c in ("lat", "lon")]
    homes = r.building.select("id", "area", "kind", *far)
    return quality.audit({"area": r.area.filter("postcode <> 'A3'"), "building": homes, "risk": risks})


@query(
    "gated_reload",
    "part:s name:s n:l",
    "risk area",
    "SELECT 'stored' AS part, 'area' AS name, COUNT(*) AS n FROM area UNION ALL SELECT 'stored', 'risk', COUNT(*) FROM (SELECT"
    " DISTINCT area, kind, measured FROM risk) UNION ALL SELECT 'refused', 'key', COUNT(*) FROM (SELECT 1 FROM risk GROUP BY"
    " area, kind, measured HAVING COUNT(*) > 1) UNION ALL SELECT 'refused', 'reference', COUNT(*) FROM risk WHERE area = 'A3'",
)
def gated_reload(r: Roles):
    """A clean set of tables is stored; one with repeated keys and a missing area is then refused."""
    root = _folder(r, "reload")
    key = ["area", "kind", "measured"]
    once = r.risk.groupBy(*key).agg(F.min_by("coefficient", "risk_id").alias("coefficient"))
    store.reload_gated({"area": r.area, "risk": once}, root)
    found = store.reload_gated({"area": r.area.filter("postcode <> 'A3'"), "risk": r.risk.select(*once.columns)}, root)
    parts = found.groupBy(F.lit("refused").alias("part"), F.col("rule").alias("name")).agg(F.count("key").alias("n"))
    for name in ("area", "risk"):
        kept = store.read_table(r.spark, root, name).agg(F.count(F.lit(1)).alias("n"))
        parts = parts.unionByName(kept.select(F.lit("stored").alias("part"), F.lit(name).alias("name"), "n"))
    return parts


@query(
    "loaded_text",
    "sensor_id:l readings:l total_x:d refused:l",
    "measurement",
    "SELECT sensor_id, COUNT(*) FILTER (WHERE event_id % 50 > 2) AS readings, SUM(x) FILTER (WHERE event_id % 50 > 2) AS"
    " total_x, COUNT(*) FILTER (WHERE event_id % 50 <= 2) AS refused FROM measurement GROUP BY 1",
)
def loaded_text(r: Roles):
    """Readings are written as text, some of them spoilt, and loaded; the spoilt ones are kept aside."""
    path = _folder(r, "text")
    spoilt = (
        r.measurement.select("event_id", *(F.col(c).cast("string").alias(c) for c in ("sensor_id", "ts", "x", "y", "z")))
        .withColumn("x", F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("about "), "x")).otherwise(F.col("x")))
        .withColumn("ts", F.when(F.col("event_id") % 50 == 1, F.lit(None)).otherwise(F.col("ts")))
        .withColumn("z", F.when(F.col("event_id") % 50 == 2, F.lit("99999.5")).otherwise(F.col("z")))
    )
    spoilt.drop("event_id").write.csv(path, header=True)
    good, bad = store.read_csv_quarantined(r.spark, path, "measurement", timestampNTZFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    refused = bad.groupBy(F.split("line", ",")[0].cast("bigint").alias("sensor_id")).agg(F.count("reason").alias("refused"))
    kept = good.groupBy("sensor_id").agg(F.count("ts").alias("readings"), F.sum("x").alias("total_x"))
    return kept.join(refused, "sensor_id", "full").select(
        "sensor_id", F.coalesce("readings", F.lit(0)).alias("readings"), "total_x", F.coalesce("refused", F.lit(0)).alias("refused")
    )


@query(
    "store_updates",
    "id:s available:l active:b seniority:l",
    "priced_lot lot_use person",
    "SELECT CAST(p.id AS VARCHAR) AS id, coalesce(100000 - u.q, 100000) AS available, CAST(NULL AS BOOLEAN) AS active,"
    " CAST(NULL AS BIGINT) AS seniority FROM priced_lot p LEFT JOIN (SELECT lot_id, SUM(quantity) AS q FROM lot_use GROUP BY"
    " 1) u ON u.lot_id = p.id UNION ALL SELECT id, NULL, active, CASE WHEN active THEN seniority + 2 ELSE seniority END FROM"
    " person",
)
def store_updates(r: Roles):
    """Tables are stored, updated in their own place (staff twice) and read back."""
    root = _folder(r, "updates")
    lots = r.priced_lot.withColumn("available", F.lit(100000).cast("bigint"))
    store.write_table(filled(lots, "lot"), root, "lot")
    store.write_table(filled(r.person, "person"), root, "person")
    drawn = r.lot_use.groupBy(F.col("lot_id").alias("id")).agg((F.lit(100000) - F.sum("quantity")).alias("available"))
    stored = store.read_table(r.spark, root, "lot")
    store.write_table(maintenance.update_columns(stored, drawn, ["id"], ["available"]), root, "lot")
    for _ in range(2):
        staff = store.read_table(r.spark, root, "person")
        store.write_table(maintenance.add_year_of_seniority(staff), root, "person")
    lots = store.read_table(r.spark, root, "lot").select(F.col("id").cast("string"), "available")
    return lots.unionByName(
        store.read_table(r.spark, root, "person").select("id", "active", "seniority"), allowMissingColumns=True
    )


@query(
    "retention_store",
    "kind:s sensor_id:l ts:t",
    "measurement sensor",
    f"SELECT DISTINCT 'reading' AS kind, sensor_id, ts FROM measurement WHERE ts >= TIMESTAMP '{KEPT_FROM}' - INTERVAL 1"
    f" MONTH UNION ALL SELECT DISTINCT 'alert', sensor_id, ts FROM al WHERE ts >= TIMESTAMP '{KEPT_FROM}' - INTERVAL 1 MONTH",
    al=ALERT_SQL,
)
def retention_store(r: Roles):
    """Stored days before the bound are dropped as folders."""
    root = _folder(r, "retention")
    store.write_table(r.measurement.dropDuplicates(["sensor_id", "ts"]), root, "measurement")
    store.write_table(sensor_op.alerts(r.measurement, r.sensor).distinct(), root, "alert")
    day = r.spark.range(1).select(maintenance.first_kept_day(KEPT_FROM)).first()[0]
    left = None
    for kind, name in (("reading", "measurement"), ("alert", "alert")):
        store.drop_days_before(r.spark, root, name, day)
        rows = store.read_table(r.spark, root, name).select(F.lit(kind).alias("kind"), "sensor_id", "ts")
        left = rows if left is None else left.unionByName(rows)
    return left


@query(
    "streamed_alerts",
    "sensor_id:l ts:t",
    "measurement sensor",
    f"SELECT DISTINCT sensor_id, ts FROM ({ALERT_SQL})",
)
def streamed_alerts(r: Roles):
    """The events in eight files, dealt without regard to time, two to a batch, some twice."""
    raw = table(r.spark, r.sf_dir, "events")
    root = _folder(r, "alerts")
    again = raw.filter("event_id % 5 = 0")
    raw.unionByName(again).repartition(8, F.hash("event_id")).write.parquet(f"{root}/in")
    stream = r.spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    found = streaming.stream_alerts(projected("measurement", stream), r.sensor)
    streaming.start_alerts(found, f"{root}/out", f"{root}/state", available_now=True).awaitTermination()
    return streaming.read_alerts(r.spark, f"{root}/out")
