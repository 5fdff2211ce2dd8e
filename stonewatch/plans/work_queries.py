"""Registered queries of stock, cost and shifts."""

from pyspark.sql import functions as F

from stonewatch.operators import cost, shifts, stock
from stonewatch.plans.registry import Roles, query
from stonewatch.plans.roles import TODAY, table
from stonewatch.plans.sqltext import ratio

REPORT_YEAR, REPORT_MONTH = 1998, 3

ALLOCATION_SQL = (
    "SELECT d.job_id, d.seq, s.material_id, s.id AS lot_id, s.purchased, least(s.hi, d.hi) - greatest(s.hi - s.available,"
    " d.hi - d.quantity) AS quantity FROM (SELECT *, SUM(available) OVER (PARTITION BY material_id ORDER BY purchased, id) AS"
    " hi FROM lot WHERE available > 0) s JOIN (SELECT *, SUM(quantity) OVER (PARTITION BY material_id ORDER BY seq) AS hi FROM"
    " request WHERE quantity > 0) d ON d.material_id = s.material_id AND least(s.hi, d.hi) > greatest(s.hi - s.available,"
    " d.hi - d.quantity)"
)


@query(
    "fifo_allocation",
    "job_id:l seq:l material_id:l lot_id:l purchased:D quantity:l",
    "lot request",
    ALLOCATION_SQL,
)
def fifo_allocation(r: Roles):
    return stock.allocate(r.request, r.lot)


@query(
    "remaining_stock",
    "material_id:l id:l purchased:D available:l",
    "lot request",
    "SELECT l.material_id, l.id, l.purchased, l.available - coalesce(a.q, 0) AS available FROM lot l LEFT JOIN (SELECT"
    " material_id, lot_id, purchased, SUM(quantity) AS q FROM al GROUP BY 1, 2, 3) a ON a.material_id = l.material_id AND"
    " a.lot_id = l.id AND a.purchased = l.purchased",
    al=ALLOCATION_SQL,
)
def remaining_stock(r: Roles):
    return stock.remaining_stock(r.lot, stock.allocate(r.request, r.lot))


GUARD_CTES = {
    "gr": "SELECT job_id, CASE WHEN seq % 17 = 0 THEN material_id + 1000000 ELSE material_id END AS material_id, CASE WHEN"
    " seq % 13 = 0 THEN -quantity ELSE quantity END AS quantity, seq FROM greedy_request",
    "us": "SELECT DISTINCT u.job_id, l.material_id FROM greedy_request u JOIN (SELECT material_id, MIN(id) AS id FROM lot GROUP"
    " BY 1) m ON m.material_id = u.material_id JOIN lot l ON l.id = m.id WHERE u.seq % 19 = 0",
    "pl": "SELECT g.*, s.stock, CASE WHEN u.job_id IS NOT NULL THEN 'material already used by the job' WHEN g.quantity < 0 THEN"
    " 'negative quantity' WHEN s.stock IS NULL THEN 'no stock of the material' END AS plain FROM gr g LEFT JOIN (SELECT"
    " material_id, SUM(available) AS stock FROM lot GROUP BY 1) s ON s.material_id = g.material_id LEFT JOIN us u ON u.job_id ="
    " g.job_id AND u.material_id = g.material_id",
    "rq": "SELECT *, ROW_NUMBER() OVER (PARTITION BY material_id ORDER BY seq) AS rn FROM pl WHERE plain IS NULL",
    "walk": "SELECT job_id, material_id, seq, quantity, rn, quantity <= stock AS taken, stock - CASE WHEN quantity <= stock"
    " THEN quantity ELSE 0 END AS room FROM rq WHERE rn = 1 UNION ALL SELECT q.job_id, q.material_id, q.seq, q.quantity, q.rn,"
    " q.quantity <= w.room, w.room - CASE WHEN q.quantity <= w.room THEN q.quantity ELSE 0 END FROM walk w JOIN rq q ON"
    " q.material_id = w.material_id AND q.rn = w.rn + 1",
}


def guarded(r: Roles):
    """Requests of which some are negative, some for a material without lots, some made before."""
    requests = r.greedy_request
    lot = r.lot.groupBy("material_id").agg(F.min("id").alias("lot_id"))
    uses = requests.filter("seq % 19 = 0").join(lot, "material_id").select("job_id", "lot_id")
    odd = requests.withColumn(
        "material_id", F.expr("if(seq % 17 = 0, material_id + 1000000, material_id)")
    ).withColumn("quantity", F.expr("if(seq % 13 = 0, -quantity, quantity)"))
    return odd, r.lot, uses


@query(
    "allocation_guards",
    "job_id:l material_id:l seq:l quantity:l reason:s",
    "lot greedy_request",
    "SELECT job_id, material_id, seq, quantity, CASE WHEN NOT taken THEN 'insufficient stock' END AS reason FROM walk UNION ALL"
    " SELECT job_id, material_id, seq, quantity, plain FROM pl WHERE plain IS NOT NULL",
    **GUARD_CTES,
)
def allocation_guards(r: Roles):
    return stock.check_requests(*guarded(r))


@query(
    "served_requests",
    "material_id:l id:l purchased:D available:l",
    "lot greedy_request",
    "SELECT l.material_id, l.id, l.purchased, l.available - coalesce(a.q, 0) AS available FROM lot l LEFT JOIN (SELECT"
    " material_id, lot_id, purchased, SUM(quantity) AS q FROM al GROUP BY 1, 2, 3) a ON a.material_id = l.material_id AND"
    " a.lot_id = l.id AND a.purchased = l.purchased",
    **GUARD_CTES,
    request="SELECT job_id, material_id, quantity, seq FROM walk WHERE taken",
    al=ALLOCATION_SQL,
)
def served_requests(r: Roles):
    return stock.serve(*guarded(r))[2]


MATERIAL_SQL = (
    "SELECT j.stage_id, SUM(u.quantity * p.unit_price) AS material_cost FROM lot_use u JOIN priced_lot p ON p.id = u.lot_id"
    " JOIN job j ON j.id = u.job_id GROUP BY 1"
)


@query("material_cost", "stage_id:l material_cost:d", "lot_use priced_lot job", MATERIAL_SQL)
def material_cost(r: Roles):
    return cost.material_cost(r.lot_use, r.priced_lot, r.job)


YEARS = f"date_sub('year', CAST({{d}} AS DATE), DATE '{TODAY}')"
PAID_SQL = (
    "SELECT *, CASE WHEN pay0 >= 10 THEN pay0 END AS pay, CASE WHEN pay0 IS NULL THEN 'unknown seniority' WHEN pay0 < 10 THEN"
    " 'date out of range' END AS reason FROM (SELECT s.*, 10 + p.seniority - "
    + YEARS.format(d='s."start"')
    + " AS pay0 FROM shift s JOIN person p ON p.id = s.worker_id)"
)
LABOUR_SQL = (
    "SELECT stage_id, CASE WHEN COUNT(*) = COUNT(pay) THEN "
    + ratio("CAST(SUM(date_sub('minute', \"start\", \"end\") * pay) AS HUGEINT)", "60", 2)
    + " END AS labour_cost, MIN(reason) AS reason FROM pd GROUP BY 1"
)


@query(
    "hourly_pay",
    "stage_id:l worker_id:s start:t end:t pay:d reason:s",
    "shift person",
    "SELECT * FROM pd",
    pd=PAID_SQL,
)
def hourly_pay(r: Roles):
    return cost.shift_pay(r.shift, r.person, TODAY)


@query("labour_cost", "stage_id:l labour_cost:d reason:s", "shift person", LABOUR_SQL, pd=PAID_SQL)
def labour_cost(r: Roles):
    return cost.labour_cost(r.shift, r.person, TODAY)


def project_costs(r: Roles, strict: bool):
    return cost.project_cost(
        r.project,
        r.management,
        r.stage,
        cost.material_cost(r.lot_use, r.priced_lot, r.job),
        cost.labour_cost(r.shift, r.paid_person, TODAY),
        strict_nulls=strict,
    )


def _project_sql(strict: bool) -> str:
    def part(c):
        return c if strict else f"coalesce({c}, 0)"

    # a stage's labour is unknown if any of its shifts is unpaid, whatever the sums say
    return (
        f"SELECT p.id AS project_id, CASE WHEN w.reason IS NULL THEN {part('f.fees')} + {part('s.st')} END AS cost, w.reason"
        " FROM project p LEFT JOIN (SELECT project_id, SUM(fee) AS fees FROM management GROUP BY 1) f ON f.project_id = p.id"
        f" LEFT JOIN (SELECT project_id, SUM({part('m.material_cost')} + {part('l.labour_cost')}) AS st FROM stage s LEFT JOIN"
        " mc m ON m.stage_id = s.id LEFT JOIN lc l ON l.stage_id = s.id GROUP BY 1) s ON s.project_id = p.id"
        " LEFT JOIN (SELECT st.project_id, MIN(x.reason) AS reason FROM stage st JOIN (SELECT stage_id, CASE WHEN"
        " COUNT(*) FILTER (WHERE reason = 'date out of range') > 0 THEN 'date out of range' ELSE 'unknown seniority' END AS"
        " reason FROM pd WHERE pay IS NULL GROUP BY 1) x ON x.stage_id = st.id GROUP BY 1) w ON w.project_id = p.id"
    )


COST_ROLES = "project management stage lot_use priced_lot job shift paid_person"
COST_CTES = {"mc": MATERIAL_SQL, "pd": PAID_SQL.replace("JOIN person p", "JOIN paid_person p"), "lc": LABOUR_SQL}


@query("project_cost", "project_id:l cost:d reason:s", COST_ROLES, _project_sql(False), **COST_CTES)
def project_cost(r: Roles):
    return project_costs(r, strict=False)


@query("project_cost_strict", "project_id:l cost:d reason:s", COST_ROLES, _project_sql(True), **COST_CTES)
def project_cost_strict(r: Roles):
    return project_costs(r, strict=True)


@query(
    "apply_updates",
    "id:l building_id:l cost:d",
    COST_ROLES,
    "SELECT p.id, p.building_id, CASE WHEN p.id % 3 = 0 OR c.reason IS NOT NULL THEN p.cost ELSE c.cost END AS cost FROM"
    " project p JOIN pc c ON c.project_id = p.id",
    **COST_CTES,
    pc=_project_sql(False),
)
def apply_updates(r: Roles):
    ended = project_costs(r, strict=False).filter("project_id % 3 <> 0")
    return cost.finish_projects(r.project, ended)


@query(
    "material_report",
    "material_id:l name:s quantity:l",
    "lot_use job stage priced_lot material",
    "SELECT p.material_id, m.name, SUM(u.quantity) AS quantity FROM lot_use u JOIN priced_lot p ON p.id = u.lot_id JOIN"
    " material m ON m.id = p.material_id WHERE u.job_id IN (SELECT j.id FROM job j WHERE j.stage_id IN (SELECT id FROM stage"
    f" WHERE ended IS NOT NULL AND year(ended) = {REPORT_YEAR} AND month(ended) = {REPORT_MONTH})) GROUP BY 1, 2",
)
def material_report(r: Roles):
    return cost.material_report(
        r.lot_use, r.job, r.stage, r.priced_lot, r.material, REPORT_YEAR, REPORT_MONTH
    )


CAPACITY = (
    "8 + CAST(round((p.seniority - " + YEARS + ") * CAST(0.5 AS DECIMAL(2,1)), 0) AS BIGINT)"
)


@query(
    "supervision_capacity",
    "person_id:s date:D capacity:l reason:s",
    "site_shift person",
    "SELECT person_id, date, CASE WHEN c >= 8 THEN c END AS capacity, CASE WHEN seniority IS NULL THEN 'unknown seniority'"
    " WHEN c < 8 THEN 'date out of range' END AS reason FROM (SELECT q.*, p.seniority, "
    + CAPACITY.format(d="q.date")
    + " AS c FROM (SELECT DISTINCT worker_id AS person_id, CAST(\"start\" AS DATE) AS date FROM site_shift) q JOIN person p ON"
    " p.id = q.person_id)",
)
def supervision_capacity(r: Roles):
    asked = r.site_shift.select(
        F.col("worker_id").alias("person_id"), F.to_date("start").alias("date")
    ).distinct()
    return shifts.capacity_on(asked, r.person, TODAY)


@query(
    "on_shift_at",
    "stage_id:l at:t workers:l",
    "site_shift",
    "SELECT i.stage_id, i.t AS at, COUNT(s.worker_id) AS workers FROM (SELECT DISTINCT o_orderkey % 10 AS stage_id,"
    " o_orderdate + to_hours(CAST(o_orderkey % 12 AS INTEGER)) AS t FROM orders) i LEFT JOIN site_shift s ON s.stage_id ="
    " i.stage_id AND s.\"start\" <= i.t AND s.\"end\" >= i.t GROUP BY 1, 2",
)
def on_shift_at(r: Roles):
    instants = table(r.spark, r.sf_dir, "orders").selectExpr(
        "o_orderkey % 10 AS stage_id",
        "timestampadd(HOUR, CAST(o_orderkey % 12 AS INT), o_orderdate) AS at",
    )
    return shifts.on_shift_at(r.site_shift, instants)


@query(
    "peak_concurrency",
    "stage_id:l start:t end:t peak:l",
    "site_shift",
    "SELECT sp.stage_id, sp.\"start\", sp.\"end\", MAX(c.n) AS peak FROM (SELECT DISTINCT stage_id, \"start\", \"end\" FROM"
    " site_shift) sp JOIN cnt c ON c.stage_id = sp.stage_id AND c.t BETWEEN sp.\"start\" AND sp.\"end\" GROUP BY 1, 2, 3",
    cnt="SELECT i.stage_id, i.t, COUNT(*) AS n FROM (SELECT DISTINCT stage_id, \"start\" AS t FROM site_shift) i JOIN"
    " site_shift s ON s.stage_id = i.stage_id AND s.\"start\" <= i.t AND s.\"end\" >= i.t GROUP BY 1, 2",
)
def peak_concurrency(r: Roles):
    return shifts.peak_concurrency(r.site_shift, r.site_shift)


@query(
    "shift_overlaps",
    "worker_id:s stage_id:l start:t end:t overlaps:b",
    "shift",
    "SELECT worker_id, stage_id, \"start\", \"end\", coalesce(MAX(\"end\") OVER (PARTITION BY worker_id ORDER BY \"start\","
    " \"end\", stage_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= \"start\", false) AS overlaps FROM shift",
)
def shift_overlaps(r: Roles):
    return shifts.overlaps(r.shift)


@query(
    "supervisor_coverage",
    "stage_id:l worker_id:s supervisor_id:s start:t end:t covered:b",
    "site_shift",
    "SELECT s.*, EXISTS (SELECT 1 FROM site_shift o WHERE o.stage_id = s.stage_id AND o.worker_id = s.supervisor_id AND"
    " o.\"start\" <= s.\"start\" AND o.\"end\" >= s.\"end\") AS covered FROM site_shift s WHERE s.worker_id <> s.supervisor_id",
)
def supervisor_coverage(r: Roles):
    return shifts.coverage(r.site_shift)


@query(
    "supervisor_load",
    "stage_id:l supervisor_id:s start:t end:t workers:l capacity:l overloaded:b",
    "site_shift person",
    "SELECT k.stage_id, k.supervisor_id, k.\"start\", k.\"end\", k.workers, k.capacity, k.workers > k.capacity AS overloaded"
    " FROM (SELECT n.*, CASE WHEN "
    + CAPACITY.format(d='n."start"')
    + " >= 8 THEN "
    + CAPACITY.format(d='n."start"')
    + " END AS capacity FROM (SELECT o.stage_id, o.worker_id AS supervisor_id, o.\"start\", o.\"end\", COUNT(DISTINCT"
    " l.worker_id) AS workers FROM (SELECT DISTINCT stage_id, worker_id, \"start\", \"end\" FROM site_shift) o JOIN site_shift l ON"
    " l.stage_id = o.stage_id AND l.supervisor_id = o.worker_id AND l.\"start\" BETWEEN o.\"start\" AND o.\"end\" GROUP BY 1, 2,"
    " 3, 4) n JOIN person p ON p.id = n.supervisor_id) k",
)
def supervisor_load(r: Roles):
    return shifts.supervisor_load(r.site_shift, r.person, TODAY)


@query("shift_validation", "seq:l stage_id:l worker_id:s supervisor_id:s start:t end:t reason:s")
def shift_validation(r: Roles):
    raw = table(r.spark, r.sf_dir, "lineitem")
    rows = raw.selectExpr(
        "l_linestatus",
        "l_orderkey * 10000 + l_linenumber * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber"
        " ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity) AS seq",
        "l_orderkey % 10 AS stage_id",
        "concat('W', l_suppkey) AS worker_id",
        "concat('W', l_suppkey % 5) AS supervisor_id",
        "timestampadd(HOUR, l_linenumber, l_shipdate) AS start",
        "timestampadd(MINUTE, CAST(l_quantity * 10 AS INT), timestampadd(HOUR, l_linenumber, l_shipdate)) AS end",
    )
    stages = rows.selectExpr("stage_id AS id").distinct().selectExpr(
        "id", "CASE WHEN id = 3 THEN DATE '2001-12-31' END AS ended"
    )
    existing = rows.filter("l_linestatus = 'F'").select(*shifts.SHIFT_COLUMNS)
    candidates = rows.filter("l_linestatus = 'O'").select("seq", *shifts.SHIFT_COLUMNS)
    return shifts.validate_shifts(existing, candidates, r.person, stages, TODAY)


#: Sites of some 40 orders, closed in themselves: 40 workers, the first three of them supervisors
#: who are on eight-hour shifts of their own around the clock.
SITE_ROWS = [
    "l_linenumber",
    "l_orderkey * 10000 + l_linenumber * 1000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber"
    " ORDER BY l_partkey, l_suppkey, l_shipdate, l_quantity) AS seq",
    "l_orderkey {div} 40 AS stage_id",
    "concat('W', l_orderkey {div} 40, '-', l_partkey % 40) AS worker_id",
    "concat('W', l_orderkey {div} 40, '-', CASE WHEN l_suppkey % 10 < 8 THEN 0 ELSE 1 + l_suppkey % 2 END) AS supervisor_id",
    "CAST((l_partkey * 7 + l_suppkey + l_linenumber) % 60 AS INT) AS hour",
    "CAST(l_quantity * 10 AS INT) AS minutes",
]
SITE_START = "1998-01-05 06:00:00"
_SITE_SQL = ", ".join(SITE_ROWS).format(div="//")
_SEEN = "{{'w': {w}, 'u': {u}, 's': {s}, 'e': {e}, 'q': CAST({q} AS BIGINT)}}"
SITE_CTES = {
    "sh": f"SELECT stage_id, worker_id, supervisor_id, seq, l_linenumber, TIMESTAMP '{SITE_START}' + to_hours(hour) AS s,"
    f" TIMESTAMP '{SITE_START}' + to_hours(hour) + to_minutes(minutes) AS e FROM (SELECT {_SITE_SQL} FROM lineitem)",
    "ex": "SELECT stage_id, worker_id, supervisor_id, s, e FROM sh WHERE l_linenumber = 1 UNION ALL SELECT stage_id,"
    " concat('W', stage_id, '-', k), concat('W', stage_id, '-', k),"
    f" TIMESTAMP '{SITE_START}' + to_hours(CAST(8 * i AS INTEGER)), TIMESTAMP '{SITE_START}' + to_hours(CAST(8 * i + 8 AS"
    " INTEGER)) FROM (SELECT DISTINCT stage_id FROM sh), range(8) a(i), range(3) b(k)",
    "cand": "SELECT *, ROW_NUMBER() OVER (PARTITION BY stage_id ORDER BY seq) AS rn, CASE WHEN worker_id LIKE '%-39' THEN"
    " 'worker not active' WHEN stage_id % 9 = 3 THEN 'stage already closed' WHEN e <= s OR e > s + INTERVAL 8 HOURS THEN"
    " 'invalid times' END AS fixed, CASE WHEN supervisor_id LIKE '%-0' THEN 8 END AS capacity FROM sh WHERE l_linenumber > 1",
    "walk": "SELECT stage_id, CAST(0 AS BIGINT) AS rn, list("
    + _SEEN.format(w="worker_id", u="supervisor_id", s="s", e="e", q="-1")
    + ") AS seen, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reason FROM ex GROUP BY 1 UNION ALL SELECT stage_id, rn,"
    " CASE WHEN reason IS NULL THEN list_append(seen, "
    + _SEEN.format(w="worker_id", u="supervisor_id", s="s", e="e", q="seq")
    + ") ELSE seen END, seq, reason FROM (SELECT *, CASE WHEN fixed IS NOT NULL THEN fixed WHEN len(list_filter(near, lambda v:"
    " v.w = worker_id)) > 0 THEN 'worker already on another shift' WHEN crowd > 14 THEN 'too many workers at once' WHEN"
    " worker_id = supervisor_id THEN NULL WHEN own IS NULL THEN 'supervisor not on shift' WHEN capacity IS NULL THEN"
    " 'supervisor''s seniority unknown or out of range' WHEN capacity <= len(list_distinct(list_transform(list_filter(seen,"
    " lambda v: v.u = supervisor_id AND v.s BETWEEN own.s AND own.e), lambda v: v.w))) THEN 'supervisor''s crew is full' END AS"
    " reason FROM (SELECT *, list_max(list_transform(near, lambda t: len(list_filter(near, lambda v: v.s <= greatest(t.s, s)"
    " AND v.e >= greatest(t.s, s))))) AS crowd FROM (SELECT c.*, w.seen, list_filter(w.seen, lambda v: v.e >= c.s AND v.s <="
    " c.e) AS near, list_min(list_transform(list_filter(w.seen, lambda v: v.w = c.supervisor_id AND v.s <= c.s AND v.e >= c.e),"
    " lambda v: {'q': v.q, 's': v.s, 'e': v.e})) AS own FROM walk w JOIN cand c ON c.stage_id = w.stage_id AND c.rn = w.rn +"
    " 1)))",
}


@query(
    "shift_validation_sites",
    "seq:l stage_id:l worker_id:s supervisor_id:s start:t end:t reason:s",
    "person",
    'SELECT c.seq, c.stage_id, c.worker_id, c.supervisor_id, c.s AS "start", c.e AS "end", w.reason FROM cand c JOIN walk w ON'
    " w.seq = c.seq",
    **SITE_CTES,
)
def shift_validation_sites(r: Roles):
    # numbered before texts are made of the keys, so that numbering shuffles the keys only
    numbered = table(r.spark, r.sf_dir, "lineitem").selectExpr("*", SITE_ROWS[1])
    rows = numbered.selectExpr(*("seq" if c.endswith("AS seq") else c.format(div="div") for c in SITE_ROWS))
    first = f"TIMESTAMP_NTZ '{SITE_START}'"
    rows = rows.withColumn("start", F.expr(f"timestampadd(HOUR, hour, {first})"))
    rows = rows.withColumn("end", F.expr("timestampadd(MINUTE, minutes, start)"))
    sites = rows.select("stage_id").distinct()
    own = sites.selectExpr("stage_id", "explode(sequence(0, 7)) AS i").selectExpr(
        "stage_id", "explode(array(0, 1, 2)) AS k", "i"
    ).selectExpr(
        "stage_id",
        "concat('W', stage_id, '-', k) AS worker_id",
        "concat('W', stage_id, '-', k) AS supervisor_id",
        f"timestampadd(HOUR, 8 * i, {first}) AS start",
        f"timestampadd(HOUR, 8 * i + 8, {first}) AS end",
    )
    people = sites.selectExpr("stage_id", "explode(sequence(0, 39)) AS k").selectExpr(
        "concat('W', stage_id, '-', k) AS id",
        "k < 39 AS active",
        "CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN NULL ELSE 5 END AS seniority",
    )
    stages = sites.selectExpr("stage_id AS id", "CASE WHEN stage_id % 9 = 3 THEN DATE '2001-12-31' END AS ended")
    existing = rows.filter("l_linenumber = 1").select(*shifts.SHIFT_COLUMNS).unionByName(own)
    candidates = rows.filter("l_linenumber > 1").select("seq", *shifts.SHIFT_COLUMNS)
    return shifts.validate_shifts(existing, candidates, people, stages, TODAY)
