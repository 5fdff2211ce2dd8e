"""The star-schema tables seen in the roles the operators expect.

Each role is a DataFrame over a whole table; `ROLE_SQL` has the same mapping as
a common table expression for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stonewatch.config import ACCEL, CRACK, GYRO, HYGRO, RAIN, THERMO

# Fixed values of the mapping: kind and alert threshold by position in a building.
KIND_BY_SLOT = (THERMO, CRACK, RAIN, HYGRO, ACCEL, GYRO)
THRESHOLD_BY_SLOT = (55, 55, 55, 53, 330, 340)

CALC_DATE = "2024-01-31"
TODAY = "2002-01-01"


def _slot_case(values, quote: bool, key: str = "s_suppkey") -> str:
    arms = " ".join(
        f"WHEN {i} THEN " + (f"'{v}'" if quote else str(v)) for i, v in enumerate(values)
    )
    return f"CASE {key} % 6 {arms} END"


KIND_CASE = _slot_case(KIND_BY_SLOT, True)
THRESHOLD_CASE = _slot_case(THRESHOLD_BY_SLOT, False)

# role -> (table, Spark projection, SQL projection where it differs)
_PLAIN: dict[str, tuple[str, list[str], list[str] | None]] = {
    "measurement": (
        "events",
        [
            "user_id div 10 AS sensor_id",
            "ts",
            "CAST(value AS DECIMAL(18,6)) AS x",
            "CAST(value / 2 AS DECIMAL(18,6)) AS y",
            "CAST(CAST(get_json_object(props, '$.k') AS DOUBLE) / 10 AS DECIMAL(18,6)) AS z",
            "event_id",
        ],
        [
            "user_id // 10 AS sensor_id",
            "ts",
            "CAST(value AS DECIMAL(18,6)) AS x",
            "CAST(value / 2 AS DECIMAL(18,6)) AS y",
            "CAST(CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10 AS DECIMAL(18,6)) AS z",
            "event_id",
        ],
    ),
    # some 300 readings of each sensor within two minutes
    "tremor": (
        "lineitem",
        [
            "l_orderkey div 75 AS sensor_id",
            "timestampadd(SECOND, CAST((l_partkey * 7919 + l_suppkey * 31 + l_linenumber) % 121 AS INT),"
            " TIMESTAMP_NTZ '2024-01-31 00:02:00') AS ts",
            "CAST(1 + l_discount AS DECIMAL(18,6)) AS x",
            "CAST(l_tax AS DECIMAL(18,6)) AS y",
            "CAST(l_quantity / 1000 AS DECIMAL(18,6)) AS z",
            "l_orderkey AS event_id",
        ],
        [
            "l_orderkey // 75 AS sensor_id",
            "TIMESTAMP '2024-01-31 00:02:00' + to_seconds(CAST((l_partkey * 7919 + l_suppkey * 31 + l_linenumber) % 121 AS"
            " INTEGER)) AS ts",
            "CAST(1 + l_discount AS DECIMAL(18,6)) AS x",
            "CAST(l_tax AS DECIMAL(18,6)) AS y",
            "CAST(l_quantity / 1000 AS DECIMAL(18,6)) AS z",
            "l_orderkey AS event_id",
        ],
    ),
    "sensor": (
        "supplier",
        [
            "s_suppkey AS id",
            "CAST(s_suppkey % 3 AS SMALLINT) AS floor",
            "s_suppkey div 6 AS building_id",
            f"{KIND_CASE} AS kind",
            f"CAST({THRESHOLD_CASE} AS DECIMAL(9,6)) AS threshold",
            "CAST(s_suppkey % 4 AS DECIMAL(5,2)) AS x",
            "CAST((s_suppkey % 2) / 2 AS DECIMAL(5,2)) AS y",
            "CAST(1.5 AS DECIMAL(5,2)) AS z",
            "CAST((s_suppkey % 5) / 5 AS DECIMAL(3,2)) AS importance",
        ],
        [
            "s_suppkey AS id",
            "CAST(s_suppkey % 3 AS SMALLINT) AS floor",
            "s_suppkey // 6 AS building_id",
            f"{KIND_CASE} AS kind",
            f"CAST({THRESHOLD_CASE} AS DECIMAL(9,6)) AS threshold",
            "CAST(s_suppkey % 4 AS DECIMAL(5,2)) AS x",
            "CAST((s_suppkey % 2) / 2 AS DECIMAL(5,2)) AS y",
            "CAST(1.5 AS DECIMAL(5,2)) AS z",
            "CAST((s_suppkey % 5) / 5 AS DECIMAL(3,2)) AS importance",
        ],
    ),
    "tremor_sensor": (
        "customer",
        [
            "c_custkey AS id",
            "CAST(c_custkey % 3 AS SMALLINT) AS floor",
            "c_custkey div 2 AS building_id",
            "CASE WHEN c_custkey % 2 = 0 THEN 'Accelerometro' ELSE 'Giroscopio' END AS kind",
        ],
        [
            "c_custkey AS id",
            "CAST(c_custkey % 3 AS SMALLINT) AS floor",
            "c_custkey // 2 AS building_id",
            "CASE WHEN c_custkey % 2 = 0 THEN 'Accelerometro' ELSE 'Giroscopio' END AS kind",
        ],
    ),
    "area": ("nation", ["concat('A', n_nationkey) AS postcode"], None),
    "building": (
        "customer",
        [
            "c_custkey AS id",
            "concat('A', c_nationkey) AS area",
            "CAST((c_custkey * 37 % 1600) / 1000 - 0.8 AS DECIMAL(9,6)) AS lat",
            "CAST((c_custkey * 91 % 3400) / 1000 - 1.7 AS DECIMAL(9,6)) AS lon",
            "c_mktsegment AS kind",
        ],
        None,
    ),
    "disaster": (
        "region",
        [
            "timestampadd(MINUTE, r_regionkey + 1, TIMESTAMP_NTZ '2024-01-31 00:00:00') AS ts",
            "CAST(r_regionkey / 10 AS DECIMAL(9,6)) AS lat",
            "CAST(r_regionkey / 5 AS DECIMAL(9,6)) AS lon",
            "'Terremoto' AS kind",
            "CAST(NULL AS DECIMAL(4,2)) AS intensity",
        ],
        [
            "TIMESTAMP '2024-01-31 00:00:00' + to_minutes(r_regionkey + 1) AS ts",
            "CAST(r_regionkey / 10 AS DECIMAL(9,6)) AS lat",
            "CAST(r_regionkey / 5 AS DECIMAL(9,6)) AS lon",
            "'Terremoto' AS kind",
            "CAST(NULL AS DECIMAL(4,2)) AS intensity",
        ],
    ),
    "disaster_area": (
        "nation",
        [
            "concat('A', n_nationkey) AS area",
            "timestampadd(MINUTE, n_regionkey + 1, TIMESTAMP_NTZ '2024-01-31 00:00:00') AS disaster_ts",
        ],
        [
            "concat('A', n_nationkey) AS area",
            "TIMESTAMP '2024-01-31 00:00:00' + to_minutes(n_regionkey + 1) AS disaster_ts",
        ],
    ),
    "risk": (
        "orders",
        [
            "concat('A', o_custkey % 25) AS area",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'Sismico' WHEN '2-HIGH' THEN 'Idrogeologico'"
            " ELSE o_orderpriority END AS kind",
            "CAST(o_orderdate AS DATE) AS measured",
            "CAST(floor(o_totalprice / 1000) AS BIGINT) % 6 AS coefficient",
            "o_orderkey AS risk_id",
        ],
        None,
    ),
    "project": (
        "customer",
        [
            "c_custkey AS id",
            "c_custkey AS building_id",
            "CASE WHEN c_acctbal >= 0 THEN CAST(c_acctbal AS DECIMAL(10,2)) END AS cost",
        ],
        None,
    ),
    "management": (
        "orders",
        [
            "o_custkey AS project_id",
            "concat('W', o_orderkey % 10) AS person_id",
            "CAST(o_totalprice AS DECIMAL(10,2)) AS fee",
        ],
        None,
    ),
    "stage": (
        "orders",
        [
            "o_orderkey AS id",
            "o_custkey AS project_id",
            "CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS ended",
        ],
        None,
    ),
    "job": (
        "orders",
        ["o_orderkey AS id", "o_orderkey AS stage_id", "o_orderstatus = 'F' AS done"],
        None,
    ),
    "lot_use": (
        "lineitem",
        [
            "l_orderkey AS job_id",
            "l_partkey AS lot_id",
            "CAST(l_quantity AS BIGINT) AS quantity",
        ],
        None,
    ),
    "priced_lot": (
        "part",
        [
            "p_partkey AS id",
            "p_partkey div 4 AS material_id",
            "CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price",
        ],
        [
            "p_partkey AS id",
            "p_partkey // 4 AS material_id",
            "CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price",
        ],
    ),
    "person": (
        "supplier",
        [
            "concat('W', s_suppkey) AS id",
            "s_acctbal > 0 AS active",
            "CASE WHEN s_suppkey % 17 <> 0 THEN s_suppkey % 30 END AS seniority",
        ],
        None,
    ),
    # most pay known, so that most projects have a cost
    "paid_person": (
        "supplier",
        ["concat('W', s_suppkey) AS id", "CASE WHEN s_suppkey % 97 <> 0 THEN 30 + s_suppkey % 30 END AS seniority"],
        None,
    ),
    "shift": (
        "lineitem",
        [
            "l_orderkey AS stage_id",
            "concat('W', l_suppkey) AS worker_id",
            "concat('W', l_suppkey % 5) AS supervisor_id",
            "timestampadd(HOUR, l_linenumber, l_shipdate) AS start",
            "timestampadd(MINUTE, CAST(l_quantity * 10 AS INT), timestampadd(HOUR, l_linenumber, l_shipdate)) AS end",
        ],
        [
            "l_orderkey AS stage_id",
            "concat('W', l_suppkey) AS worker_id",
            "concat('W', l_suppkey % 5) AS supervisor_id",
            "l_shipdate + to_hours(l_linenumber) AS \"start\"",
            "l_shipdate + to_hours(l_linenumber) + to_minutes(CAST(l_quantity * 10 AS INTEGER)) AS \"end\"",
        ],
    ),
    # the same shifts on ten large sites
    "site_shift": (
        "lineitem",
        [
            "l_orderkey % 10 AS stage_id",
            "concat('W', l_suppkey) AS worker_id",
            "concat('W', l_suppkey % 5) AS supervisor_id",
            "timestampadd(HOUR, l_linenumber, l_shipdate) AS start",
            "timestampadd(MINUTE, CAST(l_quantity * 10 AS INT), timestampadd(HOUR, l_linenumber, l_shipdate)) AS end",
        ],
        [
            "l_orderkey % 10 AS stage_id",
            "concat('W', l_suppkey) AS worker_id",
            "concat('W', l_suppkey % 5) AS supervisor_id",
            "l_shipdate + to_hours(l_linenumber) AS \"start\"",
            "l_shipdate + to_hours(l_linenumber) + to_minutes(CAST(l_quantity * 10 AS INTEGER)) AS \"end\"",
        ],
    ),
}

_FLOOR = ["p_partkey", "p_partkey {div} 3 AS building_id", "CAST(p_partkey % 3 AS SMALLINT) AS floor"]
_SIDES = [
    "CAST(p_size AS DECIMAL(10,4)) AS w",
    "CAST(p_size % 7 + 1 AS DECIMAL(10,4)) AS h",
    "p_size % 10 = 3 AS open_side",
    "p_size % 5 = 0 AS askew",
]
# Per floor: a house outline with an inward point on top and one inner wall.
_WALLS = [
    ("1", "0", "0", "w", "0"),
    ("2", "w", "0", "w", "h"),
    ("3", "w", "h", "w / 2", "h / 2"),
    ("4", "w / 2", "h / 2", "0", "h"),
    ("5", "0", "h", "0", "0"),
    ("6", "w / 2", "0", "w / 2", "h / 2"),
]
_OPENINGS = [
    ("1", "w / 4", "0", "w / 2", "0", "'Finestra'"),
    ("2", "w / 2", "0", "w / 2", "h / 4", "'Porta'"),
    ("3", "w", "h", "w * 3 / 4", "h * 3 / 4 + CASE WHEN askew THEN 0.25 ELSE 0 END", "'Vuoto'"),
]
_FACES = [
    ("1", "1", "true"),
    ("2", "2", "true"),
    ("3", "2", "true"),
    ("4", "1", "true"),
    ("5", "1", "true"),
    ("5", "2", "open_side"),
    ("6", "1", "true"),
    ("6", "2", "true"),
]


def _segment(slot, x1, y1, x2, y2, *kind) -> dict[str, str]:
    ends = {n: f"CAST({v} AS DECIMAL(5,2))" for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))}
    out = {"id": f"p_partkey * 10 + {slot}", "building_id": "building_id", "floor": "floor", **ends}
    return {**out, "kind": kind[0]} if kind else out


def _rows_sql(rows: list[tuple[dict[str, str], str]]) -> str:
    """Several rows per plot as a union, for plain SQL."""
    return " UNION ALL ".join(
        f"SELECT {', '.join(f'{v} AS {n}' for n, v in row.items())} FROM plot WHERE {cond}" for row, cond in rows
    )


def _rows_inline(rows: list[tuple[dict[str, str], str]]) -> str:
    """The same in one pass over the plots, for Spark."""
    structs = ", ".join(
        f"IF({cond}, named_struct({', '.join(f"'{n}', {v}" for n, v in row.items())}), NULL)" for row, cond in rows
    )
    return f"SELECT inline(array_compact(array({structs}))) FROM plot"


def plot_sql(div: str) -> str:
    """One row per floor with its measurements."""
    cols = ", ".join(c.format(div=div) for c in _FLOOR + _SIDES)
    return f"SELECT {cols} FROM part"


PLOT_ROWS = {
    "wall": [(_segment(*w), "true") for w in _WALLS],
    # the same walls with ten plots drawn over each other on each floor
    "crowded_wall": [({**_segment(*w), "building_id": "p_partkey {div} 30"}, "true") for w in _WALLS],
    "opening": [(_segment(*o), "true") for o in _OPENINGS],
    "wall_face": [
        ({"room_id": f"p_partkey * 10 + {room}", "wall_id": f"p_partkey * 10 + {wall}"}, cond)
        for wall, room, cond in _FACES
    ],
    "room": [
        ({"id": f"p_partkey * 10 + {n}", "building_id": "building_id", "floor": "floor"}, "true") for n in (1, 2)
    ],
}
# Stock: one lot per part, day and order line; ids are unique within part and day.
LOT_SQL = (
    "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS material_id,"
    " CAST(l_shipdate AS DATE) AS purchased, CAST(SUM(l_quantity) AS BIGINT) AS available"
    " FROM lineitem GROUP BY 1, 2, 3"
)
# Requests: one per part and order line number, for a share of what those lines hold.
REQUEST_SQL = (
    "SELECT CAST(l_linenumber AS BIGINT) AS job_id, l_partkey AS material_id,"
    " CAST(l_linenumber AS BIGINT) AS seq, CAST({share} AS BIGINT) AS quantity"
    " FROM lineitem GROUP BY l_linenumber, l_partkey"
)
MODEST = "floor(SUM(l_quantity) * 0.4)"
GREEDY = "floor(SUM(l_quantity) * (5 + 2 * l_linenumber) / 10)"
MATERIAL_SQL = "SELECT p_partkey {div} 4 AS id, MIN(p_name) AS name FROM part GROUP BY 1"

_GROUPED = {
    "lot": ("lineitem", LOT_SQL),
    "request": ("lineitem", REQUEST_SQL.format(share=MODEST)),
    "greedy_request": ("lineitem", REQUEST_SQL.format(share=GREEDY)),
    "material": ("part", MATERIAL_SQL),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projected(name: str, raw: DataFrame) -> DataFrame:
    """A plain role over its source table, also when that is a stream."""
    return raw.selectExpr(*_PLAIN[name][1])


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a DataFrame over the tables in `sf_dir`."""
    if name in _PLAIN:
        source, projection, _ = _PLAIN[name]
        return table(spark, sf_dir, source).selectExpr(*projection)
    if name in PLOT_ROWS:
        text = _rows_inline(PLOT_ROWS[name]).format(div="div").replace("FROM plot", "FROM {plot}")
        plots = spark.sql(plot_sql("div").replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
        return spark.sql(text, plot=plots)
    source, text = _GROUPED[name]
    text = text.format(div="div").replace(f"FROM {source}", "FROM {raw}")
    return spark.sql(text, raw=table(spark, sf_dir, source))


def _role_sql() -> dict[str, str]:
    out = {}
    for name, (source, projection, other) in _PLAIN.items():
        out[name] = f"SELECT {', '.join(other or projection)} FROM {source}"
    for name, rows in PLOT_ROWS.items():
        out[name] = _rows_sql(rows).format(div="//")
    for name, (_, text) in _GROUPED.items():
        out[name] = text.format(div="//")
    out["plot"] = plot_sql("//")
    return out


ROLE_SQL = _role_sql()


def with_roles(*names: str, **more: str) -> str:
    """A WITH clause defining the roles, then any further expressions."""
    ordered = list(names)
    if any(" FROM plot" in ROLE_SQL[n] for n in ordered):
        ordered.insert(0, "plot")
    parts = [f"{n} AS ({ROLE_SQL[n]})" for n in ordered]
    parts += [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH RECURSIVE " + ", ".join(parts) + " "
