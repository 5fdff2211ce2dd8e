"""Pieces of SQL shared by the checks."""

from stonewatch.config import ACCEL, ADVICE_RULES, HEALTH_WEIGHT, HIGH_RATE, LOW_RATE, NO_ADVICE


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LOW = f"({quoted(LOW_RATE)})"
HIGH = f"({quoted(HIGH_RATE)})"
MAGNITUDE = (
    "sqrt(CAST(x AS DOUBLE) * CAST(x AS DOUBLE) + CAST(y AS DOUBLE) * CAST(y AS DOUBLE)"
    " + CAST(z AS DOUBLE) * CAST(z AS DOUBLE))"
)


def ratio(num: str, den: str, scale: int) -> str:
    """num / den rounded half away from zero at a scale, exactly, for integers (den > 0)."""
    n = f"CAST(abs({num}) AS HUGEINT)"
    whole = f"(2 * {n} * {10**scale} + CAST({den} AS HUGEINT)) // (2 * CAST({den} AS HUGEINT))"
    unit = "1" if scale == 0 else f"0.{'0' * (scale - 1)}1"
    return (
        f"CAST(sign({num}) AS DECIMAL(1,0)) * CAST({whole} AS DECIMAL(24,0))"
        f" * CAST({unit} AS DECIMAL({scale + 1},{scale}))"
    )


def reround(expr: str, scale: int, to: int) -> str:
    """A decimal of one scale rounded half away from zero to a smaller scale."""
    return f"round(CAST({expr} AS DECIMAL(28,{scale})), {to})"


def mean6(column: str) -> str:
    """Mean of a six-decimal column, kept at six decimals after ten."""
    ten = ratio(f"CAST(SUM({column}) * 1000000 AS HUGEINT)", f"(1000000 * COUNT({column}))", 10)
    return f"CAST({reround(ten, 10, 6)} AS DECIMAL(18,6))"


WEIGHT = (
    "CASE kind "
    + " ".join(f"WHEN '{k}' THEN CAST({w} AS DECIMAL(9,6))" for k, w in HEALTH_WEIGHT.items())
    + " END"
)


def health_sql(source: str, keep: str) -> str:
    """Health from rows with kind, reading and threshold."""
    return (
        f"SELECT {keep}, CAST(CASE WHEN x <= p * s THEN 10.0 WHEN x >= s THEN 0.0 ELSE"
        " 10.0 - 10.0 * (CAST(x - p * s AS DOUBLE) / nullif(CAST(s - p * x AS DOUBLE), 0)) END AS DECIMAL(5,2)) AS health"
        f" FROM (SELECT *, CASE WHEN kind = '{ACCEL}' THEN abs(reading - 1) ELSE reading END AS x,"
        f" CASE WHEN kind = '{ACCEL}' THEN threshold - 1 ELSE threshold END AS s, {WEIGHT} AS p FROM {source})"
    )


def readings_sql(tagged: str, keys: str) -> str:
    """Mean of low-rate and top 1 % mean of high-rate sensors, per key."""
    return (
        f"SELECT {keys}, {mean6('x')} AS reading FROM {tagged} WHERE kind IN {LOW} GROUP BY {keys}"
        f" UNION ALL SELECT {keys}, CAST(AVG(m) AS DECIMAL(18,6)) AS reading FROM ("
        f"SELECT {keys}, m, ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY m DESC) AS rn,"
        f" COUNT(*) OVER (PARTITION BY {keys}) AS n FROM (SELECT *, {MAGNITUDE} AS m FROM {tagged} WHERE kind IN {HIGH}))"
        f" WHERE rn * 100 <= n GROUP BY {keys}"
    )


def health_ctes(day: str, new: tuple[int, int], old: tuple[int, int]) -> dict[str, str]:
    """Expressions ending in `h`: health per sensor and period around a date literal."""
    spans = " UNION ALL ".join(
        f"SELECT '{name}' AS period, CAST(DATE '{day}' - {a} AS TIMESTAMP) AS a, CAST(DATE '{day}' - {b} AS TIMESTAMP) AS b"
        for name, (a, b) in (("new", new), ("old", old))
    )
    return {
        "span": spans,
        "tagged": "SELECT m.*, s.kind, span.period FROM measurement m JOIN sensor s ON s.id = m.sensor_id"
        " JOIN span ON m.ts BETWEEN span.a AND span.b",
        "reading": readings_sql("tagged", "sensor_id, period"),
        "judged": "SELECT s.id AS sensor_id, s.building_id, s.kind, s.threshold, span.period, r.reading FROM sensor s"
        " CROSS JOIN span LEFT JOIN reading r ON r.sensor_id = s.id AND r.period = span.period",
        "h": health_sql("judged", "sensor_id, building_id, kind, threshold, period, reading"),
    }


HEALTH_PAIR = (
    "SELECT sensor_id, building_id, kind, MAX(CASE WHEN period = 'new' THEN health END) AS health_now,"
    " MAX(CASE WHEN period = 'old' THEN health END) AS health_before FROM h GROUP BY 1, 2, 3"
)

ON_WALL = (
    "SELECT s.id AS sensor_id, MIN(w.id) AS wall_id FROM sensor s JOIN wall w ON w.building_id = s.building_id"
    " AND w.floor = s.floor AND s.x BETWEEN least(w.x1, w.x2) AND greatest(w.x1, w.x2)"
    " AND s.y BETWEEN least(w.y1, w.y2) AND greatest(w.y1, w.y2) GROUP BY 1"
)


def _arms(pick) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {pick(k)}" for k in ADVICE_RULES) + " END"


def _grade(kind: str, mild, severe, none) -> str:
    rule = ADVICE_RULES[kind]
    op = "<=" if rule.inclusive_drop else "<"
    return (
        f"CASE WHEN health_now {op} health_before - 0.3 * health_before AND health_now >= {rule.limit} THEN {mild}"
        f" WHEN health_now < {rule.limit} THEN {severe} ELSE {none} END"
    )


ADVICE_TEXT = _arms(
    lambda k: _grade(
        k, quoted([ADVICE_RULES[k].mild_text]), quoted([ADVICE_RULES[k].severe_text]), quoted([NO_ADVICE])
    )
)
ADVICE_WEIGHT = _arms(
    lambda k: _grade(k, ADVICE_RULES[k].mild_importance, ADVICE_RULES[k].severe_importance, 0)
)
ADVICE_PREFIX = _arms(lambda k: quoted([ADVICE_RULES[k].prefix]))
ADVICE_SELECT = (
    f"SELECT hp.sensor_id, hp.building_id, kind, {ADVICE_PREFIX} || CAST(CASE WHEN kind = 'Fessurimetro' THEN wall_id"
    f" ELSE hp.sensor_id END AS VARCHAR) AS label, {ADVICE_TEXT} AS advice, {ADVICE_WEIGHT} AS importance"
    " FROM hp LEFT JOIN ow ON ow.sensor_id = hp.sensor_id"
)
