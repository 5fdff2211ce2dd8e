from decimal import Decimal as D

from conftest import values
from stonewatch.config import ADVICE_RULES, NO_ADVICE
from stonewatch.operators import sensors as op

SENSOR = (
    "id bigint, floor smallint, building_id bigint, kind string, threshold decimal(9,6),"
    " x decimal(5,2), y decimal(5,2), z decimal(5,2), importance decimal(3,2)"
)
READING = "sensor_id bigint, ts timestamp_ntz, x decimal(9,6), y decimal(9,6), z decimal(9,6)"
WALL = (
    "id bigint, floor smallint, building_id bigint, x1 decimal(5,2), y1 decimal(5,2), x2 decimal(5,2), y2 decimal(5,2)"
)
HEALTH = "sensor_id bigint, building_id bigint, kind string, health_now decimal(4,2), health_before decimal(4,2)"


def sensor(i, kind, threshold, x=0, y=0, floor=0, building=1):
    return (i, floor, building, kind, threshold, x, y, 1, 1)


def test_windows_are_closed_and_end_at_midnight(make):
    sensors = make(SENSOR, [sensor(1, "Termometro", 40), sensor(2, "Termometro", 40)])
    readings = make(
        READING,
        [
            (1, "2023-01-17 00:00:00", 34, None, None),  # first instant of the new window
            (1, "2023-02-01 00:00:00", 36, None, None),  # last instant of it
            (1, "2023-02-01 00:00:01", 99, None, None),  # after it
            (1, "2023-01-16 00:00:00", 30, None, None),  # last instant of the old window
            (1, "2023-01-16 10:00:00", 99, None, None),  # between the windows
            (1, "2023-01-01 23:59:59", 99, None, None),  # before the old window
        ],
    )
    rows = op.sensor_health(readings, sensors, op.day_spans("2023-02-01", op.DEFAULT.advice_periods))
    assert values(rows, "sensor_id", "period", "reading") == [
        (1, "new", D("35.000000")),
        (1, "old", D("30.000000")),
        (2, "new", None),
        (2, "old", None),
    ]


def test_a_reading_may_fall_into_both_windows(make):
    spans = op.day_spans("2023-01-31", op.DEFAULT.risk_periods)
    times = ["2023-01-14 23:59:59", "2023-01-15 12:00:00", "2023-01-16 00:00:00", "2023-01-16 00:00:01"]
    rows = make(READING, [(i, t, 1, None, None) for i, t in enumerate(times)])
    assert values(op.tag_periods(rows, spans), "sensor_id", "period") == [
        (0, "old"), (1, "new"), (1, "old"), (2, "new"), (2, "old"), (3, "new"),
    ]


def test_high_rate_needs_a_hundred_readings(make):
    sensors = make(SENSOR, [sensor(1, "Giroscopio", "0.115"), sensor(2, "Giroscopio", "0.115")])
    rows = [(s, f"2023-01-20 10:00:00.{i:06d}", f"0.0{i:03d}", 0, 0) for s, n in ((1, 99), (2, 100)) for i in range(n)]
    got = op.health_table(make(READING, rows), sensors, "2023-02-01")
    assert dict(values(got, "sensor_id", "health_now"))[1] is None
    health = dict(values(got, "sensor_id", "health_now"))
    assert health[2] is not None


def test_wall_of_sensor(make):
    sensors = make(SENSOR, [sensor(1, "Fessurimetro", 9, 2, 7), sensor(2, "Fessurimetro", 9, 3, 3), sensor(3, "Fessurimetro", 9, 9, 9)])
    walls = make(WALL, [(13, 0, 1, 0, 7, 4, 7), (12, 0, 1, 8, 3, 3, 3), (11, 0, 1, 3, 3, 0, 3), (14, 1, 1, 0, 7, 4, 7)])
    assert values(op.wall_of_sensor(sensors, walls), "sensor_id", "wall_id") == [(1, 13), (2, 11)]


def test_advice_follows_drop_and_limits(make):
    kinds = {
        "Fessurimetro": [(7, 10, 3), ("7.01", 10, 0), ("0.99", 10, 5)],  # exactly 30 % counts
        "Pluviometro": [(7, 10, 0), ("6.99", 10, 3), ("0.99", 10, 4)],
        "Termometro": [("6.99", 10, 2), ("2.99", 10, 4)],
        "Igrometro": [("6.99", 10, 2), ("4.99", 10, 3), (5, 10, 2)],
        "Accelerometro": [(3, 10, 4), (0, 10, 5)],
        "Giroscopio": [("3.70", "9.32", 4), ("3.70", None, 0), ("2.9", None, 5)],
    }
    rows, want = [], {}
    for kind, cases in kinds.items():
        for now, before, importance in cases:
            i = len(rows) + 1
            rows.append((i, 1, kind, now, before))
            want[i] = (importance, kind)
    sensors = make(SENSOR, [sensor(i, k, 9, 2, 7) for i, (_, k) in want.items()])
    walls = make(WALL, [(13, 0, 1, 0, 7, 4, 7)])
    got = {r.sensor_id: r for r in op.advice(make(HEALTH, rows), sensors, walls).collect()}
    for i, (importance, kind) in want.items():
        rule = ADVICE_RULES[kind]
        assert got[i].importance == importance, (i, kind)
        assert got[i].label == rule.prefix + ("13" if kind == "Fessurimetro" else str(i))
        text = {0: NO_ADVICE, rule.mild_importance: rule.mild_text, rule.severe_importance: rule.severe_text}
        assert got[i].advice == text[importance]
    kept = op.interventions(make(HEALTH, rows), sensors, walls, 5)
    assert {r.sensor_id for r in kept.collect()} == {
        i for i, (imp, _) in want.items() if imp and float(rows[i - 1][3]) <= 5
    }
    ranks = [r.importance for r in kept.collect()]
    assert ranks == sorted(ranks, reverse=True)


def test_two_cracks_on_one_wall_both_stay_and_off_wall_has_no_label(make):
    sensors = make(SENSOR, [sensor(1, "Fessurimetro", 9, 2, 7), sensor(2, "Fessurimetro", 9, 3, 7), sensor(3, "Fessurimetro", 9, 50, 50)])
    walls = make(WALL, [(13, 0, 1, 0, 7, 4, 7)])
    rows = make(HEALTH, [(i, 1, "Fessurimetro", 0, 10) for i in (1, 2, 3)])
    got = dict(values(op.interventions(rows, sensors, walls, 10), "sensor_id", "label"))
    assert got == {1: "Struttura - Muro: 13", 2: "Struttura - Muro: 13", 3: None}


def test_deviation_ranking(make):
    sensors = make(SENSOR, [sensor(1, "Pluviometro", 100), sensor(2, "Termometro", 40), sensor(3, "Giroscopio", 1), sensor(4, "Igrometro", 0)])
    rows = [(1, f"2023-01-20 10:{i:02d}:00", v, None, None) for i, v in enumerate([90, 90, 90, 90, 90, 1, 1])]
    rows += [(2, "2023-01-19 23:59:59", 50, None, None), (2, "2023-01-19 23:59:58", 90, None, None)]
    rows += [(3, "2023-01-20 10:00:00", 50, 0, 0), (4, "2023-01-20 10:00:00", 5, None, None)]
    got = op.deviation_ranking(make(READING, rows), sensors, "2023-01-20 23:59:59").collect()
    assert [(r.sensor_id, r.deviation) for r in got][:2] == [(2, D("0.25")), (1, D("-0.10"))]
    assert got[2].sensor_id == 4 and got[2].deviation is None  # zero threshold


def test_alerts_and_summaries(make):
    sensors = make(SENSOR, [sensor(1, "Termometro", 40), sensor(2, "Giroscopio", "0.5"), sensor(3, "Accelerometro", "1.1", building=2)])
    readings = make(
        READING,
        [
            (1, "2023-01-01 10:00:00", 40, None, None),
            (1, "2023-01-02 10:00:00", "39.999999", None, None),
            (2, "2023-01-01 12:00:00", "0.3", "0.4", 0),
            (2, "2023-01-01 13:00:00", "0.9", None, 0),
        ],
    )
    buildings = make("id bigint, area string", [(1, "A"), (2, "B")])
    areas = make("postcode string", [("A",), ("B",), ("C",)])
    found = op.alerts(readings, sensors)
    assert [r[0] for r in values(found, "sensor_id", "ts")] == [1, 2]
    summary = op.alert_summary(found, sensors, buildings, areas)
    got = op.expected_alerts(summary, sensors, buildings, "2023-01-05")
    assert values(got, "area", "alerts", "expected") == [("A", 2, 3), ("B", 0, None), ("C", 0, None)]
    only_high = op.alert_summary(found, sensors, buildings, areas, kinds=("Giroscopio", "Accelerometro"))
    assert values(only_high, "area", "alerts")[0] == ("A", 1)


def test_empty_tables(make):
    table = op.health_table(make(READING, []), make(SENSOR, []), "2023-02-01")
    assert table.count() == 0


def test_stored_days_outside_the_periods_are_not_read(spark, make, tmp_path):
    from stonewatch.sources import tables as store

    sensors = make(SENSOR, [sensor(1, "Termometro", 40), sensor(2, "Giroscopio", "0.5")])
    rows = [(1, f"2023-01-{d:02d} 10:00:00", 20 + d, None, None) for d in range(1, 29)]
    store.write_table(make(READING, rows), str(tmp_path), "measurement")
    stored, plain = store.read_table(spark, str(tmp_path), "measurement"), make(READING, rows)
    for run in (
        lambda m: op.health_table(m, sensors, "2023-01-28"),
        lambda m: op.deviation_ranking(m, sensors, "2023-01-20 12:00:00"),
    ):
        got, want = run(stored), run(plain)
        assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString()
        assert values(got, *got.columns) == values(want, *want.columns)
