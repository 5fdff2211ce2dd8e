import datetime as dt
from decimal import Decimal as D

import pytest

from conftest import values
from stonewatch.config import Config, REFERENCE_RISK_CLASSES
from stonewatch.operators import disaster, risk
from test_sensors import READING, SENSOR, sensor

RISK = "area string, kind string, measured date, coefficient int"
ROWS = [
    ("A", "Sismico", "2023-01-20", 2),
    ("A", "Idrogeologico", "2023-01-20", 2),
    ("A", "Sismico", "2022-01-10", 3),
    ("A", "Idrogeologico", "2022-01-10", 4),
    ("B", "Sismico", "2022-06-01", 5),
]


def test_risk_in_force_is_per_area(make):
    got = risk.risk_in_force(make(RISK, ROWS), "2023-02-01")
    assert values(got, "area", "kind", "coefficient") == [
        ("A", "Idrogeologico", 2), ("A", "Sismico", 2), ("B", "Sismico", 5),
    ]
    assert values(risk.risk_in_force(make(RISK, ROWS), "2023-01-19"), "coefficient") == [(3,), (4,), (5,)]


def test_risk_on_many_dates(make):
    asked = make(
        "id int, area string, kind string, date date",
        [(1, "A", "Sismico", "2022-01-09"), (2, "A", "Sismico", "2022-01-10"), (3, "A", "Sismico", "2023-01-19"),
         (4, "A", "Sismico", "2024-01-01"), (5, "C", "Sismico", "2024-01-01"), (6, "A", "Sismico", "2024-01-01")],
    )
    got = risk.risk_on_dates(asked, make(RISK, ROWS))
    assert values(got, "id", "coefficient") == [(1, None), (2, 3), (3, 3), (4, 2), (5, None), (6, 2)]


def building_case(make):
    sensors = make(
        SENSOR,
        [sensor(1, "Termometro", 40), sensor(2, "Fessurimetro", 10), sensor(3, "Pluviometro", 100)],
    )
    readings = make(
        READING,
        [
            (1, "2023-01-20 10:00:00", 40, None, None),  # health 0 in the new period
            (3, "2023-01-20 10:00:00", 10, None, None),  # health 10
            (2, "2023-01-20 10:00:00", 10, None, None),
            (1, "2023-01-10 10:00:00", 10, None, None),
            (3, "2023-01-10 10:00:00", 10, None, None),
            (2, "2023-01-10 10:00:00", 1, None, None),
        ],
    )
    return readings, sensors, make("id bigint, area string", [(1, "A")])


def test_building_risk_and_state(make):
    readings, sensors, buildings = building_case(make)
    rows = risk.building_risk(readings, sensors, buildings, make(RISK, ROWS), "2023-01-31")
    assert values(rows, "class", "period", "risk") == [
        ("environmental", "new", D("15.00")),  # mean 5 x (2 + 1)
        ("environmental", "old", D("0.00")),
        ("structural", "new", D("30.00")),
        ("structural", "old", D("0.00")),
    ]
    # 100 - 1.15 x 45
    assert values(risk.building_state(rows), "state") == [(48,)]


def test_state_on_dates_agrees_with_one_date(make):
    readings, sensors, buildings = building_case(make)
    asked = make("building_id bigint, as_of date", [(1, "2023-01-31"), (1, "2023-02-02")])
    many = risk.building_risk_on_dates(readings, sensors, buildings, make(RISK, ROWS), asked)
    states = dict(values(risk.building_state(many, ("building_id", "as_of")), "as_of", "state"))
    for day, state in states.items():
        alone = risk.building_risk(readings, sensors, buildings, make(RISK, ROWS), day)
        assert risk.building_state(alone).first().state == state
    assert len(states) == 2


def test_state_never_below_zero_and_unknown_without_risk(make):
    ddl = "building_id bigint, class string, period string, risk decimal(9,2)"
    high = [(1, c, p, 60) for c in ("environmental", "structural") for p in ("new", "old")]
    part = [(2, "environmental", p, 60) for p in ("new", "old")]
    assert values(risk.building_state(make(ddl, high + part)), "building_id", "state") == [(1, 0), (2, None)]


def test_gyroscopes_count_unless_reference_classes_are_asked_for():
    assert "Giroscopio" in Config().risk_classes[1].kinds
    assert "Giroscopio" not in REFERENCE_RISK_CLASSES[1].kinds


def test_trends(make):
    areas = make("postcode string", [("A",), ("B",), ("C",)])
    rows = risk.risk_trend(make(RISK, ROWS), areas, "2023-02-01")
    got = {r.area: r for r in rows.collect()}
    assert (got["A"].risk_now, got["A"].risk_before) == (D("2.0"), D("3.5"))
    assert got["A"].trend.endswith("è passata da 3.5 a 2.0, una diminuzione del -42.9%")
    assert got["B"].trend == risk.RISK_STABLE
    assert got["C"].trend is None
    expected = make("area string, alerts bigint, expected bigint", [("A", 8, 60), ("B", 3, 3), ("C", 0, None), ("D", 9, 4)])
    words = {r.area: r.trend for r in risk.alert_trend(expected).collect()}
    assert words["A"].endswith("(8) sono state inferiori del -86.7% rispetto alle aspettative (60)")
    assert words["B"] == risk.ALERTS_EQUAL
    assert words["C"] is None
    assert "superiori del 125.0%" in words["D"]
    report = risk.territory_report(rows, risk.alert_trend(expected))
    assert len([1 for r in report.collect() if r.area == "C"]) == 1  # two unknowns are one row


def hit_case(make):
    disasters = make(
        "ts timestamp_ntz, lat decimal(9,6), lon decimal(9,6), kind string",
        [("2023-01-31 10:01:00", "10.388135", "43.720942", "Terremoto")],
    )
    touched = make("area string, disaster_ts timestamp_ntz", [("A", "2023-01-31 10:01:00")])
    buildings = make(
        "id bigint, area string, lat decimal(9,6), lon decimal(9,6)",
        [(1, "A", "10.236771", "44.069816"), (2, "B", 0, 0)],
    )
    return disaster.hit_buildings(disasters, touched, buildings)


def test_hit_buildings(make):
    assert values(hit_case(make), "building_id", "distance_km") == [(1, 42)]


def test_peak_motion(make):
    sensors = make(
        SENSOR,
        [sensor(5, "Accelerometro", 1), sensor(15, "Accelerometro", 1, floor=1), sensor(6, "Giroscopio", 1), sensor(35, "Accelerometro", 1, floor=3)],
    )
    start = dt.datetime(2023, 1, 31, 10, 0, 0)

    def series(i, peak, base):
        quiet = [(i, start + dt.timedelta(seconds=k), base, 0, 0) for k in range(1, 119)]
        edge = [(i, start, base, 0, 0), (i, start + dt.timedelta(seconds=120), peak, 0, 0)]
        outside = [(i, start + dt.timedelta(seconds=120, microseconds=1), 9, 0, 0)]
        return quiet + edge + outside

    rows = series(5, "1.2", 1) + series(15, "1.1", 1) + series(6, "0.08", "0.01") + series(35, 5, 1)
    got = disaster.peak_motion(make(READING, rows), sensors, hit_case(make)).first()
    assert got.pga == D("0.145000")  # mean of 0.2 and 0.9 x 0.1
    assert got.pgr == D("0.080000")


def test_intensity_and_damage(make):
    stats = make(
        "disaster_ts timestamp_ntz, building_id bigint, distance_km int, mercalli decimal(4,2)",
        [("2023-01-31 10:01:00", 1, 42, "6.12"), ("2023-01-31 10:01:00", 2, 0, None)],
    )
    centre = disaster.epicentre_intensity(stats)
    assert centre.first().intensity == D("7.01")
    assert disaster.felt_intensity(centre, 42).first().felt == D("6.12")
    rows = [(b, m) for b, m in enumerate(["4", "4.01", "6.12", "9.99", "10", None], start=1)]
    stats = make(
        "disaster_ts timestamp_ntz, building_id bigint, distance_km int, mercalli decimal(4,2)",
        [("2023-01-31 10:01:00", b, 0, m) for b, m in rows],
    )
    states = make("building_id bigint, as_of date, state int", [(b, "2023-01-30", 59) for b, _ in rows])
    worth = make("building_id bigint, value decimal(20,2)", [(b, "347853") for b, _ in rows])
    got = disaster.damage(stats, states, worth)
    assert values(got, "building_id", "share", "damage", "reason") == [
        (1, D("0.00"), 0, None),
        (2, D("0.03"), 10436, None),
        (3, D("0.27"), 93920, None),
        (4, D("1.38"), 480037, None),
        (5, D("1.00"), 347853, None),
        (6, None, None, "building not hit"),
    ]


def test_a_disaster_is_estimated_once(make):
    hits = hit_case(make)
    assert disaster.new_hits(hits, hits.filter("false")).count() == 1
    assert disaster.new_hits(hits, hits).count() == 0


def test_building_value(make):
    rows = make("building_id bigint, cost decimal(10,2)", [(1, "5.50"), (1, None), (2, None)])
    assert values(disaster.building_value(rows), "building_id", "value") == [(1, D("5.50")), (2, D("0.00"))]


@pytest.mark.parametrize("empty", ["measurements", "sensors"])
def test_no_motion_without_data(make, empty):
    sensors = make(SENSOR, [] if empty == "sensors" else [sensor(5, "Accelerometro", 1)])
    stats = disaster.hit_statistics(make(READING, []), sensors, hit_case(make))
    assert values(stats, "building_id", "mercalli") == [(1, None)]
