import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import values
from stonewatch.operators import maintenance, quality
from stonewatch.operators.sensors import alerts
from stonewatch.sources import tables as store
from stonewatch.sources.schema import TABLES
from stonewatch.streaming import alerts as streaming
from test_sensors import READING, SENSOR, sensor


def test_declared_tables():
    assert len(TABLES) == 29
    for name, spec in TABLES.items():
        assert set(spec.key) <= set(spec.columns), name
        for columns, parent, targets in spec.refs:
            assert parent in TABLES and set(targets) <= set(TABLES[parent].columns)
            assert set(columns) <= set(spec.columns)


def loose(make, name, rows):
    """Rows of a table, every column nullable."""
    ddl = ", ".join(f"`{n}` {t.rstrip('?')}" for n, t in TABLES[name].columns.items())
    return make(ddl, rows)


def test_audit_finds_one_of_each(make):
    tables = {
        "area": loose(make, "area", [("A",), ("A",), (None,)]),
        "building": loose(make, "building", [(1, "A", 91, 0, "x"), (2, "Z", 0, -181, "y"), (3, "A", 0, 0, "k" * 101)]),
        "floor": loose(make, "floor", [(0, 1), (1, 7)]),
        "sensor": loose(
            make, "sensor",
            [(1, 0, 1, "Barometro", 1, 1, 1, 1, 1), (2, 5, 1, "Termometro", -1, 1, 1, 1, 2), (3, 0, 1, "Termometro", 1, 1, 1, 1, 1)],
        ),
        "lot": loose(make, "lot", [(1, 1, "s", "b", "2023-01-01", 1, 5, 6), (2, 1, "s", "b", "2023-01-01", 1, 5, 5)]),
        "stage": loose(make, "stage", [(1, 1, "d", "2020-02-01", "2020-01-01", "2020-01-15"), (2, 1, "d", "2020-02-01", "2020-03-01", None)]),
    }
    got = values(quality.audit(tables), "table", "rule", "key", "reason")
    assert got == sorted(
        [
            ("area", "missing", "NULL", "postcode missing"),
            ("area", "key", "A", "2 rows with this key"),
            ("building", "value", "1", "latitude in range"),
            ("building", "value", "2", "longitude in range"),
            ("building", "length", "3", "kind too long"),
            ("building", "reference", "2", "no such area"),
            ("floor", "reference", "1|7", "no such building"),
            ("sensor", "value", "1", "kind known"),
            ("sensor", "value", "2", "threshold not negative"),
            ("sensor", "value", "2", "importance in range"),
            ("sensor", "reference", "2", "no such floor"),
            ("lot", "unchecked", "material_id", "material not given"),
            ("lot", "value", "1", "available within units"),
            ("stage", "unchecked", "project_id", "project not given"),
            ("stage", "value", "1", "planned end after start"),
            ("stage", "value", "1", "end after start"),
        ]
    )


def test_candidate_rows(make):
    old = loose(make, "area", [("A",)])
    buildings = loose(make, "building", [(1, "A", 0, 0, "x")])
    rows = loose(make, "building", [(1, "A", 0, 0, "x"), (2, "B", 0, 0, "x"), (3, "A", 95, 0, "x"), (4, None, 0, 0, "x"), (5, "A", 0, 0, "x")])
    rows = rows.withColumn("seq", F.col("id")).unionByName(rows.filter("id >= 3").withColumn("seq", F.col("id") + 10).withColumn("lat", F.lit(0).cast("decimal(9,6)")))
    got = quality.check_rows("building", buildings, rows, {"area": old})
    assert values(got, "seq", "reason") == [
        (1, "key exists"), (2, "no such area"), (3, "latitude in range"), (4, "area missing"), (5, None),
        (13, None), (14, "area missing"), (15, "key exists"),
    ]


def test_type_rules(make):
    df = make("id string, x1 string", [("1", "999.99"), ("2", "1000"), ("3", "abc"), ("4", None)])
    named = {k: v for k, v in quality.type_rules(TABLES["wall"]).items() if k.startswith("x1")}
    got = quality.row_rules(df, "wall", ["id"], {"type": named})
    assert values(got, "key") == [("2",), ("3",)]


def test_updates_and_seniority(make):
    people = make("id string, active boolean, seniority int", [("A", True, 1), ("B", False, 1), ("C", True, None)])
    assert values(maintenance.add_year_of_seniority(people), "id", "seniority") == [("A", 2), ("B", 1), ("C", None)]
    changed = make("id string, seniority int", [("A", 9), ("B", None)])
    got = maintenance.update_columns(people, changed, ["id"], ["seniority"])
    assert values(got, "id", "seniority") == [("A", 9), ("B", None), ("C", None)]


def test_retention_takes_alerts_along(make):
    readings = make(READING, [(1, "2023-01-09 23:59:59", 1, None, None), (1, "2023-01-10 00:00:00", 1, None, None)])
    kept, left = maintenance.retention(readings, readings.select("sensor_id", "ts"), "2023-02-10")
    assert kept.count() == left.count() == 1
    assert left.first().ts == dt.datetime(2023, 1, 10)


def test_reload_append_and_read_back(spark, make, tmp_path):
    root = str(tmp_path)
    rows = make(READING, [(1, "2023-01-01 10:00:00", 1, None, None), (1, "2023-01-02 10:00:00", 2, 3, 4)])
    store.reload_all({"measurement": rows}, root)
    assert store.read_table(spark, root, "building").count() == 0
    more = make(READING, [(1, "2023-01-02 10:00:00", 9, None, None), (1, "2023-01-03 10:00:00", 3, None, None), (1, "2023-01-03 10:00:00", 3, None, None)])
    store.append_measurements(spark, root, more)
    back = store.read_table(spark, root, "measurement")
    assert [x for _, x in values(back, "ts", "x")] == [1, 2, 3]
    plan = back.filter("day = DATE'2023-01-02'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    store.reload_all({"measurement": rows.limit(0)}, root)
    assert store.read_table(spark, root, "measurement").count() == 0


def test_csv_with_declared_types(spark, tmp_path):
    path = tmp_path / "walls.csv"
    path.write_text("id,floor,building_id,x1,y1,x2,y2\n1,0,1,0.00,0.00,3.50,0.00\n")
    (row,) = store.read_csv(spark, str(path), "wall").collect()
    assert str(row.x2) == "3.50"
    path.write_text("id,floor,building_id,x1,y1,x2,y2\n1,0,1,zero,0.00,3.50,0.00\n")
    with pytest.raises(Exception):
        store.read_csv(spark, str(path), "wall").collect()


def test_hit_statistics_table(spark, make, tmp_path):
    ddl = "disaster_ts timestamp_ntz, building_id bigint, distance_km int, mercalli decimal(4,2)"
    for day in ("2023-01-31 10:01:00", "2023-02-01 10:01:00"):
        store.append_hit_statistics(make(ddl, [(day, 1, 42, "6.12")]), str(tmp_path))
    got = store.read_hit_statistics(spark, str(tmp_path))
    assert values(got, "disaster_ts", "building_id") == [
        (dt.datetime(2023, 1, 31, 10, 1), 1), (dt.datetime(2023, 2, 1, 10, 1), 1),
    ]


def test_plans_are_written_as_rows(spark, make, tmp_path):
    path = str(tmp_path / "p")
    store.write_plans(make("building_id bigint, floor int, html string", [(1, 0, "a\nb"), (1, 1, "c")]), path)
    assert values(store.read_plans(spark, path), "building_id", "floor", "html") == [(1, 0, "a\nb"), (1, 1, "c")]


LOT = "id bigint, material_id bigint, supplier string, batch string, purchased date, unit_price decimal(10,2), units int, available int"
PERSON = "id string, born date, phone string, first_name string, last_name string, active boolean, seniority smallint"


def test_a_table_is_replaced_by_rows_made_of_it(spark, make, tmp_path):
    root = str(tmp_path)
    staff = [(f"W{i}", "1990-01-01", "1", "a", "b", i % 2 == 0, i) for i in range(40)]
    store.write_table(make(PERSON, staff), root, "person")
    for _ in range(3):
        store.write_table(maintenance.add_year_of_seniority(store.read_table(spark, root, "person")), root, "person")
    got = store.read_table(spark, root, "person")
    assert values(got, "id", "seniority") == sorted((f"W{i}", i + 3 * (i % 2 == 0)) for i in range(40))
    lots = [(i, 1, "s", "b", "2023-01-01", 1, 10, 10) for i in range(30)]
    store.write_table(make(LOT, lots), root, "lot")
    new = make("id bigint, available int", [(3, 4), (5, None)])
    store.write_table(maintenance.update_columns(store.read_table(spark, root, "lot"), new, ["id"], ["available"]), root, "lot")
    got = dict(values(store.read_table(spark, root, "lot"), "id", "available"))
    assert len(got) == 30 and got[3] == 4 and got[5] is None and got[4] == 10


def test_a_failed_write_leaves_the_table(spark, make, tmp_path):
    root = str(tmp_path)
    lots = [(i, 1, "s", "b", "2023-01-01", 1, 10, 10) for i in range(30)]
    store.write_table(make(LOT, lots), root, "lot")
    broken = store.read_table(spark, root, "lot").withColumn("units", F.expr("if(id = 29, raise_error('no'), units)"))
    with pytest.raises(Exception, match="no"):
        store.write_table(broken, root, "lot")
    assert store.read_table(spark, root, "lot").count() == 30
    assert [p.name for p in tmp_path.iterdir()] == ["lot"]


def test_retention_drops_days_as_folders(spark, make, tmp_path):
    root = str(tmp_path)
    rows = [(1, f"2023-01-{d:02d} 23:59:59", 1, None, None) for d in range(1, 21)]
    store.write_table(make(READING, rows), root, "measurement")
    assert len(store.drop_days_before(spark, root, "measurement", dt.date(2023, 1, 10))) == 9
    assert store.read_table(spark, root, "measurement").count() == 11
    assert store.drop_days_before(spark, root, "alert", dt.date(2023, 1, 10)) == []
    kept = maintenance.keep_recent(store.read_table(spark, root, "measurement"), "2023-02-15")
    plan = kept._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and kept.count() == 6


def test_alerts_of_readings_in_any_order(spark, make, tmp_path):
    sensors = make(SENSOR, [sensor(1, "Termometro", 40)])
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    times = ["2023-03-05 10:00:00", "2023-03-09 10:00:00", "2023-03-01 10:00:00", "2023-03-05 10:00:00"]
    for at in times:
        make(READING, [(1, at, 41, None, None), (1, at, 41, None, None)]).coalesce(1).write.mode("append").parquet(source)
    stream = streaming.stream_alerts(streaming.read_stream(spark, source, maxFilesPerTrigger=1), sensors)
    streaming.start_alerts(stream, out, state, available_now=True).awaitTermination()
    got = values(streaming.read_alerts(spark, out), "ts")
    assert [str(t) for (t,) in got] == sorted(set(times))


def test_streamed_alerts_equal_batch(spark, make, tmp_path):
    sensors = make(SENSOR, [sensor(1, "Termometro", 40), sensor(2, "Giroscopio", "0.5")])
    first = make(READING, [(1, "2023-01-01 10:00:00", 40, None, None), (1, "2023-01-01 10:10:00", 1, None, None), (2, "2023-01-01 10:00:00", 1, 1, 1)])
    second = make(READING, [(1, "2023-01-01 10:00:00", 40, None, None), (1, "2023-01-01 10:30:00", 41, None, None), (2, "2023-01-01 10:30:00", 1, None, 1)])
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        stream = streaming.stream_alerts(streaming.read_stream(spark, source), sensors)
        streaming.start_alerts(stream, out, state, available_now=True).awaitTermination()

    first.write.parquet(source)
    run()
    second.write.mode("append").parquet(source)
    run()  # goes on where it stopped
    want = alerts(first.unionByName(second), sensors).distinct()
    assert values(streaming.read_alerts(spark, out), "sensor_id", "ts") == values(want, "sensor_id", "ts")
    assert want.count() == 3


def area_tables(make, postcodes, risks):
    return {"area": loose(make, "area", [(p,) for p in postcodes]), "risk": loose(make, "risk", risks)}


def stored(spark, root, name):
    return sorted(tuple(r) for r in store.read_table(spark, root, name).collect())


def test_a_reload_with_violations_changes_nothing(spark, make, tmp_path):
    root = str(tmp_path / "root")
    good = area_tables(make, ["1", "2"], [("1", "Sismico", "2020-01-01", 2)])
    assert store.reload_gated(good, root).isEmpty()
    before = stored(spark, root, "risk")
    assert before == [("1", "Sismico", dt.date(2020, 1, 1), 2)] and store.read_table(spark, root, "wall").isEmpty()
    bad = area_tables(make, ["1", "1"], [("9", "Sismico", "2020-01-01", 7), (None, "Sismico", "2020-01-01", 2)])
    rules = sorted((r.table, r.rule) for r in store.reload_gated(bad, root).collect())
    assert rules == [("area", "key"), ("risk", "missing"), ("risk", "reference"), ("risk", "value")]
    failing = dict(good, risk=good["risk"].withColumn("coefficient", F.raise_error(F.lit("lost")).cast("smallint")))
    with pytest.raises(Exception, match="lost"):
        store.reload_gated(failing, root)
    assert stored(spark, root, "risk") == before and stored(spark, root, "area") == [("1",), ("2",)]
    assert not [p for p in (tmp_path / "root").iterdir() if p.name.startswith(".")]


def test_an_interrupted_exchange_goes_on(spark, make, tmp_path):
    root, folder = str(tmp_path), tmp_path / ".reload-x"
    store.write_table(loose(make, "area", [("old",)]), root, "area")
    store.write_table(loose(make, "risk", [("old", "Sismico", "2020-01-01", 1)]), root, "risk")
    # the new area is in place already, the old risk is set aside, the new one still waits
    store.write_table(loose(make, "area", [("new",)]), root, "area")
    store.write_table(loose(make, "risk", [("new", "Sismico", "2020-01-01", 1)]), str(folder), "risk")
    (tmp_path / "risk").rename(folder / "_old-risk")
    (folder / store.READY).touch()
    unaudited = tmp_path / ".reload-y" / "area"
    store.write_table(loose(make, "area", [("never",)]), str(unaudited.parent), "area")
    store.recover(spark, root)
    assert stored(spark, root, "area") == [("new",)] and stored(spark, root, "risk")[0][0] == "new"
    (tmp_path / "area").rename(tmp_path / ".area-old-123")
    store.recover(spark, root)
    assert stored(spark, root, "area") == [("new",)]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["area", "risk"]


def test_bad_lines_are_kept_aside(spark, tmp_path):
    path = tmp_path / "risk.csv"
    lines = ["1,Sismico,2020-01-01,2", "1,Sismico,someday,2", "2,Sismico,2020-01-02,x", ",Sismico,2020-01-03,1", "3,Sismico,2020-01-04", "4,Sismico,2020-01-05,70000", "5,Sismico,2020-01-06,3"]
    path.write_text("area,kind,measured,coefficient\n" + "\n".join(lines) + "\n")
    good, bad = store.read_csv_quarantined(spark, str(path), "risk")
    assert sorted(r.area for r in good.collect()) == ["1", "5"]
    unread = "not readable as declared"
    assert sorted(tuple(r) for r in bad.collect()) == sorted(
        [(lines[1], unread), (lines[2], unread), (lines[3], "area missing"), (lines[4], unread), (lines[5], unread)]
    )


def test_a_late_reading_opens_its_own_day_only(spark, make, tmp_path):
    root = str(tmp_path)
    days = [f"2020-01-{d:02d} 10:00:00" for d in range(1, 21)]
    store.append_measurements(spark, root, make(READING, [(1, t, 1, None, None) for t in days]))
    late = make(READING, [(1, "2020-01-02 10:00:00", 5, None, None), (1, "2020-01-19 11:00:00", 5, None, None)])
    known = store.of_days(store.read_table(spark, root, "measurement"), late.withColumn("day", F.to_date("ts")))
    assert {r[0].split("day=")[1][:10] for r in known.select(F.input_file_name()).collect()} == {"2020-01-02", "2020-01-19"}
    assert "PartitionFilters: [day" in known._jdf.queryExecution().toString()
    store.append_measurements(spark, root, late)
    kept = stored(spark, root, "measurement")
    assert len(kept) == 21 and sorted(float(r[2]) for r in kept) == [1.0] * 20 + [5.0]
    store.append_measurements(spark, root, late.limit(0))
    assert len(stored(spark, root, "measurement")) == 21


def test_health_from_parts_of_days(spark, make, tmp_path):
    """Readings come in three batches, the last with late ones; health equals that of all readings."""
    import random

    from stonewatch.operators import sensors as op

    rng, root = random.Random(4), str(tmp_path)
    kinds = ["Termometro", "Fessurimetro", "Accelerometro", "Giroscopio"]
    side = make(SENSOR, [sensor(i, kind, threshold=2) for i, kind in enumerate(kinds, 1)])
    rows = []
    for i in range(2400):
        at = dt.datetime(2023, 1, 1) + dt.timedelta(minutes=19 * i) if i % 40 else dt.datetime(2023, 1, 1 + i // 40 % 28)
        rows.append((1 + i % 4, at, *(round(rng.uniform(0.5, 3), 3) for _ in range(3))))
    rows = list({r[:2]: r for r in rows}.values())
    for batch in (rows[:1500], rows[1500:2000], rows[2000:] + rows[700:800]):
        store.append_with_parts(spark, root, make(READING, batch), side)
    everything = store.read_table(spark, root, "measurement")
    assert everything.count() == len(rows)
    for day in ("2023-02-01", "2023-01-20", "2023-03-15"):
        want = values(op.health_table(everything, side, day), "sensor_id", "health_now", "health_before")
        got = store.stored_health(spark, root, side, day)
        assert values(got, "sensor_id", "health_now", "health_before") == want
    assert any(w[1] is not None for w in want) or want
    store.rebuild_parts(spark, root, side)
    again = store.stored_health(spark, root, side, "2023-02-01")
    assert values(again, "sensor_id", "health_now") == values(op.health_table(everything, side, "2023-02-01"), "sensor_id", "health_now")


@pytest.mark.parametrize("kinds", [["Termometro", "Fessurimetro"], ["Accelerometro", "Giroscopio"], []])
def test_health_from_parts_without_readings_of_a_kind(spark, make, tmp_path, kinds):
    """Only some kinds of sensor have readings, or none has: health equals that of all readings."""
    from stonewatch.operators import sensors as op

    root, every = str(tmp_path), ["Termometro", "Fessurimetro", "Accelerometro", "Giroscopio"]
    side = make(SENSOR, [sensor(i, kind, threshold=2) for i, kind in enumerate(every, 1)])
    rows = [
        (1 + every.index(kind), dt.datetime(2023, 1, 1) + dt.timedelta(hours=h), 1 + h % 7, 2, 3)
        for kind in kinds
        for h in range(24 * 31)
    ]
    store.append_with_parts(spark, root, make(READING, rows), side)
    everything = store.read_table(spark, root, "measurement")
    want = values(op.health_table(everything, side, "2023-02-01"), "sensor_id", "health_now", "health_before")
    got = store.stored_health(spark, root, side, "2023-02-01")
    assert values(got, "sensor_id", "health_now", "health_before") == want
    assert len({w[0] for w in want if w[1] is not None}) == len(kinds)
