import random

import pytest

from conftest import values
from stonewatch.functions import grouped
from stonewatch.operators import rules
from test_geometry import OPENING
from test_sensors import READING, SENSOR, WALL, sensor

SEQ_WALL = WALL + ", seq bigint"


def reasons(df):
    return [r for _, r in values(df, "seq", "reason")]


def with_seq(rows):
    return [(*r, i) for i, r in enumerate(rows)]


APART = "no end in common with a wall of the floor"
AGAIN = "repeats a wall of the floor"


def test_walls(make):
    existing = make(WALL, [(1, 0, 1, 0, 0, 3, 0)])
    rows = [
        (2, 0, 1, 5, 5, 6, 6),
        (3, 0, 1, 6, 6, 7, 7),  # touches only a refused wall
        (4, 0, 1, 3, 0, 5, 5),
        (5, 0, 1, 6, 6, 5, 5),  # now connected
        (6, 0, 1, 3, 0, 0, 0),  # reversed repetition
        (7, 1, 1, 9, 9, 8, 8),  # first of its floor
        (8, 1, 1, 1, 1, 2, 2),
    ]
    got = rules.check_walls(existing, make(SEQ_WALL, with_seq(rows)))
    assert reasons(got) == [APART, APART, None, None, AGAIN, None, APART]


def test_long_chains_of_walls_take_few_rounds(make, monkeypatch):
    """500 walls in a row, away from the first: all refused, until one joins the row to the rest."""
    rows = [(0, 0, 1, 0, 0, 1, 0)] + [(i, 0, 1, 10 + i, 5, 11 + i, 5) for i in range(1, 501)]
    rows += [(501, 0, 1, 1, 0, 11, 5), (502, 0, 1, 12, 5, 12, 6), (503, 0, 1, 11, 5, 11, 6)]
    rows += [(504 + i, 0, 1, 11, 6 + i, 11, 7 + i) for i in range(300)]
    cuts = []
    whole = grouped.cut_lineage
    monkeypatch.setattr(grouped, "cut_lineage", lambda df: cuts.append(df) or whole(df))
    got = reasons(rules.check_walls(make(WALL, []), make(SEQ_WALL, with_seq(rows))))
    assert got == [None] + [APART] * 500 + [None, APART, None] + [None] * 300
    assert len(cuts) < 15


@pytest.mark.parametrize("seed", [1, 2])
def test_walls_equal_adding_one_by_one(make, seed):
    rng = random.Random(seed)

    def point():
        return (rng.randint(0, 3), rng.randint(0, 3))

    rows, want = [], []
    points, segments = {0: set(), 1: set()}, {0: set(), 1: set()}
    while len(rows) < 80:
        f, a, b = rng.randint(0, 1), point(), point()
        if a == b:
            continue
        rows.append((len(rows), f, 1, *a, *b))
        reason = None
        if points[f]:
            if not {a, b} & points[f]:
                reason = APART
            elif frozenset((a, b)) in segments[f]:
                reason = AGAIN
        want.append(reason)
        if reason is None:
            points[f] |= {a, b}
            segments[f].add(frozenset((a, b)))
    got = rules.check_walls(make(WALL, []), make(SEQ_WALL, with_seq(rows)))
    assert reasons(got) == want
    assert APART in want and AGAIN in want


def test_faces(make):
    walls = make("id bigint, building_id bigint, floor int", [(1, 1, 0), (2, 1, 1), (3, 2, 0)])
    rooms = make("id bigint, building_id bigint, floor int", [(1, 1, 0), (2, 1, 0), (3, 1, 0)])
    existing = make("room_id bigint, wall_id bigint", [(1, 1)])
    rows = [(1, 3), (1, 2), (2, 1), (3, 1)]
    got = rules.check_faces(existing, make("room_id bigint, wall_id bigint, seq bigint", with_seq(rows)), walls, rooms)
    assert reasons(got) == [
        "wall and room in different buildings", "wall and room on different floors", None, "wall already has two faces",
    ]


def test_openings(make):
    walls = make(WALL, [(1, 0, 1, 0, 0, 8, 0)])
    existing = make(OPENING, [(1, 0, 1, 1, 0, 2, 0, "x")])
    rows = [(2, 0, 1, 2, 0, 1, 0, "x"), (3, 0, 1, 3, 1, 4, 1, "x"), (4, 0, 1, 3, 0, 4, 0, "x"), (5, 0, 1, 4, 0, 3, 0, "x")]
    got = rules.check_openings(existing, make(OPENING + ", seq bigint", with_seq(rows)), walls)
    assert reasons(got) == ["repeats an opening", "not within a wall", None, "repeats an opening"]


def test_material_class(make):
    one = "material_id bigint"
    rows = [(1, "tile"), (2, "brick"), (2, "tile"), (3, "tile"), (3, "brick"), (1, "brick")]
    got = rules.check_material_class(make(one, [(1,)]), make(one, []), make(one + ", class string, seq bigint", with_seq(rows)))
    assert reasons(got) == ["already a brick", None, "already a brick", None, "already a tile", None]


def test_projects(make):
    ddl = "building_id bigint, cost decimal(10,2)"
    rows = [(1, 5), (1, None), (1, 5), (1, None), (2, 5), (3, None)]
    got = rules.check_projects(make(ddl, [(2, None), (3, 7)]), make(ddl + ", seq bigint", with_seq(rows)))
    busy = "another project still open for the building"
    assert reasons(got) == [None, None, busy, busy, busy, None]


def test_stages(make):
    ddl = "project_id bigint, started date, ended date"
    existing = make(ddl, [(1, "2020-01-01", "2020-02-01"), (2, "2020-01-01", None)])
    projects = make("id bigint, approved date", [(1, "2020-01-01"), (2, "2020-01-01"), (3, None), (4, "2020-03-01")])
    rows = [
        (1, "2020-01-31", None),  # the existing one ends a day later
        (1, "2020-02-01", "2020-03-01"),
        (1, "2020-02-15", None),
        (1, "2020-03-01", None),
        (1, "2021-03-01", None),
        (2, "2021-01-01", None),
        (3, "2021-01-01", None),
        (4, "2020-02-29", "2020-03-05"),
        (4, "2020-03-01", None),
        (9, "2020-03-01", None),
    ]
    got = rules.check_stages(existing, make(ddl + ", seq bigint", with_seq(rows)), projects)
    busy = "overlaps another stage"
    assert reasons(got) == [
        busy, None, busy, None, busy, busy, "project not approved", "starts before the approval", None,
        "project not approved",
    ]


def test_closings(make):
    jobs = make("stage_id bigint, done boolean", [(1, True), (1, False), (2, True)])
    closings = make("id bigint, ended date", [(1, "2020-01-01"), (2, "2020-01-01"), (3, "2020-01-01"), (1, None)])
    got = values(rules.check_closings(closings, jobs), "id", "ended", "reason")
    assert [r for _, _, r in got] == ["jobs of the stage not done", None, None, None]


def test_interventions(make):
    jobs = make("id bigint, stage_id bigint", [(i, 1) for i in range(1, 7)])
    stages, projects = make("id bigint, project_id bigint", [(1, 1)]), make("id bigint, building_id bigint", [(1, 1)])
    walls = make("id bigint, building_id bigint", [(1, 1), (2, 2)])
    rooms = make("id bigint, building_id bigint", [(1, 1), (2, 2)])
    targets = rules.all_job_targets(
        make("job_id bigint, wall_id bigint", [(6, 1)]),
        make("job_id bigint, room_id bigint", []),
        make("job_id bigint, room_id bigint, wall_id bigint", []),
    )
    ddl = "job_id bigint, target string, wall_id bigint, room_id bigint, seq bigint"
    rows = [(1, "wall", 1, None), (1, "room", None, 1), (2, "room", None, 2), (2, "face", 1, 1), (3, "face", 2, 1), (6, "room", None, 1)]
    got = rules.check_interventions(targets, make(ddl, with_seq(rows)), jobs, stages, projects, walls, rooms)
    twice, away = "job already has an intervention", "not in the building of the project"
    assert reasons(got) == [None, twice, away, None, away, twice]


def test_managers(make):
    people = make("id string, active boolean", [("A", True), ("B", False)])
    rows = make("project_id bigint, person_id string, seq bigint", [(1, "A", 0), (1, "B", 1), (1, "Z", 2)])
    assert reasons(rules.check_managers(rows, people)) == [None, "manager not active", None]


def test_contributions(make):
    shifts = make(
        "id bigint, stage_id bigint, start timestamp_ntz, end timestamp_ntz",
        [(1, 1, "2020-12-02 10:00:00", "2020-12-02 18:00:00"), (2, 1, "2020-12-02 13:00:00", "2020-12-02 15:00:00"),
         (3, 2, "2020-12-02 10:00:00", "2020-12-02 12:00:00")],
    )
    jobs = make("id bigint, stage_id bigint, done boolean", [(1, 1, False), (2, 1, True), (3, 1, False)])
    ddl = "job_id bigint, shift_id bigint, hours decimal(2,1)"
    existing = make(ddl, [(1, 1, 3)])
    rows = [(1, 1, "4.9"), (3, 1, "0.2"), (3, 1, "0.1"), (2, 2, 1), (1, 3, 1), (1, 2, "2.0"), (3, 2, "0.1"), (1, 99, "9.0")]
    got = rules.check_contributions(existing, make(ddl + ", seq bigint", with_seq(rows)), jobs, shifts)
    over = "more hours than the shift has"
    assert reasons(got) == [
        None, over, None, "job already done", "job and shift in different stages", None, over, None,
    ]


def test_threshold_changes(make):
    old = make(SENSOR, [sensor(1, "Termometro", 40), sensor(2, "Termometro", 40), sensor(3, "Termometro", 40)])
    new = make(SENSOR, [sensor(1, "Termometro", 41), sensor(2, "Termometro", 41), sensor(3, "Termometro", 40)])
    readings = make(READING, [(1, "2023-01-01 00:00:00", 1, None, None), (3, "2023-01-01 00:00:00", 1, None, None)])
    got = rules.check_threshold_changes(old, new, readings)
    assert values(got, "id", "reason") == [(1, "sensor has readings"), (2, None), (3, None)]


def test_sensors(make):
    existing = make(SENSOR, [sensor(1, "Termometro", 40, 1, 1)])
    rows = [sensor(2, "Termometro", 40, 1, 1), sensor(3, "Igrometro", 40, 1, 1), sensor(4, "Igrometro", 40, 1, 1), sensor(5, "Termometro", 40, 1, 1, floor=1)]
    got = rules.check_sensors(existing, make(SENSOR + ", seq bigint", with_seq(rows)))
    taken = "a sensor of this kind is at this point"
    assert reasons(got) == [taken, None, taken, None]
