import random
from decimal import Decimal as D

from conftest import values
from stonewatch.operators import geometry as op
from stonewatch.operators import rendering
from test_sensors import SENSOR, WALL, sensor

FACE = "room_id bigint, wall_id bigint"
OPENING = "id bigint, floor smallint, building_id bigint, x1 decimal(5,2), y1 decimal(5,2), x2 decimal(5,2), y2 decimal(5,2), kind string"


def ring(points, start=1, floor=0, building=1):
    ends = zip(points, points[1:] + points[:1])
    return [(start + i, floor, building, *a, *b) for i, (a, b) in enumerate(ends)]


def area(make, walls, two_faced=()):
    faces = [(1, w[0]) for w in walls] + [(2, i) for i in two_faced]
    return values(op.floor_area(make(WALL, walls), make(FACE, faces)), "building_id", "floor", "area", "reason")


SQUARE = [(0, 0), (8, 0), (8, 8), (0, 8)]
CONCAVE = [(0, 0), (4, 0), (4, 3), (2, 1), (0, 3)]


def test_areas_of_outlines(make):
    walls = ring(SQUARE) + ring(CONCAVE, 20, building=2)
    assert area(make, walls) == [(1, 0, D("64.00"), None), (2, 0, D("8.00"), None)]


def test_order_and_direction_do_not_matter(make):
    walls = ring(CONCAVE)
    random.Random(1).shuffle(walls)
    turned = [(i, f, b, x2, y2, x1, y1) if i % 2 else (i, f, b, x1, y1, x2, y2) for i, f, b, x1, y1, x2, y2 in walls]
    assert area(make, turned) == [(1, 0, D("8.00"), None)]


def test_inner_walls_courtyards_and_two_outlines(make):
    inner = [(90, 0, 1, 0, 4, 8, 4)]
    assert area(make, ring(SQUARE) + inner, two_faced=[90]) == [(1, 0, D("64.00"), None)]
    yard = ring([(2, 2), (4, 2), (4, 4), (2, 4)], 50)
    assert area(make, ring(SQUARE) + yard) == [(1, 0, D("60.00"), None)]
    apart = ring([(20, 0), (21, 0), (21, 1), (20, 1)], 50)
    assert area(make, ring(SQUARE) + apart) == [(1, 0, D("65.00"), None)]


def test_open_outline_has_a_reason(make):
    walls = ring(SQUARE)[:-1] + ring(SQUARE, 30, floor=1)
    assert area(make, walls) == [(1, 0, None, "open outline"), (1, 1, D("64.00"), None)]
    faces = make(FACE, [(1, w[0]) for w in walls])
    whole = op.building_area(op.floor_area(make(WALL, walls), faces))
    assert values(whole, "area", "reason") == [(None, "open outline")]


def test_openings_lie_on_their_wall(make):
    walls = make(WALL, [(1, 0, 1, 0, 0, 4, 4), (2, 0, 1, 0, 0, 8, 0), (3, 1, 1, 0, 0, 9, 9)])
    rows = [
        (1, 0, 1, 1, 1, 3, 3, "x"),  # on the oblique wall
        (2, 0, 1, 1, 1, 3, "3.01", "x"),  # in its box, off its line
        (3, 0, 1, 3, 0, 1, 0, "x"),
        (4, 0, 1, 7, 0, 9, 0, "x"),  # sticks out
        (5, 1, 1, 5, 5, 6, 6, "x"),
        (6, 0, 1, 5, 5, 6, 6, "x"),  # other floor
        (7, 0, 1, "2.5", "2.5", "2.5", "2.5", "x"),
    ]
    got = op.containing_wall(make(OPENING, rows), walls)
    assert values(got, "opening_id", "wall_id") == [(1, 1), (2, None), (3, 2), (4, None), (5, 3), (6, None), (7, 1)]


def test_duplicates_and_shared_vertices(make):
    walls = make(WALL, [(1, 0, 1, 0, 0, 3, 0), (2, 0, 1, 3, 0, 0, 0), (3, 0, 1, 3, 0, 3, 3), (4, 1, 1, 0, 0, 3, 0), (5, 0, 1, 7, 7, 8, 8)])
    assert values(op.duplicate_segments(walls), "id", "duplicate_of") == [(2, 1)]
    assert values(op.shared_vertices(walls), "id", "shares_vertex") == [(1, True), (2, True), (3, True), (4, False), (5, False)]


def test_floor_plan_text(make):
    walls = make(WALL, [(2, 0, 1, 8, 0, 8, 3), (1, 0, 1, 0, 0, 3, 0)])
    openings = make(OPENING, [(1, 0, 1, 1, 0, 2, 0, "Finestra"), (2, 0, 1, 8, 1, 8, 2, "Porta"), (3, 0, 1, 8, 2, 8, "2.5", "Vuoto")])
    sensors = make(SENSOR, [sensor(1, "Termometro", 40, 0, "3.5"), sensor(2, "Termometro", 40, floor=4)])
    scale = rendering.plan_scale(walls).first()
    assert (scale.scale, scale.width, scale.height) == (75, 610, 235)
    (page,) = rendering.floor_plans(walls, openings, sensors).collect()
    lines = page.html.split("\r")
    assert lines[0].startswith("<!DOCTYPE html>\n<html>\n<body>\n<head>\n    <style>\n    p {\n        font-family:'Segoe UI';")
    assert lines[0].endswith("<p>Edificio: 1 | Piano: 0</p>")
    assert lines[1] == '<svg style="padding:5px; margin:5px; transform:scaleY(-1)" width="610" height="235">'
    assert lines[2] == '<line x1="5.00" y1="5.00" x2="230.00" y2="5.00" stroke="black" stroke-width="3px"/>'
    assert [line.split('stroke="')[1][:7] for line in lines[4:7]] == ["#2ab2c7", "#2ac776", "#c77e2a"]
    assert lines[7] == '<circle cx="5.00" cy="267.50" r="5" fill="#ff2b20"/>\n</svg>\n</div>\n</body>\n</html>'
    assert len(lines) == 8
