"""Registered queries of floor geometry and plans."""

from pyspark.sql import functions as F

from stonewatch.operators import geometry, rendering
from stonewatch.plans.registry import Roles, query
from stonewatch.plans.sqltext import quoted

OUTER_SQL = "SELECT * FROM wall WHERE id IN (SELECT wall_id FROM wall_face GROUP BY 1 HAVING COUNT(*) = 1)"
ENDS_SQL = "SELECT id, building_id, floor, x1 AS x, y1 AS y FROM {w} UNION ALL SELECT id, building_id, floor, x2, y2 FROM {w}"
AREA_CTES = {
    "outer_wall": OUTER_SQL,
    "ends": ENDS_SQL.format(w="outer_wall"),
    "leaky": "SELECT DISTINCT building_id, floor FROM (SELECT building_id, floor FROM ends GROUP BY building_id, floor, x, y"
    " HAVING COUNT(*) % 2 = 1)",
    "slab": "SELECT building_id, floor, x AS l, lead(x) OVER (PARTITION BY building_id, floor ORDER BY x) AS r FROM (SELECT"
    " DISTINCT building_id, floor, x FROM ends)",
    "cross_y": "SELECT s.building_id, s.floor, s.l, s.r, CAST(y1 AS DOUBLE) + CAST(y2 - y1 AS DOUBLE) * ((CAST(l AS DOUBLE) +"
    " CAST(r AS DOUBLE)) / 2 - CAST(x1 AS DOUBLE)) / CAST(x2 - x1 AS DOUBLE) AS y, w.id FROM slab s JOIN outer_wall w ON"
    " w.building_id = s.building_id AND w.floor = s.floor AND least(x1, x2) <= l AND greatest(x1, x2) >= r",
    "area": "SELECT f.building_id, f.floor, CASE WHEN k.floor IS NULL THEN coalesce(a.area, 0) END AS area, CASE WHEN k.floor"
    " IS NOT NULL THEN 'open outline' END AS reason FROM (SELECT DISTINCT building_id, floor FROM ends) f LEFT JOIN (SELECT"
    " building_id, floor, CAST(SUM(CAST(r - l AS DOUBLE) * y * CASE WHEN rn % 2 = 0 THEN 1 ELSE -1 END) AS DECIMAL(12,2)) AS"
    " area FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY building_id, floor, l ORDER BY y, id) AS rn FROM cross_y) GROUP BY"
    " 1, 2) a ON a.building_id = f.building_id AND a.floor = f.floor LEFT JOIN leaky k ON k.building_id = f.building_id AND"
    " k.floor = f.floor",
}


@query("external_walls", "id:l building_id:l floor:l", "wall wall_face", OUTER_SQL)
def external_walls(r: Roles):
    return geometry.external_walls(r.wall, r.wall_face)


@query(
    "floor_area",
    "building_id:l floor:l area:d reason:s",
    "wall wall_face",
    "SELECT * FROM area",
    **AREA_CTES,
)
def floor_area(r: Roles):
    return geometry.floor_area(r.wall, r.wall_face)


@query(
    "building_area",
    "building_id:l area:d reason:s",
    "wall wall_face",
    "SELECT building_id, CASE WHEN COUNT(reason) = 0 THEN SUM(area) END AS area, MAX(reason) AS reason FROM area GROUP BY 1",
    **AREA_CTES,
)
def building_area(r: Roles):
    return geometry.building_area(geometry.floor_area(r.wall, r.wall_face))


CONTAINED_SQL = (
    "SELECT o.id AS opening_id, o.building_id, o.floor, MIN(w.id) AS wall_id FROM opening o LEFT JOIN wall w ON w.building_id ="
    " o.building_id AND w.floor = o.floor AND least(o.x1, o.x2) >= least(w.x1, w.x2) AND greatest(o.x1, o.x2) <="
    " greatest(w.x1, w.x2) AND least(o.y1, o.y2) >= least(w.y1, w.y2) AND greatest(o.y1, o.y2) <= greatest(w.y1, w.y2) AND"
    " (w.x2 - w.x1) * (o.y1 - w.y1) = (w.y2 - w.y1) * (o.x1 - w.x1) AND (w.x2 - w.x1) * (o.y2 - w.y1) = (w.y2 - w.y1) *"
    " (o.x2 - w.x1) GROUP BY 1, 2, 3"
)


@query("opening_containment", "opening_id:l building_id:l floor:l wall_id:l", "opening wall", CONTAINED_SQL)
def opening_containment(r: Roles):
    return geometry.containing_wall(r.opening, r.wall)


@query(
    "duplicate_segments",
    "id:l building_id:l floor:l duplicate_of:l",
    "crowded_wall",
    "SELECT b.id, b.building_id, b.floor, MIN(a.id) AS duplicate_of FROM crowded_wall a JOIN crowded_wall b ON a.building_id ="
    " b.building_id AND a.floor = b.floor AND a.id < b.id AND ((a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2) OR"
    " (a.x1 = b.x2 AND a.y1 = b.y2 AND a.x2 = b.x1 AND a.y2 = b.y1)) GROUP BY 1, 2, 3",
)
def duplicate_segments(r: Roles):
    return geometry.duplicate_segments(r.crowded_wall)


@query(
    "shared_vertices",
    "id:l building_id:l floor:l shares_vertex:b",
    "wall",
    "SELECT w.id, w.building_id, w.floor, EXISTS (SELECT 1 FROM ends a JOIN ends b ON a.building_id = b.building_id AND a.floor"
    " = b.floor AND a.x = b.x AND a.y = b.y AND a.id <> b.id WHERE a.id = w.id) AS shares_vertex FROM wall w",
    ends=ENDS_SQL.format(w="wall"),
)
def shared_vertices(r: Roles):
    return geometry.shared_vertices(r.wall)


SCALE_SQL = (
    "SELECT building_id, floor, CAST(s AS BIGINT) AS scale, CAST(mx * s + 10 AS BIGINT) AS width, CAST(my * s + 10 AS BIGINT)"
    " AS height FROM (SELECT *, round(600.0 / greatest(mx, my), 0) AS s FROM (SELECT building_id, floor,"
    " CAST(round(MAX(greatest(x1, x2)), 0) AS BIGINT) AS mx, CAST(round(MAX(greatest(y1, y2)), 0) AS BIGINT) AS my FROM wall"
    " GROUP BY 1, 2))"
)


@query("plan_scale", "building_id:l floor:l scale:l width:l height:l", "wall", SCALE_SQL)
def plan_scale(r: Roles):
    return rendering.plan_scale(r.wall)


def _at(c: str) -> str:
    return f"' || CAST(CAST({c} * scale + 5 AS DECIMAL(20,2)) AS VARCHAR) || '"


def _line_sql(colour: str) -> str:
    return (
        f"'<line x1=\"{_at('x1')}\" y1=\"{_at('y1')}\" x2=\"{_at('x2')}\" y2=\"{_at('y2')}\" stroke=\"' || {colour} ||"
        " '\" stroke-width=\"3px\"/>'"
    )


OPENING_COLOUR = "CASE kind WHEN 'Finestra' THEN '#2ab2c7' WHEN 'Porta' THEN '#2ac776' ELSE '#c77e2a' END"
PLAN_SQL = (
    f"SELECT p.building_id, p.floor, {quoted([rendering.PAGE_START])} || p.building_id || {quoted([rendering.PAGE_FLOOR])} ||"
    f" p.floor || '</p>' || chr(13) || {quoted([rendering.PAGE_SVG[5:]])} || p.width || '\" height=\"' || p.height || '\">' ||"
    f" string_agg(chr(13) || e.svg, '' ORDER BY layer, e.id) || {quoted([rendering.PAGE_END])} AS html FROM sc p JOIN el e ON"
    " e.building_id = p.building_id AND e.floor = p.floor GROUP BY p.building_id, p.floor, p.width, p.height"
)
ELEMENTS_SQL = (
    f"SELECT w.building_id, w.floor, 0 AS layer, w.id, {_line_sql(quoted(['black']))} AS svg FROM wall w JOIN sc ON"
    " sc.building_id = w.building_id AND sc.floor = w.floor UNION ALL SELECT w.building_id, w.floor, 1, w.id,"
    f" {_line_sql(OPENING_COLOUR)} FROM opening w JOIN sc ON sc.building_id = w.building_id AND sc.floor = w.floor UNION ALL"
    f" SELECT w.building_id, w.floor, 2, w.id, '<circle cx=\"{_at('x')}\" cy=\"{_at('y')}\" r=\"5\" fill=\"#ff2b20\"/>' FROM"
    " sensor w JOIN sc ON sc.building_id = w.building_id AND sc.floor = w.floor"
)


@query(
    "floor_plan_svg",
    "building_id:l floor:l html:s",
    "wall opening sensor",
    PLAN_SQL,
    sc=SCALE_SQL,
    el=ELEMENTS_SQL,
)
def floor_plan_svg(r: Roles):
    return rendering.floor_plans(r.wall, r.opening, r.sensor)
