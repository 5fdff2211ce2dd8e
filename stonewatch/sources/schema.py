"""Tables: columns, keys, references and value rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from stonewatch.config import ORIENTATIONS, SENSOR_KINDS


def _listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@dataclass(frozen=True)
class Table:
    """One table. A type ending in `?` may be NULL; `checks` let NULL pass."""

    columns: dict[str, str]
    key: tuple[str, ...]
    refs: tuple[tuple[tuple[str, ...], str, tuple[str, ...]], ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)
    partition: str | None = None

    @property
    def schema(self) -> T.StructType:
        parsed = T.StructType.fromDDL(
            ", ".join(f"`{n}` {t.rstrip('?')}" for n, t in self.columns.items())
        )
        return T.StructType(
            [T.StructField(f.name, f.dataType, self.columns[f.name].endswith("?")) for f in parsed]
        )

    @property
    def required(self) -> list[str]:
        return [n for n, t in self.columns.items() if not t.endswith("?")]


COORD = "DECIMAL(5,2)"
GEO = "DECIMAL(9,6)"
FLOOR_REF = (("building_id", "floor"), "floor", ("building_id", "number"))
SEGMENT = {"x1": COORD, "y1": COORD, "x2": COORD, "y2": COORD}
SEGMENT_CHECKS = {
    **{f"{c} not negative": f"{c} >= 0" for c in SEGMENT},
    "segment has length": "abs(x2 - x1) + abs(y2 - y1) <> 0",
}
PLACE_CHECKS = {
    "latitude in range": "lat BETWEEN -90 AND 90",
    "longitude in range": "lon BETWEEN -180 AND 180",
}


def _positive(*names: str) -> dict[str, str]:
    return {f"{n} above zero": f"`{n}` > 0" for n in names}


def _not_negative(*names: str) -> dict[str, str]:
    return {f"{n} not negative": f"`{n}` >= 0" for n in names}


def _to(column: str, table: str, target: str = "id"):
    return ((column,), table, (target,))


TABLES: dict[str, Table] = {
    "area": Table({"postcode": "STRING"}, ("postcode",), lengths={"postcode": 255}),
    "risk": Table(
        {"area": "STRING", "kind": "STRING", "measured": "DATE", "coefficient": "SMALLINT"},
        ("area", "kind", "measured"),
        (_to("area", "area", "postcode"),),
        {"coefficient in range": "coefficient BETWEEN 0 AND 5"},
        {"kind": 45},
    ),
    "disaster": Table(
        {"ts": "TIMESTAMP_NTZ", "lat": GEO, "lon": GEO, "kind": "STRING", "intensity": "DECIMAL(4,2)?"},
        ("ts",),
        checks=PLACE_CHECKS,
        lengths={"kind": 100},
    ),
    "disaster_area": Table(
        {"area": "STRING", "disaster_ts": "TIMESTAMP_NTZ"},
        ("area", "disaster_ts"),
        (_to("area", "area", "postcode"), _to("disaster_ts", "disaster", "ts")),
    ),
    "building": Table(
        {"id": "BIGINT", "area": "STRING", "lat": GEO, "lon": GEO, "kind": "STRING"},
        ("id",),
        (_to("area", "area", "postcode"),),
        PLACE_CHECKS,
        {"kind": 100},
    ),
    "floor": Table(
        {"number": "SMALLINT", "building_id": "BIGINT"},
        ("number", "building_id"),
        (_to("building_id", "building"),),
        _not_negative("number"),
    ),
    "wall": Table(
        {"id": "BIGINT", "floor": "SMALLINT", "building_id": "BIGINT", **SEGMENT},
        ("id",),
        (FLOOR_REF,),
        SEGMENT_CHECKS,
    ),
    "room": Table(
        {
            "id": "BIGINT", "floor": "SMALLINT", "building_id": "BIGINT", "function": "STRING",
            "max_length": COORD, "max_width": COORD, "max_height": COORD + "?",
        },
        ("id",),
        (FLOOR_REF,),
        _positive("max_length", "max_width", "max_height"),
        {"function": 100},
    ),
    "wall_face": Table(
        {"room_id": "BIGINT", "wall_id": "BIGINT"},
        ("room_id", "wall_id"),
        (_to("room_id", "room"), _to("wall_id", "wall")),
    ),
    "opening": Table(
        {
            "id": "BIGINT", "floor": "SMALLINT", "building_id": "BIGINT", **SEGMENT, "z": COORD,
            "height": COORD, "kind": "STRING", "orientation": "STRING?",
        },
        ("id",),
        (FLOOR_REF,),
        {
            **SEGMENT_CHECKS,
            **_not_negative("z"),
            **_positive("height"),
            "orientation known": f"orientation IN ({_listed(ORIENTATIONS)})",
        },
        {"kind": 100, "orientation": 2},
    ),
    "sensor": Table(
        {
            "id": "BIGINT", "floor": "SMALLINT", "building_id": "BIGINT", "kind": "STRING",
            "threshold": GEO, "x": COORD, "y": COORD, "z": COORD, "importance": "DECIMAL(3,2)",
        },
        ("id",),
        (FLOOR_REF,),
        {
            "kind known": f"kind IN ({_listed(SENSOR_KINDS)})",
            **_not_negative("threshold", "x", "y", "z"),
            "importance in range": "importance BETWEEN 0 AND 1",
        },
        {"kind": 45},
    ),
    "measurement": Table(
        {"sensor_id": "BIGINT", "ts": "TIMESTAMP_NTZ", "x": GEO, "y": GEO + "?", "z": GEO + "?"},
        ("sensor_id", "ts"),
        (_to("sensor_id", "sensor"),),
        partition="ts",
    ),
    "alert": Table(
        {"sensor_id": "BIGINT", "ts": "TIMESTAMP_NTZ"},
        ("sensor_id", "ts"),
        ((("sensor_id", "ts"), "measurement", ("sensor_id", "ts")),),
        partition="ts",
    ),
    "hit_building": Table(
        {
            "disaster_ts": "TIMESTAMP_NTZ", "building_id": "BIGINT", "distance_km": "INT?",
            "mercalli": "DECIMAL(4,2)?",
        },
        ("disaster_ts", "building_id"),
    ),
    "project": Table(
        {
            "id": "BIGINT", "building_id": "BIGINT", "submitted": "DATE", "approved": "DATE?",
            "description": "STRING", "cost": "DECIMAL(10,2)?",
        },
        ("id",),
        (_to("building_id", "building"),),
        {"approved after submission": "approved >= submitted"},
        {"description": 100},
    ),
    "stage": Table(
        {
            "id": "BIGINT", "project_id": "BIGINT", "description": "STRING", "started": "DATE",
            "planned_end": "DATE", "ended": "DATE?",
        },
        ("id",),
        (_to("project_id", "project"),),
        {"planned end after start": "planned_end >= started", "end after start": "ended >= started"},
        {"description": 100},
    ),
    "job": Table(
        {"id": "BIGINT", "stage_id": "BIGINT", "done": "BOOLEAN", "notes": "STRING?"},
        ("id",),
        (_to("stage_id", "stage"),),
        lengths={"notes": 255},
    ),
    "job_wall": Table(
        {"job_id": "BIGINT", "wall_id": "BIGINT"},
        ("job_id", "wall_id"),
        (_to("job_id", "job"), _to("wall_id", "wall")),
    ),
    "job_room": Table(
        {"job_id": "BIGINT", "room_id": "BIGINT"},
        ("job_id", "room_id"),
        (_to("job_id", "job"), _to("room_id", "room")),
    ),
    "job_face": Table(
        {"job_id": "BIGINT", "room_id": "BIGINT", "wall_id": "BIGINT"},
        ("job_id", "room_id", "wall_id"),
        (_to("job_id", "job"), (("room_id", "wall_id"), "wall_face", ("room_id", "wall_id"))),
    ),
    "person": Table(
        {
            "id": "STRING", "born": "DATE", "phone": "STRING", "first_name": "STRING",
            "last_name": "STRING", "active": "BOOLEAN", "seniority": "SMALLINT?",
        },
        ("id",),
        lengths={"id": 16, "phone": 20, "first_name": 45, "last_name": 45},
    ),
    "management": Table(
        {"project_id": "BIGINT", "person_id": "STRING", "role": "STRING", "fee": "DECIMAL(10,2)"},
        ("project_id", "person_id"),
        (_to("project_id", "project"), _to("person_id", "person")),
        _positive("fee"),
        {"role": 45},
    ),
    "shift": Table(
        {
            "id": "BIGINT", "stage_id": "BIGINT", "worker_id": "STRING", "supervisor_id": "STRING",
            "start": "TIMESTAMP_NTZ", "end": "TIMESTAMP_NTZ",
        },
        ("id",),
        (_to("stage_id", "stage"), _to("worker_id", "person"), _to("supervisor_id", "person")),
    ),
    "contribution": Table(
        {"job_id": "BIGINT", "shift_id": "BIGINT", "hours": "DECIMAL(2,1)"},
        ("job_id", "shift_id"),
        (_to("job_id", "job"), _to("shift_id", "shift")),
        _positive("hours"),
    ),
    "material": Table(
        {
            "id": "BIGINT", "name": "STRING", "constituents": "STRING", "purpose": "STRING",
            "length": COORD + "?", "width": COORD + "?", "height": COORD + "?",
        },
        ("id",),
        checks=_positive("length", "width", "height"),
        lengths={"name": 45, "constituents": 100, "purpose": 100},
    ),
    "hollow_brick": Table(
        {"material_id": "BIGINT", "cell_shape": "STRING", "cell_material": "STRING"},
        ("material_id",),
        (_to("material_id", "material"),),
        lengths={"cell_shape": 45, "cell_material": 45},
    ),
    "tile": Table(
        {"material_id": "BIGINT", "shape": "STRING", "style": "STRING"},
        ("material_id",),
        (_to("material_id", "material"),),
        lengths={"shape": 45, "style": 45},
    ),
    "lot": Table(
        {
            "id": "BIGINT", "material_id": "BIGINT", "supplier": "STRING", "batch": "STRING",
            "purchased": "DATE", "unit_price": "DECIMAL(10,2)", "units": "INT", "available": "INT",
        },
        ("id",),
        (_to("material_id", "material"),),
        {
            **_not_negative("unit_price"),
            **_positive("units"),
            "available within units": "available BETWEEN 0 AND units",
        },
        {"supplier": 45, "batch": 45},
    ),
    "lot_use": Table(
        {"job_id": "BIGINT", "lot_id": "BIGINT", "quantity": "INT"},
        ("job_id", "lot_id"),
        (_to("job_id", "job"), _to("lot_id", "lot")),
        _not_negative("quantity"),
    ),
}
