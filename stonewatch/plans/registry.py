"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stonewatch.plans.roles import role, with_roles

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TYPES = {"l": "bigint", "d": "double", "s": "string", "b": "boolean"}
_SQL_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Plain comparable types: `name:l` bigint, d double, s text, b boolean, t time and D date as text."""

    def one(name: str, kind: str):
        if kind == "t":
            return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
        if kind == "D":
            return F.date_format(name, "yyyy-MM-dd").alias(name)
        return F.col(name).cast(_TYPES[kind]).alias(name)

    return df.select(*(one(*c) for c in _columns(spec)))


def shape_sql(prefix: str, body: str, spec: str) -> str:
    def one(name: str, kind: str) -> str:
        if kind == "t":
            return f"strftime(q.\"{name}\", '%Y-%m-%d %H:%M:%S.%f') AS \"{name}\""
        if kind == "D":
            return f"strftime(q.\"{name}\", '%Y-%m-%d') AS \"{name}\""
        return f"CAST(q.\"{name}\" AS {_SQL_TYPES[kind]}) AS \"{name}\""

    return f"{prefix} SELECT {', '.join(one(*c) for c in _columns(spec))} FROM ({body}) AS q"


class Roles:
    """Roles of one table folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return role(self.spark, self.sf_dir, name)


def query(name: str, spec: str, roles: str = "", body: str | None = None, **ctes: str):
    """Register a function of `Roles` under a name, with its SQL check if there is one."""

    def register(fn: Callable[[Roles], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shape(fn(Roles(spark, sf_dir)), spec)

        QUERIES[name] = run
        if body is not None:
            prefix = with_roles(*roles.split(), **ctes) if roles or ctes else ""
            ORACLES[name] = shape_sql(prefix, body, spec)
        return fn

    return register
