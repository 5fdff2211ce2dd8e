"""Typed reading and writing of the tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stonewatch.config import DEFAULT, Config
from stonewatch.functions.exprs import as_date, days_before, health
from stonewatch.functions.grouped import cut_lineage
from stonewatch.operators.quality import audit
from stonewatch.operators.sensors import (
    day_parts,
    health_pairs,
    merged_readings,
    part_bins,
    part_sums,
    with_kind,
)
from stonewatch.sources.schema import TABLES


def create_table(spark: SparkSession, name: str, rows) -> DataFrame:
    """A small table from Python rows in column order."""
    return spark.createDataFrame(rows, TABLES[name].schema)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared columns; nothing is inferred.

    Tables stored by day keep the day as partition column, so that ranges of days
    prune folders.
    """
    spec = TABLES[name]
    schema = spec.schema.add("day", "date") if spec.partition else spec.schema
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def read_csv(spark: SparkSession, path: str, name: str, **options) -> DataFrame:
    """A table from delimited text with a header, typed as declared; bad rows fail."""
    return spark.read.schema(TABLES[name].schema).csv(
        path, header=True, mode="FAILFAST", enforceSchema=False, **options
    )


def read_csv_quarantined(spark: SparkSession, path: str, name: str, **options) -> tuple[DataFrame, DataFrame]:
    """The good rows of delimited text with a header, typed as declared, and the bad ones as (line, reason).

    Bad are rows that do not parse (a value of another type or out of its range, too few or too
    many values) and rows without a value that must be there. Every line is in one of the two.
    """
    spec = TABLES[name]
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in spec.schema] + [T.StructField("_line", T.StringType())])
    read = spark.read.schema(loose).options(**options).csv(
        path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_line", enforceSchema=False
    )
    missing = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in spec.required]
    reason = F.coalesce(F.when(F.col("_line").isNotNull(), F.lit("not readable as declared")), *missing)
    shown = F.coalesce("_line", F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in spec.columns)))
    # Spark does not read the line alone, so the rows are written once with it
    judged = cut_lineage(read.withColumn("_reason", reason).withColumn("_line", F.when(F.col("_reason").isNotNull(), shown)))
    good = judged.filter(F.col("_reason").isNull()).select(*spec.columns)
    bad = judged.filter(F.col("_reason").isNotNull()).select(F.col("_line").alias("line"), F.col("_reason").alias("reason"))
    return good, bad


def _laid_out(df: DataFrame, name: str) -> DataFrame:
    spec = TABLES[name]
    typed = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema))
    return typed.withColumn("day", F.to_date(spec.partition)) if spec.partition else typed


def _writer(df: DataFrame, name: str):
    spec = TABLES[name]
    # rows of a day land together in few files, a crowded day in several
    rows = df.hint("rebalance", "day") if spec.partition else df
    writer = rows.write
    return writer.partitionBy("day") if spec.partition else writer


def _files(spark: SparkSession, path: str):
    """The Hadoop file system that holds a path, and the path as it takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def write_table(df: DataFrame, root: str, name: str) -> None:
    """Replace a stored table, also by rows that are computed from it.

    The new rows are written in full next to the table, which is then exchanged by two
    renames. A write that fails leaves the table as it was. A driver lost between the
    renames leaves the old rows in `.{name}-old-*`, which `recover` puts back.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    fresh, old = f"{root}/.{name}-new-{mark}", f"{root}/.{name}-old-{mark}"
    files, target = _files(spark, f"{root}/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        _writer(_laid_out(df, name), name).parquet(fresh)
    except Exception:
        files.delete(path(fresh), True)
        raise
    had = files.exists(target)
    if had and not files.rename(target, path(old)):
        raise OSError(f"cannot set aside {root}/{name}")
    if not files.rename(path(fresh), target):
        if had:
            files.rename(path(old), target)
        raise OSError(f"cannot put new rows into {root}/{name}")
    if had:
        files.delete(path(old), True)
    spark.catalog.refreshByPath(f"{root}/{name}")


def drop_days_before(spark: SparkSession, root: str, name: str, first_day) -> list[str]:
    """Delete the stored days before a date, by folder; no row is read. The days dropped."""
    if TABLES[name].partition is None:
        raise ValueError(f"{name} is not stored by day")
    files, at = _files(spark, f"{root}/{name}")
    if not files.exists(at):
        return []
    gone = []
    for folder in files.listStatus(at):
        key, _, day = folder.getPath().getName().partition("=")
        if key == "day" and day < str(first_day):  # ISO dates sort as text; the null folder's name sorts last
            files.delete(folder.getPath(), True)
            gone.append(day)
    spark.catalog.refreshByPath(f"{root}/{name}")
    return sorted(gone)


def append_table(df: DataFrame, root: str, name: str) -> None:
    _writer(_laid_out(df, name), name).mode("append").parquet(f"{root}/{name}")


def reload_all(tables: Mapping[str, DataFrame], root: str) -> None:
    """Replace every stored table; tables without new rows become empty."""
    some = next(iter(tables.values()))
    for name, spec in TABLES.items():
        rows = tables.get(name)
        write_table(
            some.sparkSession.createDataFrame([], spec.schema) if rows is None else rows, root, name
        )


def reload_gated(tables: Mapping[str, DataFrame], root: str) -> DataFrame:
    """Replace all stored tables together, if the new ones keep every declared rule.

    All tables are written aside and audited there: keys, references, missing and wrong values.
    Returns the violations found; with any, or when a write fails, the stored tables stay as they
    were. Only after a clean audit are the tables exchanged; an exchange that was interrupted
    is carried on by `recover`. Tables without new rows become empty.
    """
    spark = next(iter(tables.values())).sparkSession
    aside = f"{root}/.reload-{uuid.uuid4().hex}"
    files, at = _files(spark, aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        for name, spec in TABLES.items():
            rows = tables.get(name)
            made = spark.createDataFrame([], spec.schema) if rows is None else rows
            _writer(_laid_out(made, name), name).parquet(f"{aside}/{name}")
        staged = {name: read_table(spark, aside, name) for name in TABLES}
        found = cut_lineage(audit({n: staged[n] for n in _with_parents(tables)}))
        clean = found.isEmpty()
    except Exception:
        files.delete(at, True)
        raise
    if not clean:
        files.delete(at, True)
        return found
    files.create(path(f"{aside}/{READY}")).close()
    recover(spark, root)
    return found


def _with_parents(names) -> list[str]:
    """The tables and those they refer to."""
    return [n for n in TABLES if n in names or any(n == parent for m in names for _, parent, _ in TABLES[m].refs)]


#: Marks a set of tables as audited: from here on an interrupted exchange goes forward.
READY = "_ready"


def recover(spark: SparkSession, root: str) -> None:
    """Carry on or clear away what an interrupted job left in a folder of tables.

    An audited reload is exchanged to its end, one that was not audited is deleted; a table that
    `write_table` had set aside and not replaced is put back.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    files, at = _files(spark, root)
    if not files.exists(at):
        return

    def children(folder) -> list[str]:
        return sorted(x.getPath().getName() for x in files.listStatus(folder))

    for left in children(at):
        if left.startswith(".reload-"):
            folder = f"{root}/{left}"
            if files.exists(path(f"{folder}/{READY}")):
                for name in children(path(folder)):
                    if name in TABLES:
                        target = path(f"{root}/{name}")
                        if files.exists(target):
                            files.rename(target, path(f"{folder}/_old-{name}"))
                        if not files.rename(path(f"{folder}/{name}"), target):
                            raise OSError(f"cannot put new rows into {root}/{name}")
                        spark.catalog.refreshByPath(f"{root}/{name}")
            files.delete(path(folder), True)
        elif left.startswith(".") and ("-old-" in left or "-new-" in left):
            name = left[1:].rsplit("-", 2)[0]
            if "-old-" in left and not files.exists(path(f"{root}/{name}")):
                files.rename(path(f"{root}/{left}"), path(f"{root}/{name}"))
            else:
                files.delete(path(f"{root}/{left}"), True)


def of_days(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored rows of exactly the days that `rows` have: other folders are not read.

    The days become literals of the partition filter. They are dates, so there are a few thousand
    at most, whatever the number of rows.
    """
    days = [r.day for r in rows.select("day").distinct().collect() if r.day is not None]
    return stored.filter(F.col("day").isin(days) if days else F.lit(False))


def _new_measurements(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Readings that are not stored yet, at most one per sensor and time, written once."""
    values = F.min(F.struct("x", "y", "z"))
    fresh = rows.groupBy("sensor_id", "ts").agg(values.alias("v")).select("sensor_id", "ts", "v.*")
    fresh = cut_lineage(fresh.withColumn("day", F.to_date("ts")))
    if not path_exists(spark, f"{root}/measurement"):
        return fresh
    known = of_days(read_table(spark, root, "measurement"), fresh)
    return cut_lineage(fresh.join(known.select("sensor_id", "ts", "day"), ["day", "sensor_id", "ts"], "left_anti"))


def append_measurements(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """Add readings, at most one per sensor and time, new ones only.

    Of new readings with equal sensor and time the smallest values are kept. Stored readings
    are read for the days of the new ones only, however far apart those are.
    """
    append_table(_new_measurements(spark, root, rows), root, "measurement")


#: What is kept beside the readings, by day: results per sensor and day that merge by adding up.
SUMS = "measurement_sums"
BINS = "measurement_bins"


def append_with_parts(spark: SparkSession, root: str, rows: DataFrame, sensors: DataFrame) -> None:
    """Add readings as `append_measurements` does, and what they add to the sums and histograms of their days.

    The partial results of readings that come later are further rows beside the earlier ones. They are
    written first: after a failure between the writes, `rebuild_parts` makes them agree again.
    """
    new = _new_measurements(spark, root, rows)
    _write_parts(new, root, sensors, "append")
    append_table(new, root, "measurement")


def _write_parts(readings: DataFrame, root: str, sensors: DataFrame, mode: str) -> None:
    parts = day_parts(with_kind(readings, sensors))
    for name, made in ((SUMS, part_sums(parts)), (BINS, part_bins(parts))):
        made.hint("rebalance", "day").write.partitionBy("day").mode(mode).parquet(f"{root}/{name}")


def _stored_parts(spark: SparkSession, root: str, name: str, made: DataFrame) -> DataFrame:
    """Stored partial results with the columns of `made`.

    Before a reading of their kinds of sensors comes, the folder has no file to read the columns from.
    """
    path = f"{root}/{name}"
    files, at = _files(spark, path)
    if files.exists(at) and not any(x.isDirectory() for x in files.listStatus(at)):
        return made.limit(0)
    return spark.read.parquet(path)


def rebuild_parts(spark: SparkSession, root: str, sensors: DataFrame) -> None:
    """Compute the partial results of all stored readings anew."""
    _write_parts(read_table(spark, root, "measurement"), root, sensors, "overwrite")


def stored_health(
    spark: SparkSession, root: str, sensors: DataFrame, as_of, config: Config = DEFAULT
) -> DataFrame:
    """`health_table` of stored readings from their partial results.

    Sums and histograms are read for the days of both periods. Readings are met only in the
    histogram bins where a sensor's top 1 % ends.
    """
    day = as_date(as_of)
    spans = [
        F.struct(F.lit(name).alias("period"), days_before(day, a).alias("from_day"), days_before(day, b).alias("to_day"))
        for name, (a, b) in (("new", config.advice_periods.new), ("old", config.advice_periods.old))
    ]
    wanted = sensors.select(F.col("id").alias("sensor_id"), "building_id", "kind", "threshold")
    each = wanted.withColumn("_w", F.explode(F.array(*spans))).select("sensor_id", "_w.*")
    backs = [back for name in ("new", "old") for back in getattr(config.advice_periods, name)]
    near = F.col("day").between(days_before(day, max(backs)), days_before(day, min(backs)))
    parts = day_parts(with_kind(read_table(spark, root, "measurement").filter(near), sensors))
    sums = _stored_parts(spark, root, SUMS, part_sums(parts)).filter(near)
    bins = _stored_parts(spark, root, BINS, part_bins(parts)).filter(near)
    readings = merged_readings(parts, sums, bins, each, ["sensor_id", "period"])
    judged = wanted.join(each.select("sensor_id", "period"), "sensor_id").join(readings, ["sensor_id", "period"], "left")
    return health_pairs(judged.withColumn("health", health("kind", "reading", "threshold")))


def append_hit_statistics(rows: DataFrame, root: str) -> None:
    """Add statistics of newly estimated disasters, one folder per disaster."""
    rows.write.partitionBy("disaster_ts").mode("append").parquet(f"{root}/hit_building")


def read_hit_statistics(spark: SparkSession, root: str) -> DataFrame:
    spec = TABLES["hit_building"]
    return spark.read.schema(spec.schema).parquet(f"{root}/hit_building").select(*spec.columns)


def write_plans(plans: DataFrame, path: str) -> None:
    """Floor plans as keyed rows, the floors of a building next to each other."""
    rows = plans.select("building_id", "floor", "html")
    rows.repartitionByRange("building_id", "floor").sortWithinPartitions("building_id", "floor").write.mode(
        "overwrite"
    ).parquet(path)


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("building_id BIGINT, floor INT, html STRING").parquet(path)
