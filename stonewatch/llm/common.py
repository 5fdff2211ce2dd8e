"""What several operators need: staged tables, joins that survive hot keys, bit filters."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stonewatch.functions.grouped import shared_folder

#: White space of the contracts: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

#: A group is hot when it holds more than this share of the rows, so there are at most 10,000 of them.
HOT_SHARE = 10_000
HOT_ROWS = 64


#: Rows that a Python worker holds at a time; texts may be long.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package from where the driver has it, and
    hand them BATCH_ROWS rows at a time at most, which bounds their memory.

    On a cluster the package is installed on the executors or given by --py-files.
    """
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(batch)) <= BATCH_ROWS:
        spark.conf.set(batch, str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


#: Batches after which a worker hands freed memory back.
RELEASE_EVERY = 8


def release_memory() -> None:
    """Hand what Arrow and the C library keep of freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(function):
    """A function of record batches that hands freed memory back as it goes and at its end.

    Workers are used again by later tasks and stages; what they kept would add up.
    """

    def run(batches):
        for i, made in enumerate(function(batches)):
            yield made
            del made
            if i % RELEASE_EVERY == RELEASE_EVERY - 1:
                release_memory()
        release_memory()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame once into the shared folder and read it back.

    Cuts the lineage like `checkpoint()`, but computes the frame once and is read by column.
    The folder belongs to the cluster's scratch space and may be dropped after the application.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the folders of staged frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("llm-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def attach(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    size: str,
    total: int,
    how: str = "inner",
) -> DataFrame:
    """Join rows with their group's row, whatever share of the rows one group holds.

    `groups` has one row per key and the key's row count in `size`. Keys with over
    max(HOT_ROWS, total / HOT_SHARE) rows are at most HOT_SHARE many, hence a broadcast of
    proven size; the rows of all other keys are joined by a shuffle that no key can
    dominate. Keys must not be null. Both frames are read twice: pass staged ones.
    """
    keys = list(keys)
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = groups.filter(F.col(size) > limit).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), keys, "left")
    direct = marked.filter(F.col("_hot").isNotNull()).drop("_hot")
    cold = marked.filter(F.col("_hot").isNull()).select(*rows.columns)
    rest = cold.join(groups.filter(F.col(size) <= limit), keys, how)
    return direct.select(*rest.columns).unionByName(rest)
