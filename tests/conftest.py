import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("stonewatch-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows in DDL order -> DataFrame; numbers and dates may be given as text."""

    def build(ddl, rows):
        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        schema = T.StructType.fromDDL(ddl)
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        as_text = [
            tuple(None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r)
            for r in rows
        ]
        raw = spark.createDataFrame(as_text, text)
        return raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))

    return build


def order(row):
    """Sort key for rows with missing values."""
    return tuple((v is None, 0 if v is None else v) for v in row)


def values(df, *columns):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=order)
