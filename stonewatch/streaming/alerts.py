"""Threshold alerts on a stream of readings, with the batch operator's rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stonewatch.functions.grouped import cut_lineage
from stonewatch.operators.sensors import alerts
from stonewatch.sources.schema import TABLES
from stonewatch.sources.tables import of_days, path_exists

STORED = "sensor_id BIGINT, ts TIMESTAMP_NTZ, day DATE"


def read_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """Readings from files arriving in a folder."""
    return spark.readStream.schema(TABLES["measurement"].schema).options(**options).parquet(path)


def stream_alerts(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """Alerts of readings against a table of sensors, one per sensor and time.

    On a stream repeated readings are settled when alerts are stored, see `store_new`.
    """
    found = alerts(readings, sensors)
    return found if readings.isStreaming else found.dropDuplicates(["sensor_id", "ts"])


def store_new(found: DataFrame, path: str) -> None:
    """Append the alerts that are not stored yet, by day.

    The batch is computed once, and stored alerts are read for exactly the days of the new ones.
    Storing the same alerts again, as a restarted stream does, adds nothing.
    """
    spark = found.sparkSession
    fresh = cut_lineage(found.select("sensor_id", "ts").distinct().withColumn("day", F.to_date("ts")))
    if path_exists(spark, path):
        known = of_days(spark.read.schema(STORED).parquet(path), fresh)
        fresh = fresh.join(known, ["day", "sensor_id", "ts"], "left_anti")
    fresh.write.partitionBy("day").mode("append").parquet(path)


def start_alerts(
    alert_stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, **trigger
) -> StreamingQuery:
    """Store the alerts of a stream; with `available_now`, stop once the input is used up.

    Nothing is late: a reading alerts whatever its time and the order of arrival, and no
    state is kept between batches but the stored alerts themselves.
    """
    writer = alert_stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, _: store_new(batch, path)
    )
    return writer.trigger(**({"availableNow": True} if available_now else trigger)).start()


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path).select("sensor_id", "ts")
