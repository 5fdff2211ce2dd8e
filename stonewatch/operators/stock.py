"""Stock: oldest-first allocation of requests to lots, and its guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.functions.exprs import first_reason
from stonewatch.functions.grouped import (
    cut_lineage,
    greedy_accept,
    match_ranges,
    running_sum,
    settle,
)


def stock_of(lots: DataFrame) -> DataFrame:
    """Units left per material."""
    return lots.groupBy("material_id").agg(F.sum("available").alias("stock"))


def allocate(requests: DataFrame, lots: DataFrame) -> DataFrame:
    """Serve requests from the oldest lots of their material, in `seq` order.

    Requests are (job_id, material_id, quantity, seq), taken as accepted. One row
    per request and lot drawn from; a demand beyond the stock stays unserved.
    """
    key = ["material_id"]
    stock = running_sum(
        lots.filter(F.col("available") > 0).select(*key, "purchased", "id", "available"),
        key,
        ["purchased"],
        ["id"],
        "available",
        "upto",
    ).withColumn("_lot", F.struct("purchased", "id"))
    demand = running_sum(
        requests.filter(F.col("quantity") > 0).select(*key, "seq", "job_id", "quantity"),
        key,
        ["seq"],
        ["job_id"],
        "quantity",
        "upto",
    ).withColumn("_request", F.struct("seq", "job_id"))
    return match_ranges(stock, demand, key, "_lot", "_request").select(
        F.col("_request.job_id").alias("job_id"),
        F.col("_request.seq").alias("seq"),
        "material_id",
        F.col("_lot.id").alias("lot_id"),
        F.col("_lot.purchased").alias("purchased"),
        F.col("amount").alias("quantity"),
    )


def remaining_stock(lots: DataFrame, allocations: DataFrame) -> DataFrame:
    """Lots with what the allocations leave of them."""
    key = ["material_id", "purchased", "id"]
    drawn = (
        allocations.withColumnRenamed("lot_id", "id")
        .groupBy(*key)
        .agg(F.sum("quantity").alias("_drawn"))
    )
    return (
        lots.join(drawn, key, "left")
        .withColumn("available", F.col("available") - F.coalesce("_drawn", F.lit(0)))
        .drop("_drawn")
        .select(*lots.columns)
    )


def check_requests(requests: DataFrame, lots: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """Accept or refuse requests as if made one by one in `seq` order.

    Refused: a job already using the material, a negative quantity, a material
    without lots, a quantity above what earlier accepted requests leave.
    """
    stock = stock_of(lots)
    pair = ["job_id", "material_id"]
    known = requests.join(stock, "material_id", "left")
    if uses is None:
        known = known.withColumn("_used", F.lit(False))
    else:
        used = (
            uses.join(lots.select(F.col("id").alias("lot_id"), "material_id"), "lot_id")
            .select(*pair)
            .distinct()
            .withColumn("_used", F.lit(True))
        )
        known = known.join(used, pair, "left").withColumn("_used", F.coalesce("_used", F.lit(False)))
    known = known.withColumn(
        "_plain",
        first_reason(
            (F.col("_used"), "material already used by the job"),
            (F.col("quantity") < 0, "negative quantity"),
            (F.col("stock").isNull(), "no stock of the material"),
        ),
    )
    known = cut_lineage(known)
    room = stock.withColumnRenamed("stock", "room")

    def fit(rows: DataFrame) -> DataFrame:
        """Judge rows without a reason so far by the room left to them."""
        served = greedy_accept(rows.filter(F.col("_plain").isNull()), room, ["material_id"], "seq", "quantity")
        short = F.when(~F.col("accepted"), F.lit("insufficient stock"))
        return (
            served.withColumn("reason", short)
            .drop("accepted", "room_left")
            .unionByName(rows.filter(F.col("_plain").isNotNull()).withColumn("reason", F.col("_plain")))
        )

    if requests.groupBy(*pair).count().filter("count > 1").isEmpty():
        return fit(known).drop("_used", "_plain", "stock")

    base = known.withColumnRenamed("_plain", "_alone")

    def judge(rows: DataFrame) -> DataFrame:
        # an earlier accepted request of the same job and material blocks this one
        first = (
            rows.filter(F.col("previous").isNull() & (F.col("quantity") > 0))
            .groupBy(*pair)
            .agg(F.min("seq").alias("_first"))
        )
        again = F.when(F.col("_first") < F.col("seq"), F.lit("material already used by the job"))
        marked = rows.join(first, pair, "left").withColumn("_plain", F.coalesce("_alone", again))
        return fit(marked).drop("_first", "_plain")

    return settle(base, judge, groups=["material_id"]).drop("_used", "_alone", "stock")


def serve(
    requests: DataFrame, lots: DataFrame, uses: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judge requests, draw the accepted ones from the lots, and lower what is available.

    The judged requests, the draws and the lots afterwards; refused requests draw nothing.
    Lots and verdicts are written once, as each is read several times.
    """
    lots = cut_lineage(lots)
    judged = cut_lineage(check_requests(requests, lots, uses))
    drawn = allocate(judged.filter(F.col("reason").isNull()).select("job_id", "material_id", "quantity", "seq"), lots)
    return judged, drawn, remaining_stock(lots, drawn)
