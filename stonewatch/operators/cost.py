"""Project cost: materials, labour, management fees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.config import DEFAULT, Config
from stonewatch.functions.exprs import (
    OUT_OF_RANGE,
    UNKNOWN,
    as_date,
    hourly_pay,
    seniority_reason,
    shift_minutes,
)

MONEY = "decimal(20,2)"


def material_cost(uses: DataFrame, lots: DataFrame, jobs: DataFrame) -> DataFrame:
    """Cost of the material used per stage; stages without uses do not appear."""
    price = lots.select(F.col("id").alias("lot_id"), "unit_price")
    stage = jobs.select(F.col("id").alias("job_id"), "stage_id")
    return (
        uses.select("job_id", "lot_id", "quantity")
        .join(price, "lot_id")
        .join(stage, "job_id")
        .groupBy("stage_id")
        .agg(F.sum(F.col("quantity") * F.col("unit_price")).cast(MONEY).alias("material_cost"))
    )


def shift_pay(shifts: DataFrame, people: DataFrame, as_of, config: Config = DEFAULT) -> DataFrame:
    """Hourly pay of each shift's worker on the day it starts, with a reason when unknown."""
    staff = people.select(F.col("id").alias("worker_id"), "seniority")
    return (
        shifts.join(staff, "worker_id", "left")
        .withColumn("pay", hourly_pay("seniority", F.to_date("start"), as_of, config))
        .withColumn("reason", seniority_reason("seniority", "pay"))
    )


def labour_cost(shifts: DataFrame, people: DataFrame, as_of, config: Config = DEFAULT) -> DataFrame:
    """Cost of labour per stage; NULL with a reason when some shift has no known pay."""
    paid = shift_pay(shifts.select("stage_id", "worker_id", "start", "end"), people, as_of, config)
    minutes = shift_minutes().cast("decimal(12,0)")
    sums = paid.groupBy("stage_id").agg(
        (F.sum(minutes * F.col("pay")) / 60).cast(MONEY).alias("_total"),
        F.max(F.col("pay").isNull()).alias("_unpaid"),
        F.max(F.col("pay").isNull() & F.col("seniority").isNotNull()).alias("_dated"),
    )
    return sums.select(
        "stage_id",
        F.when(~F.col("_unpaid"), F.col("_total")).alias("labour_cost"),
        F.when(F.col("_dated"), F.lit(OUT_OF_RANGE)).when(F.col("_unpaid"), F.lit(UNKNOWN)).alias("reason"),
    )


def project_cost(
    projects: DataFrame,
    management: DataFrame,
    stages: DataFrame,
    materials: DataFrame,
    labour: DataFrame,
    strict_nulls: bool = False,
) -> DataFrame:
    """Fees plus material and labour of all stages, per project, with a reason where unknown.

    A project with a stage whose labour cannot be paid has no cost, and `reason` tells why.
    What is absent (no managers, stages, material or shifts) is zero; with `strict_nulls` a
    stage lacking material or shifts counts nothing, and a project lacking managers or
    counted stages has no cost.
    """
    zero = F.lit(0).cast(MONEY)
    fees = management.groupBy("project_id").agg(F.sum("fee").cast(MONEY).alias("fees"))
    parts = (
        stages.select(F.col("id").alias("stage_id"), "project_id")
        .join(materials, "stage_id", "left")
        .join(labour.select("stage_id", "labour_cost", "reason"), "stage_id", "left")
    )
    material, work = F.col("material_cost"), F.col("labour_cost")
    if not strict_nulls:
        material, work = F.coalesce(material, zero), F.coalesce(work, zero)
    built = parts.groupBy("project_id").agg(
        F.sum(material + work).cast(MONEY).alias("stages"), F.min("reason").alias("reason")
    )
    fee, stage = F.col("fees"), F.col("stages")
    if not strict_nulls:
        fee, stage = F.coalesce(fee, zero), F.coalesce(stage, zero)
    return (
        projects.select(F.col("id").alias("project_id"))
        .join(fees, "project_id", "left")
        .join(built, "project_id", "left")
        .select(
            "project_id",
            F.when(F.col("reason").isNull(), (fee + stage).cast(MONEY)).alias("cost"),
            "reason",
        )
    )


def finish_projects(projects: DataFrame, costs: DataFrame) -> DataFrame:
    """Projects with the given costs written into them; others unchanged.

    A cost that is unknown for a reason is not written over what a project has.
    """
    known = costs.filter(F.col("reason").isNull()) if "reason" in costs.columns else costs
    done = known.select(F.col("project_id").alias("id"), F.col("cost").alias("_cost"), F.lit(True).alias("_done"))
    cost = F.when(F.col("_done"), F.col("_cost")).otherwise(F.col("cost"))
    return projects.join(done, "id", "left").withColumn("cost", cost).select(*projects.columns)


def material_report(
    uses: DataFrame,
    jobs: DataFrame,
    stages: DataFrame,
    lots: DataFrame,
    materials: DataFrame,
    year: int,
    month: int,
) -> DataFrame:
    """Material used by jobs of the stages that ended in a month."""
    first = as_date(f"{year:04d}-{month:02d}-01")
    ended = stages.filter((F.col("ended") >= first) & (F.col("ended") < F.add_months(first, 1)))
    done = jobs.join(ended.select(F.col("id").alias("stage_id")), "stage_id", "left_semi")
    used = uses.select("job_id", "lot_id", "quantity").join(
        done.select(F.col("id").alias("job_id")), "job_id", "left_semi"
    )
    return (
        used.join(lots.select(F.col("id").alias("lot_id"), "material_id"), "lot_id")
        .groupBy("material_id")
        .agg(F.sum("quantity").alias("quantity"))
        .join(materials.select(F.col("id").alias("material_id"), "name"), "material_id")
        .select("material_id", "name", "quantity")
    )
