"""Updates of tables, and what is left of them after a time.

`sources.tables.write_table` stores an updated table in the place of the old one and
`sources.tables.drop_days_before` applies retention to tables stored by day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.functions.exprs import as_date, midnight


def update_columns(
    table: DataFrame, updates: DataFrame, key: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """The table with `columns` taken from the row of `updates` with the same key.

    A NULL in an update is written too; rows without an update stay as they are.
    """
    new = updates.select(*key, *(F.col(c).alias(f"_new_{c}") for c in columns), F.lit(True).alias("_hit"))
    changed = {
        c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns
    }
    return table.join(new, list(key), "left").select(*(changed.get(c, F.col(c)) for c in table.columns))


def first_kept_day(as_of, months: int = 1):
    return F.add_months(as_date(as_of), -months)


def keep_recent(rows: DataFrame, as_of, months: int = 1) -> DataFrame:
    """Readings or alerts not older than some months before the date; stored days are pruned."""
    first = first_kept_day(as_of, months)
    kept = rows.filter(F.col("ts") >= midnight(first))
    return kept.filter(F.col("day") >= first) if "day" in rows.columns else kept


def retention(
    measurements: DataFrame, alert_rows: DataFrame, as_of, months: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Readings and alerts left after dropping old readings and the alerts on them.

    An alert has the time of its reading, so both are cut at the same moment; alerts
    without a reading are found by the reference checks.
    """
    return keep_recent(measurements, as_of, months), keep_recent(alert_rows, as_of, months)


def add_year_of_seniority(people: DataFrame) -> DataFrame:
    """One more year for active staff; unknown seniority stays unknown."""
    more = F.when(F.col("active"), F.col("seniority") + 1).otherwise(F.col("seniority"))
    return people.withColumn("seniority", more)
