"""Grouped building blocks that stay parallel inside one hot group.

A plain window over a key hands the whole key to one task. The helpers here
cut a key into ordered slices of about equal row counts first, so a key holding much of
the table is still worked on by many tasks, whatever values its order has.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

CHUNK_ROWS = 1_000_000
BROADCAST_ROWS = 1_000_000
BINS_PER_OCTAVE = 64
SUB_BINS = 1024
EDGE_ROWS = 4096
ZERO_BIN = -1_000_000
MISSING_BIN = -2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one in local mode only.

    Elsewhere executors would each write to their own disk, so an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"master {master} needs spark.checkpoint.dir set to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="stonewatch-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/stonewatch-{uuid.uuid4().hex}"


#: Paths written by `cut_lineage` that the innermost `dropped_scratch` deletes at its end.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame once into the shared folder and read it back.

    Like a checkpoint, it cuts the lineage and survives lost executors; as Parquet, it is read by
    column and its size is known to the planner.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def dropped_scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What `cut_lineage` writes inside is deleted at the end; paths taken off the list stay."""
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        yield written
    finally:
        _WRITTEN.reset(token)
        for path in written:
            drop_scratch(spark, path)


def cut_and_drop(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """`cut_lineage` of the frame that `build` makes; what was written on the way is deleted."""
    with dropped_scratch(spark) as written:
        frame = cut_lineage(build())
        path = written.pop()
    outer = _WRITTEN.get()
    if outer is not None:
        outer.append(path)
    return frame


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries started inside delete their shuffle files when they end.

    Otherwise those stay until the driver happens to collect its garbage: of a run of many steps, nearly all.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise a narrow frame, count it, and mark it for broadcast only up to `rows`.

    Beyond that the join is left to shuffle both sides.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the tables: both sides are shuffled, neither is broadcast.

    The planner's estimate leaves out the rows that explode and inline add and how far files
    compress, so a frame of a few GB can look small enough for the driver and for every task.
    """
    return df.hint("merge")


def looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Left join of what `facts` tell on `key`, by shuffling; rows without a key are dealt out, not sent to one task."""
    known = F.col(key).try_cast(facts.schema[key].dataType)
    spread = F.when(F.col(key).isNull(), F.xxhash64(*rows.columns)).otherwise(F.xxhash64(known))
    facts = facts.withColumn("_spread", F.xxhash64(key))
    return rows.withColumn("_spread", spread).join(shuffled(facts), [key, "_spread"], "left").drop("_spread")


def seq_chunk(seq: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a running number."""
    return F.floor(F.col(seq) / F.lit(rows)).cast("long")


SLICE_COLUMNS = ("_slice", "_at")
#: Rows that a slice, and a task working on slices, should hold, and those it holds before more than
#: WIDE_TASKS tasks share them. Spark's shuffle deals rows to up to 200 tasks without keeping them in memory.
SLICE_ROWS = 200_000
FULL_ROWS = 2_000_000
WIDE_TASKS = 200


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows sorted by `keys, order`, with `_slice` and `_at`, written once.

    Slices are Spark's range partitions: about equal numbers of rows, their number growing with the
    rows, cut anywhere in a key, also among rows that tie. `_slice` rises along the order; `_at` rises by one from row to row in
    a slice. Totals of slices, combined map-side, carry what goes from slice to slice.
    """
    spark = df.sparkSession
    rows = cut_lineage(df)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), _tasks(rows))
    sort = [*keys, *order, "_tie"]
    return cut_lineage(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *sort)
        .sortWithinPartitions(*sort)
        .drop("_tie")
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )


def _tasks(rows: DataFrame) -> int:
    """Tasks for the rows of a written frame: their number grows with the rows."""
    count = rows.count()
    few = rows.sparkSession.sparkContext.defaultParallelism
    return max(few, min(WIDE_TASKS, -(-count // SLICE_ROWS)), -(-count // FULL_ROWS))


def _by_slice(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sliced rows dealt to as many tasks as they need: the planner's own number does not grow with them."""
    return rows.repartition(_tasks(rows), *keys, "_slice")


def _earlier_slices(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)


def carried_sums(rows: DataFrame, keys: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Running totals per key over sliced rows, current row included: `sums` has the column of each."""
    part = [*keys, "_slice"]
    before = _earlier_slices(keys)
    totals = rows.groupBy(*part).agg(*(F.sum(value).alias(f"_of_{out}") for out, value in sums.items()))
    offsets = totals.select(
        *part, *(F.coalesce(F.sum(f"_of_{out}").over(before), F.lit(0)).alias(f"_to_{out}") for out in sums)
    )
    within = Window.partitionBy(*part).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return _by_slice(rows, keys).join(offsets, part).select(
        *rows.columns, *((F.col(f"_to_{out}") + F.sum(value).over(within)).alias(out) for out, value in sums.items())
    )


def carried_sum(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Running total of `value` per key over sliced rows, current row included."""
    return carried_sums(rows, keys, {out: value})


def carried_previous(rows: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """`value` of the row before each sliced row of its key; NULL on the first."""
    part = [*keys, "_slice"]
    before = Window.partitionBy(*keys).orderBy("_slice")
    lasts = rows.groupBy(*part).agg(F.max_by(value, "_at").alias("_last"))
    offsets = lasts.select(*part, F.lag("_last").over(before).alias("_carried"))
    within = Window.partitionBy(*part).orderBy("_at")
    return (
        _by_slice(rows, keys).join(offsets, part).withColumn(out, F.coalesce(F.lag(value).over(within), "_carried")).drop("_carried")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    chunks: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """Running total of `value` per key in `chunks, order` order, current row included.

    Keys are not null.
    """
    return carried_sum(sliced(df, keys, [*chunks, *order]), keys, value, out).drop(*SLICE_COLUMNS)


#: Ranks in a block of a range-maximum table; a block is one row.
BLOCK_RANKS = 256


class RangeMaximum:
    """Largest value between two ranks of a key, without meeting the rows between.

    Rows (keys, rank, value) are held as blocks of BLOCK_RANKS values; above them a table of
    maxima over 1, 2, 4, ... blocks, each level joined from the one below. A range is then the
    end of one block, the start of another, and two overlapping power-of-two stretches between.
    """

    def __init__(self, rows: DataFrame, keys: Sequence[str], rank: str, value: str):
        self.keys = list(keys)
        block = F.expr(f"`{rank}` div {BLOCK_RANKS}")
        self.blocks = cut_lineage(
            rows.groupBy(*keys, block.alias("_block"))
            .agg(F.sort_array(F.collect_list(F.struct(F.col(rank), F.col(value).alias("_v")))).alias("_values"))
            .select(*keys, "_block", F.col("_values._v").alias("_values"))
        )

    def _levels(self, widest: int) -> DataFrame:
        """(keys, level, block, peak) for stretches of up to `widest` blocks."""
        level = self.blocks.select(*self.keys, "_block", F.array_max("_values").alias("_peak"))
        table, k = level.withColumn("_level", F.lit(0)), 0
        while 2 ** (k + 1) <= widest:
            level = cut_lineage(level)
            ahead = level.select(*self.keys, (F.col("_block") - 2**k).alias("_block"), F.col("_peak").alias("_next"))
            level = level.join(ahead, [*self.keys, "_block"]).select(
                *self.keys, "_block", F.greatest("_peak", "_next").alias("_peak")
            )
            k += 1
            table = table.unionByName(level.withColumn("_level", F.lit(k)))
        return cut_lineage(table)

    def over(self, ranges: DataFrame, low: str, high: str, out: str) -> DataFrame:
        """Add to ranges (keys, low, high) the largest value from rank `low` to `high`, ends included."""
        keys = self.keys
        asked = cut_lineage(
            ranges.withColumn("_b1", F.expr(f"`{low}` div {BLOCK_RANKS}"))
            .withColumn("_b2", F.expr(f"`{high}` div {BLOCK_RANKS}"))
            .withColumn("_between", F.col("_b2") - F.col("_b1") - 1)
        )
        widest = asked.agg(F.max("_between")).first()[0] or 0

        def edge(block: str) -> DataFrame:
            return self.blocks.select(*keys, F.col("_block").alias(block), F.col("_values").alias(f"_in{block}"))

        met = asked.join(edge("_b1"), [*keys, "_b1"]).join(edge("_b2"), [*keys, "_b2"])
        first = F.expr(f"cast(`{low}` % {BLOCK_RANKS} + 1 as int)")
        last = F.expr(f"cast(`{high}` % {BLOCK_RANKS} + 1 as int)")
        alone = F.array_max(F.slice("_in_b1", first, last - first + 1))
        ends = F.greatest(
            F.array_max(F.slice("_in_b1", first, F.lit(BLOCK_RANKS))), F.array_max(F.slice("_in_b2", F.lit(1), last))
        )
        met = met.withColumn("_ends", F.when(F.col("_b1") == F.col("_b2"), alone).otherwise(ends))
        met = met.drop("_in_b1", "_in_b2")
        if widest < 1:
            return met.withColumn(out, F.col("_ends")).drop("_b1", "_b2", "_between", "_ends")
        table = self._levels(widest)
        level = F.when(F.col("_between") > 0, F.floor(F.log2("_between")).cast("int"))
        met = met.withColumn("_level", level)
        for name, block in (("_head", F.col("_b1") + 1), ("_tail", F.expr("_b2 - cast(pow(2, _level) as bigint)"))):
            peaks = table.select(*keys, "_level", F.col("_block").alias(f"{name}_block"), F.col("_peak").alias(name))
            met = met.withColumn(f"{name}_block", block).join(peaks, [*keys, "_level", f"{name}_block"], "left")
        return met.withColumn(out, F.greatest("_ends", "_head", "_tail")).drop(
            "_b1", "_b2", "_between", "_ends", "_level", "_head", "_tail", "_head_block", "_tail_block"
        )


def previous_max(
    df: DataFrame,
    keys: Sequence[str],
    chunks: Sequence[str],
    order: Sequence[str],
    value: str,
    out: str,
) -> DataFrame:
    """Largest `value` over the rows before the current one, per key; NULL on the first."""
    part = [*keys, *chunks]
    before = Window.partitionBy(*keys).orderBy(*chunks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*part)
        .agg(F.max(value).alias("_chunk_max"))
        .select(*part, F.max("_chunk_max").over(before).alias("_carried"))
    )
    within = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.join(offsets, part)
        .withColumn(out, F.greatest("_carried", F.max(value).over(within)))
        .drop("_carried")
    )


def magnitude_bin(value: str) -> Column:
    """Bin of a non-negative number, non-decreasing in it; missing values go lowest.

    Never NULL, so that a join on it adds no test of the whole expression to the scan.
    """
    fine = F.floor(F.log2(F.col(value)) * BINS_PER_OCTAVE).cast("int")
    low = F.when(F.col(value) <= 0, F.lit(ZERO_BIN)).otherwise(F.lit(MISSING_BIN))
    return F.coalesce(fine, low)


def top_percent_mean(
    df: DataFrame,
    keys: Sequence[str],
    rank_by: str,
    out: str,
    value: Callable[[Column], Column] = lambda c: c,
) -> DataFrame:
    """Mean of `value(rank_by)` over each key's top 1 % of rows by `rank_by`.

    Exact, without sorting a key's rows in one task and with few of the rows shuffled:
    a first pass makes a histogram per key (bounded size, combined map-side), from which
    follow the sums of the bins wholly inside the top and the one bin in which it ends.
    While that bin has over EDGE_ROWS rows of differing values for some key, as with
    readings close together, another pass cuts it into SUB_BINS bins of equal width. The
    last pass ranks the distinct values of what is left. The histogram's outcome, one row
    per key, is materialised to know whether it can be broadcast.
    Keys with fewer than 100 rows have an empty top and do not appear. `rank_by` is
    non-negative; rows where it is NULL count as rows and rank last.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(rank_by).alias("_m")).withColumn("_bin", magnitude_bin("_m"))
    worth = value(F.col("_m"))
    bins = rows.groupBy(*keys, "_bin").agg(*_bin_sums(worth))
    return _top_mean(bins, lambda edge: rows.join(edge, [*keys, "_bin"]), keys, out, worth)


def _bin_sums(worth: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("_n"),
        F.sum(worth).alias("_sum"),
        F.count("_m").alias("_known"),
        F.min("_m").alias("_lo"),
        F.max("_m").alias("_hi"),
    ]


def binned_parts(df: DataFrame, part: Sequence[str], rank_by: str) -> DataFrame:
    """A histogram of `rank_by` per part (say a sensor's day) that merges into those of any union of parts."""
    rows = df.select(*part, F.col(rank_by).alias("_m")).withColumn("_bin", magnitude_bin("_m"))
    return rows.groupBy(*part, "_bin").agg(*_bin_sums(F.col("_m")))


def merged_top_percent_mean(
    df: DataFrame, parts: DataFrame, members: DataFrame, part: Sequence[str], keys: Sequence[str], rank_by: str, out: str
) -> DataFrame:
    """`top_percent_mean` over keys that are unions of parts, from the parts' histograms.

    `parts` is `binned_parts` of `df`, `members` has the (keys, part) pairs. Keys may share parts:
    rows of `df` are met only for the bin in which a key's top ends.
    """
    part, keys = list(part), list(keys)
    rows = df.select(*part, F.col(rank_by).alias("_m")).withColumn("_bin", magnitude_bin("_m"))
    sums = [F.sum(c).alias(c) for c in ("_n", "_sum", "_known")]
    bins = parts.join(members, part).groupBy(*keys, "_bin").agg(*sums, F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))

    def met(edge: DataFrame) -> DataFrame:
        return rows.join(members.join(edge, keys), [*part, "_bin"])

    return _top_mean(bins, met, keys, out, F.col("_m"))


def _top_mean(
    bins: DataFrame, met: Callable[[DataFrame], DataFrame], keys: list[str], out: str, worth: Column
) -> DataFrame:
    """The mean of each key's top 1 % from its histogram and, for the bin where it ends, its rows.

    `met(edge)` joins rows with their key's row of `edge` and bin.
    """
    sums = _bin_sums(worth)
    per_key = Window.partitionBy(*keys)
    down = per_key.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, 0)
    counted = bins.withColumn("_k", F.sum("_n").over(per_key))
    counted = counted.withColumn("_k", F.expr("_k div 100"))

    def edge_of(found: DataFrame) -> DataFrame:
        """The bin in which each key's `_k` highest rows end, and the sums of those above."""
        marked = (
            found.withColumn("_upto", F.sum("_n").over(down))
            .withColumn("_over", F.col("_upto") - F.col("_n"))
            .filter(F.col("_over") < F.col("_k"))
        )
        last = F.col("_upto") >= F.col("_k")
        ends = F.max(
            F.when(last, F.struct("_bin", "_lo", "_hi", "_n", (F.col("_k") - F.col("_over")).alias("_need")))
        )
        return marked.groupBy(*keys).agg(
            ends.alias("_e"),
            F.coalesce(F.sum(F.when(~last, F.col("_sum"))), F.lit(0.0)).alias("_whole_sum"),
            F.coalesce(F.sum(F.when(~last, F.col("_known"))), F.lit(0)).alias("_whole_known"),
        ).select(*keys, "_e.*", "_whole_sum", "_whole_known")

    def in_edge(edge: DataFrame) -> DataFrame:
        return met(edge).filter(F.col("_lo").isNull() | F.col("_m").between(F.col("_lo"), F.col("_hi")))

    edge = broadcast_if_small(edge_of(counted))
    while not edge.filter((F.col("_n") > EDGE_ROWS) & (F.col("_hi") > F.col("_lo"))).isEmpty():
        carry = [*keys, "_bin", "_need", "_whole_sum", "_whole_known"]
        width = F.col("_hi").cast("double") - F.col("_lo").cast("double")
        place = F.floor(F.try_divide(F.col("_m").cast("double") - F.col("_lo").cast("double"), width) * SUB_BINS)
        finer = (
            in_edge(edge)
            .withColumn("_sub", F.coalesce(place, F.lit(-1)))
            .groupBy(*carry, "_sub")
            .agg(*sums)
            .select(
                *keys, F.col("_sub").alias("_bin"), F.col("_need").alias("_k"), "_n", "_sum", "_known", "_lo", "_hi"
            )
        )
        old = edge.select(
            *keys, "_bin", F.col("_whole_sum").alias("_old_sum"), F.col("_whole_known").alias("_old_known")
        )
        edge = broadcast_if_small(
            edge_of(finer).drop("_bin").join(old, keys).select(
                *keys, "_bin", "_lo", "_hi", "_n", "_need",
                (F.col("_whole_sum") + F.col("_old_sum")).alias("_whole_sum"),
                (F.col("_whole_known") + F.col("_old_known")).alias("_whole_known"),
            )
        )
    carried = [*keys, "_need", "_whole_sum", "_whole_known"]
    distinct = in_edge(edge).groupBy(*carried, "_m").agg(F.count(F.lit(1)).alias("_n"))
    ranked = per_key.orderBy(F.desc_nulls_last("_m")).rowsBetween(Window.unboundedPreceding, 0)
    take = F.least(F.col("_n"), F.col("_need") - F.col("_over"))
    part = (
        distinct.withColumn("_over", F.sum("_n").over(ranked) - F.col("_n"))
        .withColumn("_take", F.when(F.col("_m").isNotNull(), F.greatest(take, F.lit(0))).otherwise(0))
        .withColumn("_worth", F.coalesce(worth * F.col("_take"), F.lit(0.0)))
    )
    return part.groupBy(*keys).agg(
        F.try_divide(
            F.sum("_worth") + F.first("_whole_sum"), F.sum("_take") + F.first("_whole_known")
        ).alias(out)
    )


def greedy_accept(
    requests: DataFrame, capacity: DataFrame, keys: Sequence[str], seq: str, demand: str
) -> DataFrame:
    """Serve requests in `seq` order per key, skipping those that no longer fit.

    `capacity` has the keys and `room`. Adds `accepted` and `room_left` (the room
    seen by the request; for one that can never fit again, the room left by then). `demand`
    is non-negative. Exact: a first round serves the longest prefix that fits and drops
    what cannot fit any more. Then, while the room stays at or above the power of two below
    it, smaller demands always fit, and of the larger ones the first that fits takes the room below that
    power. So one running total of the smaller demands tells all refusals up to there,
    however many, and each round at least halves the room: the rounds are bounded by
    the bits of the largest demand.
    """
    keys = list(keys)
    open_rows = requests.join(capacity.select(*keys, F.col("room").alias("_g_room")), keys, "left")
    open_rows = open_rows.withColumn("_g_room", F.coalesce("_g_room", F.lit(0)))
    need, room = F.col(demand), F.col("_g_room")
    run = running_sum(open_rows, keys, [], [seq], demand, "_g_cum")
    fits = F.col("_g_cum") <= room
    used = run.groupBy(*keys).agg(F.coalesce(F.max(F.when(fits, F.col("_g_cum"))), F.lit(0)).alias("_g_used"))
    left = room - F.col("_g_used")
    judged = cut_lineage(
        run.join(used, keys)
        .withColumn("accepted", F.when(fits, True).when(need > left, False))
        .withColumn("room_left", F.when(fits, room - F.col("_g_cum") + need).otherwise(left))
        .select(*requests.columns, left.alias("_g_room"), "accepted", "room_left")
    )
    decided = judged.filter(F.col("accepted").isNotNull()).drop("_g_room")
    while True:
        rest = judged.filter(F.col("accepted").isNull()).select(*requests.columns, "_g_room")
        if rest.isEmpty():
            return decided
        power = F.when(room > 0, F.pow(F.lit(2.0), F.floor(F.log2(room.cast("double"))))).otherwise(F.lit(1.0))
        rest = rest.withColumn("_g_power", power).withColumn(
            "_g_small", F.when(need < F.col("_g_power"), need).otherwise(need - need)
        )
        run = running_sum(rest, keys, [], [seq], "_g_small", "_g_cum")
        run = run.withColumn("_g_seen", room - F.col("_g_cum") + F.col("_g_small"))
        small = need < F.col("_g_power")
        # the first demand that brings the room below the power ends the round
        ends = F.when(small, F.col("_g_seen") - need < F.col("_g_power")).otherwise(need <= F.col("_g_seen"))
        last = F.min_by(F.struct(F.col(seq).alias("at"), (F.col("_g_seen") - need).alias("left")), seq)
        ended = run.filter(ends).groupBy(*keys).agg(last.alias("_g_end"))
        before = F.col("_g_end").isNull() | (F.col(seq) <= F.col("_g_end.at"))
        gone = need > F.col("_g_end.left")
        judged = cut_lineage(
            run.join(ended, keys, "left")
            .withColumn("accepted", F.when(before, need <= F.col("_g_seen")).when(gone, False))
            .withColumn("room_left", F.when(before, F.col("_g_seen")).otherwise(F.col("_g_end.left")))
            .select(*requests.columns, F.col("_g_end.left").alias("_g_room"), "accepted", "room_left")
        )
        decided = decided.unionByName(judged.filter(F.col("accepted").isNotNull()).drop("_g_room"))


def settle(
    candidates: DataFrame,
    judge: Callable[[DataFrame], DataFrame],
    groups: Sequence[str] = (),
    touched: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Judge candidates whose verdicts depend on earlier candidates' verdicts.

    `judge` gets the candidates with the verdicts so far (`previous`, NULL =
    accepted) and adds `reason`, looking only at existing rows and at earlier
    candidates whose `previous` is NULL. Rounds repeat until nothing changes. As a
    verdict depends on strictly earlier candidates only, settled verdicts are those
    of adding the candidates one by one, whatever `previous` is first guessed to be
    (accepted, unless the candidates bring a guess). A first round usually settles
    nearly all; each further round resolves one more link of a dependency chain.

    When verdicts depend on candidates of the same `groups` only, groups without a
    change are finished and leave the rounds. Otherwise `touched(moved, judged)` may
    mark in `todo` the rows that depend on a changed one; `judge` then judges those
    and repeats `previous` for the rest.
    """
    if "previous" not in candidates.columns:
        candidates = candidates.withColumn("previous", F.lit(None).cast("string"))
    current = cut_lineage(candidates.withColumn("todo", F.lit(True)))
    finished: DataFrame | None = None
    while True:
        judged = cut_lineage(judge(current))
        moved = judged.filter(~F.col("previous").eqNullSafe(F.col("reason")))
        last = moved.isEmpty()
        done = judged
        if groups and not last:
            live = moved.select(*groups).distinct()
            done = judged.join(live, list(groups), "left_anti")
            judged = judged.join(live, list(groups), "left_semi")
        if groups or last:
            done = done.drop("previous", "todo")
            finished = done if finished is None else finished.unionByName(done)
        if last:
            return finished
        if touched is not None:
            judged = touched(moved, judged)
        current = judged.drop("previous").withColumnRenamed("reason", "previous")


def reached(nodes: DataFrame) -> DataFrame:
    """(node, reached) of nodes (node, seed, a, b): a seed, or `a` or `b` is reached.

    `a` and `b` are earlier nodes or NULL. Each round drops pointers to nodes that are not reached
    and lets a pointer to a node with a single pointer jump to where that one points, so a chain
    of any length takes a logarithmic number of rounds. A round writes only the nodes still open.
    """
    start = nodes.select("node", F.when(F.col("seed"), True).alias("reached"), "a", "b")
    decided: DataFrame | None = None
    while True:
        none = F.col("a").isNull() & F.col("b").isNull()
        judged = cut_lineage(start.withColumn("reached", F.when(none, F.coalesce("reached", F.lit(False))).otherwise(F.col("reached"))))
        done = judged.filter(F.col("reached").isNotNull()).select("node", "reached")
        left = judged.filter(F.col("reached").isNull())
        decided = done if decided is None else decided.unionByName(done)
        if left.isEmpty():
            return decided
        alone = left.filter(F.col("a").isNull() | F.col("b").isNull())
        # a jump may lead to a node decided some rounds ago, so all decided ones are looked up
        known = decided.withColumn("jump", F.lit(None).cast(left.schema["a"].dataType)).unionByName(
            alone.select("node", "reached", F.coalesce("a", "b").alias("jump"))
        )
        start = left.select("node", "a", "b")
        for side in ("a", "b"):
            facts = known.select(F.col("node").alias(side), *(F.col(c).alias(f"_{side}_{c}") for c in ("reached", "jump")))
            start = looked_up(start, facts, side)
        hit = F.coalesce("_a_reached", F.lit(False)) | F.coalesce("_b_reached", F.lit(False))
        a, b = (
            F.when(F.coalesce(f"_{side}_reached", F.lit(True)), F.coalesce(f"_{side}_jump", side)) for side in ("a", "b")
        )
        start = start.select("node", F.when(hit, True).alias("reached"), a.alias("a"), b.alias("b"))
        start = start.withColumn("b", F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("b")))


def match_ranges(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str
) -> DataFrame:
    """Overlaps of two runs of adjacent ranges per key.

    Each side has the keys, its id column (any type) and `upto`, the end of its
    range; a range starts where the previous one of its side ends, the first at 0.
    All ends are merged and sorted into slices: every piece between neighbouring ends lies in
    one range of each side, the ones ending next. No pairs are formed, so the work
    grows with the sum of both sides. Returns keys, both ids and `amount`.
    """
    ends = sliced(
        left.select(*keys, "upto", F.lit(0).alias("_side"), F.struct("upto", left_id).alias("_left")).unionByName(
            right.select(*keys, "upto", F.lit(1).alias("_side"), F.struct("upto", right_id).alias("_right")),
            allowMissingColumns=True,
        ),
        keys,
        ["upto", "_side"],
    )
    part = [*keys, "_slice"]
    later = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)

    def first(value: Column, kind: DataType, at: Column) -> Column:
        """The first value of a slice. A struct's fields are taken one by one, as its minimum would sort all rows."""
        if isinstance(kind, StructType):
            return F.struct(*(first(value.getField(f.name), f.dataType, at).alias(f.name) for f in kind))
        return F.min_by(value, at)

    totals = [F.max("upto").alias("_upto")]
    for side in ("_left", "_right"):
        there = F.when(F.col(side).isNotNull(), F.col("_at"))
        totals += [F.count(side).alias(f"_n{side}"), first(F.col(side), ends.schema[side].dataType, there).alias(f"_1{side}")]
    around = ends.groupBy(*part).agg(*totals).select(
        *part,
        F.max("_upto").over(_earlier_slices(keys)).alias("_from"),
        *(
            F.first(F.when(F.col(f"_n{side}") > 0, F.col(f"_1{side}")), ignorenulls=True).over(later).alias(out)
            for side, out in (("_left", "_l"), ("_right", "_r"))
        ),
    )
    within = Window.partitionBy(*part).orderBy("_at")
    behind = within.rowsBetween(Window.unboundedPreceding, -1)
    ahead = within.rowsBetween(0, Window.unboundedFollowing)
    pieces = _by_slice(ends, keys).join(around, part).select(
        *keys,
        (F.col("upto") - F.coalesce(F.max("upto").over(behind), F.col("_from"), F.lit(0))).alias("amount"),
        F.coalesce(F.first("_left", ignorenulls=True).over(ahead), F.col("_l")).alias("_left"),
        F.coalesce(F.first("_right", ignorenulls=True).over(ahead), F.col("_r")).alias("_right"),
    )
    return pieces.filter(
        (F.col("amount") > 0) & F.col("_left").isNotNull() & F.col("_right").isNotNull()
    ).select(
        *keys,
        F.col(f"_left.{left_id}").alias(left_id),
        F.col(f"_right.{right_id}").alias(right_id),
        "amount",
    )
