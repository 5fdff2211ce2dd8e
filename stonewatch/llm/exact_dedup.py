"""Exact duplicates by two-pass Bloom filtering; only possibly repeated rows are shuffled.

Texts are equal when identical after replacing each run of white space by one space; they
are compared by the SHA-256 of that text. Pass one counts the slots that all hashes fall
into and keeps a bit for each slot hit twice or more; pass two does so with another hash
among the rows whose first bit is set. Rows without both bits are certainly unique and
pass straight through; the others are grouped by the full hash, which settles them exactly.

The bit tables are built by map-side combined counts of slot numbers and broadcast in
blocks of 4 KB. They hold BITS_PER_ROW bits a row and MAX_BITS (32 MB) at most: beyond
that more unique rows are taken for possible repeats, and the result stays exact.

Null texts count as empty texts and are equal to them. Null ids come after all others.
Repeated rows are copies like any other: exactly one row of a group stays, also when ids
are equal. Empty tables give empty results; extra columns are ignored (`deduplicate`
keeps them, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import SPACES, attach, stage, text_of

BITS_PER_ROW = 16
MAX_BITS = 2**28
BLOCK_BITS = 32_768


def text_hash(column: str = "text") -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(column), SPACES, " ").cast("binary"), 256))


def filter_bits(rows: int) -> int:
    """Bits of a filter over so many rows: a power of two between one block and MAX_BITS."""
    bits = BLOCK_BITS
    while bits < min(rows * BITS_PER_ROW, MAX_BITS):
        bits *= 2
    return bits


def _slot(key: Column, bits: int, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit(bits - 1)) + 1


def repeated_slots(keys: DataFrame, bits: int, seed: int) -> DataFrame:
    """Blocks (block, bits) with a bit for each slot that two or more rows of `key` fall into."""
    counts = keys.groupBy(_slot(F.col("key"), bits, seed).alias("slot")).agg(F.count("*").alias("n"))
    return (
        counts.filter("n >= 2")
        .groupBy(F.bitmap_bucket_number("slot").alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )


def test_slot(rows: DataFrame, key: Column, blocks: DataFrame, bits: int, seed: int, out: str) -> DataFrame:
    """Add whether the row's bit is set. The blocks are at most MAX_BITS / 8 bytes together."""
    slot = _slot(key, bits, seed)
    at = F.bitmap_bit_position(slot)
    marked = rows.withColumn("_block", F.bitmap_bucket_number(slot)).withColumn("_at", at)
    joined = marked.join(
        F.broadcast(blocks.select(F.col("block").alias("_block"), F.col("bits").alias("_bits"))), "_block", "left"
    )
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("cast(shiftleft(1, cast(_at % 8 as int)) as int)")
    return joined.withColumn(out, F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))).drop(
        "_block", "_at", "_bits"
    )


test_slot.__test__ = False


def possible_repeats(hashed: DataFrame, total: int) -> tuple[DataFrame, DataFrame, int]:
    """The two filters over a staged frame with a binary column `key`, and their size in bits."""
    bits = filter_bits(total)
    first = stage(repeated_slots(hashed.select("key"), bits, 1), "bloom1")
    passed = test_slot(hashed.select("key"), F.col("key"), first, bits, 1, "_p").filter("_p").select("key")
    second = stage(repeated_slots(passed, bits, 2), "bloom2")
    return first, second, bits


def _maybe(rows: DataFrame, key: Column, filters: tuple[DataFrame, DataFrame, int]) -> DataFrame:
    first, second, bits = filters
    both = test_slot(test_slot(rows, key, first, bits, 1, "_p1"), key, second, bits, 2, "_p2")
    return both.withColumn("_maybe", F.col("_p1") & F.col("_p2")).drop("_p1", "_p2")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = stage(
        docs.select(
            F.col(id_column).alias("doc_id"),
            text_hash(text_column).alias("key"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "hashes",
    )
    total = hashed.count()
    rows = stage(_maybe(hashed, F.col("key"), possible_repeats(hashed, total)), "routed")
    alone = rows.filter("not _maybe").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "key",
    )
    shared = rows.filter("_maybe").select("doc_id", "key", "rid")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid"))
    groups = stage(
        shared.groupBy("key").agg(first.alias("first"), F.count("*").alias("group_size")), "groups"
    )
    settled = attach(shared, groups, ["key"], "group_size", total).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        "key",
    )
    return alone.unionByName(settled).withColumn("text_sha256", F.lower(F.hex("key"))).drop("key")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Unique rows are passed on where they lie; possible repeats are reduced to the row of
    the smallest id per text by one map-side combined aggregation. Of rows that share id
    and text, the one with the smallest hash of its raw text stays.
    """
    key = text_hash(text_column)
    hashed = stage(docs.select(key.alias("key")), "hashes")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    packed = docs.select(row.alias("row"), key.alias("key"), F.col(f"`{id_column}`").alias("id"),
                         F.xxhash64(F.col(f"`{text_column}`")).alias("tie"))
    routed = _maybe(packed, F.col("key"), possible_repeats(hashed, hashed.count()))
    alone = routed.filter("not _maybe").select("row")
    shared = (
        routed.filter("_maybe")
        .groupBy("key")
        .agg(F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"), F.col("tie"))).alias("row"))
        .select("row")
    )
    return alone.unionByName(shared).select("row.*")
