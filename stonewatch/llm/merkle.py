"""Merkle manifest of a dataset by sibling-shift self-joins.

Every row is a leaf: the digest of its columns in a fixed encoding. The leaves of a source
form a tree of a given arity, the roots of the sources' trees form one tree above them. On
every level nodes (tree, idx, hash) are joined with themselves by the indices of their
siblings: idx XOR 1 in a binary tree, else the other slots of the node's run,
idx - slot + (slot + k) % arity. Nodes of slot zero then have all digests of their run
and emit the parent. What a node has met is its step of the proof; from the root down each node
puts its own step before its parent's, so a leaf's whole proof comes from one join a level
and the levels together hold little more rows than the leaves.

Indices are dealt without gathering a source: rows are sorted by range over all partitions,
numbered where they lie, and offset by the totals of the partitions before. Join keys
(tree, idx) are unique, so a source with any share of the rows spreads like all others.
Levels are written to the shared folder.

Digests are lowercase hex SHA-256 of their inputs concatenated, digests as hex text; they
are stored as 32 bytes. A null column is encoded as `-`, any other as its UTF-8 byte count, `:`
and its value. Null sources form a tree of their own, before all others; null ids come first in
their source. Rows of equal source and id are ordered by digest, equal digests in any order.
Repeated rows are leaves each. An empty table gives an empty result. Columns besides those
encoded are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonewatch.llm.common import stage

ENCODED = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3


def digest(text: Column) -> Column:
    """SHA-256 of a text, 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digest_of(*nodes: Column) -> Column:
    """The digest over digests, which enter as hex text."""
    return digest(F.lower(F.hex(F.concat(*nodes))))


def hex_text(node: str | Column) -> Column:
    return F.lower(F.hex(node))


def encoded(values: Sequence[Column]) -> Column:
    """The columns in order, each `-` if null, else byte count, `:`, value."""
    return F.concat(
        *(
            F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
            for v in values
        )
    )


def numbered(rows: DataFrame, tree: str, order: Sequence[str], label: str) -> DataFrame:
    """Add `idx`, 0 up per tree in the given order, and `n`, the tree's row count.

    Rows are range-partitioned by (tree, order, a running id), so that neither a large tree
    nor a value with many rows meets in one task. `tree` must not be null.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sort = [F.col(tree), *(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    dealt = stage(
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.spark_partition_id())
        .drop("_tie"),
        label,
    )
    whole = Window.partitionBy(tree)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        dealt.groupBy(tree, "_part")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        .withColumn("_skip", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("n", F.sum("_rows").over(whole))
    )
    return (
        dealt.join(stage(pieces.drop("_rows"), f"{label}-pieces"), [tree, "_part"])
        .withColumn("idx", F.col("_at") - F.col("_first") + F.col("_skip"))
        .drop("_at", "_part", "_first", "_skip")
    )


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Join nodes (tree, idx, n, hash) with their siblings: adds `left` and `right`, the digests
    of the run's other nodes before and after each, concatenated."""
    slot = F.col("idx") % arity
    met = nodes
    for k in range(1, arity):
        sibling = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + (slot + k) % arity
        other = nodes.select("tree", F.col("idx").alias(f"_at{k}"), F.col("hash").alias(f"_hash{k}"))
        met = met.withColumn(f"_at{k}", sibling).join(other, ["tree", f"_at{k}"], "left")
    none = F.lit(b"")

    def side(before: bool) -> Column:
        """The siblings of one side; ascending shifts are ascending slots on either side."""
        taken = [
            F.when((slot + k >= arity) if before else (slot + k < arity), F.coalesce(f"_hash{k}", none)).otherwise(none)
            for k in range(1, arity)
        ]
        return F.concat(none, *taken)

    return met.select("tree", "idx", "n", "hash", side(True).alias("left"), side(False).alias("right"))


def grow(leaves: DataFrame, arity: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees over `leaves` (tree, idx, n, hash), and the roots (tree, hash).

    Level k holds the nodes, with siblings, of the trees that have several nodes there.
    """
    if arity < 2:
        raise ValueError("a tree needs an arity of 2 or more")
    nodes, levels = leaves.select("tree", "idx", "n", "hash"), []
    widest = nodes.agg(F.max("n")).first()[0] or 0
    roots = nodes.filter("n = 1").select("tree", "hash")
    while widest > 1:
        level = stage(with_siblings(nodes.filter("n > 1"), arity), f"{label}-level")
        levels.append(level)
        nodes = level.filter(F.col("idx") % arity == 0).select(
            "tree",
            F.expr(f"idx div {arity}").alias("idx"),
            F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            digest_of(F.col("hash"), F.col("right")).alias("hash"),
        )
        roots = roots.unionByName(nodes.filter("n = 1").select("tree", "hash"))
        widest = -(-widest // arity)
    return levels, stage(roots, f"{label}-roots")


NO_STEPS = "cast(array() as array<struct<left: binary, right: binary>>)"


def proofs(levels: list[DataFrame], tops: DataFrame, carried: Sequence[str], arity: int) -> DataFrame:
    """(tree, idx, path, *carried) of every leaf, from the trees' roots down.

    `tops` has a row per tree with what the path goes on with above the root (`path`) and
    further columns that every leaf of the tree gets. A tree lower than others starts below.
    """
    keep = ["path", *carried]
    below = tops.withColumn("idx", F.lit(0).cast("long")).select("tree", "idx", *keep)
    if not levels:
        return below
    height = None
    for level in levels:  # the number of levels that a tree has
        seen = level.filter("idx = 0").select("tree", F.lit(1).alias("_one"))
        height = seen if height is None else height.unionByName(seen)
    height = stage(height.groupBy("tree").agg(F.sum("_one").alias("_height")), "heights")
    starts = below.join(height, "tree", "left").withColumn("_height", F.coalesce("_height", F.lit(0)))
    met = starts.filter(F.col("_height") == len(levels)).drop("_height")
    for at in range(len(levels) - 1, -1, -1):
        above = met.withColumnRenamed("idx", "_up")
        met = (
            levels[at]
            .select("tree", "idx", F.expr(f"idx div {arity}").alias("_up"), F.array(F.struct("left", "right")).alias("_step"))
            .join(above, ["tree", "_up"])
            .select("tree", "idx", F.concat("_step", "path").alias("path"), *carried)
        )
        met = met.unionByName(starts.filter(F.col("_height") == at).drop("_height"))
    return met


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of a proof lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest_of(step["left"], node, step["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a proof, level by level, left to right."""
    steps = F.transform(path, lambda step: hex_text(F.concat(step["left"], step["right"])))
    return digest(F.array_join(steps, ""))


def manifest(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """Add `subroot`, `root` and `path` (the proof) to rows with `source`, `doc_id` and `hash`.

    Column names beginning with `_` and tree, idx, n, path, subroot and root are the operator's own.
    """
    # null sources come first: no other key is empty, and keys sort like the sources
    keyed = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    placed = stage(numbered(keyed, "tree", ["doc_id", "hash"], "leaves"), "numbered")
    levels, roots = grow(placed, arity, "source")
    sources = numbered(
        roots.select(F.lit("all").alias("tree"), F.col("tree").alias("of"), "hash"), "tree", ["of"], "sources"
    )
    sources = stage(sources, "subroots")
    upper, top = grow(sources, arity, "upper")
    top = top.select("tree", F.expr(NO_STEPS).alias("path"), F.col("hash").alias("root"))
    above = sources.join(proofs(upper, top, ["root"], arity), ["tree", "idx"])
    tops = stage(above.select(F.col("of").alias("tree"), "path", "root", F.col("hash").alias("subroot")), "tops")
    found = proofs(levels, tops, ["root", "subroot"], arity)
    return placed.join(found, ["tree", "idx"]).drop("tree", "idx", "n")


def tampered_text() -> Column:
    """The text without its line feeds where 2 divides crc32(doc_id as decimal)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def verified_manifest(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Every document's place in the manifest, and whether its tampered form still proves it.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    names = [c for c in ENCODED if c != "text"]
    plain = [F.col(c) for c in names]
    leaves = docs.select(
        "doc_id",
        "source",
        digest(encoded([*plain, F.col("text")])).alias("hash"),
        digest(encoded([*plain, tampered_text()])).alias("claimed"),
    )
    proven = manifest(leaves, arity).withColumn("folded", folded(F.col("claimed"), F.col("path")))
    return proven.select(
        "doc_id",
        hex_text("hash").alias("leaf"),
        hex_text("subroot").alias("subroot"),
        hex_text("root").alias("root"),
        hex_text(proof_digest(F.col("path"))).alias("proof_sha256"),
        hex_text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
