"""Mixing sources to target weights by blocks of words.

Every source's documents are laid end to end (in an order that hashes fix) and cut into
blocks of BLOCK words. A source's target gives its number of output slots. Slots are dealt to
output shards by drawing each shard's counts per source from a multinomial law under the
condition that the totals are met: a range of shards is halved again and again, each half
drawing its share, so a shard finds its own counts, and how many slots of each source come
before it, in as many draws as there are halvings, without the other shards. A source's slot
j takes block p(j mod blocks) in round j div blocks, where p is a keyed pseudorandom
permutation of the source's block numbers. Slots and documents meet by (source, block).

Targets: sources in code point order (null last) weigh 1, 2, 3 and so on in turn and share the
sum of all sizes; a target stops at MAX_TIMES times its source's size and the excess is shared
out again by weight. A block is taken at most MAX_TIMES times, hence so is a document.

Null texts have size 0 and are never taken; null sources are one source; null ids and
repeated rows are documents like others; empty tables give empty results; extra columns are
ignored (`mixed_documents` keeps them). One number per source passes through the driver.
All draws are seeded, so reruns agree.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonewatch.llm.common import attach, frugal, stage
from stonewatch.llm.quality import words_of

BLOCK = 64
SHARD_SLOTS = 8192
MAX_TIMES = 3
WEIGHTS = (1, 2, 3)
SEED = 20_240_601
MIN_CHUNKS, MAX_CHUNKS, CHUNK_DOCS = 512, 2**20, 4096
EXACT_DRAW = 10**9

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: Sequence[int], weights: Sequence[int], times: int = MAX_TIMES) -> list[float]:
    """Shares of the total by weight, none above `times` its size.

    Sharing an excess by weight keeps all uncapped targets in proportion to their weights, so
    the capped sources are the first ones by size to weight.
    """
    total, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: Fraction(times * sizes[i], weights[i]))
    for place, i in enumerate(order):
        if times * sizes[i] * weight > total * weights[i]:
            for k in order[place:]:
                out[k] = total * weights[k] / weight
            break
        out[i] = float(times * sizes[i])
        total -= times * sizes[i]
        weight -= weights[i]
    return out


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permuted(index: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each index under its source's keyed permutation of 0 to size - 1.

    Four rounds of a balanced Feistel network over the next even number of bits; a place
    beyond the size is permuted again until it lies within.
    """
    sizes = sizes.astype(np.uint64)
    bits = np.ceil(np.log2(np.maximum(sizes, 2).astype(np.float64)) / 2 + 1e-9).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.flatnonzero(sizes > 1)
    while len(todo):
        x, b, m, k = out[todo], bits[todo], mask[todo], keys[todo].astype(np.uint64)
        left, right = x >> b, x & m
        for turn in range(4):
            left, right = right, left ^ (mixed_bits(right + k * np.uint64(0x10001) + np.uint64(turn << 56)) & m)
        out[todo] = (left << b) | right
        todo = todo[out[todo] >= sizes[todo]]
    return out.astype(np.int64)


def draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of `n` slots drawn from `counts` fall to each source; over EXACT_DRAW slots the
    normal approximation serves, kept within what exists."""
    if counts.sum() < EXACT_DRAW:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out = np.zeros_like(counts)
    rest, left = int(counts.sum()), n
    for i, c in enumerate(counts.tolist()):
        p = c / rest if rest else 0.0
        spread = (left * p * (1 - p) * (rest - left) / max(rest - 1, 1)) ** 0.5
        low, high = max(0, left - (rest - c)), min(c, left)
        out[i] = min(max(round(left * p + spread * rng.standard_normal()), low), high)
        rest -= c
        left -= int(out[i])
    return out


def shard_counts(shard: int, shards: int, slots: np.ndarray, per_shard: int, seed: int):
    """(slots of each source before the shard, slots in it)."""
    total = int(slots.sum())
    low, high, counts, before = 0, shards, slots.copy(), np.zeros_like(slots)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = draw(rng, counts, min(middle * per_shard, total) - low * per_shard)
        if shard < middle:
            high, counts = middle, left
        else:
            low, counts, before = middle, counts - left, before + left
    return before, counts


class Recipe:
    """Numbers of a mix: one entry per source."""

    def __init__(self, sources: Sequence[str | None], sizes: Sequence[int], block: int, seed: int, times: int):
        self.sources, self.sizes, self.block, self.seed = list(sources), list(sizes), block, seed
        weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]
        self.targets = targets(self.sizes, weights, times)
        self.blocks = [-(-s // block) for s in self.sizes]
        # blocks are counted by their mean size, as a source's last one may be short
        self.slots = [
            min(round(t * b / s), times * b) if s else 0 for s, t, b in zip(self.sizes, self.targets, self.blocks)
        ]


def source_key(column: str | Column = "source") -> Column:
    source = (F.col(f"`{column}`") if isinstance(column, str) else column).cast("string")
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def sized(rows: DataFrame, rid: Column, doc_id: Column, text: Column, source: Column) -> DataFrame:
    """The rows' number, id, source, words, and a place that depends on id and text alone."""
    return rows.select(
        rid.alias("rid"),
        doc_id.alias("doc_id"),
        source_key(source).alias("source_key"),
        F.size(words_of(F.coalesce(text, F.lit("")))).cast("long").alias("size"),
        F.xxhash64(doc_id, text).alias("place"),
    )


def recipe_of(rows: DataFrame, block: int = BLOCK, seed: int = SEED, times: int = MAX_TIMES):
    """The recipe, and its table by source_key; one row per source is collected."""
    found = rows.groupBy("source_key").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    found.sort(key=lambda r: (r["source_key"] == "", r["source_key"]))
    recipe = Recipe([r["source_key"] for r in found], [r["size"] for r in found], block, seed, times)
    lines = [
        (r["source_key"], i, r["size"], float(recipe.targets[i]), r["docs"]) for i, r in enumerate(found)
    ]
    made = rows.sparkSession.createDataFrame(
        lines, "source_key string, source_no long, source_size long, target double, source_docs long"
    )
    return recipe, made


def placed(rows: DataFrame, sources: DataFrame, total: int) -> DataFrame:
    """Rows with source_no, target and `start`, the words of their source before them.

    Documents are dealt to chunks by hash; a running sum within a chunk and one over the
    chunks of a source replace a running sum over the whole source.
    """
    chunks = MIN_CHUNKS
    while chunks < MAX_CHUNKS and chunks * CHUNK_DOCS < total:
        chunks *= 2
    known = attach(rows, sources, ["source_key"], "source_docs", total)
    dealt = known.withColumn("chunk", F.col("place").bitwiseAND(F.lit(chunks - 1)))
    within = (
        Window.partitionBy("source_no", "chunk").orderBy("place", "doc_id", "rid")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    across = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
        .select("source_no", "chunk", F.coalesce(F.sum("words").over(across), F.lit(0)).alias("chunk_start"))
    )
    return (
        dealt.withColumn("inner_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(starts, ["source_no", "chunk"])
        .withColumn("start", F.col("chunk_start") + F.col("inner_start"))
        .drop("chunk", "inner_start", "chunk_start", "place")
    )


def picks(spark, recipe: Recipe, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """All output slots: shard, slot, source_no, block, round."""
    slots, blocks = np.array(recipe.slots, np.int64), np.array(recipe.blocks, np.int64)
    seed = recipe.seed
    shards = max(1, -(-int(slots.sum()) // shard_slots))

    @frugal
    def fill(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                before, counts = shard_counts(shard, shards, slots, shard_slots, seed)
                source = np.repeat(np.arange(len(slots)), counts)
                ends = np.cumsum(counts)
                index = np.arange(len(source)) - np.repeat(ends - counts - before, counts)
                n = blocks[source]
                block = permuted(index % np.maximum(n, 1), n, source + seed)
                order = np.random.default_rng([seed, shard]).permutation(len(source))
                columns = [
                    np.full(len(source), shard), shard * shard_slots + np.arange(len(source)),
                    source[order], block[order], (index // np.maximum(n, 1))[order],
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["shard", "slot", "source_no", "block", "round"]
                )

    return spark.range(shards).mapInArrow(fill, "shard long, slot long, source_no long, block long, round long")


def doc_blocks(rows: DataFrame, block: int) -> DataFrame:
    """A row per document and block it lies in: word numbers `from` up to `to` of the document."""
    end = F.col("start") + F.col("size")
    spread = rows.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    )
    return spread.select(
        "rid",
        "source_no",
        "block",
        (F.greatest(F.col("block") * block, F.col("start")) - F.col("start")).alias("from"),
        (F.least((F.col("block") + 1) * block, end) - F.col("start")).alias("to"),
    )


def mix(
    docs: DataFrame,
    block: int = BLOCK,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken."""
    cells = [F.col(f"`{c}`") for c in (id_column, text_column, source_column)]
    rows = stage(sized(docs, F.monotonically_increasing_id(), *cells), "sizes")
    recipe, sources = recipe_of(rows, block, seed)
    known = stage(placed(rows, sources, rows.count()), "placed")
    times = picks(docs.sparkSession, recipe).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    taken = (
        doc_blocks(known, block)
        # the planner sees a row per shard and would broadcast the slots: name the join
        .join(times.hint("merge"), ["source_no", "block"])
        .groupBy("rid")
        .agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).alias("taken"))
    )
    return known.join(taken, "rid", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def cut_words(text: str, spans: Sequence[tuple[int, int, int]]) -> str:
    """The words of (round, from, to) spans: neighbouring spans of a round keep the text
    between them; rounds and runs stand on lines of their own."""
    places = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for turn, a, b in sorted(spans):
        if runs and runs[-1][0] == turn and runs[-1][2] == a:
            runs[-1][2] = b
        else:
            runs.append([turn, a, b])
    return "\n".join(
        text if (a, b) == (0, len(places)) else text[places[a][0] : places[b - 1][1]] for _, a, b in runs
    )


def mixed_documents(
    docs: DataFrame,
    block: int = BLOCK,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    chars_column: str = "n_chars",
) -> DataFrame:
    """The mix as documents: each document that is taken, with the words taken of it.

    All columns stay; text holds the taken words (a second round follows the first), and the
    column of character counts, where there is one, is set anew.
    """
    # the user's columns are kept in a struct of their own, whatever their names
    whole = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns))
    kept = stage(docs.select(F.monotonically_increasing_id().alias("rid"), whole.alias("doc")), "mix-docs")
    cells = [F.col("doc")[c] for c in (id_column, text_column, source_column)]
    rows = stage(sized(kept, F.col("rid"), *cells), "sizes")
    recipe, sources = recipe_of(rows, block, seed)
    known = placed(rows, sources, rows.count())
    spans = (
        doc_blocks(known, block)
        .join(
            picks(docs.sparkSession, recipe).select("source_no", "block", "round").hint("merge"), ["source_no", "block"]
        )
        .groupBy("rid")
        .agg(F.collect_list(F.struct("round", "from", "to")).alias("spans"))
    )

    @frugal
    def cut(batches):
        for batch in batches:
            texts = [
                cut_words(t, [(s["round"], s["from"], s["to"]) for s in spans])
                for t, spans in zip(batch.column("text_").to_pylist(), batch.column("spans").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string())], ["row", "text_"]
            )

    others = [c for c in docs.columns if c not in (text_column, chars_column)]
    row = F.struct(F.lit(0).alias("_"), *(F.col("doc")[c].alias(c) for c in others))
    text = F.coalesce(F.col("doc")[text_column], F.lit(""))
    joined = kept.select("rid", row.alias("row"), text.alias("text_")).join(spans, "rid")
    joined = joined.select("row", "text_", "spans")
    made = joined.mapInArrow(cut, joined.select("row", "text_").schema)

    def column(name: str) -> Column:
        if name == text_column:
            return F.col("text_").alias(name)
        if name == chars_column:
            return F.length("text_").cast(docs.schema[name].dataType).alias(name)
        return F.col("row")[name].alias(name)

    return made.select(*(column(c) for c in docs.columns))
