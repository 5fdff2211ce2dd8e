"""Repeated passages removed: prefix doubling over runs of neighbouring positions.

Texts are UTF-8 bytes. Every byte goes that a string of WINDOW bytes covers which also starts
anywhere else, in the same document or another. A window is known by its start; starts
are ranked by ever longer shared strings, and leave once their rank is unique.

Doubling over every byte would sort one row a byte and round. Here neighbouring starts are
ranked together, as a run:

- Anchors. The first rank of a window is its smallest hashed GRAM-byte string, which
  equal windows have in the same place. Neighbouring windows mostly share that place, the anchor,
  and make one run: the windows that start `lo` to `hi` bytes before it. Runs tile all windows.
- Settled at once. Runs with the same anchor string, bounds and covering text repeat as a whole;
  one of them goes on standing for all. Runs whose anchor string occurs in one such class
  only are done.
- Rounds. What is left is cut at fixed distances from the anchor into pieces of ever fewer
  starts (PIECES). All windows of a piece share a string that grows from round to round, from
  GRAM bytes to the whole window. A piece is ranked by the pair (rank of the string shared so far,
  what it grows by): a rank with one piece is unique, and gone; pieces that are equal to
  both ends repeat, and one stands for all; the others are cut again. In the last round a
  piece is one start and its string the window, which settles it.

A round's rows are the ends of repeated passages, not their bytes, and carry only the bytes that
are not yet ranked. Groups of any size are reduced by map-side combined aggregations;
joins are between staged tables, so that adaptive execution splits a rank with any share of
the rows. Ranks are 128 bits. Bit filters of bounded size keep anchor strings that occur
once, and texts with nothing to settle, out of the shuffles.

Null texts count as empty. Texts below WINDOW bytes keep everything. Equal rows, null or repeated
ids are documents like any other; the row of each input row comes back. Empty tables give
empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import discard, frugal, stage, text_of
from stonewatch.llm.exact_dedup import filter_bits, repeated_slots, test_slot
from stonewatch.llm.minhash import key_filter

WINDOW = 400
GRAM = 32
#: Starts in a piece, by round. The last must be 1.
PIECES = (128, 32, 8, 1)
#: Windows looked at together in a task; a power of two.
BLOCK = 2**19

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` bytes from each position, by doubling the length hashed. `gram` is a power of two."""
    hashes, factor, length = data.astype(np.uint64) + np.uint64(1), _MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while length < gram:
            hashes = hashes[:-length] * factor + hashes[length:]
            factor, length = factor * factor, 2 * length
        hashes ^= hashes >> np.uint64(31)
        hashes *= _MIX
        hashes ^= hashes >> np.uint64(29)
    return hashes


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` neighbours, by doubling the width."""
    at = 1
    while 2 * at <= width:
        values = np.minimum(values[:-at], values[at:])
        at *= 2
    return values if at == width else np.minimum(values[: len(values) - (width - at)], values[width - at :])


def runs_of(
    data: np.ndarray, ends: np.ndarray, window: int, gram: int, block: int = BLOCK
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first start, last start, gram hash) of all runs in concatenated texts.

    `ends` has the end of each text. Windows lie within a text. Blocks of windows bound the
    memory; a run cut by a block is two runs, which changes no result.
    """
    if len(data) < window:
        return
    low = np.uint64(block * 2 - 1)
    for first in range(0, len(data) - window + 1, block):
        piece = data[first : first + block + window - 1]
        hashes = gram_hashes(piece, gram)
        placed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        anchors = (sliding_minimum(placed, window - gram + 1) & low).astype(np.int64)
        starts = np.arange(first, first + len(anchors), dtype=np.int64)
        text = np.searchsorted(ends, starts, side="right")
        inside = ends[text] - starts >= window
        starts, text, anchors = starts[inside], text[inside], anchors[inside]
        if not len(starts):
            continue
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
        opens = np.flatnonzero(new)
        closes = np.append(opens[1:], len(starts)) - 1
        at = anchors[opens]
        yield at + first, starts[opens], starts[closes], hashes[at]


RUNS = "key binary, anchor long, lo int, hi int, gram long, name long"


def _runs(window: int, gram: int):
    schema = pa.schema(
        [("key", pa.binary()), ("anchor", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()),
         ("gram", pa.int64()), ("name", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            texts = batch.column(1).to_pylist()
            joined = b"".join(texts)
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            ends = np.cumsum(sizes)
            data = np.frombuffer(joined, dtype=np.uint8)
            del texts
            for anchors, first, last, grams in runs_of(data, ends, window, gram):
                text = np.searchsorted(ends, first, side="right")
                names = np.fromiter(
                    (xxhash.xxh3_64_intdigest(joined[a : b + window]) for a, b in zip(first.tolist(), last.tolist(), strict=True)),
                    dtype=np.uint64,
                    count=len(first),
                )
                yield pa.record_batch(
                    [
                        keys.take(pa.array(text)),
                        pa.array(anchors - (ends - sizes)[text]),
                        pa.array((anchors - last).astype(np.int32)),
                        pa.array((anchors - first).astype(np.int32)),
                        pa.array(grams.view(np.int64)),
                        pa.array(names.view(np.int64)),
                    ],
                    schema=schema,
                )

    return frugal(run)


def _keyed(docs: DataFrame, text_column: str) -> DataFrame:
    data = text_of(f"`{text_column}`").cast("binary")
    return docs.select(F.unhex(F.md5(data)).alias("key"), data.alias("data"))


def _marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Add `_maybe`: whether the row's key may be among the keys. The filter is at most MAX_BITS."""
    blocks, bits = key_filter(keys, key)
    return test_slot(rows, F.col(key), blocks, bits, 3, "_maybe")


def repeated_spans(docs: DataFrame, text_column: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, first, last): spans of bytes that repeated windows cover, per text.

    `key` is the MD5 of the text. Spans of a text may overlap.
    """
    if gram & (gram - 1) or not 0 < gram <= window:
        raise ValueError("gram must be a power of two within the window")
    far = window - gram
    texts = _keyed(docs, text_column).filter(F.length("data") >= window)
    runs = stage(texts.mapInArrow(_runs(window, gram), RUNS), "runs")
    # anchor strings that certainly occur once are unique: two slots never share a gram
    bits = filter_bits(runs.count())
    slots = stage(repeated_slots(runs.select(F.col("gram").alias("key")), bits, 1), "gram-slots")
    runs_left = test_slot(runs, F.col("gram"), slots, bits, 1, "_maybe").filter("_maybe").drop("_maybe")
    same = ["gram", "lo", "hi", "name"]
    classes = stage(
        runs_left.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("key", "anchor")).alias("one")), "classes"
    )
    whole = stage(classes.filter("n > 1").select(*same), "whole")
    ends = [(F.col("anchor") - F.col("hi")).alias("first"), (F.col("anchor") - F.col("lo") + window).alias("last")]
    covered = stage(runs_left.join(whole, same).select("key", *ends).distinct(), "covered")
    discard(runs, slots, whole)
    # anchor strings with several classes, one of them open
    open_grams = stage(
        classes.groupBy("gram")
        .agg(F.count("*").alias("_n"), F.min("n").alias("_least"))
        .filter("_n > 1 and _least = 1")
        .select("gram"),
        "grams",
    )
    left = classes.join(open_grams, "gram").select(
        F.monotonically_increasing_id().alias("id"), "gram", "lo", "hi", "one.key", "one.anchor", (F.col("n") > 1).alias("settled")
    )
    taken = stage(left, "open")
    discard(classes, open_grams)
    wanted = taken.groupBy("key").agg(F.collect_list(F.struct("id", "gram", "lo", "hi", "anchor", "settled")).alias("runs"))
    # one text of each content: copies are reduced before the shuffle
    needed = _marked(texts, taken.select("key").distinct(), "key").filter("_maybe")
    before = F.substring(F.col("data"), (F.col("r.anchor") - F.col("r.hi") + 1).cast("int"), F.col("r.hi"))
    after = F.substring(F.col("data"), (F.col("r.anchor") + gram + 1).cast("int"), far - F.col("r.lo"))
    rows = (
        needed.groupBy("key")
        .agg(F.first("data").alias("data"))
        .join(wanted, "key")
        .select("data", F.explode("runs").alias("r"))
        .select(
            "r.id", "r.settled", F.col("r.lo").alias("from"), F.col("r.hi").alias("to"),
            F.lit(0).alias("low"), F.lit(far).alias("high"), F.col("r.gram").alias("r1"), F.col("r.gram").alias("r2"),
            before.alias("left"), after.alias("right"),
        )
    )
    spans = covered
    for size in PIECES:
        rows, found = _round(rows, size)
        spans = spans.unionByName(
            found.join(taken, "id").select(
                "key", (F.col("anchor") - F.col("to")).alias("first"), (F.col("anchor") - F.col("from") + window).alias("last")
            )
        )
    return spans


def _round(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Cut pieces into pieces of `size` starts and rank them: pieces still open, and starts found.

    A piece stands for the starts `from` to `to` of the frame `low` to `high`. `r1, r2` name
    the string that all windows of the frame share; `left` and `right` are the bytes that the
    piece's windows have before and after it.
    """
    pieces = F.sequence(F.expr(f"cast(`from` div {size} as int)"), F.expr(f"cast(`to` div {size} as int)"))
    cut = rows.withColumn("piece", F.explode(pieces))
    cut = cut.withColumn("_low", F.col("piece") * size)
    cut = cut.withColumn("_high", F.least(F.col("_low") + (size - 1), F.col("high")))
    cut = cut.withColumn("_from", F.greatest("from", "_low")).withColumn("_to", F.least("to", "_high"))
    # what the shared string grows by, and what is left besides
    grown = [
        F.substring(F.col("left"), F.col("to") - F.col("_low") + 1, F.col("_low") - F.col("low")),
        F.substring(F.col("right"), F.lit(1), F.col("high") - F.col("_high")),
    ]
    rest = [
        F.substring(F.col("left"), F.col("to") - F.col("_to") + 1, F.col("_to") - F.col("_low")),
        F.substring(F.col("right"), F.col("high") - F.col("_high") + 1, F.col("_high") - F.col("_from")),
    ]
    ranked = cut.select(
        "id", "settled", F.col("_from").alias("from"), F.col("_to").alias("to"), F.col("_low").alias("low"),
        F.col("_high").alias("high"), F.xxhash64("r1", "piece", *grown).alias("r1"),
        F.xxhash64(F.lit("b"), "r2", "piece", *grown).alias("r2"), rest[0].alias("left"), rest[1].alias("right"),
    )
    inner = ["from", "to", "left", "right"]
    named = ranked.withColumn("e1", F.xxhash64("r1", *inner)).withColumn("e2", F.xxhash64(F.lit("b"), "r2", *inner))
    if size == 1:
        named = named.drop("left", "right")
    named = stage(named, "pieces")
    rank, equal = ["r1", "r2"], ["e1", "e2"]
    met = named.groupBy(*rank, *equal).agg(
        F.min("id").alias("id"), ((F.min("id") < F.max("id")) | F.bool_or("settled")).alias("settled")
    )
    met = stage(met, "equal")
    found = stage(
        named.filter("not settled").select("id", "from", "to", *equal).join(met.filter("settled").select(*equal), equal).drop(*equal),
        "found",
    )
    if size == 1:
        discard(named, met)
        return found, found
    open_ranks = stage(
        met.groupBy(*rank).agg(F.count("*").alias("_n"), F.bool_and("settled").alias("_all")).filter("_n > 1 and not _all").select(*rank),
        "ranks",
    )
    stand = met.join(open_ranks, rank).select("id", *equal, "settled")
    left = stage(named.drop("settled").join(stand, ["id", *equal]).drop(*equal), "left")
    discard(named, met, open_ranks)
    return left, found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for data, spans in zip(batch.column("data"), batch.column("spans"), strict=True):
            text, merged = data.as_py(), merge(sorted((s["first"], s["last"]) for s in spans.as_py() or ()))
            rest, at = hashlib.sha256(), 0
            for first, last in merged:
                rest.update(text[at:first])
                at = last
            rest.update(text[at:])
            for column, value in zip(
                out, (len(text), sum(b - a for a, b in merged), len(merged), rest.hexdigest()), strict=True
            ):
                column.append(value)
        yield pa.record_batch(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, with those that overlap or touch made one."""
    merged: list[tuple[int, int]] = []
    for first, last in spans:
        if merged and first <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


def with_spans(docs: DataFrame, text_column: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Add `spans`, the byte spans (first, last) to remove from each text; null where none is.

    Spans of a text may overlap and come in any order; `merge` makes them runs.
    """
    spans = repeated_spans(docs, text_column, window, gram)
    per_text = stage(spans.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    data = text_of(f"`{text_column}`").cast("binary")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    marked = _marked(docs.select(row.alias("row"), F.unhex(F.md5(data)).alias("key")), per_text, "key")
    # texts that nothing is removed from mostly pass straight through
    alone = marked.filter("not _maybe").select("row", F.lit(None).cast(per_text.schema["spans"].dataType).alias("spans"))
    met = marked.filter("_maybe").join(per_text, "key", "left").select("row", "spans")
    return alone.unionByName(met).select("row.*", "spans")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    plain = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    marked = with_spans(plain, "text", window).select("doc_id", text_of("text").cast("binary").alias("data"), "spans")
    kind = dict(marked.dtypes)["doc_id"]
    return marked.mapInArrow(
        frugal(_cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
