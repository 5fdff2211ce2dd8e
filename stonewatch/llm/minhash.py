"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Texts (A-Z lower-cased) are cut into words and sets of distinct two-word shingles. A first
permutation places each shingle on a circle of CIRCLE places; a second one gives each place a
value, and coordinate k of the signature is the smallest value found k places further on. So
two permutations give all COORDINATES, and a shingle's values are one contiguous slice.

Equal sets are one class, linked without further work. Classes that agree on all ROWS
coordinates of one of BANDS bands share a bucket. No pair within a bucket is left out:

1. every class is compared with the bucket's pivot, the class whose buckets hold most rows;
2. links found so far give components; buckets that lie in one component are done;
3. buckets of more than CROWD classes that are still open are settled together with those of the same pivot,
   whatever their size: blocks of sets meet, and only links that join components are kept (see `crowds`);
4. in the others, the classes outside the bucket's most frequent component are compared
   with the classes of another component. First each takes the one most like it, which joins
   most of them to the rest; then steps 2 and 4 are done again with all pairs that are
   still open, fewer than CROWD for each class and bucket. Pairs of one component need no comparison,
   so every pair in a bucket is settled. A pair is settled in the first bucket that it shares.

Comparisons of steps 1 and 4 look at set sizes and a byte of each coordinate first; pairs whose estimate is
more than SLACK under the threshold (four standard deviations) are out, the others are
verified on the full sets of both texts. Hot buckets, centres and classes meet their rows in
joins of staged tables, which adaptive execution splits. A pair with the threshold's similarity shares no bucket with
probability (1 - 0.8**ROWS)**BANDS, about 3 in a million.

Null and empty texts, and texts without words, have empty sets and are linked with nothing; a
text of one word has that word as its only shingle. Null ids come after all others: their
component is named by the smallest id in it, or null. Repeated rows are copies. Empty tables
give empty results; extra columns are ignored (`drop_near_duplicates` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import frugal, stage, text_of
from stonewatch.llm.components import components
from stonewatch.llm.crowds import crowd_links
from stonewatch.llm.exact_dedup import BLOCK_BITS, MAX_BITS, test_slot
from stonewatch.llm.token_counts import slices

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
CIRCLE = 2**20
SEED = 7
PERCENT = 80
SLACK = 0.13
BLOCK_CLASSES = 256
CROWD = 64
PAIRS_A_TASK = 512


@lru_cache(1)
def circle() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the second one's values with its start repeated at the end,
    seen as one slice per place."""
    rng = np.random.default_rng(SEED)
    first = rng.permutation(CIRCLE).astype(np.uint32)
    second = rng.permutation(CIRCLE).astype(np.uint32)
    turned = np.concatenate((second, second[: COORDINATES - 1]))
    return first, np.lib.stride_tricks.sliding_window_view(turned, COORDINATES)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    data = b"\n".join(parts).lower() + b"\n"  # bytes: A-Z only
    raw = np.frombuffer(data, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before = np.concatenate(([True], blank[:-1]))
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    at = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    offsets = np.append(np.stack((starts, ends), 1).ravel(), len(data)).astype(np.int64)
    every = pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
    )
    words = every.take(pa.array(np.arange(0, len(every), 2))).dictionary_encode()
    distinct = words.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[words.indices.to_numpy()]
    pairs = _spread(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + _spread(hashes[1:]))
    alone = _spread(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out.append(np.unique(pairs[a : b - 1]) if b - a > 1 else alone[a:b])
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    first, slices_of = circle()
    places = first[(hashes >> np.uint64(13)).astype(np.int64) & (CIRCLE - 1)]
    low = np.full(COORDINATES, CIRCLE, np.uint32)
    for i in range(0, len(places), 2048):
        low = np.minimum(low, slices_of[places[i : i + 2048]].min(axis=0))
    return low


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bands = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for r in range(ROWS):
        key = _spread(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return key.view(np.int64)


_SKETCHED = "rid long, doc_id long, n_shingles long, class_key binary, bands array<long>, sketch binary"


def sketched(docs: DataFrame) -> DataFrame:
    """Set size, class key, band keys and sketch of each row of (rid, doc_id, text)."""

    @frugal
    def made(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            done = 0
            for texts in slices(batch.column(2).to_pylist()):
                sets = shingles(texts)
                signatures = np.stack([signature(s) for s in sets])
                keys, low = band_keys(signatures), signatures.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(texts)),
                        batch.column(1).slice(done, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([k if len(s) else [] for k, s in zip(keys, sets)], pa.list_(pa.int64())),
                        pa.array([x.tobytes() if len(s) else None for x, s in zip(low, sets)], pa.binary()),
                    ],
                    ["rid", "doc_id", "n_shingles", "class_key", "bands", "sketch"],
                )
                done += len(texts)

    return docs.select("rid", "doc_id", text_of().alias("text")).mapInArrow(made, _SKETCHED)


def likely(sizes_a, sizes_b, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs can reach the similarity, by size and by matching sketch bytes."""
    fits = np.minimum(sizes_a, sizes_b) * 100 >= percent * np.maximum(sizes_a, sizes_b)
    # an unequal coordinate still matches in its byte once in 256
    estimate = ((a == b).mean(axis=-1) - 1 / 256) * 256 / 255
    return fits & (estimate >= percent / 100 - SLACK)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def word_set(text: str) -> set:
    words = text.encode("utf-8", "replace").lower().split()
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


def is_link(a: set, b: set, percent: int) -> bool:
    shared = len(a & b)
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def bucket_members(banded: DataFrame) -> DataFrame:
    """(bucket, rid, n, pivot) of shared buckets. The pivot is the class whose buckets are largest
    in all, so that the buckets of one group of copies mostly have one pivot, near its middle."""
    sizes = stage(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = stage(banded.join(sizes, "bucket"), "shared")
    reach = stage(shared.groupBy("rid").agg(F.sum("n").alias("reach")), "reach")
    pivots = shared.join(reach, "rid").groupBy("bucket").agg(
        F.max_by("rid", F.struct("reach", -F.col("rid"))).alias("pivot")
    )
    return stage(shared.join(pivots, "bucket"), "members")


def crowds(members: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Classes of the buckets of over CROWD classes, grouped by pivot, with their sets; groups that
    lie in one component are left out."""
    grouped = members.filter(F.col("n") > CROWD).select(F.col("pivot").alias("g"), "rid").distinct()
    grouped = grouped.join(labels.withColumnRenamed("node", "rid"), "rid", "left")
    grouped = stage(grouped.select("g", "rid", F.coalesce("label", "rid").alias("label")), "crowd-labels")
    still_open = grouped.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    grouped = stage(grouped.join(still_open.filter("low <> high").select("g"), "g"), "crowd-open")
    needed = stage(grouped.select("rid").distinct(), "needed")
    texts = possibly(docs.select("rid", text_of().alias("text")), needed, "rid").join(needed, "rid", "left_semi")

    @frugal
    def cut(batches):
        for batch in batches:
            done = 0
            for part in slices(batch.column(1).to_pylist()):
                sets = [s.view(np.int64) for s in shingles(part)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(part)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sets, pa.list_(pa.int64())),
                    ],
                    ["rid", "size", "elements"],
                )
                done += len(part)

    sets = stage(texts.mapInArrow(cut, "rid long, size long, elements array<long>"), "crowd-sets")
    return stage(grouped.join(sets, "rid"), "crowd")


def star_pairs(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) of each class with the pivot of each of its buckets."""
    pairs = stage(
        members.filter("rid <> pivot").select(F.col("pivot").alias("a"), F.col("rid").alias("b")).distinct(), "star"
    )
    facts = lambda s: classes.select(
        F.col("rid").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")
    )
    known = pairs.join(facts("b"), "b").join(facts("a"), "a")

    @frugal
    def tested(batches):
        for batch in batches:
            if batch.num_rows:
                n = lambda c: batch.column(c).to_numpy()
                good = likely(n("na"), n("nb"), _sketches(batch.column("sa")), _sketches(batch.column("sb")), percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return known.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(tested, "a long, b long")


def cross_pairs(
    members: DataFrame, classes: DataFrame, labels: DataFrame, percent: int, best_only: bool
) -> DataFrame:
    """Likely pairs (a, b) between components that meet in a bucket, by blocks against blocks.

    `best_only`: of each class outside its bucket's largest component, only the likeliest
    partner. Pairs come once, from the first bucket that both classes share.
    """
    known = members.filter(f"n > 2 and n <= {CROWD}").join(labels.withColumnRenamed("node", "rid"), "rid", "left")
    known = stage(known.select("bucket", "rid", F.coalesce("label", "rid").alias("label")), "labelled")
    open_buckets = known.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = stage(known.join(open_buckets.filter("low <> high").select("bucket"), "bucket"), "mixed")
    per_label = mixed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    buckets = stage(
        per_label.groupBy("bucket").agg(
            F.max_by("label", F.struct("n", "label")).alias("most"),
            F.sum("n").alias("n"),
            (F.sum("n") - F.max("n")).alias("others"),
        ),
        "open-buckets",
    )
    facts = mixed.join(buckets, "bucket").join(classes.select("rid", "n_shingles", "sketch", "bands"), "rid")

    def blocks(frame: DataFrame, size: str, out: str) -> DataFrame:
        count = F.ceil(F.col(size) / F.lit(BLOCK_CLASSES))
        one = F.struct("rid", "label", "n_shingles", "sketch", "bands")
        return (
            frame.withColumn(out, F.pmod(F.xxhash64("rid", F.lit(out)), count))
            .groupBy("bucket", out, "n")
            .agg(F.collect_list(one).alias(f"{out}_rows"))
        )

    everything = blocks(facts, "n", "block")
    outside = blocks(facts.filter("label <> most"), "others", "outer")
    spread = outside.withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.lit(BLOCK_CLASSES)) - 1))
    )
    met = everything.drop("n").join(spread.drop("n"), ["bucket", "block"])

    @frugal
    def compared(batches):
        for batch in batches:
            found = [
                _open_pairs(bucket.as_py(), x.values, y.values, percent, best_only)
                for bucket, x, y in zip(*batch.columns)
            ]
            rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["a", "b", "matches"])

    made = met.select("bucket", "outer_rows", "block_rows").mapInArrow(compared, "a long, b long, matches long")
    if best_only:
        made = made.groupBy("a").agg(F.max_by("b", F.struct("matches", "b")).alias("b"))
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _open_pairs(bucket: int, outer: pa.Array, block: pa.Array, percent: int, best_only: bool) -> np.ndarray:
    """Likely pairs (outer, other, matching bytes) of differing labels first met in this bucket."""
    col = lambda v, c: v.field(c).to_numpy()
    keys = lambda v: v.field("bands").flatten().to_numpy().reshape(-1, BANDS)
    a, b, ka, kb = _sketches(outer.field("sketch")), _sketches(block.field("sketch")), keys(outer), keys(block)
    ids, labels, sizes = (col(block, c) for c in ("rid", "label", "n_shingles"))
    found = []
    for i, (rid, label, size) in enumerate(zip(*(col(outer, c).tolist() for c in ("rid", "label", "n_shingles")))):
        j = np.flatnonzero(labels != label)
        same = ka[i] == kb[j]
        j = j[ka[i][same.argmax(axis=1)] == bucket]
        j = j[likely(size, sizes[j], a[i], b[j], percent)]
        matches = (a[i] == b[j]).sum(axis=1)
        if best_only and len(j):
            top = matches.argmax()
            j, matches = j[top : top + 1], matches[top : top + 1]
        found.append(np.stack((np.full(len(j), rid), ids[j], matches), 1))
    return np.concatenate(found)


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (staged) whose full sets reach the similarity.

    Only texts that pairs name are shuffled: the others are kept back by a bit filter of
    bounded size. A text in many pairs is handed to several tasks, PAIRS_A_TASK pairs each.
    """
    times = stage(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).alias("parts")), "parts")
    named = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    needed = stage(named.select(F.col("a").alias("rid")), "needed")
    texts = stage(
        possibly(docs.select("rid", text_of().alias("text")), needed, "rid").join(needed, "rid", "left_semi"), "texts"
    )
    left = (
        times.join(texts.withColumnRenamed("rid", "a"), "a")
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .select("a", "part", F.col("text").alias("text_a"))
    )
    dealt = pairs.select("a", "b").join(times, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    both = dealt.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")), "b").join(left, ["a", "part"])

    @frugal
    def checked(batches):
        last, own = None, set()
        for batch in batches:
            good = []
            for a, ta, tb in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if a != last:
                    last, own = a, word_set(ta)
                good.append(is_link(own, word_set(tb), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(checked, "a long, b long")


def possibly(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among `keys`, by a broadcast bit filter of MAX_BITS at most."""
    blocks, bits = key_filter(keys, key)
    return test_slot(rows, F.col(key), blocks, bits, 3, "_maybe").filter("_maybe").drop("_maybe")


def key_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    bits = BLOCK_BITS
    while bits < min(16 * keys.count(), MAX_BITS):
        bits *= 2
    slot = F.xxhash64(F.col(key), F.lit(3)).bitwiseAND(F.lit(bits - 1)) + 1
    slots = keys.select(slot.alias("slot")).distinct()
    blocks = slots.groupBy(F.bitmap_bucket_number("slot").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    return stage(blocks, "filter"), bits


def near_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(rid, doc_id, n_shingles, component_id, kept) of staged rows (rid, doc_id, text).

    kept: the row of the smallest id of its component (of equal ids, the smallest rid).
    """
    rows = stage(sketched(docs), "sketches")
    narrow = rows.select("rid", "doc_id", "n_shingles", "class_key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid"))
    groups = stage(
        narrow.filter("class_key is not null").groupBy("class_key").agg(first.alias("first")), "classes"
    )
    classes = stage(
        rows.join(groups.select(F.col("first.rid").alias("rid")), "rid").select("rid", "n_shingles", "sketch", "bands"),
        "class-rows",
    )
    banded = classes.select("rid", F.explode("bands").alias("bucket"))
    members = bucket_members(banded)
    links = stage(verified(stage(star_pairs(members, classes, percent), "likely"), docs, percent), "links")
    labels = components(links)
    crowded = crowds(members, labels, docs)
    if not crowded.isEmpty():
        more = stage(reduce(DataFrame.unionByName, crowd_links(crowded, percent)).distinct(), "likely")
        added = stage(verified(more, docs, percent), "links")
        links = stage(links.unionByName(added), "links")
        labels = components(links)
    for best_only in (True, False):
        more = stage(cross_pairs(members, classes, labels, percent, best_only), "likely")
        if more.isEmpty():
            break
        added = stage(verified(more, docs, percent), "links")
        if not added.isEmpty():
            links = stage(links.unionByName(added), "links")
            labels = components(links)
    named = groups.select("class_key", "first", F.col("first.rid").alias("node")).join(labels, "node", "left")
    named = stage(named.withColumn("label", F.coalesce("label", "node")), "named")
    smallest = stage(named.groupBy("label").agg(F.min("first").alias("head")), "heads")
    placed = named.join(smallest, "label").select("class_key", "head")
    grouped = narrow.filter("class_key is not null").join(stage(placed, "placed"), "class_key")
    found = grouped.select(
        "rid", "doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"),
        (F.col("rid") == F.col("head.rid")).alias("kept"),
    )
    alone = narrow.filter("class_key is null").select(
        "rid", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return found.unionByName(alone)


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.col(f"`{text_column}`").alias("text"),
    )
    return near_components(stage(rows, "docs"), percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(
    docs: DataFrame, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The documents that stay, one of each component, with all their columns.

    Rows that no dropped row's bit matches are passed on without a shuffle.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    kept = stage(docs.select(F.monotonically_increasing_id().alias("rid"), row.alias("row")), "docs")
    rows = kept.select(
        "rid", F.col("row")[id_column].cast("long").alias("doc_id"), F.col("row")[text_column].alias("text")
    )
    gone = stage(near_components(rows, percent).filter("not kept").select("rid"), "gone")
    blocks, bits = key_filter(gone, "rid")
    marked = test_slot(kept, F.col("rid"), blocks, bits, 3, "_maybe")
    passed = marked.filter("not _maybe").select("rid", "row")
    doubtful = marked.filter("_maybe").select("rid", "row").join(gone, "rid", "left_anti")
    return passed.unionByName(doubtful).select("row.*")
