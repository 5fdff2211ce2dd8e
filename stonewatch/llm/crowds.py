"""Similar sets within large groups, by blocks against blocks.

The members of a group are dealt into blocks of about BLOCK members, or fewer when their sets are large
(BLOCK_ELEMENTS elements together). Each two blocks meet in one task, and each block meets itself: a member is
written once for each block of its group, so a group of one block is written once. In a task the
sizes of all intersections are a product of two tables of members by elements, a few elements at a
time; elements that one member alone has are left out. Of the pairs that reach the similarity only
those that join members of different labels are given, one for each join.

No pair is dropped and no group is capped. All pairs of a group are counted, BLOCK by BLOCK in
bounded memory; rows and links grow with the members, times the blocks of their group. Elements are
64-bit hashes; callers confirm the links on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import frugal, stage

BLOCK = 1024
BLOCK_ELEMENTS = 2**20
#: Elements of a table of members by elements.
COLUMNS = 2048


def crowd_links(members: DataFrame, percent: int) -> list[DataFrame]:
    """Staged links (a, b), a < b, that join all members of a group which links within it join.

    members (staged): g, rid, label (members of one label are joined already), size and elements
    (distinct) of the set.
    """
    if members.isEmpty():
        return []
    return [stage(_settled(_dealt(members), percent), "crowd-links")]


def _dealt(members: DataFrame) -> DataFrame:
    """A row (low, high, block) of each member for each block that its own one meets, itself included."""
    blocks = members.groupBy("g").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).alias("blocks")
    )
    placed = members.join(stage(blocks, "crowd-blocks"), "g")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rid", F.lit(1)), "blocks"))
    met = placed.withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select(
        "g", F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high"),
        "block", "rid", "label", "size", "elements",
    )


def _settled(dealt: DataFrame, percent: int) -> DataFrame:
    """Links that join the members of each two blocks."""
    one = F.struct("block", "rid", "label", "size", "elements")
    pairs = dealt.groupBy("g", "low", "high").agg(F.collect_list(one).alias("rows")).select("low", "high", "rows")

    @frugal
    def joined(batches):
        for batch in batches:
            for low, high, rows in zip(*batch.columns):
                rows, low, high = rows.values, low.as_py(), high.as_py()
                blocks, ids, labels, sizes = (
                    rows.field(c).to_numpy() for c in ("block", "rid", "label", "size")
                )
                sets = rows.field("elements")
                a, b = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
                shared = _shared(sets.take(pa.array(a)), sets.take(pa.array(b)))
                linked = (shared > 0) & ((100 + percent) * shared >= percent * (sizes[a][:, None] + sizes[b]))
                i, j = _joining(linked, labels[a], labels[b])
                x, y = ids[a[i]], ids[b[j]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y), pa.int64()), pa.array(np.maximum(x, y), pa.int64())], ["a", "b"]
                )

    return pairs.mapInArrow(joined, "a long, b long").distinct()


def _shared(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Sizes of the intersections of each left with each right set."""
    owners = [np.repeat(np.arange(len(s)), s.value_lengths().to_numpy()) for s in (left, right)]
    values = [s.flatten().to_numpy() for s in (left, right)]
    both = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    counts = np.zeros((len(left), len(right)), np.int64)
    places = []
    for owner, value in zip(owners, values):
        at = np.searchsorted(both, value)
        known = at < len(both)
        known[known] = both[at[known]] == value[known]
        at, owner = at[known], owner[known]
        order = np.argsort(at, kind="stable")
        places.append((at[order], owner[order]))
    for start in range(0, len(both), COLUMNS):
        tables = []
        for (at, owner), n in zip(places, counts.shape):
            a, b = np.searchsorted(at, (start, start + COLUMNS))
            table = np.zeros((n, COLUMNS), np.float32)
            table[owner[a:b], at[a:b] - start] = 1
            tables.append(table)
        counts += (tables[0] @ tables[1].T).astype(np.int64)
    return counts


def _joining(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the linked pairs, as many as join the labels that they join."""
    names, codes = np.unique(np.concatenate((left, right)), return_inverse=True)
    i, j = np.nonzero(linked & (left[:, None] != right))
    x, y = codes[: len(left)][i], codes[len(left) :][j]
    pair = np.full((len(names), len(names)), -1, np.int64)
    pair[x, y] = pair[y, x] = np.arange(len(i))
    left_over, chosen = np.ones(len(names), bool), []
    for root in range(len(names)):
        if not left_over[root]:
            continue
        left_over[root], reached = False, [root]
        while reached:
            at = reached.pop()
            new = np.flatnonzero(left_over & (pair[at] >= 0))
            left_over[new] = False
            chosen.append(pair[at, new])
            reached.extend(new.tolist())
    chosen = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
    return i[chosen], j[chosen]
