"""Conversation repair, Merkle manifest and repeated passages against brute force and on odd rows."""

import hashlib
import heapq
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stonewatch.llm import conversation_repair as convs
from stonewatch.llm import glr, merkle, mixing, repeats
from stonewatch.llm.common import ship

SPACE = " \t\n\x0b\x0c\r"
FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
CLASHING = (
    "key", "rank", "tree", "idx", "n", "hash", "path", "id", "settled", "from", "to", "piece", "spans", "data",
    "copies", "digest", "blank", "first", "_tie", "kind", "odd name.x",
)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def clash(df):
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHING if c not in df.columns))


def cheapest(rows):
    """(cost, audit, lines) over all edits by uniform-cost search; rows are (role, text, fault)."""
    heap, seen, limit, found = [(0, 0, "", "", ())], set(), None, []
    while heap:
        cost, i, state, audit, lines = heapq.heappop(heap)
        if limit is not None and cost > limit:
            break
        if (i, state, audit) in seen:
            continue
        seen.add((i, state, audit))
        if i == len(rows) and state in ("", "a"):
            limit = cost
            found.append((audit, lines))
        moves = [(2, 0, r, "I", f"{full}:") for r, full in convs.ROLES.items()]
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, i + 1, state, audit + "D", lines))
            if fault in ("none", "truncated"):
                extra = fault == "truncated"
                moves.append((extra, 1, role[:1], "K", f"{role}:{text}"))
                moves += [(2 + extra, 1, r, "R", f"{full}:{text}") for r, full in convs.ROLES.items()]
        for price, step, initial, letter, line in moves:
            if (state, initial) in FOLLOWS:
                heapq.heappush(heap, (cost + price, i + step, FOLLOWS[state, initial], audit + letter, (*lines, line)))
    audit, lines = min(found)
    return limit, audit, lines


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(SPACE)
        if not shown:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("none" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def expected(conv_id, rows):
    """The contract's row for the original rows (turn, role, text) of one conversation."""
    kept = []
    for turn, role, text in rows:
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        role, text, hit = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(hit, text)
        kept += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    found = faults([r[1:] for r in kept])
    cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(kept, found)])
    turns = [t for t, *_ in kept if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
    return (
        conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(found.count(k) for k in convs.FAULTS[1:]),
        sum(p not in convs.PAIRS for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


TURNS = "conv_id long, turn long, role string, text string"


def check_conversations(spark, rows):
    by_id = defaultdict(list)
    for conv_id, *row in rows:
        by_id[conv_id].append(tuple(row))
    df = clash(spark.createDataFrame(rows, TURNS))
    got = {r[0]: tuple(r) for r in convs.repair_digests(convs.damaged(df)).collect()}
    assert got == {c: expected(c, own) for c, own in by_id.items()}


def test_conversations_of_odd_rows(spark):
    rng = random.Random(3)
    texts = ["Hello.", "Hello.", "What", "", " \n", None, "ok!", "long " * 20_000, "Été ? \t"]
    roles = ["user", "assistant", "system", "tool", "", None, "sysadmin"]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 6))]
    rows += [(None, t, "user", "no id.") for t in range(5)] + [(61, 4, "user", "same.")] * 7
    check_conversations(spark, rows)


def test_conversations_of_the_table(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    check_conversations(spark, [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()])


def test_repaired_rows_follow_the_grammar(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes?"), (2, 0, "system", "Be kind."), (2, 1, "user", "And?"), (3, 0, "user", "")]
    got = convs.repair(convs.intact(spark.createDataFrame(rows, TURNS))).orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.role, r.edit) for r in got] == [
        (1, "user", "I"), (1, "assistant", "K"), (1, "user", "K"), (1, "assistant", "I"),
        (2, "system", "K"), (2, "user", "K"), (2, "assistant", "I"),
    ]


def test_no_conversations(spark):
    assert convs.repair_digests(convs.damaged(spark.createDataFrame([], TURNS))).count() == 0


def test_repair_equals_search_over_all_edits():
    machine, rng = convs.repairer(), random.Random(1)
    for _ in range(1500):
        kinds = [(rng.choice("ssuua?"), rng.choice(("none", "none", "none", "blank", "duplicate", "truncated"))) for _ in range(rng.randint(0, 6))]
        cost, audit, _ = cheapest([(i, "", f) for i, f in kinds])
        assert machine.best(convs.token(*k) for k in reversed(kinds)) == (cost, audit)


def test_grammars_with_growing_stacks_are_refused():
    rules = [("c", ("l",)), ("l", ("l", "u")), ("l", ("u",))]
    with pytest.raises(ValueError, match="right-recursive"):
        glr.Repair(rules, {0: [("u", 0, "K")]}, [("u", 1, "I")]).best([0])


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spelt(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels_of(hashes, arity):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + arity])) for i in range(0, len(last), arity)])
    return levels


def proof_of(levels, at, arity):
    """(before, after) of each level from a leaf up."""
    steps = []
    for level in levels[:-1]:
        first = at - at % arity
        steps.append((level[first:at], level[at + 1 : first + arity]))
        at //= arity
    return steps


def check_manifest(spark, rows, arity):
    by_source = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        head = spelt(doc_id) + spelt(source) + spelt(lang) + spelt(n_chars)
        forged = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            forged = text.replace("\n", "")
        leaf, claim = digest(head + spelt(text)), digest(head + spelt(forged))
        by_source[(source is not None, (source or "").encode())].append((doc_id is not None, doc_id or 0, leaf, doc_id, claim))
    trees, want = [], Counter()
    for source in sorted(by_source):
        leaves = sorted(by_source[source], key=lambda x: x[:3])
        trees.append((leaves, levels_of([x[2] for x in leaves], arity)))
    top = levels_of([levels[-1][0] for _, levels in trees], arity)
    for at, (leaves, levels) in enumerate(trees):
        for i, (_, _, leaf, doc_id, claim) in enumerate(leaves):
            steps, node = proof_of(levels, i, arity) + proof_of(top, at, arity), claim
            for before, after in steps:
                node = digest("".join([*before, node, *after]))
            met = "".join(h for before, after in steps for h in [*before, *after])
            want[(doc_id, leaf, levels[-1][0], top[-1][0], digest(met), node, node == top[-1][0])] += 1
    got = Counter(tuple(r) for r in merkle.verified_manifest(clash(spark.createDataFrame(rows, DOCS)), arity).collect())
    assert got == want


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_of_odd_rows(spark, arity):
    rows = [
        (None, "a", None, None, None), (None, None, "en", 3, "x\ny"), (1, None, "en", 3, "x\ny"), (1, None, "en", 3, "x\ny"),
        (2, "", "en", 0, ""), (3, "é", "fr", 2, "é\n"), (3, "é", "fr", 2, "è\n"), (4, "z", "de", 9, "w\n" * 30_000),
    ]
    rows += [(i, "hot", "en", i, f"text {i}\nmore\n") for i in range(100, 137)] + [(7, "a", "en", 1, "same\n")] * 4
    check_manifest(spark, rows, arity)


def test_no_manifest(spark):
    assert merkle.verified_manifest(spark.createDataFrame([], DOCS)).count() == 0


def removed_by_hand(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for text in texts:
        gone = np.zeros(len(text), dtype=bool)
        for i in range(len(text) - window + 1):
            if seen[text[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int(gone.sum() and (np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((len(text), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(text, np.uint8)[~gone])).hexdigest()))
    return out


def check_repeats(spark, texts, window=400):
    rows = [(i % 17 if i % 5 else None, t) for i, t in enumerate(texts)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string"))
    want = removed_by_hand([(t or "").encode() for t in texts], window)
    got = Counter(tuple(r) for r in repeats.remove_repeats(df, window=window).collect())
    assert got == Counter((doc_id, *w) for (doc_id, _), w in zip(rows, want, strict=True))


def words(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlué", k=rng.randint(2, 8))) for _ in range(n))


def test_repeats_of_odd_rows(spark):
    rng = random.Random(5)
    passage, base = words(rng, 110), words(rng, 300)
    texts = [None, "", "short", "x" * 399, "x" * 400, "y" * 2500, "ab" * 900, base, base, base[1:], passage]
    texts += [words(rng, rng.randint(0, 90)) + passage[rng.randint(0, 99) : 540 + rng.randint(0, 60)] + words(rng, 60) for _ in range(30)]
    for _ in range(40):  # near copies: a few words changed
        parts = base.split(" ")
        for _ in range(rng.randint(1, 3)):
            parts[rng.randrange(len(parts))] = words(rng, 1)
        texts.append(" ".join(parts))
    check_repeats(spark, texts)


def test_repeats_at_the_limit(spark):
    """Strings of one byte less stay; of exactly the window go, at either end of a text."""
    rng = random.Random(6)
    piece = "".join(rng.choices("abcdefgh", k=400))
    noise = ["".join(rng.choices("ijklmnop", k=300)) for _ in range(6)]
    texts = [piece + noise[0], noise[1] + piece, noise[2] + piece[1:] + noise[3], noise[4] + piece[:-1] + noise[5], noise[1]]
    check_repeats(spark, texts)


def test_blocks_do_not_change_runs():
    rng = np.random.default_rng(1)
    data, ends = rng.integers(0, 3, 5000).astype(np.uint8), np.array([900, 901, 1500, 5000])
    tiled = {}
    for block in (64, 1024, 8192):
        starts = {}
        for anchors, first, last, grams in repeats.runs_of(data, ends, 40, 8, block):
            for a, lo, hi, g in zip(anchors, first, last, grams):
                assert lo <= a <= lo + 32 and a + 8 <= hi + 40
                starts |= {s: g for s in range(lo, hi + 1)}
        tiled[block] = sorted(starts)
    want = [s for s in range(5000) if ends[np.searchsorted(ends, s, side="right")] - s >= 40]
    assert tiled[64] == tiled[1024] == tiled[8192] == want


def test_no_repeats(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("value", [None, 7])
def test_mix_whatever_the_other_columns_are_called(spark, value):
    """A column `rid` of the input, null or the same in all rows, changes nothing and is kept."""
    rng = random.Random(8)
    rows = [(i, f"s{i % 4}", "en", 0, words(rng, rng.randint(0, 300))) for i in range(60)]
    plain = spark.createDataFrame(rows, DOCS)
    named = plain.select("*", *(F.lit(value).cast("long").alias(c) for c in ("rid", "block", "doc", "row", "spans", "text_")))
    want = Counter(tuple(r) for r in mixing.mix(plain).collect())
    assert Counter(tuple(r) for r in mixing.mix(named).collect()) == want
    assert all(r[-1] <= 3 * r[1] for r in want) and sum(r[-1] for r in want.elements()) > 0
    mixed = {r.doc_id: r for r in mixing.mixed_documents(named).collect()}
    texts = {r.doc_id: r.text for r in mixing.mixed_documents(plain).collect()}
    assert {d: r.text for d, r in mixed.items()} == texts and {r.rid for r in mixed.values()} == {value}
    assert {r[0]: r[-1] for r in want if r[-1]} == {d: len(t.split()) for d, t in texts.items()}
