"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stonewatch.llm import (
    components,
    exact_dedup,
    html_extract,
    minhash,
    mixing,
    packing,
    quality,
    secrets,
    token_counts,
    toxicity,
    transducer,
    url_filter,
)
from stonewatch.llm.common import attach, ship, stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = "rid long, key string, size long, row string, `odd name.x` string, label long, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def odd_rows():
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, "a b  c", "en", "s1", 6),
        (2, "a b\tc", "en", "s1", 6),
        (3, "A b c", None, None, None),
        (4, None, "en", "s1", 0),
        (5, "", "en", None, 0),
        (6, " \n ", "de", "s2", 3),
        (None, "a b c", "en", "s1", 5),
        (None, None, None, None, None),
        (7, long_text, "en", "s2", len(long_text)),
        (8, "a b c", "en", "s3", 5),
        (8, "a b c", "en", "s3", 5),
        (9, "x" * 50_000, "en", "s2", 50_000),
        (10, "<|endoftext|> it's <|startoftext|>", "en", "s2", 30),
        (11, "na\u00efve \u00c5ngstr\u00f6m \u03a3\u0391\u03a3 \U0001f923", "fr", "s2", 20),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    plain = spark.createDataFrame(odd_rows(), DOCS)
    return plain.select("*", *(F.lit(None).cast(c.split(" ")[-1]).alias(c.rsplit(" ", 1)[0].strip("`")) for c in CLASHING.split(", ")))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


def test_exact_duplicates_of_odd_rows(odd):
    rows = exact_dedup.exact_duplicates(odd).collect()
    assert len(rows) == len(odd_rows())
    groups = defaultdict(list)
    for doc_id, text, *_ in odd_rows():
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(doc_id)
    assert Counter(r["text_sha256"] for r in rows) == {k: len(v) for k, v in groups.items()}
    for r in rows:
        ids = groups[r["text_sha256"]]
        named = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (min(named) if named else None)
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert all(kept[k] == 1 for k in groups)


def test_deduplicate_keeps_columns_and_one_row_a_text(odd, empty):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 6, 7, 9, 10, 11]
    assert exact_dedup.deduplicate(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_full_filter_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_BITS", 2**15)
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))).alias("text")
    )
    got = exact_dedup.exact_duplicates(docs)
    assert got.filter("kept").count() == 40_000 - 13_334 + 1
    assert got.agg(F.max("group_size")).first()[0] == 13_334


def test_attach_splits_hot_keys(spark):
    rows = stage(spark.range(5000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 400).alias("k")), "t")
    groups = stage(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low")), "t")
    got = attach(rows, groups, ["k"], "n", 5000)
    assert got.count() == 5000
    assert got.join(rows.groupBy("k").agg(F.min("id").alias("want")), "k").filter("low <> want").count() == 0


def brute_repeats(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    places = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(places)


def test_quality_counts(odd, empty, spark):
    rows = {(r["doc_id"], r["n_words"]): r for r in quality.judge(odd).collect()}
    for doc_id, text, *_ in odd_rows():
        r = rows[doc_id, len(words(text))]
        assert r["word_chars"] == sum(map(len, words(text)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_repeat_words"] == brute_repeats(text)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
    assert quality.judge(empty).count() == 0


def test_quality_rejects_depleted_documents(spark):
    line = "this line stands in every document of the host and says nothing new"
    rows = [(i, f"{line}\nown {i} words", "h") for i in range(60)]
    rows += [(100 + i, f"{line}\n" + " ".join(f"w{i}x{k}" for k in range(40)), "h") for i in range(5)]
    rows += [(200 + i, " ".join(f"z{k}" for k in range(30)), "h") for i in range(50)]  # copies are one text
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs).collect()}
    assert not any(kept[i] for i in range(60))
    assert all(kept[i] for i in (*range(100, 105), *range(200, 250)))
    cleaned = {r["doc_id"]: r["text"] for r in quality.without_frequent_lines(docs).collect()}
    assert cleaned[3] == "own 3 words" and line not in cleaned[102]


def test_targets_share_the_excess():
    for seed in range(30):
        rng = random.Random(seed)
        sizes = [rng.choice([0, 5, 100, 1000, 5000]) for _ in range(rng.randint(1, 9))]
        weights = [1 + i % 3 for i in range(len(sizes))]
        share = [0.0] * len(sizes)
        rest, open_ = float(sum(sizes)), set(range(len(sizes)))
        while rest > 1e-6 and open_:  # as the contract words it
            w = sum(weights[i] for i in open_)
            for i in list(open_):
                share[i] += rest * weights[i] / w
            rest = 0.0
            for i in list(open_):
                if share[i] >= 3 * sizes[i]:
                    rest += share[i] - 3 * sizes[i]
                    share[i] = float(3 * sizes[i])
                    open_.discard(i)
        assert mixing.targets(sizes, weights) == pytest.approx(share, rel=1e-9, abs=1e-3)


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        index = np.arange(n)
        got = mixing.permuted(index, np.full(n, n), np.full(n, 5))
        assert sorted(got.tolist()) == index.tolist()


def test_shard_counts_add_up():
    slots = np.array([100, 0, 37, 1000, 5])
    shards = 9
    seen = np.zeros_like(slots)
    for shard in range(shards):
        before, counts = mixing.shard_counts(shard, shards, slots, 128, 3)
        assert (before == seen).all()
        assert counts.sum() == min(128, 1142 - 128 * shard)
        seen += counts
    assert (seen == slots).all()
    big = np.array([10**10, 3 * 10**10])
    drawn = mixing.draw(np.random.default_rng(1), big, 10**10)
    assert drawn.sum() == 10**10 and (drawn <= big).all()


def test_mix(spark, odd, empty):
    rng = random.Random(4)
    rows = [
        (i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(0, 400))), rng.choice(["a", "b", "c", None]))
        for i in range(400)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, second = (sorted(map(tuple, mixing.mix(docs).collect())) for _ in range(2))
    assert first == second
    source = {i: s for i, _, s in rows}
    taken, target = Counter(), {}
    for doc_id, size, _, goal, got in first:
        assert size == len(words(rows[doc_id][1])) and got <= 3 * size
        taken[source[doc_id]] += got
        target[source[doc_id]] = goal
    assert all(abs(taken[s] - target[s]) < 0.02 * target[s] for s in target)
    texts = {r["doc_id"]: r["text"] for r in mixing.mixed_documents(docs).collect()}
    for doc_id, _, _, _, got in first:
        assert len(words(texts.get(doc_id))) == got
        assert set(words(texts.get(doc_id))) <= set(words(rows[doc_id][1]))
    assert mixing.mix(odd).count() == len(odd_rows())
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def fuzzed(n):
    rng = random.Random(2)
    letters = list("abst'revlmdS  \n\t1.!\u00e9\u6f22\u0301\u2167\u00b2<|>")
    return ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(n)] + [
        "<|endoftext|>", "a<|endoftext|> b", "'s 're'll don't", "  two  blanks \n", "x" * 3000, "\u1e9e\u0130\u03a3",
    ]


def test_token_counts_equal_the_library(odd, empty):
    from tokenizers import Tokenizer

    path = transducer.file_of("byte_bpe_50k.json")
    texts = fuzzed(3000)
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_tokens(texts, path).tolist() == want
    rows = token_counts.token_counts(odd).collect()
    assert len(rows) == len(odd_rows())
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert token_counts.token_counts(empty).count() == 0


def test_chunks_compose_like_one_run():
    machine = transducer.splitter(True)
    symbols = np.random.default_rng(3).integers(0, transducer.N_SYMBOLS, 5000).astype(np.uint8)
    symbols[0] += transducer.FIRST
    state, want = 0, []
    for s in symbols.tolist():
        want.append(bool(machine.begins[state * 2 * transducer.N_SYMBOLS + s]))
        made = machine.apply[machine.after[s]]
        state = int(made[state])
    assert machine.starts(symbols).tolist() == want


def test_url_rules(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("example.com", "/en/a/", "allow"),
             ("www.example.com", "/en/", "allow"), ("net", "", "block"), ("net", "", "allow")]
    rng = random.Random(1)
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(['', 'www.', 'a.b.'])}"
            f"{rng.choice(['example.com', 'Example.COM', 'xexample.com', 'foo.net', 'network', 'com'])}"
            f"{rng.choice(['', '/', '/en', '/en/', '/en/a/b', '/EN/x'])}{rng.choice(['', '?q=/en/', '#f'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "://", "http://", "x://y://z/en/", "http://\u00e9.net/\U0010ffff"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    lower = str.maketrans(url_filter.UPPER, url_filter.LOWER)
    for i, url in enumerate(urls):
        rest = url.partition("://")[2] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(lower)
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h + p, "block" if h == "net" else v) for h, p, v in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
        want = max(fits) if fits else (0, None, "allow")
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, want[1], want[2]), url
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.judge(pages, none).collect()} == {"allow"}
    assert url_filter.judge(pages.limit(0), none).count() == 0


def test_levenshtein_search():
    lexicon = toxicity.Lexicon({"idiot": (5.0, 1), "worthlessness": (4.0, 1), "lowei*": (3.0, 2), "scum": (2.0, 1)})
    find = lambda w: (lexicon.find(w) or (None, None))[:2]
    assert find("IDIOT!!") == (5.0, 0) and find("idiott") == (5.0, 1) and find("idot") == (5.0, 1)
    assert find("id1ot") == (5.0, 1) and find("idxxt") == (None, None)
    assert find("wrthlessnes") == (4.0, 2) and find("loweischaft") == (3.0, 0)
    assert find("scum") == (2.0, 0) and find("scam") == (None, None) and find("") == (None, None)


def test_toxicity_learns_and_reads_contexts(spark, odd, empty):
    rng = random.Random(5)
    plain = lambda n: [f"w{rng.randint(0, 300)}ab".replace("0", "o") for _ in range(n)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        text = plain(40)
        if toxic:
            for _ in range(3):
                text.insert(rng.randint(0, 40), rng.choice(["idiot", "moron", "loser"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 0, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for i, _, toxic in labels:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i]["predicted"] == toxic
    assert sorted(r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()) == [i for i, _, t in labels if not t]
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    nobody = toxicity.fit(docs, table.limit(0))
    assert {r["score"] for r in toxicity.score(docs, nobody).collect()} == {toxicity.BLANK_SCORE}
    assert toxicity.score(empty, model).count() == 0
    x = toxicity.features(['he said "idiot" once', "you idiot go away"], model.lexicon)
    assert x[0, 3] > 0 and x[0, 4] == 0 and x[1, 3] == 0 and x[1, 4] > 0


def test_lexicon_keeps_rare_terms_and_long_words(spark):
    rows = []
    for i in range(100):
        word = "".join(chr(97 + (i // 26**k + 3 * k) % 26) for k in range(3)) + "zuberwort"
        rows += [(t, 300, 0, 0, 0) for t in (word, *(word[:n] + "*" for n in toxicity.STEM_LETTERS))]
    rows += [("vermin", 12, 0, 0, 0), ("scum", 12, 0, 0, 0), ("scums", 12, 0, 0, 0), ("plain", 300, 300, 0, 0)]
    rows += [(f"only{chr(97 + i // 26)}{chr(97 + i % 26)}", 200, 0, 0, 0) for i in range(600)]
    counts = spark.createDataFrame(rows, "term string, toxic1 long, clean1 long, toxic2 long, clean2 long")
    terms = toxicity.choose_terms(counts, 3000, 3000)
    assert {"vermin", "scum", "scums"} <= set(terms) and "plain" not in terms
    assert len(terms) == 100 + 3 + 600 and sum(t.endswith("*") for t in terms) == 100
    lexicon = toxicity.Lexicon({"idio*": (5.0, 1), "scum": (5.0, 1)})
    assert lexicon.find("idiot" * 9) is not None and lexicon.find("scum" * 12) is None
    assert toxicity.terms_of(["idiot" * 9])["idio*"] == 1


def brute_components(sets, percent=80):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if minhash.is_link(sets[a], sets[b], percent) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(8)
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    for _ in range(6):
        base = [f"v{rng.randint(0, 2000)}" for _ in range(rng.randint(20, 150))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = f"u{rng.randint(0, 9999)}"
            add(" ".join(copy[: rng.randint(int(len(copy) * 0.8), len(copy))]))
    chain = [f"c{i}" for i in range(400)]
    for cut in range(400, 150, -20):  # each links to its neighbours only
        add(" ".join(chain[:cut]))
    for text in ("", None, " ", "one", "One", "two", "a b", "A  b"):
        add(text)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components({i: minhash.word_set(t or "") for i, t in rows})
    got = minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert all(r["n_shingles"] == len(minhash.word_set(rows[r["doc_id"]][1] or "")) for r in got)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows())
    assert sum(r["kept"] for r in got if r["component_id"] == 1) == 1
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    # one of the texts `a b c`; the texts without words, of which two have no id, all stay
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 4, 5, 6, None, 7, 9, 10, 11])
    assert minhash.near_duplicates(empty).count() == 0 and minhash.drop_near_duplicates(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000)]
    got = components.components(stage(spark.createDataFrame(links, "a long, b long"), "links"))
    labels = {r["node"]: r["label"] for r in got.collect()}
    assert {labels[i] for i in range(201)} == {0}
    assert {labels[1000 + i] for i in range(300)} == {1000}
    assert labels[5000] == labels[4000] == 4000


def test_secrets(odd, empty):
    ranks = secrets.word_ranks(transducer.file_of(secrets.WORD_LIST))
    text = "PASSWORD = hunter2x, pwd: x7#kQ9!vLm2p AKIA" + "A1" * 9 + " " + "0f" * 13 + " token: short secret=tiny pwd: changeme"
    n_assign, n_access, n_hex, sha, spans = secrets.scan(text, ranks)
    assert (n_assign, n_access, n_hex) == (1, 1, 1) or n_assign == 1
    found = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in spans.split(","))]
    assert ("assign", "PASSWORD = hunter2x") in found and ("password", "x7#kQ9!vLm2p") in found
    assert ("hex", "0f" * 13) in found and ("access", "AKIA" + "A1" * 9) in found
    assert not any("changeme" in v for _, v in found)
    base = ",".join(s for s in spans.split(",") if not s.startswith("password"))
    assert sha == hashlib.sha256(base.encode()).hexdigest()
    assert secrets.scan("", ranks) == (0, 0, 0, hashlib.sha256(b"").hexdigest(), "")
    assert secrets.find_secrets(odd).count() == len(odd_rows())
    assert secrets.find_secrets(empty).count() == 0


def test_guess_cost_is_the_smallest_over_all_splits():
    ranks = {"pass": 10, "word": 20, "password": 2, "abc": 5}
    cost, spans = secrets.guess_cost("password2019qwerty", ranks)
    assert [k for k, _, _ in spans] == ["word", "date", "walk"]
    assert cost < secrets.guess_cost("pxsswxrd2x19qwxrty", ranks)[0]
    assert secrets.guess_cost("aaaaaaaa", ranks)[0] < 4 < secrets.guess_cost("k3j9Zq!x", ranks)[0]


def test_long_values_are_scored():
    ranks = secrets.word_ranks(transducer.file_of(secrets.WORD_LIST))
    for value, told in (("x" * 300, False), ("house-garden-" * 30, False), ("k3j9Zq!x7Wp" * 2 + "x" * 300, True)):
        assert secrets.is_password(value, ranks) is told, value
        assert ("password" in secrets.scan(f"pwd={value}", ranks)[4]) is told


def brute_fill(lengths, room):
    best = {0}
    for x in lengths:
        best |= {s + x for s in best if s + x <= room}
    return max(best)


def test_fill_is_closest_to_capacity():
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randint(1, 60) for _ in range(rng.randint(0, 12))]
        counts, room = Counter(items), rng.randint(0, 150)
        chosen = packing.fill(sorted(counts, reverse=True), dict(counts), room)
        assert all(0 < k <= counts[x] for x, k in chosen.items())
        assert sum(x * k for x, k in chosen.items()) == brute_fill(items, room)


def test_letter_pieces_go_straight_to_the_model():
    from tokenizers import Tokenizer

    texts = ["Tiré vonwher elle\u0301 été x1 don't", "ŉ ĿĿ İstanbul ẞ ǅ ſs µm ªº Ωmega σΣ \x1c\x1d\x85 kk\xa0"]
    made = packing.WordIds(transducer.file_of(packing.TOKENIZER))
    whole, asked = made.library, []

    class Library:
        def encode_batch(self, some, **options):
            asked.extend(some)
            return whole.encode_batch(some, **options)

    made.library = Library()
    found = [ids[:-1].tolist() for ids in made.of_texts(texts)]
    library = Tokenizer.from_file(transducer.file_of(packing.TOKENIZER))
    assert found == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked and not {"tiré", "vonwher", "elle\u0301", "ellé", "été"} & set(asked)


def test_packing_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(transducer.file_of(packing.TOKENIZER))
    texts = fuzzed(500) + [" ".join(f"word{i % 50}" for i in range(k)) for k in range(0, 3000, 97)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = packing.pack(docs, capacity=256, with_ids=True).collect()
    want = [e.ids + [1] for e in library.encode_batch(texts, add_special_tokens=False)]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, ids in enumerate(want):
        made = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in made for x in r["ids"]] == ids
        assert all(r["doc_tokens"] == len(ids) for r in made)
        assert [r["start"] for r in made] == list(np.cumsum([0] + [r["length"] for r in made])[:-1])
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0] + [r["length"] for r in pieces])
        assert [r["offset"] for r in pieces] == list(ends[:-1])
        assert ends[-1] <= 256 and (ends[-1] & (ends[-1] - 1)) == 0  # nothing is padded
    assert {r["doc_id"] for r in packing.pack(odd).collect()} == {r[0] for r in odd_rows()}
    assert packing.pack(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><header>Top</header>
<article><header><h1>Title &amp; more</h1></header><p><b>First &eacute; line<br>goes on<p>Second   line<ul><li>one<li>two</ul>
<div class="ad">Buy</div><form><input><p>mail?</p></form><aside>See also</aside>
<section class="comments"><article class="comment"><p>I agree</p></article></section></article>
<footer>&copy; site</footer>"""


def test_main_text():
    got = html_extract.main_text(html_extract.parse(PAGE), frozenset())
    assert got == "Title & more\nFirst \u00e9 line goes on\nSecond line\none\ntwo"
    for html, text in (
        ("", ""), ("plain", "plain"), ("<p>a<p>b</p></p>c", "a\nb\nc"), ("<!-- open", ""), ("<p>x<!-- y -->z", "xz"),
        ("<div>" * 5000 + "deep", "deep"), ("<" * 50, "<" * 50), ("a &lt; b &#233; &nbsp; c", "a < b \u00e9 c"),
        ("<main><p>m</p></main><p>rest</p>", "m"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2\n3"),
    ):
        assert html_extract.main_text(html_extract.parse(html), frozenset()) == text


def test_articles_in_wrappers_named_like_furniture():
    for html in (
        "<div class='layout with-sidebar'><article><p>The text</p></article></div>",
        "<div id='social-wrapper'><main><p>The text</p></main></div>",
        "<div class='page-header-wrap'><article><p>The text</p></article></div>",
        "<form id='aspnetForm'><article><p>The text</p></article></form>",
        "<form id='aspnetForm'><div><p>The text</p></div><nav>Menu</nav></form>",
        "<article class='post has-comments'><p>The text</p></article>",
        "<article><div class='body with-sidebar'><p>The text</p></div></article>",
        "<main><div class='sidebar'><article><p>The text</p></article></div></main>",
        "<article><p>The text</p></article><div class='comment-list'><article class='comment-body'>I too</article></div>",
        "<div><p>The text</p></div><div class='comments'><article>I too</article></div>",
        "<article><p>The text</p><section class='comments'>Much more than the text itself</section></article>",
    ):
        assert html_extract.main_text(html_extract.parse(html), frozenset()) == "The text", html


def test_site_templates_are_removed(spark):
    box = "<div class=x><a href=/1>Top story</a> <a href=/2>Other story</a></div>"
    rows = [(i, f"http://h.org/{i}", f"<body>{box}<p>Text number {i} of this site.</p><p>Shared paragraph.</p></body>") for i in range(30)]
    rows += [(99, None, None), (98, "http://other.org/", f"<body>{box}<p>Alone</p></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got[3] == "Text number 3 of this site.\nShared paragraph."
    assert got[99] == "" and got[98] == "Top story Other story\nAlone"
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_templates_inside_articles(spark):
    box = "<div class=x><p>" + "Readers of this site may sign up for its weekly letter, which costs nothing. " * 2 + "</p></div>"
    told = "<h2>Summary</h2><p>Shared paragraph.</p><ul><li>Salt</li><li>Only in {0}</li></ul>"
    rows = [
        (i, "http://h.org/", f"<article><p>Text number {i} of this site.</p>{box if i < 12 else ''}{told.format(i)}</article>")
        for i in range(300)
    ]
    body = "".join(f"<section><p>Part {k} of a text that stands on many pages, told at length.</p></section>" for k in range(6))
    rows += [(1000 + i, "http://h.org/", f"<article><h1>Copy</h1>{body}<p>{i} May</p></article>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    for i in (3, 200):
        assert got[i] == f"Text number {i} of this site.\nSummary\nShared paragraph.\nSalt\nOnly in {i}"
    assert got[1007].startswith("Copy\nPart 0 ") and got[1007].endswith("7 May") and got[1007].count("Part") == 6


@pytest.fixture(scope="module")
def pipeline_parts():
    return pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, pipeline_parts, tmp_path):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = [set(rows)]
    for name, function in pipeline_parts.STAGES[:-1]:
        docs = stage(function(spark, docs, folder), "step")
        assert docs.columns == columns
        kept.append({r["doc_id"] for r in docs.collect()})
        assert kept[-1] <= kept[-2]
    groups = defaultdict(list)
    for i in kept[1]:
        groups[" ".join(words(rows[i]))].append(i)
    assert kept[2] == {min(g) for g in groups.values()}
    assert kept[3] == set(brute_components({i: minhash.word_set(rows[i]) for i in kept[2]}).values())
    last = pipeline_parts.STAGES[-1][1](spark, docs, folder).collect()
    assert {r["doc_id"] for r in last} == kept[4]
    again = pipeline_parts.run(spark, folder).collect()
    assert sum(r["length"] for r in again) == sum(r["length"] for r in last)
