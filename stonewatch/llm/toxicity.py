"""Toxicity scores from a learned lexicon, misspellings and contexts included.

Terms are words and word stems that labelled toxic documents hold far more often than labelled
clean ones; some tell only when a text holds them twice. They form a trie, which is met with
the Levenshtein automata of its terms (one or two errors in longer terms): the places of the
trie that a word's letters can lead to are the states of a machine that is compiled as words
come. What it accepts are the terms that a word spells or misspells. Every hit is then read in
its window of WINDOW words on either side: inside quotation marks or next to words of reporting
it is a quotation; next to a word of address or to another hit it is abuse. A logistic model
over these few sums gives the score.

The lexicon and the model are fitted on at most FIT_ROWS toxic and FIT_ROWS clean labelled
documents (those with the smallest hashes of their ids), held-out rows left out; texts of all
documents are scored. The lexicon holds every telling term that no shorter telling stem covers;
as each is in MIN_TERM_DOCS of the fitted documents, the sample bounds it, not the input.

Null and empty texts get the score of a text without any hit. Null ids are not held out;
repeated rows are scored alike; without labels of both kinds every score is BLANK_SCORE;
empty tables give empty results; extra columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import frugal, stage, text_of
from stonewatch.llm.token_counts import slices
from stonewatch.llm.transducer import SPACE_MORE, character_classes

FIT_ROWS = 3000
FOLDS = 5
MIN_TERM_DOCS = 8
MIN_LOG_ODDS = 3.0
STEM_LETTERS = range(4, 9)
MIN_WORD, MAX_WORD = 3, 40
ONE_ERROR_FROM, TWO_ERRORS_FROM = 5, 10
WINDOW = 6
RIDGE = 0.5
BLANK_SCORE = 0.1
MAX_STEPS = 300_000

#: Digits and signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
#: Words of address and of reporting, English, German, French, Spanish.
ADDRESS = frozenset("you your you're u du dich dir dein deine ihr euch tu toi te ton ta vous votre ti tú usted tus".split())
REPORT = frozenset(
    "said says called wrote quote quoted term word sagte nannte schrieb wort zitat dit disait écrit mot dijo llamó"
    " escribió palabra".split()
)
OPENING, ENDS = "\"'“„«‘(", tuple("\"'”“»’)")
FEATURES = 8


def held_out(id_column: str = "doc_id") -> Column:
    crc = F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary"))
    return F.coalesce(crc % FOLDS == 0, F.lit(False))


def plain(word: str) -> str:
    """A word as the lexicon has it: lower case, signs around it cut off."""
    word = word.lower()
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def words_of_batch(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of every word of all texts in order, where each text begins."""
    joined = "\n".join(texts) + "\n" if texts else ""
    data = joined.encode("utf-8", "replace")
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    blank = character_classes()[points] >= SPACE_MORE
    before = np.concatenate(([True], blank[:-1])) if len(blank) else blank
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    cuts = np.stack((starts, ends), 1).ravel()
    if len(data) != len(points):
        width = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
        cuts = (np.cumsum(width, dtype=np.int64) - width)[cuts]
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    offsets = np.append(cuts, len(data)).astype(np.int64)
    every = pa.Array.from_buffers(
        pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
    )
    encoded = every.take(pa.array(np.arange(0, len(cuts), 2))).dictionary_encode()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    at = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    return [w.decode() for w in encoded.dictionary.to_pylist()], encoded.indices.to_numpy(), at


def terms_of(words: Iterable[str]) -> Counter:
    """Occurrences of whole words, and of stems marked by a star."""
    found: Counter = Counter()
    for word, n in Counter(words).items():
        word = plain(word)
        if MIN_WORD <= len(word) and word.isalpha():
            if len(word) <= MAX_WORD:
                found[word] += n
            for letters in STEM_LETTERS:
                if letters <= len(word):
                    found[word[:letters] + "*"] += n
    return found


_COUNTS = ("toxic1", "clean1", "toxic2", "clean2")


def term_counts(sample: DataFrame) -> DataFrame:
    """Toxic and clean documents with each term once or more, and twice or more."""

    @frugal
    def counted(batches):
        for batch in batches:
            both: dict[str, Counter] = {c: Counter() for c in _COUNTS}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind, found = "toxic" if label else "clean", terms_of(text.split())
                both[kind + "1"].update(found.keys())
                both[kind + "2"].update(t for t, n in found.items() if n > 1)
            terms = list(both["toxic1"].keys() | both["clean1"].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), *(pa.array([both[c][t] for t in terms], pa.int64()) for c in _COUNTS)],
                ["term", *_COUNTS],
            )

    schema = "term string, " + ", ".join(f"{c} long" for c in _COUNTS)
    parts = sample.select("label", "text").mapInArrow(counted, schema)
    return parts.groupBy("term").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def choose_terms(counts: DataFrame, toxic: int, clean: int) -> dict[str, tuple[float, int]]:
    """Terms with log odds and the least occurrences that count; of a telling stem and what
    begins with it, the stem stays."""

    def odds(least: int) -> Column:
        t, c = F.col(f"toxic{least}"), F.col(f"clean{least}")
        value = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
        return F.when((t >= MIN_TERM_DOCS) & (value >= MIN_LOG_ODDS), value)

    telling = stage(
        counts.withColumn("once", odds(1))
        .withColumn("twice", odds(2))
        .filter("once is not null or twice is not null")
        .select("term", "once", "twice"),
        "terms",
    )
    stems = telling.filter(F.col("term").endswith("*")).select(F.col("term").alias("stem"))
    is_stem, letters = F.col("term").endswith("*"), F.length(F.rtrim(F.col("term"), F.lit("*")))
    shorter = F.filter(
        F.array(*(F.struct(F.lit(n).alias("n"), F.concat(F.substring("term", 1, n), F.lit("*")).alias("stem")) for n in STEM_LETTERS)),
        lambda x: (x["n"] < letters) | (x["n"] == letters) & ~is_stem,
    )
    covered = telling.select("term", F.explode(shorter).alias("s")).select("term", "s.stem").join(stems, "stem")
    kept = telling.join(covered.select("term").distinct(), "term", "left_anti").collect()
    return {r["term"]: (r["once"], 1) if r["once"] is not None else (r["twice"], 2) for r in kept}


def allowed_errors(length: int) -> int:
    return 2 if length >= TWO_ERRORS_FROM else 1 if length >= ONE_ERROR_FROM else 0


class Lexicon:
    """The trie of terms met with the Levenshtein automata of all of them.

    A place is a trie node with the errors made so far; a letter of a word matches a child,
    stands in for one, or stands for nothing, and a child may be left out. Sets of places are
    the states of a deterministic machine, compiled when first met, so that a word costs one
    lookup a letter and most words end after a few, when no place is left.
    """

    def __init__(self, terms: dict[str, tuple[float, int]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple]] = [[]]  # (odds, term's number, least, allowed errors, is a stem)
        self.most: list[int] = [0]  # errors that any term below allows
        for number, (term, (odds, least)) in enumerate(sorted(terms.items())):
            letters, at = term.rstrip("*"), 0
            allowed = allowed_errors(len(letters))
            for c in letters:
                self.most[at] = max(self.most[at], allowed)
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                at = self.children[at][c]
            self.most[at] = max(self.most[at], allowed)
            self.ends[at].append((odds, number, least, allowed, term.endswith("*")))
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.results: list[tuple | None] = []
        self.n_steps = 0
        self.start = self._number(self._closed({0: 0}), None)

    def _closed(self, places: dict[int, int]) -> dict[int, int]:
        """Places reached by leaving out children as well; the fewest errors of each node."""
        todo = list(places.items())
        while todo:
            node, errors = todo.pop()
            if errors == places[node]:
                for child in self.children[node].values():
                    if errors < self.most[child] and errors + 1 < places.get(child, 99):
                        places[child] = errors + 1
                        todo.append((child, errors + 1))
        return places

    @staticmethod
    def _better(a: tuple | None, b: tuple | None) -> tuple | None:
        """Fewer errors, then higher odds, then the term's number."""
        if a is None or b is None:
            return a or b
        return min(a, b, key=lambda x: (x[1], -x[0], x[2]))

    def _number(self, places: dict[int, int], found: tuple | None) -> int:
        at_end = None
        for node, errors in places.items():
            for odds, number, least, allowed, stem in self.ends[node]:
                if errors <= allowed:
                    hit = (odds, errors, number, least)
                    at_end = self._better(at_end, hit)
                    if stem:  # met, whatever follows
                        found = self._better(found, hit)
        key = (frozenset(places.items()), found)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append((places, found))
            self.steps.append({})
            self.results.append(self._better(found, at_end))
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        places, found = self.states[state]
        moved: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= self.most[node] and errors < moved.get(node, 99):
                moved[node] = errors

        for node, errors in places.items():
            reach(node, errors + 1)
            for c, child in self.children[node].items():
                reach(child, errors + (c != letter))
        self.n_steps += 1
        made = self.steps[state][letter] = self._number(self._closed(moved), found)
        return made

    def _run(self, word: str) -> tuple[float, int, int, int] | None:
        state, steps = self.start, self.steps
        for letter in word:
            following = steps[state].get(letter)
            if following is None:
                following = self._step(state, letter)
            state = following
            if not self.states[state][0]:
                break
        return self.results[state]

    def find(self, word: str) -> tuple[float, int, int, int] | None:
        """(odds, errors, term's number, least occurrences) of the closest term that the word
        spells, else None."""
        if self.n_steps > MAX_STEPS:
            self._reset()
        own = plain(word)
        if len(own) < MIN_WORD:
            return None
        found = self._run(own)
        if found is None and not own.isalpha():
            straight = own.translate(LEET)
            found = self._run(straight) if straight != own else None
            found = found and (found[0], max(1, found[1]), *found[2:])
        return found


def features(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    """FEATURES sums of each text's hits."""
    out = np.zeros((len(texts), FEATURES))
    words, order, at = words_of_batch(texts)
    hit = np.fromiter((lexicon.find(w) is not None for w in words), bool, len(words))
    places = np.flatnonzero(hit[order]) if len(words) else np.zeros(0, np.int64)
    owner = np.searchsorted(at, places, "right") - 1
    hits = [(p, t, lexicon.find(words[order[p]])) for p, t in zip(places.tolist(), owner.tolist())]
    met = Counter((t, found[2]) for _, t, found in hits)
    telling = {p: (t, found) for p, t, found in hits if met[t, found[2]] >= found[3]}
    for place, (text, (odds, errors, _, least)) in telling.items():
        low, high = max(at[text], place - WINDOW), min(at[text + 1], place + WINDOW + 1)
        around = [words[i] for i in order[low:high]]
        here = place - low
        near = [plain(w) for i, w in enumerate(around) if i != here]
        opened = any(w[0] in OPENING for w in around[: here + 1])
        closed = any(w.rstrip(".,;:!?")[-1:] in ENDS for w in around[here:])
        quoted = opened and closed or any(w in REPORT for w in near)
        addressed = any(w in ADDRESS for w in near) or any(p in telling for p in range(low, high) if p != place)
        row = out[text]
        row[0] += errors == 0 and least == 1
        row[1] += errors > 0
        row[2] += odds if errors == 0 else 0.3 * odds
        row[3] += quoted
        row[4] += addressed and not quoted
        row[5] = max(row[5], odds if errors == 0 else 0.0)
        row[7] += errors == 0 and least > 1
    sizes = np.maximum(np.diff(at), 1)
    out[:, 6] = 100 * (out[:, 0] + out[:, 1] + out[:, 7]) / sizes
    out[:, [0, 1, 2, 3, 4, 6, 7]] = np.log1p(out[:, [0, 1, 2, 3, 4, 6, 7]])
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights (the constant last) by Newton steps with a ridge."""
    x = np.column_stack((x, np.ones(len(x))))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: dict[str, tuple[float, int]], weights: np.ndarray | None):
        self.terms, self.weights = terms, weights
        self._lexicon: Lexicon | None = None

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "_lexicon": None}

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.terms)
        return self._lexicon

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), BLANK_SCORE)
        x = np.column_stack((features(texts, self.lexicon), np.ones(len(texts))))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Staged (label, text) of at most `rows` labelled documents of each kind, none held out."""
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("label"))
        .withColumn("order", F.xxhash64("doc_id"))
    )
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy("order", "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = stage(chosen.select("doc_id", "label"), "fit-rows")
    # at most 2 * rows ids: a broadcast of proven size
    return stage(
        docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "text"),
        "fit-texts",
    )


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Lexicon and weights from the labelled documents that are not held out."""
    sample = training_sample(docs, labels, rows)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, None)
    model = Model(choose_terms(term_counts(sample), sizes[1], sizes[0]), None)

    @frugal
    def measured(batches):
        for batch in batches:
            x = features(batch.column(1).to_pylist(), model.lexicon)
            columns = [pa.array(x[:, i], pa.float64()) for i in range(FEATURES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["label", *(f"f{i}" for i in range(FEATURES))])

    schema = "label int, " + ", ".join(f"f{i} double" for i in range(FEATURES))
    found = np.array([tuple(r) for r in sample.mapInArrow(measured, schema).collect()], float)
    found = found[np.lexsort(found.T)]  # sums do not depend on the order of partitions
    model.weights = fit_logistic(found[:, 1:], found[:, 0])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    @frugal
    def scored(batches):
        for batch in batches:
            found = [model.scores(s) for s in slices(batch.column(2).to_pylist())]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), text_of().alias("text"))
    made = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return made.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a score under one half, all columns kept."""

    @frugal
    def passed(batches):
        for batch in batches:
            found = [model.scores(s) for s in slices(batch.column("text_").to_pylist())]
            keep = pa.array(np.concatenate(found) < 0.5 if found else [], pa.bool_())
            yield batch.select(["row"]).filter(keep)

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text_of().alias("text_"))
    return rows.mapInArrow(passed, rows.select("row").schema).select("row.*")
