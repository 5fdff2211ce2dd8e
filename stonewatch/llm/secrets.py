"""Secrets in texts: fixed patterns, and passwords found by the cost of guessing them.

Base spans are the leftmost non-overlapping matches of three fixed patterns. Beyond them,
values that stand in a credential's place (after names such as `pwd` or `login`, after
`Bearer`, or between user and host of an address) are scored by the cheapest way to guess them:
a dynamic program over the value's characters splits it into dictionary words, dates, repeats,
keyboard walks, sequences and brute-force spans with the smallest product of guesses. Values
over MIN_LOG10_GUESSES that are not made of dictionary words alone are spans of kind `password`,
unless they lie in a base span.

The dictionary is the vocabulary of a public tokenizer file (whole words of three or more
letters; the rank is the place in the vocabulary), so its size is fixed.

Offsets are code points, ends exclusive. Values of any length are scored whole: the program
takes time in proportion to their length. Null texts are empty; null or repeated ids are carried along; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import frugal, text_of
from stonewatch.llm.transducer import file_of

#: The base patterns, and the least characters of the value or match.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "password")

#: Names before a value, and other places where credentials stand.
CONTEXTS = (
    re.compile(
        r"""(?i:pass(?:word|wd|phrase|code)?|pwd|pw|pin|secret|token|api[_-]?key|access[_-]?key|credentials?|auth|login)"""
        r"""["']?\x20*(?::|=|=>|\x20is\x20)\x20*["']?([^\s"'<>,;]+)""",
        re.ASCII,
    ),
    re.compile(r"""(?i:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]+)""", re.ASCII),
    re.compile(r"""://[^\s/:@]+:([^\s/@]+)@""", re.ASCII),
)
#: Every context holds one of these; texts without any are not searched.
CLUES = ("pass", "pwd", "pw", "pin", "secret", "token", "key", "credential", "auth", "login", "bearer", "basic", "://")

MIN_VALUE = 6
MIN_LOG10_GUESSES = 8.0
WORD_LIST = "word_bpe_49k.json"
MAX_WORD = 24

#: Rows of keys next to each other.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertz", "azerty", "1qaz2wsx3edc4rfv5tgb6yhn7ujm")
#: Digits and signs that stand for letters.
LEET = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
DATE = re.compile(
    r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d"
)
LOG2 = math.log10(2)


def classes_size(text: str) -> int:
    """Characters that a guesser must try per place."""
    size = 26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text)
    size += 10 * any(c.isdigit() for c in text) + 33 * any(not c.isalnum() for c in text)
    return size or 1


@lru_cache(2)
def word_ranks(path: str) -> dict[str, int]:
    """Whole words of a vocabulary file with their ranks."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (t[:-4] for t in vocabulary if t.endswith("</w>") and len(t) >= 7 and t[:-4].isalpha())
    return {w: i + 1 for i, w in enumerate(words)}


def walks(lowered: str):
    """(start, end) of runs of three or more neighbouring keys, in either direction."""
    for row in KEY_ROWS:
        for keys in (row, row[::-1]):
            start = 0
            while start < len(lowered) - 2:
                end = start + 1
                at = keys.find(lowered[start])
                while at >= 0 and end < len(lowered) and at + 1 < len(keys) and keys[at + 1] == lowered[end]:
                    at += 1
                    end += 1
                if end - start >= 3:
                    yield start, end
                    start = end - 1
                else:
                    start += 1


def sequences(value: str):
    """(start, end) of runs of three or more characters with a step of 1 or -1."""
    start = 0
    while start < len(value) - 2:
        step = ord(value[start + 1]) - ord(value[start])
        end = start + 1
        while step in (1, -1) and end < len(value) and ord(value[end]) - ord(value[end - 1]) == step:
            end += 1
        if end - start >= 3:
            yield start, end
        start = max(end - 1, start + 1)


def repeats(value: str):
    """(start, end, unit) of a unit of one to four characters said twice or more."""
    for unit in range(1, 5):
        start = 0
        while start + 2 * unit <= len(value):
            end = start + unit
            while value[end : end + unit] == value[start : start + unit] and end + unit <= len(value):
                end += unit
            if end - start >= max(2 * unit, 3):
                yield start, end, unit
                start = end
            else:
                start += 1


def guess_cost(value: str, ranks: dict[str, int]) -> tuple[float, list[tuple[str, int, int]]]:
    """log10 of the guesses, and the cheapest segmentation as (kind, start, end).

    The best split of a prefix is the best over its last span; each further span adds a
    factor two for the choice of where to split.
    """
    n = len(value)
    lowered, base = value.lower(), math.log10(classes_size(value))
    plain = lowered.translate(LEET)
    ends: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for start in range(n):
        for end in range(start + 3, min(n, start + MAX_WORD) + 1):
            rank, extra = ranks.get(lowered[start:end]), 0.0
            if rank is None and plain[start:end] != lowered[start:end]:
                rank, extra = ranks.get(plain[start:end]), LOG2
            if rank is not None:
                extra += LOG2 * (value[start:end] != lowered[start:end])
                ends[end].append((start, math.log10(rank) + extra, "word"))
    for start, end in walks(lowered):
        ends[end].append((start, math.log10(40 * (end - start)), "walk"))
    for start, end in sequences(value):
        ends[end].append((start, math.log10(26 * (end - start)), "sequence"))
    for start, end, unit in repeats(value):
        ends[end].append((start, unit * base + math.log10((end - start) // unit), "repeat"))
    for start in range(n):
        match = DATE.match(value, start)
        if match:
            ends[match.end()].append((start, math.log10(365 * 120 if match.end() - start > 4 else 120), "date"))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    for end in range(1, n + 1):
        cost, start, kind = best[end - 1][0] + base, end - 1, "brute"
        if best[end - 1][2] not in ("brute", ""):
            cost += LOG2
        for s, c, k in ends[end]:
            total = best[s][0] + c + (LOG2 if s else 0.0)
            if total < cost:
                cost, start, kind = total, s, k
        best.append((cost, start, kind))
    spans, end = [], n
    while end:
        _, start, kind = best[end]
        if spans and kind == "brute" and spans[-1][0] == "brute":
            spans[-1] = ("brute", start, spans[-1][2])
        else:
            spans.append((kind, start, end))
        end = start
    return best[n][0], spans[::-1]


def is_password(value: str, ranks: dict[str, int], least: float = MIN_LOG10_GUESSES) -> bool:
    if len(value) < MIN_VALUE:
        return False
    cost, spans = guess_cost(value, ranks)
    # words and signs between them are names or placeholders, not passwords
    return cost >= least and any(kind != "word" and any(map(str.isalnum, value[a:b])) for kind, a, b in spans)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base matches."""
    found = [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        lowered = text.lower()
        if any(c in lowered for c in ("passw", "secret", "token", "apikey", "api_key")):
            found += [
                (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
            ]
    return found


def password_spans(text: str, ranks: dict[str, int], least: float = MIN_LOG10_GUESSES) -> set[tuple[int, int, int]]:
    """Values in a credential's place that are hard to guess."""
    lowered = text.lower()
    if not any(c in lowered for c in CLUES):
        return set()
    found = set()
    for context in CONTEXTS:
        for m in context.finditer(text):
            value = m[1].rstrip(".)]}")
            if is_password(value, ranks, least):
                found.add((m.start(1), 3, m.start(1) + len(value)))
    return found


def scan(text: str, ranks: dict[str, int], least: float = MIN_LOG10_GUESSES) -> tuple:
    """(n_assign, n_access, n_hex, base_sha256, spans) of a text."""
    base = sorted(base_spans(text))
    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    added = [
        p for p in password_spans(text, ranks, least) if not any(a <= p[0] and p[2] <= b for a, _, b in base)
    ]
    every = sorted([*base, *added])
    return (*counts, hashlib.sha256(said(base).encode()).hexdigest(), said(every))


def find_secrets(
    docs: DataFrame,
    least: float = MIN_LOG10_GUESSES,
    words: str = WORD_LIST,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    @frugal
    def scanned(batches):
        ranks = word_ranks(file_of(words))
        for batch in batches:
            found = [scan(t, ranks, least) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds[1:]))], names
            )

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_of(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(
        scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
