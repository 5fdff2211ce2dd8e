"""Quality rules: counts within a text, and lines shared by many documents of a host.

Words are runs of anything but space and U+0009 to U+000D. A document fails the base rules
with fewer than MIN_WORDS words, or when over MAX_REPEAT_PERCENT of its words lie in
5-word windows found twice or more in it.

Across documents: lines are normalised (trimmed, white space to one space, lower case),
hashed to 64 bits, and counted per host by distinct texts, so that plain copies of one
document do not turn its lines into boilerplate. A line in more than MIN_LINE_DOCS texts and
more than LINE_PERCENT percent of the host's texts is removed; a document left with less
than KEEP_PERCENT percent of its words is depleted and rejected.

Null texts have no words and fail; null hosts form a host of their own; repeated rows get the
same verdict; empty tables give empty results; extra columns are ignored. Lines without a word
are never counted. A line that a third of all documents share is handled by the hot side of
`attach`; whole texts never leave the scan, only counts and line hashes do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import SPACE_CHARS, SPACES, attach, stage, text_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
MIN_LINE_DOCS = 20
LINE_PERCENT = 10
KEEP_PERCENT = 30


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words within windows that occur twice or more; the windows' places are sorted by hash."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(
            placed,
            lambda p: F.filter(
                p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])
            ),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("at"))
        return F.aggregate(
            places,
            start,
            lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["at"])).alias("n"), i.alias("at")),
            lambda a: a["n"],
        )

    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) >= window,
            F.transform(
                F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window))
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    return _let(
        words,
        lambda w: _let(
            windows(w),
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)),
        ),
    )


def line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACES, " "))))


def _lines(text: Column) -> Column:
    """(h, words, raw) of each line with a word."""
    split = F.transform(
        F.split(text, "\n"),
        lambda x: F.struct(line_key(x).alias("h"), F.size(words_of(x)).alias("words"), F.xxhash64(x).alias("raw")),
    )
    return F.filter(split, lambda x: x["words"] > 0)


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Staged counts and line hashes of every document."""
    text = text_of(f"`{text_column}`")
    raw = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(f"`{id_column}`").alias("doc_id"),
        F.coalesce(F.col(f"`{host_column}`").cast("string"), F.lit("\0")).alias("host"),
        F.xxhash64(text).alias("text_key"),
        _let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated"))).alias("w"),
        F.length(_without(text, SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        _lines(text).alias("lines"),
    )
    return stage(raw, "measured")


def frequent_lines(
    counted: DataFrame, min_docs: int = MIN_LINE_DOCS, percent: int = LINE_PERCENT
) -> tuple[DataFrame, int]:
    """Lines (host, h, n_rows) over the limits, staged, and the number of line rows counted."""
    firsts = counted.groupBy("host", "text_key").agg(F.min("rid").alias("rid"))
    reps = stage(firsts, "texts")
    hosts = reps.groupBy("host").agg(F.count("*").alias("host_docs"))
    hashes = counted.select(
        "rid", "host", F.array_distinct(F.transform("lines", lambda x: x["h"])).alias("hs")
    ).join(reps.select("rid", F.lit(1).alias("rep")), "rid", "left")
    lines = hashes.select("host", F.coalesce("rep", F.lit(0)).alias("rep"), F.explode("hs").alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n_rows"), F.sum("rep").alias("docs"))
    over = (
        counts.filter(F.col("docs") > min_docs)
        .join(hosts, "host")
        .filter(F.col("docs") * 100 > F.col("host_docs") * percent)
        .select("host", "h", "n_rows")
    )
    total = counted.agg(F.sum(F.size("lines"))).first()[0] or 0
    return stage(over, "lines"), total


def removed_words(counted: DataFrame, frequent: DataFrame, total: int) -> DataFrame:
    """Words in removed lines by row: (rid, removed)."""
    lines = counted.select("rid", "host", F.explode("lines").alias("l")).select(
        "rid", "host", F.col("l.h").alias("h"), F.col("l.words").alias("words")
    )
    hits = attach(lines, frequent, ["host", "h"], "n_rows", total)
    return hits.groupBy("rid").agg(F.sum("words").alias("removed"))


def judge(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    min_docs: int = MIN_LINE_DOCS,
    percent: int = LINE_PERCENT,
    keep_percent: int = KEEP_PERCENT,
) -> DataFrame:
    """One row per document: the counts, base_failed, removed_words and kept."""
    counted = measured(docs, id_column, text_column, host_column)
    frequent, total = frequent_lines(counted, min_docs, percent)
    removed = removed_words(counted, frequent, total)
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    rows = counted.select(
        "rid",
        "doc_id",
        F.col("w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct(F.transform("lines", lambda x: x["raw"])))).cast("long").alias("n_dup_lines"),
        F.col("w.repeated").cast("long").alias("n_repeat_words"),
    )
    failed = (n < MIN_WORDS) | (repeated * 100 > n * MAX_REPEAT_PERCENT)
    gone = F.coalesce("removed", F.lit(0)).cast("long")
    return (
        rows.join(removed, "rid", "left")
        .withColumn("removed_words", gone)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & ((n - F.col("removed_words")) * 100 >= n * keep_percent))
        .drop("rid", "removed")
    )


def without_frequent_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    host_column: str = "source",
    min_docs: int = MIN_LINE_DOCS,
    percent: int = LINE_PERCENT,
) -> DataFrame:
    """The documents (id and host) with the lines over the limits taken out of their texts."""
    counted = measured(docs, id_column, text_column, host_column)
    frequent, _ = frequent_lines(counted, min_docs, percent)
    numbered = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(f"`{id_column}`").alias("doc_id"),
        F.coalesce(F.col(f"`{host_column}`").cast("string"), F.lit("\0")).alias("host"),
        F.posexplode(F.split(text_of(f"`{text_column}`"), "\n")).alias("pos", "line"),
    ).withColumn("h", line_key(F.col("line")))
    kept = numbered.join(frequent.select("host", "h"), ["host", "h"], "left_anti")
    joined = kept.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return numbered.select("rid", "doc_id").distinct().join(joined, ["rid", "doc_id"], "left").select(
        "doc_id", F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("")).alias("text")
    )
