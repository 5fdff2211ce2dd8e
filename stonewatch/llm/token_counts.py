"""Token counts by compiled finite-state machines (see transducer.py).

Works on the whole text, in one pass without a shuffle. Special strings inside a text are one
token each, as the library takes them by default, and cut it into parts that are split on
their own. Null texts are empty texts with 0 tokens; ids may be null or repeated; empty
tables give empty results; extra columns are ignored. Texts are handled SLICE_CHARS characters
at a time (a longer text is a slice of its own), which bounds a worker's memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import frugal, text_of
from stonewatch.llm.transducer import file_of, piece_transducer, pieces

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
SLICE_CHARS = 2_000_000


def slices(texts: Iterable[str], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters together."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > chars:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def parts_of(texts: list[str], special: list[str]) -> tuple[list[str], np.ndarray, list[list[str]]]:
    """Texts cut at special strings: all parts, the text each belongs to, and the strings met."""
    if not any(s in t for s in special for t in texts):
        return texts, np.arange(len(texts)), []
    pattern = re.compile("|".join(map(re.escape, special)))
    cut = [pattern.split(t) for t in texts]
    met = [pattern.findall(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    return [p for c in cut for p in c], owner, met


def count_tokens(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text."""
    machine = piece_transducer(path)
    parts, owner, met = parts_of(texts, machine.special)
    encoded, starts = pieces(parts, True)
    per_piece = np.fromiter(map(machine.count, encoded.dictionary.to_pylist()), np.int64, len(encoded.dictionary))
    running = np.concatenate(([0], np.cumsum(per_piece[encoded.indices.to_numpy()])))
    tokens = np.zeros(len(texts), np.int64)
    np.add.at(tokens, owner, np.diff(running[starts]))
    if met:
        tokens += [len(m) for m in met]
    return tokens


def token_counts(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    limit: int = LIMIT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""

    @frugal
    def counted(batches):
        path = file_of(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [count_tokens(s, path) for s in slices(texts)]
            n = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    text = text_of(f"`{text_column}`")
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        text.alias("text"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
