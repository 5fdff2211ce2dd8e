"""Packing token sequences into windows by minimum bin slack.

A document's ids (with the closing id) fill whole windows first. What remains of the
documents of a partition is held in a buffer of at most HELD pieces; each window takes the
longest piece, and a subset-sum program over a bitset (bit s is set when lengths with sum s
can be taken) picks the multiset of further lengths that fills the window closest to
capacity; the counts taken of each length are found by walking the bitsets back. If even the
best choice leaves slack, one more piece is cut to close it. At a partition's end the
remaining ids are cut at powers of two, so that no sequence needs padding.

One pass, no shuffle: sequences never cross partitions, and ids of sequences are unique by
partition number. A partition read again after a lost executor gives the same sequences.

Null texts are empty texts: they have the closing id only. Null or repeated ids are carried
along; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import frugal, text_of
from stonewatch.llm.token_counts import parts_of, slices
from stonewatch.llm.transducer import byte_letters, file_of, pieces

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
CLOSING_ID = 1
HELD = 1024
LOW_WATER = 256
MAX_KNOWN = 300_000
#: UTF-8 bytes of the letters below U+0240 are under this one; such letters, lower-cased, are in NFC.
LATIN_END = 0xC9


class WordIds:
    """Ids of whole texts; the library is asked once for each distinct piece.

    A run of Latin letters passes normaliser and splitter unchanged and whole, so it goes straight
    to the library's model; all other pieces go through the whole library.
    """

    def __init__(self, path: str):
        # one thread a task: Spark runs the tasks side by side
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.known: dict[bytes, bytes] = {}  # ids of a piece as packed uint16

    @staticmethod
    def normalised(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return text.lower()

    def _ids(self, found: list[bytes]) -> list[bytes]:
        known = self.known
        if len(known) > MAX_KNOWN:
            known.clear()
        each = list(map(known.get, found))
        missing = [i for i, ids in enumerate(each) if ids is None]
        others = []
        for i in missing:
            piece = found[i]
            text = piece.decode()
            if text.isalpha() and max(piece) < LATIN_END:
                if not text.isascii():
                    text = piece.decode("latin-1").translate(self.letters)
                each[i] = known[piece] = array("H", [t.id for t in self.model.tokenize(text)]).tobytes()
            else:
                others.append(i)
        for i in range(0, len(others), 1000):
            some = others[i : i + 1000]
            encoded = self.library.encode_batch([found[k].decode() for k in some], add_special_tokens=False)
            for k, e in zip(some, encoded):
                each[k] = known[found[k]] = array("H", e.ids).tobytes()
        return each

    def of_texts(self, texts: list[str]) -> list[np.ndarray]:
        """uint16 ids of each text with CLOSING_ID at the end."""
        parts, owner, met = parts_of(texts, list(self.special))
        encoded, starts = pieces([self.normalised(p) for p in parts], False)
        each = self._ids(encoded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // 2
        flat = np.frombuffer(b"".join(each), np.uint16)
        at = np.cumsum(lengths) - lengths
        order = encoded.indices.to_numpy()
        taken = lengths[order]
        ends = np.cumsum(taken)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(at[order] - (ends - taken), taken) + np.arange(total)]
        cuts = np.concatenate(([0], ends))[starts]
        close = np.array([CLOSING_ID], np.uint16)
        if not met:
            return [np.concatenate((ids[a:b], close)) for a, b in zip(cuts[:-1], cuts[1:])]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        seen = [0] * len(texts)
        for i, a, b in zip(owner, cuts[:-1], cuts[1:]):
            if out[i]:  # the special string before this part
                out[i].append(np.array([self.special[met[i][seen[i]]]], np.uint16))
                seen[i] += 1
            out[i].append(ids[a:b])
        return [np.concatenate((*o, close)) for o in out]


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of the lengths (given longest first) with the largest sum not over `room`."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        left, batch = min(counts[length], room // length), 1
        while left > 0:  # counts in binary: 1, 2, 4, ..., rest
            take = min(batch, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            batch *= 2
        if reach >> room:
            break
    best = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return chosen


class Packer:
    """Windows of one partition; `emit` is called with (piece, sequence, offset)."""

    def __init__(self, capacity: int, emit):
        self.capacity, self.emit = capacity, emit
        self.held: dict[int, list] = {}  # pieces (document, start, length) by length
        self.n, self.total, self.sequence = 0, 0, 0

    def add(self, document, length: int) -> None:
        start = 0
        while length - start >= self.capacity:
            self.emit((document, start, self.capacity), self.sequence, 0)
            self.sequence += 1
            start += self.capacity
        if length > start:
            self._hold((document, start, length - start))
        if self.n >= HELD:
            self.pack(LOW_WATER)

    def _hold(self, piece) -> None:
        self.held.setdefault(piece[2], []).append(piece)
        self.n += 1
        self.total += piece[2]

    def _take(self, length: int):
        queue = self.held[length]
        piece = queue.pop()
        if not queue:
            del self.held[length]
        self.n -= 1
        self.total -= length
        return piece

    def pack(self, until: int) -> None:
        """Fill windows while more than `until` pieces and a whole window of ids are held."""
        while self.n > until and self.total >= self.capacity:
            longest = max(self.held)
            window = [self._take(longest)]
            lengths = sorted(self.held, reverse=True)
            chosen = fill(lengths, {k: len(v) for k, v in self.held.items()}, self.capacity - longest)
            for length, times in chosen.items():
                window.extend(self._take(length) for _ in range(times))
            slack = self.capacity - sum(p[2] for p in window)
            if slack:
                document, start, length = self._take(max(self.held))
                window.append((document, start, slack))
                self._hold((document, start + slack, length - slack))
            self._put(window)

    def _put(self, window) -> None:
        offset = 0
        for piece in window:
            self.emit(piece, self.sequence, offset)
            offset += piece[2]
        self.sequence += 1

    def finish(self) -> None:
        """Fill the last windows, then cut the rest, under one window, at powers of two."""
        self.pack(0)
        rest = [p for length in sorted(self.held, reverse=True) for p in self.held[length]]
        room, total, window = 0, self.total, []
        while rest:
            if not room:
                room = 1 << (total.bit_length() - 1)
                total -= room
            document, start, length = rest.pop(0)
            part = min(length, room)
            window.append((document, start, part))
            room -= part
            if part < length:
                rest.insert(0, (document, start + part, length - part))
            if not room:
                self._put(window)
                window = []
        self.held, self.n, self.total = {}, 0, 0


def _pieces_schema(with_ids: bool) -> str:
    plain = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return plain + (", ids array<int>" if with_ids else "")


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool):
    encoder = word_ids(path)
    first = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []

    def emit(piece, sequence: int, offset: int) -> None:
        (doc_id, ids), start, length = piece
        own = ids[start : start + length]
        row = (doc_id, start, length, zlib.crc32(own.astype("<u4").tobytes()), len(ids), first + sequence, offset)
        rows.append((*row, own.astype(np.int32)) if with_ids else row)

    names = [c.split(" ")[0] for c in _pieces_schema(with_ids).split(", ")]
    kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    packer = Packer(capacity, emit)
    for batch in batches:
        doc_ids = iter(batch.column(0).to_pylist())
        for texts in slices(batch.column(1).to_pylist()):
            for ids in encoder.of_texts(texts):
                packer.add((next(doc_ids), ids), len(ids))
            if rows:
                yield flush()
    packer.finish()
    if rows:
        yield flush()


def pack(
    docs: DataFrame,
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `with_ids` adds the piece's ids. A sequence is the pieces of one sequence_id by offset.
    """

    @frugal
    def packed(batches):
        return _packed(batches, file_of(tokenizer), capacity, with_ids)

    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), text_of(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(packed, _pieces_schema(with_ids))
