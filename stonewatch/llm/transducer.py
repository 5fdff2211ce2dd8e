"""Tokenizers compiled to finite-state machines.

Two machines work one after the other. `Splitter` is the pre-tokenizer's regular expression
as a deterministic transducer over character classes: every transition says whether a piece
begins at the character. All state maps that characters can cause are enumerated (a small
monoid), so a text of any length is cut into chunks whose maps are found side by side and
composed by a parallel prefix scan; no chunk waits for the one before. `PieceTransducer`
reads one piece by bytes: its states are prefixes, compiled when first met and shared
between pieces, and its transitions carry how many tokens the step adds or takes away, so
the sum along a piece is its number of tokens under byte-pair merging.

The prefix states rest on two facts of byte-pair merging: leaving out the last token of an
encoding gives the encoding of the rest, and a sequence of tokens is an encoding exactly if
each two neighbours are one. So the last token of a prefix is the one suffix of it that is a
token compatible with the last token of what stands before.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa

# characters as the machine sees them; a text's first character has FIRST added
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACE_LAST, SPACE_MORE, BLANK_LAST, BLANK_MORE = range(9)
N_SYMBOLS = 9
FIRST = N_SYMBOLS
# states: what the open piece consists of
NOTHING, LETTERS, NUMBERS, OTHERS, ONE_SPACE, BLANKS, CLIP1, CLIP2 = range(8)
N_STATES = 8

#: Letters after an apostrophe that form a piece with it.
CLIPS_ONE = "stmd"
CLIPS_TWO = ("re", "ve", "ll")

CHUNK = 512
MAX_NODES = 1_000_000
MAX_SHARED_BYTES = 64


def file_of(tokenizer: str) -> str:
    """A path as it is, or the place of one of the public vocabulary files by name."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


@lru_cache(1)
def character_classes() -> np.ndarray:
    """Class of every code point: LETTER, NUMBER, OTHER, SPACE_MORE (the space) or BLANK_MORE."""
    import regex

    text = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    classes = np.full(0x110000, OTHER, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", BLANK_MORE)):
        for run in regex.finditer(pattern, text):
            classes[ord(run[0][0]) : ord(run[0][-1]) + 1] = value
    classes[32] = SPACE_MORE
    return classes


class Splitter:
    """Where pieces begin. `join_space`: a single space belongs to the piece after it and
    numbers form runs; otherwise every blank and every numeral is a piece of its own."""

    def __init__(self, join_space: bool):
        step = [[self._step(s, c, join_space) for c in range(N_SYMBOLS)] for s in range(N_STATES)]
        # a text's first character acts as from NOTHING, whatever came before
        for row in step:
            row.extend(step[NOTHING][:N_SYMBOLS])
        self.begins = np.array([[b for _, b in row] for row in step], bool).ravel()
        letters = [tuple(step[s][c][0] for s in range(N_STATES)) for c in range(2 * N_SYMBOLS)]
        maps = {tuple(range(N_STATES)): 0}
        order = list(maps)
        after: list[list[int]] = []
        for known in order:  # grows while new maps are found
            row = []
            for letter in letters:
                made = tuple(letter[s] for s in known)
                if made not in maps:
                    maps[made] = len(order)
                    order.append(made)
                row.append(maps[made])
            after.append(row)
        self.n_maps = len(order)
        self.after = np.array(after, np.uint16).ravel()
        self.apply = np.array(order, np.uint8)
        self.compose = np.array(
            [[maps[tuple(b[s] for s in a)] for b in order] for a in order], np.uint16
        )

    @staticmethod
    def _step(state: int, c: int, join: bool) -> tuple[int, bool]:
        """Next state, and whether a piece begins at the character."""
        if state == CLIP2 and c == LETTER:
            return CLIP1, False
        if state == CLIP1 and c == LETTER:
            return NOTHING, False
        joined = state == ONE_SPACE
        if c == LETTER:
            return LETTERS, not (state == LETTERS or joined)
        if c == NUMBER:
            return (NUMBERS, not (state == NUMBERS or joined)) if join else (NOTHING, True)
        if c == OTHER or c in (QUOTE2, QUOTE3) and (joined or state == OTHERS):
            return OTHERS, not (state == OTHERS or joined)
        if c in (QUOTE2, QUOTE3):
            return (CLIP1 if c == QUOTE2 else CLIP2), True
        if not join:
            return NOTHING, True
        if c == SPACE_LAST:
            return ONE_SPACE, True
        if c == BLANK_LAST:
            return NOTHING, True
        return BLANKS, state != BLANKS

    def starts(self, symbols: np.ndarray) -> np.ndarray:
        """For each symbol, whether a piece begins there; chunks side by side, then a scan."""
        n = len(symbols)
        lanes = -(-n // CHUNK)
        padded = np.zeros(lanes * CHUNK, np.uint8)
        padded[:n] = symbols
        across = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
        maps = np.empty((CHUNK + 1, lanes), np.uint16)
        maps[0] = 0
        for i in range(CHUNK):
            maps[i + 1] = self.after[maps[i].astype(np.int32) * (2 * N_SYMBOLS) + across[i]]
        total = maps[CHUNK].copy()
        reach = 1
        while reach < lanes:  # total[j] becomes the map of all chunks up to j
            total[reach:] = self.compose[total[:-reach], total[reach:]]
            reach *= 2
        entry = np.zeros(lanes, np.uint8)
        entry[1:] = self.apply[total[:-1], NOTHING]
        states = self.apply[maps[:CHUNK], entry[None, :]]
        begins = self.begins[states.astype(np.int32) * (2 * N_SYMBOLS) + across]
        return begins.T.reshape(-1)[:n]


@lru_cache(2)
def splitter(join_space: bool) -> Splitter:
    return Splitter(join_space)


def pieces(texts: list[str], join_space: bool) -> tuple[pa.Array, np.ndarray]:
    """All pieces of all texts in order, dictionary-encoded, and where each text's pieces
    begin among them (one entry more than texts)."""
    joined = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    firsts = ends - sizes
    n = len(joined)
    if n == 0:
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(texts) + 1, np.int64)
    data = joined.encode("utf-8", "replace")
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    classes = character_classes()[points]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    blank = classes >= SPACE_MORE
    # the last blank of a run counts apart, unless the text ends there
    last = np.zeros(n, bool)
    last[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    symbols = classes - last
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        end = np.append(firsts[sizes > 0], n)[np.searchsorted(firsts[sizes > 0], quotes, "right")]
        ahead = lambda k: np.where(quotes + k < end, points[np.minimum(quotes + k, n - 1)], 0)
        one, two = ahead(1), ahead(2)
        symbols[quotes[np.isin(one, [ord(c) for c in CLIPS_ONE])]] = QUOTE2
        for a, b in CLIPS_TWO:
            symbols[quotes[(one == ord(a)) & (two == ord(b))]] = QUOTE3
    symbols[first[:n]] += FIRST
    begins = np.flatnonzero(splitter(join_space).starts(symbols))
    width = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
    if len(data) == n:
        offsets = np.append(begins, n)
    else:
        offsets = np.append((np.cumsum(width, dtype=np.int64) - width)[begins], len(data))
    kind, ints = (pa.binary(), np.int32) if len(data) < 2**31 else (pa.large_binary(), np.int64)
    array = pa.Array.from_buffers(
        kind, len(begins), [None, pa.py_buffer(offsets.astype(ints).tobytes()), pa.py_buffer(data)]
    )
    return array.dictionary_encode(), np.append(np.searchsorted(begins, firsts), len(begins))


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the other bytes follow in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceTransducer:
    """Number of tokens of a piece, by a lazily compiled machine over its bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, letters = described["model"], byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.special = [t["content"] for t in described["added_tokens"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.endings: dict = {}  # tokens by their bytes from the last to the first
        for token in self.tokens:
            at = self.endings
            for b in reversed(token):
                at = at.setdefault(b, {})
            at[-1] = token
        self.nodes: dict[bytes, tuple[int, bytes]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.counts: dict[bytes, int] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Byte-pair merging by its definition; used on two tokens at a time."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))]
            best, at = min(ranked)
            if best == 1 << 60:
                break
            pair, out, i = (parts[at], parts[at + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _compatible(self, a: bytes, b: bytes) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def _last(self, piece: bytes, end: int, before) -> bytes:
        """The last token of piece[:end]; `before(i)` is the last token of piece[:i]."""
        at, i = self.endings, end
        while i > 0:
            at = at.get(piece[i - 1])
            if at is None:
                break
            i -= 1
            token = at.get(-1)
            if token is not None and self._compatible(before(i), token):
                return token
        raise AssertionError("a vocabulary that lacks single bytes")

    def step(self, piece: bytes, end: int) -> int:
        """Compile the transition from piece[:end - 1] over one byte: the tokens it adds (or takes away)."""
        token = self._last(piece, end, lambda i: self.nodes[piece[:i]][1])
        tokens = self.nodes[piece[: end - len(token)]][0] + 1
        self.nodes[piece[:end]] = (tokens, token)
        return tokens - self.nodes[piece[: end - 1]][0]

    def count(self, piece: bytes) -> int:
        known = self.counts.get(piece)
        if known is not None:
            return known
        if len(self.nodes) > MAX_NODES or len(self.fits) > MAX_NODES:
            self.nodes.clear(), self.fits.clear(), self.counts.clear()
        self.nodes[b""] = (0, b"")
        if len(piece) <= MAX_SHARED_BYTES:
            known_to = len(piece)
            while piece[:known_to] not in self.nodes:
                known_to -= 1
            total = self.nodes[piece[:known_to]][0]
            for end in range(known_to + 1, len(piece) + 1):
                total += self.step(piece, end)
            self.counts[piece] = total
            return total
        counts, lasts = [0], [b""]  # a long piece keeps its states to itself
        for end in range(1, len(piece) + 1):
            token = self._last(piece, end, lasts.__getitem__)
            lasts.append(token)
            counts.append(counts[end - len(token)] + 1)
        return counts[-1]


@lru_cache(4)
def piece_transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)
