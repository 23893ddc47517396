"""Byte-level BPE: pre-tokenisation by scanned transition functions, cached pair merging, decoding.

The split pattern is that of byte-level BPE vocabularies of this family:
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
No regular expression runs. Every code point gets a class; with its next neighbours it becomes a
symbol; a symbol is a function from scanner state to scanner state. Function composition is
associative, so the states of all characters of a batch come from a blocked prefix scan.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

LETTER, NUMBER, OTHER, SPACE, WHITE, END = range(6)
#: White_Space of Unicode without the space itself.
WHITE_SPACE = (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Symbols: a white-space character is "last" if something that is no white space follows.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_LAST_SPACE, S_LAST_WHITE, S_MORE_WHITE, S_END = range(9)
# States: in a run of letters, numbers or others; after a space that the next run takes; in white
# space; one or two letters of a contraction to come; FRESH: whatever follows starts a match.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, PREFIX, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
NONE = 1 << 60
#: By class and whether something that is no white space follows.
SYMBOL = np.array([S_LETTER] * 2 + [S_NUMBER] * 2 + [S_OTHER] * 2 + [S_MORE_WHITE, S_LAST_SPACE, S_MORE_WHITE, S_LAST_WHITE] + [S_END] * 2, np.uint8)
BATCH_CHARS, BATCH_TOKENS = 1 << 19, 1 << 17
#: Pieces whose merges a worker remembers, about 30 MB.
CACHED = 150_000


# Letters and numbers that Unicode 16 added (first and last code point), which an older Python does not know.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point, by Unicode 16 as the library has it."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[list(WHITE_SPACE)] = WHITE
    out[32] = SPACE
    return out


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a match starts here) by symbol and state."""
    go, cut = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for symbol, run in ((S_LETTER, IN_LETTERS), (S_NUMBER, IN_NUMBERS), (S_OTHER, IN_OTHERS), (S_QUOTE1, IN_OTHERS), (S_QUOTE2, IN_OTHERS)):
        go[symbol] = run
        cut[symbol, [run, PREFIX]] = False
    for symbol, rest in ((S_QUOTE1, ONE_MORE), (S_QUOTE2, TWO_MORE)):
        start = [s for s in range(8) if s not in (IN_OTHERS, PREFIX)]
        go[symbol, start] = rest
    go[S_LETTER, ONE_MORE], go[S_LETTER, TWO_MORE] = FRESH, ONE_MORE
    cut[S_LETTER, [ONE_MORE, TWO_MORE]] = False
    go[S_LAST_SPACE], go[S_LAST_WHITE], go[S_END] = PREFIX, FRESH, FRESH
    go[S_MORE_WHITE] = IN_WHITE
    cut[S_MORE_WHITE, IN_WHITE] = False
    return go, cut


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Symbol of every character; `ends` are the places of the end marks between texts."""
    kind = classes()[codes]
    kind[ends] = END
    last = np.append(kind[1:], np.uint8(END)) < SPACE
    out = SYMBOL[kind * np.uint8(2) + last]
    quote = np.flatnonzero((codes == 39) & (kind == OTHER))
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        padded[ends] = 0
        one, two = padded[quote + 1], padded[quote + 2]
        out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = S_QUOTE1
        pair = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            pair |= (one == ord(a)) & (two == ord(b))
        out[quote[pair]] = S_QUOTE2
    return out


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that symbols compose to, by number: (number of each symbol, composition table, state
    that each function leads to from each state). Number 0 is the identity. There are a few dozen."""
    go = machine()[0]
    known = {tuple(range(8)): 0}
    order = [tuple(range(8))]
    for f in order:
        for row in go:
            g = tuple(int(row[s]) for s in f)
            if g not in known:
                known[g] = len(order)
                order.append(g)
    values = np.array(order, np.uint8)
    after = [[known[tuple(int(g[s]) for s in f)] for g in order] for f in order]
    return np.array([known[tuple(map(int, row))] for row in go], np.intp), np.array(after, np.intp), values


def scan(symbol: np.ndarray, block: int = 256) -> np.ndarray:
    """State before every character, by an associative scan over transition functions.

    Each block composes its own functions, a doubling scan composes those of all blocks before
    it, and a second pass applies them.
    """
    number, after, values = monoid()
    n = len(symbol)
    rows = -(-n // block)
    padded = np.full(rows * block, S_END, np.uint8)
    padded[:n] = symbol
    padded = np.ascontiguousarray(padded.reshape(rows, block).T)
    whole = np.zeros(rows, np.intp)
    for column in number[padded]:
        whole = after[whole, column]
    step = 1
    while step < rows:  # whole[i] becomes the composition of blocks 0..i
        whole = np.concatenate([whole[:step], after[whole[:-step], whole[step:]]])
        step *= 2
    state = np.concatenate([[FRESH], values[whole[:-1], FRESH]]).astype(np.uint8)
    before = np.empty((block, rows), np.uint8)
    go = machine()[0]
    for j, column in enumerate(padded):
        before[j] = state
        state = go[column, state]
    return before.T.ravel()[:n]


def split_texts(texts: list[str]) -> list[list[str]]:
    """The pattern's matches in each text."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    symbol = symbols(codes, ends)
    start = np.flatnonzero(machine()[1][symbol, scan(symbol)])
    at = start.tolist()
    pieces = [joined[a:b] for a, b in zip(at, at[1:])]
    pieces.append("\0")
    # The end mark of a text is a piece of its own.
    marks = np.searchsorted(start, ends).tolist()
    return [pieces[a + 1 : b] for a, b in zip([-1, *marks], marks)]


class Vocabulary:
    """Ranks of a byte-level vocabulary file (base64 token, rank on each line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        # The bytes of all tokens in one array, and where each token lies in it.
        self.lengths = np.zeros(max(self.tokens, default=0) + 1, np.int64)
        for v, k in self.tokens.items():
            self.lengths[v] = len(k)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.raw = np.frombuffer(b"".join(self.tokens[v] for v in sorted(self.tokens)), np.uint8)
        self.cache: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> list[int] | tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            found = self.merge(piece.encode("utf-8", "replace"))
            if len(piece) <= 64:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[piece] = found = tuple(found)
        return found

    def merge(self, raw: bytes) -> list[int]:
        """Merge the leftmost pair of lowest rank until none is left; a heap keeps long pieces cheap."""
        if raw in self.ranks:
            return [self.ranks[raw]]
        ranks, n = self.ranks, len(raw)
        if n <= 32:
            parts = [raw[i : i + 1] for i in range(n)]
            pairs = [ranks.get(raw[i : i + 2], NONE) for i in range(n - 1)]
            while pairs and (low := min(pairs)) < NONE:
                i = pairs.index(low)
                parts[i] += parts.pop(i + 1)
                pairs.pop(i)
                if i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1], NONE)
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
            return [ranks[p] for p in parts]
        end = list(range(1, n + 1))  # end of the part that starts at i
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], after[i], alive[j] = stop, after[j], False
            if after[j] < n:
                prior[after[j]] = i
                if (r := ranks.get(raw[i : end[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[j]]))
            if (p := prior[i]) >= 0 and (r := ranks.get(raw[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        for a, b in slices(np.fromiter(map(len, texts), np.int64, len(texts)), BATCH_CHARS):
            for pieces in split_texts(texts[a:b]):
                ids: list[int] = []
                piece, known = self.piece, self.cache.get
                for p in pieces:
                    ids += known(p) or piece(p)
                yield ids

    def offsets(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The byte at which each token of the texts between `bounds` starts in its own text."""
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths[ids])])
        return at[:-1] - np.repeat(at[bounds[:-1]], np.diff(bounds))

    def place(self, ids: np.ndarray, offsets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of each text: every token's bytes are put where its offset says, and must fill the text without overlap."""
        lengths = self.lengths[ids]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
        if not np.array_equal(offsets, self.offsets(ids, bounds)):
            raise ValueError("the offsets do not fit the tokens")
        within = np.arange(ends[-1]) - np.repeat(ends[:-1], lengths)
        first = ends[bounds]
        out = np.empty(int(ends[-1]), np.uint8)
        out[np.repeat(np.repeat(first[:-1], np.diff(bounds)) + offsets, lengths) + within] = self.raw[np.repeat(self.starts[ids], lengths) + within]
        whole = out.tobytes()
        return [whole[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with the text replaced by `ids` and `offsets`: the byte of the text where each token starts.

    A null text counts as empty and has no ids. `path` is a rank file present on every executor. Columns of these
    names are replaced.
    """
    kept = [c for c in df.columns if c not in (text, "ids", "offsets")]
    numbers = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("ids", numbers, False), T.StructField("offsets", numbers, False)])

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            for a, b in slices(np.ones(len(batch)), 256):
                part = batch.slice(a, b - a)
                ids = [np.array(x, np.int32) for x in own.encode([t or "" for t in part.column(text).to_pylist()])]
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in ids], dtype=np.int64)])
                lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32())) for x in (flat, own.offsets(flat, bounds))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *lists], names=schema.names)

    return df.select(*kept, text).mapInArrow(run, schema)


def decode(df: DataFrame, path: str) -> DataFrame:
    """df with `n_tokens`, `ids_sha256` (of the ids as little-endian unsigned 32-bit integers) and
    `decoded` (the bytes the ids stand for, each put at its offset) in place of `ids` and `offsets`."""
    kept = [c for c in df.columns if c not in ("ids", "offsets")]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column("ids").offsets).astype(np.int64))
            for a, b in slices(sizes, BATCH_TOKENS):
                part = batch.slice(a, b - a)
                ids, offsets = (np.asarray(part.column(c).flatten()) for c in ("ids", "offsets"))
                bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[a:b])])
                spans = zip(bounds[:-1].tolist(), bounds[1:].tolist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in kept],
                        pa.array(sizes[a:b]),
                        pa.array([hashlib.sha256(ids[x:y].astype("<u4").tobytes()).hexdigest() for x, y in spans]),
                        pa.array(own.place(ids, offsets.astype(np.int64), bounds), pa.binary()),
                    ],
                    names=schema.names,
                )

    return df.mapInArrow(run, schema)
