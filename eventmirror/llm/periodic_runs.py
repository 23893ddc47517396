"""Periodic runs of words: seed and extend on the diagonals of a text compared with itself.

A run of period q and length L repeats L - q words at lag q. Seeds are k-grams of the overlap that every run of a band of lags must
have: 6 words below lag 8 (LEAST words at least, or twice the period), and 2^b words for the lags from 2^b to 2^(b+1). Occurrences
of a seed in one document whose distance lies in the band are paired and extended to the right.

Per lag, an extension covers every later pair inside it, and a pair is covered just when the words before its two places agree, so
the furthest point covered needs no look at the text: such pairs are stepped over, as many at once as follow on each other. Of
a stretch only its first pair is left, so the pairs of a band grow with the words, even if one word makes up the text. A pair is
extended only if the seed at the end of the least overlap agrees too and no known run of a divisor of the lag covers it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, raw_text, slices

#: Words of the shortest run.
LEAST = 12
#: Words of the shortest seed: at lag q a run repeats max(LEAST - q, q) words.
SEED = LEAST // 2
#: Bytes of text compared at a time; a longer text goes alone.
BATCH_BYTES = 1 << 20
#: Pairs of words looked at in one step of an extension.
STEP = 1 << 18
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _joined(h: np.ndarray, other: np.ndarray, by: int) -> np.ndarray:
    """Hashes of the grams that consist of the gram of h at i and that of `other` at i + by."""
    return mix64(h * np.uint64(0x9E3779B97F4A7C15) + np.append(other[by:], np.zeros(min(by, len(other)), np.uint64)))


def seed_pairs(at: np.ndarray, seed: np.ndarray, before: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of occurrences of one seed at a distance in [low, high) that no earlier pair of their lag covers.

    `at` ascends; `before` is the word in front of each place.
    """
    order, span = np.argsort(seed, kind="stable"), int(at[-1]) + high + 1
    at, seed, before = at[order], seed[order], before[order]
    group = np.cumsum(np.append(False, seed[1:] != seed[:-1]))
    line = group * span + at
    first, stop = np.searchsorted(line, line + low), np.searchsorted(line, line + high)
    # The next occurrence that has another word in front of it.
    ends = np.append(np.flatnonzero((group[1:] != group[:-1]) | (before[1:] != before[:-1])) + 1, len(at))
    beyond = np.repeat(ends, np.diff(np.append(0, ends)))
    mine = np.flatnonzero(first < stop)
    other, stop = first[mine], stop[mine]
    places, lags = [], []
    while len(mine):
        covered = before[other] == before[mine]
        places.append(at[mine[~covered]])
        lags.append(at[other[~covered]] - places[-1])
        other = np.where(covered, beyond[other], other + 1)
        left = other < stop
        mine, other, stop = mine[left], other[left], stop[left]
    return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *lags])


def extend(words: np.ndarray, at: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """How many words from `at` on equal those `lag` further on. The last word equals no other."""
    reach, open_, width = np.zeros(len(at), np.int64), np.arange(len(at)), 32
    while len(open_):
        left = []
        for part in np.array_split(open_, -(-len(open_) * width // STEP)):
            here = np.minimum((at[part] + reach[part])[:, None] + np.arange(width), len(words) - 1)
            differs = words[here] != words[np.minimum(here + lag[part][:, None], len(words) - 1)]
            ends = differs.any(1)
            reach[part] += np.where(ends, differs.argmax(1), width)
            left.append(part[~ends])
        open_, width = np.concatenate(left), min(2 * width, STEP)
    return reach


def covered(known: np.ndarray, at: np.ndarray, lag: np.ndarray, k: int) -> np.ndarray:
    """Which pairs lie in a known run whose period divides their lag: all they give is that run again. Known runs come by start, and
    as the words before such a pair differ, the run starts where the pair does."""
    first, stop = np.searchsorted(known[:, 0], at), np.searchsorted(known[:, 0], at, side="right")
    out = np.zeros(len(at), bool)
    for step in range(int((stop - first).max(initial=0))):
        some = np.flatnonzero(first + step < stop)
        _, length, period = known[first[some] + step].T
        out[some] |= (lag[some] % period == 0) & (length >= lag[some] + k)
    return out


def runs_of(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period.

    `words` are numbers of words; every document is between two separators, which are numbers used nowhere else. `doc` is each
    place's document.
    """
    none = np.zeros((0, 3), np.int64)
    h1 = mix64(words.astype(np.uint64))
    h2 = _joined(h1, h1, 1)
    h = _joined(h2, h2, 2)
    own = doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    seeds = _joined(h, h2, 4) ^ own
    # Only places whose seed occurs again in their document can lie in a run.
    ordered = np.sort(seeds)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return none
    slot = np.minimum(np.searchsorted(again, seeds), len(again) - 1)
    live = np.flatnonzero(again[slot] == seeds)
    room = np.searchsorted(doc, doc, side="right") - np.arange(len(doc))  # words up to the document's end
    low, high, k, found = 1, SEED + 2, SEED, none
    while (room[live] > 2 * k).any():  # a run of this band has 2 k words at least
        at, lag = seed_pairs(live, seeds[live], words[live - 1], low, high)
        least = np.maximum(LEAST - lag, lag)
        last = at + least - k
        open_ = (seeds[last] == seeds[np.minimum(last + lag, len(words) - 1)]) & ~covered(found, at, lag, k)
        at, lag, least = at[open_], lag[open_], least[open_]
        repeated = extend(words, at, lag)
        new = np.stack([at, repeated + lag, lag], 1)[repeated >= least]
        found = np.concatenate([found, new])
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        low, high = (8, 16) if low == 1 else (high, 2 * high)
        h = _joined(h, h, k // 2 if k > SEED else 4)
        k = low
        seeds = h ^ own
        live = live[room[live] > k]
    # A stretch may have a row for several of its periods: the smallest counts.
    first = np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))[: len(found)]
    runs = found[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words as numbers between separators, each place's text, place of each text's first word)."""
    numbers: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes
    out = np.zeros(int(sizes.sum()) + len(texts) + 1, np.int64)
    out[np.append(0, first + sizes)] = -1 - np.arange(len(texts) + 1)
    inside = out == 0
    out[inside] = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, int(sizes.sum()))
    return out, np.append(0, np.repeat(np.arange(len(texts)), sizes + 1)), first


def find_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the text replaced by `runs` and `collapsed`.

    Words are what white space of ASCII separates. A run is a stretch of words with smallest period q (words q apart are identical) and
    at least max(LEAST, 2 q) words that no neighbouring word extends; runs (start, length, period; words from 0) come by start and
    period. `collapsed` has the words that lie in no run after its first q words, joined by one space. A null or empty text has no
    runs and an empty `collapsed`. Rows that repeat are handled one by one; columns of these names are replaced. All work is within
    a row's task: nothing is dealt out, and a text of any length is compared whole, with memory in proportion to it.
    """
    kept = [c for c in df.columns if c not in (text, "runs", "collapsed")]
    out = T.StructType([*[df.schema[c] for c in kept], *T._parse_datatype_string(f"runs {RUNS}, collapsed binary").fields])
    item = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches):
        for batch in batches:
            raw = batch.column(len(kept))
            for a, b in slices(np.array([len(x) for x in raw.to_pylist()], np.int64), BATCH_BYTES):
                texts = [x.split() for x in raw.slice(a, b - a).to_pylist()]
                words, doc, first = numbered(texts)
                runs = runs_of(words, doc)
                ends = np.searchsorted(runs[:, 0], np.append(first, len(words)))
                collapsed = []
                for i, own in enumerate(texts):
                    mine = runs[ends[i] : ends[i + 1]]
                    if len(mine):
                        mine[:, 0] -= first[i]
                        edges = np.zeros(len(own) + 1, np.int64)
                        np.add.at(edges, mine[:, 0] + mine[:, 2], 1)
                        np.add.at(edges, mine[:, 0] + mine[:, 1], -1)
                        own = [own[j] for j in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                    collapsed.append(b" ".join(own))
                spans = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], fields=list(item))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans), pa.array(collapsed, pa.binary())], names=out.names
                )

    found = raw_text(df, text, kept).mapInArrow(run, out)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def periodic_text(doc_id: Column, text: Column) -> Column:
    """The text, and for one document in ten a text that repeats: with h = crc32(doc_id), g = h / 10 and h % 10 = 0, each of
    its n words i from a = g % n on is word a + (i - a) % p, where p = 1 + (n - a) / (3 + g % 8). A null doc_id leaves it as it is."""
    h = F.crc32(doc_id.cast("string"))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    repeated = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    looped = F.concat(F.slice(words, F.lit(1), a), F.slice(repeated, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(looped, " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: smallest start, then period; nulls if there
    is none), and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("_b.start"), F.col("_b.length"), -F.col("_b.period")
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
