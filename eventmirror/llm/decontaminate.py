"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

A seed hashes the words of a window at the positions of a fixed mask and ignores the rest, so
a substituted word at an ignored position does not change it. Benchmark and training seeds are
joined; around each hit the two texts are laid over each other and compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids

#: Together these masks find every pair of 13-word windows with at most two substitutions
#: (checked exhaustively in the tests).
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, EQUAL = 13, 11
#: Items of fewer words are no evidence of a leak and are left out.
LEAST_WORDS = 5
#: Seeds are broadcast up to this many (about 24 bytes each), beyond it the join shuffles.
BROADCAST_SEEDS = 2_000_000


def words(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits."""
    runs = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(runs, lambda w: F.xxhash64(w))


def seed(hashes: Column, at: Column, mask: tuple[int, ...]) -> Column:
    """The hash of the masked words of the window that starts at `at`."""
    name = F.lit(",".join(map(str, mask)))
    return F.xxhash64(name, *[F.get(hashes, at + F.lit(m)) for m in mask])


def keyed(hashes: Column, at: Column, mask: tuple[int, ...], name: str) -> Column:
    """(place, seed) of each of the places `at`."""
    return F.transform(at, lambda i: F.struct(i.alias(name), seed(hashes, i, mask).alias("key")))


def _places(hashes: Column, mask: tuple[int, ...]) -> Column:
    last = F.size(hashes) - F.lit(mask[-1] + 1)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _bit(key: Column, bits: int) -> tuple[Column, Column]:
    """Word and bit of a key in a bitmap of `bits` bits."""
    place = F.pmod(key, F.lit(bits))
    return F.shiftright(place, 6).cast("int"), F.pmod(place, F.lit(64)).cast("int")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every document that overlaps a benchmark item, with the items.

    An overlap is 13 consecutive words of an item of which 11 or more equal the document's words
    at the same distance; an item of 5 to 12 words must occur whole. Words are lower-cased runs of
    letters and digits. Returns doc_id, item_ids (sorted), n_items, n_equal (most equal words on one
    alignment), for leaking documents only. Null and empty texts and items of under 5 words match
    nothing; rows that share a doc_id are one document; equal items are each reported; empty tables
    give an empty result; other columns are ignored.

    A bitmap of the benchmark's seeds (64 bits a seed, up to 2**24 bits, which is 2 MB, however large the benchmark)
    thins out the positions inside each row before anything is exploded; the join on the seed is exact.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", words(F.col("text")).alias("item")).where(F.size("item") >= LEAST_WORDS)
    short = sorted(r[0] for r in items.where(F.size("item") < WINDOW).select(F.size("item")).distinct().collect())
    masks = [*MASKS, *[tuple(range(n)) for n in short]]

    def seeds_of(hashes: Column, whole: bool) -> list[Column]:
        out = []
        for k, mask in enumerate(masks):
            full = k >= len(MASKS)
            at = _places(hashes, mask)
            if whole and full:  # an all-ones mask stands for the items of its length only
                at = F.when(F.size(hashes) == len(mask), at).otherwise(F.array().cast("array<int>"))
            elif whole:
                at = F.when(F.size(hashes) >= WINDOW, at).otherwise(F.array().cast("array<int>"))
            out.append((at, mask))
        return out

    seeds = items.select(
        "item_id",
        F.explode(
            F.concat(*[keyed(F.col("item"), at, mask, "item_at") for at, mask in seeds_of(F.col("item"), True)])
        ).alias("s"),
    ).select("item_id", "s.item_at", "s.key")
    n_seeds = seeds.count()
    bits = 1 << min(24, max(12, (64 * n_seeds).bit_length()))
    word, bit = _bit(F.col("key"), bits)
    filled = dict(
        seeds.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("v")).collect()
    )
    bitmap = F.split(F.lit(",".join(str(filled.get(w, 0)) for w in range(bits // 64))), ",").cast("array<bigint>")

    def likely(hashes: Column, at: Column, mask: tuple[int, ...]) -> Column:
        def known(i: Column) -> Column:
            w, b = _bit(seed(hashes, i, mask), bits)
            return F.getbit(F.get(bitmap, w), b) == 1

        return F.filter(at, known)

    near = F.concat(*[keyed(F.col("h"), likely(F.col("h"), at, mask), mask, "at") for at, mask in seeds_of(F.col("h"), False)])
    hits = docs.select("doc_id", words(F.col("text")).alias("h")).select("doc_id", "h", F.explode(near).alias("s")).select("doc_id", "h", "s.at", "s.key")
    if n_seeds <= BROADCAST_SEEDS:
        hits = hits.join(F.broadcast(seeds), "key").join(F.broadcast(items), "item_id")
    else:
        hits = hits.join(seeds, "key").join(items, "item_id")
    # The item's word k lies over the document's word k + shift.
    shift = F.col("at") - F.col("item_at")
    low = F.greatest(F.lit(0), -shift)
    high = F.least(F.size("item"), F.size("h") - shift)
    equal = F.transform(F.sequence(low, high - 1), lambda k: (F.get("h", k + shift) == F.get("item", k)).cast("int"))
    width = F.least(F.lit(WINDOW), F.size("item"))
    need = F.when(F.size("item") < WINDOW, F.size("item")).otherwise(F.lit(EQUAL))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    found = (
        hits.select("doc_id", "item_id", equal.alias("equal"), width.alias("width"), need.alias("need"))
        .where(F.size("equal") >= F.col("width"))
        .where(F.exists(F.sequence(F.lit(1), F.size("equal") - F.col("width") + 1), lambda s: add(F.slice("equal", s, F.col("width"))) >= F.col("need")))
        .select("doc_id", "item_id", add(F.col("equal")).alias("n"))
    )
    return (
        found.groupBy("doc_id", "item_id").agg(F.max("n").alias("n"))
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n_items"), F.max("n").alias("n_equal"))
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that find_leaks() names; a null doc_id is never removed."""
    return by_ids(docs, find_leaks(docs, benchmark), "left_anti")


SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS p
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS l FROM documents)),
b AS (
  SELECT item_id, len(l) AS n, unnest(l) AS word, generate_subscripts(l, 1) AS p
  FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS l FROM benchmark)
  WHERE len(l) >= 5),
m AS (
  SELECT w.doc_id, b.item_id, b.n, w.p - b.p AS shift, b.p AS k
  FROM w JOIN b USING (word)),
c AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS eq,
    lag(k, (CASE WHEN n < 13 THEN n ELSE 11 END) - 1) OVER (PARTITION BY doc_id, item_id, shift, n ORDER BY k) AS back
  FROM m
  QUALIFY eq >= CASE WHEN n < 13 THEN n ELSE 11 END),
f AS (
  SELECT doc_id, item_id, max(eq) AS n FROM c
  WHERE k - back < least(13, n)
  GROUP BY ALL)
SELECT doc_id, list_sort(list(item_id)) AS item_ids, count(*) AS n_items, max(n)::INTEGER AS n_equal
FROM f GROUP BY doc_id
"""
