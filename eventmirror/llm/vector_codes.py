"""Vector codes: each of the parts of a vector becomes the number of the nearest entry of its codebook, in whole numbers throughout.

Nearest entries are found under an integer Walsh-Hadamard transform of the zero-padded parts and entries: it keeps squared distances up to
a factor, the padded length, and gathers what differs most in its first rows. Squared differences are added up in sequency order, and
an entry goes as soon as its sum passes the distance of a first guess, or of an entry that is known to be nearer.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components beyond this count as not finite. Within it, squares that pass 62 bits are computed with Python's whole numbers.
LARGEST = 1 << 53
#: Numbers compared in one step.
CELLS = 1 << 20
#: A label with over one row in HOT of all is joined by broadcast; there are fewer than HOT of these.
HOT = 1000


@functools.cache
def walsh(n: int) -> np.ndarray:
    """The Hadamard matrix of n rows, a power of two, by the number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1))]


def transformed(x: np.ndarray) -> np.ndarray:
    """Rows zero-padded to a power of two under walsh()."""
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), n), x.dtype)
    padded[:, : x.shape[1]] = x
    return padded @ walsh(n).astype(x.dtype)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest row of book, squared distance) for each row of x; of equally near ones the first."""
    most = max(int(abs(x).max(initial=0)), int(abs(book).max(initial=0)))
    n = 1 << max(0, x.shape[1] - 1).bit_length()
    exact = np.int64 if 4 * n * n * most * most < 1 << 62 else object
    a, b = transformed(x.astype(exact)), transformed(book.astype(exact))
    number, distance = np.zeros(len(a), np.int64), np.zeros(len(a), exact)
    for start in range(0, len(a), max(1, CELLS // len(b))):
        part = a[start : start + max(1, CELLS // len(b))]
        so_far = (part[:, :1] - b[:, 0]) ** 2
        guess = ((part - b[so_far.argmin(1)]) ** 2).sum(1)
        row, entry = np.nonzero(so_far <= guess[:, None])
        so_far = so_far[row, entry]
        for c in range(1, n):
            so_far = so_far + (part[row, c] - b[entry, c]) ** 2
            left = so_far <= guess[row]
            row, entry, so_far = row[left], entry[left], so_far[left]
        first = np.searchsorted(row, np.arange(len(part)))  # the guess itself is always left
        least = np.minimum.reduceat(so_far, first)
        hit = np.flatnonzero(so_far == least[row])
        chosen = entry[hit[np.searchsorted(row[hit], np.arange(len(part)))]]
        number[start : start + len(part)], distance[start : start + len(part)] = chosen, least // n
    return number, distance


def scaled(vectors: list[np.ndarray], dim: int) -> np.ndarray:
    """floor(SCALE x) of every component, rows padded with zeros to dim."""
    out = np.zeros((len(vectors), dim), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = np.floor(np.asarray(v, np.float64) * SCALE)
    return out


def _parts(rows: np.ndarray):
    """The rows' parts by position."""
    return np.split(rows, PARTS, axis=1)


def fit(vectors: DataFrame, dim: int, first: np.ndarray) -> list[np.ndarray]:
    """The codebooks (entries x dim / PARTS) after ROUNDS rounds from the rows `first`.

    Tasks add up their rows by part and entry; only PARTS x ENTRIES sums a task meet in the shuffle and reach the driver.
    """
    books = _parts(first)
    for _ in range(ROUNDS):
        given = books

        def sums(batches, given=given):
            total = [np.zeros((len(b), b.shape[1] + 1), object) for b in given]
            for pdf in batches:
                for book, part, own in zip(given, _parts(scaled(list(pdf.embedding), dim)), total):
                    entry, _ = nearest(part, book)
                    for e in np.unique(entry):
                        mine = part[entry == e]
                        own[e, :-1] += mine.sum(0) if abs(mine).max(initial=0) < 1 << 40 else mine.astype(object).sum(0)
                        own[e, -1] += len(mine)
            yield pd.DataFrame([(p, e, i, str(x)) for p, own in enumerate(total) for e in range(len(own)) if own[e, -1] for i, x in enumerate(own[e])], columns=["part", "entry", "place", "total"])

        rows = vectors.select("embedding").mapInPandas(sums, "part int, entry int, place int, total string")
        added = rows.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # the size of the codebooks
        totals = {(r.part, r.entry, r.place): int(r.total) for r in added}
        width = dim // PARTS
        books = [
            np.array([[totals[p, e, i] // totals[p, e, width] for i in range(width)] if (p, e, width) in totals else book[e].tolist() for e in range(len(book))], np.int64).reshape(book.shape)
            for p, book in enumerate(books)
        ]
    return books


def kept_vectors(df: DataFrame) -> DataFrame:
    """vec_id, label and embedding (doubles) of the rows whose vector is not null and holds finite numbers only."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > LARGEST / SCALE))
    return df.select("vec_id", "label", e.alias("embedding")).where(F.col("embedding").isNotNull() & ~bad)


def compress(df: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error; the codebooks) of the rows with a vec_id, a vector and a label of any kind.

    Rows whose vector is null or holds null, NaN, infinite or (beyond LARGEST / SCALE) unmanageable components are dropped. Each
    component becomes floor(SCALE x); a vector is cut into PARTS equal parts, after zeros if it is shorter than the longest one or
    its length is no multiple of PARTS. The codebooks start as the parts of the ENTRIES rows of smallest vec_id (null ids last,
    equal ids by vector; fewer rows give fewer entries), are refined in ROUNDS rounds, and unused entries stay. `code` holds
    two hex digits a part, `error` the squared distances summed over parts, null where they pass a long. Equal vectors get equal
    codes; repeated vec_ids are rows of their own. An empty table gives no rows and empty codebooks.
    """
    vectors = materialise(kept_vectors(df), "vectors")
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0]
    dim = max(PARTS, -(-(longest or 0) // PARTS) * PARTS)
    # Taken from each task's smallest, so no task sorts more than ENTRIES rows of every other.
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).collect()
    books = fit(vectors, dim, scaled([r.embedding for r in first], dim)) if first else []

    def codes(batches):
        for pdf in batches:
            found = [nearest(part, book) for part, book in zip(_parts(scaled(list(pdf.embedding), dim)), books)]
            digits = np.stack([n for n, _ in found], 1).astype(np.uint8)
            total = sum(d.astype(object) for _, d in found)
            yield pd.DataFrame({"vec_id": pdf.vec_id, "label": pdf.label, "code": [d.tobytes().hex() for d in digits], "error": pd.array([x if x < 1 << 63 else None for x in total], "Int64")})

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    coded = materialise(vectors.mapInPandas(codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "coded")
    discard(vectors)
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: the errors summed over equal labels, nulls together; null where the sum passes a long.

    Sums are taken before the shuffle. Labels with over one row in HOT of all come back by broadcast (fewer than HOT rows), all
    others by a join in which no label has more rows than that, so no task gets a hot label.
    """
    totals = materialise(coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error"), F.count(F.lit(1)).alias("n")), "totals")
    rows = totals.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT > rows
    hot = totals.where(often).select(F.col("label").alias("_l"), "label_error", F.lit(True).alias("_hot"))
    out = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_l")), "left").drop("_l")
    rest = totals.where(~often).select(F.col("label").alias("_l"), F.col("label_error").alias("_e"))
    cold = out.where("_hot IS NULL").drop("label_error").join(rest, F.col("label").eqNullSafe(F.col("_l")), "left").withColumnRenamed("_e", "label_error")
    columns = [*coded.columns, "label_error"]
    return out.where("_hot").select(*columns).unionByName(cold.select(*columns))


def books_text(books: list[np.ndarray]) -> str:
    """All entries' components in decimal, by part, entry and place, joined by commas."""
    return ",".join(str(x) for book in books for x in book.reshape(-1).tolist())


def _assigned(books: str) -> str:
    return f"""
    SELECT vec_id, label, row_id, p, min(struct_pack(d := d, e := e)) AS best, any_value(x) AS x FROM (
      SELECT s.vec_id, s.label, s.row_id, s.p, s.x, b.e, list_sum([(s.x[i] - b.c[i]) * (s.x[i] - b.c[i]) FOR i IN range(1, len(s.x) + 1)])::BIGINT AS d
      FROM split s JOIN {books} b USING (p)) GROUP BY vec_id, label, row_id, p"""


def _round(assigned: str, books: str) -> str:
    floor_div = "(t - (((t % n) + n) % n)) // n"
    return f"""
    SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
      SELECT p, e, list({floor_div} ORDER BY i) AS c FROM (
        SELECT p, best.e AS e, i, sum(x[i])::BIGINT AS t, count(*)::BIGINT AS n FROM {assigned}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM split) + 1)) AS i) GROUP BY 1, 2, 3)
      GROUP BY p, e) m USING (p, e)"""


def _sql() -> str:
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS row_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
split AS MATERIALIZED (
  SELECT vec_id, label, row_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p)),
b0 AS MATERIALIZED (SELECT p, row_id AS e, x AS c FROM split WHERE row_id < {ENTRIES}),
a0 AS MATERIALIZED ({_assigned("b0")}),
b1 AS MATERIALIZED ({_round("a0", "b0")}),
a1 AS MATERIALIZED ({_assigned("b1")}),
b2 AS MATERIALIZED ({_round("a1", "b1")}),
a2 AS MATERIALIZED ({_assigned("b2")}),
coded AS (
  SELECT vec_id, label, row_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a2 GROUP BY vec_id, label, row_id),
books AS (SELECT sha256(string_agg(c_text, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(c, ',') AS c_text FROM b2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, books
"""


SQL = _sql()
