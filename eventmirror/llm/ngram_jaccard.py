"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows are distinct n-gram sets, columns are n-grams. Only a set's prefix (its first
n - ceil(t n) + 1 n-grams in one global order) enters the product: two sets of similarity t or more
share one of those. The order puts n-grams that very many documents hold last, so that shared
passages stay out of most prefixes. Blocks of columns are multiplied within tasks; pairs whose sizes
and positions cannot give the overlap are discarded there; overlaps of prefixes are then
accumulated and compared with the bound, and what is left is verified on the whole sets.

The product runs twice. The first run multiplies each column with its hub and the row before only, which
finds the large groups of near copies in as many pairs as they have rows. The second run takes
every pair of rows that are not yet connected. So no link between components is lost, and no
group is expanded into all of its pairs.

The n-grams that are put last are known to every task, a bounded number; their columns are the long ones. They are dealt
out by n-gram and salt. In a column of over BIG rows the hubs are found by aggregation, and the second run
deals the rows to blocks and multiplies block by block, so no column is one task's work.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_ids, connected_components, discard, materialise, mix64, slices

WORDS = 4
#: Similarity as a fraction: 100 * intersection >= 85 * union.
NUMERATOR, DENOMINATOR = 85, 100
BATCH_BYTES = 1 << 18
#: An n-gram is put last if it is in so many documents of a task's batch of about one million n-grams and
#: LOCAL_TOTAL in all, or in over FREQUENT prefixes. The order decides what the join costs, never what it
#: finds, and so does the bound of the list.
LOCAL_HOT, LOCAL_TOTAL, FREQUENT, MOST_HOT = 3, 48, 24, 1_000_000
#: Partners of a row that the first run verifies, and the shared columns it asks for, as a part of the row's n-grams.
PARTNERS, LIKELY = 2, 30
#: In columns of more rows the second run takes only pairs that could still reach the overlap if this were their first.
LONG = 64
SALTS = 16
#: Hubs of long columns that are broadcast at most, about 40 bytes each.
MOST_HUBS = 1_000_000
#: A longer column is multiplied in blocks of so many rows, and pairs are passed on so many at a time.
BIG, PAIRS = 50_000, 1 << 17

_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_COMBINE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(texts: pa.StringArray, words: int = WORDS):
    """(row, sorted distinct n-gram hashes) of every text; shorter texts are one n-gram, empty ones none."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    for a, b in slices(np.diff(offsets), BATCH_BYTES):
        first, last = int(offsets[a]), int(offsets[b])
        raw = _LOWER[data[first:last]]
        bounds = offsets[a : b + 1] - first
        word = ~_SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        cut[bounds] = True  # a word ends with its text
        before = np.append(False, word[:-1]) & ~cut[:-1]
        after = np.append(word[1:], False) & ~cut[1:]
        start, stop = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(raw), _P, np.uint64)]))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1])])
        inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(raw), _INVERSE, np.uint64)]))
        hashed = mix64((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))
        at = np.searchsorted(start, bounds)  # first word of each text
        if len(hashed) >= words:
            grams = np.zeros(len(hashed) - words + 1, np.uint64)
            for k in range(words):
                grams += hashed[k : len(hashed) - words + 1 + k] * _COMBINE[k % 4] * np.uint64(2 * (k // 4) + 1)
            grams = mix64(grams)
        for i in range(b - a):
            x, y = int(at[i]), int(at[i + 1])
            if y - x >= words:
                yield a + i, np.unique(grams[x : y - words + 1])
            elif y > x:
                whole = np.array([y - x], np.uint64)
                for k in range(x, y):
                    whole = mix64(whole * _COMBINE[3] + hashed[k : k + 1])
                yield a + i, whole
            else:
                yield a + i, np.zeros(0, np.uint64)


def _least_overlap(n: np.ndarray) -> np.ndarray:
    """ceil(t n): the overlap that any partner of a set of n needs."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The overlap that sets of n and m need: ceil(t (n + m) / (1 + t))."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def describe(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, n, digest of its set) and rows (hot, seen) for n-grams that many of a
    task's documents hold."""
    names = ["doc_id", "n", "digest", "hot", "seen"]

    def run(batches):
        held, size = [], 0

        def hot() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= LOCAL_HOT
            k = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(values[keep].view(np.int64)), pa.array(counts[keep])], names=names)

        for batch in batches:
            n, digest = np.zeros(len(batch), np.int64), [b""] * len(batch)
            for i, grams in shingle_sets(batch.column(1)):
                n[i], digest[i] = len(grams), hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                held.append(grams)
                size += len(grams)
                if size > 1 << 20:
                    yield hot()
                    held, size = [], 0
            k = len(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(digest, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
        if held:
            yield hot()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, digest binary, hot long, seen long")


def _most(counts: DataFrame) -> np.ndarray:
    """The n-grams of the largest counts (h, n), as many as MOST_HOT: 8 MB at most."""
    return counts.orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").toArrow().column("h").to_numpy()


def prefixes(docs: DataFrame, hot: np.ndarray, longer: float = 1.0) -> DataFrame:
    """doc_id, n, digest and the prefix of each set that is not empty; `hot` n-grams come last in the order, from place `early` on.

    With `longer` the prefix is so many times as long, to count what would come next.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(hot.view(np.uint64)))

    def run(batches):
        late = shared.value
        for batch in batches:
            rows, n, digest, prefix, early = [], [], [], [], []
            for i, grams in shingle_sets(batch.column(1)):
                if not len(grams):
                    continue
                rows.append(i)
                n.append(len(grams))
                digest.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
                take = int((len(grams) - int(_least_overlap(np.int64(len(grams)))) + 1) * longer)
                early.append(take)
                if len(late):
                    place = np.minimum(np.searchsorted(late, grams), len(late) - 1)
                    is_late = late[place] == grams
                    grams = np.concatenate([grams[~is_late], grams[is_late]])
                    early[-1] = int((~is_late).sum())
                prefix.append(grams[:take].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(early, pa.int32())], names=["doc_id", "n", "digest", "prefix", "early"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, digest binary, prefix array<long>, early int")


def whole_sets(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = list(shingle_sets(batch.column(1)))
            for a, b in slices(np.array([8 * len(g) for _, g in found] or [0], np.int64)[: len(found)], 8 << 20):
                rows = pa.array([i for i, _ in found[a:b]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([g.view(np.int64) for _, g in found[a:b]], pa.list_(pa.int64()))], names=["node", "grams"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "node long, grams array<long>")


def _edges(rows, by: tuple[str, ...]) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    out = np.zeros(rows.num_rows, bool)
    out[:1] = True
    for c in by:
        v = rows.column(c).to_numpy(zero_copy_only=False)
        out[1:] |= v[1:] != v[:-1]
    return out


def _runs(batches, by: tuple[str, ...] = ("h",)):
    """Whole runs of rows with one n-gram (and block) from sorted batches, as many at a time as come together."""
    waiting: list[pa.RecordBatch] = []
    key = lambda batch, i: tuple(batch.column(c)[i].as_py() for c in by)
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting and key(waiting[-1], waiting[-1].num_rows - 1) == key(batch, 0) == key(batch, batch.num_rows - 1):
            waiting.append(batch)
            continue
        last = int(np.flatnonzero(_edges(batch, by))[-1])
        if last:
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)]).combine_chunks()
        elif waiting:
            yield pa.Table.from_batches(waiting).combine_chunks()
        waiting = [batch.slice(last)]
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in names]


def _repeated(batches):
    """The rows of columns of two rows or more, with the column's length; those of late n-grams, which are only parts here, all."""
    for rows in _runs(batches, ("h", "salt")):
        edge = np.flatnonzero(_edges(rows, ("h", "salt")))
        length = np.repeat(np.diff(np.append(edge, len(rows))), np.diff(np.append(edge, len(rows))))
        late = rows.column("late").to_numpy(zero_copy_only=False)
        rows = rows.drop_columns(["salt"]).append_column("k", pa.array(length))
        yield from rows.filter(pa.array((length > 1) | late)).to_batches()


def _counted(x, y, nx, ny, lx, ly, ok) -> pa.RecordBatch:
    """One row per pair: how many of the columns at hand it shares, and whether any of them could be its first."""
    order = np.lexsort([y, x])
    x, y, nx, ny, lx, ly, ok = (v[order] for v in (x, y, nx, ny, lx, ly, ok))
    first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))) if len(x) else np.zeros(0, int)
    count = np.diff(np.append(first, len(x)))
    can = np.logical_or.reduceat(ok, first) if len(first) else ok
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (x[first], y[first], nx[first], ny[first], lx[first], ly[first], count, can)], names=["x", "y", "nx", "ny", "lx", "ly", "c", "ok"])


def _star(batches):
    """Each row of a column with the row before it and with a hub of each of two windows of like sizes.

    The hub is the row whose prefix has the fewest n-grams before this one. Rare n-grams come first, so
    that is the row with the least of its own: of a group of near copies, the one nearest to the text they share.
    """
    for rows in _runs(batches):
        h, n, pos, node = _columns(rows, "h", "n", "pos", "node")
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        ends = np.append(edge[1:], len(h))
        left, right = [np.maximum(np.arange(len(h)) - 1, 0)], [np.arange(len(h))]
        left[0][edge] = edge
        for s, e in zip(edge.tolist(), ends.tolist()):
            at = back = s
            while at < e:
                reach = s + int(np.searchsorted(n[s:e], n[at] * DENOMINATOR // NUMERATOR, "right"))
                middle = (at + reach + 1) // 2
                for x, y in ((at, reach), (back, middle)):  # the second windows lie across the ends of the first
                    if y - x > 1:
                        hub = x + int(np.argmin(pos[x:y]))
                        left.append(np.full(y - x, hub))
                        right.append(np.arange(x, y))
                at, back = max(reach, at + 1), middle
        left, right = np.concatenate(left), np.concatenate(right)
        keep = (node[left] != node[right]) & (NUMERATOR * np.maximum(n[left], n[right]) <= DENOMINATOR * np.minimum(n[left], n[right]))
        left, right = left[keep], right[keep]
        none = np.zeros(len(left), np.int64)
        yield _counted(node[right], node[left], n[right], n[left], none, none, none == 0)


def _cross(batches):
    """Every pair of a column whose rows are in different components and whose sizes allow the overlap.

    Of a column in blocks, the rows of two blocks are together; pairs within the first are taken where it is alone.
    """
    by = ("h", "low", "high")
    for rows in _runs(batches, by):
        n, pos, node, comp, far, k, own, low, high = _columns(rows, "n", "pos", "node", "component", "far", "k", "block", "low", "high")
        edge = np.flatnonzero(_edges(rows, by))
        ends = np.append(edge[1:], len(n))
        left, right, can, held = [], [], [], 0

        def pairs():
            a, b, ok = np.concatenate(left), np.concatenate(right), np.concatenate(can)
            turn = node[a] > node[b]
            a, b = np.where(turn, b, a), np.where(turn, a, b)
            return _counted(node[a], node[b], n[a], n[b], far[a], far[b], ok)

        for s, e in zip(edge.tolist(), ends.tolist()):
            if e - s < 2 or (comp[s:e] == comp[s]).all():
                continue
            ns, rest, cs, bs = n[s:e], n[s:e] - pos[s:e], comp[s:e], own[s:e]
            two = low[s] != high[s]
            reach = np.searchsorted(ns, ns * DENOMINATOR // NUMERATOR, "right")
            for i in range(e - s - 1):
                j = np.arange(i + 1, reach[i])
                ok = np.minimum(rest[j], rest[i]) >= _needed(ns[i], ns[j])
                take = (cs[j] != cs[i]) & (ok | (k[s] <= LONG))
                if two:
                    take &= bs[j] != bs[i]
                if take.any():
                    j = j[take]
                    left.append(np.full(len(j), s + i))
                    right.append(s + j)
                    can.append(ok[take])
                    held += len(j)
                    if held > PAIRS:
                        yield pairs()
                        left, right, can, held = [], [], [], 0
        if left:
            yield pairs()


COUNTED = "x long, y long, nx long, ny long, lx long, ly long, c long, ok boolean"


def _product(postings: DataFrame, multiply, schema: str = COUNTED, by: tuple[str, ...] = ("h",)) -> DataFrame:
    return postings.repartition(*by).sortWithinPartitions(*by, "n", "node").mapInArrow(multiply, schema)


def _far_star(big: DataFrame) -> DataFrame:
    """_star() of the columns of over BIG rows: hubs by partial minima, before anything is shuffled. There are at
    most so many such columns as late n-grams, and few sizes in each, so the hubs are given to all tasks."""
    size = F.log(F.col("n").cast("double")) / float(np.log(DENOMINATOR / NUMERATOR))
    windows = F.explode(F.array(F.floor(size) * 2, F.floor(size + 0.5) * 2 + 1))
    rows = big.select("h", "n", "pos", "node", windows.alias("w"))
    hubs = rows.groupBy("h", "w").agg(F.min(F.struct("pos", "node", "n")).alias("hub"))
    if hubs.count() <= MOST_HUBS:
        hubs = F.broadcast(hubs)
    pairs = rows.join(hubs, ["h", "w"]).where((F.col("node") != F.col("hub.node")) & (NUMERATOR * F.greatest("n", "hub.n") <= DENOMINATOR * F.least("n", "hub.n")))
    zero = F.lit(0).cast("long")
    pairs = pairs.groupBy(F.col("node").alias("x"), F.col("hub.node").alias("y"), "h").agg(F.max("n").alias("nx"), F.max("hub.n").alias("ny"))
    return pairs.select("x", "y", "nx", "ny", zero.alias("lx"), zero.alias("ly"), F.lit(1).cast("long").alias("c"), F.lit(True).alias("ok"))


def _accumulated(counted: DataFrame) -> DataFrame:
    return counted.groupBy("x", "y").agg(*[F.max(c).alias(c) for c in ("nx", "ny", "lx", "ly", "ok")], F.sum("c").alias("c"))


def _hubs(repeated: DataFrame) -> DataFrame:
    """(a, b): each row's best partners among hubs and neighbours, by shared columns."""
    counted = _product(repeated.where(F.col("k") <= BIG).select("h", "n", "pos", "node"), _star)
    big = repeated.where(F.col("k") > BIG)
    likely = _accumulated(counted if big.isEmpty() else counted.unionByName(_far_star(big))).where(F.col("c") * LIKELY >= F.col("nx"))
    best = likely.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("c", "y")), False), 1, PARTNERS).alias("p"))  # no more than the prefix has columns
    pairs = best.select("x", F.explode("p.y").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _bounded(known: DataFrame) -> DataFrame:
    """(a, b): the pairs of different components whose prefixes share enough.

    Of two prefixes, the one that ends first has all n-grams that it shares counted, but for those in long columns
    (`far` of a row's); only the rest of its set can add to the overlap.
    """
    least = lambda n: F.ceil(F.col(n) * NUMERATOR / DENOMINATOR)
    most = F.col("c") + F.least("lx", "ly") + F.greatest(least("nx"), least("ny")) - 1
    # Rows of a column of over BIG rows go to blocks, and each block meets every other one.
    blocks = F.ceil(F.col("k") / BIG).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    met = known.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("h", "n", "pos", "node", "component", "far", "k", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    pairs = _accumulated(_product(met, _cross, by=("h", "low", "high"))).where(F.col("ok") & (most * (NUMERATOR + DENOMINATOR) >= (F.col("nx") + F.col("ny")) * NUMERATOR))
    return pairs.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs that are similar, on their whole sets, which are made of the texts again."""
    pairs = materialise(pairs, "pairs")
    nodes = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # The ids grow with the input, so they are never broadcast, whatever their size now.
    grams = materialise(whole_sets(by_ids(docs, nodes, "left_semi")), "sets")
    shared = F.size(F.array_intersect("ga", "gb"))
    union = F.size("ga") + F.size("gb") - shared
    found = materialise(
        pairs.join(grams.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
        .join(grams.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
        .where(shared * DENOMINATOR >= union * NUMERATOR)
        .select("a", "b"),
        "links",
    )
    discard(pairs, grams)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Words are runs of anything but ASCII white space, A-Z in lower case; a set holds the distinct four-word
    shingles of the whole text, or its one shorter sequence. Two documents link when
    100 * intersection >= 85 * union. Equal sets are one row of the product. Null and empty texts
    have no shingles and link with nothing, as have rows of a null doc_id (their component is null);
    rows that share a doc_id are one document. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    facts = materialise(describe(docs), "facts")
    rows = facts.where("hot IS NULL").select("doc_id", "n", "digest")
    hot = facts.where("hot IS NOT NULL").groupBy(F.col("hot").alias("h")).agg(F.sum("seen").alias("n")).where(F.col("n") >= LOCAL_TOTAL)
    hot = _most(hot)
    groups = materialise(
        rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")), "groups"
    )
    docs = docs.where("doc_id IS NOT NULL")
    frequent = prefixes(docs, hot, 1.5).select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FREQUENT)
    hot = np.union1d(hot, _most(frequent))
    sets = materialise(
        prefixes(docs, hot)
        .join(groups.select("digest", F.col("node").alias("doc_id")), ["doc_id", "digest"])
        .groupBy(F.col("doc_id").alias("node"), "digest").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("early").alias("early"))
        .select("node", "n", "prefix", "early"),
        "prefixes",
    )
    late = F.col("pos") >= F.col("early")
    postings = sets.select("node", "n", "early", F.posexplode("prefix").alias("pos", "h")).select(
        "h", "n", "pos", "node", late.alias("late"), F.when(late, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
    )
    parts = materialise(_product(postings, _repeated, "h long, n long, pos int, node long, late boolean, k long", ("h", "salt")), "parts")
    # The lengths of the late columns, of which there are two lists of MOST_HOT at most: 32 MB.
    lengths = parts.where("late").groupBy("h").agg(F.count(F.lit(1)).alias("whole"))
    whole = parts.join(F.broadcast(lengths), "h", "left").withColumn("k", F.coalesce("whole", "k"))
    repeated = materialise(whole.where("k > 1").select("h", "n", "pos", "node", "k"), "repeated")
    discard(sets, parts)
    links = _verify(_hubs(repeated), docs)
    first = None if links.isEmpty() else connected_components(links)
    known = repeated if first is None else repeated.join(first.withColumnRenamed("id", "node"), "node", "left")
    known = known.withColumn("component", F.col("node") if first is None else F.coalesce("component", "node"))
    known = known.join(repeated.groupBy("node").agg(F.count_if(F.col("k") > LONG).alias("far")), "node")
    more = _verify(_bounded(known), docs)
    if more.isEmpty():
        found = first
    else:
        found = connected_components(links.union(more))
    discard(repeated, links, more)
    # Rows of the digests that have copies or links take their component; all others are their own.
    named = groups.withColumn("component", F.col("node")) if found is None else groups.join(found.withColumnRenamed("id", "node"), "node", "left")
    named = (
        named.withColumn("component", F.coalesce("component", "node")).where("copies > 1 OR component <> node")
        .select("digest", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    return (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        .join(named, ["digest", "salt"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with the document of the smallest doc_id of each component, once."""
    kept = near_duplicates(docs).groupBy("doc_id").agg(F.min("component_id").alias("component")).where("doc_id <> component").select("doc_id")
    return by_ids(docs, materialise(kept, "dropped"), "left_anti")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'x^', ''), '[^\x20\x09-\x0D]+') AS l
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(l) = 0 THEN []::VARCHAR[] WHEN len(l) < 4 THEN [array_to_string(l, ' ')]
    ELSE list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) END AS g
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
t AS MATERIALIZED (SELECT a, b FROM k UNION ALL SELECT b, a FROM k)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id FROM s JOIN (
  WITH RECURSIVE r(root, node) AS (
    SELECT doc_id, doc_id FROM s UNION SELECT r.root, t.b FROM r JOIN t ON t.a = r.node)
  SELECT root AS doc_id, min(node) AS component_id FROM r GROUP BY 1) USING (doc_id)
"""
