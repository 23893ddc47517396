"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its hashed letter 1- to 3-grams; a linear layer
and softmax give the language. Embeddings and layer are learned by stochastic gradient descent in
numpy on a bounded sample; a temperature and a rejection threshold are fitted on rows kept apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import LETTER, classes
from .common import mix64, slices

BUCKETS, WIDTH = 1 << 13, 16
#: Training rows per language at most.
PER_LANGUAGE = 750
UNKNOWN = "und"


def histograms(texts: list[str], most_chars: int = 1 << 18, most_rows: int = 64):
    """(first row, matrix): counts of hashed letter n-grams of each text, in blocks of rows.

    An n-gram lies in a word and the mark on either side of it; everything but letters is a mark.
    """
    texts = [(t or "").lower() for t in texts]
    sizes = np.fromiter((max(len(t) + 2, most_chars // most_rows) for t in texts), np.int64, len(texts))
    for a, b in slices(sizes, most_chars):
        part = texts[a:b]
        codes = np.frombuffer("".join(f" {t} " for t in part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(b - a), np.fromiter((len(t) + 2 for t in part), np.int64, b - a))
        c = np.where(classes()[codes.astype(np.intp)] == LETTER, codes, np.uint64(0))
        left, right = np.append(np.uint64(0), c[:-1]), np.append(c[1:], np.uint64(0))
        letter = c > 0
        two, P = letter | (right > 0), np.uint64(0x1F123BB5)
        grams = [(c[letter], row[letter], 1), ((c * P + right)[two], row[two], 2), (((left * P + c) * P + right)[letter], row[letter], 3)]
        out = np.zeros((b - a) * BUCKETS)
        for values, rows, n in grams:
            key = (mix64(values + np.uint64(n << 60)) & np.uint64(BUCKETS - 1)).astype(np.int64) + rows * BUCKETS
            out += np.bincount(key, minlength=len(out))
        yield a, out.reshape(b - a, BUCKETS)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # embeddings times layer, BUCKETS x languages
    bias: np.ndarray
    temperature: float = 1.0
    #: A prediction of a lower score is rejected.
    threshold: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts.astype(np.float32) @ self.weights / np.maximum(counts.sum(1, keepdims=True), 1) + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.languages:
            for first, counts in histograms(texts):
                p = softmax(self.logits(counts) / self.temperature)
                for i, k in enumerate(p.argmax(1)):
                    if counts[i].any():
                        names[first + i], scores[first + i] = self.languages[k], p[i, k]
        return names, scores


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(counts: np.ndarray, names: list[str], epochs: int = 20, batch: int = 32, rate: float = 4.0, seed: int = 7) -> Model:
    """SGD over embeddings and layer; every fifth row fits the temperature and the threshold instead."""
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(languages, names)
    x = (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
    order = rng.permutation(len(y))
    apart, own = (order[::5], np.setdiff1d(order, order[::5])) if len(order) >= 50 else (order, order)
    embed = rng.normal(0, 0.5, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        rng.shuffle(own)
        step = rate * (1 - epoch / epochs)
        for i in range(0, len(own), batch):
            rows = own[i : i + batch]
            h = x[rows] @ embed
            gap = softmax(h @ layer + bias)
            gap[np.arange(len(rows)), y[rows]] -= 1
            gap /= len(rows)
            back = gap @ layer.T
            layer -= step * (h.T @ gap)
            bias -= step * 0.1 * gap.sum(0)
            embed -= step * 50 * (x[rows].T @ back)
    model = Model(languages, embed @ layer, bias)
    raw = model.logits(counts[apart])
    loss = lambda t: -np.log(softmax(raw / t)[np.arange(len(apart)), y[apart]] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.2, 5, 33), key=loss))
    p = softmax(raw / model.temperature)
    right = p.max(1)[p.argmax(1) == y[apart]]
    # Rejection keeps all but one in a thousand of the right answers, and never asks for more than a bare majority.
    model.threshold = float(min(np.quantile(right, 0.001), 0.5)) if len(right) else 0.0
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is divisible by 5; such rows are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from about `per_language` rows of each language, drawn by a hash of doc_id from the rows
    whose lang and text are not null and that are not held out; whole texts count.

    Executors turn the drawn texts into counts (BUCKETS numbers at most); only those reach the driver.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return train(np.zeros((0, BUCKETS)), [])
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(int((1 << 20) * min(1.0, per_language / n))))])

    def run(batches):
        for batch in batches:
            for first, counts in histograms(batch.column(1).to_pylist()):
                at = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(at)),
                        pa.array([i.astype(np.int32) for i in at], pa.list_(pa.int32())),
                        pa.array([c[i].astype(np.int32) for c, i in zip(counts, at)], pa.list_(pa.int32())),
                    ],
                    names=["lang", "at", "n"],
                )

    # One row of an id that repeats (that of the greatest lang and text), so that a frequent id adds no more to the sample than others.
    drawn = rows.where(draw < share[F.col("lang")]).groupBy("doc_id").agg(F.max(F.struct("lang", "text")).alias("r")).select("r.lang", "r.text")
    sample = drawn.mapInArrow(run, "lang string, at array<int>, n array<int>").toArrow()
    counts = np.zeros((len(sample), BUCKETS), np.float32)
    for i, (at, n) in enumerate(zip(sample.column("at"), sample.column("n"))):
        counts[i, at.values.to_numpy()] = n.values.to_numpy()
    order = np.lexsort([counts[:, 0], counts.sum(1), sample.column("lang").to_pylist()])  # the same model whatever the row order
    names = np.array(sample.column("lang").to_pylist())[order].tolist()
    return train(counts[order], names)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if not given) with lang_pred and score.

    lang_pred is `und`, with score 0, if the text is null, empty or has no letter; else it is the
    likeliest language and score its calibrated probability. Columns of these names are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            names, scores = model.predict(batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the rows that the model rejects: no letters, or a score below the fitted threshold."""
    model = fit(docs)
    found = identify(docs, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= model.threshold)).select(docs.columns)
