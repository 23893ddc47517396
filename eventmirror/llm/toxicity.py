"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

Folding maps look-alike letters and digit substitutions to plain letters, drops invisible marks
and turns the rest into single spaces. Matches of the lexicon count by weight unless they lie in an
exception phrase, and are normalised by the number of words; a logistic curve makes a probability.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, slices
from .langid import held_out

#: Labelled rows to learn from, of either label, at most.
PER_LABEL = 8000
# Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKE = dict(zip("авекмнорстухіјѕԁԛԝһαβεικνορτυχγ", "abekmhopctyxijsdqwhabeiknoptuxy"))
# Digits and signs that stand for letters inside a word.
DIGITS = dict(zip("0134578", "oieastb"))
SIGNS = dict(zip("@$!|€", "asiie"))
INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
#: Known before any label is seen; learned weights replace these.
BASE_LEXICON = dict.fromkeys("idiot moron imbecile stupid loser scum worthless pathetic disgusting bastard asshole bitch whore slut retard".split(), 2.0)
#: Inside these phrases a lexicon word does not count.
BASE_EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "sore loser rule")


@functools.cache
def folding() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point, 0 for none: the letter it becomes (of no Latin look: itself, in lower case), the digit it is, and
    the letter that it stands for only inside a word (1 for a mark that is dropped)."""
    plain, digit, inside = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        if kind in "LNM":
            base = unicodedata.normalize("NFKD", ch)[0].lower()
            base = unicodedata.normalize("NFKD", base)[0]
            base = LOOK_ALIKE.get(base, base)
            if "a" <= base <= "z":
                plain[c] = ord(base)
            elif "0" <= base <= "9":
                digit[c], inside[c] = ord(base), ord(DIGITS.get(base, base))
            else:
                plain[c] = ord(ch.lower()[0])
    for ch, base in SIGNS.items():
        inside[ord(ch)] = ord(base)
    for marks in (list(INVISIBLE), slice(0x300, 0x370)):  # the latter are accents of their own
        plain[marks], inside[marks] = 0, 1
    return plain, digit, inside


def fold(texts: list[str]) -> list[str]:
    """Each text as folded words between single spaces, with a space at both ends.

    Look-alikes, accents and digits or signs for letters become plain letters; letters of other scripts and
    numbers stay what they are, so that different words stay different.
    """
    plain, digits, inside = folding()
    out: list[str] = []
    for a, b in slices(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)), 1 << 17):
        joined = "".join(f" {t} \n" for t in texts[a:b])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        mark = np.zeros(len(codes), bool)
        mark[np.cumsum([len(t) + 3 for t in texts[a:b]]) - 1] = True
        letter, number, sub = plain[codes], digits[codes], inside[codes]
        keep = sub != 1
        letter, number, sub, mark = letter[keep], number[keep], sub[keep], mark[keep]
        digit = number > 0
        sign = (sub > 0) & ~digit
        # A sign counts between two letters or digits; a digit in a run that has a letter.
        alnum = (letter > 0) | digit
        sign &= np.append(False, alnum[:-1]) & np.append(alnum[1:], False)
        part = alnum | sign
        edge = np.flatnonzero(np.diff(part.astype(np.int8), prepend=0) != 0)
        has = np.repeat(np.logical_or.reduceat(letter > 0, edge), np.diff(np.append(edge, len(part)))) if len(edge) else np.zeros(0, bool)
        has = np.concatenate([np.zeros(len(part) - len(has), bool), has])
        folded = np.where(letter > 0, letter, np.where(part & has, sub, np.where(digit, number, 32))).astype("<u4")
        folded[mark] = 10
        space = folded == 32
        folded = folded[~space | ~np.append(False, space[:-1])]
        out += folded.tobytes().decode("utf-32-le", "surrogatepass").split("\n")[:-1]
    return out


@dataclass
class Model:
    lexicon: dict[str, float]
    exceptions: tuple[str, ...]
    curve: np.ndarray = field(default_factory=lambda: np.array([-3.0, 1.5, 0.3]))
    _machine: object = None

    def __getstate__(self):
        return self.__dict__ | {"_machine": None}

    def machine(self):
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for word, weight in self.lexicon.items():
                self._machine.add_word(f" {word} ", (len(word) + 2, weight))
            for phrase in self.exceptions:
                self._machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self._machine.make_automaton()
        return self._machine

    def features(self, folded: str) -> tuple[float, float]:
        """log(1 + weight of the matches), and that weight per hundred words, damped for short texts."""
        hits, excused = [], []
        if self.lexicon:
            for end, (length, weight) in self.machine().iter(folded):
                (excused if weight is None else hits).append((end - length + 1, end, weight))
        if excused:
            # A match is excused if, of the phrases that begin no later, one ends no earlier.
            excused.sort()
            begins, ends = [x for x, _, _ in excused], list(itertools.accumulate((y for _, y, _ in excused), max))
            hits = [(a, b, w) for a, b, w in hits if not (i := bisect.bisect_right(begins, a)) or ends[i - 1] < b]
        total = sum(w for _, _, w in hits)
        words = folded.count(" ")
        return float(np.log1p(total)), float(np.log1p(100 * total / (words + 50)))

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.features(f) for f in fold(texts)]).reshape(len(texts), 2)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method for a ridge logistic curve."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def sample_of(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[DataFrame, dict[int, int]]:
    """text and toxic of about `per_label` labelled rows of each label that are not held out, drawn by
    a hash of doc_id, and the number of rows of each label. The drawn labels are bounded by that parameter, so they are broadcast."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20))
    share = F.when(F.col("toxic") == 1, int((1 << 20) * min(1, per_label / sizes.get(1, 1)))).otherwise(int((1 << 20) * min(1, per_label / sizes.get(0, 1))))
    drawn = known.where(draw < share)
    # One row of an id that repeats (that of the greatest text), so that a frequent id adds no more to the sample than others.
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text")).select("toxic", "text"), sizes


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn weights, exception phrases and the curve from a bounded sample of the labels.

    A word joins the lexicon if more toxic texts than clean ones hold it, by six standard errors of the
    log odds (two for the words of BASE_LEXICON), or if four or more and 3 % of the toxic texts and no clean one
    do; its weight is that log odds. A word pair around a lexicon word becomes an exception if at least ten clean texts
    and few toxic ones hold it. Every such word and pair is taken, of any length: a part of the words of the drawn texts.
    """
    drawn, whole = sample_of(docs, labels, per_label)
    sample = materialise(drawn, "toxicity-sample")

    def count(batches):
        for batch in batches:
            tally: dict[str, list[int]] = {}
            toxic = batch.column(0).to_pylist()
            for label, folded in zip(toxic, fold(batch.column(1).to_pylist())):
                for w in set(folded.split()):
                    tally.setdefault(w, [0, 0])[label] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([v[0] for v in tally.values()], pa.int64()), pa.array([v[1] for v in tally.values()], pa.int64())], names=["word", "clean", "toxic"])

    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        discard(sample)
        return Model(dict(BASE_LEXICON), BASE_EXCEPTIONS)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (F.lit(toxic) + 1 - a)) - F.log(b / (F.lit(clean) + 1 - b))
    error = F.sqrt(1 / a + 1 / b)
    base = F.col("word").isin(*BASE_LEXICON)
    learned = (
        sample.mapInArrow(count, "word string, clean long, toxic long")
        .groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .withColumn("odds", odds).withColumn("z", odds / error)
        .where(((F.col("z") >= 6) | ((F.col("toxic") >= 4) & (F.col("clean") == 0) & (F.col("toxic") >= 0.03 * toxic)) | (base & (F.col("z") >= 2))) & (F.col("odds") > 1))
        .select("word", "odds").orderBy("word").collect()
    )
    lexicon = BASE_LEXICON | {r["word"]: float(r["odds"]) for r in learned}

    def measure(batches):
        own = Model(lexicon, BASE_EXCEPTIONS)
        for batch in batches:
            folded = fold(batch.column(1).to_pylist())
            x = [own.features(f) for f in folded]
            pairs = [sorted({" ".join(p) for p in zip(w, w[1:]) if p[0] in lexicon or p[1] in lexicon}) for w in map(str.split, folded)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), pa.array(pairs, pa.list_(pa.string()))], names=["toxic", "x0", "x1", "pairs"])

    seen = sample.mapInArrow(measure, "toxic int, x0 double, x1 double, pairs array<string>")
    phrases = (
        seen.select("toxic", F.explode("pairs").alias("pair")).groupBy("pair")
        .agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))
        .where((F.col("clean") >= 10) & (F.col("toxic") * clean * 4 < F.col("clean") * toxic))
        .orderBy("pair").collect()
    )
    model = Model(lexicon, (*BASE_EXCEPTIONS, *[r["pair"] for r in phrases]))

    def again(batches):
        for batch in batches:
            x = [model.features(f) for f in fold(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64())], names=["toxic", "x0", "x1"])

    points = sample.mapInArrow(again, "toxic int, x0 double, x1 double").toArrow() if phrases else seen.select("toxic", "x0", "x1").toArrow()
    discard(sample)
    y = points.column("toxic").to_numpy().astype(float)
    x = np.column_stack([points.column("x0").to_numpy(), points.column("x1").to_numpy()])
    model.curve = logistic(x, y)
    # The labels drawn may not be in the proportion of the table; that shifts the constant alone.
    shift = np.log(whole[1] / toxic) - np.log(whole[0] / clean)
    model.curve[0] += shift
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all, if not given) with score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts score as texts without a match. Columns of these names are replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        for batch in batches:
            s = model.scores([t or "" for t in batch.column(len(kept)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, schema)


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic."""
    return score(docs, fit(docs, labels)).where("predicted = 0").select(docs.columns)
