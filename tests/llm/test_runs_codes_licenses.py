"""Periodic runs, vector codes and license scans on small fixtures, held against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventmirror.llm import langid, license_scan, periodic_runs, toxicity, vector_codes

DOCS = "doc_id long, text string, runs string, blocks string, n_words string, _text string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "r", "b", "n", "t") for i, t in rows], DOCS)


# ---- 11 periodic runs


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
        sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def texts_with_runs():
    rnd = random.Random(11)
    out = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "  \x1c x " * 6, "é ü\t" * 12]
    fib = [["a"], ["a", "b"]]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    out.append(" ".join(fib[-1]))
    out += [" ".join((["a"] * n + ["b"]) * m) for n, m in ((29, 3), (1, 40), (90, 2), (5, 20))]
    for _ in range(120):
        of = rnd.choice([1, 2, 3, 60])
        part = lambda n: [f"w{rnd.randrange(of)}" for _ in range(n)]
        unit = part(rnd.randrange(1, 40))
        words = part(rnd.randrange(30)) + unit * rnd.randrange(1, 6) + unit[: rnd.randrange(len(unit) + 1)] + part(rnd.randrange(30))
        out.append("".join(w + rnd.choice([" ", "\n", "  ", "\x0b"]) for w in words))
    return out


def test_periodic_runs_against_plain_python(spark):
    rows = list(enumerate(texts_with_runs()))
    rows += rows[-3:] + [(None, "x y " * 20), (10**15, " ".join(f"v{i}" for i in range(25_000)))]
    docs = documents(spark, rows)
    looped = docs.withColumn("text", periodic_runs.periodic_text(F.col("doc_id"), F.col("text")))
    found = periodic_runs.find_runs(looped)
    assert found.columns == ["doc_id", "blocks", "n_words", "_text", "runs", "collapsed"]
    got = [tuple(r) for r in periodic_runs.digests(found).collect()]
    # The plain version is quadratic, so the long text, which holds no word twice, is known to have no run.
    want = [plain_row(i, t) for i, t in rows[:-1]]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows[:-1]) > 5 and sum(r[1] for r in want) > 200
    assert zlib.crc32(str(10**15).encode()) % 10 != 0
    assert sorted(map(repr, got)) == sorted(map(repr, [*want, (10**15, 0, None, None, None, None, hashlib.sha256(b"").hexdigest(), hashlib.sha256(rows[-1][1].encode()).hexdigest())]))


def test_periodic_runs_of_long_texts():
    one, _, _ = words = periodic_runs.numbered([[b"a"] * 100_000])
    assert periodic_runs.runs_of(*words[:2]).tolist() == [[1, 100_000, 1]] and len(one) == 100_002
    blocks = periodic_runs.numbered([([b"a"] * 999 + [b"b"]) * 4, [b"c"] * 5])
    assert periodic_runs.runs_of(*blocks[:2]).tolist() == [[1, 999, 1], [1, 4000, 1000], [1001, 999, 1], [2001, 999, 1], [3001, 999, 1]]
    rnd = random.Random(2)
    unit = [b"%d" % rnd.randrange(50) for _ in range(7001)]
    text = periodic_runs.numbered([unit * 3 + unit[:77]])
    assert [1, 3 * 7001 + 77, 7001] in periodic_runs.runs_of(*text[:2]).tolist()


def test_periodic_runs_of_an_empty_table(spark):
    assert periodic_runs.digests(periodic_runs.find_runs(documents(spark, []))).collect() == []


# ---- 12 vector codes


def plain_codes(rows):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    dim = max((-(-len(v) // 16) * 16 for *_, v in kept), default=16) or 16
    width = dim // 16
    split = [[(v + [0] * dim)[p * width : (p + 1) * width] for p in range(16)] for *_, v in kept]
    books = [[s[p] for s in split[:64]] for p in range(16)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p]))
    for _ in range(2):
        new = []
        for p in range(16):
            mine = collections.defaultdict(list)
            for s in split:
                mine[near(p, s[p])[1]].append(s[p])
            new.append([[sum(c) // len(mine[e]) for c in zip(*mine[e])] if e in mine else c for e, c in enumerate(books[p])])
        books = new
    out = [(i, label, [near(p, s[p]) for p in range(16)]) for (i, label, _), s in zip(kept, split)]
    errors = collections.Counter()
    for _, label, best in out:
        errors[label] += sum(d for d, _ in best)
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), errors[label], sha) for i, label, best in out]


def coded(spark, rows):
    df = spark.createDataFrame([(i, v, label, "c", "e") for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error string")
    found, books = vector_codes.compress(df)
    sha = hashlib.sha256(vector_codes.books_text(books).encode()).hexdigest()
    return [(r.vec_id, r.code, r.error, r.label_error, sha) for r in vector_codes.with_label_error(found).collect()]


@pytest.mark.parametrize("dim", [64, 16, 48, 37])
def test_vector_codes_against_plain_python(spark, dim):
    rnd = random.Random(dim)
    draw = lambda: [float(np.float32(rnd.gauss(0, 0.3))) for _ in range(dim)]
    rows = [(i, draw(), rnd.choice([1, 1, 1, 2, 3, None])) for i in range(300)]
    rows += [(i, rows[i - 300][1], 1) for i in range(300, 340)]  # equal vectors: ties
    rows += [(400, None, 1), (401, [math.nan] * dim, 1), (402, [math.inf] + [0.0] * (dim - 1), 2), (403, [None] * dim, 2), (404, [0.0] * dim, None), (405, [-0.001] * dim, 4), (406, draw()[: dim // 2], 4), (407, [], 4)]
    rows += [(i, draw(), 5) for i in range(-30, 0)]
    rnd.shuffle(rows)
    assert sorted(coded(spark, rows)) == sorted(plain_codes(rows))


def test_vector_codes_of_few_repeated_and_no_rows(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []
    row = [0.5, -0.25] * 8
    assert coded(spark, [(1, row, 1)]) == plain_codes([(1, row, 1)])
    same = [(7, row, 1)] * 5 + [(None, [1.0] * 16, None)]
    assert sorted(coded(spark, same), key=repr) == sorted(plain_codes(same), key=repr)


def test_nearest_is_exact_beyond_long():
    rnd = random.Random(5)
    x = np.array([[rnd.randrange(-(1 << 53), 1 << 53) for _ in range(5)] for _ in range(40)])
    book = np.array([[rnd.randrange(-(1 << 53), 1 << 53) for _ in range(5)] for _ in range(20)] + [x[3].tolist(), x[3].tolist()])
    number, distance = vector_codes.nearest(x, book)
    want = [min((sum((a - b) ** 2 for a, b in zip(v, c)), e) for e, c in enumerate(book.tolist())) for v in x.tolist()]
    assert list(zip(distance.tolist(), number.tolist())) == want and number[3] == 20


def test_walsh_rows_come_by_sequency():
    for n in (1, 2, 8, 16):
        w = vector_codes.walsh(n)
        assert (w @ w.T == n * np.eye(n)).all() and (np.diff(w, axis=1) != 0).sum(1).tolist() == list(range(n))


def test_label_errors_of_many_labels(spark):
    rows = [(i, i % 1200 if i > 4000 else 1, "", i) for i in range(6000)] + [(i, None, "", 1) for i in range(6000, 6050)]
    df = spark.createDataFrame(rows, "vec_id long, label int, code string, error long")
    want = collections.Counter()
    for _, label, _, error in rows:
        want[label] += error
    got = vector_codes.with_label_error(df).collect()
    assert len(got) == len(rows) and all(r.label_error == want[r.label] for r in got)


# ---- 13 license scans


def plain_scan(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = set()
    for a in range(0, len(w), license_scan.STRIDE):
        block = set(w[a : a + license_scan.BLOCK])
        for t, (label, body) in enumerate(license_scan.TEMPLATES):
            held = len(block & set(body.split()))
            if 5 * held >= 4 * len(set(body.split())):
                found.add((a, min(a + license_scan.BLOCK, len(w)), label, t, held / len(set(body.split()))))
    return len(w), sorted(base), sorted(found)


def test_license_scan_against_plain_python(spark):
    rnd = random.Random(13)
    vocabulary = [w.decode() for w in license_scan.vocabulary()]
    texts = [None, "", "MIT", "MIT-License, mit.LICENSE; the Apache\nlicense", "general public license general public license", "mit   license", "MİT license", "mit license" + " x" * 200 + " mit"]
    for _, body in license_scan.TEMPLATES:
        own = body.split()
        for lost in (0, len(own) // 10, len(own) // 4):
            words = [w for i, w in enumerate(own) if i not in set(rnd.sample(range(len(own)), lost))]
            texts.append(" ".join(rnd.choices(["lorem", "ipsum", "dolor"], k=rnd.randrange(150)) + [w.upper() if rnd.random() < 0.3 else w for w in words] + ["amet"] * rnd.randrange(150)))
    texts += [" ".join(rnd.choices(vocabulary, k=rnd.randrange(400))) for _ in range(60)] + [" ".join(["word"] * 30_000 + ["released under the Apache license"])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])]
    found = license_scan.scan(documents(spark, rows))
    assert found.columns == ["doc_id", "runs", "_text", "n_words", "phrases", "blocks"]
    got = collections.Counter((r.doc_id, r.n_words, tuple((p.start, p.label) for p in r.phrases), tuple(sorted(tuple(b) for b in r.blocks))) for r in found.collect())
    want = collections.Counter((i, n, tuple(base), tuple(blocks)) for i, t in rows for n, base, blocks in [plain_scan(t)])
    assert got == want and sum(len(k[3]) for k in want) > 60
    for r in license_scan.summary(found).collect():
        n, base, blocks = plain_scan(dict(rows)[r.doc_id])
        labels = lambda x: ",".join(sorted(set(x)))
        assert (r.n_words, r.n_base, r.base_labels, r.labels) == (n, len(base), labels(b for _, b in base), labels([b for _, b in base] + [b[2] for b in blocks]))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r.score == (1.0 if base else max((b[4] for b in blocks), default=0.0))


def test_license_templates_fit_a_block():
    assert all(len(t.split()) <= license_scan.BLOCK - license_scan.STRIDE + 1 for _, t in license_scan.TEMPLATES)


def test_license_scan_of_clean_and_no_texts(spark):
    assert license_scan.summary(license_scan.scan(documents(spark, []))).collect() == []
    prose = "The software was released in spring and anyone with a license to drive may use the car, provided that the copy of this form is signed by the holder. "
    row = license_scan.summary(license_scan.scan(documents(spark, [(1, prose * 30)]))).first()
    assert (row.labels, row.score, row.first_word) == ("", 0.0, None)


@pytest.mark.parametrize("module", [vector_codes, license_scan])
def test_sql_agrees(spark, module):
    duckdb = pytest.importorskip("duckdb")
    rnd = random.Random(4)
    con = duckdb.connect()
    if module is vector_codes:
        rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(32)] if i % 9 else None, rnd.choice([1, 2, None])) for i in range(200)]
        embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"label": "Int32"})  # noqa: F841
        con.execute("CREATE TABLE embeddings AS SELECT vec_id, embedding::FLOAT[] AS embedding, label FROM embeddings")
        got = coded(spark, rows)
    else:
        vocabulary = [w.decode() for w in license_scan.vocabulary()] + ["MIT License", "general public LICENSE"]
        rows = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randrange(300)))) for i in range(80)] + [(90, None), (91, license_scan.TEMPLATES[4][1])]
        documents_ = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
        con.execute("CREATE TABLE documents AS SELECT * FROM documents_")
        got = [tuple(r) for r in license_scan.summary(license_scan.scan(documents(spark, rows))).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(module.SQL).fetchall(), key=repr)


# ---- bounded samples of 7 and 10


def test_an_id_that_repeats_adds_one_row_to_the_samples(spark):
    rows = [(7, f"je suis le numero {i}", "fr", "s", 1) for i in range(400)] + [(i, f"this is the number {i}", "en", "s", 1) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").where("crc32(cast(doc_id AS string)) % 5 <> 0")
    labels = spark.createDataFrame([(7, 1, 1)] + [(i, 1, 0) for i in range(100, 140)], "doc_id long, quality int, toxic int")
    drawn, sizes = toxicity.sample_of(docs, labels)
    ids = docs.select("doc_id").distinct().count()
    assert docs.where("doc_id = 7").count() == 400 and drawn.count() == ids == sum(sizes.values())
    assert drawn.where("toxic = 1").first()["text"] == max(r[1] for r in rows[:400])
    assert set(langid.fit(docs).languages) == {"en", "fr"}
