"""The pipeline against a version in plain Python on the smallest tables, and its guard."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_operators import brute_leaks, brute_near

import __spark_entry__ as entry
from eventmirror.llm import bpe, langid, queries, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


def plain(spark, rows, labels, benchmark):
    """The pipeline's result over (doc_id, text, lang) rows: the trained models applied row by row, near copies and
    leaks by brute force, tokens by the library."""
    frame = lambda own: spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(frame(rows))
    names, scores = model.predict([r[1] for r in rows])
    rows = [r for r, name, score in zip(rows, names, scores) if name != langid.UNKNOWN and score >= model.threshold]
    civil = toxicity.fit(frame(rows), labels).scores([r[1] or "" for r in rows])
    rows = [r for r, score in zip(rows, civil) if score < 0.5]
    component = brute_near([r[:2] for r in rows])[0]
    rows = [r for r in rows if component[r[0]] == r[0]]
    leaks = set(brute_leaks([r[:2] for r in rows], benchmark))
    rows = [r for r in rows if r[0] not in leaks]
    path = public_tokenizers.path(queries.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Vocabulary(path).ranks, special_tokens={})
    out = []
    for r in rows:
        ids = library.encode_ordinary(r[1] or "")
        out.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), ids))
    return sorted(out)


def shown(df):
    return sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.tokens)) for r in df.collect())


def test_run_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    want = plain(spark, rows, spark.read.parquet(f"{TABLES}/labels.parquet"), items)
    assert shown(corpus_pipeline.run(spark, TABLES)) == want and 0 < len(want) < len(rows)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.materialise(stage(spark, docs, TABLES), name)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        assert after <= before
        before = after


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and a column of a name that stages use."""
    rnd = random.Random(2)
    say = lambda n: " ".join(rnd.choice("alpha beta gamma delta omega sigma".split()) + str(rnd.randrange(400)) for _ in range(n))
    rows = [(i, say(30), "en", "s", 1, "x") for i in range(60)] + [(100, None, "en", "s", None, None), (101, "", None, None, 0, "x"), (102, say(40_000), "en", "s", 1, "x"), (103, "12 !?", "en", "s", 1, "x")]
    rows += [rows[3], (200, rows[5][1], None, None, None, None), (None, say(30), "en", "s", 1, "x")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, score string"
    passage = rows[7][1]
    for name, own in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(own, shape).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "some")).collect()]
    assert sorted(i for i in got if i is not None) == sorted([i for i in range(60) if i != 7] + [102, 3]) and got.count(None) == 1
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
