"""The corpus operators on small fixtures, held against plain Python."""

import base64
import collections
import gzip
import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventmirror.llm import bpe, common, decontaminate, embedding_dedup, html_extract, langid, ngram_jaccard, preference, sharding, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], DOCS + "".join(f", {n} string" for n in ("score", "h", "node")[: len(extra)]))


def words(rnd, n, of=2000):
    return [f"w{rnd.randrange(of)}" for _ in range(n)]


# ---- components


def test_connected_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}


# ---- 1 sharding


def test_sharding_law_and_slots(spark):
    rows = [(i, "x" * (i % 7)) for i in range(3000)] + [(5, None), (5, None), (None, "a")]
    out = sharding.shard_documents(documents(spark, rows, ("clash",)), 8).toPandas()
    assert len(out) == 3003 and (out.law == "key").all()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert set(out.shard) == set(range(8)) and ((out.grown_shard == out.shard) | (out.grown_shard == 8)).all()
    assert 3003 / 9 * 0.8 < (out.grown_shard == 8).sum() < 3003 / 9 * 1.2
    sizes = out[out.doc_id == 5]
    assert sorted(sizes["size"]) == [1, 1, 6] and sizes.shard.nunique() == 1
    assert out[out.doc_id == 6].text_crc32.iloc[0] == zlib.crc32(b"x" * 6)


def test_slots_over_many_buckets(spark):
    df = spark.range(1000).selectExpr("id", "cast(id % 3 as int) AS shard")
    out = sharding.with_slots(df, "shard", rows_per_bucket=50).toPandas()
    assert len(out) == 1000 and all(sorted(own.slot) == list(range(len(own))) for _, own in out.groupby("shard"))


def test_slots_of_many_copies(spark):
    df = spark.range(3000).selectExpr("if(id < 2500, NULL, id) AS id", "cast(0 as int) AS shard")
    out = sharding.with_slots(df, "shard", rows_per_bucket=100, copies_per_row=7).toPandas()
    assert sorted(out.slot) == list(range(3000)) and out.id.isna().sum() == 2500


def test_rendezvous_against_plain_python(spark):
    """Bids recomputed from MD5 and logarithms outside Spark, for equal and other weights."""

    def winner(key, weights):
        bids = []
        for s, w in weights.items():
            bits = int(hashlib.md5(f"{key}/{s}".encode()).hexdigest()[:13], 16)
            bids.append((-math.log((bits + 0.5) / 2**52) / w, s))
        return min(bids)[1]

    rows = [(i, "x" * (i % 50)) for i in range(500)] + [(None, None), (7, "long " * 60_000)]
    for shards in (8, {0: 1.0, 3: 2.5, 5: 0.5}):
        weights = dict.fromkeys(range(8), 1.0) if shards == 8 else shards
        grown = weights | {max(weights) + 1: 1.0}
        out = sharding.shard_documents(documents(spark, rows), shards).collect()
        assert len(out) == len(rows)
        for r in out:
            key = "" if r.doc_id is None else str(r.doc_id)
            assert (r.shard, r.grown_shard) == (winner(key, weights), winner(key, grown))
        assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}


def test_weighted_rendezvous(spark):
    df = spark.range(20_000)
    place = lambda w: df.select("id", sharding.rendezvous(F.col("id"), w).alias("s")).toPandas().set_index("id").s
    a, b = place({0: 1, 1: 1, 2: 2}), place({0: 1, 1: 1, 2: 2, 3: 1})
    assert abs((a == 2).mean() - 0.5) < 0.02 and ((a == b) | (b == 3)).all()
    assert sharding.shard_documents(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), {0: 0})


# ---- 2 decontamination


def test_masks_find_two_substitutions():
    for bad in itertools.combinations(range(decontaminate.WINDOW), 2):
        assert any(not set(bad) & {o + m for m in mask} for mask in decontaminate.MASKS for o in range(decontaminate.WINDOW - mask[-1]))


def brute_leaks(docs, items):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, text in docs:
        h = tokens(text)
        for i, item in items:
            b = tokens(item)
            if len(b) < 5:
                continue
            width, need = min(13, len(b)), len(b) if len(b) < 13 else 11
            for shift in range(-len(b) + 1, len(h)):
                eq = [int(0 <= k + shift < len(h) and h[k + shift] == b[k]) for k in range(len(b))]
                if any(sum(eq[s : s + width]) >= need and 0 <= s + shift and s + shift + width <= len(h) for s in range(len(b) - width + 1)):
                    out.setdefault(d, set()).add(i)
    return out


def test_leaks_against_brute_force(spark):
    rnd = random.Random(2)
    items = [(i, " ".join(words(rnd, n, 60))) for i, n in enumerate((30, 20, 13, 12, 8, 5, 4, 0, 40))] + [(9, None)]
    docs = []
    for d in range(60):
        body = words(rnd, rnd.randrange(3, 60), 60)
        if d % 2:
            piece = items[rnd.choice((0, 1, 2, 3, 4, 5, 6, 8))][1].split()
            start = rnd.randrange(max(1, len(piece) - 12))
            piece = piece[start : start + rnd.randrange(11, 25)] if d % 4 == 1 else piece
            for _ in range(d % 3):
                piece[rnd.randrange(len(piece))] = "CHANGED"
            at = rnd.randrange(len(body))
            body[at:at] = piece
        docs.append((d, ", ".join(body).upper() if d % 5 == 0 else " ".join(body)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[1][1])]
    out = decontaminate.find_leaks(documents(spark, docs, ("clash", "clash")), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: set(r.item_ids) for r in out.collect()} == brute_leaks(docs, items)
    left = decontaminate.remove_leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in docs} - set(brute_leaks(docs, items))


def test_leaks_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(documents(spark, [(1, "a b c d e f g")]), none).count() == 0
    assert decontaminate.find_leaks(documents(spark, []), spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0


def test_leaks_by_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    out = decontaminate.find_leaks(documents(spark, [(1, f"x {item} y"), (2, "clean")]), spark.createDataFrame([(4, item)], "item_id long, text string"))
    assert [(r.doc_id, r.item_ids, r.n_equal) for r in out.collect()] == [(1, [4], 14)]


# ---- 3 HTML


PAGE = '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div>%s<footer>&copy; us</footer></body></html>'


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain   text", "plain text"), (PAGE % "<article><h1>A&amp;B</h1><p>x <b>bo</b>ld<br>y</p></article>", "A&B x bold y"),
        (PAGE % "<article><p><b>One<br><p>Two</p></article>", "One Two"), (PAGE % "<article><p>cut &am", "cut &am"), (PAGE % "<article>a<script>var t='</p>'</script>b<!-- c -->c</article>", "abc"),
        (PAGE % "<article><div class='post comments'>no</div><aside>no</aside><form>no</form><p>yes</p></article>", "yes"), (PAGE % "<main><header><h1>T</h1></header><p>b</p></main>", "T b"),
        (PAGE % "<header>site</header><div id=content><p>a&nbsp;&#233;&lt;x&gt;</p></div>", "a é<x>"), (PAGE % "<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table></article>", "1 2 3 4"),
        (PAGE % "<article><p>a<span hidden>no</span>b</p><div aria-hidden='true'>no</div></article>", "a b"), ("<article>x</b></i></p>y", "x y"), (PAGE % "<article></article>", ""), ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_page(html, text):
    assert " ".join(html_extract.alone(html_extract.blocks_of(html or ""))) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ('<body class="no-sidebar"><p>t</p></body>', "t"), ('<body class="sidebar widget"><p>t</p></body>', "t"), ('<article class="post social-proof">t</article>', "t"),
        ('<main id="search">t</main>', "t"), ('<div class="overflow-hidden">t</div>', "t"), ('<div style="overflow: hidden">t</div>', "t"), ('<article title="The hidden garden">t</article>', "t"),
        ("<p data-x='a class=\"ad\" b'>t</p>", "t"), ("<p class=x class=ad>t</p>", "t"), ("<div data-hidden=1>t</div>", "t"),
        ("<div class=ad>t</div><p class='x hidden'>t</p><p hidden>t</p><p title='x' hidden=''>t</p><div role=navigation>t</div><div aria-hidden=true>t</div>", ""),
    ],
)
def test_words_in_attributes(html, text):
    assert " ".join(b["text"] for b in html_extract.blocks_of(html) if b["state"] == html_extract.KEPT) == text


def test_weak_words_give_way_to_what_varies(spark):
    page = lambda i: f"<div class=widget><h2>Top</h2><p>story {i}</p></div><div class=ad>buy {i}</div>"
    other = lambda i: f"<p>text {i}</p><div class=widget>tip {i}</div>"
    rows = [(i, "http://a.example/", page(i)) for i in range(30)] + [(100 + i, "http://b.example/", other(i)) for i in range(30)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == {i: f"story {i}" for i in range(30)} | {100 + i: f"text {i}" for i in range(30)}


def test_template_of_a_host(spark):
    rnd = random.Random(3)
    page = lambda i: f"<body><div class=top>Always here</div><div class=body><p>{' '.join(words(rnd, 9))}</p><p>Shared line</p>{'<p>more</p>' * (i % 3)}</div><p>Imprint</p></body>".replace("Shared line", "Shared line" if i % 2 else f"own {i}")
    rows = [(i, f"http://A.example/{i}", page(i)) for i in range(200)] + [(900, "http://b.example/", page(1)), (901, None, page(1)), (902, "http://b.example/", None)]
    copy = page(5)
    rows += [(1000 + i, "http://copies.example/x", copy) for i in range(20)]
    out = html_extract.extract(spark.createDataFrame([r + ("c",) for r in rows], "page_id long, url string, html string, text string")).toPandas().set_index("page_id")
    assert len(out) == len(rows)
    assert not out[out.index < 200].text.str.contains("Always here|Imprint").any()
    assert out.loc[1].text.count("Shared line") == 1 and out.loc[4].text.count("own 4") == 1
    assert "Always here" in out.loc[900].text and "Always here" in out.loc[1000].text and out.loc[902].text == "" and out.loc[902].n_chars == 0


def test_template_of_a_host_with_many_copies(spark):
    rnd = random.Random(4)
    page = lambda: f"<body><div class=top>Always here</div><div class=body><p>{' '.join(words(rnd, 9))}</p></div></body>"
    rows = [(i, "http://hot.example/", page()) for i in range(20)]
    rows += [(100 + i, "http://hot.example/", rows[0][2]) for i in range(1200)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas()
    assert len(out) == len(rows) and not out.text.str.contains("Always here").any() and (out.n_chars > 0).all()


def brute_match(a, b):
    """The most matched nodes, over all ways to pair the children in order."""
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), brute_match(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a.children, b.children)


def test_tree_matching_against_brute_force():
    rnd = random.Random(8)

    def paths():
        out, open_ = [], [""]
        for _ in range(rnd.randrange(1, 9)):
            out.append(f"{rnd.choice(open_[-3:])}/{rnd.choice('abc')}:{len(out)}")
            open_.append(out[-1])
        return out

    for _ in range(300):
        shapes = html_extract.Shapes()
        (a, own), (b, _) = html_extract.tree(paths(), shapes), html_extract.tree(paths(), shapes)
        pairs = html_extract.aligned(a, b, shapes)
        assert shapes.match(a.shape, b.shape) == brute_match(a, b) == len(pairs)
        assert all(x.label == y.label for x, y in pairs) and len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
        order = {id(n): i for i, n in enumerate(walk(a))}
        other = {id(n): i for i, n in enumerate(walk(b))}
        places = sorted((order[id(x)], other[id(y)]) for x, y in pairs)
        assert [y for _, y in places] == sorted(y for _, y in places)


def test_long_lists_of_siblings_are_aligned_as_a_whole():
    rnd = random.Random(81)
    for n in (30, 150, 400):
        paths = lambda: [f"/{rnd.choice('abcd')}:{i}" + rnd.choice(["", "/x:0", "/y:0"]) for i in range(n + rnd.randrange(20))]
        shapes = html_extract.Shapes()
        (a, _), (b, _) = html_extract.tree(paths(), shapes), html_extract.tree(paths(), shapes)
        pairs = html_extract.aligned(a, b, shapes)
        row = [0] * (len(b.children) + 1)
        for x in a.children:  # the whole table, cell by cell
            above, row = row, [0]
            for j, y in enumerate(b.children):
                row.append(max(above[j + 1], row[j], above[j] + brute_match(x, y)))
        assert len(pairs) == 1 + row[-1] == shapes.match(a.shape, b.shape)
        order, other = ({id(x): i for i, x in enumerate(walk(r))} for r in (a, b))
        places = sorted((order[id(x)], other[id(y)]) for x, y in pairs)
        assert all(x.label == y.label for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(places, places[1:]))


@pytest.mark.parametrize("n", [60, 64, 100, 128, 140, 700])
def test_one_more_block_before_many_siblings_leaves_no_template(spark, n):
    box = lambda k: f"<div class=box><b>Fixed box {k}</b></div>"
    page = lambda i: "<body>" + "<div class=top>Top of all</div>" * (i % 2) + "".join(box(k) if k % 7 == 3 else f"<p>own {i} {k}</p>" for k in range(n)) + "</body>"
    out = html_extract.extract(spark.createDataFrame([(i, "http://wide.example/", page(i)) for i in range(20)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in out} == {i: " ".join(f"own {i} {k}" for k in range(n) if k % 7 != 3) for i in range(20)}


def walk(node):
    yield node
    for child in node.children:
        yield from walk(child)


def bare_page(rnd, i):
    """No tag or word tells the article from the rest: only alignment can."""
    hint = "<div><span>Tip of the day for everyone</span></div>" if i % 3 == 0 else ""
    links = "".join(f"<div><a href=/{w}>{w} {w}</a></div>" for w in words(rnd, 4))
    body = "".join(f"<p>{' '.join(words(rnd, 30))}</p>" for _ in range(rnd.randrange(2, 6)))
    return f"<body><div>Home News Contact</div>{hint}<section>{links}</section><section><h2>{' '.join(words(rnd, 3))}</h2>{body}<p>Copyright of this site</p></section><div>All rights {i % 2}</div></body>", re.findall(r"<h2>(.*?)</h2>|<p>(w.*?)</p>", f"<h2>x</h2>{body}")


def test_article_without_telling_tags(spark):
    rnd = random.Random(12)
    made = [bare_page(rnd, i) for i in range(150)]
    rows = [(i, f"http://bare.example/{i}", html) for i, (html, _) in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    for i, (html, parts) in enumerate(made):
        title = re.search(r"<h2>(.*?)</h2>", html)[1]
        assert out[i] == " ".join([title, *[p for _, p in parts if p]])
    without = {r.page_id: r.text for r in html_extract.extract(df, induction=False).collect()}
    assert all("Home News Contact" in without[i] and without[i] != out[i] for i in out)
    assert {r.page_id: r.text for r in html_extract.extract(df.repartition(7).orderBy(F.desc("page_id"))).collect()} == out


def test_deep_wide_and_broken_pages(spark):
    rnd = random.Random(13)
    deep = lambda i: "<div>" * 3000 + f"<p>deep {i}</p>" + "</div>" * 3000
    wide = lambda i: "<article><table>" + "".join(f"<tr><td>{i} {k}</td><th>{k}</th></tr>" for k in range(2000)) + "</table>" + f"<dl>{''.join(f'<dt>{i}<dd>{k}' for k in range(600))}</dl></article>"
    broken = "<section>" * 2000 + "</p>" * 20_000 + "x" + "</b>" * 20_000
    rows = [(i, "http://deep.example/", deep(i)) for i in range(20)] + [(100 + i, "http://wide.example/", wide(i)) for i in range(12)]
    rows += [(200, "http://wide.example/", broken), (201, None, None), (202, "http://deep.example/", ""), (None, "http://deep.example/", deep(3)), (203, "http://long.example/", f"<p>{' '.join(words(rnd, 200_000))}</p>")]
    began = time.time()
    out = html_extract.extract(spark.createDataFrame([r + ("clash",) for r in rows], "page_id long, url string, html string, text string")).collect()
    assert time.time() - began < 120 and len(out) == len(rows)
    text = {r.page_id: r.text for r in out}
    assert [text[i] for i in range(20)] == [f"deep {i}" for i in range(20)] and text[None] == "deep 3"
    # Cells that are the same on all pages are template.
    assert all(text[100 + i].split() == [w for k in range(2000) for w in (str(i), str(k))] + [str(i)] * 600 for i in range(12))
    assert text[200] == "x" and text[201] == "" and len(text[203].split()) == 200_000
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_near_copies_of_one_article_keep_it(spark):
    """All pages of a host hold one article but for a word: its text is no template."""
    rnd = random.Random(15)
    body = [words(rnd, 40) for _ in range(12)]
    page = lambda i: f"<nav>menu</nav><article><h1>same title</h1>{''.join('<p>' + ' '.join([*p[:-1], str(i) if k == i % 12 else p[-1]]) + '</p>' for k, p in enumerate(body))}</article><div class=ad>buy</div>"
    out = html_extract.extract(spark.createDataFrame([(i, "http://copies.example/", page(i)) for i in range(100)], "page_id long, url string, html string")).collect()
    assert all(len(r.text.split()) == 480 and str(r.page_id) in r.text.split() for r in out)


def test_wrappers_by_salted_joins(spark, monkeypatch):
    rnd = random.Random(14)
    rows = [(i, f"http://bare{i % 3}.example/{i}", bare_page(rnd, i)[0]) for i in range(90)] + [(500 + i, f"http://few{i}.example/", bare_page(rnd, i)[0]) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    monkeypatch.setattr(html_extract, "BROADCAST_BYTES", 0)
    assert {r.page_id: r.text for r in html_extract.extract(df).collect()} == want


# ---- 4 embeddings


def brute_links(rows, cosine=0.93):
    good = [(i, l, np.asarray(v, float) / np.linalg.norm(v)) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = collections.defaultdict(set)
    for (i, l, v), (j, m, w) in itertools.combinations(good, 2):
        if l == m and len(v) == len(w) and v @ w >= cosine:
            near[i].add(j)
            near[j].add(i)
    comp = {}
    for start in sorted(i for i, *_ in rows):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = start
                todo += near[x]
    return {i: (len(near[i]), comp[i]) for i, *_ in rows}


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 60)
    monkeypatch.setattr(embedding_dedup, "MEMBERS", 7)
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(12):
            base = rng.normal(size=16)
            for spread in rng.uniform(0.0, 0.45, rng.integers(1, 14)):
                noise = rng.normal(size=16)
                v = base / np.linalg.norm(base) + spread * noise / np.linalg.norm(noise)
                rows.append((n, [float(x) for x in v.astype(np.float32)], label))
                n += 1
    rows += [(n + k, list(rows[0][1]), 0) for k in range(25)]  # copies
    n += 25
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [1.0, None], 0), (n + 5, rows[0][1], None), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [float("inf")] + [0.0] * 15, 0)]
    df = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    out = embedding_dedup.near_duplicates(df)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    want = brute_links(rows)
    true, found = sum(v[0] for v in want.values()), sum(min(got[i][0], v[0]) for i, v in want.items())
    assert set(got) == set(want) and found / true >= 0.9 and all(got[i][0] <= v[0] for i, v in want.items())
    assert all(want[i][1] <= got[i][1] <= i for i in want)  # a lost link splits a component, nothing joins two
    if found == true:
        assert got == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in out.collect())
    audit = embedding_dedup.audit_recall(df.where("size(embedding) = 16 AND vec_id < 200"), out, every=10).first()
    assert audit.recall >= 0.9
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("mean, rows", [(0.89, 1200), (0.93, 600)])
def test_vectors_with_a_common_direction(spark, monkeypatch, mean, rows):
    """All vectors share a direction: one shard, searched part by part, or as one part."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(rows, 64))
    x[:, 0] += 8 * np.sqrt(mean / (1 - mean))
    x = np.vstack([x, x[:40], x[:40] + rng.normal(size=(40, 64)) * 0.3])
    unit = embedding_dedup.units(list(x))
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    component = np.arange(len(x))
    while True:
        low = np.minimum(component, np.where(near, component[None, :], len(x)).min(1))
        if (low == component).all():
            break
        component = low
    for part_rows in (500, 6000):
        monkeypatch.setattr(embedding_dedup, "PART_ROWS", part_rows)
        got = embedding_dedup.near_duplicates(df).toPandas().set_index("vec_id").sort_index()
        assert len(got) == len(x) and (got.n_links.to_numpy() <= near.sum(1)).all()
        assert got.n_links.sum() >= 0.99 * near.sum()
        assert (got.component_id.to_numpy() >= component).all()


def test_groups_are_linked_as_the_matrix_links_them():
    rng = np.random.default_rng(7)
    for n in (1, 5, 40):
        linked = np.triu(rng.random((n, n)) < 1.2 / n, 1)
        ids = rng.permutation(1000)[:n]

        def groups(pairs):
            of = {int(i): {int(i)} for i in ids}
            for a, b in pairs:
                of[a] |= of[b]
                for c in of[a]:
                    of[c] = of[a]
            return {frozenset(g) for g in of.values()}

        found = embedding_dedup.stars(linked, ids, ids)
        assert groups(found) == groups([(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(linked))]) and len(found) < 2 * n


def test_robust_pruning_keeps_the_nearest():
    x = embedding_dedup.units(list(np.random.default_rng(1).normal(size=(80, 8))))
    graph = embedding_dedup.build_graph(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -1)
    assert all(sims[i].argmax() in graph[i] for i in range(80))


def test_links_of_many_exact_copies(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 10)
    monkeypatch.setattr(embedding_dedup, "MEMBERS", 7)
    rng = np.random.default_rng(8)
    base = np.concatenate([[0.0], rng.normal(size=15)])
    near = [base + s * rng.normal(size=16) for s in (0.02, 0.1, 0.1, 0.13, 0.13)]
    vectors = [base] * 1200 + [np.concatenate([[-0.0], base[1:]])] + near * 3 + list(rng.normal(size=(40, 16)))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    scaled = [(5000 + i, [float(c) for c in np.float32(base * s)], 1) for i, s in enumerate(rng.uniform(0.5, 7, 900))]
    table = spark.createDataFrame(rows + scaled, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).collect()}
    assert got == brute_links(rows) | brute_links(scaled)


# ---- 5 preference


def test_preference_pairs(spark):
    t = lambda conv, *turns: [(conv, i, r, x) for i, (r, x) in enumerate(turns)]
    rows = t(2, ("user", "hi"), ("assistant", "a"), ("user", "q"), ("assistant", "long <|end|> answer")) + t(3, ("user", "hi"), ("assistant", "a"), ("user", "q"), ("assistant", None)) + t(4, ("user", "same")) + t(5, ("user", "same"))
    rows += t(6, ("user", "a")) + t(7, (None, "b"), ("assistant", "c")) + t(8, ("user", "alone")) + [(2, 0, "user", "hi"), (None, 0, "user", "x"), (3, None, "user", "x")]
    df = preference.pair_neighbours(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.pair_id: r for r in preference.format_preferences(df).collect()}
    assert set(out) == {1, 2, 3}
    both = spark.createDataFrame([(1, "chosen", 9, 0, "user", "of nine"), (1, "chosen", 4, 0, "user", "of four"), (1, "chosen", 4, 1, "assistant", "y " * 200_000), (1, "rejected", 5, 0, "user", "of four")], "pair_id long, side string, conv_id long, turn long, role string, text string")
    (r,) = preference.format_preferences(both.withColumn("prompt", F.lit("clash"))).collect()
    assert (r.chosen_id, r.n_common, r.prompt) == (4, 1, "<|user|>\nof four<|end|>\n") and len(r.chosen) == 400_022
    one = out[1]
    assert one.n_common == 3 and one.prompt == "<|user|>\nhi<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nq<|end|>\n" and one.usable
    assert one.chosen == "<|assistant|>\nlong < |end|> answer<|end|>\n" and one.rejected == "<|assistant|>\n<|end|>\n"
    runs = [(x[0], int(x[1:])) for x in re.findall(r"[+-]\d+", one.chosen_mask)]
    assert sum(n for _, n in runs) == len(one.chosen) and one.chosen[runs[0][1] :] == "long < |end|> answer<|end|>\n" and runs[1][0] == "+"
    assert (out[2].n_common, out[2].chosen, out[2].usable) == (1, "", False) and out[3].n_common == 0
    assert preference.format_preferences(df.limit(0)).count() == 0


# ---- 6 n-gram Jaccard


def brute_near(rows):
    sets = collections.defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i].append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in ids}, {i: sorted(map(len, s)) for i, s in sets.items()}


def edited(rnd, body, n):
    body = list(body)
    for _ in range(n):
        body[rnd.randrange(len(body))] = f"new{rnd.randrange(10**6)}"
    return body


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_jaccard, "LOCAL_HOT", 3)
    monkeypatch.setattr(ngram_jaccard, "LOCAL_TOTAL", 4)
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 3)
    if seed == 2:  # columns in blocks, pairs a few at a time, hubs by a shuffle
        for name, value in (("BIG", 6), ("PAIRS", 20), ("MOST_HUBS", 0)):
            monkeypatch.setattr(ngram_jaccard, name, value)
    rnd = random.Random(seed)
    passage, rows, n = words(rnd, 60), [], 0
    for g in range(40):
        base = words(rnd, rnd.choice((1, 2, 3, 4, 5, 8, 30, 80, 150)))
        if g % 3 == 0:
            base = passage + base
        for k in range(rnd.choice((1, 1, 2, 3, 25 if g % 10 == 0 else 4))):
            body = edited(rnd, base, rnd.randrange(4)) if k else base
            rows.append((n, (" ", "\n", "\t ")[k % 3].join(body).title() if k % 2 else " ".join(body)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "a b c"), (n + 4, "A  B\nc"), (n + 5, "nb sp x y z"), (0, rows[0][1])]
    out = ngram_jaccard.near_duplicates(documents(spark, rows + [(None, rows[0][1])], ("x", "y", "z"))).collect()
    comp, sizes = brute_near(rows)
    assert len(out) == len(rows) + 1
    assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == comp
    assert all(r.n_shingles in sizes[r.doc_id] for r in out if r.doc_id is not None) and [r.component_id for r in out if r.doc_id is None] == [None]
    kept = ngram_jaccard.keep_one(documents(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, c in comp.items() if i == c}
    assert ngram_jaccard.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [1, 7, 100_000])
def test_runs_come_whole_whatever_the_batches(rows):
    rnd = random.Random(rows)
    h = sorted(rnd.choice((1, 2, 2, 2, 3, 9, 9)) for _ in range(500))
    batches = pa.Table.from_pydict({"h": h, "i": list(range(500))}).to_batches(max_chunksize=rows)
    runs = [r.column("h").to_pylist() for r in ngram_jaccard._runs(batches)]
    assert [x for r in runs for x in r] == h
    assert len({x for r in runs for x in set(r)}) == sum(len(set(r)) for r in runs)


def test_long_columns_take_linear_time():
    batches = pa.Table.from_pydict({"h": np.zeros(2_000_000, np.int64), "n": np.full(2_000_000, 50), "pos": np.zeros(2_000_000, np.int32), "node": np.arange(2_000_000)}).to_batches(max_chunksize=1000)
    began = time.time()
    assert sum(b.num_rows for b in ngram_jaccard._star(batches)) >= 1_999_999
    assert time.time() - began < 30


# ---- 7 language


def test_language(spark):
    rnd = random.Random(6)
    stems = {"aa": "ka lo mi pu ne".split(), "bb": "sch ung heit ber ver".split(), "cc": "ción ado que llar ez".split()}
    say = lambda k, n: " ".join("".join(rnd.choice(stems[k]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    rows = [(i, say(k := rnd.choice("abc") * 2, rnd.randrange(3, 40)), k) for i in range(400)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !", "cc"), (1003, say("aa", 20000), "aa"), (1004, say("bb", 9), None), (None, say("cc", 9), "cc")]
    df = spark.createDataFrame([(i, t, k, "x") for i, t, k in rows], "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(df, per_language=80)
    out = langid.identify(df, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: r.lang_pred for r in out if r.doc_id in (1000, 1001, 1002)} == dict.fromkeys((1000, 1001, 1002), "und")
    real = [r for r in out if r.text and r.lang and r.doc_id != 1002]
    assert np.mean([r.lang_pred == r.lang for r in real]) > 0.97
    kept = {r.doc_id for r in langid.keep_identified(df).collect()}
    assert not kept & {1000, 1001, 1002} and len(kept) >= 0.98 * 403
    nothing = df.where("false")
    assert langid.identify(df.limit(3), langid.fit(nothing)).select("lang_pred").distinct().collect()[0][0] == "und"


# ---- 8 WARC


def gzip_tree(path):
    return path.removeprefix("file://")


def test_warc_round_trip(spark, tmp_path):
    body = ["<p>é</p>", "<p>é</p>", "", None, "x\r\n\r\ny" * 300, "<p>é</p>", "WARC/1.1\r\n", "x\r\n\r\ny" * 300]
    rows = [(i, f"http://h.example/{i}" if i != 4 else None, h) for i, h in enumerate(body)] + [(20, "http://a\r\nWARC-Type: evil", "z"), (None, "http://n", "null id"), (5, "http://again", "<p>é</p>")]
    pages = spark.createDataFrame([r + ("c",) for r in rows], "page_id long, url string, html string, payload string")
    path, own = str(tmp_path / "mono"), tmp_path / "own"
    warc.write_archives(pages, path)
    index = common.materialise(warc.normalise(spark, path, f"file://{own}"), "index")
    out = warc.read_archives(index, str(own)).collect()
    top = collections.defaultdict(int)
    for i, _, h in rows:
        if i is not None:
            top[h or ""] = max(top[h or ""], i)
    want = sorted((str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i is None or top[h or ""] == i else "revisit", None if i is None or top[h or ""] == i else top[h or ""]) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert {bytes(r.payload).decode() for r in out if r.record_type == "response"} == {h or "" for *_, h in rows}
    for entry in index.collect():  # one record alone, by its offset
        with open(own / entry.archive, "rb") as f:
            f.seek(entry.offset)
            one = gzip.decompress(f.read(entry.length))
        assert one.startswith(b"WARC/1.1\r\n") and entry.record_id.encode() in one and one.endswith(b"\r\n\r\n")
    assert not [f for f in own.iterdir() if f.suffix != ".gz" and not f.name.endswith(".crc")]
    again = warc.read_archives(common.materialise(warc.normalise(spark, str(own), str(tmp_path / "own2")), "index"), str(tmp_path / "own2")).collect()  # many members are read as well
    assert sorted(map(str, again)) == sorted(map(str, out))
    least = str(tmp_path / "least")
    warc.write_archives(pages, least, least_bytes=100)
    found = common.materialise(warc.normalise(spark, least, str(tmp_path / "own3")), "index")
    assert sum(r.record_type == "revisit" for r in warc.read_archives(found, str(tmp_path / "own3")).collect()) == 1


def test_warc_of_large_payloads_and_of_none(spark, tmp_path):
    """Payloads beyond one piece, with the mark between records in them and at their ends; then a table without rows."""
    rnd = random.Random(6)
    body = [" ".join(words(rnd, 60_000)) + end for end in ("", "\r\n", "\r\n\r\n", "\r\n\r\n\r\n")] + [f"{i}" * 300 for i in range(3000)]
    pages = spark.createDataFrame([(i, None, h) for i, h in enumerate(body)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "a"), records_per_file=2500)
    index = common.materialise(warc.normalise(spark, str(tmp_path / "a"), str(tmp_path / "b")), "index")
    out = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(index, str(tmp_path / "b")).collect()}
    assert out == dict(enumerate(body))
    warc.write_archives(pages.limit(0), str(tmp_path / "c"))
    none = common.materialise(warc.normalise(spark, str(tmp_path / "c"), str(tmp_path / "d")), "index")
    assert warc.read_archives(none, str(tmp_path / "d")).count() == 0


def test_damaged_archive(spark, tmp_path):
    good = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "two.warc.gz").write_bytes(good + good)
    assert warc.normalise(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "cut.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 30\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(Exception, match="ends within a record"):
        warc.normalise(spark, str(tmp_path / "bad"), str(tmp_path / "out")).collect()


# ---- 9 BPE


@pytest.fixture(scope="module")
def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Vocabulary(path)
    return path, own, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_equals_the_library(tokenizer):
    _, own, library = tokenizer
    rnd = random.Random(9)
    signs = ["'", "s", "t", "re", "ve", "ll", "m", "d", "r", "e", "l", " ", "  ", "\n", "\t", "a", "1", "!", "é", "中", " ", "　", "²", "\0", "\x1c", "😀", "'S", "​", "<|endoftext|>"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(40))) for _ in range(4000)] + ["", "a" * 5000, " " * 3000, "ab" * 40, "x" * 33]
    assert list(own.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_every_code_point_has_the_librarys_class():
    """A pattern of one class finds a code point only if the library counts it among that class."""
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    text = "".join(map(chr, points))
    own = bpe.classes()[points]
    for pattern, kinds in ((r"\p{L}", [bpe.LETTER]), (r"\p{N}", [bpe.NUMBER]), (r"\s", [bpe.SPACE, bpe.WHITE])):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        found = set(bytes(probe.encode_ordinary(text)).decode())  # the bytes of what is found
        assert [hex(c) for c, known in zip(points, np.isin(own, kinds)) if (chr(c) in found) != known] == []


def test_every_code_point_is_encoded_as_by_the_library(tokenizer):
    _, own, library = tokenizer
    around = [f"a{chr(c)}a {chr(c)}1{chr(c)};" for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(around[a : a + 128]) for a in range(0, len(around), 128)]
    assert list(own.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_bpe_query_columns(spark, tokenizer):
    path, own, library = tokenizer
    rows = [(1, "Hello world's  end\n"), (2, None), (3, ""), (3, "é" * 100), (None, "x")]
    tokens = bpe.encode(documents(spark, rows, ("clash",)).select("doc_id", "text", F.col("score").alias("ids")), path)
    for r in tokens.collect():
        parts = [own.tokens[i] for i in r.ids]
        assert r.offsets == [sum(map(len, parts[:k])) for k in range(len(parts))]
    out = bpe.decode(tokens, path).collect()
    wrong = tokens.withColumn("offsets", F.transform("offsets", lambda x: x + 1))
    with pytest.raises(Exception, match="offsets do not fit"):
        bpe.decode(wrong, path).collect()
    for (i, text), r in zip(rows, out):
        ids = library.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens, bytes(r.decoded).decode(), r.ids_sha256) == (i, len(ids), text or "", hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert bpe.encode(documents(spark, []).select("doc_id", "text"), path).count() == 0


# ---- 10 toxicity


def test_folding():
    texts = ["Idiot, 1d10t!! ІDIОT i​diot­ 2024 a5", "", "x\ny", "$$$ lo$er $5", "ｉｄｉｏｔ"]
    assert toxicity.fold(texts) == [" idiot idiot idiot idiot 2024 as ", " ", " x y ", " loser 5 ", " idiot "]
    # Letters of no Latin look, and numbers, are told apart; marks on Latin letters go, however they are written.
    other = toxicity.fold(["жизнь время", "中文字 中文母", "2023 2024 5$5", "café cafe\u0301 i\u0336d\u0336iot", "한국 한글", "हिंदी हिंदु"])
    assert all(len(set(t.split())) == n for t, n in zip(other, (2, 2, 3, 2, 2, 2)))
    assert other[3] == " cafe cafe idiot " and other[2] == " 2023 2024 5 5 "


def test_exception_phrases_are_found_in_time():
    """Many matches among many excuses, against every pair of them."""
    model = toxicity.Model({"bad": 1.0}, ("bad dog", "very bad"))
    rnd = random.Random(3)
    tokens = [rnd.choice(["bad", "dog", "very", "x"]) for _ in range(60_000)]
    free = sum(w == "bad" and not (tokens[i + 1 : i + 2] == ["dog"] or (i and tokens[i - 1] == "very")) for i, w in enumerate(tokens))
    began = time.time()
    assert model.features(toxicity.fold([" ".join(tokens)])[0])[0] == pytest.approx(np.log1p(free))
    assert time.time() - began < 5


def test_toxicity(spark):
    rnd = random.Random(5)
    bad = ["grumf", "blorp", "zazzle"]
    rows, labels = [], []
    for i in range(1500):
        toxic = rnd.random() < 0.3
        body = words(rnd, rnd.randrange(5, 60), 300)
        for _ in range(rnd.randrange(1, 4) * toxic):
            body.insert(rnd.randrange(len(body)), rnd.choice(bad))
        if not toxic and i % 4 == 0:
            body += ["grumf", "sauce"]
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "gruмf " + "GRUMF, bl0rp!"), (5003, "the grumf sauce tastes fine"), (5004, "w1 " * 50_000 + "x")]
    labels += [(1, None, None), (None, 1, 1), (7, 1, labels[7][2])]
    docs, lab = documents(spark, rows, ("clash",)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    assert set(bad) <= set(model.lexicon) and "grumf sauce" in model.exceptions
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    held = [i for i, *_ in labels[:1500] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i].predicted == labels[i][2] for i in held]) > 0.97
    assert [out[i].predicted for i in (5000, 5001, 5002, 5003, 5004)] == [0, 0, 1, 0, 0]
    kept = {r.doc_id for r in toxicity.keep_civil(docs, lab).collect()}
    assert kept == {i for i, r in out.items() if not r.predicted}
    bare = toxicity.fit(docs, lab.limit(0))
    assert toxicity.score(documents(spark, [(1, "you idiot"), (2, "fine")]), bare).orderBy("doc_id").select("score").collect()[0][0] > 0.1
    assert toxicity.score(docs.limit(0), model).count() == 0


# ---- storage


def test_materialise_and_discard(spark):
    df = common.materialise(spark.range(10), "x")
    assert df.count() == 10
    path = df._scratch
    common.discard(df)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()
    assert pd.DataFrame(spark.range(0).collect()).empty and pa.__version__ and json
