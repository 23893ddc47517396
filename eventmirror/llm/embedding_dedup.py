"""Embedding near-duplicates: a robust-pruned flat graph over overlapping cluster shards.

0. Rows of one label and one vector are one row with a weight; all its copies get the same links at the end.
1. Tight cells. Vectors within half the link angle of a leader are linked with each other by the
   triangle inequality, so a cell of near copies is one node and its pairs need no work at all.
2. Leaders go to their nearest clusters (several: shards overlap); a shard is dealt to parts of PART_ROWS by a hash. Each
   part builds a robust-pruned graph, in which leaders of one direction are one node and a ring; the adjacency
   lists of a leader are united over its shards.
3. Every leader searches the graphs of all parts of its shards: greedily from the medoid (and its own list), then on
   through everything within range. So all leaders of a shard meet, whatever its size, and no task holds more than two
   parts. A pair of shards' common leaders is reported by the first of those shards. United lists also lead out of a
   shard: what lies one step outside from a leader in range is compared as well. What is sure to be linked leaves a task
   as counts and as links to one leader of each group, not as pairs.
4. Pairs that the cells' radii leave open are verified vector by vector, in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialise

COSINE = 0.93
SHARD_ROWS, OVERLAP = 1000, 2
#: Leaders of a shard's part at most, but for the skew of a hash. This bounds a task's memory; all parts of a shard search each other.
PART_ROWS = 6000
DEGREE, POOL, BEAM = 16, 48, 24
#: The search goes on through leaders so many times as far as those it reports.
THROUGH = 1.08
#: Doubles that a task gathers at once.
GATHER = 4 << 20
#: Vectors that the cluster centres are fitted on at most; there is a centre for each four of them at most.
SAMPLE = 20_000
MEMBERS = 250
SLACK = 1e-9
#: Leaders of this cosine are one node of the graph: rounding leaves their distances without an order.
SAME = 1 - 1e-12
#: What a task says of two cells or one.
OUTSIDE, OPEN, SURE, COUNT, LINK = range(5)


def units(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64) if len(vectors) else np.zeros((0, 1))
    x /= np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def fit_centres(x: np.ndarray, k: int, apart: float = 0.0, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Spherical k-means. Of centres within `apart` of each other the first stays: several centres inside one
    group of near copies would deal its links to shards that do not meet."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.maximum(norm, 1e-300), centres)
    if apart:
        own: list[int] = []
        for i, c in enumerate(centres):
            if not own or (centres[own] @ c).max() < np.cos(apart):
                own.append(i)
        centres = centres[own]
    return centres


def nearest(vectors, centres: dict[int, np.ndarray], k: int) -> list[list[int]]:
    """The k nearest centres of each vector, nearest first; [0] for lengths that no centre has."""
    out: list[list[int]] = [[0]] * len(vectors)
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    for d in np.unique(lengths).tolist():
        if d in centres:
            at = np.flatnonzero(lengths == d)
            near = np.argsort(-(units([vectors[i] for i in at]) @ centres[d].T), axis=1, kind="stable")[:, :k]
            for i, row in zip(at.tolist(), near.tolist()):
                out[i] = row
    return out


def cells_of(block: pd.DataFrame, radius: float) -> pd.DataFrame:
    """Greedy leaders in vec_id order: each takes the free vectors within the radius. A cell's size counts copies."""
    block = block.sort_values(["vec_id", "k1", "k2"], kind="stable").reset_index(drop=True)
    x = units(block.embedding)
    n = len(x)
    cell, reach = np.full(n, -1), np.zeros(n)
    for i in range(n):
        if cell[i] < 0:
            free = np.flatnonzero(cell < 0)
            far = angle(x[free] @ x[i])
            far[free == i] = 0
            took = free[far <= radius]
            cell[took] = i
            reach[i] = far[far <= radius].max()
    sizes, members = np.zeros(n, np.int64), np.bincount(cell, minlength=n)
    np.add.at(sizes, cell, block.copies.to_numpy())
    first = block.iloc[0]
    name = f"{first.label}/{first.dim}/{first.shard}/{first.block}/"
    return pd.DataFrame(
        {
            "vec_id": block.vec_id, "label": block.label, "dim": block.dim, "embedding": block.embedding,
            "k1": block.k1, "k2": block.k2, "copies": block.copies, "cell": [f"{name}{c}" for c in cell], "cell_id": block.vec_id.to_numpy()[cell],
            "leads": cell == np.arange(n), "radius": reach[cell], "size": sizes[cell], "members": members[cell],
        }
    )


def dots(x: np.ndarray, at: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosines of the rows x[at[i, k]] with y[i]."""
    return np.einsum("mkd,md->mk", x[at], y)


def prune(x: np.ndarray, pool: np.ndarray, degree: int = DEGREE, alpha: float = 1.2) -> np.ndarray:
    """Robust pruning of every node's candidates (-1: none), many nodes at once: take the nearest, drop
    those that are alpha times nearer to it than to the node, and so on."""
    out = np.full((len(pool), degree), -1)
    chunk = max(1, GATHER // (pool.shape[1] * x.shape[1]))
    for a in range(0, len(pool), chunk):
        part = pool[a : a + chunk]
        rows = np.arange(len(part))
        there = x[np.maximum(part, 0)]
        far = np.where(part >= 0, angle(np.einsum("mkd,md->mk", there, x[a : a + chunk])), np.inf)
        for k in range(degree):
            best = far.argmin(1)
            live = np.isfinite(far[rows, best])
            if not live.any():
                break
            out[a : a + chunk, k] = np.where(live, part[rows, best], -1)
            between = angle(np.einsum("mkd,md->mk", there, there[rows, best]))
            far = np.where(live[:, None] & (alpha * between <= far), np.inf, far)
            far[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Adjacency lists: the nearest rows and a few random ones, pruned; then with reverse edges, pruned again."""
    n = len(x)
    k = min(POOL, n - 1)
    if k <= 0:
        return np.full((n, DEGREE), -1)
    pool = np.empty((n, k), int)
    chunk = max(1, GATHER // n)
    for a in range(0, n, chunk):
        near = x[a : a + chunk] @ x.T
        near[np.arange(len(near)), np.arange(a, a + len(near))] = -np.inf
        pool[a : a + chunk] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    some = np.random.default_rng(seed).integers(0, n, (n, 16))
    out = prune(x, np.hstack([pool, np.where(some == np.arange(n)[:, None], -1, some)]))
    source, slot = np.nonzero(out >= 0)
    target = out[source, slot]
    order = np.argsort(target, kind="stable")
    back = np.full((n, 2 * DEGREE), -1)
    place = np.arange(len(order)) - np.searchsorted(target[order], target[order])
    keep = place < 2 * DEGREE
    back[target[order][keep], place[keep]] = source[order][keep]
    return prune(x, np.hstack([out, back]))


def tied_graph(x: np.ndarray) -> np.ndarray:
    """build_graph() over one row of each direction. Rows of one direction are a ring in the last column, so a
    search that finds one of them finds all; pruning would keep a single one of them."""
    chunk = max(1, GATHER // len(x))
    first = np.concatenate([(x[a : a + chunk] @ x.T >= SAME).argmax(1) for a in range(0, len(x), chunk)])
    while (first[first] != first).any():
        first = first[first]
    own = np.unique(first)
    out = np.full((len(x), DEGREE + 1), -1)
    inner = build_graph(x[own])
    out[own, :DEGREE] = np.where(inner >= 0, own[inner], -1)
    order = np.argsort(first, kind="stable")
    starts = np.searchsorted(first[order], first[order])
    last = np.append(first[order][1:] != first[order][:-1], True)
    follower = order[np.where(last, starts, np.minimum(np.arange(len(x)) + 1, len(x) - 1))]
    out[order, DEGREE] = np.where(follower == order, -1, follower)
    return out


def adjacency(names, lists) -> np.ndarray:
    """The lists as places within `names` (-1: none); what is not there is left out."""
    at = {c: i for i, c in enumerate(names)}
    rows = [[at[c] for c in row if c in at] for row in lists]
    width = max(1, max(map(len, rows)))
    return np.array([o + [-1] * (width - len(o)) for o in rows])


def search(x: np.ndarray, graph: np.ndarray, radii: np.ndarray, asked: np.ndarray, asked_radii: np.ndarray, theta: float, own: bool) -> np.ndarray:
    """Which rows of x each asked vector finds within theta and both radii, as a matrix. If the asked vectors are the `own` rows of
    the graph, they start at their own lists too, and a pair that either of its rows finds is found."""
    n, width, widest = len(x), graph.shape[1], radii.max()
    medoid = int((x @ x.mean(0)).argmax())
    out = np.zeros((len(asked), n), bool)
    chunk = max(1, min(512, GATHER // (width * x.shape[1]), (16 << 20) // n))
    for a in range(0, len(asked), chunk):
        q = asked[a : a + chunk]
        m = len(q)
        row = np.arange(m)
        beam = np.full((m, BEAM), -1)
        beam[:, 0] = medoid
        if own:
            lists = graph[a : a + m, : BEAM - 1]
            beam[:, 1 : 1 + lists.shape[1]] = lists
            beam[:, 1:][beam[:, 1:] == medoid] = -1
        seen = np.zeros((m, n + 1), bool)  # the last column stands for no row
        seen[row[:, None], beam] = True
        cos = np.where(beam >= 0, dots(x, beam, q), -np.inf)
        done = beam < 0
        live = row
        while len(live):
            pick = np.where(done[live], -np.inf, cos[live]).argmax(1)
            done[live, pick] = True
            more = graph[beam[live, pick]]
            more = np.where(seen[live[:, None], more], -1, more)
            seen[live[:, None], more] = True
            value = np.where(more >= 0, dots(x, more, q[live]), -np.inf)
            next_, far, over = (np.hstack([o[live], f]) for o, f in ((beam, more), (cos, value), (done, more < 0)))
            top = np.argpartition(-far, BEAM - 1, axis=1)[:, :BEAM]
            beam[live], cos[live] = np.take_along_axis(next_, top, 1), np.take_along_axis(far, top, 1)
            done[live] = np.take_along_axis(over, top, 1) | ~np.isfinite(cos[live])
            live = live[~done[live].all(1)]
        # On through everything within range, all asked vectors of the chunk at once.
        reach = theta + asked_radii[a : a + m]
        seen[:] = False
        seen[:, n] = True
        seen[row[:, None], beam] = True
        at, node = np.nonzero(beam >= 0)
        node, far = beam[at, node], angle(cos[at, node])
        step = max(1, GATHER // x.shape[1])
        while len(at):
            hit = far <= reach[at] + radii[node] + SLACK
            out[a + at[hit], node[hit]] = True
            go = far <= THROUGH * (reach[at] + widest) + SLACK
            at, node = at[go], node[go]
            fresh_at, fresh = [], []
            for b in range(0, len(at), step):
                key = (at[b : b + step, None] * (n + 1) + np.where(graph[node[b : b + step]] < 0, n, graph[node[b : b + step]])).ravel()
                key = np.unique(key[~seen.ravel()[key]])
                seen.ravel()[key] = True
                fresh_at.append(key // (n + 1))
                fresh.append(key % (n + 1))
            at, node = (np.concatenate(f) if f else np.zeros(0, int) for f in (fresh_at, fresh))
            far = np.concatenate([angle(np.einsum("kd,kd->k", x[node[b : b + step]], q[at[b : b + step]])) for b in range(0, len(at), step)]) if len(at) else np.zeros(0)
    if own:
        out |= out.T
        np.fill_diagonal(out, False)
    return out


def stars(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between ids, one for each member of each connected group but one, that connect what the matrix connects."""
    out = []
    todo, open_ = linked.any(1), linked.any(0)
    for i in np.flatnonzero(todo):
        if todo[i]:
            front = np.array([i])
            todo[i] = False
            while len(front):
                columns = np.flatnonzero(linked[front].any(0) & open_)
                open_[columns] = False
                out += [(int(left[i]), int(right[j])) for j in columns if left[i] != right[j]]
                front = np.flatnonzero(linked[:, columns].any(1) & todo) if len(columns) else columns
                todo[front] = False
                out += [(int(left[i]), int(left[j])) for j in front if left[i] != left[j]]
    return out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Rows link if their labels are equal and not null, their vectors have one length and their cosine is
    `cosine` at least. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows of a null vec_id; rows that share a vec_id are vectors of their own in one
    component. Extra columns are ignored; an empty table gives an empty one.
    """
    theta = float(np.arccos(cosine))
    radius = theta / 2 - SLACK
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    good = F.coalesce(good, F.lit(False))
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where(good).withColumn("dim", F.size("embedding"))

    keyed = rows.withColumns({k: F.xxhash64(F.lit(k), "label", "embedding") for k in ("k1", "k2")})
    unique = keyed.groupBy("label", "dim", "embedding").agg(F.min("vec_id").alias("vec_id"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.count(F.lit(1)).alias("copies"))
    unique = materialise(unique, "unique")
    labels = unique.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    if not labels[0]:
        return alone
    draw = F.pmod(F.xxhash64(F.lit("centres"), "vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / labels[1]))
    sample = unique.where(draw).select("embedding").toArrow().column(0).to_pylist()
    k = min(SAMPLE // 4, -(-labels[0] // SHARD_ROWS))
    centres = {d: fit_centres(units([v for v in sample if len(v) == d]), k, radius) for d in {len(v) for v in sample}}

    def place(batches):
        for pdf in batches:
            yield pdf.assign(shard=[x[0] for x in nearest(list(pdf.embedding), centres, 1)])

    row = "label long, dim int, embedding array<double>, vec_id long, k1 long, k2 long, copies long"
    placed = materialise(unique.mapInPandas(place, f"{row}, shard int"), "placed")
    discard(unique)
    sizes = placed.groupBy("label", "dim", "shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).alias("blocks"))
    blocks = placed.join(sizes, ["label", "dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "k1"), F.col("blocks")).cast("int")).drop("blocks")
    cell_schema = "vec_id long, label long, dim int, embedding array<double>, k1 long, k2 long, copies long, cell string, cell_id long, leads boolean, radius double, size long, members long"
    members = materialise(blocks.groupBy("label", "dim", "shard", "block").applyInPandas(lambda b: cells_of(b, radius), cell_schema), "members")
    discard(placed)

    def near(batches):
        for pdf in batches:
            yield pdf.assign(near=nearest(list(pdf.embedding), centres, OVERLAP + 2))

    leader = "cell string, cell_id long, label long, dim int, embedding array<double>, radius double, size long, members long"
    leaders = materialise(members.where("leads").select("cell", "cell_id", "label", "dim", "embedding", "radius", "size", "members").mapInPandas(near, f"{leader}, near array<int>"), "leaders")
    homed = materialise(leaders.withColumn("homes", F.sort_array(F.slice("near", 1, OVERLAP))).drop("near"), "homed")
    discard(leaders)
    dealt = homed.withColumn("shard", F.explode("homes"))
    by = ["label", "dim", "shard"]
    counts = dealt.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
    shards = dealt.join(counts, by).withColumn("part", F.pmod(F.xxhash64("cell"), F.col("parts")).cast("int"))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cell").reset_index(drop=True)
        names = part.cell.to_numpy()
        return pd.DataFrame({"cell": names, "next": [names[g[g >= 0]].tolist() for g in tied_graph(units(part.embedding))]})

    lists = shards.groupBy(*by, "part").applyInPandas(build, "cell string, next array<string>")
    graph = lists.groupBy("cell").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))  # OVERLAP * (DEGREE + 1) names at most

    def find(task: pd.DataFrame) -> pd.DataFrame:
        here, low, high = task["shard"].iloc[0], task.low.iloc[0], task.high.iloc[0]
        task = task.sort_values("cell").reset_index(drop=True)
        p, q = (task[task.part == k].reset_index(drop=True) for k in (low, high))
        if not len(p) or not len(q):
            return pd.DataFrame(columns=found_columns)
        x, y = units(p.embedding), units(q.embedding)
        rp, rq = p.radius.to_numpy(), q.radius.to_numpy()
        hits = search(x, adjacency(p.cell, p.next), rp, y, rq, theta, low == high)
        if low != high:  # each part asks the other
            hits |= search(y, adjacency(q.cell, q.next), rq, x, rp, theta, False).T
        present = set(task.cell)
        away = [[c for c in row if c not in present] for row in p.next]
        out = []
        if any(away):
            for i, name in enumerate(q.cell):
                near_by = {c for j in np.flatnonzero(hits[i]) for c in away[j]} | (set(away[i]) if low == high else set())
                out += [(min(name, c), max(name, c), 0, 0, 0, 0, 0, 0, OUTSIDE) for c in near_by]
        if low == high:
            hits = np.triu(hits)
        # Pairs that another shard reports go; both have this one in common.
        homes_p, homes_q = (np.array([sorted(h) + [here] * (OVERLAP - len(h)) for h in side.homes], np.int64) for side in (p, q))
        sure_at = np.zeros_like(hits)
        facts_p, facts_q = (list(side[["cell", "cell_id", "size", "members"]].itertuples(index=False, name=None)) for side in (p, q))
        step = max(1, GATHER // (x.shape[1] * len(x)))
        for a in range(0, len(q), step):
            i, j = np.nonzero(hits[a : a + step])
            i += a
            common = np.full(len(i), here)
            for h in range(OVERLAP):
                mine = homes_q[i, h]
                common = np.where((homes_p[j] == mine[:, None]).any(1), np.minimum(common, mine), common)
            i, j = i[common == here], j[common == here]
            cos = np.einsum("kd,kd->k", y[i], x[j])
            t, both = angle(cos), rq[i] + rp[j]
            sure = np.where(both == 0, cos >= cosine, t <= theta - both - SLACK)
            sure_at[i[sure], j[sure]] = True
            for k in np.flatnonzero(~sure & (both > 0)):
                u, v = sorted((facts_q[i[k]], facts_p[j[k]]))
                out.append((*(value for two in zip(u, v) for value in two), OPEN))
        for side, n in ((q, sure_at @ p["size"].to_numpy()), (p, q["size"].to_numpy() @ sure_at)):
            out += [(side.cell[k], None, 0, 0, int(n[k]), 0, 0, 0, COUNT) for k in np.flatnonzero(n)]
        out += [(None, None, a, b, 0, 0, 0, 0, LINK) for a, b in stars(sure_at, q.cell_id.to_numpy(), p.cell_id.to_numpy())]
        return pd.DataFrame(out, columns=found_columns)

    # One row: a pair of cells that is outside, open or sure; how many vectors a cell is linked with for sure; or a link of ids.
    pair = "a string, b string, ida long, idb long, sa long, sb long, ma long, mb long"
    found_columns = ["a", "b", "ida", "idb", "sa", "sb", "ma", "mb", "kind"]
    asked = shards.join(graph, "cell").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    met = materialise(asked.groupBy(*by, "low", "high").applyInPandas(find, f"{pair}, kind int"), "met")

    def outside(batches):
        for pdf in batches:
            cos = (units(pdf.xa) * units(pdf.xb)).sum(1)
            t, both = angle(cos), (pdf.ra + pdf.rb).to_numpy()
            sure = np.where(both == 0, cos >= cosine, t <= theta - both - SLACK)
            keep = (t <= theta + both + SLACK) & (sure | (both > 0))
            yield pdf.assign(kind=np.where(sure, SURE, OPEN)).loc[keep, found_columns]

    end = lambda c: homed.select(F.col("cell").alias(c), F.col("cell_id").alias(f"id{c}"), F.col("size").alias(f"s{c}"), F.col("members").alias(f"m{c}"), F.col("embedding").alias(f"x{c}"), F.col("radius").alias(f"r{c}"), F.col("homes").alias(f"h{c}"))
    beyond = met.where(F.col("kind") == OUTSIDE).select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b").where(~F.arrays_overlap("ha", "hb")).drop("ha", "hb")
    pairs = materialise(met.where(F.col("kind") != OUTSIDE).unionByName(beyond.mapInPandas(outside, f"{pair}, kind int")), "pairs")
    discard(met, homed)

    # What the radii leave open: members against members, in blocks of MEMBERS rows by MEMBERS rows.
    part = lambda n: F.sequence(F.lit(0), F.ceil(F.col(n) / MEMBERS).cast("int") - 1)
    open_ = pairs.where(F.col("kind") == OPEN).withColumn("pa", F.explode(part("ma"))).withColumn("pb", F.explode(part("mb")))
    parts = members.select("cell", "k1", "k2", "copies", "embedding", F.pmod(F.xxhash64("vec_id", "k1"), F.ceil(F.col("members") / MEMBERS)).cast("int").alias("p"))
    side = lambda cell, p, left: open_.join(parts.withColumnsRenamed({"cell": cell, "p": p}), [cell, p]).select("a", "b", "ida", "idb", "pa", "pb", F.lit(left).alias("left"), "k1", "k2", "copies", "embedding")

    def verify(block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block.left], block[~block.left]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["cell", "ida", "idb", "k1", "k2", "n"])
        hit = units(left.embedding) @ units(right.embedding).T >= cosine
        out = [
            pd.DataFrame({"cell": cell, "k1": own.k1.to_numpy(), "k2": own.k2.to_numpy(), "n": n})
            for cell, own, n in ((block.a.iloc[0], left, hit @ right.copies.to_numpy()), (block.b.iloc[0], right, left.copies.to_numpy() @ hit))
        ]
        out = pd.concat(out)
        out = out[out.n > 0]
        return out.assign(ida=block.ida.iloc[0], idb=block.idb.iloc[0])[["cell", "ida", "idb", "k1", "k2", "n"]]

    verified = materialise(
        side("a", "pa", True).unionByName(side("b", "pb", False)).groupBy("a", "b", "pa", "pb").applyInPandas(verify, "cell string, ida long, idb long, k1 long, k2 long, n long"), "verified"
    )
    sure = pairs.where(F.col("kind") == SURE)
    links = pairs.where(F.col("kind").isin(SURE, LINK)).select(F.col("ida").alias("a"), F.col("idb").alias("b")).union(verified.select("ida", "idb").distinct())
    counted = pairs.where(F.col("kind") == COUNT).select(F.col("a").alias("cell"), F.col("sa").alias("n"))
    outer = counted.union(sure.select("a", "sb")).union(sure.select("b", "sa")).groupBy("cell").agg(F.sum("n").alias("outer"))
    exact = verified.groupBy("cell", "k1", "k2").agg(F.sum("n").alias("exact"))
    result = members.join(outer, "cell", "left").join(exact, ["cell", "k1", "k2"], "left")
    if links.isEmpty():
        result = result.withColumn("component", F.col("cell_id"))
    else:
        result = result.join(connected_components(links).withColumnRenamed("id", "cell_id"), "cell_id", "left")
    n = (F.col("size") - 1 + F.coalesce("outer", F.lit(0)) + F.coalesce("exact", F.lit(0))).cast("long")
    found = result.select("vec_id", "k1", "k2", "copies", n.alias("n_links"), F.coalesce("component", "cell_id").alias("component_id"))
    found = materialise(found, "found")
    discard(members, pairs, verified)
    again = keyed.select("vec_id", "k1", "k2").join(found.where("copies > 1").select("k1", "k2", "n_links", "component_id"), ["k1", "k2"])
    out = found.where("copies = 1").select("vec_id", "n_links", "component_id").unionByName(again.select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id")).unionByName(alone)


def audit_recall(vectors: DataFrame, found: DataFrame, cosine: float = COSINE, every: int = 100, rows: int = 2000) -> DataFrame:
    """links, found and recall over a stated query set (vec_id divisible by `every`) held against all rows of equal label and
    length by brute force, block against block of `rows` rows, each pair of blocks in a task of its own."""
    good = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select("vec_id", F.col("label").cast("long").alias("label"), F.size("embedding").alias("dim"), "embedding")
    asked = F.pmod("vec_id", F.lit(every)) == 0
    sizes = good.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("nr"), F.ceil(F.count_if(asked) / rows).cast("int").alias("nq")).where("nq > 0")
    known = good.join(sizes, ["label", "dim"])
    block = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.col(n)).cast("int")
    every_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = lambda df, q, r, asks: df.withColumn("q", q).withColumn("r", r).select("label", "dim", "q", "r", "vec_id", "embedding", F.lit(asks).alias("asks"))
    both = side(known.where(asked), block("nq"), every_("nr"), True).unionByName(side(known, every_("nq"), block("nr"), False))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        q, x = pdf[pdf.asks], pdf[~pdf.asks]
        if not len(q) or not len(x):
            return pd.DataFrame(columns=["vec_id", "links"])
        with np.errstate(all="ignore"):
            hit = units(q.embedding) @ units(x.embedding).T >= cosine
        return pd.DataFrame({"vec_id": q.vec_id.to_numpy(), "links": (hit & (q.vec_id.to_numpy()[:, None] != x.vec_id.to_numpy()[None, :])).sum(1)})

    truth = both.groupBy("label", "dim", "q", "r").applyInPandas(count, "vec_id long, links long").groupBy("vec_id").agg(F.sum("links").alias("links"))
    matched = truth.join(found.select("vec_id", "n_links"), "vec_id")
    least = F.sum(F.least("links", "n_links"))
    return matched.agg(F.sum("links").alias("links"), least.alias("found"), F.coalesce(F.try_divide(least, F.sum("links")), F.lit(1.0)).alias("recall"))
