"""HTML extraction by wrapper induction.

Pages of one host are aligned with a reference page as trees, by simple tree matching. A node that holds the same text
on nearly all of them is template; what varies is a slot. The deepest node that holds most of the varying
text is the article: slots within it are content, slots elsewhere and lists of links are not. Tags that are never
an article (menus, forms, scripts) are left out before. Within the content's root, slots with a telling word in class, id or role go
if there are slots without.
"""

from __future__ import annotations

import collections
import hashlib
import html as entities
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, slices

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Containers that are never the article.
LEFT_OUT = set("head nav footer aside form script style noscript template iframe svg math button select option textarea menu dialog object canvas audio video map input title fieldset".split())
#: Whole words of a class, id or role that say so too; parts of a hyphenated word do not, nor those of the elements in WHOLE.
LEFT_OUT_WORDS = set(
    "ad ads advert advertisement advertising sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead "
    "comment comments reply replies disqus respond cookie cookies consent notice notices popup modal overlay newsletter subscribe signup share sharing "
    "social related recommended widget login search toolbar pagination pager hidden contentinfo complementary".split()
)
#: Of these, those that an article's own container may bear too: where all else of a page is template, what varies in such elements is content.
WEAK_WORDS = set("banner sidebar notice notices modal overlay popup widget social related recommended search share sharing subscribe signup newsletter respond toolbar".split())
WHOLE = {"html", "body", "main", "article"}
ENDS_OWN_PAIRS = {"dt": ("dd",), "dd": ("dt",), "td": ("th",), "th": ("td",)}
#: A start tag of these ends an open paragraph; those of ENDS_OWN end an open element of their own kind.
ENDS_P = set("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_OWN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PAGES_PER_BLOCK = 64
#: A node is template if this part of the pages that have it, and so many pages, hold the same text in it.
CONSTANT, LEAST_PAGES = 0.9, 8
#: A single text within a slot is template if this part of the pages holds it there.
EVERYWHERE = 0.98
#: The content's root is the deepest node that holds this part of all varying text; slots of which links are so much are menus.
MASS, LINKS = 0.8, 0.5
#: Elements below this depth belong to their ancestor there.
DEPTH = 100
#: Shapes and their matchings that a wrapper remembers between pages; this bounds memory and changes no result.
SHAPES = 20_000
SALTS = 16
#: Wrappers are given to all tasks at once if they have so many bytes, as counted, and else by a salted join.
BROADCAST_BYTES = 16 << 20
BLOCK = "struct<path: string, main: boolean, state: int, link: int, digest: bigint, text: string>"
ENTRIES = "array<struct<path: string, state: int, chars: int, link: int, digests: array<bigint>>>"
#: What a block's tags and words say of it: never an article, words of no article, words that a part of an article may bear, nothing.
OUT, WORD, WEAK, KEPT = range(4)


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def blocks_of(page: str) -> list[dict]:
    """The text blocks of a page in order: path of elements with their places, whether in an article or
    main element, state (OUT, WORD, WEAK or KEPT), characters within links, digest, text."""
    out: list[dict] = []
    # An open element: tag, path, in main, state, number of children by label.
    stack: list[list] = [["", "", False, KEPT, {}]]
    open_: collections.Counter[str] = collections.Counter()
    words: list[str] = []
    linked: list[int] = []

    def flush() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            link = round(len(text) * sum(linked) / max(1, sum(map(len, words))))
            words.clear()
            linked.clear()
            if text:
                top = next(x for x in reversed(stack) if x[0] not in INLINE)
                state = min(stack[-1][3], top[3])
                out.append({"path": top[1], "main": top[2], "state": state, "link": link, "digest": digest(text), "text": text})

    def put(piece: str) -> None:
        words.append(piece)
        if open_["a"] > 0:
            linked.append(len(piece))

    def close(at: int) -> None:
        if any(x[0] not in INLINE or x[3] != KEPT for x in stack[at:]):
            flush()
        open_.subtract(x[0] for x in stack[at:])
        del stack[at:]

    def last(*tags: str) -> int:
        """The place of the innermost open element of these tags, 0 for none."""
        if not any(open_[t] > 0 for t in tags):
            return 0
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in tags), 0)

    pos, raw_end = 0, None
    while True:
        m = TAG.search(page, pos)
        if m is None:
            put(page[pos:])
            break
        if m.start() > pos:
            put(page[pos : m.start()])
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            at = last(tag)
            # A stray inline end tag does not close blocks around it.
            if at and not (tag in INLINE and any(x[0] not in INLINE for x in stack[at + 1 :])):
                close(at)
            elif tag in ("p", "br"):
                flush()
            continue
        if tag not in INLINE and tag not in RAW:
            flush()
        if tag in VOID:
            continue
        if tag in ENDS_P:
            at = last("p", "td", "article", "body", "li", "div") if open_["p"] > 0 else 0
            if at and stack[at][0] == "p":
                close(at)
        elif tag in ENDS_OWN and any(open_[t] > 0 for t in (tag, *ENDS_OWN_PAIRS.get(tag, ()))):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ENDS_OWN[tag]:
                    break
                if stack[i][0] == tag or {stack[i][0], tag} == {"dt", "dd"} or {stack[i][0], tag} == {"td", "th"}:
                    close(i)
                    break
        named = {k.lower(): (a or b or c or "").lower() for k, a, b, c in reversed(ATTRIBUTE.findall(m[3]))} if m[3] else {}  # the first of a name counts
        top = stack[-1]
        main = top[2] or tag in ("article", "main") or named.get("role") == "main"
        marks = set() if tag in WHOLE or named.get("role") == "main" else LEFT_OUT_WORDS.intersection(" ".join(named.get(k, "") for k in ("class", "id", "role")).split())
        kept = top[3]
        if tag in LEFT_OUT or (tag == "header" and not top[2]) or "hidden" in named or named.get("aria-hidden") == "true":
            kept = OUT
        elif marks:
            kept = min(kept, WORD if marks - WEAK_WORDS else WEAK)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if top[3] != kept:
            flush()
        label = tag + "".join(f".{c}" for c in sorted(named.get("class", "").split())[:3])
        n = top[4].get(label, 0)
        top[4][label] = n + 1
        path = top[1] if tag in INLINE or len(stack) > DEPTH else f"{top[1]}/{label}:{n}"
        if not (tag in INLINE and m[3].rstrip().endswith("/")):
            stack.append([tag, path, main, kept, {}])
            open_[tag] += 1
    flush()
    return out


def bare(path: str) -> str:
    """A path without the places of its elements."""
    return re.sub(r":[0-9]+(?=/|$)", "", path)


def entries_of(blocks: list[dict]) -> tuple[list[dict], list[int]]:
    """(entries, the entry of each block): blocks that follow each other on one path but for places are one entry, as
    the paragraphs of an article or the rows of a table are. Blocks that are OUT are left out, with the entry -1."""
    out: list[dict] = []
    own, name = [], None
    for b in blocks:
        if b["state"] == OUT:
            own.append(-1)
            continue
        here = bare(b["path"])
        if here != name:
            out.append({"path": b["path"], "state": b["state"], "chars": 0, "link": 0, "digests": []})
            name = here
        e = out[-1]
        e["state"] = min(e["state"], b["state"])
        e["chars"] += len(b["text"])
        e["link"] += b["link"]
        e["digests"].append(b["digest"])
        own.append(len(out) - 1)
    return out, own


_ENTRIES = pa.list_(pa.struct([("path", pa.string()), ("state", pa.int32()), ("chars", pa.int32()), ("link", pa.int32()), ("digests", pa.list_(pa.int64()))]))


def parse(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (digest of all entries), entries and blocks."""
    schema = f"page_id long, url string, host string, page bigint, entries {ENTRIES}, blocks array<{BLOCK}>"
    kind = pa.list_(pa.struct([("path", pa.string()), ("main", pa.bool_()), ("state", pa.int32()), ("link", pa.int32()), ("digest", pa.int64()), ("text", pa.string())]))

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(a, b - a) for a, b in slices(np.ones(len(whole)), 128)):
                urls = batch.column(1).to_pylist()
                blocks = [blocks_of(h or "") for h in batch.column(2).to_pylist()]
                entries = [entries_of(b)[0] for b in blocks]
                hosts = [(m[1].lower() if u and (m := re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u)) else "") for u in urls]
                pages = [digest(json.dumps(e)) for e in entries]  # pages of one digest have one tree
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts), pa.array(pages, pa.int64()), pa.array(entries, _ENTRIES), pa.array(blocks, kind)], names=["page_id", "url", "host", "page", "entries", "blocks"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, schema)


class Shapes:
    """Numbers for the shapes of subtrees (a label and the children's shapes) and the matching of shapes with each other.

    Pages of a host share most of their shapes, so a matching is worked out once for all pages that are aligned together.
    """

    def __init__(self):
        self.known: dict[tuple, int] = {}
        self.label: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.memo: dict[tuple[int, int], int] = {}

    def number(self, label: str, children: tuple[int, ...]) -> int:
        n = self.known.setdefault((label, children), len(self.label))
        if n == len(self.label):
            self.label.append(label)
            self.children.append(children)
            self.size.append(1 + sum(self.size[c] for c in children))
        return n

    def match(self, a: int, b: int) -> int:
        """Simple tree matching: the most pairs of nodes of equal labels that keep order and parents. Trees are DEPTH deep at most."""
        if a == b:
            return self.size[a]
        if self.label[a] != self.label[b]:
            return 0
        got = self.memo.get((a, b))
        if got is None:
            left, right, _, _ = trimmed(self.children[a], self.children[b])
            same = sum(self.size[c] for c in self.children[a]) - sum(self.size[c] for c in left)
            best = 0
            if left and right:
                for row in self.rows(left, right):
                    best = int(row[-1])
            got = self.memo[a, b] = 1 + same + best
        return got

    def weights(self, left: tuple[int, ...], right: tuple[int, ...]) -> dict[int, np.ndarray]:
        """By shape on the left, its matching with each place on the right."""
        kinds, at = np.unique(np.array(right, np.int64), return_inverse=True)
        return {x: np.array([self.match(x, int(y)) for y in kinds], np.int64)[at] for x in set(left)}

    def rows(self, left: tuple[int, ...], right: tuple[int, ...], first: np.ndarray | None = None, weights: dict | None = None):
        """The rows of the alignment's table, below `first`: the best sum for the children so far and each prefix on the right."""
        weights = self.weights(left, right) if weights is None else weights
        row = np.zeros(len(right) + 1, np.int64) if first is None else first
        for x in left:
            above, row = row, row.copy()
            np.maximum(above[1:], above[:-1] + weights[x], out=row[1:])
            np.maximum.accumulate(row, out=row)
            yield row

    def pairs(self, left: tuple[int, ...], right: tuple[int, ...]) -> list[tuple[int, int]]:
        """The places that a best alignment of two lists of children pairs.

        Only each k-th row of the table is kept, k the root of their number; the rows between are worked out again on the way
        back, so lists of any length are aligned as a whole within little memory.
        """
        n, m = len(left), len(right)
        left, right, head, tail = trimmed(left, right)
        out = [(i, i) for i in range(head)] + [(n - i, m - i) for i in range(1, tail + 1)]
        if not left or not right:
            return out
        step = int(len(left) ** 0.5) + 1
        weights = self.weights(left, right)
        kept = [np.zeros(len(right) + 1, np.int64)]
        for i, row in enumerate(self.rows(left, right, weights=weights), 1):
            if i % step == 0:
                kept.append(row)
        j = len(right)
        for block in range((len(left) - 1) // step, -1, -1):
            start = block * step
            table = [kept[block], *self.rows(left[start : start + step], right, kept[block], weights)]
            i = len(table) - 1
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j = int(np.searchsorted(table[i], table[i][j]))  # the first place of this sum: rows never fall
                else:
                    out.append((head + start + i - 1, head + j - 1))
                    i, j = i - 1, j - 1
        return out


def trimmed(left: tuple[int, ...], right: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], int, int]:
    """Both lists without the equal shapes at their heads and tails, and how many these are; some best alignment pairs them."""
    most = min(len(left), len(right))
    head = next((i for i in range(most) if left[i] != right[i]), most)
    tail = next((i for i in range(most - head) if left[-1 - i] != right[-1 - i]), most - head)
    return left[head : len(left) - tail], right[head : len(right) - tail], head, tail


class Node:
    """An element of a tree that is matched; `entry` is its own text's, `shape` its number in Shapes."""

    __slots__ = ("label", "path", "parent", "children", "entry", "shape")

    def __init__(self, label: str, path: str, parent: Node | None):
        self.label, self.path, self.parent, self.children, self.entry, self.shape = label, path, parent, [], -1, -1


def tree(paths: list[str], shapes: Shapes | None = None) -> tuple[Node, list[Node]]:
    """(root, the node of each path)."""
    root = Node("", "", None)
    known, own = {"": root}, []
    for i, path in enumerate(paths):
        here, parent = "", root
        for step in path.split("/")[1:]:
            here = f"{here}/{step}"
            node = known.get(here)
            if node is None:
                node = known[here] = Node(step.rsplit(":", 1)[0], here, parent)
                parent.children.append(node)
            parent = node
        parent.entry = i
        own.append(parent)
    if shapes is not None:
        for node in reversed(known.values()):  # children come after their parents
            node.shape = shapes.number(node.label, tuple(c.shape for c in node.children))
    return root, own


def aligned(a: Node, b: Node, shapes: Shapes) -> list[tuple[Node, Node]]:
    """The pairs of nodes of a best matching of two roots."""
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.children and y.children:
            at = shapes.pairs(shapes.children[x.shape], shapes.children[y.shape])
            todo.extend((x.children[i], y.children[j]) for i, j in at)
    return out


def choose(paths: list[str], stats: dict[int, tuple]) -> tuple[list[bool], str]:
    """(whether each slot of the reference page is content, path of the content's root).

    stats has pages, same (pages that hold the slot's commonest text), state, chars and links of each slot. Constant slots
    and lists of links have no mass. Of what varies, slots with a telling word in class, id or role count as mass, and as content within
    the root, only if nothing without them is there. Where less than half of a host's text varies, its pages are copies of
    each other, which cannot tell template from content: no slot is content then, and each page is judged alone.
    """
    none = (0, 0, KEPT, 0, 0)
    facts = [stats.get(i, none) for i in range(len(paths))]
    varies = [n > 0 and not (n >= LEAST_PAGES and same >= CONSTANT * n) and link < LINKS * chars for n, same, _, chars, link in facts]
    _, own = tree(paths)

    def inside(path: str, root: str) -> bool:
        return path == root or path.startswith(root + "/")

    def level(under: list[int]) -> int:
        return max((facts[i][2] for i in under if varies[i]), default=KEPT)

    least = level(list(range(len(paths))))
    mass = {i: facts[i][3] for i in range(len(paths)) if varies[i] and facts[i][2] >= least}
    of: dict[str, int] = collections.Counter()
    nodes: dict[str, Node] = {}
    for i, m in mass.items():
        node = own[i]
        while node is not None:
            of[node.path] += m
            nodes[node.path] = node
            node = node.parent
    total = sum(mass.values())
    if 2 * total < sum(chars for _, _, state, chars, link in facts if state >= least and link < LINKS * chars):
        return [False] * len(paths), ""
    holds = [n for p, n in nodes.items() if of[p] >= MASS * total and (n.children or n.label.split(".")[0] in ("div", "section", "article", "main", "td", ""))]
    root = max(holds, key=lambda n: n.path.count("/")) if holds and total else None
    if root is None:
        return [False] * len(paths), ""
    up = root
    while up is not None and up.label.split(".")[0] not in ("article", "main"):
        up = up.parent
    root = up or root
    within = [i for i, p in enumerate(paths) if inside(p, root.path)]
    least = level(within)
    # A heading before the root, of an element around it, is the article's.
    heads = [i for i, n in enumerate(own) if n.label.split(".")[0] in ("h1", "h2") and i < min(within) and inside(root.path, n.parent.path)]
    return [varies[i] and ((i in within and facts[i][2] >= least) or (i in heads and facts[i][2] == KEPT)) for i in range(len(paths))], root.path


def in_slot(slot: int, text: int) -> int:
    """A text's digest where it stands."""
    return digest(f"{slot}/{text}")


def tally(reference: list[str], pages: list) -> list[tuple]:
    """(slot, digest, pages, same, state, chars, link) of the slots of the reference page over a block of pages, of the
    texts that nearly all of the block's pages hold in one slot (slot -2), and of the block itself (slot -1)."""
    shapes = Shapes()
    root, _ = tree(reference, shapes)
    slots: dict[int, list] = {}
    commonest: dict[int, collections.Counter] = {}
    texts: collections.Counter[int] = collections.Counter()
    for entries in pages:
        there, _ = tree([e["path"] for e in entries], shapes)
        for a, b in aligned(root, there, shapes):
            if a.entry >= 0 and b.entry >= 0:
                e = entries[b.entry]
                texts.update({in_slot(a.entry, int(d)) for d in e["digests"]})
                s = slots.setdefault(a.entry, [0, KEPT, 0, 0])
                s[0], s[1], s[2], s[3] = s[0] + 1, min(s[1], e["state"]), s[2] + e["chars"], s[3] + e["link"]
                commonest.setdefault(a.entry, collections.Counter())[tuple(map(int, e["digests"]))] += 1
    n = len(pages)
    rows = [(s, 0, v[0], max(commonest[s].values()), v[1], v[2], v[3]) for s, v in slots.items()]
    return rows + [(-2, d, n, 0, 0, 0, 0) for d, k in texts.items() if k >= EVERYWHERE * n and n > 1] + [(-1, 0, n, 0, 0, 0, 0)]


def wrapper_of(paths: list[str], facts: list[tuple]) -> str:
    """A host's wrapper, from the sums of tally()'s rows."""
    total = sum(f[2] for f in facts if f[0] == -1)
    content, root = choose(paths, {f[0]: f[2:] for f in facts if f[0] >= 0})
    texts = sorted(int(f[1]) for f in facts if f[0] == -2 and total >= LEAST_PAGES and f[2] >= EVERYWHERE * total)
    return json.dumps({"paths": paths, "content": content, "root": root, "texts": texts, "pages": int(total)})


def induce(parsed: DataFrame) -> DataFrame:
    """host and wrapper (JSON: paths of the reference page, which of them are content, root, template texts).

    Different pages of a host are dealt to blocks of about 64 by a hash; hosts with fewer than LEAST_PAGES pages are
    aligned together, as the host of no name. The largest page of a host is the reference that each block is aligned to, so
    slots have the same meaning in all blocks and their counts can be summed; no task sees a whole host. A text
    is template in a slot if blocks with nearly all of the host's pages find it there on nearly all of theirs.
    """
    parsed = parsed.where(F.size("entries") > 0)
    sizes = materialise(parsed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # Few bytes a host; by measure, not by guess, they are sent to all tasks or dealt with salted keys.
    measured = sizes.agg(F.coalesce(F.sum(F.octet_length("host") + 24), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(F.col("n") < LEAST_PAGES, F.col("n"))), F.lit(0)).alias("pooled")).first()
    small = F.col("n") < LEAST_PAGES
    names = sizes.select("host", F.when(small, F.lit("")).otherwise(F.col("host")).alias("name"), F.ceil(F.when(small, F.lit(measured["pooled"])).otherwise(F.col("n")) / PAGES_PER_BLOCK).cast("int").alias("blocks"))

    def named(rows: DataFrame) -> DataFrame:
        if measured["bytes"] <= BROADCAST_BYTES:
            return rows.join(F.broadcast(names), "host")
        salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("salt", F.pmod(F.col("page"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])

    largest = F.max(F.struct(F.size("entries").alias("size"), "page", F.transform("entries", lambda e: e["path"]).alias("paths")))
    reference = materialise(named(parsed).groupBy(F.col("name").alias("host")).agg(largest.alias("r")).select("host", "r.paths"), "references")
    dealt = named(parsed.groupBy("host", "page").agg(F.first("entries").alias("entries"))).select(F.col("name").alias("host"), F.pmod(F.xxhash64("page"), F.col("blocks")).cast("int").alias("block"), "page", "entries")
    blocks = names.select(F.col("name").alias("host"), "blocks").distinct().select("host", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(reference, "host")

    def align(block: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = [(block.host.iloc[0], *r) for r in tally(list(own.paths.iloc[0]), list(block.entries))] if len(block) and len(own) else []
        return pd.DataFrame(rows, columns=["host", "slot", "digest", "pages", "same", "state", "chars", "link"])

    schema = "host string, slot int, digest bigint, pages bigint, same bigint, state int, chars bigint, link bigint"
    counts = dealt.groupBy("host", "block").cogroup(blocks.groupBy("host", "block")).applyInPandas(align, schema)
    counts = counts.groupBy("host", "slot", "digest").agg(*[F.sum(c).alias(c) for c in ("pages", "same", "chars", "link")], F.min("state").alias("state"))
    # One row a slot of the reference page and a row a frequent text: as many as a page has blocks, and few more.
    facts = counts.groupBy("host").agg(F.collect_list(F.struct("slot", "digest", "pages", "same", "state", "chars", "link")).alias("facts")).join(reference, "host")

    def decide(batches):
        names = ("slot", "digest", "pages", "same", "state", "chars", "link")
        for pdf in batches:
            yield pd.DataFrame({"host": pdf.host, "wrapper": [wrapper_of(list(p), [tuple(int(f[k]) for k in names) for f in x]) for x, p in zip(pdf.facts, pdf.paths)]})

    found = materialise(facts.mapInPandas(decide, "host string, wrapper string"), "wrappers")
    discard(sizes, reference)
    return found


class Wrapper:
    """A host's wrapper, ready to be laid over its pages."""

    def __init__(self, text: str):
        known = json.loads(text)
        self.paths = known["paths"]
        self.align_anew()
        self.content, self.path, self.texts = known["content"], known["root"], set(known["texts"])
        self.usable = known["pages"] >= LEAST_PAGES and any(known["content"])

    def align_anew(self) -> None:
        self.shapes = Shapes()
        self.root, _ = tree(self.paths, self.shapes)

    def content_of(self, blocks: list[dict]) -> list[str] | None:
        """The texts of the page's slots that are content; None if the page is not like the host's others, or so much like
        them that most of its content would be template."""
        entries, own = entries_of(blocks)
        if len(self.shapes.memo) + len(self.shapes.label) > SHAPES:
            self.align_anew()
        there, nodes = tree([e["path"] for e in entries], self.shapes)
        pair = {id(b): a for a, b in aligned(self.root, there, self.shapes)}
        good, met, slots = [False] * len(entries), 0, [-1] * len(entries)
        for i, (e, node) in enumerate(zip(entries, nodes)):
            a = pair.get(id(node))
            if a is not None and a.entry >= 0:
                met += 1
                good[i], slots[i] = self.content[a.entry], a.entry
            else:  # a slot that the reference page lacks belongs to where it stands
                while a is None:
                    node = node.parent
                    a = pair.get(id(node))
                good[i] = (a.path == self.path or a.path.startswith(self.path + "/")) and e["state"] == KEPT and e["link"] < LINKS * e["chars"]
        if 2 * met < len(entries):
            return None
        inside = [(b["text"], slots[i]) for b, i in zip(blocks, own) if i >= 0 and good[i]]
        if not self.texts:
            return [t for t, _ in inside]
        content = [t for t, slot in inside if in_slot(slot, digest(t)) not in self.texts]
        return content if 2 * sum(map(len, content)) >= sum(len(t) for t, _ in inside) else None


def alone(blocks: list[dict]) -> list[str]:
    """The texts of a page without a wrapper: of its article or main element if it has one, without what tags and words leave out."""
    for least in (KEPT, WEAK):
        own = [b for b in blocks if b["state"] >= least]
        main = [b for b in own if b["main"]]
        if own:
            return [b["text"] for b in main or own]
    return []


def extract(pages: DataFrame, induction: bool = True) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    A page's content is what its host's wrapper says (see induce()); a page unlike the others of its host, and one of a
    table with too few pages, is judged by its own tags and words. Without `induction` all text outside tags that are
    never an article counts. Character references are decoded, white space within a block is one space, blocks are joined by one
    space in page order. A null or empty html gives an empty text; a null url is of the host of no name; repeated pages
    are each returned; other columns are left out; an empty table gives an empty one.
    """
    parsed = materialise(parse(pages), "parsed")
    wrappers: dict[str, str] | None = {}
    rows = parsed.select("page_id", "url", "host", "blocks")
    if induction:
        found = induce(parsed.select("host", "page", "entries"))
        if found.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
            wrappers = {r["host"]: r["wrapper"] for r in found.collect()}  # BROADCAST_BYTES at most
            rows = rows.withColumn("wrapper", F.lit(None).cast("string"))
        else:
            # Each page gets its host's, else that of the pool, by keys of host and salt.
            wrappers = None
            pool = found.where("host = ''").select("wrapper").first()
            salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
            rows = rows.select("page_id", "url", "host", "blocks", F.coalesce("wrapper", F.lit(pool[0] if pool else None)).alias("wrapper"))
    else:
        rows = rows.withColumn("wrapper", F.lit(None).cast("string"))

    def run(batches):
        ready: dict[str, Wrapper] = {}

        def wrapper(host: str, text: str | None) -> Wrapper | None:
            text = text or (wrappers and (wrappers.get(host) or wrappers.get("")))
            if not text:
                return None
            if text not in ready:
                if len(ready) > 1000:
                    ready.clear()
                ready[text] = Wrapper(text)
            return ready[text]

        for batch in batches:
            out = []
            for host, blocks, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if not induction:
                    out.append(" ".join(b["text"] for b in blocks if b["state"] > OUT))
                    continue
                own = wrapper(host, text)
                content = own.content_of(blocks) if own and own.usable else None
                out.append(" ".join(alone(blocks) if content is None else content))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
