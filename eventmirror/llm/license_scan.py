"""License scans: phrases that name a license, and an exact set-similarity join of text blocks with license templates.

A block is BLOCK words from every STRIDE-th word on. A template is found in a block if the block holds THRESHOLD of its distinct words.
Words are ordered by how often they occur in all texts, rarest first; words that no template holds change no overlap and are left out.
A pair can only reach the threshold if the block is long enough (length filter), one of the first words of the template and of the
block agree (prefix filter) and enough words come after that (positional filter); such pairs are counted exactly.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_text, slices

BLOCK, STRIDE = 96, 48
#: Share of a template's distinct words, as a fraction.
THRESHOLD = (4, 5)
#: Bytes of text scanned at a time; a longer text goes alone.
BATCH_BYTES = 1 << 20
# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Sentences of public licenses and their labels. At most STRIDE + 1 words, so that each lies whole in some block.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("all-rights-reserved", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
)
#: A-Z become a-z, and what is no part of a word becomes a space; bytes from 128 on are parts of words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@functools.cache
def vocabulary() -> dict[bytes, int]:
    """The words of phrases and templates, numbered."""
    words = sorted({w for t in [*PHRASES, *(t for _, t in TEMPLATES)] for w in t.split()})
    return {w.encode(): i for i, w in enumerate(words)}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def _numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number in the vocabulary or -1 of every word, its text, its place in that text)."""
    known = vocabulary()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    numbers = np.fromiter((known.get(w, -1) for t in texts for w in t), np.int64, int(sizes.sum()))
    return numbers, np.repeat(np.arange(len(texts)), sizes), np.arange(len(numbers)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _batches(batches):
    """(part of a batch, words of its texts)."""
    for batch in batches:
        raw = batch.column(batch.num_columns - 1).to_pylist()
        for a, b in slices(np.fromiter(map(len, raw), np.int64, len(raw)), BATCH_BYTES):
            yield batch.slice(a, b - a), [words_of(t) for t in raw[a:b]]


def frequencies(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often each word of the vocabulary occurs in all texts. Tasks count first; the shuffle has one row a word and task."""

    def count(batches):
        total = np.zeros(len(vocabulary()), np.int64)
        for _, texts in _batches(batches):
            numbers = _numbers(texts)[0]
            total += np.bincount(numbers[numbers >= 0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["word", "n"])

    found = raw_text(df, text, []).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()  # the vocabulary at most
    out = np.zeros(len(vocabulary()), np.int64)
    out[found["word"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


@dataclass
class Index:
    """Templates as sets of ranks, and which of them have a rank in their prefix."""

    rank: np.ndarray  # of each word of the vocabulary
    holds: np.ndarray  # template x rank
    size: np.ndarray
    need: np.ndarray
    first: np.ndarray  # rank -> where its postings start
    template: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Index:
        rank = np.empty(len(counts), np.int64)
        rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        known = vocabulary()
        sets = [np.unique([rank[known[w.encode()]] for w in t.split()]) for _, t in TEMPLATES]
        holds = np.zeros((len(sets), len(counts)), bool)
        for row, s in zip(holds, sets):
            row[s] = True
        size = np.array([len(s) for s in sets])
        need = -(-size * THRESHOLD[0] // THRESHOLD[1])
        postings = sorted((int(r), t, i) for t, s in enumerate(sets) for i, r in enumerate(s[: size[t] - need[t] + 1]))
        ranks, template, place = (np.array(x, np.int64) for x in zip(*postings))
        return cls(rank, holds, size, need, np.searchsorted(ranks, np.arange(len(counts) + 1)), template, place)

    def join(self, block: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, overlap) of all pairs that meet the threshold; the distinct ranks of blocks come in order."""
        new = np.append(True, block[1:] != block[:-1])[: len(block)]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(block)))
        own = np.repeat(np.arange(len(start)), length)
        at = np.arange(len(block)) - start[own]
        probes = np.flatnonzero(at <= length[own] - self.need.min())  # within the prefix for the least overlap of any template
        n = self.first[rank[probes] + 1] - self.first[rank[probes]]
        i = np.repeat(probes, n)
        posting = np.repeat(self.first[rank[probes]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        t, j, size = self.template[posting], self.place[posting], length[own[i]]
        need = self.need[t]
        possible = (size >= need) & (at[i] <= size - need) & (1 + np.minimum(size - at[i], self.size[t] - j) - 1 >= need)
        pairs = np.unique(own[i][possible] * len(self.size) + t[possible])
        s, t = pairs // len(self.size), pairs % len(self.size)
        n = length[s]
        member = np.repeat(start[s] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = self.holds[np.repeat(t, n), rank[member]]
        overlap = np.bincount(np.repeat(np.arange(len(s)), n), shared, len(s)).astype(np.int64)
        found = overlap >= self.need[t]
        return block[start[s[found]]], t[found], overlap[found]


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the text replaced by n_words, phrases (start, label) and blocks (start, end, label, template, share).

    Words are runs of a-z, digits and characters beyond ASCII, after A-Z are lower-cased. `phrases` has every place where the words of a
    phrase of PHRASES stand consecutively, by start; `blocks` every block that holds THRESHOLD of the distinct words of a template, with
    the share it holds, by start and template. A null or empty text has no words. Rows are judged one by one, so repeated rows and any
    order give the same; columns of these names are replaced. Counts the words of all texts first (one job): they decide the order of
    comparison only, never the result.
    """
    index = Index.of(frequencies(df, text))
    new = T._parse_datatype_string("n_words bigint, phrases array<struct<start: bigint, label: string>>, blocks array<struct<start: bigint, end: bigint, label: string, template: int, share: double>>")
    kept = [c for c in df.columns if c not in (text, *new.names)]
    out = T.StructType([*[df.schema[c] for c in kept], *new.fields])
    known = vocabulary()
    phrases = [([known[w.encode()] for w in p.split()], label) for p, label in PHRASES.items()]

    def run(batches):
        for part, texts in _batches(batches):
            numbers, text_of, place = _numbers(texts)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            named: list[list[dict]] = [[] for _ in texts]
            for ids, label in phrases:
                here = np.flatnonzero(numbers == ids[0])
                here = here[place[here] + len(ids) <= sizes[text_of[here]]]
                for i in range(1, len(ids)):
                    here = here[numbers[here + i] == ids[i]]
                for i in here.tolist():
                    named[text_of[i]].append({"start": int(place[i]), "label": label})
            blocks: list[list[dict]] = [[] for _ in texts]
            hits = np.flatnonzero(numbers >= 0)
            if len(hits):
                most = int(sizes.max()) // STRIDE + 1
                block = text_of[hits] * most + place[hits] // STRIDE
                earlier = [np.flatnonzero(place[hits] // STRIDE >= back) for back in range(BLOCK // STRIDE)]
                ranks = index.rank[numbers[hits]]
                width = len(index.rank)
                keys = np.unique(np.concatenate([(block[e] - back) * width + ranks[e] for back, e in enumerate(earlier)]))
                for b, t, n in zip(*(x.tolist() for x in index.join(keys // width, keys % width))):
                    start = b % most * STRIDE
                    blocks[b // most].append({"start": start, "end": min(start + BLOCK, int(sizes[b // most])), "label": TEMPLATES[t][0], "template": t, "share": n / int(index.size[t])})
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c) for c in kept], pa.array(sizes),
                    pa.array([sorted(x, key=lambda p: p["start"]) for x in named], pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))),
                    pa.array(blocks, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("template", pa.int32()), ("share", pa.float64())]))),
                ],
                names=out.names,
            )

    return raw_text(df, text, kept).mapInArrow(run, out)


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (1 with a phrase, else the greatest share of a
    template that meets the threshold, else 0) of scan()'s rows. Labels are distinct, sorted and joined by commas."""
    joined = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    starts = F.col("phrases.start")
    score = F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("blocks.share"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.col("phrases.label")).alias("base_labels"), joined(F.col("phrases.label"), F.col("blocks.label")).alias("labels"), score.alias("score"),
    )


def _sql() -> str:
    at = lambda words: " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words.split(), 1))
    phrases = "\n  UNION ALL ".join(f"SELECT row_id, i, '{label}' AS label FROM places WHERE {at(p)}" for p, label in PHRASES.items())
    templates = ", ".join(f"({i}, '{label}', '{t}')" for i, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, row_number() OVER () AS row_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS (SELECT row_id, w, unnest(range(len(w))) AS i FROM docs),
phrases AS MATERIALIZED ({phrases}),
templates AS MATERIALIZED (SELECT t, label, word, count(*) OVER (PARTITION BY t) AS size FROM (
  SELECT DISTINCT t, label, unnest(string_split(body, ' ')) AS word FROM (VALUES {templates}) v(t, label, body))),
held AS MATERIALIZED (SELECT row_id, i, w[i + 1] AS word FROM places WHERE w[i + 1] IN (SELECT word FROM templates)),
blocks AS (SELECT DISTINCT row_id, i // {STRIDE} - back AS block, word FROM held, (SELECT unnest(range({BLOCK // STRIDE})) AS back) WHERE i // {STRIDE} >= back),
found AS (
  SELECT row_id, label, count(*) / any_value(size) AS share FROM blocks JOIN templates USING (word)
  GROUP BY row_id, block, t, label HAVING count(*) * {THRESHOLD[1]} >= any_value(size) * {THRESHOLD[0]}),
base AS (SELECT row_id, count(*) AS n, min(i) AS a, max(i) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM phrases GROUP BY row_id),
every AS (
  SELECT row_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS share
  FROM (SELECT row_id, label, 1.0::DOUBLE AS share FROM phrases UNION ALL SELECT row_id, label, share FROM found) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels, coalesce(share, 0.0)::DOUBLE AS score
FROM docs LEFT JOIN base USING (row_id) LEFT JOIN every USING (row_id)
"""


SQL = _sql()
