"""Scratch tables, id components and text splitting shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh_path

#: Bytes of a row group of scratch tables, which a task holds until it is full.
ROW_GROUP = 32 << 20


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends and a lost executor costs no rework.

    discard() deletes it; what a lazy result still reads stays until the folder is cleared.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    out = df.write.option("parquet.block.size", ROW_GROUP)
    if by:
        out = out.partitionBy(by)
    out.parquet(path)
    back = spark.read.schema(df.schema).parquet(path) if by is None else spark.read.parquet(path)
    back._scratch = path
    return back


def discard_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialise() that nothing lazy reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            discard_folder(df.sparkSession, path)
            df._scratch = None


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of docs whose doc_id is in ids (left_semi) or is not (left_anti). A task hashes its part of the ids, so whole texts
    stream past them and are never sorted."""
    return docs.join(ids.select("doc_id").hint("shuffle_hash"), "doc_id", how).select(docs.columns)


def raw_text(df: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """The columns `kept` and, last, the bytes of the text, empty for a null, under a name that none of them has."""
    name = "_text"
    while name in kept:
        name += "_"
    return df.select(*kept, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias(name))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from every id that edges mention.

    Each round maps every node to the smallest node next to it and contracts the edges by
    that map, so a star is done in one round and the number of rounds grows with the
    logarithm of the longest path. Nothing is gathered by component.
    """
    edges = materialise(
        edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges"
    )
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("low")), "low")
        if labels is None:
            new_labels = materialise(least.select(F.col("node").alias("id"), F.col("low").alias("component")), "labels")
        else:
            new_labels = materialise(
                labels.join(least, labels.component == least.node, "left").select(
                    "id", F.coalesce("low", "component").alias("component")
                ),
                "labels",
            )
            discard(labels)
        labels = new_labels
        new_edges = materialise(
            edges.join(least.select(F.col("node").alias("a"), F.col("low").alias("la")), "a")
            .join(least.select(F.col("node").alias("b"), F.col("low").alias("lb")), "b")
            .where("la <> lb")
            .select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
            .distinct(),
            "edges",
        )
        discard(edges, least)
        edges = new_edges
        if edges.isEmpty():
            discard(edges)
            return labels


def slices(sizes: np.ndarray, most: int):
    """(start, stop) runs of rows whose sizes add up to `most` at most, or single larger rows."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
