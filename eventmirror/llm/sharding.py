"""Sharding: rendezvous hashing of record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone (52 bits of an MD5)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("/", key, F.lit(str(shard)))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, shards: int | Mapping[int, float]) -> Column:
    """The shard whose weighted draw wins: the smallest ``-ln(draw) / weight``.

    A shard of twice the weight gets twice the rows. A further shard competes with its own
    draw only, so records move into it or stay; one that goes gives up its own records only.
    A null key counts as the empty key, so its rows share one shard. Ties go to the smaller shard.
    """
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(range(shards), 1.0)
    if not weights or min(weights.values()) <= 0:
        raise ValueError("at least one shard, each of a positive weight")
    key = F.coalesce(key.cast("string"), F.lit(""))
    bids = [F.struct((-F.log(draw(key, s)) / F.lit(float(w))).alias("bid"), F.lit(s).alias("shard")) for s, w in sorted(weights.items())]
    return (F.array_min(F.array(*bids)) if len(bids) > 1 else bids[0])["shard"]


def with_slots(df: DataFrame, shard: str, rows_per_bucket: int = 200_000, copies_per_row: int = 1000) -> DataFrame:
    """df with `slot`: the place of each row in its shard, without gaps from 0.

    Equal rows are counted first, before they are shuffled, so any number of copies is one row. Rows of a shard are
    dealt to hash buckets of about `rows_per_bucket` rows; a slot is the number of rows in the earlier buckets
    plus the place within the bucket. At last copies are put out again, first in blocks of `copies_per_row`, which are
    dealt out, so that no task makes all of them. No task sorts a whole shard. df should be narrow.
    """
    columns = df.columns
    groups = materialise(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "slots")
    buckets = max(1, -(-groups.count() // rows_per_bucket))
    dealt = groups.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(shard, "_bucket").agg(F.sum("_n").alias("_all"))
    starts = counts.select(shard, "_bucket", F.coalesce(F.sum("_all").over(before(shard).orderBy("_bucket")), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum("_n").over(before(shard, "_bucket").orderBy(*columns)), F.lit(0))
    placed = dealt.withColumn("_place", within).join(starts, [shard, "_bucket"]).withColumn("slot", F.col("_start") + F.col("_place"))
    span = lambda first, last: F.explode(F.sequence(first, last))
    blocks = placed.where("_n > 1").withColumn("_block", span(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / copies_per_row).cast("long")))
    first = F.col("_block") * copies_per_row
    copies = blocks.repartition(shard, "slot", "_block").withColumn("_copy", span(first, F.least(first + copies_per_row, F.col("_n")) - 1)).withColumn("slot", F.col("slot") + F.col("_copy"))
    return placed.where("_n = 1").select(*columns, "slot").unionByName(copies.select(*columns, "slot"))


def shard_documents(docs: DataFrame, shards: int | Mapping[int, float] = 8) -> DataFrame:
    """Place every document by its doc_id (law `key`) and say where one more shard, of weight 1, would put it.
    `shards` is a number of equal shards or the weight of each.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot, grown_shard. A null
    text counts as empty, a null doc_id as the empty key; repeated rows get slots of their own;
    an empty table gives an empty one; other columns are left out. The text is read once:
    only the narrow row is written and dealt out.
    """
    weights = dict(shards) if isinstance(shards, Mapping) else dict.fromkeys(range(shards), 1.0)
    grown = weights | {max(weights) + 1: 1.0}
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), grown).alias("grown_shard"),
    )
    out = with_slots(narrow, "shard")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
