"""Chat formatting for preference training: one prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _turns(side: str) -> Column:
    """The turns of one side in order, of the side's smallest conv_id; a repeated turn number keeps its smallest (role, text)."""
    turns = F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("conv_id", "turn", "role", "text"))))
    return F.filter(turns, lambda t: t["conv_id"] == F.get(turns, F.lit(0))["conv_id"])


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Runs over the rendered text: -n characters to leave out of the loss, +n to learn."""

    def run(t: Column) -> Column:
        head, tail = F.length(t["role"]) + 5, F.length(t["text"]) + len(END)
        text = lambda c: c.cast("string")
        return F.when(t["role"] == "assistant", F.concat(F.lit("-"), text(head), F.lit("+"), text(tail))).otherwise(F.concat(F.lit("-"), text(head + tail)))

    return F.array_join(F.transform(turns, run), "")


def format_preferences(turns: DataFrame) -> DataFrame:
    """Pairs of conversations as prompt, chosen and rejected.

    `turns` has pair_id, side ('chosen' or 'rejected'), conv_id, turn, role, text. The longest common prefix of
    whole turns (equal role and text) is rendered once as the prompt; each side's rest is its completion, with
    a mask that learns the assistant's text and end marks only. `usable` says that both completions hold
    an assistant turn. Null roles are `user`, null texts empty; ``<|`` within a text is written ``< |``, so that
    no text can close a turn. Of a side's conversations the one of the smallest conv_id counts. Rows without pair_id, side, conv_id or turn belong to no pair; a pair of one side
    gives no row; of rows that repeat a turn one stays; an empty table gives an empty one.
    A conversation is put together in one place, as its rendered text is one value.
    """
    clean = (
        turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .select("pair_id", "side", "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
        .groupBy("pair_id", "side", "conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("t"))
        .select("pair_id", "side", "conv_id", "turn", "t.role", "t.text")
    )
    pairs = clean.groupBy("pair_id").agg(
        F.min(F.when(F.col("side") == "chosen", F.col("conv_id"))).alias("chosen_id"),
        F.min(F.when(F.col("side") == "rejected", F.col("conv_id"))).alias("rejected_id"),
        _turns("chosen").alias("c"),
        _turns("rejected").alias("r"),
    ).where("chosen_id IS NOT NULL AND rejected_id IS NOT NULL")
    shorter = F.least(F.size("c"), F.size("r"))
    differ = F.filter(F.sequence(F.lit(0), shorter - 1), lambda i: (F.get("c", i)["role"] != F.get("r", i)["role"]) | (F.get("c", i)["text"] != F.get("r", i)["text"]))
    pairs = pairs.withColumn("n_common", F.coalesce(F.get(differ, F.lit(0)), shorter))
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.size(c))
    pairs = pairs.withColumns({"p": F.slice("c", F.lit(1), F.col("n_common")), "c": rest("c"), "r": rest("r")})
    answers = lambda c: F.exists(c, lambda t: t["role"] == "assistant")
    return pairs.select(
        "pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
        _render(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"),
        (answers("c") & answers("r")).alias("usable"),
    )


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """Without preference labels: conversation 2k stands for the chosen one, 2k + 1 for the rejected one."""
    return conversations.select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"),
        F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        "conv_id", "turn", "role", "text",
    )


SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id, turn, min(struct_pack(role := coalesce(role, 'user'), text := replace(coalesce(text, ''), '<|', '< |'))) AS t
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
  '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) AS piece,
  CASE WHEN t.role = 'assistant' THEN '-' || (length(t.role) + 5) || '+' || (length(t.text) + 8) ELSE '-' || (length(t.role) + length(t.text) + 13) END AS mask
  FROM t),
c AS (SELECT * FROM n WHERE conv_id % 2 = 0), r AS (SELECT * FROM n WHERE conv_id % 2 = 1),
s AS (SELECT pair_id, max(c.i) AS cn, max(r.i) AS rn, min(CASE WHEN c.t IS DISTINCT FROM r.t THEN coalesce(c.i, r.i) END) - 1 AS k
  FROM c FULL JOIN r USING (pair_id, i) GROUP BY 1 HAVING cn IS NOT NULL AND rn IS NOT NULL),
m AS (SELECT pair_id, least(cn, rn, coalesce(k, cn)) AS n_common FROM s)
SELECT pair_id, pair_id * 2 AS chosen_id, pair_id * 2 + 1 AS rejected_id, n_common,
  coalesce((SELECT string_agg(piece, '' ORDER BY i) FROM c WHERE c.pair_id = m.pair_id AND i <= n_common), '') AS prompt,
  coalesce((SELECT string_agg(piece, '' ORDER BY i) FROM c WHERE c.pair_id = m.pair_id AND i > n_common), '') AS chosen,
  coalesce((SELECT string_agg(mask, '' ORDER BY i) FROM c WHERE c.pair_id = m.pair_id AND i > n_common), '') AS chosen_mask,
  coalesce((SELECT string_agg(piece, '' ORDER BY i) FROM r WHERE r.pair_id = m.pair_id AND i > n_common), '') AS rejected,
  coalesce((SELECT string_agg(mask, '' ORDER BY i) FROM r WHERE r.pair_id = m.pair_id AND i > n_common), '') AS rejected_mask,
  coalesce((SELECT bool_or(t.role = 'assistant') FROM c WHERE c.pair_id = m.pair_id AND i > n_common), false)
    AND coalesce((SELECT bool_or(t.role = 'assistant') FROM r WHERE r.pair_id = m.pair_id AND i > n_common), false) AS usable
FROM m
"""
