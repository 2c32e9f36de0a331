"""Cumulative-snapshot collapse of logged conversations.

Chat logs often hold a conversation once for every request: each snapshot repeats all turns so far. Rolling hashes of the
turn prefixes find the conversations that are a prefix of a longer one; anti-joins drop them, and what stays is maximal.

The hash of the first i turns is the sum of 64-bit hashes of (position, role, text), twice with different seeds: a window
sum, so one conversation's turns need not fit in memory. Only hashes are shuffled until the maximal conversations are known.

Defined cases: turns are ordered by turn (null first), then role, then text; equal rows of one conversation count once;
null role and text differ from empty ones and are rendered as empty; rows without conv_id are left out; of conversations
with equal turns the smallest conv_id stays; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written


def _turn_keys(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, k1, k2: distinct turns by content hash, without their texts."""
    def key(seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")

    kept = turns.where(F.col("conv_id").isNotNull())
    # Ties of turn are ordered by role and text; a digest of the text gives an order that is the same everywhere.
    return kept.select("conv_id", "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("text").isNull().alias("no_text"), key(1).alias("k1"), key(2).alias("k2")).dropDuplicates(["conv_id", "turn", "k1", "k2"])


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, i, h1, h2, n: the rolling hashes of the first i turns, for i from 1 to the number of turns n."""
    w = Window.partitionBy("conv_id")
    order = w.orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("no_text").desc(), "digest")
    at = _turn_keys(turns).withColumn("i", F.row_number().over(order))

    def rolling(key: str, seed: int) -> Column:
        part = F.xxhash64(F.lit(seed), "i", key).cast("decimal(20,0)")
        return F.sum(part).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    return at.select("conv_id", F.col("i").cast("long").alias("i"), rolling("k1", 11).alias("h1"), rolling("k2", 12).alias("h2"), F.count(F.lit(1)).over(w).alias("n"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that prefix no longer one, one of each set of equals."""
    hashes = written(prefix_hashes(turns), "turn-prefixes")
    whole = hashes.where("i = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.where("i < n").select(F.col("i").alias("n"), "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame, keep: DataFrame) -> DataFrame:
    """conv_id, n_turns, chat: one <|role|> line and the text for each turn."""
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text").dropDuplicates()
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    item = F.struct("turn", "role", F.col("text").isNotNull().alias("has"), digest.alias("digest"), "text")
    lines = F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat(F.lit("<|"), F.coalesce(x["role"], F.lit("")), F.lit("|>\n"), F.coalesce(x["text"], F.lit(""))))
    return rows.join(keep, "conv_id").groupBy("conv_id", "n_turns").agg(F.array_join(lines, "\n").alias("chat"))


def collapse(turns: DataFrame) -> DataFrame:
    turns = turns.select("conv_id", "turn", "role", "text")
    return render(turns, written(maximal(turns), "maximal-conversations"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text IS NOT NULL, sha256(coalesce(text, ''))) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  coalesce(length(role)::VARCHAR || ':' || role, '-') || coalesce(length(text)::VARCHAR || ':' || text, '-') AS k FROM t),
p AS (SELECT conv_id, i, n, sha256(string_agg(k, '|') OVER (PARTITION BY conv_id ORDER BY i)) AS h FROM o),
m AS (SELECT min(conv_id) AS conv_id, n FROM p WHERE i = n AND NOT EXISTS (SELECT 1 FROM p q WHERE q.h = p.h AND q.i < q.n AND q.i = p.n) GROUP BY n, h)
SELECT m.conv_id, m.n AS n_turns, string_agg('<|' || coalesce(o.role, '') || '|>' || chr(10) || coalesce(o.text, ''), chr(10) ORDER BY o.i) AS chat
FROM m JOIN o USING (conv_id) GROUP BY m.conv_id, m.n"""
