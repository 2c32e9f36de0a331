"""Mixing sources to target weights by temperature.

A source's share p of all tokens becomes the weight p**alpha, normalised. alpha = 1 keeps the shares, alpha = 0 makes all
sources equal. Bisection finds the smallest alpha that keeps the repetition limit, or the alpha that meets a target
entropy. The weights then become token budgets: those of `budget` tokens in all, or, without one, scaled so that the least
repeated source is emitted once in full. Each source gets whole passes (none, if its budget is below its tokens) and one
partial pass. The documents of a source are dealt into blocks by hash and the blocks are permuted; the partial pass takes
blocks in permuted order, and of the block at its end the first documents by hash.

Sources may be many: their totals stay a table, of which only sums come to the driver, and budgets are broadcast if they
are counted to be at most BROADCAST_SOURCES; beyond, rows meet them by a salted join.

Defined cases: a null source is a source of its own; a null or empty text has no tokens and goes with its block; rows that
repeat a doc_id are ordered by a hash of their text and then count one by one; a source without tokens is emitted once; an
empty table gives no rows; extra columns are kept as they are, whatever their names; texts are only counted and hashed, so
their length doesn't matter. Without a budget nothing is dropped: every document is emitted at least once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read_table, unused, written

BLOCK_DOCS = 4096
#: Budgets of so many sources are some 10 MB; salts for the join of more.
BROADCAST_SOURCES, SALTS = 100_000, 32
#: Exponents that are tried in one pass over the sources' totals.
AT_ONCE = 15


def _log_share(whole: int) -> Column:
    return F.log(F.col("tokens").cast("double")) - math.log(whole)


def entropies(totals: DataFrame, whole: int, alphas: list[float]) -> list[float]:
    """The entropy of the weights p**alpha, for each alpha: one pass."""
    lp = _log_share(whole)
    sums = [x for a in alphas for x in (F.sum(F.exp(lp * a)), F.sum(F.exp(lp * a) * lp))]
    row = totals.where("tokens > 0").agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()
    return [math.log(row[2 * i]) - a * row[2 * i + 1] / row[2 * i] for i, a in enumerate(alphas)]


def solve_alpha(totals: DataFrame, repetition_limit: float | None = None, target_entropy: float | None = None, steps: int = 60) -> float:
    """The smallest alpha from 0 to 1 that is not too flat, by bisection: entropy and the largest number of passes,
    (largest share / smallest share)**(1 - alpha), fall as alpha grows. totals(source, tokens)."""
    ends = totals.where("tokens > 0").agg(F.sum("tokens").alias("whole"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if ends["whole"] is None or repetition_limit is None and target_entropy is None:
        return 1.0
    out = 0.0
    if repetition_limit is not None:
        span, most = math.log(ends["most"] / ends["least"]), math.log(max(repetition_limit, 1.0))
        lo, hi = (0.0, 1.0) if span > most else (0.0, 0.0)
        for _ in range(steps if hi else 0):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (1 - mid) * span > most else (lo, mid)
        out = hi
    if target_entropy is not None and entropies(totals, ends["whole"], [out])[0] > target_entropy:
        lo, hi = out, 1.0
        for _ in range(-(-steps // int(math.log2(AT_ONCE + 1)))):
            tries = [lo + (hi - lo) * (i + 1) / (AT_ONCE + 1) for i in range(AT_ONCE)]
            flat = sum(h > target_entropy for h in entropies(totals, ends["whole"], tries))
            lo, hi = [lo, *tries][flat], [*tries, hi][flat]
        out = hi
    return out


def budgets(totals: DataFrame, alpha: float, budget: int | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """source, blocks, full_passes, part_tokens, weight of each source of totals(source, tokens, docs)."""
    ends = totals.where("tokens > 0").agg(F.sum("tokens").alias("whole"), F.max("tokens").alias("most")).first()
    whole, most = ends["whole"] or 1, ends["most"] or 1
    lp, has = _log_share(whole), F.col("tokens") > 0
    z = totals.where("tokens > 0").agg(F.sum(F.exp(_log_share(whole) * alpha)).alias("z")).first()["z"] or 1.0
    weight = F.when(has, F.exp(lp * alpha) / z).otherwise(0.0)
    times = F.exp((lp - math.log(most / whole)) * (alpha - 1)) if budget is None else weight * budget / F.col("tokens")
    times = F.when(has, F.round(times, 9)).otherwise(1.0)
    return totals.select("source", F.ceil(F.col("docs") / block_docs).alias("blocks"), F.floor(times).alias("full_passes"), F.floor((times - F.floor(times)) * F.col("tokens") + 1e-6).alias("part_tokens"), F.round(weight, 12).alias("weight"))


def _token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(docs: DataFrame, seed: int = 1, repetition_limit: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """A row for each row of docs(doc_id, source, text): doc_id, source, n_tokens, digest, block, block_rank, copies,
    weight. No text is shuffled."""
    rows = written(docs.select("doc_id", "source", _token_count(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("digest")), "mix-rows")
    totals = written(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-totals")
    own = written(budgets(totals, solve_alpha(totals, repetition_limit, target_entropy), budget, block_docs), "mix-budgets")
    own = own.withColumnRenamed("source", "s")
    if own.count() <= BROADCAST_SOURCES:
        dealt = rows.join(F.broadcast(own), rows["source"].eqNullSafe(own["s"]))
    else:
        salted = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("int"))
        dealt = dealt.join(salted, dealt["source"].eqNullSafe(salted["s"]) & (dealt["salt"] == salted["salt"])).drop("salt")
    dealt = dealt.drop("s").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "digest"), F.col("blocks"))).withColumn("block_key", F.xxhash64(F.lit(seed), "source", "block"))
    # Blocks in permuted order and the tokens before each: a window over block totals, a row for about block_docs documents.
    sums = dealt.groupBy("source", "block", "block_key", "part_tokens").agg(F.sum("n_tokens").alias("block_tokens"))
    order = Window.partitionBy("source").orderBy("block_key", "block")
    sums = sums.withColumn("block_rank", F.row_number().over(order).cast("long")).withColumn("before", F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    all_in = F.col("before") + F.col("block_tokens") <= F.col("part_tokens")
    sums = sums.select(F.col("source").alias("s"), F.col("block").alias("b"), "block_rank", "before", all_in.alias("all_in"), (~all_in & (F.col("before") < F.col("part_tokens"))).alias("is_cut"))
    cut = written(dealt.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b", "blocks", "block_key"), "mix-dealt")
    # Only the one block of each source where its partial pass ends is put in order.
    inner = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "digest"), "doc_id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [cut.where("NOT is_cut").withColumn("more", F.col("all_in").cast("long")), cut.where("is_cut").withColumn("more", (F.col("before") + F.sum("n_tokens").over(inner) <= F.col("part_tokens")).cast("long"))]
    return out[0].unionByName(out[1]).select("doc_id", "source", "n_tokens", "digest", "block", "block_rank", (F.col("full_passes") + F.col("more")).alias("copies"), "weight")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the plan says; equal rows of one source have one fate, the larger."""
    ids = [unused(n, docs.columns) for n in ("mix_id", "mix_source", "mix_digest", "mix_copies", "mix_copy")]
    fate = plan(docs, **options).groupBy(*(F.col(a).alias(b) for a, b in zip(("doc_id", "source", "digest"), ids[:3], strict=True))).agg(F.max("copies").alias(ids[3]))
    same = docs["doc_id"].eqNullSafe(F.col(ids[0])) & docs["source"].eqNullSafe(F.col(ids[1])) & (F.xxhash64(docs["text"]) == F.col(ids[2]))
    held = docs.join(fate.where(F.col(ids[3]) > 0), same).withColumn(ids[4], F.explode(F.sequence(F.lit(1), F.col(ids[3]).cast("int"))))
    return held.select(*(docs[c] for c in docs.columns))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(read_table(spark, sf_dir, "documents")).drop("digest")
