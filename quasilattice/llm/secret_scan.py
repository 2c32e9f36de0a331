"""Secret scans over an incremental blob ledger, with DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content (a blob). A ledger holds the (blob, rule, rule
version) triples that were scanned. scan() distils the distinct blobs, scans only pairs that the ledger lacks, and joins
old and new findings back to all paths. A new rule version scans old blobs again; an old version's findings don't count.

A rule's matches are the leftmost non-overlapping ones of its pattern; one is kept if its group `size_group` has at least
`least` characters. Offsets are code points of the whole match, end exclusive. They come from splitting the text at the
matches: the lengths of pieces and matches, summed in order.

Defined cases: a null content is the empty one; paths may repeat; a null path is kept; an empty table gives empty
results; extra columns are ignored, whatever their names. Memory: one blob a row, of any length; sums run over one blob's matches of one rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str  # Java syntax
    hint: str  # a pattern that every text with a match has: cheap to look for
    size_group: int
    least: int
    rank: int  # order among matches that start together


#: The kinds, in the order listed. For `access` and `hex` the least length stands in the pattern, which
#: gives the same matches, as their runs can't be left early.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", 2, 12, 0),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", "AKIA[A-Z0-9]{14}", 0, 18, 1),
    Rule("hex", 1, r"[0-9a-f]{16,}", "[0-9a-f]{16}", 0, 16, 2),
)
LEDGER = "blob string, rule string, version int"
FINDINGS = "blob string, rule string, version int, start long, end long"
SALTS = 16


def blob_of(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def distinct_blobs(versions: DataFrame) -> DataFrame:
    """blob, content: each content once. Copies meet first in their own task, then by blob."""
    kept = versions.select(blob_of(F.col("content")).alias("blob"), F.coalesce("content", F.lit("")).alias("content"))
    return kept.groupBy("blob").agg(F.first("content").alias("content"))


def unseen(blobs: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """blobs with `todo`: the rules whose (blob, rule, version) the ledger lacks; blobs with none are left out."""
    wanted = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", wanted)
    done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", F.col("version").cast("string"))).alias("done"))
    left = blobs.join(done, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
    return left.where(F.size("todo") > 0).drop("done")


PARTS = "array<struct<rule:string,version:int,gap:int,size:int,keep:boolean>>"


def _part(r: Rule) -> Callable[[Column], Column]:
    """Of a piece and the match after it: their lengths, and whether the match is kept. The last piece has no match."""
    return lambda x: F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.length(x["piece"]).alias("gap"), F.length(x["match"]).alias("size"), (F.length(x["sized"]) >= r.least).alias("keep"))


def matches(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """FINDINGS of blobs(blob, content, todo)."""
    arms = []
    for r in rules:
        hit = F.array_contains("todo", f"{r.kind}:{r.version}") & F.col("content").rlike(r.hint)
        lit = F.lit(r.pattern)
        found = F.arrays_zip(
            F.split("content", r.pattern, -1).alias("piece"),
            F.regexp_extract_all("content", lit, F.lit(0)).alias("match"),
            (F.regexp_extract_all("content", lit, F.lit(r.size_group)) if r.size_group else F.regexp_extract_all("content", lit, F.lit(0))).alias("sized"),
        )
        arms.append(F.when(hit, F.transform(found, _part(r))).otherwise(F.array().cast(PARTS)))
    parts = blobs.select("blob", F.explode(F.array(*arms)).alias("arm")).where(F.size("arm") > 0)
    rows = parts.select("blob", F.posexplode("arm").alias("at", "x")).select("blob", "at", "x.*").where(F.col("size").isNotNull())
    so_far = F.sum(F.col("gap").cast("long") + F.col("size")).over(Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", so_far).where("keep").select("blob", "rule", "version", (F.col("end") - F.col("size")).alias("start"), "end")


@dataclass(frozen=True)
class Scan:
    ledger: DataFrame  # all pairs scanned so far
    findings: DataFrame  # of all of them
    fresh: DataFrame  # the pairs of this scan


def scan(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> Scan:
    """Scan versions(path, content): only what ledger lacks. Findings and scanned pairs are written tables in the shared
    folder, so a later scan that is given them reads no earlier input."""
    found = written(matches(unseen(distinct_blobs(versions), ledger, rules), rules), "secret-findings")
    blobs = versions.select(blob_of(F.col("content")).alias("blob")).distinct()
    pair = F.explode("todo").alias("pair")
    fresh = unseen(blobs, ledger, rules).select("blob", pair).select("blob", F.substring_index("pair", ":", 1).alias("rule"), F.substring_index("pair", ":", -1).cast("int").alias("version"))
    fresh = written(fresh, "secret-ledger")
    return Scan(fresh if ledger is None else ledger.select("blob", "rule", "version").unionByName(fresh), found if findings is None else findings.select(found.columns).unionByName(found), fresh)


def by_path(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each row of versions: path, blob, and its blob's findings under the rules given, as
    found: array of (start, rank, rule, end) in order. Blobs with findings are few: they are dealt out SALTS times, so
    that a blob of many paths is joined by many tasks."""
    current = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    rank = F.element_at(F.create_map(*(x for r in rules for x in (F.lit(r.kind), F.lit(r.rank)))), F.col("rule"))
    own = findings.where(F.array_contains(current, F.concat_ws(":", "rule", F.col("version").cast("string"))))
    digest = own.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "rule", "end"))).alias("found"))
    salted = digest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = versions.select("path", blob_of(F.col("content")).alias("blob"))
    paths = paths.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    return paths.join(salted, ["blob", "salt"], "left").drop("salt")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as versions of paths named by doc_id, against an empty ledger."""
    versions = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    rows = by_path(versions, scan(versions).findings).withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:int,rule:string,end:bigint>>")))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["rule"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _sql_spans(kind: str, pattern: str, group: int, least: int, rank: int) -> str:
    flags = ", 'i'" if kind == "assign" else ""
    return f"""
  SELECT doc_id, rid, '{kind}' AS kind, {rank} AS rnk, m, g,
         list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, rid, i, found, string_split(regexp_replace(t, '{pattern}', chr(1), 'g{"i" if flags else ""}'), chr(1)) AS pieces,
               found[i] AS m, regexp_extract_all(t, '{pattern}', {group}{flags})[i] AS g
        FROM (SELECT doc_id, rid, t, regexp_extract_all(t, '{pattern}', 0{flags}) AS found, unnest(range(1, 1 + len(regexp_extract_all(t, '{pattern}', 0{flags})))) AS i FROM d))
  WHERE length(g) >= {least}"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
f AS ({_sql_spans("assign", "(password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12, 0)}
  UNION ALL {_sql_spans("access", "AKIA[A-Z0-9]+", 0, 18, 1)}
  UNION ALL {_sql_spans("hex", "[0-9a-f]{16,}", 0, 16, 2)}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || (s::BIGINT + length(m)), ',' ORDER BY s, rnk) AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)"""
