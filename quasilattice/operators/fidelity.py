"""Whether two sources say the same: both are loaded, rows normalised, and multisets compared both ways."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.values import canonical_real
from ..plans.dictionary import DictionaryLoader, load_dictionary
from ..plans.schema import ID, Schema, Table, generate_schema
from ..sources.model import CifFile, build
from . import relational as R
from .ingest import Dataset, IngestionError, ingest
from .storage import local_table

MISMATCHES = "kind string, side string, table_name string, detail string"
SHOWN = 200


@dataclass
class FidelityReport:
    passed: bool
    mismatches: list = field(default_factory=list)  # rows of MISMATCHES, in order; at most SHOWN in all
    frame: DataFrame | None = None  # all of them
    total: int = 0  # how many there are


def load_source(source: str | Path | CifFile) -> tuple[CifFile, list]:
    """A model, a path, or text (which has several lines)."""
    if isinstance(source, CifFile):
        return source, []
    if isinstance(source, Path) or "\n" not in source:
        source = Path(source).read_text(encoding="utf-8")
    return build(source)


def load_schema(schema: Schema | str | Path | None) -> Schema | None:
    if schema is None or isinstance(schema, Schema):
        return schema
    path = Path(schema)
    dictionary = load_dictionary(str(path)) if path.suffix == ".json" else DictionaryLoader().load(path.read_text(encoding="utf-8"), base_uri=path.name)
    return generate_schema(dictionary)


def generated(a: Dataset, b: Dataset) -> set[tuple[str, str]]:
    """Columns that hold keys made on loading, in either source, and links to them: they say nothing."""
    out: set[tuple[str, str]] = set()
    for data in (a, b):
        for t, df in data.tables.items():
            keys = data.schema.tables[t].keys
            if keys:
                flags = df.agg(*(F.bool_or(C.is_uuid(F.col(k))).alias(k) for k in keys)).first()
                out |= {(t, k) for k in keys if flags[k]}
    schema = a.schema
    for t in schema.tables.values():
        for key in t.foreign_keys:
            out |= {(t.name, s) for s, g in zip(key.source_columns, key.target_columns, strict=True) if (key.target_table, g) in out}
    return out


def normalised(df: DataFrame, table: Table, dropped: set[tuple[str, str]]) -> DataFrame:
    """One JSON text a row: non-null values that aren't placeholders, numbers in canonical form. Rows without any are left out."""
    # Spark runs the function on all rows, whatever the condition around it.
    canonical = F.udf(lambda v: None if v is None else canonical_real(v), "string", useArrow=True)
    canonical_su = F.udf(lambda v: None if v is None else canonical_real(v, True), "string", useArrow=True)
    cells = []
    for c in table.columns:
        if c.is_synthetic or c.name == ID or (table.name, c.name) in dropped or c.name not in df.columns:
            continue
        x = F.when(~C.is_sentinel(F.col(c.name)), F.col(c.name))
        if c.type_contents == "Real" and (c.type_container or "Single") == "Single":
            x = F.when(x.isNotNull(), (canonical_su if c.is_su else canonical)(x))
        cells.append(x.alias(c.name))
    if not cells:
        return df.sparkSession.createDataFrame([], "row string")
    return df.select(F.to_json(F.struct(*cells)).alias("row")).where("row <> '{}'")


def compare_tables(a: Dataset, b: Dataset) -> list[DataFrame]:
    spark, dropped, out = a.spark, generated(a, b), []
    for t, table in a.schema.tables.items():
        have = [t in a.tables, t in b.tables]
        if not any(have):
            continue
        rows = [normalised(d.tables[t], table, dropped) if t in d.tables else spark.createDataFrame([], "row string") for d in (a, b)]
        if have[0] != have[1]:
            side = "a" if have[0] else "b"
            if not rows[0 if have[0] else 1].isEmpty():
                out.append(spark.createDataFrame([("table_missing", side, t, f"only {side} has rows of {t}")], MISMATCHES))
            continue
        out.append(R.multiset_difference(*rows).select(F.lit("row_content").alias("kind"), "side", F.lit(t).alias("table_name"), F.col("row").alias("detail")))
    return out


def compare_fallback(a: Dataset, b: Dataset) -> DataFrame:
    """Values of unknown tags: differing counts, and equal ones whose kind differs."""
    counts = None
    for side, data in (("a", a), ("b", b)):
        x = data.infra["fallback"].select(F.lit(side).alias("side"), "tag", "value", "value_type")
        counts = x if counts is None else counts.unionByName(x)
    is_ = lambda s: F.when(F.col("side") == s, 1)
    typed = counts.groupBy("tag", "value", "value_type").agg(F.count(is_("a")).alias("n_a"), F.count(is_("b")).alias("n_b"))
    plain = typed.groupBy("tag", "value").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.max(F.col("n_a") != F.col("n_b")).alias("kinds"))
    odd = plain.where("n_a <> n_b OR kinds")
    kind = F.when(F.col("n_a") != F.col("n_b"), "fallback_mismatch").otherwise("value_type")
    side = F.when(F.col("n_a") > F.col("n_b"), "a").when(F.col("n_a") < F.col("n_b"), "b").otherwise("both")
    return odd.select(kind.alias("kind"), side.alias("side"), F.lit(None).cast("string").alias("table_name"), F.concat_ws(" ", "tag", F.concat(F.lit("a:"), F.col("n_a").cast("string")), F.concat(F.lit("b:"), F.col("n_b").cast("string")), "value").alias("detail"))


def compare_places(a: Dataset, b: Dataset) -> DataFrame:
    """Tags that one source has in the fallback and the other in a table."""
    out = a.spark.createDataFrame([], MISMATCHES)
    for side, x, y in (("a", a, b), ("b", b, a)):
        known = local_table(a.spark, [(tag, t) for (t, _), tag in y.schema.column_to_tag.items() if t in y.tables], "tag string, table_name string")
        hit = x.infra["fallback"].select("tag").distinct().join(known, "tag").join(y.infra["fallback"].select("tag").distinct(), "tag", "left_anti")
        out = out.unionByName(hit.select(F.lit("schema_mismatch").alias("kind"), F.lit(side).alias("side"), "table_name", F.concat(F.col("tag"), F.lit(" is in the fallback of this source only")).alias("detail")))
    return out


def check_fidelity(a: str | Path | CifFile, b: str | Path | CifFile, schema: Schema | str | Path | None = None, *, spark: SparkSession | None = None, report_file: str | None = None) -> FidelityReport:
    """Parse errors end the comparison; loading errors too."""
    spark, schema = spark or SparkSession.getActiveSession(), load_schema(schema)
    loaded, early = [], []
    for side, source in (("a", a), ("b", b)):
        cif, errors = load_source(source)
        early += [("parse_error", side, None, f"line {e.line}: {e.message}") for e in errors if e.kind != "warning"]
        loaded.append(cif)
    if not early:
        data = []
        for side, cif in zip("ab", loaded, strict=True):
            try:
                data.append(ingest(cif, schema, spark=spark))
            except IngestionError as e:
                early.append(("ingest_error", side, None, str(e)))
    if early:
        frame = spark.createDataFrame(early, MISMATCHES)
    else:
        frame = compare_fallback(*data).unionByName(compare_places(*data))
        for f in compare_tables(*data):
            frame = frame.unionByName(f)
    shown = frame.orderBy("kind", "table_name", "side", "detail").limit(SHOWN).collect()
    report = FidelityReport(not shown, shown, frame, frame.count() if len(shown) == SHOWN else len(shown))
    if report_file:
        Path(report_file).write_text(format_report(report), encoding="utf-8")
    return report


def nearest_row(row: dict, others: list[dict]) -> list[str]:
    """Up to three differences from the most similar of other rows."""
    if not others:
        return []
    best = max(others, key=lambda o: sum(row.get(k) == v for k, v in o.items()))
    keys = sorted(set(row) | set(best))
    return [f"{k}: {row.get(k)!r} / {best.get(k)!r}" for k in keys if row.get(k) != best.get(k)][:3]


def format_report(report: FidelityReport) -> str:
    import json

    lines = ["equal" if report.passed else f"{max(report.total, len(report.mismatches))} differences" + (f" (the first {len(report.mismatches)} are listed)" if report.total > len(report.mismatches) else "")]
    rows = [m for m in report.mismatches if m["kind"] == "row_content"]
    for m in report.mismatches:
        lines.append(f"{m['kind']} [{m['side']}] {m['table_name'] or ''} {m['detail']}".rstrip())
        if m["kind"] == "row_content" and m["side"] == "a":
            others = [json.loads(o["detail"]) for o in rows if o["side"] == "b" and o["table_name"] == m["table_name"]]
            lines += [f"    {d}" for d in nearest_row(json.loads(m["detail"]), others)]
    return "\n".join(lines) + "\n"


__all__ = ["FidelityReport", "check_fidelity", "compare_fallback", "compare_places", "compare_tables", "format_report", "nearest_row", "normalised"]
