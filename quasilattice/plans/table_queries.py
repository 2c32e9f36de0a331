"""The relational operators on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import relational as R
from ..operators.storage import local_table


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def natural_key_merge(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return R.natural_key_merge(e, ["user_id"], ["v"], "event_id", first=["event_type"], order_name="rid").withColumnRenamed("event_type", "first_type")


def merge_conflicts(s: SparkSession, d: str) -> DataFrame:
    return R.merge_conflicts(_t(s, d, "events"), ["user_id"], ["event_type", "props"])


def metatable_counts(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").select(F.when(F.col("value") > 50, F.col("event_type")).alias("event_type"), "props")
    return R.non_null_counts(e, ["event_type", "props"])


def tag_presence(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").select("event_id", "user_id")
    return R.losing_rows(e, e.groupBy("user_id").agg(F.min("event_id").alias("w")), ["user_id"], "w", "event_id").select("event_id", "user_id")


def active_columns(s: SparkSession, d: str) -> DataFrame:
    p = _t(s, d, "part").select(F.when(F.col("p_size") > 999, 1).alias("a"), F.col("p_name").alias("b"))
    return R.active_columns(p, ["a", "b"])


def fk_fill_same_scope(s: SparkSession, d: str) -> DataFrame:
    o = _t(s, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("pr"))
    return R.fill_from(o, o.select("o_custkey", F.col("pr").alias("p")), ["o_custkey"], "pr", "p").select("o_orderkey", "pr")


def fk_chain_two_hops(s: SparkSession, d: str) -> DataFrame:
    c, n, r = _t(s, d, "customer"), _t(s, d, "nation"), _t(s, d, "region")
    return R.chain_lookup(c, [(n, "c_nationkey", "n_nationkey"), (r, "n_regionkey", "r_regionkey")]).select("c_custkey", "r_name")


def stub_parents(s: SparkSession, d: str) -> DataFrame:
    return R.missing_keys(_t(s, d, "events"), _t(s, d, "customer").where("c_acctbal > 0"), [("user_id", "c_custkey")])


def key_stub_per_block(s: SparkSession, d: str) -> DataFrame:
    return R.groups_without(_t(s, d, "documents").select("doc_id", "lang"), _t(s, d, "labels").select(F.col("doc_id").alias("l")), ("doc_id", "l"), "lang", "doc_id", "m")


def upsert_coalesce(s: SparkSession, d: str) -> DataFrame:
    c = _t(s, d, "customer")
    old = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("v"))
    return R.upsert_coalesce(old, c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("k"), F.lit(0.0).alias("v")), ["k"], ["v"])


def insert_ignore(s: SparkSession, d: str) -> DataFrame:
    return R.insert_ignore(_t(s, d, "region").select(F.col("r_regionkey").alias("k")), _t(s, d, "nation").select(F.col("n_nationkey").alias("k")), ["k"])


def keyed_default(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").select("event_id", "event_type")
    lookup = local_table(s, [("click", "c"), ("error", "x")], "k string, dv string")
    return R.keyed_default(e, lookup, "event_type", "k", F.when(F.col("event_type") == "view", "own"), "dv", "v").select("event_id", "v")


def scalar_default(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").select("p_partkey", R.scalar_default(F.when(F.col("p_size") < 25, F.col("p_brand")), "Brand#0").alias("b"))


def su_split(s: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.col("l_partkey").cast("string"), F.lit(".25("), F.col("l_linenumber").cast("string"), F.lit(")"))
    m, su = C.split_su(v)
    return _t(s, d, "lineitem").select("l_partkey", m.alias("m"), su.alias("su"))


def typed_cast(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").select("p_partkey", C.typed(F.replace("p_brand", F.lit("Brand#"), F.lit("")), "Integer").alias("i"), C.typed(F.col("p_name"), "Real").alias("d"))


def json_leaf_cast(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "events").select("event_id", C.to_integer(F.get_json_object("props", "$.k")).alias("k"))


def route_tags(s: SparkSession, d: str) -> DataFrame:
    routes = local_table(s, [("click", "c1"), ("view", "c2")], "event_type string, col string")
    return R.route(_t(s, d, "events").select("event_type"), routes, "event_type").groupBy(F.col("event_type").alias("tag"), F.col("col").isNull().alias("fallback")).agg(F.count(F.lit(1)).alias("n"))


def pivot_loop(s: SparkSession, d: str) -> DataFrame:
    return R.pivot_rows(_t(s, d, "events"), ["user_id"], "event_type", "value", ["click", "view"])


def loop_pad(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "events").select("user_id", F.col("event_type").alias("tag"), F.col("props").alias("v"))
    return R.padded_grid(e, "user_id", "tag", "v", ["click", "view"], "?")


def dedup_first(s: SparkSession, d: str) -> DataFrame:
    return R.keep_edge(_t(s, d, "events"), ["user_id"], "event_id", [])


def dedup_last(s: SparkSession, d: str) -> DataFrame:
    return R.keep_edge(_t(s, d, "events"), ["user_id"], "event_id", [], last=True)


def strip_padding(s: SparkSession, d: str) -> DataFrame:
    return R.strip_padding(_t(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", F.col("role") != "assistant").select("conv_id", "turn")


def dense_row_ids(s: SparkSession, d: str) -> DataFrame:
    return R.dense_ids(_t(s, d, "documents").select("doc_id", "source"), ["source", "doc_id"], "rid", 1000).select("doc_id", "rid")


def name_disambiguation(s: SparkSession, d: str) -> DataFrame:
    return R.number_repeats(_t(s, d, "part").select("p_partkey", "p_name"), "p_name", "p_partkey", "nm").select("p_partkey", "nm")


def sanitize_name(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "pages").select("page_id", C.sanitized(F.col("url")).alias("nm"))


def quote_cif2(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "part").select("p_partkey", C.quoted(F.col("p_name")).alias("tok"))


def dataset_select(s: SparkSession, d: str) -> DataFrame:
    return R.in_any_or_unlisted(_t(s, d, "documents").select("doc_id"), _t(s, d, "labels"), "doc_id", F.col("quality") == 1)


def dataset_intersection(s: SparkSession, d: str) -> DataFrame:
    return R.in_all(_t(s, d, "events"), "event_type", "user_id")


def fingerprint_group(s: SparkSession, d: str) -> DataFrame:
    return R.fingerprint(_t(s, d, "orders"), ["o_custkey"], "o_orderstatus", "fp").groupBy("fp").agg(F.count(F.lit(1)).alias("n"))


def positional_zip(s: SparkSession, d: str) -> DataFrame:
    return R.positional_zip(_t(s, d, "region").select("r_regionkey", "r_name"), _t(s, d, "nation").select("n_nationkey", "n_name"), "r_regionkey", "n_nationkey").select("r", "r_name", "n_name")


def type_contents_check(s: SparkSession, d: str) -> DataFrame:
    rules = [("Word", ~C.contents_ok(F.col("p_name"), "Word")), ("Integer", ~C.contents_ok(F.col("p_brand"), "Integer"))]
    return R.rule_issues(_t(s, d, "part"), ["p_partkey"], rules)


def enum_range_check(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "lineitem").where(~C.in_range(F.col("l_discount"), 0.02, 0.08)).select("l_orderkey", "l_discount")


def enum_states_check(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "orders").where(~C.in_states(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"], fold=True)).select("o_orderkey", "o_orderpriority")


def unknown_tags(s: SparkSession, d: str) -> DataFrame:
    known = local_table(s, [("click",), ("view",)], "tag string")
    tags = _t(s, d, "events").select("event_type").where("event_type IS NOT NULL").distinct()
    return tags.join(known, tags["event_type"] == known["tag"], "left_anti")


def fidelity_multiset_diff(s: SparkSession, d: str) -> DataFrame:
    o = _t(s, d, "orders")
    return R.multiset_difference(o.select("o_custkey", "o_orderstatus"), o.where("o_totalprice > 100000").select("o_custkey", "o_orderstatus"))


def all_blocks_partition(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "orders").groupBy(F.concat(F.lit("orders_"), "o_orderstatus").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    natural_key_merge, merge_conflicts, metatable_counts, tag_presence, active_columns, fk_fill_same_scope, fk_chain_two_hops,
    stub_parents, key_stub_per_block, upsert_coalesce, insert_ignore, keyed_default, scalar_default, su_split, typed_cast,
    json_leaf_cast, route_tags, pivot_loop, loop_pad, dedup_first, dedup_last, strip_padding, dense_row_ids,
    name_disambiguation, sanitize_name, quote_cif2, dataset_select, dataset_intersection, fingerprint_group,
    positional_zip, type_contents_check, enum_range_check,
    enum_states_check, unknown_tags, fidelity_multiset_diff, all_blocks_partition,
)}

ORACLE_SQL: dict[str, str] = {
    "natural_key_merge": r"""SELECT user_id, arg_min(value,event_id) FILTER (WHERE event_type='click') AS v, arg_min(event_type,event_id) AS first_type, min(event_id) AS rid FROM events GROUP BY user_id""",
    "merge_conflicts": r"""SELECT user_id, column_name FROM (SELECT user_id, event_type, props FROM events) UNPIVOT (v FOR column_name IN (event_type, props)) GROUP BY ALL HAVING count(DISTINCT v) > 1""",
    "metatable_counts": r"""SELECT 'event_type' AS col, count(CASE WHEN value>50 THEN event_type END) AS n FROM events UNION ALL SELECT 'props', count(props) FROM events""",
    "tag_presence": r"""SELECT e.event_id, e.user_id FROM events e JOIN (SELECT user_id, min(event_id) AS w FROM events GROUP BY 1) f USING (user_id) WHERE e.event_id <> f.w""",
    "active_columns": r"""SELECT count(CASE WHEN p_size>999 THEN 1 END)>0 AS a, count(p_name)>0 AS b FROM part""",
    "fk_fill_same_scope": r"""SELECT o.o_orderkey, COALESCE(CASE WHEN o.o_orderstatus='F' THEN o.o_orderpriority END, (SELECT min(p.o_orderpriority) FROM orders p WHERE p.o_custkey=o.o_custkey AND p.o_orderstatus='F')) AS pr FROM orders o""",
    "fk_chain_two_hops": r"""SELECT c.c_custkey, r.r_name FROM customer c LEFT JOIN nation n ON n.n_nationkey=c.c_nationkey LEFT JOIN region r ON r.r_regionkey=n.n_regionkey""",
    "stub_parents": r"""SELECT DISTINCT e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey=e.user_id AND c.c_acctbal>0)""",
    "key_stub_per_block": r"""SELECT d.lang, min(d.doc_id) AS m FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id) GROUP BY d.lang""",
    "upsert_coalesce": r"""SELECT COALESCE(a.k,b.k) AS k, COALESCE(a.v,b.v) AS v FROM (SELECT c_custkey AS k, CASE WHEN c_acctbal>0 THEN c_acctbal END AS v FROM customer WHERE c_mktsegment<>'BUILDING') a FULL JOIN (SELECT c_custkey AS k, 0.0 AS v FROM customer WHERE c_mktsegment<>'MACHINERY') b ON a.k=b.k""",
    "insert_ignore": r"""SELECT r_regionkey AS k FROM region UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)""",
    "keyed_default": r"""SELECT e.event_id, COALESCE(CASE WHEN e.event_type='view' THEN 'own' END, d.dv) AS v FROM events e LEFT JOIN (VALUES ('click','c'),('error','x')) d(k,dv) ON d.k=e.event_type""",
    "scalar_default": r"""SELECT p_partkey, COALESCE(CASE WHEN p_size<25 THEN p_brand END,'Brand#0') AS b FROM part""",
    "su_split": r"""SELECT l_partkey, regexp_extract(s,'^([+-]?[0-9.]+)\((\d+)\)$',1) AS m, '0.0'||regexp_extract(s,'\((\d+)\)$',1) AS su FROM (SELECT l_partkey, l_partkey::VARCHAR||'.25('||l_linenumber::VARCHAR||')' AS s FROM lineitem)""",
    "typed_cast": r"""SELECT p_partkey, try_cast(regexp_replace(replace(p_brand,'Brand#',''),'\(\d+\)$','') AS INTEGER) AS i, try_cast(p_name AS DOUBLE) AS d FROM part""",
    "json_leaf_cast": r"""SELECT event_id, try_cast(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events""",
    "route_tags": r"""SELECT e.event_type AS tag, m.col IS NULL AS fallback, count(*) AS n FROM events e LEFT JOIN (VALUES ('click','c1'),('view','c2')) m(tag,col) ON m.tag=e.event_type GROUP BY ALL""",
    "pivot_loop": r"""SELECT user_id, max(value) FILTER (WHERE event_type='click') AS click, max(value) FILTER (WHERE event_type='view') AS view FROM events GROUP BY user_id""",
    "loop_pad": r"""SELECT u.user_id, t.t AS tag, COALESCE(min(e.props),'?') AS v FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('click'),('view')) t(t) LEFT JOIN events e ON e.user_id=u.user_id AND e.event_type=t.t GROUP BY ALL""",
    "dedup_first": r"""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id)=1""",
    "dedup_last": r"""SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1""",
    "strip_padding": r"""SELECT e.conv_id, e.turn FROM conversations e JOIN (SELECT conv_id, max(turn) FILTER (WHERE role<>'assistant') AS last FROM conversations GROUP BY 1) m USING (conv_id) WHERE e.turn<=m.last""",
    "dense_row_ids": r"""SELECT doc_id, 1000+row_number() OVER (ORDER BY source, doc_id) AS rid FROM documents""",
    "name_disambiguation": r"""SELECT p_partkey, CASE WHEN r>1 THEN p_name||'_'||r ELSE p_name END AS nm FROM (SELECT p_partkey,p_name,row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) r FROM part)""",
    "sanitize_name": r"""SELECT page_id, trim(regexp_replace(regexp_replace(url,'[^a-zA-Z0-9_]','_','g'),'_+','_','g'),'_') AS nm FROM pages""",
    "quote_cif2": r"""SELECT p_partkey, CASE WHEN p_name NOT LIKE '% %' THEN p_name WHEN p_name NOT LIKE '%''%' THEN ''''||p_name||'''' ELSE '"'||p_name||'"' END AS tok FROM part""",
    "dataset_select": r"""SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id AND l.quality=1) OR NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id)""",
    "dataset_intersection": r"""SELECT event_type FROM events GROUP BY 1 HAVING count(DISTINCT user_id)=(SELECT max(c) FROM (SELECT count(DISTINCT user_id) c FROM events GROUP BY event_type))""",
    "fingerprint_group": r"""SELECT fp, count(*) AS n FROM (SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS fp FROM orders GROUP BY o_custkey) GROUP BY fp""",
    "positional_zip": r"""SELECT COALESCE(a.r, b.r) AS r, a.r_name, b.n_name FROM (SELECT row_number() OVER (ORDER BY r_regionkey) r, r_name FROM region) a FULL JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) r, n_name FROM nation) b ON a.r=b.r""",
    "type_contents_check": r"""SELECT p_partkey, 'Word' AS chk FROM part WHERE regexp_matches(p_name,'\s') UNION ALL SELECT p_partkey,'Integer' FROM part WHERE NOT regexp_full_match(p_brand,'[+-]?\d+')""",
    "enum_range_check": r"""SELECT l_orderkey, l_discount FROM lineitem WHERE l_discount<0.02 OR l_discount>0.08""",
    "enum_states_check": r"""SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(o_orderpriority) NOT IN ('1-urgent','2-high')""",
    "unknown_tags": r"""SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click','view')""",
    "fidelity_multiset_diff": r"""SELECT 'a' AS side, * FROM (SELECT o_custkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice>100000) UNION ALL SELECT 'b', * FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice>100000 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders)""",
    "all_blocks_partition": r"""SELECT 'orders_'||o_orderstatus AS block, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1""",
}
