"""Relational operators: pure functions of DataFrames and column names.

The loader, the default filler, the validator and the comparison are built of these, and so are the registered queries.
All are plain Catalyst plans: no Python runs on rows and nothing is collected. Where the order of rows matters it is an
explicit column; ties make the smallest value win, so results don't depend on the number of partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

Names = Sequence[str]


# ---- merging


def first_non_null(value: str | Column, order: str | Column) -> Column:
    """The first non-null value by order: one aggregate, no window. Spark hashes numbers for it and sorts text."""
    value = F.col(value) if isinstance(value, str) else value
    order = F.col(order) if isinstance(order, str) else order
    return F.min_by(value, F.when(value.isNotNull(), order))


def natural_key_merge(df: DataFrame, keys: Names, values: Names, order: str, first: Names = (), order_name: str | None = None) -> DataFrame:
    """A row for each key: of `values` the first non-null, of `first` the value of the first row, and the smallest order."""
    picks = [first_non_null(v, order).alias(v) for v in values] + [F.min_by(c, order).alias(c) for c in first]
    return df.groupBy(*keys).agg(*picks, F.min(order).alias(order_name or order))


def merge_conflicts(df: DataFrame, keys: Names, values: Names) -> DataFrame:
    """(keys, column_name) with more than one distinct non-null value. Distinct values are counted without a text shuffle
    beyond the partial aggregate's."""
    long = unpivot_values(df, keys, values).where(F.col("value").isNotNull())
    return long.groupBy(*keys, "column_name").agg(F.count_distinct("value").alias("n")).where("n > 1").drop("n")


def unpivot_values(df: DataFrame, ids: Names, values: Names) -> DataFrame:
    """ids, column_name, value: nulls stay, values as strings."""
    typed = df.select(*ids, *(F.col(v).cast("string").alias(v) for v in values))
    return typed.unpivot(list(ids), list(values), "column_name", "value")


def non_null_counts(df: DataFrame, columns: Names, name: str = "col", count: str = "n") -> DataFrame:
    """A row for each column: one pass over df."""
    one = df.agg(*(F.count(c).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).alias(count)) for c in columns))).alias("x")).select("x.*")


def active_columns(df: DataFrame, columns: Names) -> DataFrame:
    """One row: which columns have a non-null value."""
    return df.agg(*((F.count(c) > 0).alias(c) for c in columns))


def losing_rows(staged: DataFrame, final: DataFrame, keys: Names, winner: str, own: str) -> DataFrame:
    """Staged rows of a key whose winner is another row or block."""
    return staged.join(final.select(*keys, F.col(winner).alias("_winner")), list(keys)).where(F.col(own) != F.col("_winner")).drop("_winner")


def tag_presence(staged: DataFrame, keys: Names, block: str, values: Names) -> DataFrame:
    """(block, column_name, pk_json): the cells that each block contributed to keys of more than one block."""
    shared = staged.groupBy(*keys).agg(F.min(block).alias("_a"), F.max(block).alias("_b")).where("_a <> _b").select(*keys)
    rows = staged.join(shared, list(keys), "left_semi").withColumn("pk_json", key_json(keys))
    return unpivot_values(rows, [block, "pk_json"], values).where(F.col("value").isNotNull()).select(block, "column_name", "pk_json").distinct()


def key_json(keys: Names) -> Column:
    return F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))


# ---- filling


def fill_from(df: DataFrame, parent: DataFrame, on: Names, target: str, source: str, order: Column | None = None) -> DataFrame:
    """df with null `target` filled from the first non-null `source` of parent's rows with equal `on` values."""
    pick = F.min(source) if order is None else F.min_by(source, F.when(F.col(source).isNotNull(), order))
    found = parent.groupBy(*on).agg(pick.alias("_found"))
    return df.join(found, list(on), "left").withColumn(target, F.coalesce(F.col(target), F.col("_found"))).drop("_found")


def fill_scopes(df: DataFrame, parent: DataFrame, scopes: Sequence[tuple[Names, Column | None]], target: str, source: str, order: Column) -> DataFrame:
    """Several fills, the narrowest scope first: each is (columns to join on, condition on parent)."""
    for on, condition in scopes:
        df = fill_from(df, parent if condition is None else parent.where(condition), on, target, source, order)
    return df


def chain_lookup(df: DataFrame, hops: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins one after the other: each hop is (table, df's column, table's key)."""
    for table, left, right in hops:
        df = df.join(table, df[left] == table[right], "left")
    return df


def keyed_default(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, value: Column, default: str, name: str) -> DataFrame:
    """value, or where it is null the lookup's default for the key. The lookup is a dictionary's table: Spark broadcasts it
    if it is as small as it should be, and joins by shuffle if not."""
    return df.join(lookup, df[key] == lookup[lookup_key], "left").withColumn(name, F.coalesce(value, lookup[default]))


def scalar_default(value: Column, default: object) -> Column:
    return F.coalesce(value, F.lit(default))


# ---- stubs and upserts


def missing_keys(child: DataFrame, parent: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct non-null foreign keys of child that parent lacks."""
    present = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c, _ in pairs))
    wanted = child.where(present).select(*(c for c, _ in pairs)).distinct()
    return wanted.join(parent, reduce(lambda a, b: a & b, (wanted[c] == parent[p] for c, p in pairs)), "left_anti")


def groups_without(df: DataFrame, other: DataFrame, on: tuple[str, str], by: str, order: str, name: str) -> DataFrame:
    """Of rows without a partner in other: each group's smallest order."""
    return df.join(other, df[on[0]] == other[on[1]], "left_anti").groupBy(by).agg(F.min(order).alias(name))


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: Names, values: Names) -> DataFrame:
    """Full outer join by key; old values win where they aren't null."""
    a, b = old.alias("old"), new.alias("new")
    on = reduce(lambda x, y: x & y, (F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys))
    return a.join(b, on, "full_outer").select(*(F.coalesce(f"old.{c}", f"new.{c}").alias(c) for c in (*keys, *values)))


def insert_ignore(old: DataFrame, new: DataFrame, keys: Names) -> DataFrame:
    """old and those rows of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


# ---- routing, pivots, grids


def route(df: DataFrame, routes: DataFrame, on: str) -> DataFrame:
    """df with the route of its tag, null if it has none. routes should be a relation of known size (storage.local_table): then
    Spark broadcasts it if it is small, and df isn't shuffled by its few tags."""
    return df.join(routes, on, "left")


def pivot_rows(df: DataFrame, ids: Names, column: str, value: str | Column, known: Names, order: str | None = None) -> DataFrame:
    """Long to wide with known columns: one aggregate, no pass to find them."""
    value = F.col(value) if isinstance(value, str) else value
    def cell(k: str) -> Column:
        own = F.when(F.col(column) == k, value)
        return (F.max(own) if order is None else first_non_null(own, order)).alias(k)
    return df.groupBy(*ids).agg(*(cell(k) for k in known))


def padded_grid(df: DataFrame, row: str, column: str, value: str, known: Names, pad: str) -> DataFrame:
    """Every known column for every row; missing cells get pad."""
    wide = df.groupBy(row).agg(*(F.min(F.when(F.col(column) == k, F.col(value))).alias(k) for k in known))
    return wide.unpivot([row], list(known), column, value).withColumn(value, F.coalesce(value, F.lit(pad)))


def last_filled(df: DataFrame, by: Names, order: str, filled: Column) -> DataFrame:
    """The largest order with a filled row, for each group that has one."""
    return df.groupBy(*by).agg(F.max(F.when(filled, F.col(order))).alias("_last"))


def strip_padding(df: DataFrame, by: Names, order: str, filled: Column) -> DataFrame:
    """Rows up to the last filled one of their group."""
    return df.join(last_filled(df, by, order, filled), list(by)).where(F.col(order) <= F.col("_last")).drop("_last")


# ---- order


def keep_edge(df: DataFrame, by: Names, order: str, values: Names, last: bool = False) -> DataFrame:
    """The first (or last) row of each group, by aggregation: no window, no sort."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in values if c != order]
    return df.groupBy(*by).agg((F.max if last else F.min)(order).alias(order), *(pick(c, order).alias(c) for c in rest))


def dense_ids(df: DataFrame, order: Names, name: str, start: int = 0) -> DataFrame:
    """start + 1, + 2, ... in a total order, without gathering rows in one task: rows are dealt out by range and written
    with their part; parts are numbered inside, and a running sum over the parts' sizes (a row a part) gives offsets."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(before, "_part").withColumn(name, F.lit(start) + F.col("_before") + at).drop("_part", "_before")


def number_repeats(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """The second and later rows of a name get _2, _3, ..."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 1, F.concat_ws("_", by, F.col("_n").cast("string"))).otherwise(F.col(by))).drop("_n")


def positional_zip(a: DataFrame, b: DataFrame, order_a: str, order_b: str, name: str = "r") -> DataFrame:
    """Rows side by side, by position."""
    return dense_ids(a, [order_a], name).join(dense_ids(b, [order_b], name), name, "full_outer")


# ---- sets


def in_any_or_unlisted(df: DataFrame, members: DataFrame, on: str, wanted: Column) -> DataFrame:
    """Rows with a wanted member, and rows without any member: one join with the members' flags."""
    flags = members.groupBy(on).agg(F.max(F.when(wanted, 1).otherwise(0)).alias("_wanted"))
    return df.join(flags, on, "left").where(F.coalesce("_wanted", F.lit(1)) == 1).drop("_wanted")


def in_all(df: DataFrame, item: str, of: str) -> DataFrame:
    """Items that occur with as many distinct `of` as the most widespread item."""
    counts = df.groupBy(item).agg(F.count_distinct(of).alias("_n"))
    return counts.where(F.col("_n") == counts.agg(F.max("_n")).scalar()).select(item)


def fingerprint(df: DataFrame, by: Names, value: str, name: str) -> DataFrame:
    """The sorted distinct values of each group as one string."""
    return df.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_set(value)), ",").alias(name))


def multiset_difference(a: DataFrame, b: DataFrame, side: str = "side") -> DataFrame:
    """EXCEPT ALL both ways, by one aggregate of signed counts."""
    columns = a.columns
    both = a.select(*columns, F.lit(1).alias("_d")).unionAll(b.select(*columns, F.lit(-1).alias("_d")))
    net = both.groupBy(*columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    rows = net.withColumn("_i", F.explode(F.sequence(F.lit(1), F.abs("_d").cast("int"))))
    return rows.select(F.when(F.col("_d") > 0, "a").otherwise("b").alias(side), *columns)


# ---- checks


def repeated_groups(df: DataFrame, by: Names, most: int = 1) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)


def rule_issues(df: DataFrame, ids: Names, rules: Sequence[tuple[str, Column]], name: str = "chk") -> DataFrame:
    """A row for each broken rule: one pass, whatever the number of rules."""
    flags = F.array(*(F.when(broken, F.lit(rule)) for rule, broken in rules))
    return df.select(*ids, F.explode(F.filter(flags, lambda x: x.isNotNull())).alias(name))


def pattern_counts(df: DataFrame, by: Names, value: str, pattern: str) -> DataFrame:
    """For each group: how many values don't match, and how many rows it has."""
    return df.groupBy(*by).agg(F.count_if(~F.col(value).rlike(pattern)).alias("bad"), F.count(F.lit(1)).alias("total"))
