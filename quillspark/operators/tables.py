"""Joins that attach columns, reshaping, audits, and answers as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.ranks import row_numbers


def attach(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join by key of those columns of right that left does not have."""
    return left.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key, "left")


def beside(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """The k-th row of left with the k-th of right; raises unless both have as many rows."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows can't be put beside {m}")
    names = [c for c in right.columns if c not in left.columns]
    a, b = row_numbers(left, left_order, "_k"), row_numbers(right, right_order, "_k").select("_k", *names)
    return a.join(b, "_k").drop("_k")


def attach_by_index(left: DataFrame, key: str, right: DataFrame, index: str) -> DataFrame:
    """Left join of a key with a table's index column of another name, which does not come along."""
    names = [c for c in right.columns if c != index]
    clash = [c for c in names if c in left.columns]
    if clash:
        raise ValueError(f"on both sides: {clash}")
    return left.join(right.select(F.col(index).alias("_index"), *names), F.col(key) == F.col("_index"), "left").drop("_index")


def merge_samples(left: DataFrame, right: DataFrame, key: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Features joined by key where right has it, else by position in the given orders, if the numbers of rows are equal."""
    return attach(left, right, key) if key in right.columns else beside(left, right, left_order, right_order)


def pivoted(long: DataFrame, index: str, column: str, value: str, names: list[str]) -> DataFrame:
    """One row for each index, with the value of each name as a column."""
    return long.groupBy(index).pivot(column, names).agg(F.first(value, ignorenulls=True))


def answer_number(text: Column, strict: bool = False) -> Column:
    """1 for an answer that begins with yes, 0 for one that begins with no; else 0, or an error if strict."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    other = F.raise_error(F.concat(F.lit("no answer: "), low)).cast("int") if strict else F.lit(0)
    return F.when(low.startswith("yes"), 1).when(low.startswith("no"), 0).otherwise(other)


def as_list(c: Column, kind: T.DataType) -> Column:
    """An array as it is, null as an empty one, and any other value as an array of it."""
    if isinstance(kind, T.ArrayType):
        return F.coalesce(c, F.array().cast(kind))
    return F.when(c.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(c))


def item_text(retrieval: Column | None, parts: dict[str, Column], long: tuple[str, ...] = ("description", "short_description", "about_the_game")) -> Column:
    """The retrieval text, at most 1200 characters, else 'name: value' parts joined by ' | ', at most 1500; blank parts are left out."""
    tidy = lambda c, n: F.substring(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, n)
    shown = []
    for name, c in parts.items():
        value = tidy(c, 700 if name in long else 300)
        shown.append(F.when(value != "", F.concat(F.lit(f"{name}: "), value)))
    built = F.substring(F.concat_ws(" | ", *shown), 1, 1500)
    return built if retrieval is None else F.coalesce(F.nullif(tidy(retrieval, 1200), F.lit("")), built)


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, rows, nulls) of every column of several tables, one scan of each."""
    out = None
    for name, df in tables.items():
        nulls = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.count_if(F.col(c).isNull()).alias("nulls")) for c, t in df.dtypes])
        one = df.agg(F.count("*").alias("rows"), nulls.alias("c")).select(F.lit(name).alias("table"), "rows", F.explode("c").alias("c")).select("table", "c.column", "c.type", "rows", "c.nulls")
        out = one if out is None else out.unionByName(one)
    return out


def audit_document(audited: DataFrame) -> DataFrame:
    """The audit as one JSON document per table."""
    columns = F.sort_array(F.collect_list(F.struct("column", "type", "nulls")))
    return audited.groupBy("table").agg(F.max("rows").alias("rows"), columns.alias("columns")).select("table", F.to_json(F.struct("rows", "columns")).alias("document"))
