"""Profiles of tables: counts, quantiles, nulls, coverage, balance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import evaluate


def null_report(df: DataFrame) -> DataFrame:
    """(column, nulls, share) of every column, from one aggregate."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns])).alias("x"))
    return long.select("x.column", "x.nulls", F.coalesce(F.try_divide(F.col("x.nulls"), F.col("_n")), F.lit(0.0)).alias("share"))


def nulls_present(df: DataFrame) -> DataFrame:
    """null_report of the columns that have nulls."""
    return null_report(df).where("nulls > 0")


def most_null(df: DataFrame, n: int) -> DataFrame:
    """(place, column, share) of the n columns with the largest shares of nulls, equal ones by name; one row for each column."""
    place = F.row_number().over(Window.orderBy(F.desc("share"), "column"))
    return null_report(df).select(place.alias("place"), "column", "share").where(F.col("place") <= n)


def weighted_null_share(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    one = df.agg(*[(F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col(weight))), F.lit(0)) / F.sum(weight)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("share")) for c in columns])).alias("x")).select("x.*")


def coverage(keys: DataFrame, other: DataFrame, key: str, weight: str) -> DataFrame:
    """How many keys, and how much of their weight, are in other."""
    flagged = keys.join(other.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    return flagged.agg(F.count("*").alias("n_keys"), F.count_if(F.col("_in")).alias("covered"), F.sum(weight).alias("weight"), F.coalesce(F.sum(F.when(F.col("_in"), F.col(weight))), F.lit(0)).alias("covered_weight"))


def percent_of_total(df: DataFrame, *keys: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def describe(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of each group; the quartiles by distributed selection."""
    plain = df.groupBy(*by).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    found = evaluate.exact_quantiles(df, value, list(names), list(by))
    wide = found.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(n) for q, n in names.items()])
    same = reduce(lambda x, z: x & z, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else F.lit(True)
    return plain.join(wide, same, "left").select(*by, "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def label_balance(df: DataFrame, label: str, *by: str) -> DataFrame:
    y = F.col(label).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(y).alias("positives"), F.avg(y.cast("double")).alias("rate"))


def crosstab(df: DataFrame, rows: str, column: str, values: list) -> DataFrame:
    return df.groupBy(rows).pivot(column, values).count().na.fill(0)


def schema_preview(df: DataFrame, most: int = 500, order: list | None = None) -> DataFrame:
    """(column, type, value): each column's type and its value in the first row of the order (any row without one); of more than most characters the first ones and '...'."""
    row = df.orderBy(*order).limit(1) if order else df.limit(1)
    text = {c: F.col(c).cast("string") for c in df.columns}
    first = row.select(*[F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s).alias(c) for c, s in text.items()])
    return first.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c).alias("value")) for c, t in df.dtypes])).alias("x")).select("x.*")
