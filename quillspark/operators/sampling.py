"""Deterministic samples: every draw is a rank by md5 of a salted key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.ranks import numbers_within


def drawn(key: str, salt: str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(salt)))


def ranked(df: DataFrame, strata: list[str], key: str, salt: str) -> DataFrame:
    return df.withColumn("sample_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(drawn(key, salt), key)))


def quota_sample(df: DataFrame, quotas: dict[str, int], column: str, strata: list[str], key: str, salt: str) -> DataFrame:
    """Up to quotas[value of column] rows of each stratum. The bound over all quotas lets Spark cut the sort short."""
    keep = None
    for value, n in quotas.items():
        one = (F.col(column) == value) & (F.col("sample_rank") <= n)
        keep = one if keep is None else keep | one
    return ranked(df, strata, key, salt).where((F.col("sample_rank") <= max(quotas.values())) & keep)


def availability(df: DataFrame, quotas: dict[str, int], column: str, label: str) -> DataFrame:
    """(column, label, quota, available, enough) of every cell that the quotas name; empty cells count as 0."""
    grid = df.sparkSession.createDataFrame([(v, b, n) for v, n in quotas.items() for b in (False, True)], f"{column} string, {label} boolean, quota long")
    found = grid.join(df.groupBy(column, label).agg(F.count("*").alias("n")), [column, label], "left")
    return found.select(column, label, "quota", F.coalesce("n", F.lit(0)).alias("available"), (F.coalesce("n", F.lit(0)) >= F.col("quota")).alias("enough"))


def check_available(df: DataFrame, quotas: dict[str, int], column: str, label: str) -> None:
    """Raises if a cell of (column, label) has fewer rows than its quota."""
    short = availability(df, quotas, column, label).where("NOT enough").collect()  # two rows at most for each quota
    if short:
        raise ValueError(f"too few rows: {[tuple(r) for r in short]}")


def balanced(df: DataFrame, label: str, n: int, key: str, seed: str) -> DataFrame:
    """n rows of each class, or all if fewer."""
    return ranked(df, [label], key, seed).where(F.col("sample_rank") <= n)


def strict(df: DataFrame, label: str, n: int, key: str, seed: str) -> DataFrame:
    """n rows of each class; raises if a class has fewer."""
    few = [tuple(r) for r in df.groupBy(label).count().where(F.col("count") < n).collect()]  # a row for each class
    if few:
        raise ValueError(f"too few rows: {few}")
    return balanced(df, label, n, key, seed)


def nested(df: DataFrame, label: str, n: int, inner: int, key: str, seed: int) -> DataFrame:
    """A balanced sample of a balanced sample, the inner one drawn with the next seed."""
    outer = balanced(df, label, n, key, f"seed{seed}").drop("sample_rank")
    return balanced(outer, label, inner, key, f"seed{seed + 1}")


def remaining(df: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key isn't taken yet."""
    return df.join(taken.select(key).distinct(), key, "left_anti")


def chunk(df: DataFrame, label: str, n: int, k: int, key: str, seed: str) -> DataFrame:
    """The k-th chunk (from 1) of n rows of each class; chunks are disjoint."""
    return ranked(df, [label], key, seed).where((F.col("sample_rank") > (k - 1) * n) & (F.col("sample_rank") <= k * n))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> int:
    return a.join(b.select(key), key, "left_semi").count()


def folds(df: DataFrame, label: str, k: int, key: str, seed: str) -> DataFrame:
    """fold from 0 to k - 1, stratified by label."""
    numbered = numbers_within(df.withColumn("_d", F.unhex(drawn(key, seed))), label, [F.col("_d"), F.col(key)], "_rank", "_n", df.columns)
    return numbered.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_n")


def matching(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")
