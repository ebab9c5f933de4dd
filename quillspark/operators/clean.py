"""Cleaning: validity, latest row of each pair, users with enough items, first rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ["user_id", "app_id", "date", "is_recommended", "hours"]
#: A total order of a user's reviews; the columns after review_id break ties.
TIME = ["date", "review_id", "ship_date", "price"]


def valid(df: DataFrame) -> DataFrame:
    """No nulls in the required columns, hours finite and not negative."""
    return df.na.drop(subset=REQUIRED).where(~F.isnan("hours") & (F.col("hours") >= 0) & (F.col("hours") < float("inf")))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of the given columns. One shuffle, none if df is dealt by some of the keys;
    Spark sorts by the keys for it, as it keeps structs in no hash aggregate, but by nothing else, and partial maxima shrink
    the groups first. The struct that is compared holds the row, so that no column is kept twice; ties go on to the other columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    if any("map<" in t or t == "variant" for c, t in df.dtypes if c in rest):  # have no order
        best = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("row")
    else:
        best = F.max(F.struct(*order, *rest)).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*").select(*df.columns)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def removal_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (rows, kept, removed): what first_of takes off. Rows are counted by key first, so that no key is one task."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("kept")).select("rows", "kept", (F.col("rows") - F.col("kept")).alias("removed"))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def cleaned(df: DataFrame) -> DataFrame:
    """Valid reviews, the latest of each user and item."""
    return latest(valid(df), ["user_id", "app_id"], TIME)


def with_sequence(df: DataFrame, least: int = 5) -> DataFrame:
    """Users with at least least items; each review's number and its number from the end. All from one partitioning by user."""
    w = Window.partitionBy("user_id")
    time = [F.col(c) for c in [*TIME, "app_id"]]
    df = df.withColumn("user_interaction_count", F.count("*").over(w)).where(F.col("user_interaction_count") >= least)
    df = df.withColumn("user_interaction_idx", F.row_number().over(w.orderBy(*time)))
    return df.withColumn("reverse_idx", F.col("user_interaction_count").cast("int") - F.col("user_interaction_idx") + 1)
