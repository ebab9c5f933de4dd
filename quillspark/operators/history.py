"""Bounded histories of users, their targets, and time-based splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.clean import TIME
from quillspark.operators.ranks import numbers_within, row_numbers


def histories(reviews: DataFrame, most: int = 10, least: int = 4) -> DataFrame:
    """The latest review of each user as the target, with the up to most reviews before it, oldest first.

    A bounded frame over the user's own reviews takes the place of a band self-join.
    """
    order = [F.col(c) for c in [*TIME, "app_id"]]
    before = Window.partitionBy("user_id").orderBy(*order).rowsBetween(-most, -1)
    item = F.struct("app_id", "date", F.col("is_recommended").alias("label"), "hours")
    df = reviews.withColumn("history", F.collect_list(item).over(before)).where("reverse_idx = 1")
    df = df.where(F.size("history") >= least)
    return df.select(
        "user_id",
        F.col("app_id").alias("target_app_id"),
        F.col("date").alias("target_date"),
        F.col("is_recommended").alias("label"),
        F.col("hours").alias("target_hours"),
        F.col("review_id").alias("target_review_id"),
        F.size("history").cast("long").alias("history_len"),
        "history",
    )


def parallel_arrays(df: DataFrame) -> DataFrame:
    """history as the four arrays of the output format."""
    return df.select("*", *[_field("history", f).alias(f"history_{name}") for f, name in (("app_id", "app_ids"), ("date", "dates"), ("label", "labels"), ("hours", "hours"))]).drop("history")


def _field(array: str, field: str):
    """The field of each struct of an array."""
    return F.transform(array, lambda x: x[field])


def boundaries(candidates: DataFrame, shares: tuple[float, float] = (0.8, 0.9)) -> DataFrame:
    """One row: the first dates on which the cumulative share of targets reaches each share, and the totals.

    The window runs over one row for each date.
    """
    by_date = candidates.groupBy("target_date").agg(F.count("*").alias("n"))
    w = by_date.withColumn("cum", F.sum("n").over(Window.orderBy("target_date"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    first = lambda q: F.min(F.when(F.col("cum") >= F.lit(q).cast("decimal(3,2)") * F.col("total"), F.col("target_date")))
    return w.agg(first(shares[0]).alias("val_start"), first(shares[1]).alias("test_start"), F.max("total").alias("total"))


def temporal_split(candidates: DataFrame) -> DataFrame:
    """split by date: no date is in two splits."""
    bounds = F.broadcast(boundaries(candidates))  # one row
    split = F.when(F.col("target_date") < F.col("val_start"), "train").when(F.col("target_date") < F.col("test_start"), "val").otherwise("test")
    return candidates.crossJoin(bounds).withColumn("split", split).drop("val_start", "test_start", "total")


def rank_fraction_split(candidates: DataFrame, shares: tuple[str, str] = ("0.8", "0.9")) -> DataFrame:
    """split by each label's own order of dates; compared in decimals."""
    df = numbers_within(candidates, "label", [F.col("target_date"), F.col("user_id")], "_rank", "_n")
    upto = lambda q: F.col("_rank") <= F.lit(q).cast("decimal(3,2)") * F.col("_n")
    return df.withColumn("split", F.when(upto(shares[0]), "train").when(upto(shares[1]), "val").otherwise("test")).drop("_rank", "_n")


def with_items(samples: DataFrame, items: DataFrame, key: str = "user_id", fields: tuple[str, ...] = ("game_title", "tags", "genres")) -> DataFrame:
    """Target columns (target_*) and parallel history arrays (history_*) from the item dimension."""
    t = items.select(F.col("app_id").alias("target_app_id"), *[F.col(f).alias(f"target_{f}") for f in fields])
    return samples.join(t, "target_app_id", "left").join(gathered(samples, items, key, fields), key, "left")


def gathered(samples: DataFrame, items: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key and the fields of the history's items as parallel arrays (history_*).

    The history is exploded with its positions, joined, and gathered again by the sample's key alone.
    """
    e = samples.select(key, F.posexplode_outer("history").alias("pos", "h")).withColumn("app_id", F.col("h.app_id"))
    e = e.join(items.select("app_id", *fields), "app_id", "left")
    g = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *fields))).alias("_h"))
    return g.select(key, *[_field("_h", f).alias(f"history_{f}") for f in fields])


def with_sample_id(samples: DataFrame, order: list[str], prefix: str = "sample") -> DataFrame:
    """A number in the given order as sample_id, of six digits or more."""
    text = (F.col("_n") - 1).cast("string")
    padded = F.when(F.length(text) < 6, F.lpad(text, 6, "0")).otherwise(text)
    return row_numbers(samples, [F.col(c) for c in order], "_n").withColumn("sample_id", F.concat(F.lit(f"{prefix}_"), padded)).drop("_n")
