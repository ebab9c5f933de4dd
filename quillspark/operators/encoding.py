"""Popularity and target encodings of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.stage import staged


def popularity(train: DataFrame, item: str = "app_id", label: str = "label") -> DataFrame:
    y = F.col(label).cast("int")
    return train.groupBy(item).agg(F.sum(y).alias("positives"), F.count("*").alias("n")).withColumn("rate", F.col("positives") / F.col("n"))


def prior(train: DataFrame, label: str = "label") -> DataFrame:
    """One row: the share of positives."""
    return train.agg(F.avg(F.col(label).cast("double")).alias("prior"))


def encode(df: DataFrame, train: DataFrame, item: str = "app_id", label: str = "label", alpha: float = 10.0) -> DataFrame:
    """item_score = (positives + alpha * prior) / (n + alpha) and item_log_count = ln(1 + n) of train; unseen items: prior and 0."""
    stats = popularity(train, item, label).select(item, "positives", F.col("n").alias("_n"))
    p = F.broadcast(prior(train, label))  # one row
    out = df.join(stats, item, "left").crossJoin(p)
    n = F.coalesce("_n", F.lit(0))
    score = (F.coalesce("positives", F.lit(0)) + alpha * F.col("prior")) / (n + alpha)
    return out.withColumn("item_score", F.when(F.col("_n").isNull(), F.col("prior")).otherwise(score)).withColumn("item_log_count", F.log1p(n)).drop("positives", "_n", "prior")


def encode_out_of_fold(train: DataFrame, item: str = "app_id", label: str = "label", fold: str = "fold", alpha: float = 10.0, global_prior: bool = False) -> DataFrame:
    """Each row encoded from the other folds: an item's totals less its fold's, and the prior of the other folds (or of all).

    Sums by (item, fold) are made from the tasks' own sums, and those of an item from these: a row for each item and fold,
    joined to the rows, so that no item's rows are gathered. There is no loop over folds.
    """
    y = F.col(label).cast("int")
    sums = staged(train.groupBy(F.col(item).alias("_item"), F.col(fold).alias("_fold")).agg(F.sum(y).alias("p"), F.count("*").alias("n")), "fold-sums")
    whole = sums.groupBy(F.col("_item").alias("_whole")).agg(F.sum("p").alias("wp"), F.sum("n").alias("wn"))
    other = sums.join(whole, F.col("_item").eqNullSafe(F.col("_whole"))).select("_item", "_fold", (F.col("wp") - F.coalesce("p", F.lit(0))).alias("_p"), (F.col("wn") - F.col("n")).alias("_n"))
    per_fold = sums.groupBy(F.col("_fold").alias("_f")).agg(F.sum("p").alias("fp"), F.sum("n").alias("fn"))
    w = Window.partitionBy()  # one row for each fold
    total_p, total_n = F.sum("fp").over(w), F.sum("fn").over(w)
    rate = total_p / total_n if global_prior else (total_p - F.col("fp")) / (total_n - F.col("fn"))
    df = train.join(other, F.col(item).eqNullSafe(F.col("_item")) & (F.col(fold) == F.col("_fold"))).join(F.broadcast(per_fold.select("_f", rate.alias("_prior"))), F.col(fold) == F.col("_f"))
    score = F.when(F.col("_n") == 0, F.col("_prior")).otherwise((F.col("_p") + alpha * F.col("_prior")) / (F.col("_n") + alpha))
    return df.withColumn("item_score", score).withColumn("item_log_count", F.log1p("_n")).select(*train.columns, "item_score", "item_log_count")
