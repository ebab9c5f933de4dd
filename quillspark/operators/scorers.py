"""Scorers: each adds a column score to its samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import encoding
from quillspark.sources.stage import staged


def constant(samples: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    p = F.broadcast(encoding.prior(train, label).select(F.col("prior").alias("score")))  # one row
    return samples.crossJoin(p)


def item_popularity(samples: DataFrame, train: DataFrame, item: str = "target_app_id", label: str = "label") -> DataFrame:
    """The item's share of positives in train; unseen items the overall share."""
    rates = encoding.popularity(train, item, label).select(item, "rate")
    p = F.broadcast(encoding.prior(train, label))  # one row
    return samples.join(rates, item, "left").crossJoin(p).withColumn("score", F.coalesce("rate", "prior")).drop("rate", "prior")


def positive_events(train: DataFrame) -> DataFrame:
    """Distinct (user_id, app_id): liked history items and positive targets of train."""
    liked = train.select("user_id", F.explode(F.filter("history", lambda h: h["label"])).alias("h")).select("user_id", F.col("h.app_id").alias("app_id"))
    targets = train.where("label").select("user_id", F.col("target_app_id").alias("app_id"))
    return liked.unionByName(targets).distinct()


def item_knn(samples: DataFrame, train: DataFrame, k: int = 30) -> DataFrame:
    """Mean of the k largest positive cosine similarities of the target to liked history items, less that to disliked ones.

    Common users are counted by user: a user has few items (a bounded history and a target), so the pairs
    of a user's items are few, whatever an item's popularity; of them the occurring (target, history
    item) pairs are kept.
    """
    events = positive_events(train)
    degree = events.groupBy("app_id").agg(F.count("*").alias("degree"))
    e = samples.select("user_id", "target_app_id", F.explode("history").alias("h")).select("user_id", "target_app_id", F.col("h.app_id").alias("app_id"), F.col("h.label").alias("label")).where("app_id != target_app_id")
    pairs = e.select("target_app_id", "app_id").distinct()
    mine = events.select("user_id", F.col("app_id").alias("target_app_id"))
    both = mine.join(events.select("user_id", "app_id"), "user_id").where("app_id != target_app_id")
    common = both.join(pairs, ["target_app_id", "app_id"], "left_semi").groupBy("target_app_id", "app_id").agg(F.count("*").alias("common"))
    sim = common.join(degree, "app_id").join(degree.select(F.col("app_id").alias("target_app_id"), F.col("degree").alias("target_degree")), "target_app_id")
    sim = sim.select("target_app_id", "app_id", (F.col("common") / F.sqrt(F.col("degree") * F.col("target_degree"))).alias("sim"))
    near = e.join(sim, ["target_app_id", "app_id"])
    rank = F.row_number().over(Window.partitionBy("user_id", "label").orderBy(F.desc("sim"), "app_id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k)
    side = lambda want: F.coalesce(F.avg(F.when(F.col("label") == want, F.col("sim"))), F.lit(0.0))
    g = near.groupBy("user_id").agg((side(True) - side(False)).alias("score"))
    return samples.join(g, "user_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def content_similarity(overlap: DataFrame) -> DataFrame:
    """score of token_overlap's rows: how much nearer the target is to liked than to disliked items; 0 if unknown."""
    return overlap.withColumn("score", F.coalesce(F.col("jaccard_diff"), F.lit(0.0)))


def separations(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """(place, feature, difference): each feature's difference of means between the classes in deviations, largest absolute value first."""
    of = lambda f: F.try_divide(F.avg(F.when(F.col(y), F.col(f))) - F.avg(F.when(~F.col(y), F.col(f))), F.stddev_pop(f))
    one = df.agg(F.array(*[F.struct(F.lit(f).alias("feature"), of(f).alias("difference")) for f in features]).alias("x"))
    long = one.select(F.explode("x").alias("x")).select("x.*")
    return long.select(F.row_number().over(Window.orderBy(F.desc_nulls_last(F.abs("difference")), "feature")).alias("place"), "feature", "difference")  # a row for each feature


def batch_scorer(samples: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.Series]], key: str = "sample_id") -> DataFrame:
    """score from a model of any kind: make() runs once in each task and returns the function that scores a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for b in batches:
            yield pd.DataFrame({key: b[key], "score": score(b).astype(float)})

    return samples.mapInPandas(run, f"{key} {dict(samples.dtypes)[key]}, score double")


def medians(train: DataFrame, features: list[str]) -> dict[str, float]:
    """The median of each feature, within a rank error of a thousandth; 0 where all are null."""
    found = train.select(*[F.col(f).cast("double") for f in features]).approxQuantile(features, [0.5], 1e-3)
    return {f: float(q[0]) if q else 0.0 for f, q in zip(features, found)}


def filled(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """df with doubles for the named columns, values for their nulls."""
    return df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(v)) for f, v in values.items()})


class Line(NamedTuple):
    """A logistic model of standardized features."""

    features: list[str]
    median: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray  # the intercept first

    def design(self, x: np.ndarray) -> np.ndarray:
        x = (np.where(np.isnan(x), self.median, x) - self.mean) / self.deviation
        return np.hstack([np.ones((len(x), 1)), x])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.design(x) @ self.weights))


def fit_logistic(train: DataFrame, features: list[str], label: str = "label", c: float = 1.0, steps: int = 12) -> Line:
    """Medians for nulls, standardized, L2 logistic regression by iteratively reweighted least squares.

    Every step sums X'WX and the gradient in the tasks, one row for each entry, which are added as groups: (k + 1) ** 2 +
    k + 1 numbers for k features come to the driver, whatever the rows. The intercept has no penalty.
    """
    rows = staged(train.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y")), "line-rows")
    median = medians(rows, features)
    of = filled(rows, median).agg(*[F.avg(f).alias(f"m{k}") for k, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{k}") for k, f in enumerate(features)]).first()
    k = len(features)
    deviation = np.array([of[f"s{i}"] or 1.0 for i in range(k)])
    model = Line(features, np.array([median[f] for f in features]), np.array([of[f"m{i}"] or 0.0 for i in range(k)]), deviation, np.zeros(k + 1))
    ridge = np.diag([0.0] + [1.0 / c] * k)

    def summed(now: Line):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k + 1) * (k + 2))
            for b in batches:
                x, y = now.design(b[features].to_numpy(float)), b["_y"].to_numpy(float)
                p = 1 / (1 + np.exp(-x @ now.weights))
                total += np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (y - p)])
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        return work

    for _ in range(steps):
        entries = rows.mapInPandas(summed(model), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((k + 1) * (k + 2))
        for r in entries:
            total[r["i"]] = r["v"]
        curvature = total[: (k + 1) ** 2].reshape(k + 1, k + 1) + ridge
        gradient = total[(k + 1) ** 2 :] - ridge @ model.weights
        model = model._replace(weights=model.weights + np.linalg.lstsq(curvature, gradient, rcond=None)[0])
    return model


def logistic_scores(samples: DataFrame, model: Line) -> DataFrame:
    """samples with score, in Arrow batches; the model is sent once to each executor."""
    sent = samples.sparkSession.sparkContext.broadcast(model)
    names = model.features

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[keep].assign(score=sent.value.probability(b[[f"_f_{f}" for f in names]].to_numpy(float)))

    keep = samples.columns
    inputs = samples.select("*", *[F.col(f).cast("double").alias(f"_f_{f}") for f in names])
    return inputs.mapInPandas(work, ", ".join([*[f"`{c}` {t}" for c, t in samples.dtypes], "score double"]))


def coefficients(spark, model: Line) -> DataFrame:
    rows = [(f, float(w)) for f, w in zip(model.features, model.weights[1:])]
    return spark.createDataFrame(rows, "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")), "feature")
