"""Queries of scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import numeric
from quillspark.operators import boosting, features, sampling, scorers, tabular
from quillspark.plans import tabular as tabular_plans
from quillspark.plans.base import SPLIT, query
from quillspark.plans.data import splits
from quillspark.sources.canonical import table
from quillspark.sources.stage import staged, staged_once


@query(f"""WITH {SPLIT}, t AS (SELECT * FROM split WHERE split = 'train'), r AS (SELECT target_app_id, avg(CAST(label AS DOUBLE)) AS rate FROM t GROUP BY target_app_id)
SELECT user_id, split, round((SELECT avg(CAST(label AS DOUBLE)) FROM t), 9) AS constant_score, round(coalesce(rate, (SELECT avg(CAST(label AS DOUBLE)) FROM t)), 9) AS score FROM split LEFT JOIN r USING (target_app_id) WHERE split <> 'train'""")
def popularity_scores(spark, sf_dir):
    s = splits(spark, sf_dir)
    train, rest = s.where("split = 'train'"), s.where("split != 'train'")
    both = scorers.constant(rest, train).withColumnRenamed("score", "constant_score")
    return scorers.item_popularity(both, train).select("user_id", "split", F.round("constant_score", 9).alias("constant_score"), F.round("score", 9).alias("score"))


@query(f"""WITH {SPLIT}, ev AS (SELECT user_id, app_id FROM hist JOIN split USING (user_id) WHERE hist.label AND split = 'train' UNION SELECT user_id, target_app_id FROM split WHERE label AND split = 'train'),
dg AS (SELECT app_id, count(*) AS d FROM ev GROUP BY app_id), e AS (SELECT s.user_id, s.target_app_id, h.app_id, h.label FROM split s JOIN hist h USING (user_id) WHERE split <> 'train' AND h.app_id <> s.target_app_id),
pr AS (SELECT DISTINCT target_app_id, app_id FROM e), cm AS (SELECT pr.target_app_id, pr.app_id, count(*) AS c FROM pr JOIN ev a ON a.app_id = pr.target_app_id JOIN ev b ON b.app_id = pr.app_id AND b.user_id = a.user_id GROUP BY ALL),
sm AS (SELECT cm.target_app_id, cm.app_id, c / sqrt(x.d * y.d) AS sim FROM cm JOIN dg x ON x.app_id = cm.target_app_id JOIN dg y ON y.app_id = cm.app_id),
n AS (SELECT user_id, label, sim, row_number() OVER (PARTITION BY user_id, label ORDER BY sim DESC, e.app_id) AS r FROM e JOIN sm USING (target_app_id, app_id)),
g AS (SELECT user_id, coalesce(avg(sim) FILTER (WHERE label), 0) - coalesce(avg(sim) FILTER (WHERE NOT label), 0) AS score FROM n WHERE r <= 30 GROUP BY user_id)
SELECT s.user_id, s.split, round(coalesce(g.score, 0), 9) AS score FROM split s LEFT JOIN g USING (user_id) WHERE split <> 'train'""")
def itemknn_scores(spark, sf_dir):
    s = staged(splits(spark, sf_dir), "splits")
    return scorers.item_knn(s.where("split != 'train'"), s.where("split = 'train'")).select("user_id", "split", F.round("score", 9).alias("score"))


@query("SELECT event_id, exp(value / 100 - greatest(value / 100, event_id % 3)) / (exp(value / 100 - greatest(value / 100, event_id % 3)) + exp(event_id % 3 - greatest(value / 100, event_id % 3))) AS yes FROM events")
def logit_normalization(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", numeric.two_way_softmax(F.col("value") / 100, (F.col("event_id") % 3).cast("double")).alias("yes"))


def _number_rows(spark, sf_dir):
    return staged_once(spark, f"model frame {sf_dir}", lambda: tabular_plans.model_frame(spark, sf_dir))


def _parts(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.when(F.col("split") == "train", boosting.TRAIN).when(F.col("split") == "val", boosting.VAL).otherwise(boosting.REST))


KEPT = ["user_id", "split", "label"]


def _fitted_line(spark, sf_dir):
    df = _number_rows(spark, sf_dir)
    return df, scorers.fit_logistic(df.where("split = 'train'"), features.safe_features(df, tabular.LINEAR))


@query()
def logreg_scores(spark, sf_dir):
    """17 features, the same as the reviews' linear model finds available."""
    df, model = _fitted_line(spark, sf_dir)
    return scorers.logistic_scores(df.where("split != 'train'"), model).select(*KEPT, "score")


@query()
def logreg_coefficients(spark, sf_dir):
    """Weights of the standardized features, the largest first."""
    return scorers.coefficients(spark, _fitted_line(spark, sf_dir)[1])


def _grown(df: DataFrame, sets: dict[str, list[str]], **how) -> dict[str, boosting.Forest]:
    """Forests of the train rows that stop by the ROC-AUC of the val rows."""
    specs = [boosting.Spec(name, tuple(features.safe_features(df, names)), **how) for name, names in sets.items()]
    return boosting.boost(_parts(df), specs)


def _base_forest(spark, sf_dir):
    df = _number_rows(spark, sf_dir)
    return df, _grown(df, {"base": tabular.BASE}, rounds=1000, step=0.04, depth=6, patience=80)


@query()
def gbt_scores(spark, sf_dir):
    """25 features, up to 1,000 trees; trees is how many were kept."""
    df, forests = _base_forest(spark, sf_dir)
    return boosting.predict(df.where("split = 'test'"), forests, KEPT).drop("variant")


@query()
def gbt_importances(spark, sf_dir):
    """Each feature's share of the gain of all splits, the largest first."""
    return boosting.importances(spark, _base_forest(spark, sf_dir)[1]).drop("variant").orderBy(F.desc("importance"), "feature")


@query()
def gbt_variants(spark, sf_dir):
    """Scores by each other feature set: with encodings, with similarities, and the safe lists with up to 1,200 trees."""
    df = _number_rows(spark, sf_dir)
    specs = []
    for name, names in tabular.SETS.items():
        safe = name.startswith("safe")
        specs.append(boosting.Spec(name, tuple(features.safe_features(df, names)), rounds=1200 if safe else 1000, step=0.04, depth=6, patience=100 if safe else 80))
    return boosting.predict(df.where("split = 'test'"), boosting.boost(_parts(df), specs), KEPT)


@query()
def gbt_same_budget(spark, sf_dir):
    """Three feature sets on balanced training samples of two sizes, up to 700 trees."""
    df = _number_rows(spark, sf_dir)
    out = None
    for budget in (20_000, 30_000):
        train = sampling.balanced(df.where("split = 'train'").select("user_id", "label"), "label", budget // 2, "user_id", "budget").select("user_id")
        own = staged(df.where("split != 'train'").unionByName(df.where("split = 'train'").join(train, "user_id", "left_semi")), "budget")
        forests = _grown(own, {k: tabular.SETS[k] for k in ("base", "popularity", "semantic")}, rounds=700, step=0.05, depth=6, patience=80)
        one = boosting.predict(own.where("split = 'test'"), forests, KEPT).select(F.lit(budget).alias("budget"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def hist_gbt_variants(spark, sf_dir):
    """150 trees of up to 31 leaves, without stopping, of the similarities alone, the other numbers, and both; medians for nulls."""
    df = _number_rows(spark, sf_dir)
    numbers = tabular.BASE + tabular.POPULARITY
    sets = {"semantic_only": tabular.SEMANTIC, "numeric_without_semantic": numbers, "numeric_with_semantic": numbers + tabular.SEMANTIC}
    df = scorers.filled(df, scorers.medians(df.where("split = 'train'"), numbers + tabular.SEMANTIC))
    forests = _grown(df, sets, rounds=150, step=0.06, depth=8, l2=0.05, patience=None, symmetric=False, leaves=31, least_rows=20)
    return boosting.predict(df.where("split != 'train'"), forests, KEPT)
