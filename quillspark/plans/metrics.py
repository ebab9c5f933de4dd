"""Queries of metrics over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import numeric
from quillspark.operators import evaluate, profile, sampling
from quillspark.plans.base import ORACLES, query
from quillspark.sources import files
from quillspark.sources.canonical import table

_SCORED = "scored AS (SELECT doc_id, quality AS y, length(text) / (length(text) + 6000.0::DOUBLE) AS score, lang, source FROM labels JOIN documents USING (doc_id))"
_CURVE = _SCORED + """, st AS (SELECT {g} AS g, score, sum(y) AS p, count(*) AS n FROM scored GROUP BY 1, score),
cv AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY g) AS ap, sum(n) OVER (PARTITION BY g) AS an FROM st WINDOW w AS (PARTITION BY g ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
mt AS (SELECT g, CAST(max(an) AS BIGINT) AS n, max(ap) / max(an)::DOUBLE AS positive_rate,
  CASE WHEN max(ap) > 0 AND max(an - ap) > 0 THEN sum(p * ((an - cn) - (ap - cp) + (n - p) / 2.0::DOUBLE)) / (max(ap) * max(an - ap)) END AS roc_auc,
  CASE WHEN max(ap) > 0 AND max(an - ap) > 0 THEN sum(p / ap::DOUBLE * cp / cn) END AS pr_auc FROM cv GROUP BY g)"""
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0)"


def scored(spark, sf_dir) -> DataFrame:
    """Labelled documents with a score that grows with the text's length, without an end."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") / (F.length("text") + 6000.0)).alias("score"), "lang", "source")
    return labels.join(docs, "doc_id")


@query(f"WITH {_CURVE.format(g='0')} SELECT n, round(positive_rate, 9) AS positive_rate, round(roc_auc, 9) AS roc_auc FROM mt")
def roc_auc(spark, sf_dir):
    return evaluate.auc_and_ap(scored(spark, sf_dir), []).select("n", F.round("positive_rate", 9).alias("positive_rate"), F.round("roc_auc", 9).alias("roc_auc"))


@query(f"WITH {_CURVE.format(g='0')} SELECT n, round(pr_auc, 9) AS pr_auc FROM mt")
def average_precision(spark, sf_dir):
    return evaluate.auc_and_ap(scored(spark, sf_dir), []).select("n", F.round("pr_auc", 9).alias("pr_auc"))


@query(f"""WITH {_SCORED}, c AS (SELECT lang, count(*) FILTER (WHERE y = 1 AND score >= 0.3) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.3) AS fp, count(*) FILTER (WHERE y = 0 AND score < 0.3) AS tn, count(*) FILTER (WHERE y = 1 AND score < 0.3) AS fn FROM scored GROUP BY lang)
SELECT lang, tp, fp, tn, fn, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, {_F1} AS f1 FROM c""")
def confusion_metrics(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir), ["lang"], F.col("score") >= 0.3)


_GRID = _SCORED + """, g AS ({grid}), a AS (SELECT t, sum(y) FILTER (WHERE score >= t) AS tp, count(*) FILTER (WHERE score >= t AND y = 0) AS fp, count(*) FILTER (WHERE score < t AND y = 1) AS fn FROM g, scored GROUP BY t),
f AS (SELECT t, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM a) SELECT '{name}' AS variant, round(arg_min(t, {order}), 9) AS threshold, round(max(f1), 9) AS f1 FROM f WHERE round(f1, 12) = (SELECT max(round(f1, 12)) FROM f)"""


def _grid_sql(name: str, grid: str, order: str = "t") -> str:
    return f"(WITH {_GRID.format(grid=grid, name=name, order=order)})"


@query(
    " UNION ALL ".join(
        [
            "SELECT * FROM " + _grid_sql("unit_first", "SELECT i * 0.001::DOUBLE AS t FROM range(0, 1001) r(i)"),
            "SELECT * FROM " + _grid_sql("unit_middle", "SELECT i * 0.001::DOUBLE AS t FROM range(0, 1001) r(i)", "row(round(abs(t - 0.5), 12), t)"),
            "SELECT * FROM " + _grid_sql("coarse", "SELECT 0.01::DOUBLE + i * 0.01::DOUBLE AS t FROM range(0, 99) r(i)"),
            "SELECT * FROM " + _grid_sql("fine", "SELECT 0.05::DOUBLE + i * 0.005::DOUBLE AS t FROM range(0, 181) r(i)"),
        ]
    )
)
def best_f1_threshold(spark, sf_dir):
    s = scored(spark, sf_dir)
    unit = evaluate.linspace(s, 0.0, 1.0, 1001)
    variants = {"unit_first": (unit, "first"), "unit_middle": (unit, "middle"), "coarse": (evaluate.linspace(s, 0.01, 0.99, 99), "first"), "fine": (evaluate.linspace(s, 0.05, 0.95, 181), "first")}
    out = None
    for name, (grid, ties) in variants.items():
        one = evaluate.best_threshold(s, grid, ties).select(F.lit(name).alias("variant"), F.round("threshold", 9).alias("threshold"), F.round("f1", 9).alias("f1"))
        out = one if out is None else out.unionByName(one)
    return out


_METHODS = {"length": "score", "lines": "n_lines / (n_lines + 20.0::DOUBLE)", "constant": "0.5::DOUBLE"}
_OF_METHODS = f"""labelled AS (SELECT doc_id, quality AS y, length(text) / (length(text) + 6000.0::DOUBLE) AS score, length(text) - length(replace(text, chr(10), '')) AS n_lines, lang, source FROM labels JOIN documents USING (doc_id)),
m AS ({" UNION ALL ".join(f"SELECT '{k}' AS method, y, {v} AS score, lang, source FROM labelled" for k, v in _METHODS.items())}),
u AS (SELECT method, 'lang' AS group_type, lang AS g, y, score FROM m UNION ALL SELECT method, 'source', source, y, score FROM m),
st AS (SELECT method, group_type, g, score, sum(y) AS p, count(*) AS n FROM u GROUP BY ALL),
cv AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY method, group_type, g) AS ap, sum(n) OVER (PARTITION BY method, group_type, g) AS an FROM st WINDOW w AS (PARTITION BY method, group_type, g ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
mt AS (SELECT method, group_type, g, CAST(max(an) AS BIGINT) AS n, max(ap) / max(an)::DOUBLE AS positive_rate,
  CASE WHEN max(ap) > 0 AND max(an - ap) > 0 THEN sum(p * ((an - cn) - (ap - cp) + (n - p) / 2.0::DOUBLE)) / (max(ap) * max(an - ap)) END AS roc_auc,
  CASE WHEN max(ap) > 0 AND max(an - ap) > 0 THEN sum(p / ap::DOUBLE * cp / cn) END AS pr_auc FROM cv GROUP BY method, group_type, g),
c AS (SELECT method, group_type, g, count(*) FILTER (WHERE y = 1 AND score >= 0.3) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.3) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.3) AS fn FROM u GROUP BY ALL)"""


def methods(spark, sf_dir) -> DataFrame:
    """Labelled documents with the scores of three methods, a row for each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.length("text").alias("_n"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("_l"))
    scores = {"length": F.col("_n") / (F.col("_n") + 6000.0), "lines": F.col("_l") / (F.col("_l") + 20.0), "constant": F.lit(0.5)}
    both = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")).join(docs, "doc_id")
    return both.select("doc_id", "y", "lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("method"), v.alias("score")) for k, v in scores.items()])).alias("m")).select("doc_id", "y", "lang", "source", "m.*")


@query(f"""WITH {_OF_METHODS} SELECT mt.method, mt.group_type, mt.g AS "group", n, round(positive_rate, 9) AS positive_rate, round(roc_auc, 9) AS roc_auc, round(pr_auc, 9) AS pr_auc, round({_F1}, 9) AS f1
FROM mt JOIN c ON c.method = mt.method AND c.group_type = mt.group_type AND c.g IS NOT DISTINCT FROM mt.g""")
def group_metrics(spark, sf_dir):
    g = evaluate.group_metrics(methods(spark, sf_dir), ["lang", "source"], 0.3, method="method")
    return g.select("method", "group_type", "group", "n", *[F.round(c, 9).alias(c) for c in ("positive_rate", "roc_auc", "pr_auc", "f1")])


_GRID_1001 = _SCORED + ", g AS (SELECT DISTINCT round(t, 9) AS t FROM (SELECT unnest(quantile_cont(score, [i / 1000.0::DOUBLE for i in range(0, 1001)])) AS t FROM scored UNION ALL SELECT min(score) - 1e-12 FROM scored UNION ALL SELECT max(score) + 1e-12 FROM scored UNION ALL SELECT 0.0))"


@query(f"WITH {_GRID_1001} SELECT count(*) AS n, round(min(t), 9) AS low, round(max(t), 9) AS high, round(sum(t), 6) AS total, round(sum(t * t), 6) AS squares FROM g")
def quantile_grid_sums(spark, sf_dir):
    """The 1,001 quantiles of the scores that a threshold is searched among, as sums."""
    t = F.col("t")
    return evaluate.quantile_grid(scored(spark, sf_dir)).select(F.round("t", 9).alias("t")).distinct().agg(F.count("*").alias("n"), F.round(F.min(t), 9).alias("low"), F.round(F.max(t), 9).alias("high"), F.round(F.sum(t), 6).alias("total"), F.round(F.sum(t * t), 6).alias("squares"))


@query(f"""WITH {_SCORED}, ids AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY md5(doc_id || 'fair'), doc_id) AS r FROM scored) WHERE r <= 30), s AS (SELECT * FROM scored WHERE doc_id IN (SELECT doc_id FROM ids))
SELECT 'length' AS method, count(*) AS n, count(*) FILTER (WHERE (score >= 0.3) = (y = 1)) / count(*)::DOUBLE AS accuracy FROM s UNION ALL SELECT 'constant', count(*), count(*) FILTER (WHERE y = 1) / count(*)::DOUBLE FROM s""")
def fair_subset(spark, sf_dir):
    s = scored(spark, sf_dir)
    s = sampling.matching(s, sampling.balanced(s, "y", 30, "doc_id", "fair"), "doc_id")
    both = s.select("y", F.explode(F.array(F.struct(F.lit("length").alias("method"), F.col("score")), F.struct(F.lit("constant").alias("method"), F.lit(0.5).alias("score")))).alias("m")).select("y", "m.*")
    c = evaluate.confusion(both, ["method"], F.col("score") >= 0.3)
    return c.select("method", (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"), "accuracy")


@query(f"""WITH {_OF_METHODS.replace("'lang' AS group_type, lang AS g", "'all' AS group_type, 'all' AS g").replace(" UNION ALL SELECT method, 'source', source, y, score FROM m", "")}, b AS (SELECT method, roc_auc AS test_roc_auc FROM mt)
SELECT CAST(row_number() OVER (ORDER BY test_roc_auc DESC, method) AS INTEGER) AS place, method, round(test_roc_auc, 9) AS test_roc_auc, CASE WHEN method = 'constant' THEN '' ELSE 'computed' END AS "group" FROM b""")
def leaderboard(spark, sf_dir):
    """Methods by their ROC-AUC: the computed ones put into a table that holds the constant's row without a group."""
    from pyspark.sql import Window

    a = evaluate.auc_and_ap(methods(spark, sf_dir), ["method"]).select("method", F.col("roc_auc").alias("test_roc_auc"))
    old, new = a.where("method = 'constant'"), a.where("method != 'constant'").withColumn("group", F.lit("computed"))
    place = F.row_number().over(Window.orderBy(F.desc("test_roc_auc"), "method"))  # one row for each method
    return files.upsert(old, new, "method").select(place.alias("place"), "method", F.round("test_roc_auc", 9).alias("test_roc_auc"), F.coalesce("group", F.lit("")).alias("group"))


@query("""WITH n AS (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey)
SELECT CASE WHEN n <= 0 THEN 'cold_0' WHEN n <= 2 THEN 'very_rare_1_2' WHEN n <= 5 THEN 'rare_3_5' WHEN n <= 20 THEN 'tail_6_20' WHEN n <= 100 THEN 'mid_21_100' ELSE 'head_100_plus' END AS bin, count(*) AS items FROM n GROUP BY 1""")
def item_bins(spark, sf_dir):
    return _bins(spark, sf_dir, table(spark, sf_dir, "lineitem"))


@query(ORACLES["item_bins"])
def item_bins_all(spark, sf_dir):
    """item_bins under the name that it had when it counted one line number only."""
    return _bins(spark, sf_dir, table(spark, sf_dir, "lineitem"))


def _bins(spark, sf_dir, lines: DataFrame) -> DataFrame:
    lines = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "part").select("p_partkey").join(lines, "p_partkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.groupBy(numeric.item_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("items"))


@query("""WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey), r AS (SELECT *, percent_rank() OVER (ORDER BY n, l_partkey) AS r FROM n)
SELECT l_partkey, n, CASE WHEN r <= 0.25 THEN 'Q1_tail' WHEN r <= 0.5 THEN 'Q2' WHEN r <= 0.75 THEN 'Q3' ELSE 'Q4_head' END AS quartile FROM r""")
def rank_quartiles(spark, sf_dir):
    return evaluate.quartiles(table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), "n", "l_partkey")


@query(f"""WITH {_SCORED}, m AS (SELECT 'fixed' AS mode, y, score >= 0.5 AS p FROM scored UNION ALL SELECT 'generated', y, doc_id % 2 = 0 FROM scored UNION ALL SELECT 'val_best', y, score >= 0.1 FROM scored),
c AS (SELECT mode, count(*) FILTER (WHERE y = 1 AND p) AS tp, count(*) FILTER (WHERE y = 0 AND p) AS fp, count(*) FILTER (WHERE y = 1 AND NOT p) AS fn, count(*) FILTER (WHERE y = 0 AND NOT p) AS tn FROM m GROUP BY mode)
SELECT mode, {_F1} AS f1, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy FROM c""")
def decision_modes(spark, sf_dir):
    modes = {"fixed": F.col("score") >= 0.5, "generated": F.col("doc_id") % 2 == 0, "val_best": F.col("score") >= 0.1}
    long = scored(spark, sf_dir).select("y", F.explode(F.array(*[F.struct(F.lit(k).alias("mode"), p.alias("pred")) for k, p in modes.items()])).alias("m")).select("y", "m.*")
    return evaluate.confusion(long, ["mode"], F.col("pred")).select("mode", "f1", "accuracy")


@query("SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type FROM events) GROUP BY event_type")
def value_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"))
    df = profile.percent_of_total(e, "event_type")
    from pyspark.sql import Window

    return df.select("event_type", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))
