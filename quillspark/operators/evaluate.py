"""Metrics of scored rows: exact ROC-AUC, average precision, threshold search, group metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.ranks import row_numbers, running


def curve(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """For each group and distinct score, from the highest: positives and rows so far, and the group's totals.

    Rows are first reduced to one for each group and score. These are summed over ranges of (group, score) as one
    sequence, from which what stands before a group is taken off again: no group is one task, however large.
    """
    steps = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count("*").alias("n"))
    sums = running(steps, [*[F.col(c) for c in by], F.desc("score")], {"cum_p": F.col("p"), "cum_n": F.col("n")})
    totals = sums.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.min(F.col("cum_p") - F.col("p")).alias("_p0"), F.min(F.col("cum_n") - F.col("n")).alias("_n0"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by)]
    joined = sums.join(totals, reduce(lambda a, b: a & b, same)) if by else sums.crossJoin(F.broadcast(totals))  # one row
    return joined.select(*by, "score", "p", "n", (F.col("cum_p") - F.col("_p0")).alias("cum_p"), (F.col("cum_n") - F.col("_n0")).alias("cum_n"), "all_p", "all_n")


def auc_and_ap(df: DataFrame, by: list[str], score: str = "score", y: str = "y") -> DataFrame:
    """ROC-AUC (ties count half) and step-wise average precision; null for a group of one class."""
    c = curve(df, by, score, y)
    neg, all_neg = F.col("n") - F.col("p"), F.col("all_n") - F.col("all_p")
    below = F.col("all_n") - F.col("cum_n") - (F.col("all_p") - F.col("cum_p"))  # negatives of lower score
    pairs = F.sum(F.col("p") * (below + neg / 2))
    both = (F.max("all_p") > 0) & (F.max(all_neg) > 0)
    return c.groupBy(*by).agg(
        F.max("all_n").alias("n"),
        (F.max("all_p") / F.max("all_n")).alias("positive_rate"),
        F.when(both, pairs / (F.max("all_p") * F.max(all_neg))).alias("roc_auc"),
        F.when(both, F.sum(F.col("p") / F.col("all_p") * F.col("cum_p") / F.col("cum_n"))).alias("pr_auc"),
    )


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, by: list[str], pred: Column, y: str = "y") -> DataFrame:
    """Accuracy, precision, recall, F1 of given predictions; a zero division is 0."""
    t = F.col(y).cast("int") == 1
    df = df.withColumn("_pred", F.coalesce(pred.cast("int") == 1, F.lit(False)))
    c = df.groupBy(*by).agg(F.count_if(t & F.col("_pred")).alias("tp"), F.count_if(~t & F.col("_pred")).alias("fp"), F.count_if(~t & ~F.col("_pred")).alias("tn"), F.count_if(t & ~F.col("_pred")).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(*by, "tp", "fp", "tn", "fn", _safe(tp + tn, tp + fp + tn + fn).alias("accuracy"), _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"), _safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def linspace(df: DataFrame, low: float, high: float, n: int) -> DataFrame:
    """A grid of n thresholds as rows of t."""
    step = (high - low) / (n - 1)
    return df.sparkSession.range(n).select((F.lit(low) + F.col("id") * F.lit(step)).alias("t"))


def exact_quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """by, q (the share) and value: interpolated quantiles of each group's values that are no nulls, without a group in one task.

    Values are counted, the counts summed over ranges of (group, value), and of these rows only those are kept that
    hold the one or two ranks between which an asked quantile lies.
    """
    by = by or []
    steps = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    sums = running(steps, [*[F.col(c) for c in by], F.col("_v")], {"_cum": F.col("_c")})
    totals = sums.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]).agg(F.sum("_c").alias("_n"), F.min(F.col("_cum") - F.col("_c")).alias("_0"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by)]
    rows = sums.join(totals, reduce(lambda a, b: a & b, same)) if by else sums.crossJoin(F.broadcast(totals))  # one row
    rows = rows.select(*by, "_v", (F.col("_cum") - F.col("_c") - F.col("_0")).alias("_a"), (F.col("_cum") - F.col("_0")).alias("_b"), (F.col("_n") - 1).alias("_m"))
    asked = F.array(*[F.lit(float(q)) for q in shares])
    first, last = _places(shares, F.col("_a") - 1, F.col("_m"), True), _places(shares, F.col("_b"), F.col("_m"), False)
    near = rows.where(first <= last).select("*", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("_k")).withColumn("q", F.element_at(asked, F.col("_k") + 1))
    at = F.col("q") * F.col("_m")
    low, high = F.floor(at), F.ceil(at)
    holds = lambda r: F.when((r >= F.col("_a")) & (r < F.col("_b")), F.col("_v"))
    pair = near.select(*by, "q", holds(low).alias("_low"), holds(high).alias("_high"), (at - low).alias("_part")).where("_low IS NOT NULL OR _high IS NOT NULL")
    both = pair.groupBy(*by, "q").agg(F.max("_low").alias("_low"), F.max("_high").alias("_high"), F.max("_part").alias("_part"))
    return both.select(*by, "q", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("value"))


def _places(shares: list[float], rank: Column, most: Column, first: bool) -> Column:
    """The place in the ascending shares of the first whose rank is rank or more, or of the last whose rank is rank or less."""
    even = len(shares) > 2 and all(abs(q - k / (len(shares) - 1)) < 1e-12 for k, q in enumerate(shares))
    if even:  # k / (n - 1): by division, one place wider on either side; the ranks are compared again
        x = rank * (len(shares) - 1) / F.greatest(most, F.lit(1))
        return F.greatest(F.ceil(x) - 1, F.lit(0)) if first else F.least(F.floor(x) + 1, F.lit(len(shares) - 1))
    hit = [F.lit(q) * most >= rank if first else F.lit(q) * most <= rank for q in shares]
    count = reduce(lambda a, b: a + b, [h.cast("int") for h in hit])
    return F.lit(len(shares)) - count if first else count - 1


def quantile_grid(df: DataFrame, score: str = "score", n: int = 1001) -> DataFrame:
    """Quantiles of the scores, and 0 and just outside the extremes."""
    inner = exact_quantiles(df, score, [k / (n - 1) for k in range(n)]).select(F.col("value").alias("t"))
    ends = df.agg(F.array(F.min(score) - 1e-12, F.max(score) + 1e-12, F.lit(0.0)).alias("ts")).select(F.explode("ts").alias("t"))
    return inner.unionByName(ends).distinct()


def best_threshold(df: DataFrame, grid: DataFrame, ties: str = "first", score: str = "score", y: str = "y") -> DataFrame:
    """One row (threshold, f1): the grid's best F1 with pred = score >= t; ties: 'first' (least t) or 'middle' (nearest 0.5, then least).

    Each score falls to the largest threshold it still reaches, so one cumulative pass over the grid serves all thresholds.
    """
    g = grid.select("t").distinct()
    ts = g.agg(F.array_sort(F.collect_list("t")).alias("ts"))  # as long as the grid
    place = F.size(F.filter("ts", lambda t: t <= F.col("score")))
    scores = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count("*").alias("n"))
    reached = scores.crossJoin(F.broadcast(ts)).groupBy(place.alias("k")).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    numbered = g.withColumn("k", F.row_number().over(Window.orderBy("t")))
    up = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    total = scores.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("all_p"))
    at = numbered.join(reached, "k", "left").select("k", "t", F.coalesce(F.sum("p").over(up), F.lit(0)).alias("tp"), F.coalesce(F.sum("n").over(up), F.lit(0)).alias("predicted")).crossJoin(F.broadcast(total))
    at = at.withColumn("f1", _safe(2 * F.col("tp"), F.col("predicted") + F.col("all_p")))
    rank = F.struct(F.round("f1", 12), -F.col("t")) if ties == "first" else F.struct(F.round("f1", 12), -F.round(F.abs(F.col("t") - 0.5), 12), -F.col("t"))
    return at.agg(F.max_by("t", rank).alias("threshold"), F.max("f1").alias("f1"))


def group_metrics(df: DataFrame, groups: list[str], threshold: float | Column, score: str = "score", y: str = "y", method: str | None = None) -> DataFrame:
    """All metrics for each method (if there is one) and value of each group column, in one pass over the unpivoted rows."""
    more = [method] if method else []
    hit = F.col(score) >= threshold
    long = df.select(*more, score, y, hit.alias("_hit"), F.explode(F.array(*[F.struct(F.lit(g).alias("group_type"), F.col(g).cast("string").alias("group")) for g in groups])).alias("g")).select(*more, score, y, "_hit", "g.*")
    by = [*more, "group_type", "group"]
    a = auc_and_ap(long, by, score, y)
    b = confusion(long, by, F.col("_hit"), y)
    same = reduce(lambda x, z: x & z, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in by])
    return a.alias("a").join(b.alias("b"), same).select("a.*", *[F.col(f"b.{c}") for c in ("accuracy", "precision", "recall", "f1")])


def quartiles(df: DataFrame, value: str, key: str, names: tuple[str, ...] = ("Q1_tail", "Q2", "Q3", "Q4_head")) -> DataFrame:
    """Equal-frequency quartile of the rank of value, ties broken by key."""
    numbered = row_numbers(df, [F.col(value), F.col(key)], "_r").crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))  # one row
    r = (F.col("_r") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    return numbered.withColumn("quartile", F.when(r <= 0.25, names[0]).when(r <= 0.5, names[1]).when(r <= 0.75, names[2]).otherwise(names[3])).drop("_r", "_n")


def threshold_on_test(val: DataFrame, test: DataFrame, grid: DataFrame, ties: str = "first", score: str = "score", y: str = "y") -> DataFrame:
    """The threshold of the best F1 on val, and the metrics of test at it: test has no say in the choice."""
    chosen = best_threshold(val, grid, ties, score, y).select("threshold")  # one row
    return confusion(test.crossJoin(F.broadcast(chosen)), ["threshold"], F.col(score) >= F.col("threshold"), y)
