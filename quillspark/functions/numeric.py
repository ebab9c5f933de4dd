"""Numbers, bins, labels, vectors: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_bucket(h: Column) -> Column:
    # Names of the buckets.
    out = F.when(h.isNull(), "unknown").when(h <= 0, "zero")
    for top, name in ((1, "very_low_0_1"), (5, "low_1_5"), (20, "medium_5_20"), (100, "high_20_100")):
        out = out.when(h < top, name)
    return out.otherwise("very_high_100_plus")


def right_closed(c: Column, tops: list[float], names: list[str]) -> Column:
    """Name of the first bin whose top is at least c; the last name above all tops."""
    out = None
    for top, name in zip(tops, names):
        out = F.when(c <= top, name) if out is None else out.when(c <= top, name)
    return out.otherwise(names[-1])


def item_bin(n: Column) -> Column:
    return right_closed(n, [0, 2, 5, 20, 100], ["cold_0", "very_rare_1_2", "rare_3_5", "tail_6_20", "mid_21_100", "head_100_plus"])


def history_bin(n: Column) -> Column:
    return right_closed(n, [2, 5, 10, 20], ["hist_0_2", "hist_3_5", "hist_6_10", "hist_11_20", "hist_21_plus"])


def hours_reference(median: Column, p75: Column) -> Column:
    return F.coalesce(F.when(median > 0, median), F.when(p75 > 0, p75), F.lit(1.0))


def label_variants(label: Column, hours: Column, reference: Column) -> dict[str, Column]:
    """Strict, hybrid and relative labels, and flags of hours that contradict the label; unknown hours count as false."""
    known = lambda c: F.coalesce(c, F.lit(False))
    return {
        "label_strict": known(label),
        "label_hybrid": known(label & (hours >= 2)),
        "label_hours_relative": known(hours / reference >= 1),
        "is_low_hours_positive": known(label & (hours < 2)),
        "is_high_hours_negative": known(~label & (hours / reference >= 1)),
    }


def two_way_softmax(yes: Column, no: Column) -> Column:
    m = F.greatest(yes, no)
    return F.exp(yes - m) / (F.exp(yes - m) + F.exp(no - m))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return F.coalesce(F.try_divide(array_sum(a), F.size(a).cast("double")), F.lit(0.0))


def array_median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.coalesce(middle, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def top_mean(a: Column, k: int) -> Column:
    """Mean of the k largest; 0 if there are none."""
    return array_mean(F.slice(F.sort_array(a, asc=False), 1, k))
