"""Row numbers and running sums over a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.stage import staged


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of the given columns over all rows up to each one, in a total order.

    Rows are dealt by ranges of the order; each range sums its own rows, and the ranges before it add
    one number each: the only window over everything has a row for each partition.
    """
    mine = {k: c.alias(f"_s_{k}") for k, c in sums.items()}
    dealt = df.select("*", *mine.values()).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt, "ranks")  # ranges are drawn from a sample: they are used twice, so they are kept
    totals = dealt.groupBy("_part").agg(*[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(offsets), "_part").select(*df.columns, *[(F.sum(f"_s_{k}").over(upto) + F.col(f"_b_{k}")).alias(k) for k in sums])


def row_numbers(df: DataFrame, order: list[Column], name: str, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (all of df's by default) with the row number, from 1, in a total order.

    Rows are dealt by ranges once: a row's place in its sorted range is in the number that Spark gives it there, whose bits
    from 33 on are the range's, and kept before other work.
    """
    keep = keep or df.columns
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*keep, F.monotonically_increasing_id().alias("_id"))
    dealt = staged(dealt, "ranks")
    dealt = dealt.select(*keep, F.shiftright("_id", 33).alias("_part"), (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("_at"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_t")).select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))
    return dealt.join(F.broadcast(offsets), "_part").select(*keep, (F.col("_at") + F.col("_b")).alias(name))


def numbers_within(df: DataFrame, stratum: str, order: list[Column], name: str, total: str, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep (the stratum among them; all by default) with the row number inside the stratum and its size, for few strata of any size."""
    keep = keep or df.columns
    numbered = row_numbers(df, [F.col(stratum), *order], "_g", keep)
    strata = F.broadcast(numbered.groupBy(F.col(stratum).alias("_stratum")).agg(F.min("_g").alias("_first"), F.count("*").alias(total)))  # a row for each
    out = numbered.join(strata, F.col(stratum).eqNullSafe(F.col("_stratum")))
    return out.select(*keep, (F.col("_g") - F.col("_first") + 1).alias(name), total)
