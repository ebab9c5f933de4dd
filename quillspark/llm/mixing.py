"""Mixing sources to target weights by Poisson replication.

The target weight of a source times all characters, over the source's own characters, is the mean
number of times each of its documents is repeated. A hash of (seed, doc_id, source, text, place among the
rows equal in these) gives a uniform number, and the inverse of the Poisson distribution turns it into a
count; rows are exploded by it and shuffled by a hash of the copy. So rows that share a doc_id, or have none, draw
apart from each other, and so do equal rows. A mean above STEP is a sum of independent Poisson numbers of equal
means of at most STEP, so that no mean underflows.

A row whose mean asks for many draws is split: each RUN of draws is a row of its own, which draws and
explodes in a task of its own, so no row's copies pass through one task. Copies are dealt by a hash of
doc_id, text and copy number, so the copies of a row are spread; only equal copies of equal rows meet.

Defined cases: null source is a source of its own (weight key None). Null or empty text counts as one
character, so that it too has a place in the mix. Repeated rows each draw a count of their own. Sources that the
weights do not name get weight 0 if others are named; without weights all sources get equal ones. Very
long texts are repeated whole. An empty table gives an empty result. A column named copy_no is replaced;
columns used inside take names that docs does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import written

STEP, MOST = 16.0, 90  # P(Poisson(16) > 90) is below 2 ** -53
RUN = 64  # draws made and exploded together: some 1,000 copies
BROADCAST_SOURCES = 100_000  # rows of (source, mean): some MB
BROADCAST_REPEATED = 200_000  # keys of repeated rows: some 15 MB


def uniform(*parts) -> Column:
    """A number in (0, 1) from md5 of the parts: its first 52 bits, plus a half, over 2 ** 52."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """source, rate: mean repetitions of each document of a source, so that the mix has epochs times all characters."""
    size = F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1)).cast("long")
    sums = docs.groupBy("source").agg(F.sum(size).alias("size"))
    total = sums.agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    if weights is None:
        weight = F.lit(1.0) / F.col("n")
    else:
        full = float(sum(weights.values())) or 1.0
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(w / full)).otherwise(weight)
    return sums.crossJoin(F.broadcast(total)).select("source", (F.lit(float(epochs)) * weight * F.col("total") / F.col("size")).alias("rate"))  # total is one row


def poisson_cdf(mean: Column) -> Column:
    """P(Poisson(mean) <= k) for k from 0 to MOST."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step, lambda acc: acc["cdf"])


def _numbered(docs: DataFrame, key: str, place: str) -> DataFrame:
    """docs with place: 1, 2, ... among the rows of one key; rows that share a key are numbered in two steps, in the
    partitions that read them and then over these, so that no key's rows meet in one task."""
    counts = docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("many"))
    many = written(counts, "repeated")
    few = many.limit(BROADCAST_REPEATED + 1).count() <= BROADCAST_REPEATED
    side = F.broadcast(many) if few else many
    single = docs.join(side, F.col(key) == F.col("many"), "left_anti").withColumn(place, F.lit(1).cast("long"))
    if many.isEmpty():
        return docs.withColumn(place, F.lit(1).cast("long"))
    part = place + "_part"
    repeated = written(docs.join(side, F.col(key) == F.col("many"), "left_semi").withColumn(part, F.spark_partition_id()), "repeated-rows")
    sizes = repeated.groupBy(F.col(key).alias("k"), F.col(part).alias("p")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("k", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(key, part).orderBy(F.lit(1)))
    numbered = repeated.withColumn(place, own).join(sizes, (F.col(key) == F.col("k")) & (F.col(part) == F.col("p")))
    numbered = numbered.withColumn(place, F.col(place) + F.col("before")).drop("k", "p", "before", part)
    return single.unionByName(numbered)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """docs with each row repeated by its count, in an order that a hash shuffles globally. copy_no is a long:
    0, 1, ... in a run of draws, and run r begins at r * RUN * MOST."""
    columns = [c for c in docs.columns if c != "copy_no"]
    prefix = "_mix"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    mine = {c: f"{prefix}_{c}" for c in ("source", "rate", "steps", "cdf", "n", "key", "run", "draw", "place")}
    table = rates(docs, weights, epochs)
    steps = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("long")
    table = table.withColumn("steps", steps).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("steps")))
    table = table.select(*[F.col(c).alias(mine[c]) for c in ("source", "rate", "steps", "cdf")])
    few = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    key = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]))
    named = _numbered(docs.select(*columns, key.alias(mine["draw"])), mine["draw"], mine["place"])
    joined = named.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col(mine["source"])))
    joined = joined.where(F.col(mine["rate"]) > 0)
    runs = joined.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(mine["steps"]) - 1) / RUN))).alias(mine["run"]))
    if (table.agg(F.max(mine["steps"])).first()[0] or 0) > RUN:
        runs = runs.repartition(F.xxhash64(mine["draw"], mine["place"], mine["run"]))
    first, last = F.col(mine["run"]) * RUN + 1, F.least((F.col(mine["run"]) + 1) * RUN, F.col(mine["steps"]))
    draws = F.transform(F.sequence(first, last), lambda j: uniform(F.lit(seed), F.col(mine["draw"]), F.col(mine["place"]), j))
    n = F.aggregate(draws, F.lit(0).cast("long"), lambda acc, u: acc + F.size(F.filter(F.col(mine["cdf"]), lambda c: c < u)))
    copies = runs.withColumn(mine["n"], n).where(F.col(mine["n"]) > 0)
    numbers = F.sequence(F.lit(0).cast("long"), F.col(mine["n"]) - 1)
    copies = copies.select(*columns, mine["run"], mine["draw"], mine["place"], F.explode(numbers).alias("copy_no")).withColumn("copy_no", F.col("copy_no") + F.col(mine["run"]) * (RUN * MOST))
    place = F.xxhash64(F.lit(seed), F.col("copy_no"), F.col(mine["draw"]), F.col(mine["place"]))
    shuffled = copies.select(*columns, "copy_no", place.alias(mine["key"]))
    return shuffled.repartition(mine["key"]).sortWithinPartitions(mine["key"]).drop(mine["key"])
