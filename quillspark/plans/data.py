"""Queries of scans, profiles, cleaning, histories, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import numeric, text
from quillspark.operators import clean, encoding, evaluate, history, profile, sampling
from quillspark.operators.ranks import numbers_within
from quillspark.plans.base import CLEANED, HIST, ORACLES, SEQUENCE, SPLIT, query
from quillspark.sources import canonical, versioned
from quillspark.sources.canonical import SQL_INTERACTIONS, SQL_ITEMS, table
from quillspark.sources.stage import staged_once, stage_path


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.cleaned(canonical.interactions(spark, sf_dir))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews are dealt by user once: the latest of each pair, the counts and the histories need no other shuffle."""
    return clean.with_sequence(clean.cleaned(canonical.interactions(spark, sf_dir).repartition("user_id")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with their histories, which most plans build on: computed once in a session."""
    return staged_once(spark, f"candidates {sf_dir}", lambda: history.histories(sequence(spark, sf_dir)))


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.temporal_split(candidates(spark, sf_dir))


@query(f"""WITH {SQL_INTERACTIONS} SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT app_id) AS items, min(date) AS first_date, max(date) AS last_date,
CAST(sum(CASE WHEN is_recommended THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM interactions""")
def interaction_profile(spark, sf_dir):
    return canonical.interactions(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("app_id").alias("items"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if("is_recommended").alias("positives"))


@query("SELECT quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, quantile_cont(l_quantity, 0.9) AS q90, quantile_cont(l_quantity, 0.95) AS q95, quantile_cont(l_quantity, 0.99) AS q99 FROM lineitem")
def hours_quantiles_exact(spark, sf_dir):
    return _quantile_row(table(spark, sf_dir, "lineitem"), "l_quantity", {p: f"q{round(100 * p)}" for p in (0.5, 0.75, 0.9, 0.95, 0.99)})


def _quantile_row(df: DataFrame, value: str, names: dict[float, str]) -> DataFrame:
    found = evaluate.exact_quantiles(df, value, list(names))
    return found.agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n) for p, n in names.items()])


@query(f"""WITH {SQL_INTERACTIONS}, c AS (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id)
SELECT quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.9) AS q90, quantile_cont(n, 0.99) AS q99, max(n) AS most, avg(n) AS mean FROM c""")
def user_activity_quantiles(spark, sf_dir):
    n = canonical.interactions(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    quantiles = _quantile_row(n, "n", {0.5: "q50", 0.9: "q90", 0.99: "q99"})
    return quantiles.crossJoin(F.broadcast(n.agg(F.max("n").alias("most"), F.avg("n").alias("mean"))))  # one row each


@query(f"WITH {SQL_INTERACTIONS} SELECT user_id, app_id, count(*) AS n FROM interactions GROUP BY user_id, app_id HAVING count(*) > 1")
def duplicate_pairs(spark, sf_dir):
    return clean.duplicated(canonical.interactions(spark, sf_dir), ["user_id", "app_id"])


@query(f"WITH {CLEANED} SELECT user_id, app_id, date, is_recommended, hours, review_id, ship_date, price FROM cleaned")
def dedup_latest(spark, sf_dir):
    return cleaned(spark, sf_dir)


@query(f"WITH {SEQUENCE} SELECT user_id, app_id, date, review_id, user_interaction_count, CAST(user_interaction_idx AS INTEGER) AS user_interaction_idx, CAST(reverse_idx AS INTEGER) AS reverse_idx FROM seq")
def eligible_interactions(spark, sf_dir):
    return sequence(spark, sf_dir).select("user_id", "app_id", "date", "review_id", "user_interaction_count", "user_interaction_idx", "reverse_idx")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM lineitem GROUP BY l_returnflag, l_linestatus")
def label_balance_pct(spark, sf_dir):
    return profile.percent_of_total(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(f"""WITH {SQL_INTERACTIONS}, c AS (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id)
SELECT n AS user_interaction_count, count(*) AS users FROM c GROUP BY n ORDER BY n LIMIT 20""")
def activity_histogram_smallest(spark, sf_dir):
    n = canonical.interactions(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("user_interaction_count"))
    return n.groupBy("user_interaction_count").agg(F.count("*").alias("users")).orderBy("user_interaction_count").limit(20)


def item_dimension_of(spark, sf_dir, chars: int | None = 60) -> DataFrame:
    """chars: how much of a text is its description, before it is normalized; None is the whole text."""
    counts = canonical.interactions(spark, sf_dir).groupBy("app_id").agg(F.count("*").alias("interaction_count"), F.countDistinct("user_id").alias("user_count"))
    items = clean.first_of(canonical.items(spark, sf_dir), ["app_id"], ["game_title"])
    described_by = F.col("text") if chars is None else F.substring("text", 1, chars)
    described = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("app_id"), text.normalize(described_by).alias("description"))
    return items.join(counts, "app_id", "left").join(described, "app_id", "left").withColumn("interaction_count", F.coalesce("interaction_count", F.lit(0)))


@query(f"""WITH {SQL_INTERACTIONS}, {SQL_ITEMS}, c AS (SELECT app_id, count(*) AS interaction_count, count(DISTINCT user_id) AS user_count FROM interactions GROUP BY app_id)
SELECT app_id, game_title, price, required_age, coalesce(interaction_count, 0) AS interaction_count, user_count,
  nullif(trim(regexp_replace(d.text, '[\\r\\n]', ' ', 'g')), '') AS description, coalesce(nullif(trim(d.source), ''), genres) AS origin
FROM items LEFT JOIN c USING (app_id) LEFT JOIN documents d ON d.doc_id = app_id""")
def item_dimension(spark, sf_dir):
    return _with_origin(spark, sf_dir, None)


def _with_origin(spark, sf_dir, chars: int | None) -> DataFrame:
    origin = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("app_id"), "source")
    df = item_dimension_of(spark, sf_dir, chars).join(origin, "app_id", "left")
    return df.select("app_id", "game_title", "price", "required_age", "interaction_count", "user_count", "description", F.coalesce(F.nullif(F.trim("source"), F.lit("")), "genres").alias("origin"))


@query(ORACLES["item_dimension"])
def item_dimension_whole(spark, sf_dir):
    """item_dimension under the name that it had when its texts were cut."""
    return _with_origin(spark, sf_dir, None)


@query(f"""WITH {SQL_INTERACTIONS}, c AS (SELECT app_id, count(*) AS w FROM interactions GROUP BY app_id)
SELECT count(*) AS n_keys, count(*) FILTER (WHERE v.vec_id IS NOT NULL) AS covered, CAST(sum(w) AS BIGINT) AS weight, CAST(coalesce(sum(w) FILTER (WHERE v.vec_id IS NOT NULL), 0) AS BIGINT) AS covered_weight
FROM c LEFT JOIN embeddings v ON v.vec_id = c.app_id""")
def item_coverage_weighted(spark, sf_dir):
    c = canonical.interactions(spark, sf_dir).groupBy("app_id").agg(F.count("*").alias("w"))
    return profile.coverage(c, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("app_id")), "app_id", "w")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT 'event_id' AS "column", count(*) - count(event_id) AS nulls, (count(*) - count(event_id))::DOUBLE / count(*) AS share FROM e
UNION ALL SELECT 'event_type', count(*) - count(event_type), (count(*) - count(event_type))::DOUBLE / count(*) FROM e
UNION ALL SELECT 'value', count(*) - count(value), (count(*) - count(value))::DOUBLE / count(*) FROM e""")
def null_share(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return profile.null_report(e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value")))


@query("""WITH e AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, event_id % 10 AS w FROM events)
SELECT 'event_type' AS "column", sum(w) FILTER (WHERE event_type IS NULL)::DOUBLE / sum(w) AS share FROM e UNION ALL SELECT 'value', sum(w) FILTER (WHERE value IS NULL)::DOUBLE / sum(w) FROM e""")
def weighted_null_share(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.select(F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), (F.col("event_id") % 10).alias("w"))
    return profile.weighted_null_share(e, ["event_type", "value"], "w")


@query(f"WITH {SQL_INTERACTIONS} SELECT DISTINCT user_id, app_id FROM interactions")
def distinct_pairs(spark, sf_dir):
    return canonical.interactions(spark, sf_dir).select("user_id", "app_id").distinct()


@query("SELECT conv_id, turn, role, length(text) AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations) WHERE rn = 1")
def keep_first(spark, sf_dir):
    return clean.first_of(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query(f"""WITH {HIST} SELECT c.user_id, any_value(c.target_app_id) AS target_app_id, any_value(c.target_date) AS target_date, any_value(c.label) AS label, any_value(c.history_len) AS history_len,
  string_agg(CAST(h.app_id AS VARCHAR), ',' ORDER BY pos) AS history_app_ids, string_agg(CAST(h.label AS VARCHAR), ',' ORDER BY pos) AS history_labels, string_agg(CAST(h.date AS VARCHAR), ',' ORDER BY pos) AS history_dates
FROM cand c JOIN hist h ON c.user_id = h.user_id GROUP BY c.user_id""")
def history_window(spark, sf_dir):
    df = history.parallel_arrays(candidates(spark, sf_dir))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return df.select("user_id", "target_app_id", "target_date", "label", "history_len", joined("history_app_ids"), joined("history_labels"), joined("history_dates"))


@query(f"""WITH {HIST}, {SQL_ITEMS} SELECT c.user_id, any_value(t.game_title) AS target_title, string_agg((pos + 1) || '. ' || i.game_title, chr(10) ORDER BY pos) AS history_titles, string_agg(i.tags, '|' ORDER BY pos) AS history_tags
FROM cand c JOIN hist h ON c.user_id = h.user_id LEFT JOIN items i ON i.app_id = h.app_id LEFT JOIN items t ON t.app_id = c.target_app_id GROUP BY c.user_id""")
def history_enriched(spark, sf_dir):
    df = history.with_items(candidates(spark, sf_dir), canonical.items(spark, sf_dir))
    return df.select("user_id", F.col("target_game_title").alias("target_title"), text.numbered(F.col("history_game_title")).alias("history_titles"), F.array_join("history_tags", "|").alias("history_tags"))


@query(f"WITH {SPLIT} SELECT * FROM bounds")
def temporal_bounds(spark, sf_dir):
    return history.boundaries(candidates(spark, sf_dir))


@query(f"WITH {SPLIT} SELECT split, label, count(*) AS n FROM split GROUP BY split, label")
def temporal_split_counts(spark, sf_dir):
    return splits(spark, sf_dir).groupBy("split", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {HIST}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY target_date, user_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM cand)
SELECT user_id, label, CASE WHEN r <= 0.8 * n THEN 'train' WHEN r <= 0.9 * n THEN 'val' ELSE 'test' END AS split FROM r""")
def rank_fraction_split(spark, sf_dir):
    return history.rank_fraction_split(candidates(spark, sf_dir).select("user_id", "label", "target_date")).select("user_id", "label", "split")


@query(f"""WITH {SPLIT}, r AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY md5(user_id || 's1'), user_id) AS sample_rank FROM split)
SELECT split, label, user_id, CAST(sample_rank AS INTEGER) AS sample_rank FROM r WHERE (split = 'train' AND sample_rank <= 400) OR (split IN ('val', 'test') AND sample_rank <= 50)""")
def hash_quota_sample(spark, sf_dir):
    return sampling.quota_sample(splits(spark, sf_dir), {"train": 400, "val": 50, "test": 50}, "split", ["split", "label"], "user_id", "s1").select("split", "label", "user_id", "sample_rank")


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || 'seed42'), doc_id) AS r FROM labels)
SELECT r.doc_id, quality, length(text) AS chars FROM r JOIN documents USING (doc_id) WHERE r <= 40""")
def balanced_sample(spark, sf_dir):
    s = sampling.balanced(table(spark, sf_dir, "labels"), "quality", 40, "doc_id", "seed42")
    return table(spark, sf_dir, "documents").join(s, "doc_id").select("doc_id", "quality", F.length("text").cast("long").alias("chars"))


@query(f"""WITH {HIST}, r AS (SELECT user_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(user_id || 'c'), user_id) AS r FROM cand)
SELECT user_id, label, CAST(1 + (r - 1) // 60 AS INTEGER) AS chunk FROM r WHERE r <= 180""")
def disjoint_chunks(spark, sf_dir):
    c = candidates(spark, sf_dir).select("user_id", "label")
    return sampling.chunk(c, "label", 180, 1, "user_id", "c").select("user_id", "label", F.ceil(F.col("sample_rank") / 60).cast("int").alias("chunk"))


@query("""SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || 'f'), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels""")
def stratified_folds(spark, sf_dir):
    return sampling.folds(table(spark, sf_dir, "labels"), "quality", 5, "doc_id", "f").select("doc_id", "quality", "fold")


@query(f"""WITH {CLEANED}, q AS (SELECT app_id, quantile_cont(hours, 0.5) AS med, quantile_cont(hours, 0.75) AS p75 FROM cleaned GROUP BY app_id),
r AS (SELECT c.*, coalesce(CASE WHEN med > 0 THEN med END, CASE WHEN p75 > 0 THEN p75 END, 1.0) AS reference FROM cleaned c JOIN q USING (app_id))
SELECT user_id, app_id, reference, CASE WHEN hours <= 0 THEN 'zero' WHEN hours < 1 THEN 'very_low_0_1' WHEN hours < 5 THEN 'low_1_5' WHEN hours < 20 THEN 'medium_5_20' WHEN hours < 100 THEN 'high_20_100' ELSE 'very_high_100_plus' END AS bucket,
  is_recommended AS label_strict, is_recommended AND hours >= 2 AS label_hybrid, hours / reference >= 1 AS label_hours_relative, is_recommended AND hours < 2 AS is_low_hours_positive, NOT is_recommended AND hours / reference >= 1 AS is_high_hours_negative FROM r""")
def hours_reference_labels(spark, sf_dir):
    c = cleaned(spark, sf_dir)
    q = c.groupBy("app_id").agg(F.percentile("hours", F.lit(0.5)).alias("med"), F.percentile("hours", F.lit(0.75)).alias("p75"))
    c = c.join(q, "app_id").withColumn("reference", numeric.hours_reference(F.col("med"), F.col("p75")))
    labels = numeric.label_variants(F.col("is_recommended"), F.col("hours"), F.col("reference"))
    return c.select("user_id", "app_id", "reference", numeric.hours_bucket(F.col("hours")).alias("bucket"), *[x.alias(k) for k, x in labels.items()])


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0) AS even FROM events GROUP BY event_type")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").withColumn("k", k).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k_sum"), F.count_if(F.col("k") % 2 == 0).alias("even"))


@query("SELECT year(o_orderdate) AS release_year, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT NULL, 1")
def release_year(spark, sf_dir):
    dates = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    bad = spark.createDataFrame([("not a date",)], "d string")
    return dates.unionByName(bad).select(F.year(F.try_to_timestamp("d", F.lit("yyyy-MM-dd"))).cast("long").alias("release_year")).groupBy("release_year").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) FILTER (WHERE value < 50) AS low, count(*) FILTER (WHERE value >= 50) AS high FROM events GROUP BY event_type")
def crosstab_pivot(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("level", F.when(F.col("value") < 50, "low").otherwise("high"))
    return profile.crosstab(e, "event_type", "level", ["low", "high"])


@query("""SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25,
round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM events GROUP BY event_type""")
def describe_stats(spark, sf_dir):
    d = profile.describe(table(spark, sf_dir, "events"), "value", "event_type")
    return d.select("event_type", "count", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@query(f"WITH {SPLIT} SELECT split, count(*) AS n, CAST(sum(CAST(label AS INTEGER)) AS BIGINT) AS positives, avg(CAST(label AS DOUBLE)) AS rate FROM split GROUP BY split")
def label_balance(spark, sf_dir):
    return profile.label_balance(splits(spark, sf_dir), "label", "split")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(coalesce(CAST(p_name AS VARCHAR), '')), 'an') OR contains(lower(coalesce(p_type, '')), 'an') OR contains(lower(coalesce(p_brand, '')), 'an') OR contains(CAST(p_partkey AS VARCHAR), 'an')")
def any_column_search(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(text.any_contains([F.col(c) for c in ("p_name", "p_type", "p_brand", "p_partkey")], "AN")).select("p_partkey", "p_name")


_RATES = "SELECT '{0}' || l_returnflag AS method, avg(l_discount) AS rate, count(*) AS n FROM lineitem WHERE l_linestatus = '{1}' GROUP BY l_returnflag"


@query(f"""WITH o AS ({_RATES.format("flag_", "F")} UNION ALL {_RATES.format("old_", "F")}), n AS (SELECT * FROM ({_RATES.format("flag_", "O")}) WHERE n > 0)
SELECT method, round(rate, 9) AS rate, CAST(NULL AS BIGINT) AS n FROM o WHERE method NOT IN (SELECT method FROM n) AND method NOT LIKE 'old%' UNION ALL SELECT method, round(rate, 9), n FROM n""")
def metrics_upsert(spark, sf_dir):
    """Rates of the closed lines, with the methods of an old run, kept in a versioned table; then those of the open lines, some of the same methods, and the old ones retired."""
    lines = table(spark, sf_dir, "lineitem")

    def rates(prefix: str, status: str) -> DataFrame:
        g = lines.where(F.col("l_linestatus") == status).groupBy("l_returnflag").agg(F.avg("l_discount").alias("rate"), F.count("*").alias("n"))
        return g.select(F.concat(F.lit(prefix), "l_returnflag").alias("method"), "rate", "n")

    kept = versioned.VersionedTable(spark, stage_path(spark, "metrics"))
    kept.upsert(rates("flag_", "F").unionByName(rates("old_", "F")).drop("n"), "method")
    flags = [r["l_returnflag"] for r in lines.select("l_returnflag").distinct().collect()]  # a few letters
    kept.upsert(rates("flag_", "O"), "method", retired=tuple(f"old_{f}" for f in flags))
    return kept.read().select("method", F.round("rate", 9).alias("rate"), "n")


@query("""WITH q AS (SELECT l_returnflag AS k, quantile_cont(l_quantity, 0.5) AS v FROM lineitem GROUP BY l_returnflag), w AS (SELECT l_linestatus AS k, quantile_cont(l_quantity, 0.75) AS v FROM lineitem GROUP BY l_linestatus)
SELECT 'flag_' || k AS key, v AS value FROM q UNION ALL SELECT 'status_' || k, v FROM w""")
def threshold_store(spark, sf_dir):
    """Thresholds computed by two runs, kept as keys and values: the second run adds to the first's."""
    lines = table(spark, sf_dir, "lineitem")
    kept = versioned.VersionedTable(spark, stage_path(spark, "thresholds"))
    for prefix, by, q in (("flag_", "l_returnflag", 0.5), ("status_", "l_linestatus", 0.75)):
        found = evaluate.exact_quantiles(lines, "l_quantity", [q], [by])
        kept.upsert(found.select(F.concat(F.lit(prefix), by).alias("key"), "value"), "key")
    return kept.read()


@query(f"""WITH {CLEANED}, s AS (SELECT app_id, sum(CAST(is_recommended AS INTEGER)) AS p, count(*) AS n FROM cleaned GROUP BY app_id) SELECT app_id, CAST(p AS BIGINT) AS positives, n, p / n::DOUBLE AS rate FROM s""")
def item_popularity(spark, sf_dir):
    return encoding.popularity(cleaned(spark, sf_dir).withColumnRenamed("is_recommended", "label"))


@query(f"""WITH {SPLIT}, t AS (SELECT * FROM split WHERE split = 'train'), pr AS (SELECT avg(CAST(label AS DOUBLE)) AS prior FROM t), s AS (SELECT target_app_id, sum(CAST(label AS INTEGER)) AS p, count(*) AS n FROM t GROUP BY target_app_id)
SELECT user_id, split, round(CASE WHEN s.n IS NULL THEN prior ELSE (p + 10.0::DOUBLE * prior) / (s.n + 10) END, 9) AS item_score, round(ln(1 + coalesce(s.n, 0)), 9) AS item_log_count FROM split LEFT JOIN s USING (target_app_id), pr WHERE split <> 'train'""")
def smoothed_encoding(spark, sf_dir):
    s = splits(spark, sf_dir)
    out = encoding.encode(s.where("split != 'train'"), s.where("split = 'train'"), item="target_app_id")
    return out.select("user_id", "split", F.round("item_score", 9).alias("item_score"), F.round("item_log_count", 9).alias("item_log_count"))


_OOF = """f AS (SELECT user_id, app_id, CAST(is_recommended AS INTEGER) AS y, (row_number() OVER (PARTITION BY is_recommended ORDER BY md5(CAST(review_id AS VARCHAR) || 'oof'), review_id, ship_date, price, user_id, app_id) - 1) % 5 AS fold FROM cleaned),
tot AS (SELECT app_id, sum(y) AS p, count(*) AS n FROM f GROUP BY app_id), own AS (SELECT app_id, fold, sum(y) AS p, count(*) AS n FROM f GROUP BY app_id, fold),
pf AS (SELECT fold, sum(y) AS p, count(*) AS n FROM f GROUP BY fold), al AS (SELECT sum(y) AS p, count(*) AS n FROM f)"""


@query(f"""WITH {CLEANED}, {_OOF}
SELECT user_id, app_id, CAST(f.fold AS INTEGER) AS fold, round(CASE WHEN tot.n = own.n THEN (al.p - pf.p) / (al.n - pf.n)::DOUBLE ELSE (tot.p - own.p + 10.0::DOUBLE * (al.p - pf.p) / (al.n - pf.n)) / (tot.n - own.n + 10) END, 9) AS item_score,
  round(ln(1 + tot.n - own.n), 9) AS item_log_count FROM f JOIN tot USING (app_id) JOIN own ON own.app_id = f.app_id AND own.fold = f.fold JOIN pf ON pf.fold = f.fold, al""")
def oof_encoding(spark, sf_dir):
    c = cleaned(spark, sf_dir).withColumnRenamed("is_recommended", "label").withColumn("_d", F.unhex(sampling.drawn("review_id", "oof")))  # bytes, in the order of their digits
    c = numbers_within(c, "label", [F.col(x) for x in ("_d", "review_id", "ship_date", "price", "user_id", "app_id")], "_rank", "_n", ["user_id", "app_id", "label"])
    c = c.select("user_id", "app_id", "label", F.pmod(F.col("_rank") - 1, F.lit(5)).cast("int").alias("fold"))
    out = encoding.encode_out_of_fold(c)
    return out.select("user_id", "app_id", "fold", F.round("item_score", 9).alias("item_score"), F.round("item_log_count", 9).alias("item_log_count"))
