"""Queries of attached columns, reshaping, audits, nested samples, thresholds chosen on val, and file round trips."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import evaluate, sampling, scorers, tables
from quillspark.plans.base import ORACLES, query
from quillspark.plans.metrics import _F1, _SCORED, confusion_metrics, scored
from quillspark.sources import arrays, files
from quillspark.sources.canonical import table
from quillspark.sources.stage import stage_path, staged


@query("SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def attached_columns(spark, sf_dir):
    """Labels on documents by key; of the label side only columns that the documents lack."""
    left = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    right = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", F.lit("other").alias("lang"))
    return tables.merge_samples(left, right, "doc_id", [], [])


@query("""WITH a AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) AS k FROM part),
b AS (SELECT p_partkey AS other, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_partkey, p_name, other, p_retailprice FROM a JOIN b USING (k)""")
def merged_by_position(spark, sf_dir):
    """Items beside items in another order: as many rows on both sides, no common key."""
    part = table(spark, sf_dir, "part")
    left, right = part.select("p_partkey", "p_name"), part.select(F.col("p_partkey").alias("other"), "p_retailprice")
    return tables.merge_samples(left, right, "sample_id", [F.col("p_partkey")], [F.desc("p_retailprice"), F.col("other")])


@query(f"SELECT lang, precision, recall, f1 FROM ({ORACLES['confusion_metrics']})")
def metrics_pivot(spark, sf_dir):
    names = ["precision", "recall", "f1"]
    m = confusion_metrics(spark, sf_dir)
    long = m.select("lang", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("x")).select("lang", "x.*")
    return tables.pivoted(long, "lang", "metric", "value", names)


@query("""WITH a AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, ' Yes, it is'), (-1, 1, 'NO.'), (-1, 2, 'nothing'), (-1, 3, 'maybe yes'), (-1, 4, NULL)) t)
SELECT conv_id, turn, CASE WHEN starts_with(lower(trim(coalesce(text, ''))), 'yes') THEN 1 ELSE 0 END AS answer FROM a""")
def answer_by_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    more = spark.createDataFrame([(-1, k, t) for k, t in enumerate([" Yes, it is", "NO.", "nothing", "maybe yes", None])], c.schema)
    return c.unionByName(more).select("conv_id", "turn", tables.answer_number(F.col("text")).alias("answer"))


@query("""WITH l AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS one, CASE WHEN event_id % 5 = 0 THEN NULL ELSE string_split(event_type, 'i') END AS many FROM events)
SELECT event_id, CASE WHEN one IS NULL THEN 0 ELSE 1 END AS n_one, coalesce(one, '') AS one, coalesce(len(many), 0) AS n_many, coalesce(array_to_string(many, '|'), '') AS many FROM l""")
def coerced_lists(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    strings = T.ArrayType(T.StringType())
    one = tables.as_list(F.when(F.col("event_id") % 7 != 0, F.col("event_type")), T.StringType())
    many = tables.as_list(F.when(F.col("event_id") % 5 != 0, F.split("event_type", "i")), strings)
    return e.select("event_id", F.size(one).alias("n_one"), F.array_join(one, "|").alias("one"), F.size(many).cast("long").alias("n_many"), F.array_join(many, "|").alias("many"))


_DRAW = "row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '{}'), doc_id)"


@query(f"WITH a AS (SELECT *, {_DRAW.format('seed42')} AS r FROM labels), b AS (SELECT *, {_DRAW.format('seed43')} AS s FROM a WHERE r <= 40) SELECT doc_id, quality, s AS sample_rank FROM b WHERE s <= 15")
def nested_subsample(spark, sf_dir):
    return sampling.nested(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", 40, 15, "doc_id", 42)


@query(f"WITH a AS (SELECT *, {_DRAW.format('seed7')} AS r FROM labels) SELECT doc_id, quality FROM a WHERE r <= 5")
def strict_balanced_sample(spark, sf_dir):
    return sampling.strict(table(spark, sf_dir, "labels"), "quality", 5, "doc_id", "seed7").select("doc_id", "quality")


@query(f"WITH a AS (SELECT *, {_DRAW.format('seed7')} AS r FROM labels) SELECT doc_id, quality FROM a WHERE r > 5")
def remaining_pool(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return sampling.remaining(labels, sampling.balanced(labels, "quality", 5, "doc_id", "seed7"), "doc_id")


@query(f"WITH a AS (SELECT *, {_DRAW.format('seed7')} AS r FROM labels), x AS (SELECT doc_id FROM a WHERE r <= 30), y AS (SELECT doc_id FROM a WHERE r > 20) SELECT count(*) AS n_common FROM x SEMI JOIN y USING (doc_id)")
def common_keys(spark, sf_dir):
    """Keys that two samples share, counted; 0 would show that they are disjoint."""
    r = sampling.ranked(table(spark, sf_dir, "labels").select("doc_id", "quality"), ["quality"], "doc_id", "seed7")
    return r.where("sample_rank <= 30").select("doc_id").join(r.where("sample_rank > 20").select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("n_common"))


_AUDITED = {"labels": ["doc_id", "quality", "toxic"], "benchmark": ["item_id", "text"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "conversations": ["conv_id", "turn", "role", "text"]}
_AUDIT = " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", '{c}' AS "column", any_value(replace(replace(lower(typeof({c})), 'varchar', 'string'), 'integer', 'int')) AS type, count(*) AS rows, count(*) - count({c}) AS nulls FROM {t}"""
    for t, cs in _AUDITED.items() for c in cs
)


@query(_AUDIT)
def dataset_audit(spark, sf_dir):
    return tables.audit({t: table(spark, sf_dir, t).select(*cs) for t, cs in _AUDITED.items()})


@query(f"""WITH a AS ({_AUDIT}) SELECT "table", '{{"rows":' || max(rows) || ',"columns":[' || string_agg('{{"column":"' || "column" || '","type":"' || type || '","nulls":' || nulls || '}}', ',' ORDER BY "column") || ']}}' AS document FROM a GROUP BY "table\"""")
def audit_documents(spark, sf_dir):
    return tables.audit_document(dataset_audit(spark, sf_dir))


@query("SELECT l_returnflag, unnest([0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS q, unnest(quantile_disc(l_quantity, [0.5, 0.75, 0.9, 0.95, 0.99])) AS hours FROM lineitem GROUP BY l_returnflag")
def approximate_quantiles(spark, sf_dir):
    """Approximate quantiles: mergeable sketches, no sort; as exact as their accuracy, here over few distinct values."""
    shares = [0.5, 0.75, 0.9, 0.95, 0.99]
    a = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_quantity", shares, 100_000).alias("v"))
    return a.select("l_returnflag", F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("q"), F.col("v").alias("hours"))).alias("x")).select("l_returnflag", "x.q", "x.hours")


_WITHIN = 0.0133  # three times the normal rank error of sketches with k = 600


@query("SELECT event_type, q, count(value) AS n, true AS within FROM events, (SELECT unnest([0.01, 0.25, 0.5, 0.9, 0.99]::DOUBLE[]) AS q) GROUP BY event_type, q")
def sketched_quantiles(spark, sf_dir):
    """Rank sketches of each day's values, stored, merged over the days: within says whether an estimate's rank among the values is as near as the sketch promises."""
    events = table(spark, sf_dir, "events")
    by_day = staged(events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.kll_sketch_agg_double("value", F.lit(600)).alias("sketch")), "sketches")
    shares = F.array(*[F.lit(q) for q in (0.01, 0.25, 0.5, 0.9, 0.99)])
    whole = by_day.groupBy("event_type").agg(F.kll_merge_agg_double("sketch", F.lit(600)).alias("sketch"))
    asked = whole.select(F.col("event_type").alias("kind"), F.explode(F.arrays_zip(shares.alias("q"), F.kll_sketch_get_quantile_double("sketch", shares).alias("v"))).alias("x")).select("kind", "x.q", "x.v")
    ranked = events.join(asked, F.col("event_type") == F.col("kind")).groupBy("event_type", "q").agg(F.count("value").alias("n"), F.count_if(F.col("value") <= F.col("v")).alias("below"))
    return ranked.select("event_type", "q", "n", (F.abs(F.col("below") / F.col("n") - F.col("q")) <= _WITHIN).alias("within"))


_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INTEGER) AS y, {", ".join(_LINE)} FROM lineitem),
m AS (SELECT {", ".join(f"avg({c}) FILTER (WHERE y = {k}) AS {c}_m{k}" for c in _LINE for k in (0, 1))}, {", ".join(f"var_pop({c}) AS {c}_v" for c in _LINE)}, avg(y) AS rate FROM x),
w AS (SELECT *, {", ".join(f"({c}_m1 - {c}_m0) / {c}_v AS {c}_w" for c in _LINE)} FROM m)
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(ln(rate / (1 - rate)) + {" + ".join(f"{c}_w * ({c} - ({c}_m0 + {c}_m1) / 2)" for c in _LINE)}))), 6) AS score FROM x, w""")
def batch_linear_scores(spark, sf_dir):
    """A linear discriminant with variances only, fitted by sums over the lines and applied in Arrow batches; its few numbers are sent once to each executor."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("|", "l_orderkey", "l_linenumber").alias("line"), (F.col("l_returnflag") == "R").alias("y"), *_LINE)
    of = lines.agg(*[F.avg(F.when(F.col("y") == bool(k), F.col(c))).alias(f"{c}_m{k}") for c in _LINE for k in (0, 1)], *[F.var_pop(c).alias(f"{c}_v") for c in _LINE], F.avg(F.col("y").cast("int")).alias("rate")).first()
    weights = {c: (of[f"{c}_m1"] - of[f"{c}_m0"]) / of[f"{c}_v"] for c in _LINE}
    start = math.log(of["rate"] / (1 - of["rate"])) - sum(w * (of[f"{c}_m0"] + of[f"{c}_m1"]) / 2 for c, w in weights.items())
    model = spark.sparkContext.broadcast((start, weights))

    def make():
        start, weights = model.value
        return lambda b: 1 / (1 + np.exp(-(start + sum(w * b[c] for c, w in weights.items()))))

    scores = scorers.batch_scorer(lines.select("line", *_LINE), make, key="line")
    place = F.split("line", r"\|")
    return scores.select(place[0].cast("long").alias("l_orderkey"), place[1].cast("int").alias("l_linenumber"), F.round("score", 6).alias("score"))


@query("SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings")
def array_source(spark, sf_dir):
    """The embeddings written as dense array files with an index of their rows, and read again by ranges of rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = stage_path(spark, "arrays")
    arrays.write_arrays(vectors, path, "vec_id", "embedding")
    return arrays.read_arrays(spark, path, "vec_id").select("vec_id", F.transform("values", lambda x: x.cast("double")).alias("embedding"))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 997 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS customer, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders")
def csv_sniffed(spark, sf_dir):
    """Orders through CSV without a schema: types guessed from the first lines and widened where a later value differs, in one scan of all."""
    orders = table(spark, sf_dir, "orders")
    customer = F.when(F.col("o_orderkey") % 997 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    path = stage_path(spark, "sniffed")
    orders.select("o_orderkey", "o_totalprice", customer.alias("customer"), F.to_date("o_orderdate").alias("day"), "o_orderstatus").write.option("header", True).csv(path)
    return files.read_csv_sniffed(spark, path)


_CHOSEN = _SCORED + f""", g AS (SELECT 0.01::DOUBLE + i * 0.01::DOUBLE AS t FROM range(0, 99) r(i)), val AS (SELECT * FROM scored WHERE doc_id % 2 = 1),
a AS (SELECT t, count(*) FILTER (WHERE y = 1 AND score >= t) AS tp, count(*) FILTER (WHERE y = 0 AND score >= t) AS fp, count(*) FILTER (WHERE y = 1 AND score < t) AS fn FROM g, val GROUP BY t),
f AS (SELECT t, round({_F1}, 12) AS f1 FROM a), best AS (SELECT min(t) AS threshold FROM f WHERE f1 = (SELECT max(f1) FROM f))"""
_COUNTS = "count(*) FILTER (WHERE y = 1 AND p) AS tp, count(*) FILTER (WHERE y = 0 AND p) AS fp, count(*) FILTER (WHERE y = 0 AND NOT p) AS tn, count(*) FILTER (WHERE y = 1 AND NOT p) AS fn"


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = scored(spark, sf_dir)
    return s.where("doc_id % 2 = 1"), s.where("doc_id % 2 = 0"), evaluate.linspace(s, 0.01, 0.99, 99)


@query(f"""WITH {_CHOSEN}, x AS (SELECT threshold, y, score >= threshold AS p FROM scored, best WHERE doc_id % 2 = 0), c AS (SELECT threshold, {_COUNTS} FROM x GROUP BY threshold)
SELECT round(threshold, 9) AS threshold, tp, fp, tn, fn, {_F1} AS f1, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy FROM c""")
def val_threshold_on_test(spark, sf_dir):
    """The best threshold of val (odd ids), applied to test (even ids)."""
    val, test, grid = _halves(spark, sf_dir)
    return evaluate.threshold_on_test(val, test, grid).select(F.round("threshold", 9).alias("threshold"), "tp", "fp", "tn", "fn", "f1", "accuracy")


@query(f"""WITH {_CHOSEN}, x AS (SELECT CASE WHEN doc_id % 2 = 1 THEN 'val' ELSE 'test' END AS split, y, score, doc_id FROM scored),
m AS (SELECT split, 'fixed' AS mode, y, score >= 0.5 AS p FROM x UNION ALL SELECT split, 'generated', y, doc_id % 3 = 0 FROM x UNION ALL SELECT split, 'val_best', y, score >= threshold FROM x, best),
c AS (SELECT split, mode, {_COUNTS} FROM m GROUP BY split, mode) SELECT split, mode, {_F1} AS f1, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy FROM c""")
def decision_modes_by_split(spark, sf_dir):
    """Three ways to decide on both splits: a fixed threshold, the generated answer, and the best threshold of val."""
    val, test, grid = _halves(spark, sf_dir)
    both = val.withColumn("split", F.lit("val")).unionByName(test.withColumn("split", F.lit("test")))
    both = both.crossJoin(F.broadcast(evaluate.best_threshold(val, grid).select("threshold")))  # one row
    modes = {"fixed": F.col("score") >= 0.5, "generated": F.col("doc_id") % 3 == 0, "val_best": F.col("score") >= F.col("threshold")}
    long = both.select("split", "y", F.explode(F.array(*[F.struct(F.lit(k).alias("mode"), p.alias("pred")) for k, p in modes.items()])).alias("m")).select("split", "y", "m.*")
    return evaluate.confusion(long, ["split", "mode"], F.col("pred")).select("split", "mode", "f1", "accuracy")


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN repeat(p_name || '  ' || p_type || ' ', 40) ELSE ' ' END AS retrieval, p_name, p_type, CASE WHEN p_size % 2 = 0 THEN p_brand END AS p_brand, repeat(p_name || chr(10), 60) AS d FROM part),
s AS (SELECT *, trim(regexp_replace(retrieval, '\\s+', ' ', 'g')) AS r, substr(trim(regexp_replace(d, '\\s+', ' ', 'g')), 1, 700) AS description FROM t)
SELECT p_partkey, CASE WHEN r <> '' THEN substr(r, 1, 1200) ELSE substr(concat_ws(' | ', 'game_title: ' || substr(p_name, 1, 300), 'genres: ' || substr(p_type, 1, 300), 'categories: ' || substr(p_brand, 1, 300), 'description: ' || description), 1, 1500) END AS item_text FROM s""")
def item_texts(spark, sf_dir):
    """Text of an item for embeddings: a third of the items have retrieval text of their own."""
    p = table(spark, sf_dir, "part")
    retrieval = F.when(F.col("p_partkey") % 3 == 0, F.repeat(F.concat("p_name", F.lit("  "), "p_type", F.lit(" ")), 40)).otherwise(F.lit(" "))
    parts = {"game_title": F.col("p_name"), "genres": F.col("p_type"), "categories": F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), "description": F.repeat(F.concat("p_name", F.lit("\n")), 60)}
    return p.select("p_partkey", tables.item_text(retrieval, parts).alias("item_text"))


@query("SELECT doc_id, quality, toxic FROM labels")
def csv_round_trip(spark, sf_dir):
    """A small table written as CSV with a header and read again with inferred types."""
    path = stage_path(spark, "csv")
    files.write_small_csv(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), path)
    return files.read_csv(spark, path, columns=["doc_id", "quality", "toxic"]).select(F.col("doc_id").cast("long"), F.col("quality").cast("long"), F.col("toxic").cast("long"))


@query("SELECT doc_id, lang, length(text) AS chars, md5(text) AS digest FROM documents")
def json_lines_round_trip(spark, sf_dir):
    """Documents as JSON lines, a folder for each language, read again with a declared schema."""
    path = stage_path(spark, "jsonl")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    files.write_json_lines(docs, path, ["doc_id", "text"], by="lang")
    back = files.read_json_lines(spark, path, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]))
    return back.select("doc_id", "lang", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query("SELECT event_id, event_type, value FROM events")
def sorted_parquet_round_trip(spark, sf_dir):
    path = stage_path(spark, "sorted")
    files.write_sorted_parquet(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, ["event_type", "event_id"])
    return spark.read.parquet(path)
