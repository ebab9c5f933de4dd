"""Queries of text functions, tokens, features, embeddings and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text, tokens
from quillspark.operators import features, history, profile, sampling, scorers
from quillspark.plans.base import HIST, SPLIT, query
from quillspark.plans.data import candidates, splits
from quillspark.sources import canonical
from quillspark.sources.canonical import SQL_EMBEDDINGS, SQL_ITEMS, table


@query("""WITH c AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, CASE WHEN s IN ('[]', '{}', 'nan', 'None', '<NA>') THEN '' WHEN length(s) > 80 THEN regexp_replace(substr(s, 1, 80), ' [^ ]*$', '') || '...' ELSE s END AS clean,
  CASE WHEN length(s) > 35 THEN rtrim(substr(s, 1, 35)) || '...' ELSE s END AS hard FROM c""")
def text_clean_truncate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.clean(F.col("text"), 80).alias("clean"), text.truncate_hard(text.collapse(F.col("text")), 35).alias("hard"))


@query("""WITH o AS (SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'none' WHEN 2 THEN CAST(p_size AS VARCHAR) ELSE format('{:,}', p_size * 1000) || ' - ' || format('{:,}', p_size * 2500) END AS owners FROM part)
SELECT p_partkey, owners, CASE WHEN p_partkey % 5 = 2 THEN p_size::DOUBLE WHEN p_partkey % 5 > 2 THEN p_size * 1000.0::DOUBLE END AS owners_min, CASE WHEN p_partkey % 5 = 2 THEN p_size::DOUBLE WHEN p_partkey % 5 > 2 THEN p_size * 2500.0::DOUBLE END AS owners_max,
  CASE WHEN p_partkey % 5 = 2 THEN p_size::DOUBLE WHEN p_partkey % 5 > 2 THEN p_size * 1750.0::DOUBLE END AS owners_mid FROM o""")
def owner_range_parse(spark, sf_dir):
    """Ranges of owners written from the parts' sizes, some empty, without a number or with one number only."""
    kind, size = F.col("p_partkey") % 5, F.col("p_size")
    written = F.when(kind == 0, "").when(kind == 1, "none").when(kind == 2, size.cast("string")).otherwise(F.concat(F.format_number(size * 1000, 0), F.lit(" - "), F.format_number(size * 2500, 0)))
    df = table(spark, sf_dir, "part").select("p_partkey", written.alias("owners"))
    low, high, mid = text.owner_range(F.col("owners"))
    return df.select("p_partkey", "owners", low.alias("owners_min"), high.alias("owners_max"), mid.alias("owners_mid"))


@query("""WITH a AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'Yes.'), (-1, 1, 'no'), (-1, 2, 'yes no'), (-1, 3, 'maybe'), (-1, 4, 'YES yes'), (-1, 5, 'nothing')) t),
m AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '\\b(yes|no)\\b', 1)) AS m FROM a) SELECT conv_id, turn, CASE WHEN len(m) = 1 THEN CAST(m[1] = 'yes' AS INTEGER) END AS answer FROM m""")
def parse_yes_no(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    more = spark.createDataFrame([(-1, k, t) for k, t in enumerate(["Yes.", "no", "yes no", "maybe", "YES yes", "nothing"])], c.schema)
    return c.unionByName(more).select("conv_id", "turn", text.parse_yes_no(F.col("text")).alias("answer"))


def _words_sql(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_CLASSES = "semantic AS (SELECT {} AS k), generic AS (SELECT {} AS k), junk AS (SELECT {} AS k)".format(*map(_words_sql, (tokens.SEMANTIC_KEYWORDS, tokens.GENERIC_KEYWORDS, tokens.JUNK_TOKENS)))


@query(f"""WITH {_CLASSES}, t AS (SELECT p_partkey, string_split(replace(p_name, ' ', ';') || ';Extra ' || upper(semantic.k[p_partkey % 45 + 1]) || ';' || semantic.k[p_size % 45 + 1] || ';' || generic.k[p_partkey % 15 + 1] || ';' || junk.k[p_partkey % 16 + 1], ';') AS w FROM part, semantic, generic, junk),
u AS (SELECT p_partkey, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM t),
f AS (SELECT p_partkey, lower(t) AS l, min(i) AS i, arg_min(t, i) AS t FROM u WHERE t <> '' GROUP BY p_partkey, lower(t)),
p AS (SELECT f.*, list_position(list_transform(semantic.k, lambda k: contains(l, k)), true) AS s, list_position(list_transform(generic.k, lambda k: contains(l, k)), true) AS g,
  len(list_filter(junk.k, lambda k: contains(l, k))) > 0 AS dropped FROM f, semantic, generic, junk),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN s > 0 THEN 0 WHEN g > 0 THEN 1 ELSE 2 END, CASE WHEN s > 0 THEN s WHEN g > 0 THEN g ELSE 0 END, i) AS r FROM p WHERE NOT dropped)
SELECT p_partkey, string_agg(t, ', ' ORDER BY r) FILTER (WHERE r <= 6) AS tags FROM r GROUP BY p_partkey""")
def token_rank_select(spark, sf_dir):
    """Tags of an item: its name's words, with keywords of every class added by its key, so that all classes occur."""
    p = table(spark, sf_dir, "part")
    words = lambda given: F.array(*map(F.lit, given))
    pick = lambda given, key: F.get(words(given), (F.col(key) % len(given)).cast("int"))
    fields = [F.replace("p_name", F.lit(" "), F.lit(";")), F.concat(F.lit("Extra "), F.upper(pick(tokens.SEMANTIC_KEYWORDS, "p_partkey")), F.lit(";"), pick(tokens.SEMANTIC_KEYWORDS, "p_size")), pick(tokens.GENERIC_KEYWORDS, "p_partkey"), pick(tokens.JUNK_TOKENS, "p_partkey")]
    return p.select("p_partkey", F.array_join(tokens.select_tags(fields, 6), ", ").alias("tags"))


@query(f"""WITH {HIST}, a AS (SELECT user_id, count(*) AS history_len, count(*) FILTER (WHERE label) AS n_liked, sum(hours) AS hours_sum, avg(hours) AS hours_mean, quantile_cont(hours, 0.5) AS hours_median, max(hours) AS hours_max, min(hours) AS hours_min,
  coalesce(avg(hours) FILTER (WHERE label), 0.0) AS liked_hours_mean, coalesce(avg(hours) FILTER (WHERE NOT label), 0.0) AS disliked_hours_mean FROM hist GROUP BY user_id)
SELECT user_id, history_len, n_liked, n_liked / history_len::DOUBLE AS liked_share, round(hours_sum, 6) AS hours_sum, round(hours_mean, 6) AS hours_mean, hours_median, hours_max, hours_min, round(liked_hours_mean, 6) AS liked_hours_mean, round(disliked_hours_mean, 6) AS disliked_hours_mean FROM a""")
def history_numeric_features(spark, sf_dir):
    df = features.history_numbers(candidates(spark, sf_dir))
    return df.select(*[F.round(c, 6).alias(c) if c in ("hours_sum", "hours_mean", "liked_hours_mean", "disliked_hours_mean") else c for c in df.columns])


_TOKENS = f"""WITH {HIST}, {SQL_ITEMS}, tt AS (SELECT c.user_id, list_distinct(string_split(i.tags, ',')) AS t FROM cand c LEFT JOIN items i ON i.app_id = c.target_app_id),
hh AS (SELECT user_id, label, list_distinct(flatten(list(string_split(i.tags, ',')))) AS w FROM hist h LEFT JOIN items i ON i.app_id = h.app_id GROUP BY user_id, label),
x AS (SELECT tt.user_id, t, coalesce(l.w, []) AS l, coalesce(d.w, []) AS d FROM tt LEFT JOIN hh l ON l.user_id = tt.user_id AND l.label LEFT JOIN hh d ON d.user_id = tt.user_id AND NOT d.label),
y AS (SELECT user_id, len(list_intersect(t, l)) AS lo, len(list_intersect(t, d)) AS dlo, len(list_distinct(list_concat(t, l))) AS lu, len(list_distinct(list_concat(t, d))) AS du FROM x)"""


@query(f"""{_TOKENS} SELECT user_id, lo AS liked_overlap, dlo AS disliked_overlap, round(coalesce(lo / nullif(lu, 0)::DOUBLE, 0), 6) AS liked_jaccard, round(coalesce(dlo / nullif(du, 0)::DOUBLE, 0), 6) AS disliked_jaccard,
round(coalesce(lo / nullif(lu, 0)::DOUBLE, 0) - coalesce(dlo / nullif(du, 0)::DOUBLE, 0), 6) AS jaccard_diff FROM y""")
def token_overlap(spark, sf_dir):
    df = features.token_overlap(history.with_items(candidates(spark, sf_dir), canonical.items(spark, sf_dir)))
    return df.select(*[F.round(c, 6).alias(c) if "jaccard" in c else c for c in df.columns])


_SIM = f"""WITH {HIST}, {SQL_EMBEDDINGS}, sim AS (SELECT h.user_id, h.pos, h.app_id, h.label, h.target_app_id, a.embedding AS v,
  CASE WHEN a.embedding IS NOT NULL AND t.embedding IS NOT NULL THEN list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) END AS sim
  FROM hist h LEFT JOIN item_embeddings a ON a.app_id = h.app_id LEFT JOIN item_embeddings t ON t.app_id = h.target_app_id)"""


@query(f"""{_SIM}, parts AS (SELECT user_id, label, generate_subscripts(v, 1) AS dim, unnest(CAST(v AS DOUBLE[])) AS x FROM sim WHERE v IS NOT NULL),
sums AS (SELECT user_id, label, dim, sum(x) AS s FROM parts GROUP BY ALL), norms AS (SELECT user_id, label, sqrt(sum(s * s)) AS norm FROM sums GROUP BY ALL),
sides AS (SELECT user_id, label, sum(sim) AS total, max(sim) AS top, list_sort(list(sim), 'DESC')[1:3] AS best FROM sim WHERE sim IS NOT NULL GROUP BY ALL),
v AS (SELECT user_id, label, CASE WHEN norm > 1e-12 THEN total / norm ELSE 0 END AS mean_cos, top, list_sum(best) / len(best) AS top_mean FROM sides JOIN norms USING (user_id, label))
SELECT c.user_id, round(coalesce(max(mean_cos) FILTER (WHERE v.label), 0), 6) AS liked_mean_cos, round(coalesce(max(mean_cos) FILTER (WHERE NOT v.label), 0), 6) AS disliked_mean_cos,
  round(coalesce(max(top) FILTER (WHERE v.label), 0), 6) AS liked_top, round(coalesce(max(top) FILTER (WHERE NOT v.label), 0), 6) AS disliked_top,
  round(coalesce(max(top_mean) FILTER (WHERE v.label), 0), 6) AS liked_top_mean, round(coalesce(max(top_mean) FILTER (WHERE NOT v.label), 0), 6) AS disliked_top_mean,
  round(coalesce(max(mean_cos) FILTER (WHERE v.label), 0) - coalesce(max(mean_cos) FILTER (WHERE NOT v.label), 0), 6) AS cos_gap
FROM cand c LEFT JOIN v ON v.user_id = c.user_id GROUP BY c.user_id""")
def semantic_features(spark, sf_dir):
    df = features.semantic(candidates(spark, sf_dir), canonical.item_vectors(spark, sf_dir))
    return df.select("user_id", *[F.round(c, 6).alias(c) for c in df.columns if c != "user_id"])


@query(f"""{_SIM}, r AS (SELECT user_id, label, app_id, pos, coalesce(sim, -1.0) AS sim, row_number() OVER (PARTITION BY user_id, label ORDER BY coalesce(sim, -1.0) DESC, pos) - 1 AS place FROM sim WHERE app_id <> target_app_id)
SELECT user_id, label, place, app_id, pos, round(sim, 6) AS sim FROM r WHERE place < 5""")
def retrieved_topk(spark, sf_dir):
    return features.retrieved(candidates(spark, sf_dir), canonical.item_vectors(spark, sf_dir)).withColumn("sim", F.round("sim", 6))


@query(f"""{_SIM}, r AS (SELECT user_id, label, row_number() OVER (PARTITION BY user_id, label ORDER BY coalesce(sim, -1.0) DESC, pos) AS place FROM sim WHERE app_id <> target_app_id),
n AS (SELECT user_id, count(*) FILTER (WHERE label AND place <= 5) AS l, count(*) FILTER (WHERE NOT label AND place <= 5) AS d FROM r GROUP BY user_id)
SELECT count(*) FILTER (WHERE l > 0) AS with_liked, count(*) FILTER (WHERE d > 0) AS with_disliked, round(avg(l), 6) AS mean_liked, round(avg(d), 6) AS mean_disliked FROM n""")
def retrieval_stats(spark, sf_dir):
    r = features.retrieved(candidates(spark, sf_dir), canonical.item_vectors(spark, sf_dir))
    n = r.groupBy("user_id").agg(F.count_if("label").alias("l"), F.count_if(~F.col("label")).alias("d"))
    return n.agg(F.count_if(F.col("l") > 0).alias("with_liked"), F.count_if(F.col("d") > 0).alias("with_disliked"), F.round(F.avg("l"), 6).alias("mean_liked"), F.round(F.avg("d"), 6).alias("mean_disliked"))


_LINE = "i.game_title || ' - tags: ' || i.tags || '; ' || printf('%.1f', h.hours) || ' hours'"


@query(f"""WITH {HIST}, {SQL_ITEMS}, l AS (SELECT h.user_id, h.label, h.pos, row_number() OVER (PARTITION BY h.user_id, h.label ORDER BY pos) || '. ' || {_LINE} AS line FROM hist h LEFT JOIN items i ON i.app_id = h.app_id),
s AS (SELECT user_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE label) AS liked, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT label) AS disliked FROM l GROUP BY user_id)
SELECT c.user_id, CASE WHEN c.label THEN 'Yes' ELSE 'No' END AS output_text, 'The user liked:' || chr(10) || coalesce(liked, 'None') || chr(10) || 'The user disliked:' || chr(10) || coalesce(disliked, 'None') || chr(10)
  || 'Target game: ' || t.game_title || chr(10) || 'Genres: ' || t.genres || chr(10) || 'Will the user recommend it? Answer Yes or No.' AS prompt_text
FROM cand c JOIN s USING (user_id) LEFT JOIN items t ON t.app_id = c.target_app_id""")
def prompt_build(spark, sf_dir):
    df = features.prompts(history.with_items(candidates(spark, sf_dir), canonical.items(spark, sf_dir)))
    return df.select("user_id", "output_text", "prompt_text")


@query(f"""{_SIM}, {SQL_ITEMS}, r AS (SELECT user_id, label, app_id, coalesce(sim, -1.0) AS sim, row_number() OVER (PARTITION BY user_id, label ORDER BY coalesce(sim, -1.0) DESC, pos) AS place FROM sim WHERE app_id <> target_app_id),
l AS (SELECT r.user_id, label, place, '- similarity=' || printf('%.4f', r.sim) || ': [app_id=' || r.app_id || '] ' || i.game_title AS line FROM r LEFT JOIN items i USING (app_id) WHERE place <= 5),
g AS (SELECT user_id, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE label) AS l, string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT label) AS d FROM l GROUP BY user_id)
SELECT c.user_id, 'Similar liked items:' || chr(10) || coalesce(l, 'No similar liked items found.') || chr(10) || 'Similar disliked items:' || chr(10) || coalesce(d, 'No similar disliked items found.') AS input_text FROM cand c LEFT JOIN g USING (user_id)""")
def retrieved_prompts(spark, sf_dir):
    return features.retrieved_prompts(candidates(spark, sf_dir), canonical.item_vectors(spark, sf_dir), canonical.items(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, quality, text FROM labels JOIN documents USING (doc_id)), r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY length(text), doc_id) AS r FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || 'shots'), doc_id) AS k FROM r WHERE r <= 20), o AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM s WHERE k <= 2)
SELECT string_agg('Example ' || i || ':' || chr(10) || text || chr(10) || 'Answer: ' || CASE WHEN quality = 1 THEN 'Yes' ELSE 'No' END, chr(10) || chr(10) ORDER BY doc_id) AS few_shot FROM o""")
def few_shot_examples(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    shots = sampling.balanced(features.shortest(d, "text", "quality", "doc_id", 20), "quality", 2, "doc_id", "shots")
    return features.few_shot_block(shots.withColumn("answer", F.when(F.col("quality") == 1, "Yes").otherwise("No")), "text", "answer", "doc_id")


@query("SELECT role, count(*) AS n, min(length(text)) AS shortest, round(avg(length(text)), 6) AS mean, max(length(text)) AS longest, count(*) FILTER (WHERE length(text) > 1000) AS truncated FROM conversations GROUP BY role")
def prompt_stats(spark, sf_dir):
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("longest"), F.count_if(n > 1000).alias("truncated"))


@query(f"""WITH {SPLIT}, ev AS (SELECT app_id FROM hist JOIN split USING (user_id) WHERE hist.label AND split = 'train' UNION SELECT target_app_id FROM split WHERE label AND split = 'train'),
h AS (SELECT s.user_id, bool_or(h.label AND h.app_id IN (SELECT app_id FROM ev)) AS l, bool_or(NOT h.label AND h.app_id IN (SELECT app_id FROM ev)) AS d FROM split s JOIN hist h USING (user_id) WHERE split = 'test' GROUP BY s.user_id)
SELECT count(*) AS n, count(*) FILTER (WHERE s.target_app_id IN (SELECT app_id FROM ev)) AS known_targets, count(*) FILTER (WHERE l) AS with_liked, count(*) FILTER (WHERE d) AS with_disliked FROM split s JOIN h USING (user_id)""")
def known_item_coverage(spark, sf_dir):
    s = splits(spark, sf_dir)
    return features.known_coverage(s.where("split = 'test'"), scorers.positive_events(s.where("split = 'train'")))


@query(f"""WITH {SPLIT} SELECT user_id, 'sample_' || lpad(CAST(row_number() OVER (ORDER BY split, label, target_date, user_id) - 1 AS VARCHAR), 6, '0') AS sample_id FROM split""")
def sample_ids(spark, sf_dir):
    order = ["split", "label", "target_date", "user_id"]
    return history.with_sample_id(splits(spark, sf_dir).select(*order), order).select("user_id", "sample_id")


@query("""WITH f AS (SELECT * FROM documents ORDER BY doc_id LIMIT 1), v AS (SELECT 'doc_id' AS "column", 'bigint' AS type, CAST(doc_id AS VARCHAR) AS value FROM f UNION ALL SELECT 'text', 'string', text FROM f UNION ALL SELECT 'lang', 'string', lang FROM f UNION ALL SELECT 'source', 'string', source FROM f UNION ALL SELECT 'n_chars', 'bigint', CAST(n_chars AS VARCHAR) FROM f)
SELECT "column", type, CASE WHEN length(value) > 500 THEN substr(value, 1, 500) || '...' ELSE value END AS value FROM v""")
def schema_preview(spark, sf_dir):
    """Columns of the documents, their types, and the first document's values."""
    return profile.schema_preview(table(spark, sf_dir, "documents"), order=["doc_id"])
