"""Queries of the models' features and of the prompt versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import tokens
from quillspark.operators import encoding, features, history, prompts, sampling, tabular
from quillspark.plans import features as feature_plans  # noqa: F401  its SQL is part of a query here
from quillspark.plans.base import HIST, ORACLES, SPLIT, query
from quillspark.plans.data import candidates, splits
from quillspark.sources import canonical
from quillspark.sources.canonical import SQL_DETAILS, SQL_ITEMS
from quillspark.sources.stage import staged


def enriched(spark, sf_dir, samples: DataFrame) -> DataFrame:
    """What the tabular features take of samples: tags and genres of the history and the target's item columns, of its texts the lengths.

    Texts are measured where they are read, and only keys go to the items: histories are dealt by user alone.
    """
    items = canonical.items(spark, sf_dir)
    details = canonical.item_details(spark, sf_dir, tabular.length(F.col("text")).alias("description_len"))
    told = items.withColumn("game_title_len", tabular.length(F.col("game_title"))).drop("game_title").join(details, "app_id", "left")
    told = told.select(F.col("app_id").alias("target_app_id"), *[F.col(c).alias(f"target_{c}") for c in told.columns if c != "app_id"])
    targets = samples.select("user_id", "target_app_id").join(told, "target_app_id", "left").drop("target_app_id")
    return samples.select("user_id", "history").join(history.gathered(samples, items, "user_id", ("tags", "genres")), "user_id", "left").join(targets, "user_id")


_OF_HISTORY = """n AS (SELECT user_id, count(*) AS history_len, count(*) FILTER (WHERE label) AS history_positive_count, count(*) FILTER (WHERE NOT label) AS history_negative_count,
  sum(hours) AS history_total_hours, avg(hours) AS history_mean_hours, quantile_cont(hours, 0.5) AS history_median_hours, max(hours) AS history_max_hours, min(hours) AS history_min_hours,
  coalesce(avg(hours) FILTER (WHERE label), 0) AS history_liked_mean_hours, coalesce(avg(hours) FILTER (WHERE NOT label), 0) AS history_disliked_mean_hours FROM hist GROUP BY user_id)"""
_OF_TOKENS = """words AS (SELECT app_id, list_distinct(string_split(lower(tags || ',' || genres), ',')) AS past, list_distinct(string_split(lower(tags || ',' || genres || ',' || categories), ',')) AS own FROM items),
heard AS (SELECT user_id, list_distinct(flatten(coalesce(list(past) FILTER (WHERE label), []))) AS l, list_distinct(flatten(coalesce(list(past) FILTER (WHERE NOT label), []))) AS d FROM hist JOIN words USING (app_id) GROUP BY user_id),
w AS (SELECT user_id, len(own) AS target_token_count, len(l) AS liked_token_count, len(d) AS disliked_token_count, len(list_intersect(own, l)) AS target_liked_overlap_count, len(list_intersect(own, d)) AS target_disliked_overlap_count,
  len(list_distinct(list_concat(own, l))) AS either_l, len(list_distinct(list_concat(own, d))) AS either_d FROM cand JOIN words ON app_id = target_app_id JOIN heard USING (user_id))"""
_ROUNDED = ["history_positive_share", "history_total_hours", "history_mean_hours", "history_liked_mean_hours", "history_disliked_mean_hours"]


@query(f"""WITH {HIST}, {SQL_ITEMS}, {SQL_DETAILS}, {_OF_HISTORY}, {_OF_TOKENS}
SELECT user_id, n.history_len, history_positive_count, history_negative_count, round(history_positive_count / n.history_len::DOUBLE, 6) AS history_positive_share, round(history_total_hours, 6) AS history_total_hours, round(history_mean_hours, 6) AS history_mean_hours,
  history_median_hours, history_max_hours, history_min_hours, round(history_liked_mean_hours, 6) AS history_liked_mean_hours, round(history_disliked_mean_hours, 6) AS history_disliked_mean_hours,
  target_token_count, liked_token_count, disliked_token_count, target_liked_overlap_count, target_disliked_overlap_count, round(target_liked_overlap_count / either_l::DOUBLE, 6) AS target_liked_jaccard,
  round(target_disliked_overlap_count / either_d::DOUBLE, 6) AS target_disliked_jaccard, round(target_liked_overlap_count / either_l::DOUBLE - target_disliked_overlap_count / either_d::DOUBLE, 6) AS target_jaccard_diff,
  length(trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g'))) AS target_description_len, length(trim(regexp_replace(game_title, '\\s+', ' ', 'g'))) AS target_title_len, price, required_age, dlc_count, year(release_date) AS release_year
FROM cand JOIN n USING (user_id) JOIN w USING (user_id) JOIN items ON items.app_id = target_app_id JOIN details ON details.app_id = target_app_id""")
def tabular_features(spark, sf_dir):
    """The 25 features of the tree models."""
    df = tabular.tabular(enriched(spark, sf_dir, candidates(spark, sf_dir)))
    return df.select(*[F.round(c, 6).alias(c) if c in _ROUNDED or "jaccard" in c else c for c in df.columns])


_FOLDED = """t AS (SELECT user_id, target_app_id, CAST(label AS INTEGER) AS y, (row_number() OVER (PARTITION BY label ORDER BY md5(user_id || 'oof'), user_id) - 1) % 5 AS fold FROM split WHERE split = 'train'),
total AS (SELECT sum(y) AS p, count(*) AS n FROM t), whole AS (SELECT target_app_id, sum(y) AS p, count(*) AS n FROM t GROUP BY ALL), part_of AS (SELECT target_app_id, fold, sum(y) AS p, count(*) AS n FROM t GROUP BY ALL),
folds AS (SELECT fold, sum(y) AS p, count(*) AS n FROM t GROUP BY fold), other AS (SELECT fold, (total.p - folds.p) / (total.n - folds.n)::DOUBLE AS prior FROM folds, total),
e AS (SELECT t.user_id, whole.p - part_of.p AS p, whole.n - part_of.n AS n, prior FROM t JOIN whole USING (target_app_id) JOIN part_of USING (target_app_id, fold) JOIN other USING (fold)
  UNION ALL SELECT user_id, coalesce(whole.p, 0), coalesce(whole.n, 0), total.p / total.n::DOUBLE FROM split LEFT JOIN whole USING (target_app_id), total WHERE split <> 'train')"""


@query(f"WITH {SPLIT}, {_FOLDED} SELECT user_id, round(CASE WHEN n = 0 THEN prior ELSE (p + 10 * prior) / (n + 10) END, 6) AS item_score, round(ln(1 + n), 6) AS item_log_count FROM e")
def encoded_targets(spark, sf_dir):
    """Encodings of the target item: out of fold for the training rows, from all of them for the others."""
    return encodings(staged(splits(spark, sf_dir), "splits")).select("user_id", *[F.round(c, 6).alias(c) for c in tabular.POPULARITY])


def encodings(s: DataFrame) -> DataFrame:
    s = s.select("user_id", "target_app_id", "label", "split")
    train, rest = s.where("split = 'train'"), s.where("split != 'train'")
    folded = encoding.encode_out_of_fold(sampling.folds(train, "label", 5, "user_id", "oof"), item="target_app_id")
    return folded.select("user_id", *tabular.POPULARITY).unionByName(encoding.encode(rest, train, item="target_app_id").select("user_id", *tabular.POPULARITY))


def in_sample(s: DataFrame) -> DataFrame:
    """The target item's counts and rate in train, its own row included: null for items that train lacks."""
    stats = encoding.popularity(s.where("split = 'train'"), "target_app_id").select("target_app_id", F.col("positives").alias("item_positive_count"), F.col("n").alias("item_total_count"), F.col("rate").alias("item_rate"))
    return s.select("user_id", "target_app_id").join(stats, "target_app_id", "left").select("user_id", *tabular.IN_SAMPLE)


@query(f"""WITH {SPLIT}, t AS (SELECT target_app_id, sum(CAST(label AS INTEGER)) AS p, count(*) AS n FROM split WHERE split = 'train' GROUP BY target_app_id)
SELECT user_id, CAST(p AS BIGINT) AS item_positive_count, n AS item_total_count, round(p / n::DOUBLE, 6) AS item_rate FROM split LEFT JOIN t USING (target_app_id)""")
def in_sample_popularity(spark, sf_dir):
    return in_sample(staged(splits(spark, sf_dir), "splits")).select("user_id", "item_positive_count", "item_total_count", F.round("item_rate", 6).alias("item_rate"))


def model_frame(spark, sf_dir) -> DataFrame:
    """user_id, split, label and all 37 features."""
    s = staged(splits(spark, sf_dir), "splits")
    numbers = tabular.tabular(enriched(spark, sf_dir, s))
    vectors = features.semantic(s, canonical.item_vectors(spark, sf_dir))
    return s.select("user_id", "split", "label").join(numbers, "user_id").join(encodings(s), "user_id").join(in_sample(s), "user_id").join(vectors, "user_id")


@query(f"SELECT * FROM (WITH {SPLIT} SELECT user_id, split, label FROM split) JOIN ({ORACLES['tabular_features']}) USING (user_id) JOIN ({ORACLES['encoded_targets']}) USING (user_id) JOIN ({ORACLES['in_sample_popularity']}) USING (user_id) JOIN ({ORACLES['semantic_features']}) USING (user_id)")
def model_features(spark, sf_dir):
    df = model_frame(spark, sf_dir)
    exact = ["user_id", "split", "label", "item_positive_count", "item_total_count", *[c for c in tabular.BASE if c not in _ROUNDED and "jaccard" not in c]]
    return df.select(*[c if c in exact else F.round(c, 6).alias(c) for c in df.columns])


def _clean(c: str, n: int | None = None, sentinels: bool = True) -> str:
    s = f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
    s = f"(CASE WHEN {s} IN ('[]', '{{}}', 'nan', 'None', '<NA>') THEN '' ELSE {s} END)" if sentinels else s
    return f"(CASE WHEN length({s}) > {n} THEN regexp_replace(substr({s}, 1, {n}), ' [^ ]*$', '') || '...' ELSE {s} END)" if n else s


def _first(c: str, n: int) -> str:
    """The first n distinct tokens; the items' own have neither blanks around them nor empty ones."""
    words = f"string_split({c}, ',')"
    return f"array_to_string(list_filter({words}, lambda x, i: list_position({words}, x) = i)[1:{n}], ', ')"


def _best(name: str, c: str, n: int) -> str:
    """A table of (app_id, name): the best n tokens of c."""
    return f"""{name}_u AS (SELECT app_id, unnest(string_split({c}, ',')) AS t, generate_subscripts(string_split({c}, ','), 1) AS i FROM items),
{name}_f AS (SELECT app_id, lower(t) AS l, min(i) AS i, arg_min(t, i) AS t FROM {name}_u GROUP BY app_id, lower(t)),
{name}_p AS (SELECT f.*, list_position(list_transform(semantic.k, lambda k: contains(l, k)), true) AS s, list_position(list_transform(generic.k, lambda k: contains(l, k)), true) AS g FROM {name}_f f, semantic, generic, junk WHERE len(list_filter(junk.k, lambda k: contains(l, k))) = 0),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY CASE WHEN s > 0 THEN 0 WHEN g > 0 THEN 1 ELSE 2 END, CASE WHEN s > 0 THEN s WHEN g > 0 THEN g ELSE 0 END, i) AS r FROM {name}_p),
{name}_t AS (SELECT app_id, string_agg(t, ', ' ORDER BY r) FILTER (WHERE r <= {n}) AS {name} FROM {name}_r GROUP BY app_id)"""


def _shown(lead: str, c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') <> '' THEN '{lead}: ' || {c} END"


def _prompts_sql() -> str:
    classes = ", ".join(f"{n} AS (SELECT {list(w)} AS k)" for n, w in (("semantic", tokens.SEMANTIC_KEYWORDS), ("generic", tokens.GENERIC_KEYWORDS), ("junk", tokens.JUNK_TOKENS)))
    best = ", ".join([_best("past_tags", "tags || ',' || genres", 8), _best("own_genres", "genres", 8), _best("own_categories", "categories", 8), _best("own_tags", "tags || ',' || genres", 14)])
    hours = "printf('%.1f', h.hours) || ' hours'"
    title = _clean("i.game_title", 120)
    lines = {
        "v1": f"{title} || ' - ' || {_clean('i.tags', 180, False)} || ', ' || {hours}",
        "v2": f"{title} || ' - tags: ' || {_first('i.tags', 6)} || '; ' || {hours}",
        "v3": f"{title} || coalesce(' - tags: ' || past_tags, '') || '; ' || {hours}",
    }
    numbered = ", ".join(f"row_number() OVER (PARTITION BY user_id, label ORDER BY pos) || '. ' || {x} AS {v}" for v, x in lines.items())
    sides = ", ".join(f"coalesce(string_agg({v}, chr(10) ORDER BY pos) FILTER (WHERE {s}), 'None') AS {v}_{n}" for v in lines for n, s in (("l", "label"), ("d", "NOT label")))
    description = _shown("Description", _clean("description", 500))
    targets = {
        "v1": [_clean("i.game_title", 120, False), _shown("Genres", _clean("i.genres", 160, False)), _shown("Tags", _clean("i.tags", 220, False)), _shown("Description", _clean("description", 450, False))],
        "v2": [f"'Title: ' || {_clean('i.game_title', 150)}", _shown("Genres", _first("i.genres", 8)), _shown("Categories", _first("i.categories", 8)), _shown("Tags", _first("i.tags", 12)), description],
        "v3": [f"'Title: ' || {_clean('i.game_title', 150)}", _shown("Genres", "own_genres"), _shown("Categories", "own_categories"), _shown("Tags", "own_tags"), description],
    }
    quoted = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    whole = ", ".join(
        f"{quoted(f'Instruction:\n{prompts.INSTRUCTION}\n\nInput:\n{prompts.LIKED}\n')} || {v}_l || {quoted(f'\n\n{prompts.DISLIKED}\n')} || {v}_d || {quoted(f'\n\n{prompts.TARGET}\n')} || concat_ws(chr(10), {', '.join(x)}) AS prompt_{v}"
        for v, x in targets.items()
    )
    joined = " ".join(f"LEFT JOIN {n}_t ON {n}_t.app_id = i.app_id" for n in ("own_genres", "own_categories", "own_tags"))
    return f"""WITH {HIST}, {SQL_ITEMS}, {SQL_DETAILS}, {classes}, {best},
l AS (SELECT h.user_id, h.label, h.pos, {numbered} FROM hist h JOIN items i ON i.app_id = h.app_id LEFT JOIN past_tags_t ON past_tags_t.app_id = h.app_id), s AS (SELECT user_id, {sides} FROM l GROUP BY user_id)
SELECT c.user_id, CASE WHEN c.label THEN 'Yes' ELSE 'No' END AS output_text, {whole} FROM cand c JOIN s USING (user_id) JOIN items i ON i.app_id = c.target_app_id JOIN details ON details.app_id = c.target_app_id {joined}"""


@query(_prompts_sql())
def prompt_versions(spark, sf_dir):
    items = canonical.items(spark, sf_dir).join(canonical.item_details(spark, sf_dir).select("app_id", "description"), "app_id", "left")
    return prompts.versions_of_items(candidates(spark, sf_dir), items)
