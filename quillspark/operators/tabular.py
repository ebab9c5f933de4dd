"""Number features of samples for linear and tree models, and the sets of them that the models take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import numeric, text, tokens

# Tokens that say nothing of an item's content.
PLATFORM_TOKENS = (
    "steam achievements", "steam trading cards", "steam cloud", "controller", "partial controller support",
    "full controller support", "remote play", "family sharing", "stats", "leaderboards", "steam workshop",
)

# Feature names, in the order in which the models take them.
HISTORY = [
    "history_len", "history_positive_count", "history_negative_count", "history_positive_share", "history_total_hours", "history_mean_hours",
    "history_median_hours", "history_max_hours", "history_min_hours", "history_liked_mean_hours", "history_disliked_mean_hours",
]
TOKENS = [
    "target_token_count", "liked_token_count", "disliked_token_count", "target_liked_overlap_count", "target_disliked_overlap_count",
    "target_liked_jaccard", "target_disliked_jaccard", "target_jaccard_diff",
]
ITEM = ["target_description_len", "target_title_len", "price", "required_age", "dlc_count", "release_year"]
POPULARITY = ["item_score", "item_log_count"]
IN_SAMPLE = ["item_positive_count", "item_total_count", "item_rate"]
SEMANTIC = ["liked_mean_cos", "disliked_mean_cos", "liked_top", "disliked_top", "liked_top_mean", "disliked_top_mean", "cos_gap"]

BASE = HISTORY + TOKENS + ITEM
SAFE = [f for f in BASE if f not in ("history_max_hours", "history_min_hours") and not f.endswith("_token_count")]
LINEAR = [f for f in SAFE if f not in ("target_title_len", "required_age", "dlc_count")]
SETS = {"base": BASE, "popularity": BASE + POPULARITY, "semantic": BASE + POPULARITY + SEMANTIC, "safe": SAFE, "safe_popularity": SAFE + IN_SAMPLE, "safe_semantic": SAFE + IN_SAMPLE + SEMANTIC}


def _tokens(c: Column) -> Column:
    return tokens.parse(text.collapse(c), "[,;|]", lowercase=True, drop=PLATFORM_TOKENS)


def length(c: Column) -> Column:
    """Characters of a text whose white space is collapsed."""
    return F.length(text.collapse(c)).cast("long")


def tabular(enriched: DataFrame) -> DataFrame:
    """user_id and the features of BASE.

    enriched has history (array of app_id, date, label, hours), the parallel history_tags and history_genres, and the
    target's game_title, tags, genres, categories, description, price, required_age, dlc_count and release_date as target_*;
    in place of game_title and description their lengths (game_title_len, description_len; null counts as 0) will do.
    Unknown hours are left out of the sums and means, and an item without tokens adds none.
    """
    of = lambda want: F.filter(F.transform(F.filter("history", lambda h: h["label"] == want), lambda h: h["hours"]), lambda x: x.isNotNull())
    z = F.arrays_zip("history", "history_tags", "history_genres")
    said = lambda want: F.array_distinct(F.flatten(F.transform(F.filter("_z", lambda x: x["history"]["label"] == want), lambda x: F.concat(_tokens(x["history_tags"]), _tokens(x["history_genres"])))))
    df = enriched.withColumn("_z", z).withColumns({
        "_hours": F.filter(F.transform("history", lambda h: h["hours"]), lambda x: x.isNotNull()),
        "_liked": said(True),
        "_disliked": said(False),
        "_target": F.array_distinct(F.concat(*[_tokens(F.col(f"target_{f}")) for f in ("tags", "genres", "categories")])),
    })
    long = lambda c: F.coalesce(F.col(f"{c}_len"), F.lit(0).cast("long")) if f"{c}_len" in enriched.columns else length(F.col(c))
    n, liked = F.size("history"), F.size(F.filter("history", lambda h: h["label"]))
    hours, target = F.col("_hours"), F.col("_target")
    near, far = tokens.jaccard(target, F.col("_liked")), tokens.jaccard(target, F.col("_disliked"))
    made = {
        "history_len": n.cast("long"),
        "history_positive_count": liked.cast("long"),
        "history_negative_count": (n - liked).cast("long"),
        "history_positive_share": F.coalesce(F.try_divide(liked.cast("double"), n.cast("double")), F.lit(0.0)),
        "history_total_hours": numeric.array_sum(hours),
        "history_mean_hours": numeric.array_mean(hours),
        "history_median_hours": numeric.array_median(hours),
        "history_max_hours": F.coalesce(F.array_max(hours), F.lit(0.0)),
        "history_min_hours": F.coalesce(F.array_min(hours), F.lit(0.0)),
        "history_liked_mean_hours": numeric.array_mean(of(True)),
        "history_disliked_mean_hours": numeric.array_mean(of(False)),
        "target_token_count": F.size(target).cast("long"),
        "liked_token_count": F.size("_liked").cast("long"),
        "disliked_token_count": F.size("_disliked").cast("long"),
        "target_liked_overlap_count": tokens.overlap(target, F.col("_liked")).cast("long"),
        "target_disliked_overlap_count": tokens.overlap(target, F.col("_disliked")).cast("long"),
        "target_liked_jaccard": near,
        "target_disliked_jaccard": far,
        "target_jaccard_diff": near - far,
        "target_description_len": long("target_description"),
        "target_title_len": long("target_game_title"),
        "price": F.col("target_price"),
        "required_age": F.col("target_required_age"),
        "dlc_count": F.col("target_dlc_count"),
        "release_year": F.year("target_release_date").cast("long"),
    }
    return df.select("user_id", *[made[f].alias(f) for f in BASE])
