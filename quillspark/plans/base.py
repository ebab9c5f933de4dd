"""Registration of queries, and pieces of SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.canonical import SQL_INTERACTIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


CLEANED = (
    SQL_INTERACTIONS
    + """,
cleaned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, app_id ORDER BY date DESC, review_id DESC, ship_date DESC, price DESC) AS rn
  FROM interactions WHERE user_id IS NOT NULL AND app_id IS NOT NULL AND date IS NOT NULL AND is_recommended IS NOT NULL AND hours >= 0) WHERE rn = 1)"""
)
SEQUENCE = (
    CLEANED
    + """,
counted AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS user_interaction_count FROM cleaned),
seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date, review_id, ship_date, price, app_id) AS user_interaction_idx,
  row_number() OVER (PARTITION BY user_id ORDER BY date DESC, review_id DESC, ship_date DESC, price DESC, app_id DESC) AS reverse_idx FROM counted WHERE user_interaction_count >= 5)"""
)
HIST = (
    SEQUENCE
    + """,
framed AS (SELECT *, list({'app_id': app_id, 'date': date, 'label': is_recommended, 'hours': hours, 'idx': user_interaction_idx})
  OVER (PARTITION BY user_id ORDER BY user_interaction_idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS past FROM seq),
cand AS (SELECT user_id, app_id AS target_app_id, date AS target_date, is_recommended AS label, hours AS target_hours, review_id AS target_review_id, len(past) AS history_len, past
  FROM framed WHERE reverse_idx = 1 AND len(past) >= 4),
hist AS (SELECT user_id, unnest(past, recursive := true), generate_subscripts(past, 1) - 1 AS pos, target_app_id FROM cand)"""
)
SPLIT = (
    HIST
    + """,
dated AS (SELECT list(target_date ORDER BY target_date) AS d FROM cand),
bounds AS (SELECT d[CAST(ceil(0.8 * len(d)) AS BIGINT)] AS val_start, d[CAST(ceil(0.9 * len(d)) AS BIGINT)] AS test_start, len(d) AS total FROM dated),
split AS (SELECT cand.*, CASE WHEN target_date >= test_start THEN 'test' WHEN target_date >= val_start THEN 'val' ELSE 'train' END AS split FROM cand, bounds)"""
)
