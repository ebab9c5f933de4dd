"""The driver's star schema seen as review data: interactions, items, item embeddings."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line: a user's (customer's) review of an item (part); not recommended if returned."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("app_id"),
        F.to_date("o_orderdate").alias("date"),
        (F.col("l_returnflag") != "R").alias("is_recommended"),
        F.col("l_quantity").alias("hours"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("review_id"),
        F.to_date("l_shipdate").alias("ship_date"),
        F.col("l_extendedprice").alias("price"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("app_id"),
        F.col("p_name").alias("game_title"),
        F.array_join(F.split("p_name", " "), ",").alias("tags"),
        F.col("p_type").alias("genres"),
        F.col("p_brand").alias("categories"),
        F.col("p_retailprice").alias("price"),
        F.col("p_size").alias("required_age"),
    )


class SharedVectors(NamedTuple):
    """Vectors that items share: keys has (app_id, vec_id), vectors (vec_id, embedding), broadcast if they are few."""

    keys: DataFrame
    vectors: DataFrame
    few: bool


def item_vectors(spark: SparkSession, sf_dir: str, most_bytes: int = 64 << 20) -> SharedVectors:
    """item_embeddings without a copy of a vector for each item; the vectors are broadcast if they are counted to be few enough."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.count("*").alias("n"), (F.coalesce(F.sum(F.greatest(F.size("embedding"), F.lit(0))), F.lit(0)) * 4 + F.count("*") * 32).alias("bytes")).first()
    keys = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("app_id"), F.expr(f"try_mod(p_partkey, {n['n']})").alias("vec_id"))
    few = n["bytes"] <= most_bytes
    return SharedVectors(keys, F.broadcast(vectors) if few else vectors, few)


def item_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(app_id, embedding): items share the vectors, item k has vector k modulo their number."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.count("*").alias("n"))
    keyed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("app_id")).crossJoin(F.broadcast(n))  # n is one row
    return keyed.withColumn("vec_id", F.col("app_id") % F.col("n")).join(vectors, "vec_id").select("app_id", "embedding")


def item_details(spark: SparkSession, sf_dir: str, told: Column | None = None) -> DataFrame:
    """(app_id, description, dlc_count, release_date): whole texts of documents, or what told makes of text before any join; parts have neither add-ons nor dates, so their sizes and keys stand in."""
    told = F.col("text").alias("description") if told is None else told
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("app_id"), (F.col("p_size") % 4).alias("dlc_count"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("p_partkey") % 6000).cast("int")).alias("release_date"))
    return part.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("app_id"), told), "app_id", "left")


#: The same views for the DuckDB oracle, as common table expressions.
SQL_INTERACTIONS = """interactions AS (
  SELECT o_custkey AS user_id, l_partkey AS app_id, CAST(o_orderdate AS DATE) AS date, l_returnflag <> 'R' AS is_recommended, l_quantity AS hours,
         l_orderkey * 8 + l_linenumber AS review_id, CAST(l_shipdate AS DATE) AS ship_date, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
SQL_ITEMS = """items AS (
  SELECT p_partkey AS app_id, p_name AS game_title, array_to_string(string_split(p_name, ' '), ',') AS tags, p_type AS genres, p_brand AS categories,
         p_retailprice AS price, p_size AS required_age FROM part)"""
SQL_EMBEDDINGS = """item_embeddings AS (
  SELECT p_partkey AS app_id, embedding FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""
SQL_DETAILS = """details AS (
  SELECT p_partkey AS app_id, text AS description, p_size % 4 AS dlc_count, DATE '2000-01-01' + CAST(p_partkey % 6000 AS INTEGER) AS release_date FROM part LEFT JOIN documents ON doc_id = p_partkey)"""
