"""File sources and sinks of the pipeline: CSV, JSON lines, Parquet, file discovery, keyed upserts."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.sources.stage import staged

RECOMMENDATIONS = T.StructType([T.StructField(n, t) for n, t in (("app_id", T.LongType()), ("helpful", T.LongType()), ("funny", T.LongType()), ("date", T.DateType()), ("is_recommended", T.BooleanType()), ("hours", T.DoubleType()), ("user_id", T.LongType()), ("review_id", T.LongType()))])
GAMES_METADATA = T.StructType([T.StructField("app_id", T.LongType()), T.StructField("description", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None, sample: float | None = None) -> DataFrame:
    """CSV with a header: with the declared schema, or inferred (from a share of the rows, for audits); only columns, if given."""
    reader = spark.read.option("header", True).option("multiLine", False)
    if schema is not None:
        df = reader.schema(schema).option("enforceSchema", False).csv(path)
    else:
        df = reader.option("inferSchema", True).option("samplingRatio", sample or 1.0).csv(path)
    return df.select(*columns) if columns else df


#: From the narrowest on; a column gets the first that all its values can be read as.
TYPES = ("bigint", "double", "date", "boolean", "string")


def read_csv_sniffed(spark: SparkSession, path: str, lines: int = 1000) -> DataFrame:
    """CSV with a header and without a schema, scanned whole once.

    Types are guessed from the first lines; the one scan then stores the text of each column and counts, for its
    guess and the wider types, the values that can't be read as such. A guess that any value contradicts is widened.
    Empty fields are nulls; a column of nulls alone is text.
    """
    names = spark.read.option("header", True).csv(path).columns
    raw = spark.read.option("header", True).schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)
    sample = raw.limit(lines)
    guess = _fitting(sample.agg(*_unread_counts(names, {n: list(TYPES) for n in names})).first().asDict(), names, {n: list(TYPES) for n in names})
    wider = {n: list(TYPES[TYPES.index(t) :]) for n, t in guess.items()}
    seen = Observation()
    stored = staged(raw.observe(seen, *_unread_counts(names, wider)), "csv")
    types = _fitting(seen.get, names, wider)
    return stored.select(*[F.expr(f"try_cast(`{n}` AS {types[n]})").alias(n) for n in names])


def _unread_counts(names: list[str], types: dict[str, list[str]]) -> list:
    """For each column and type how many values can't be read as it, and how many there are."""
    counts = [F.count_if(F.col(f"`{n}`").isNotNull() & F.expr(f"try_cast(`{n}` AS {t})").isNull()).alias(f"{k}_{t}") for k, n in enumerate(names) for t in types[n]]
    return counts + [F.count(f"`{n}`").alias(f"{k}_n") for k, n in enumerate(names)]


def _fitting(counts: dict, names: list[str], types: dict[str, list[str]]) -> dict[str, str]:
    return {n: next(t for t in types[n] if counts[f"{k}_{t}"] == 0) if counts[f"{k}_n"] else "string" for k, n in enumerate(names)}


def read_head(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, and a broken one fails the read if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def write_json_lines(df: DataFrame, path: str, columns: list[str] | None = None, by: str | None = None) -> None:
    """JSON lines with keys in the order of columns, nulls kept and text not escaped to ASCII; one folder per value of by."""
    columns = columns or df.columns
    lines = df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"), *([by] if by else []))
    writer = lines.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def write_sorted_parquet(df: DataFrame, path: str, order: list, by: str | None = None) -> None:
    """Parquet (zstd) in a total order over the files."""
    writer = df.orderBy(*order).write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_parquet(df: DataFrame, path: str, codec: str = "snappy") -> None:
    """Parquet in the order that the rows come in."""
    df.write.mode("overwrite").option("compression", codec).parquet(path)


def write_document(one: DataFrame, path: str) -> None:
    """A summary of one row as a JSON document in a text file; nulls are kept."""
    one.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_small_csv(df: DataFrame, path: str) -> None:
    """One CSV file, for results of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def list_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, length, suffix) of all files below path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    files = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)))
    return files.where(F.col("suffix").isin(*suffixes)) if suffixes else files


def largest_file(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("length", "path")).alias("path"))


def pick_path(paths: list[str], name: str, prefer: str | tuple[str, ...] = (), avoid: tuple[str, ...] = ()) -> str:
    """The path ending in name that lacks the fewest of prefer, then has the fewest of avoid, case aside, then the shortest."""
    prefer = [prefer] if isinstance(prefer, str) else prefer
    found = [p for p in paths if Path(p).name == name]
    if not found:
        raise FileNotFoundError(name)
    return min(found, key=lambda p: (sum(w.lower() not in p.lower() for w in prefer), sum(w.lower() in p.lower() for w in avoid), len(p), p))


def resolve_column(df: DataFrame, candidates: list[str]) -> str:
    """The first of candidates that df has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {candidates} is in {df.columns}")


def existing_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that df has, in the order of names."""
    return df.select(*[n for n in names if n in df.columns])


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def upsert(old: DataFrame, new: DataFrame, key: str, retired: tuple[str, ...] = ()) -> DataFrame:
    """old without the keys of new and the retired ones, and new; columns that one lacks are null."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    if retired:
        kept = kept.where(~F.col(key).isin(*retired))
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_json(path: str, values: dict, retired: tuple[str, ...] = ()) -> dict:
    """Key/value JSON on the driver, for a few thresholds."""
    file = Path(path)
    now = json.loads(file.read_text()) if file.exists() else {}
    now = {k: v for k, v in now.items() if k not in retired} | values
    file.write_text(json.dumps(now, indent=2, sort_keys=True))
    return now
