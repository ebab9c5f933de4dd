"""Tables of the operators, kept in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.sources.stage import shared_dir


def written(df: DataFrame, name: str, by: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """df, written to the shared folder and read again: cuts the lineage and survives lost executors. options: of the writer."""
    path = f"{shared_dir(df.sparkSession)}/quill/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**(options or {})).option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
