"""Tables kept between jobs in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where a local session names none."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quill-stage-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: computed once however often it is used, and safe from lost executors."""
    path = stage_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_ONCE: dict[tuple[str, str], DataFrame] = {}


def staged_once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """make's result, staged at the first call of a name in this application and read again by later ones.

    For tables that many plans start from; input folders are taken not to change while an application runs.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _ONCE:
        _ONCE[key] = staged(make(), "once")
    return _ONCE[key]
