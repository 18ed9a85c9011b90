"""Sessions by key and versions of models, in the shared file system."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_SCHEMA = "key string, saved_at timestamp, payload string"


def put_session(spark: SparkSession, path: str, key: str, payload: str) -> None:
    """Add a session (JSON text); of a key put twice the later one counts."""
    spark.range(1).select(F.lit(key).alias("key"), F.current_timestamp().alias("saved_at"), F.lit(payload).alias("payload")).write.mode("append").parquet(path)


def get_session(spark: SparkSession, path: str, key: str) -> str | None:
    """The latest payload of a key, or None."""
    row = spark.read.schema(SESSION_SCHEMA).parquet(path).where(F.col("key") == key).agg(F.max_by("payload", "saved_at").alias("p")).first()
    return row["p"]


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """All sessions, the latest of each key."""
    rows = spark.read.schema(SESSION_SCHEMA).parquet(path)
    return rows.groupBy("key").agg(F.max(F.struct("saved_at", "payload")).alias("m")).select("key", "m.saved_at", "m.payload")


def _files(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return jpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def export_model(model, path: str, version: str) -> bool:
    """Write a pipeline model as ``version`` below ``path`` unless it is there already; whether it was written.

    It is written beside its place and renamed, so a reader sees all of it or nothing.
    """
    spark = SparkSession.active()
    files, jpath = _files(spark, path)
    target = jpath(f"{path}/{version}")
    if files.exists(target):
        return False
    beside = f"{path}/.{uuid.uuid4().hex}"
    model.write().save(beside)
    if not files.rename(jpath(beside), target):
        files.delete(jpath(beside), True)
        return False
    return True


def load_model(path: str, version: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/{version}")
