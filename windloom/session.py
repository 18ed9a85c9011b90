"""Session settings that the operators rely on, and table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with UTC times, adaptive execution and Arrow."""
    builder = SparkSession.builder.appName("windloom")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=settings).getOrCreate()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values as NULL: one NaN would make an average NaN and compares as larger than every number."""
    floats = {f.name: f.dataType.simpleString() for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)).cast(t) for c, t in floats.items()})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder of ``spark.checkpoint.dir``, which driver and executors share.  Where that is unset a
    local folder does if Spark runs in this one process (tests); on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="windloom-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base}/windloom/{name}-{uuid.uuid4().hex}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet into the shared folder and reread: lineage is cut, and each row is computed once."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
