"""Helpers shared by the operators: stored intermediates, connected components, batch slicing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of the record batches that operators work on.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.  Where it is unset a fresh local folder is set if Spark runs in
    this one process (tests); on a cluster, whose executors don't share local folders, that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="windloom-checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_written: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def store(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it reread: lineage is cut and a lost executor
    costs no recomputation.  The files go with ``release``, or when the application ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/windloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _written.append(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files behind a table made by ``store`` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/windloom/" in folder:
            _delete(df.sparkSession, folder)


def stored_so_far() -> int:
    """A mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, mark: int) -> None:
    """Delete all tables stored since the mark but the last one, which nothing else than that one was made from."""
    for path in _written[mark:-1]:
        _delete(spark, path)
    del _written[mark:-1]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as keep it apart from the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in batch.column(column).cast(pa.binary()).to_pylist()]


def row_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """About the bytes of each row: eight a column, and what strings, binaries and lists hold."""
    total = np.full(batch.num_rows, 8 * batch.num_columns, np.int64)
    for column in batch.columns:
        kind = column.type
        if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
            size = pc.binary_length(column)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
            size = pc.multiply(pc.list_value_length(column), 8 * max(1, kind.value_type.num_fields))
            if pa.types.is_struct(kind.value_type):  # about: the bytes inside are dealt evenly to the list's items
                inside = sum(pc.sum(pc.binary_length(column.flatten().field(k))).as_py() or 0 for k, f in enumerate(kind.value_type) if pa.types.is_binary(f.type) or pa.types.is_string(f.type))
                items = max(1, pc.sum(pc.list_value_length(column)).as_py() or 1)
                size = pc.multiply(pc.list_value_length(column), 8 * kind.value_type.num_fields + inside // items)
        else:
            continue
        total += pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return total


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most ``rows`` rows and ``limit`` bytes (a larger row alone), which bounds what
    a task holds at once."""
    for batch in batches:
        end = np.cumsum(row_bytes(batch))
        start = 0
        while start < batch.num_rows:
            most = int(np.searchsorted(end, (end[start - 1] if start else 0) + limit, "right"))
            stop = min(start + rows, max(most, start + 1))
            yield batch.slice(start, stop - start)
            start = stop


class Remembered:
    """What was computed for keys (strings), within about ``limit`` bytes: a young and an old generation of half of it each.

    Keys in use move to the young one; when that is full it becomes the old one, and keys not met since are forgotten.
    """

    def __init__(self, limit: int) -> None:
        self.limit, self.used = limit // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        """Call before a batch: starts a generation where the young one is full."""
        if self.used > self.limit:
            self.old, self.young, self.used = self.young, {}, 0

    def missing(self, keys: set) -> list:
        """Those of ``keys`` that are in neither generation; the others are in the young one afterwards."""
        out = []
        old, put = self.old, self.put
        for k in keys.difference(self.young):
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                put(k, v)
        return out

    def put(self, key, value) -> None:
        self.young[key] = value
        self.used += 160 + len(key) + (len(value) if isinstance(value, bytes) else 0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a long, b long)``; root is the smallest node of its component.

    Rounds of hooking and contraction: every node points to its smallest neighbour if that is smaller, pointers are
    doubled, and edges are rewritten to the nodes pointed to; edges inside a component vanish, so the table shrinks
    each round.  Aggregates are partial before each shuffle and lookups are joins against unique keys, so a node of
    very high degree is dealt with before the shuffle or by splitting its partition.  Every round is stored.
    Self-loops, repeated edges and nulls (ignored) are allowed; an empty table gives an empty result.
    """
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = store(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    nodes = None
    for _ in range(max_rounds):
        if both.isEmpty():
            break
        parent = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p")).select(F.col("a").alias("n"), "p")
        parent = store(parent, "parent")
        for _ in range(2):
            up = parent.select(F.col("n").alias("p"), F.col("p").alias("pp"))
            parent, old = store(parent.join(up, "p", "left").select("n", F.coalesce("pp", "p").alias("p")), "parent"), parent
            drop_stored(old)
        if nodes is None:
            nodes = parent.select(F.col("n").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("n").alias("root"), F.col("p").alias("next"))
            nodes = nodes.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        nodes = store(nodes, "nodes")
        pa_, pb = parent.select(F.col("n").alias("a"), F.col("p").alias("pa")), parent.select(F.col("n").alias("b"), F.col("p").alias("pb"))
        moved = both.join(pa_, "a").join(pb, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct()
        both, old = store(moved, "edges"), both
        drop_stored(old)
        drop_stored(parent)
    else:
        raise RuntimeError("connected components did not converge")
    if nodes is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return nodes
