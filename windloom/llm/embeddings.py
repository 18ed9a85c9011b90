"""Embedding near-duplicates by spherical-cap filters with structured random product codes.

Vectors are turned by a fixed random rotation and cut into blocks; each block has a small set of random unit codes, and
a filter direction is one code of every block, so that a few codes stand for a very large number of directions.  A
vector is list-decoded to all directions whose caps it exceeds: those within a margin of its nearest one, found block by
block with partial sums and never by trying all.  Vectors of a label meet in the filters that they share; in each filter
their cosines are computed as matrix products in double precision.  A pair counts in the smallest filter that both share and
nowhere else, so each filter gives the number of links of its vectors and a spanning forest of them, and links are never
written out one by one: what is stored grows with the vectors and not with the pairs.

The margin: for vectors at cosine t, the difference of the scores of two directions f and g changes from one to the other by
a normal variate of deviation sqrt((2 - 2 t) / d) * |f - g|, with |f - g| some 2 for directions that differ in two blocks.
``SPREAD`` such deviations over 2 are the margin of both lists; a pair is lost only if no direction lies in both.

Equal vectors of a label are one class (by label and 128 bits of hash): they are linked without comparing, and only classes
are compared.  Filters with more than ``TILE_ROWS`` classes are cut into tiles, and each pair of tiles is a block of its own,
so no task holds more than two tiles; the comparisons of one very dense group still grow with the square of its different
vectors, as their links do.  Defined cases: a null label, a null or zero vector, and null or non-finite components link with
nothing; vectors of unlike length are never compared; repeated rows count as vectors of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm import bitslice
from windloom.llm.common import connected_components, slices, store

#: Blocks of a code; deviations of the margin; classes of a filter compared in one block; pairs looked at in one step.
BLOCKS, SPREAD, SEED, TILE_ROWS, STEP_PAIRS = 4, 2.0, 20240601, 4096, 1 << 16


def margin(threshold: float, d: int) -> float:
    """How far below its nearest direction's score the directions of a vector of ``d`` components may lie."""
    return SPREAD * float(np.sqrt(max(0.0, 2 - 2 * threshold) / d)) + 1e-9


class ProductCode:
    """Codes for vectors of ``d`` components: ``codes`` random unit vectors in each of four blocks."""

    def __init__(self, d: int, codes: int) -> None:
        rng = np.random.default_rng([SEED, d, codes])
        self.width, self.codes = -(-d // BLOCKS), codes
        full = self.width * BLOCKS
        self.turn = np.linalg.qr(rng.standard_normal((full, full)))[0][:, :d]
        own = rng.standard_normal((BLOCKS, codes, self.width))
        self.book = own / np.linalg.norm(own, axis=2, keepdims=True)

    def decode(self, unit: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest filter of each row, and (row, filter) of all filters within ``margin`` of its score."""
        turned = (unit @ self.turn.T).reshape(len(unit), BLOCKS, self.width)
        score = np.einsum("nbw,bcw->nbc", turned, self.book)
        lack = score.max(axis=2, keepdims=True) - score
        rows, lists, gaps = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        top = np.zeros(len(unit), np.int64)
        for b in range(BLOCKS):
            top = top * self.codes + lack[:, b].argmin(axis=1)
            total = gaps[:, None] + lack[rows, b]
            at, code = np.nonzero(total <= margin)
            rows, lists, gaps = rows[at], lists[at] * self.codes + code, total[at, code]
        return top, rows, lists


def code_size(vectors: int) -> int:
    """Codes a block: filters (its fourth power) at least as many as vectors, so that a filter's list stays short."""
    return max(16, int(np.ceil(vectors**0.25)))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def vectors_of(table: DataFrame) -> DataFrame:
    """``(vec_id, valid, label, dim, h1, h2, embedding)`` per row; invalid vectors link with nothing."""
    e = F.col("embedding")
    # Comparisons with null are null: forall and exists are then null or decided without it.
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    kind = dict(table.dtypes)["embedding"]
    if kind != "array<float>":  # floats are carried as such and compared as doubles
        table = table.withColumn("embedding", e.cast("array<double>"))
    table = table.withColumns({"label": F.col("label").cast("string"), "vec_id": F.col("vec_id").cast("long")})
    hashes = [F.xxhash64(F.lit(k), "label", e).alias(f"h{k}") for k in (1, 2)]
    return table.select("vec_id", valid.alias("valid"), "label", F.size(e).alias("dim"), *hashes, "embedding")


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that the rows of ``a`` and ``b`` (ascending, filled up with the largest) share."""
    out, left = np.full(len(a), np.iinfo(np.int64).max), np.arange(len(a))
    for k in range(a.shape[1]):
        own = a[left, k]
        hit = (b[left] == own[:, None]).any(axis=1)
        out[left[hit]] = own[hit]
        left = left[~hit]
        if not len(left):
            break
    return out


def _pairs(unit: np.ndarray, block: np.ndarray, threshold: float):
    """Index arrays (i, j), i < j, of the pairs of one block with that cosine; equal ``block`` numbers are adjacent."""
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    size = np.diff(np.r_[starts, len(block)])
    small = np.flatnonzero(np.repeat(size, size) <= 64)
    for s in range(1, int(size[size <= 64].max(initial=0))):
        i = small[:-s][block[small[:-s]] == block[small[s:]]] if len(small) > s else small[:0]
        i = i[np.einsum("nd,nd->n", unit[i], unit[i + s]) >= threshold]
        for k in range(0, len(i), STEP_PAIRS):
            yield i[k : k + STEP_PAIRS], i[k : k + STEP_PAIRS] + s
    for start, n in zip(starts[size > 64], size[size > 64], strict=True):
        for at in range(start, start + n, 256):
            end = min(at + 256, start + n)
            i, j = np.nonzero(np.triu(unit[at:end] @ unit[at : start + n].T >= threshold, 1))
            for k in range(0, len(i), STEP_PAIRS):
                yield at + i[k : k + STEP_PAIRS], at + j[k : k + STEP_PAIRS]


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def linked(table: pa.Table, threshold: float, dim: int) -> pa.RecordBatch | None:
    """``(a, b, others)`` of the blocks of vectors with ``dim`` components in ``table``: for each class with links, the first
    class that it is connected to there and the vectors that it is linked with by pairs that count there."""
    keys = [table.column(c).to_numpy(zero_copy_only=False) for c in ("filter", "t1", "t2")]
    label = table.column("label").combine_chunks().dictionary_encode()
    label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
    change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in [label, *keys]])) + 1
    size = np.diff(np.r_[0, change, table.num_rows])
    rows = np.flatnonzero(np.repeat(size, size) > 1)
    if not len(rows):
        return None
    block = np.repeat(np.arange(len(size)), size)[rows]
    table = table.take(pa.array(rows))
    x = _matrix(table.column("embedding").combine_chunks())
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = table.column("near").combine_chunks()
    per = near.value_lengths().to_numpy()
    lists = np.full((len(rows), int(per.max())), np.iinfo(np.int64).max)
    lists[np.arange(lists.shape[1])[None, :] < per[:, None]] = near.flatten().to_numpy()
    filters, own, across = keys[0][rows], table.column("t").to_numpy(), (keys[1] != keys[2])[rows]
    copies, others = table.column("copies").to_numpy(), np.zeros(len(rows), np.int64)

    def pairs():
        for i, j in _pairs(unit, block, threshold - 1e-9):
            keep = ~across[i] | (own[i] != own[j])
            close = np.flatnonzero(keep & (np.abs(np.einsum("nd,nd->n", unit[i], unit[j]) - threshold) < 2e-9))
            keep[close] = _exact(x[i[close]], x[j[close]]) >= threshold
            i, j = i[keep], j[keep]
            counts = first_shared(lists[i], lists[j]) == filters[i]
            np.add.at(others, i[counts], copies[j[counts]])
            np.add.at(others, j[counts], copies[i[counts]])
            yield i, j

    root = bitslice.forest(len(rows), pairs())
    cid = table.column("cid").to_numpy()
    some = np.flatnonzero((others > 0) | (root != np.arange(len(rows))))
    return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(cid[root[some]]), pa.array(others[some])], ["a", "b", "others"])


def links(classes: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, others)`` rows of all blocks of ``classes(cid, copies, label, dim, embedding)``: edges a-b connect what links
    connect, and ``others``, summed by a, is the number of vectors linked with those of a (its own copies not among them)."""
    codes = code_size(classes.count())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, ProductCode] = {}
        for batch in slices(batches, 1024):
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                code = known.setdefault(int(d), ProductCode(int(d), codes))
                x = _matrix(part.column(3))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                _, rows, found = code.decode(x / np.linalg.norm(x, axis=1, keepdims=True), margin(threshold, int(d)))
                order = np.lexsort((found, rows))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order], np.arange(len(x) + 1)), pa.int32()), pa.array(found[order]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), lists], ["cid", "label", "dim", "near"])

    coded = store(classes.select("cid", "label", "dim", "embedding").mapInArrow(decoded, "cid long, label string, dim int, near array<long>"), "filters")
    key = ["label", "dim", "filter"]
    members = coded.select("cid", "label", "dim", F.explode("near").alias("filter"))
    # Filters with one class need no comparing: only the others' vectors are moved.
    size = members.groupBy(*key).count().where("count > 1").select(*key, F.ceil(F.col("count") / F.lit(TILE_ROWS)).cast("int").alias("tiles"))
    blocks = members.join(size, key).withColumn("t", F.pmod(F.xxhash64("cid", F.lit(7)), F.col("tiles")).cast("int"))
    blocks = blocks.join(classes.join(coded.select("cid", "near"), "cid").select("cid", "copies", "near", "embedding"), "cid")
    blocks = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    blocks = blocks.withColumns({"t1": F.least("t", "o"), "t2": F.greatest("t", "o")})
    order = ["dim", "label", "filter", "t1", "t2"]
    blocks = blocks.select(*order, "t", "cid", "copies", "near", "embedding").repartition(*order).sortWithinPartitions(*order, "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in slices(batches, 2 * TILE_ROWS):
            table = pa.Table.from_batches([*held, batch])
            last = _last_change(table, order)
            yield from compared(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield from compared(pa.Table.from_batches(held))

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        dims = table.column("dim").to_numpy()
        for d in np.unique(dims):
            found = linked(table.filter(pa.array(dims == d)), threshold, int(d))
            if found is not None and found.num_rows:
                yield found

    return blocks.mapInArrow(run, "a long, b long, others long")


def _last_change(table: pa.Table, order: list[str]) -> int:
    """Where the last block of ``table`` begins."""
    n = table.num_rows
    if n < 2:
        return 0
    changed = np.zeros(n - 1, bool)
    for c in order:
        column = table.column(c).combine_chunks()
        if pa.types.is_string(column.type):
            column = column.dictionary_encode()
            column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).indices
        v = column.to_numpy(zero_copy_only=False)
        changed |= v[1:] != v[:-1]
    at = np.flatnonzero(changed)
    return int(at[-1]) + 1 if len(at) else 0


def near_duplicates(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors(vec_id, embedding, label)``."""
    rows = vectors_of(vectors)
    same = ["label", "dim", "h1", "h2"]
    classes = rows.where("valid").groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.first("embedding").alias("embedding"))
    classes = store(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    found = store(links(classes.select("cid", "copies", "label", "dim", "embedding"), threshold), "links")
    degree = found.groupBy(F.col("a").alias("cid")).agg(F.sum("others").alias("others"))
    roots = connected_components(found.where("a <> b").select("a", "b").distinct()).withColumnRenamed("node", "cid")
    of = classes.select(*same, "cid", "copies", "first_id").join(degree, "cid", "left").join(roots, "cid", "left")
    of = of.select(*same, (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("root", "cid").alias("root"), "first_id")
    of = of.join(of.groupBy("root").agg(F.min("first_id").alias("component")), "root").select(*same, "n", "component", F.lit(True).alias("valid"))
    joined = rows.drop("embedding").join(of, [*same, "valid"], "left")
    component = F.coalesce("component", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.98 within equal labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op5_embedding_near_dedup": op5_embedding_near_dedup}
