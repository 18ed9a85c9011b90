"""SimHash near-duplicates by bit-sliced comparison.

Words are maximal runs of characters other than space and U+0009 to U+000D of the text with A-Z lower-cased; shingles are
``shingle_words`` consecutive words joined by a space, repeats included (fewer words: the whole sequence is one shingle).
A fingerprint bit is set if it is set in more than half of the shingles' XXH64 values (seed 42, UTF-8); no words: zero.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link with each other like any
others; repeated rows keep a row each and share a fingerprint; ties (exactly half) leave a bit clear; an empty table
gives an empty result; extra input columns are ignored by ``fingerprints`` and kept by ``dedup`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm import bitslice
from windloom.llm.common import connected_components, slices, store, text_bytes, unused

#: Rows of a block that are compared in one piece; larger blocks are cut into tiles, and pairs of tiles are compared.
TILE_ROWS = 16384


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    w = text.lower().split()  # bytes.lower changes A-Z only; bytes.split cuts at exactly these six characters
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), seed)], np.uint64)
    joined = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(seed)), np.uint64, len(w) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8192):
        part = hashes[start : start + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes sent through the k-th of a family of bijections of 64-bit words."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_column: str = "doc_id") -> DataFrame:
    """``(doc_id, fp)`` per row of ``docs(doc_id, text)``; ``fp`` is the 64-bit fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([majority(shingle_hashes(t, shingle_words)) for t in text_bytes(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _agreeing_keys(radius: int, bits: int = 64) -> list[int]:
    """Masks such that any two words within ``radius`` bits agree on at least one of them: the bits fall into
    ``radius + 3`` fields, of which ``radius`` differing bits leave three untouched."""
    fields = radius + 3
    edges = [bits * k // fields for k in range(fields + 1)]
    field = [(1 << edges[k + 1]) - (1 << edges[k]) for k in range(fields)]
    return [sum(c) for c in combinations(field, 3)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def block_links(blocks: DataFrame, radius: int, n_words: int) -> DataFrame:
    """Edges ``(a, b)`` that connect, within each block, what pairs within ``radius`` connect.

    ``blocks(key long, node long, w0..)`` holds 64-bit words of fingerprints.  In each block all pairs are compared
    bit-sliced; of their links a spanning forest is kept (a row's edge goes to the first row that it is connected to), so
    edges grow with the rows and not with the pairs.  Blocks above ``TILE_ROWS`` rows are cut into tiles by the node's
    hash and every pair of tiles is compared in a task of its own: no row is dropped and no task holds more than two
    tiles.
    """
    names = [f"w{k}" for k in range(n_words)]
    large = blocks.groupBy("key").count().where(F.col("count") > TILE_ROWS)
    large = large.select("key", F.ceil(F.col("count") / F.lit(TILE_ROWS)).cast("int").alias("tiles"))
    blocks = blocks.join(large, "key", "left")
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int")
    blocks = blocks.withColumn("t", F.coalesce(own, F.lit(0)))
    blocks = blocks.select("key", "node", *names, "t", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("tiles") - 1, F.lit(0)))).alias("o"))
    blocks = blocks.select("key", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), "node", *names)
    blocks = blocks.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("key", "t1", "t2")], 1)
            if not len(keys):
                continue
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            last = int(change[-1]) if len(change) else 0
            if last:
                yield from linked(table.slice(0, last), np.r_[0, change[:-1]], last)
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield from linked(table, np.array([0]), table.num_rows) if table.num_rows else ()

    def linked(table: pa.Table, starts: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        size = np.diff(np.r_[starts, n])
        rows = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(rows):
            return
        block = np.repeat(np.arange(len(starts)), size)[rows]
        words = np.stack([table.column(c).to_numpy()[rows].view(np.uint64) for c in names], 1)
        node = table.column("node").to_numpy()[rows]
        root = bitslice.forest(len(rows), bitslice.links(words, block, radius))
        moved = np.flatnonzero(root != np.arange(len(rows)))
        if len(moved):
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[root[moved]])], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").distinct()


def components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``(fp, component_id)`` for every distinct ``fp`` of ``prints(doc_id, fp)``: the smallest doc_id reachable over
    fingerprints that differ in ``radius`` bits or fewer.  Exact: two such fingerprints agree on three of ``radius + 3``
    fields, and each choice of three fields is a block key (radius 2: ten keys of some 38 bits each)."""
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    masks = _agreeing_keys(radius)
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))) for k, m in enumerate(masks)])
    blocks = distinct.select(F.explode(keys).alias("key"), F.col("fp").alias("node"), F.col("fp").alias("w0"))
    roots = connected_components(block_links(blocks, radius, 1))
    of = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    return of.join(of.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``."""
    prints = store(fingerprints(docs, shingle_words), "fingerprints")
    fp = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(components(prints, radius), "fp").select("doc_id", fp, "component_id")


# Near-duplicates by similarity, for the pipeline: wider fingerprints of the distinct shingles find candidates, whose
# similarity is then counted from the texts.

WIDE_WORDS, BANDS, BAND_ROWS = 4, 12, 3
#: Distinct shingles (and 128 for each row) of a tile of candidates: what a task holds is at most two tiles.
TILE_SHINGLES = 2**21


def candidate_radius(similarity: float, bits: int) -> int:
    """Bits within which all pairs of that Jaccard similarity fall: of two equally large sets (the worst case) the cosine
    is 2 s / (1 + s), each bit differs with probability angle / pi, and six standard deviations are added."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(round(bits * p + 6 * (bits * p * (1 - p)) ** 0.5))


def signatures(docs: DataFrame, shingle_words: int) -> DataFrame:
    """``(doc_id, sum, node, size, w0..w3, bands array<long>)`` per row: hash and size of the set of shingles, a 256-bit
    fingerprint of it (the hash sent through four bijections) and twelve keys, each of three minimum shingle hashes."""
    names = [f"w{k}" for k in range(WIDE_WORDS)]
    schema = "doc_id long, sum long, node long, size long, " + ", ".join(f"{c} long" for c in names) + ", bands array<long>"

    def one(text: bytes) -> tuple[int, int, list[int], np.ndarray]:
        h = np.unique(shingle_hashes(text, shingle_words))
        node = xxhash.xxh64_intdigest(h.astype("<u8").tobytes())
        if not len(h):
            return node, 0, [0] * WIDE_WORDS, np.arange(BANDS, dtype=np.uint64)
        low = np.array([_mixed(h, 16 + k).min() for k in range(BANDS * BAND_ROWS)], np.uint64).reshape(BANDS, BAND_ROWS)
        key = np.arange(BANDS, dtype=np.uint64)
        for r in range(BAND_ROWS):
            key = _mixed(key ^ low[:, r], r)
        return node, len(h), [majority(_mixed(h, k)) for k in range(WIDE_WORDS)], key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [one(t) for t in text_bytes(batch)]
            node, size = np.array([m[0] for m in made], np.uint64), np.array([m[1] for m in made], np.int64)
            w = np.array([m[2] for m in made], np.uint64).reshape(-1, WIDE_WORDS)
            bands = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([m[3] for m in made]).view(np.int64)), BANDS)
            cols = [batch.column(0), batch.column(2), pa.array(node.view(np.int64)), pa.array(size)]
            cols += [*[pa.array(np.ascontiguousarray(w[:, k]).view(np.int64)) for k in range(WIDE_WORDS)], bands.cast(pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sum", "node", "size", *names, "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("sum"))
    return rows.mapInArrow(run, schema)


def similar_forest(sets: list[np.ndarray], pairs: Iterable[tuple[np.ndarray, np.ndarray]], similarity: float) -> np.ndarray:
    """Smallest index connected to each of ``sets`` (distinct hashes each) by those of the pairs whose Jaccard similarity,
    counted exactly, is ``similarity`` or more.  Pairs that are connected already aren't counted."""
    size = np.array([len(x) for x in sets], np.int64)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.r_[0, np.cumsum(size)]
    own, root = np.zeros(int(ids.max(initial=-1)) + 1, bool), np.arange(len(sets))
    for i, j in pairs:
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for a, others in zip(i[np.r_[True, i[1:] != i[:-1]]], np.split(j, np.flatnonzero(i[1:] != i[:-1]) + 1), strict=True):
            others = others[root[others] != root[a]]
            if not len(others):
                continue
            own[ids[start[a] : start[a + 1]]] = True
            seen = np.r_[0, np.cumsum(own[np.concatenate([ids[start[b] : start[b + 1]] for b in others])])]
            own[ids[start[a] : start[a + 1]]] = False
            end = np.cumsum(size[others])
            shared = seen[end] - seen[end - size[others]]
            for b in others[shared >= similarity * (size[a] + size[others] - shared) - 1e-9]:
                low, high = sorted((root[a], root[b]))
                root[root == high] = low
    return root


def similar_links(members: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Edges ``(a, b)`` that connect, within each ``key``, what pairs of that similarity connect.

    ``members(key long, node long, size long, w0.., text)`` are candidates: rows with one ``node`` have the same shingles.
    Pairs within the candidates' radius are compared, however many a key has.  Keys with many shingles are cut into tiles as in
    ``block_links``.
    """
    names = [f"w{k}" for k in range(WIDE_WORDS)]
    radius = candidate_radius(similarity, 64 * WIDE_WORDS)
    tiles = F.ceil(F.sum(F.col("size") + 128) / F.lit(TILE_SHINGLES)).cast("int").alias("tiles")
    members = members.join(members.select("key", "node", "size").distinct().groupBy("key").agg(tiles), "key")
    members = members.withColumn("t", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles")).cast("int"))
    members = members.select("key", "node", *names, "text", "t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
    members = members.select("key", F.least("t", "o").alias("t1"), F.greatest("t", "o").alias("t2"), "node", *names, "text")
    members = members.repartition("key", "t1", "t2").sortWithinPartitions("key", "t1", "t2", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, node, words, sets = None, [], [], []
        for batch in slices(batches):
            keys = zip(*(batch.column(c).to_pylist() for c in ("key", "t1", "t2")), strict=True)
            w = np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], 1)
            for key, n, row, text in zip(keys, batch.column("node").to_pylist(), w, text_bytes(batch), strict=True):
                if key != at:
                    yield from linked(node, words, sets)
                    at, node, words, sets = key, [], [], []
                if not node or node[-1] != n:
                    node.append(n)
                    words.append(row)
                    sets.append(np.unique(shingle_hashes(text, shingle_words)))
        yield from linked(node, words, sets)

    def linked(node: list[int], words: list[np.ndarray], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        n = len(node)
        if n < 2:
            return
        root = similar_forest(sets, bitslice.links(np.stack(words), np.zeros(n, np.int64), radius), similarity)
        moved = np.flatnonzero(root != np.arange(n))
        if len(moved):
            ids = np.array(node, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], ["a", "b"])

    return members.mapInArrow(run, "a long, b long").distinct()


def dedup(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` less all but the smallest doc_id (null last) of every group of near-duplicates.

    Documents whose sets of shingles have that Jaccard similarity or more are linked.  Equal sets are one node.  Candidates
    are nodes with three equal minimum hashes in one of twelve bands (a pair at 0.8 shares one in all but 0.02 % of cases)
    whose 256-bit fingerprints, compared bit-sliced, lie within ``candidate_radius``; in what the candidates connect the
    similarity is counted exactly, so no link is below it.  Of a repeated row one stays.
    """
    names = [f"w{k}" for k in range(WIDE_WORDS)]
    own_id, own_sum, first_id, first_sum = unused(docs, "__wl_id", "__wl_sum", "__wl_first_id", "__wl_first_sum")
    same = F.col(own_id).eqNullSafe(F.col(first_id)) & (F.col(own_sum) == F.col(first_sum))
    sig = store(signatures(docs, shingle_words), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "sum")).alias("first")
    # Rows of one node have the same set of shingles, so the same size, fingerprint and bands.
    classes = sig.groupBy("node").agg(first, *[F.first(c).alias(c) for c in ("size", *names)])
    bands = sig.groupBy("node").agg(*[F.first(c).alias(c) for c in (*names, "bands")])
    blocks = bands.select(F.explode("bands").alias("key"), "node", *names)
    candidates = connected_components(block_links(blocks, candidate_radius(similarity, 64 * WIDE_WORDS), WIDE_WORDS))
    own = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_sum: F.xxhash64(F.coalesce("text", F.lit("")))})
    members = candidates.join(classes, "node").select(F.col("root").alias("key"), "node", "size", *names, F.col("first.doc_id").alias(first_id), F.col("first.sum").alias(first_sum))
    texts = own.select(own_id, own_sum, "text").join(members, same)
    members = store(texts.select("key", "node", "size", *names, "text"), "members")
    roots = connected_components(similar_links(members, shingle_words, similarity))
    of = classes.select("node", "first").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    stay = of.groupBy("root").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.doc_id").alias(first_id), F.col("first.sum").alias(first_sum))
    kept = own.join(stay, same, "left_semi")
    return kept.dropDuplicates([own_id, own_sum]).select(docs.columns)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, two differing bits or fewer."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
