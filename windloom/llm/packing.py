"""Packing with a controlled mixture: deficit round-robin over the sources' queues.

A source's queue holds its documents' tokens (each document ends with the id 1), cut into packets of at most
``packet`` tokens.  Round r adds to every source's deficit a quantum in proportion to its share of the mixture (by default
its share of all tokens), the quanta of a round making one window, and serves packets while the deficit covers them;
what is left is carried into the next round.  A packet whose end stands at c tokens in its queue is therefore served
in round ceil(c / quantum): the rounds of all packets follow from running sums of the queues alone, with no state
passed between partitions.  Packets in the order (round, source, place in the queue) fill windows of 2048 tokens without
gaps, a packet at a window's end being cut; only the last window can be short, and is padded.

Running sums go in two steps (parts, then within a part) so that no task holds a source or the whole order.
Defined cases: a null text counts as empty and has the one id 1; a null source is a source of its own; repeated rows
are documents of their own; the token of a special string inside a text is that of the library's default; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windloom.llm.common import slices, store

#: Tokens of a window and of the largest packet; parts of a queue; white space that is left to the library, in characters.
WINDOW, PACKET, QUEUE_PARTS, LONG_SPACE = 2048, 256, 1024, 16384


class Tokenizer:
    """Ids as unsigned 16-bit integers of the vocabulary in a tokenizers file; nothing is remembered between texts.

    Byte-level BPE whose ids stand in merge order is encoded by the ranks read from the file, several times as fast as the
    library and with the same ids (tests compare them); other files, and texts with very long runs of white space (on which
    the rank encoder's pattern would exhaust its stack), are encoded by the library.
    """

    def __init__(self, file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.file = file
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) > 65535:
            raise ValueError("ids must fit in 16 bits")
        self.ranks = _by_ranks(spec)
        self.long_space = re.compile(r"\s{%d}" % LONG_SPACE)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.file)

    def encode(self, text: str) -> bytes:
        if self.ranks is None or (len(text) > LONG_SPACE and self.long_space.search(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        if any(s in text for s in self.special):
            return self.ranks.encode_to_numpy(text, allowed_special="all").astype("<u2").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes()


def _by_ranks(spec: dict):
    """A rank encoder with the vocabulary of a tokenizers file, or None if that isn't plain byte-level BPE with ids in merge
    order."""
    import public_tokenizers
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return None
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        return None
    # The characters that stand for bytes: printable Latin-1 for themselves, the others from U+0100 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte[c] for c in t): k for t, k in model["vocab"].items() if t not in special}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def tokenizer(file: str) -> Tokenizer:
    return Tokenizer(file)


def tokenized(docs: DataFrame, file: str, end_id: int = 1) -> DataFrame:
    """``(row, doc_id, source, n, ids)`` per row: ids as 16-bit integers, the end id included; stored."""
    end = end_id.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            encode = tokenizer(file).encode
            ids = [encode(x or "") + end for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "n", "ids"])

    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), "text")
    made = rows.mapInArrow(run, "doc_id long, source string, n long, ids binary")
    return store(made.withColumn("row", F.monotonically_increasing_id()), "tokens")


def _running_sum(df: DataFrame, keys: list[str], part: str, order: list[str], value: str, name: str, also: DataFrame | None = None) -> DataFrame:
    """``df`` plus the sum of ``value`` before each row of its ``keys`` in the order (part, order), and the columns of
    ``also`` (one row for each of ``keys``), which come with the sums of parts so that no rows are dealt by ``keys``."""
    sums = df.groupBy(*keys, part).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    if also is not None:
        sums = sums.join(also, keys)
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = df.withColumn("__own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return own.join(sums, [*keys, part]).withColumn(name, F.col("__before") + F.col("__own")).drop("__before", "__own")


def served(docs: DataFrame, window: int, packet: int, mixture: DataFrame | None = None) -> DataFrame:
    """``(row, round, source, place, start, length)`` of every packet of ``docs(row, source, n)``.

    ``mixture(source, share)``: other shares than the sources' own, any scale; sources not in it get no quantum of
    their own and are served as the smallest share is.
    """
    queues = docs.select("row", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), "n")
    queues = queues.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(QUEUE_PARTS)).cast("int"))
    totals = queues.groupBy("source").agg(F.sum("n").alias("total"))
    if mixture is not None:
        shares = mixture.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), F.col("share").cast("double"))
        totals = totals.join(shares, "source", "left")
        least = totals.agg(F.min("share").alias("s")).withColumn("s", F.coalesce("s", F.lit(1.0)))
        totals = totals.join(F.broadcast(least)).select("source", F.coalesce("share", "s").alias("weight"))
    else:
        totals = totals.select("source", F.col("total").cast("double").alias("weight"))
    whole = totals.agg(F.sum("weight").alias("whole"))  # one row
    quantum = totals.join(F.broadcast(whole)).select("source", (F.col("weight") / F.col("whole") * window).alias("quantum"))
    queues = _running_sum(queues, ["source"], "part", ["row"], "n", "before", quantum)
    packets = queues.withColumn("k", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {packet} as int)"))))
    start = F.col("k").cast("long") * packet
    packets = packets.select("row", "source", "quantum", start.alias("start"), F.least(F.lit(packet), F.col("n") - start).cast("long").alias("length"), (F.col("before") + start).alias("place"))
    end = F.col("place") + F.col("length")
    return packets.select("row", F.ceil(end / F.col("quantum")).alias("round"), "source", "place", "start", "length")


def placed(packets: DataFrame, window: int) -> DataFrame:
    """``(row, start, length, sequence_id, offset)`` of every piece: packets in their order, cut at window ends."""
    order = ["round", "source", "place"]
    n = max(1, int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = packets.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    whole = _running_sum(store(ranged, "packets").withColumn("all", F.lit(0)), ["all"], "part", order, "length", "at")
    fits = F.lit(window) - F.col("at") % window
    first = F.struct(F.col("start"), F.least("length", fits).alias("length"), F.col("at"))
    more = F.struct((F.col("start") + fits).alias("start"), (F.col("length") - fits).alias("length"), (F.col("at") + fits).alias("at"))
    pieces = whole.select("row", F.explode(F.when(F.col("length") > fits, F.array(first, more)).otherwise(F.array(first))).alias("p"))
    at = F.col("p.at")
    return pieces.select("row", "p.start", "p.length", F.expr(f"p.at div {window}").alias("sequence_id"), (at % window).alias("offset"))


def pack(docs: DataFrame, file: str | None = None, window: int = WINDOW, packet: int = PACKET, mixture: DataFrame | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; with ``keep_ids``
    also ``ids`` (little-endian unsigned 32-bit integers), from which sequences are put together.  ``packet`` is at most
    ``window``."""
    if not 0 < packet <= window:
        raise ValueError("a packet must fit in a window")
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("byte_bpe_50k.json")
    tokens = tokenized(docs, file)
    pieces = placed(served(tokens, window, packet, mixture), window)
    # The pieces of one document: at most its own tokens / packet + tokens / window + 1 of them.
    lists = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    joined = tokens.select("row", "doc_id", "n", "ids").join(lists, "row").select("doc_id", "n", "ids", "pieces")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = batch.column(3)
            per, flat = lists.value_lengths().to_numpy(), lists.flatten()
            start, length, sequence, offset = (flat.field(k).to_numpy() for k in range(4))
            doc = np.repeat(np.arange(batch.num_rows), per)
            wide = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in batch.column(2).to_pylist()]
            own = [wide[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            at = pa.array(doc)
            columns = [batch.column(0).take(at), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64()), batch.column(1).take(at), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * keep_ids, names)

    return joined.mapInArrow(run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens, mixed by source."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


QUERIES = {"op10_packing": op10_packing}
