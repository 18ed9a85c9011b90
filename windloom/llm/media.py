"""Media columns in FLAC: texts as 8-bit samples, stored losslessly, read back in seekable PCM blocks.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are the samples: each less 128, or ``ranked``: a fixed
bijection that gives bytes common in text the samples near zero, which Rice codes make short.  ``stored`` makes
a media column of FLAC streams: blocks of 1024 samples with fixed or quantised linear predictors and Rice-coded residuals,
checksums on headers and frames, the MD5 of the samples, and a seek table that gives the byte offset of every block.
``decoded`` reads such a column, verifies every checksum (an error where one doesn't hold) and gives the PCM blocks with
their offsets; ``seek`` reads single blocks by their byte offset.  ``described`` writes the ranked streams, rereads them, and computes
digests and features from what it decodes.

Defined cases: null and empty texts are 64 zero bytes; equal texts have equal streams, as a stream depends on nothing
else; texts of any length are coded a thousand blocks at a time; repeated rows keep a row each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from windloom.llm import flac
from windloom.llm.common import slices, store, text_bytes

#: Blocks that are coded in one step.
STEP = 1024
#: Bytes by how common they are in European text, roughly; all others follow in ascending order (a fixed value of the stored form).
COMMON = b" eanitrsoludmchpgfbvwy,.k\n\xc3\xa9\xa8qxzj-'ETAOINSRHLDCUMFPGWYBVKJXQZ0123456789!?:;\"()/"


def _ranked_samples() -> np.ndarray:
    """The sample of each byte: 0, -1, 1, -2, 2... in the order of the bytes' ranks."""
    order = [*COMMON, *(b for b in range(256) if b not in COMMON)]
    out = np.zeros(256, np.int8)
    out[order] = [k // 2 if k % 2 == 0 else -(k + 1) // 2 for k in range(256)]
    return out


#: By ``ranked``: the sample of each byte, and the byte of each sample (plus 128).
SAMPLES = {False: np.arange(-128, 128).astype(np.int8), True: _ranked_samples()}
BYTES = {kind: np.argsort(of_byte).astype(np.uint8) for kind, of_byte in SAMPLES.items()}


def as_samples(payload: bytes, ranked: bool) -> bytes:
    return SAMPLES[ranked][np.frombuffer(payload, np.uint8)].tobytes()


def as_payload(pcm: bytes, ranked: bool) -> bytes:
    return BYTES[ranked][np.frombuffer(pcm, np.uint8) ^ 0x80].tobytes()


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def encode(payloads: list[bytes], ranked: bool = False) -> list[bytes]:
    """The FLAC stream of each payload (a positive multiple of 64 bytes)."""
    blocks = [-(-len(p) // flac.BLOCK) for p in payloads]
    doc = np.repeat(np.arange(len(payloads)), blocks)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.array([len(p) for p in payloads], np.int64)
    start = (np.cumsum(length) - length)[doc] + number * flac.BLOCK
    size = np.minimum(flac.BLOCK, length[doc] - number * flac.BLOCK)
    data = np.frombuffer(b"".join(payloads) + bytes(flac.BLOCK), np.uint8)
    frames: list[bytes] = []
    for a in range(0, len(doc), STEP):
        rows = slice(a, a + STEP)
        samples = SAMPLES[ranked][data[start[rows, None] + np.arange(flac.BLOCK)]].astype(np.int32)
        frames += flac.encode_frames(samples, size[rows], number[rows])
    out, at = [], 0
    for p, n in zip(payloads, blocks, strict=True):
        own = frames[at : at + n]
        pcm = as_samples(p, ranked)
        out.append(flac.stream_header(pcm, [len(f) for f in own]) + b"".join(own))
        at += n
    return out


def decode(streams: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """The PCM of each stream (signed 8-bit samples) and its blocks' offsets: (first sample, byte in the stream)."""
    frames: list[bytes] = []
    heads = []
    for data in streams:
        md5, points, first = flac.split_stream(data)
        at = [first + p for _, p in points] + [len(data)]
        frames += [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        heads.append((md5, [(s, a) for (s, _), a in zip(points, at, strict=False)]))
    parts: list[bytes] = []
    for a in range(0, len(frames), STEP):
        samples, sizes, _ = flac.decode_frames(frames[a : a + STEP])
        rows = samples.astype(np.int8)
        parts += [r[:n].tobytes() for r, n in zip(rows, sizes.tolist(), strict=True)]
    out, at = [], 0
    for md5, offsets in heads:
        pcm = b"".join(parts[at : at + len(offsets)])
        at += len(offsets)
        if hashlib.md5(pcm).digest() != md5:
            raise ValueError("checksum of the samples")
        out.append((pcm, offsets))
    return out


def features(payload: bytes) -> str:
    """Peak, mean square, mean absolute difference and zero crossings of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    step = int(np.abs(np.diff(x)).sum())
    return f"peak={int(np.abs(x).max())};square={int((x * x).sum()) / len(x):.6f};step={step / max(1, len(x) - 1):.6f};crossings={crossings}"


def stored(docs: DataFrame, ranked: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, media)``: the stream of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = text_bytes(batch)
            media = encode([padded(t) for t in texts], ranked)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


_BLOCKS = pa.list_(pa.struct([("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("pcm", pa.binary())]))


def decoded(media: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media_bytes, media_sha256, blocks)`` per row of ``media(doc_id, n_bytes, media)``: the PCM blocks
    (signed 8-bit samples) of each stream with their first sample and the place of their frame; null media: no blocks."""
    schema = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample_offset: long, byte_offset: long, pcm: binary>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            streams = batch.column(2).to_pylist()
            made = iter(decode([m for m in streams if m is not None]))
            blocks: list = []
            for m in streams:
                if m is None:
                    blocks.append(None)
                    continue
                pcm, offsets = next(made)
                blocks.append([{"sample_offset": s, "byte_offset": b, "pcm": pcm[s : s + flac.BLOCK]} for s, b in offsets])
            sums = [None if m is None else hashlib.sha256(m).hexdigest() for m in streams]
            columns = [batch.column(0), batch.column(1), pa.array([None if m is None else len(m) for m in streams], pa.int64()), pa.array(sums, pa.string()), pa.array(blocks, _BLOCKS)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return media.selectExpr("cast(doc_id as long) as doc_id", "cast(n_bytes as long) as n_bytes", "media").mapInArrow(run, schema)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """``(doc_id, block, sample_offset, byte_offset, pcm)``: one row a block of ``decoded``."""
    return decoded(media).selectExpr("doc_id", "posexplode(blocks) as (block, b)").selectExpr("doc_id", "cast(block as long) as block", "b.sample_offset", "b.byte_offset", "b.pcm")


def seek(stream: bytes, byte_offset: int, byte_end: int | None = None) -> bytes:
    """The PCM of the one block whose frame begins at ``byte_offset`` (and ends before the next one's), verified."""
    samples, sizes, _ = flac.decode_frames([stream[byte_offset:byte_end]])
    return samples[0, : sizes[0]].astype(np.int8).tobytes()


def described(docs: DataFrame) -> DataFrame:
    """Digests and features of every text from its stream, written and reread."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    media = store(stored(docs, ranked=True), "media", compression="uncompressed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            streams = batch.column(2).to_pylist()
            back = [as_payload(pcm, ranked=True) for pcm, _ in decode(streams)]
            columns = [
                batch.column(0), batch.column(1), pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                pa.array([zlib.crc32(p[-64:]) for p in back], pa.int64()), pa.array([len(m) for m in streams], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in streams], pa.string()),
                pa.array([features(p) for p in back], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return media.mapInArrow(run, schema)


def op9_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as FLAC and read back."""
    return described(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_flac_media": op9_flac_media}
