"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per task.

Words are the matches of the vocabulary's pattern.  A word that is a vocabulary entry is its own id; the others go, once
each, into a table of token positions that starts with one row per byte, each with its successor.  Each step of a recursive
query joins neighbouring tokens to the merge table, finds for every word the smallest rank and of equal ranks the leftmost
pair, and contracts it; a word without a pair left is finished.  Ids are decoded by an aggregation ordered by position.

A word longer than ``SPAN`` bytes goes into that table as overlapping spans.  As every neighbouring pair of tokens that is
the encoding of its own bytes makes the whole sequence the encoding of its bytes, two spans are joined where they agree
on two neighbouring tokens, and the time grows with the word's length and not with its square.  Words whose spans don't
agree (a character repeated many times, say) go whole through a second query, which contracts all occurrences of a word's
smallest rank in one step.

A task remembers encodings within a bound in bytes, so memory doesn't grow with the input.  Texts are
whole; words and texts may be of any length.  Defined cases: null and empty texts have no ids and decode to no bytes;
strings that other vocabularies treat as special are ordinary text; repeated rows keep a row each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from windloom.llm.common import Remembered, slices

#: Bytes of remembered words and of pieces between spaces per task; words and bytes of one recursive query; token rows of one
#: decoding query; bytes of a long word's spans, which overlap by half.
WORD_BYTES, PIECE_BYTES, QUERY_WORDS, QUERY_BYTES, QUERY_TOKENS, SPAN = 64 << 20, 64 << 20, 20_000, 1 << 20, 2_000_000, 64

ENCODE = """
with recursive step(word, pos, token, next_pos, next_token, pair, active) as (
  select word, pos, token, next_pos, next_token, (m.rank::bigint << 32) | pos, true
  from tokens left join merges m on m.pair = (token::bigint << 20) | next_token
  union all
  select n.word, n.pos, n.token, n.next_pos, n.next_token, (m.rank::bigint << 32) | n.pos, n.active
  from (
    select s.word, s.pos,
           case when s.pos = p.at then p.rank else s.token end as token,
           case when s.pos = p.at then p.after_pos else s.next_pos end as next_pos,
           case when s.pos = p.at then p.after_token when s.next_pos = p.at then p.rank else s.next_token end as next_token,
           p.at is not null as active
    from step s left join (
      select best.word, best.at, best.rank, l.next_pos as gone, r.next_pos as after_pos, r.next_token as after_token
      from (
        select word, (min(pair) >> 32)::int as rank, (min(pair) & 4294967295)::int as at
        from step where active and pair is not null group by word
      ) best
      join step l on l.word = best.word and l.pos = best.at
      join step r on r.word = l.word and r.pos = l.next_pos
    ) p on p.word = s.word
    where s.active and (p.gone is null or s.pos <> p.gone)
  ) n left join merges m on m.pair = (n.token::bigint << 20) | n.next_token
)
select word, list(token order by pos) as ids from step where not active group by word order by word
"""

#: The same, but every step contracts all occurrences of a word's smallest rank (of overlapping ones every second), unless the
#: token made may be part of a merge of smaller rank: then the leftmost.
ENCODE_ALL = """
with recursive step(word, pos, token, next_pos, next_token, pair, active) as (
  select word, pos, token, next_pos, next_token, (m.rank::bigint << 32) | pos, true
  from tokens left join merges m on m.pair = (token::bigint << 20) | next_token
  union all (
    with best as (
      select word, (min(pair) >> 32)::int as rank, (min(pair) & 4294967295)::int as leftmost
      from step where active and pair is not null group by word
    ), found as (
      select s.word, s.pos, s.next_pos, b.rank, b.leftmost, row_number() over w as k, coalesce(lag(s.next_pos) over w = s.pos, false) as touches
      from step s join best b on b.word = s.word and b.rank = (s.pair >> 32)
      window w as (partition by s.word order by s.pos)
    ), runs as (
      select *, max(case when touches then 0 else k end) over (partition by word order by pos) as first from found
    ), chosen as (
      select word, pos, next_pos, rank from runs where (k - first) % 2 = 0 and (pos = leftmost or rank not in (select rank from alone))
    ), made as (
      select s.word, s.pos, coalesce(c.rank, s.token) as token, case when c.pos is null then s.next_pos else r.next_pos end as next_pos,
             s.word in (select word from best) as active
      from step s left join chosen c on c.word = s.word and c.pos = s.pos
      left join step r on r.word = c.word and r.pos = c.next_pos
      where s.active and not exists (select 1 from chosen g where g.word = s.word and g.next_pos = s.pos)
    )
    select n.word, n.pos, n.token, n.next_pos, x.token, (m.rank::bigint << 32) | n.pos, n.active
    from made n left join made x on x.word = n.word and x.pos = n.next_pos
    left join merges m on m.pair = (n.token::bigint << 20) | x.token
  )
)
select word, list(token order by pos) as ids from step where not active group by word order by word
"""

DECODE = "select doc, string_agg(hex, '' order by pos) as hex from ids join vocabulary using (token) group by doc order by doc"

_codecs: dict[tuple[str, str], Codec] = {}


class Codec:
    """The vocabulary in a DuckDB database of this task's process."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(rank_file, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # White space by its Unicode property, whatever the regex library takes \s to be.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        merges = [(left << 20 | right, k) for t, k in self.rank.items() for i in range(1, len(t)) if (left := self.rank.get(t[:i])) is not None and (right := self.rank.get(t[i:])) is not None]
        self._table("merges", pair=pa.array([m[0] for m in merges], pa.int64()), rank=pa.array([m[1] for m in merges], pa.int32()))
        self._table("vocabulary", token=pa.array(list(self.rank.values()), pa.int32()), hex=pa.array([t.hex() for t in self.rank]))
        alone = sorted({part for pair, k in merges for part in (pair >> 20, pair & 0xFFFFF) if part > k})
        self._table("alone", rank=pa.array(alone, pa.int32()))
        self.size = np.zeros(max(self.rank.values()) + 1, np.int64)
        self.size[list(self.rank.values())] = [len(t) for t in self.rank]
        self.words, self.pieces = Remembered(WORD_BYTES), Remembered(PIECE_BYTES)

    def _table(self, name: str, **columns) -> None:
        self.db.register("arrow", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as select * from arrow")
        self.db.unregister("arrow")

    def _contract(self, words: list[bytes], query: str) -> list[np.ndarray]:
        """The ids of each word by a recursive query, some thousand words at a time."""
        out: list[np.ndarray] = []
        start = 0
        while start < len(words):
            end, held = start, 0
            while end < len(words) and end - start < QUERY_WORDS and (end == start or held + len(words[end]) <= QUERY_BYTES):
                held += len(words[end])
                end += 1
            part = words[start:end]
            size = np.array([len(w) for w in part])
            first = np.repeat(np.cumsum(size) - size, size)
            flat = self.of_byte[np.frombuffer(b"".join(part), np.uint8)]
            word, pos = np.repeat(np.arange(len(part), dtype=np.int32), size), (np.arange(len(flat)) - first).astype(np.int32)
            last = np.r_[word[1:] != word[:-1], True]
            self._table("tokens", word=word, pos=pos, token=flat, next_pos=pa.array(pos + 1, mask=last), next_token=pa.array(np.r_[flat[1:], flat[:1]], mask=last))
            ids = self.db.sql(query).to_arrow_table().column("ids").combine_chunks()
            out += np.split(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.cumsum(ids.value_lengths().to_numpy())[:-1])
            start = end
        return out

    def _joined(self, spans: list[np.ndarray]) -> np.ndarray | None:
        """The ids of a word from those of its spans; None where two spans don't agree on neighbouring tokens."""
        ends = [k * (SPAN // 2) + np.cumsum(self.size[s]) for k, s in enumerate(spans)]
        begins = [e - self.size[s] for e, s in zip(ends, spans, strict=True)]
        out, start = [], 0
        for k, ids in enumerate(spans):
            at = begins[k]
            if k + 1 == len(spans):
                out.append(ids[at >= start])
                break
            same = np.intersect1d(at << 20 | ids, begins[k + 1] << 20 | spans[k + 1])
            begin, after = same >> 20, (same >> 20) + self.size[same & 0xFFFFF]
            cuts = begin[1:][after[:-1] == begin[1:]]
            if not len(cuts):
                return None
            cut = int(cuts[len(cuts) // 2])
            out.append(ids[(at >= start) & (at < cut)])
            start = cut
        return np.concatenate(out)

    def _merge(self, words: list[str]) -> None:
        """Remember the ids of words that are no vocabulary entries."""
        words.sort(key=len)  # words of like length reach their fixpoint together
        raw = [w.encode() for w in words]
        short = [k for k, w in enumerate(raw) if len(w) <= SPAN]
        for k, ids in zip(short, self._contract([raw[k] for k in short], ENCODE), strict=True):
            self.words.put(words[k], ids.tobytes())
        for k, w in enumerate(raw):
            if len(w) <= SPAN:
                continue
            ids = self._joined(self._contract([w[a : a + SPAN] for a in range(0, len(w) - SPAN // 2, SPAN // 2)], ENCODE))
            self.words.put(words[k], (self._contract([w], ENCODE_ALL)[0] if ids is None else ids).tobytes())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        self.words.turn()
        self.pieces.turn()
        # A space between two characters that aren't white space always begins a word: texts are cut there, and a piece
        # that begins with such a space is known by what follows it.
        cut = [t.split(" ") for t in texts]
        new = set(self.pieces.missing(set(chain.from_iterable(cut))))
        ragged = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        if ragged:
            new -= ragged
            for k, c in enumerate(cut):
                if not ragged.isdisjoint(c):
                    cut[k] = _rejoined(c)
                    new.update(self.pieces.missing(set(cut[k][1:])))
        heads = {c[0]: self.find(c[0]) for c in cut}
        new = {p: self.find(p if p[0] == " " else " " + p) for p in new}
        missing: list[str] = []
        for w in self.words.missing(set(chain.from_iterable(heads.values())).union(*new.values())):
            k = self.rank.get(w.encode())
            if k is None:
                missing.append(w)
            else:
                self.words.put(w, k.to_bytes(4, "little"))
        self._merge(missing)
        ids, pieces = self.words.young.__getitem__, self.pieces
        for p, found in new.items():
            pieces.put(p, b"".join(map(ids, found)))
        known = pieces.young.__getitem__
        return [b"".join([*map(ids, heads[c[0]]), *map(known, c[1:])]) for c in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each document's ids stand for."""
        size = np.array([len(x) // 4 for x in ids], np.int64)
        out = [b""] * len(ids)
        start = 0
        while start < len(ids):
            end = start + 1
            total = size[start]
            while end < len(ids) and total + size[end] <= QUERY_TOKENS:
                total += size[end]
                end += 1
            n = size[start:end]
            first = np.repeat(np.cumsum(n) - n, n)
            token = np.frombuffer(b"".join(ids[start:end]), "<u4").astype(np.int32)
            self._table("ids", doc=np.repeat(np.arange(start, end, dtype=np.int32), n), pos=(np.arange(len(token)) - first).astype(np.int32), token=token)
            for doc, text in self.db.execute(DECODE).fetchall():
                out[doc] = bytes.fromhex(text)
            start = end
        return out


def _rejoined(parts: list[str]) -> list[str]:
    """The parts of a text split at spaces, those joined again whose space isn't between two plain characters."""
    out, held = [], parts[0]
    for p in parts[1:]:
        if p and held and not p[0].isspace() and not held[-1].isspace():
            out.append(held)
            held = p
        else:
            held += " " + p
    if out and held[-1].isspace():
        held = " " + held  # kept apart from a part without spaces, which is only remembered if it ends otherwise
    return [*out, held]


def codec(rank_file: str, pattern: str) -> Codec:
    if (rank_file, pattern) not in _codecs:
        _codecs[rank_file, pattern] = Codec(rank_file, pattern)
    return _codecs[rank_file, pattern]


def round_trip(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per row, with ``keep_ids`` also ``ids`` and ``decoded``."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            own = codec(rank_file, pattern)
            ids = own.encode([x or "" for x in batch.column(1).to_pylist()])
            decoded = own.decode(ids)
            sums = [pa.array([hashlib.sha256(x).hexdigest() for x in column], pa.string()) for column in (ids, decoded)]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *sums]
            if keep_ids:
                columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding of every document by the 50k byte-level ranks."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
