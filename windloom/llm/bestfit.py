"""Best-fit packing into sequences of at most 4096 tokens, improved by local search.

Only documents longer than a sequence are cut, into pieces of a whole sequence and a shorter last one.  Pieces that fill a sequence
stand alone; the others are dealt evenly, by a hash of their row, into blocks of some thousands, which tasks pack: longest first into
the fullest bin that has room, then by exchanges between underfull bins.  The emptiest bin gives to fuller ones: it moves a piece, swaps
one for a smaller one, one for two, or two for one, always the exchange that raises the sum of squared fills most.  The sum can't
grow for ever, so the search ends: when the bins are as few as their tokens need, or when no bin has an improving exchange left.

A block leaves a few bins with more room than a 64th.  Their pieces are dealt anew, into fewer blocks, until one block holds them or
a round leaves more than half of them, so the loss doesn't grow with the number of blocks.

Every distinct word between spaces is encoded once per task memory, by the library or, for plain ASCII, piece by piece with the
library's own merges; ids are those of the library for the whole text.  Defined cases: a null text counts as empty and
has the one end id; repeated rows are documents of their own; an empty table gives an empty result; a special token's string in a
text is that token, as is the library's default; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windloom.llm import packing
from windloom.llm.common import slices, store

#: Tokens of a sequence; pieces of a block; bytes of words that a Python worker remembers; rounds of dealing anew.
CAPACITY, BLOCK, REMEMBERED, ROUNDS = 4096, 8192, 256 << 20, 6


class _Known(dict):
    """Values by key, made by ``make`` where missing; what wasn't met in the last ``limit`` bytes or so is forgotten."""

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.used, self.old = make, limit // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.used += 160 + len(key) + len(value)
        self[key] = value
        return value

    def turn(self) -> None:
        """Call between texts: the young half becomes the old one when it is full."""
        if self.used > self.limit:
            self.old, self.used = dict(self), 0
            self.clear()


class WordEncoder:
    """Ids (unsigned 16-bit) by a tokenizers file that drops white space and never joins what it separates, so that the words between
    spaces can be encoded one by one; other files are left to ``packing.Tokenizer``."""

    def __init__(self, file: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = None if _parts_at_spaces(spec) else packing.tokenizer(file)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(file)
            self.words, self.pieces = _Known(self._word, REMEMBERED // 2), _Known(self._piece, REMEMBERED // 2)
            # What special tokens begin with: a word that holds it (any word, if they have nothing in common) goes to the library.
            self.special = os.path.commonprefix([t["content"] for t in spec["added_tokens"]]) if spec["added_tokens"] else "\n"

    #: Words of printable ASCII and Latin letters have the same lower case, normal form and cut everywhere.
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    #: Fixed by the format of the vocabulary: how such a word is cut, in lower case; what bytes are shown as.
    PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    SHOWN = {ord(c): f"Ã{chr(b) if b > 0xA0 and b != 0xAD else chr(0x143 if b == 0xAD else b + 0xA2)}" for c in map(chr, range(0xC0, 0x100)) for b in [c.encode()[1]]}

    def _word(self, word: str) -> bytes:
        if (word.isascii() and word.isprintable() or self.PLAIN.fullmatch(word)) and self.special not in word:
            return b"".join(map(self.pieces.__getitem__, self.PIECE.findall(word.lower())))
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u2").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.translate(self.SHOWN)
        ids = [t.id for t in self.library.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def encode(self, text: str) -> bytes:
        if self.whole is not None:
            return self.whole.encode(text)
        self.words.turn()
        self.pieces.turn()
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def _parts_at_spaces(spec: dict) -> bool:
    """Normal forms, white space to one space, lower case; words matched by a pattern without white space, the rest dropped;
    BPE without options over bytes shown as characters, ids that fit in 16 bits."""
    forms = [n.get("type") for n in (spec["normalizer"] or {}).get("normalizers", [])]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    model, added = spec["model"], spec["added_tokens"]
    if forms != ["NFC", "Replace", "Lowercase"] or [s["type"] for s in steps] != ["Split", "ByteLevel"] or model["type"] != "BPE":
        return False
    swap = spec["normalizer"]["normalizers"][1]
    split, shown = steps
    #: Fixed by the format of the vocabulary.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    as_known = (swap["pattern"], swap["content"]) == ({"Regex": r"\s+"}, " ") and split["pattern"] == {"Regex": pattern} and (split["behavior"], split["invert"]) == ("Removed", True)
    bare = not shown["add_prefix_space"] and not shown.get("use_regex", True) and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    return plain and as_known and bare and max([*model["vocab"].values(), *(t["id"] for t in added)]) < 65536


@cache
def encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def cut(docs: DataFrame, file: str, capacity: int, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document's pieces, the end id included; with ``keep_ids`` also
    ``ids`` (little-endian unsigned 32-bit integers)."""
    end = end_id.to_bytes(2, "little")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file).encode
        for batch in slices(batches):
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wide = np.frombuffer(encode(text or "") + end, "<u2").astype("<u4").tobytes()
                for k, at in enumerate(range(0, len(wide), 4 * capacity)):
                    ids = wide[at : at + 4 * capacity]
                    found.append((doc_id, k, at // 4, len(ids) // 4, zlib.crc32(ids), ids)[: len(names)])
            columns = list(zip(*found, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest items first, each into the fullest bin with room for it."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    some = 0  # bit r: there are bins with room r
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = sizes[item]
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                some ^= 1 << r
            bins[b].append(item)
            r -= size
        else:
            b, r = len(bins), capacity - size
            bins.append([item])
        if r:
            room[r].append(b)
            some |= 1 << r
    return bins


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills, until bins are empty or nothing helps.

    Every underfull bin offers what it can give back: nothing, one of its pieces, or two (each distinct size or pair of sizes once).
    The offers of all bins stand in flat arrays, and those of a changed bin are struck out and written anew at the end.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins
        self.fill = np.array([sum(sizes[k] for k in b) for b in bins], np.int64)
        self.offers: np.ndarray = np.zeros((0, 4), np.int64)  # bin, size, size, tokens given back
        self.late: list[np.ndarray] = []
        for b in np.flatnonzero(self.fill < capacity).tolist():
            self._offer(b)

    def _sets(self, b: int) -> tuple[list[int], list[tuple[int, int]]]:
        own = sorted(self.sizes[k] for k in self.bins[b])
        single = sorted(set(own))
        twice = [x for x, y in zip(own, own[1:]) if x == y]
        return single, sorted({*combinations(single, 2), *((x, x) for x in twice)})

    def _offer(self, b: int) -> None:
        single, pair = self._sets(b)
        rows = [(b, 0, 0, 0), *((b, x, 0, x) for x in single), *((b, x, y, x + y) for x, y in pair)]
        self.late.append(np.array(rows, np.int64))

    def _strike(self, b: int) -> None:
        self._settle()
        self.offers = self.offers[self.offers[:, 0] != b]

    def _settle(self) -> None:
        if self.late:
            self.offers, self.late = np.concatenate([self.offers, *self.late]), []

    def best_exchange(self, giver: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """(receiver, sizes given, sizes given back) with the greatest rise, or None."""
        self._settle()
        single, pair = self._sets(giver)
        fill = self.fill[self.offers[:, 0]]
        fuller = (self.offers[:, 0] != giver) & (fill >= self.fill[giver])
        at = np.flatnonzero(fuller)
        back, lead, room = self.offers[at, 3], fill[at] - self.fill[giver], self.capacity - fill[at]
        best, found = 0, None
        one = (self.offers[at, 1] > 0) & (self.offers[at, 2] == 0)
        for given, among in ([((x,), None) for x in single] + [(p, one) for p in pair]):
            more = sum(given) - back
            rise = np.where((more > 0) & (more <= room), more * (lead + more), 0)
            if among is not None:
                rise = np.where(among, rise, 0)
            if len(rise) and (k := int(rise.argmax())) is not None and rise[k] > best:
                best, found = int(rise[k]), (int(self.offers[at[k], 0]), given, tuple(int(x) for x in self.offers[at[k], 1:3] if x))
        return found

    def exchange(self, giver: int, receiver: int, given: tuple[int, ...], back: tuple[int, ...]) -> None:
        for source, target, moved in ((giver, receiver, given), (receiver, giver, back)):
            for size in moved:
                item = next(k for k in self.bins[source] if self.sizes[k] == size)
                self.bins[source].remove(item)
                self.bins[target].append(item)
        more = sum(given) - sum(back)
        self.fill[giver] -= more
        self.fill[receiver] += more
        for b in (giver, receiver):
            self._strike(b)
            if 0 < self.fill[b] < self.capacity:
                self._offer(b)

    def run(self) -> list[list[int]]:
        """Ends when at most one bin has room, or when every underfull bin has been tried since the last exchange."""
        stuck: set[int] = set()
        while True:
            open_bins = np.flatnonzero((self.fill > 0) & (self.fill < self.capacity)).tolist()
            able = [b for b in open_bins if b not in stuck]
            if len(open_bins) < 2 or not able:
                return [b for b in self.bins if b]
            giver = min(able, key=lambda b: (self.fill[b], b))
            found = self.best_exchange(giver)
            if found is None:
                stuck.add(giver)
            else:
                self.exchange(giver, *found)
                stuck.clear()


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, each within ``capacity``."""
    return LocalSearch(best_fit(sizes, capacity), sizes, capacity).run()


def _packed(pieces: DataFrame, capacity: int, blocks: int, salt: int) -> DataFrame:
    """``pieces`` with ``sequence_id, offset, closed``, packed in so many blocks.  A sequence has the smallest row of its pieces as id."""
    names = [c for c in pieces.columns if c != "block"]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def run(block: pa.Table) -> pa.Table:
        block = block.select(names).sort_by("row")
        sizes, rows = block.column("length").to_pylist(), block.column("row").to_pylist()
        order, sequence, offset, shut = [], [], [], []
        for b in pack_block(sizes, capacity):
            at, first = 0, min(rows[k] for k in b)
            closed = 64 * (capacity - sum(sizes[k] for k in b)) <= capacity
            for k in sorted(b):
                order.append(k)
                sequence.append(first)
                offset.append(at)
                shut.append(closed)
                at += sizes[k]
        out = block.take(pa.array(order, pa.int64()))
        for name, values, kind in (("sequence_id", sequence, pa.int64()), ("offset", offset, pa.int64()), ("closed", shut, pa.bool_())):
            out = out.append_column(name, pa.array(values, kind))
        return out

    dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.col("row") + salt), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(run, f"{kept}, sequence_id long, offset long, closed boolean")


def pack(docs: DataFrame, file: str | None = None, capacity: int = CAPACITY, block: int = BLOCK, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; with ``keep_ids`` also ``ids`` (little-endian
    unsigned 32-bit integers), from which sequences are put together."""
    if capacity < 1 or block < 1:
        raise ValueError("sequences and blocks hold at least one token or piece")
    if file is None:
        import public_tokenizers

        file = public_tokenizers.path("word_bpe_49k.json")
    pieces = store(cut(docs, file, capacity, keep_ids=keep_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    out = [c for c in pieces.columns if c not in ("row", "ids")] + ["sequence_id", "offset"] + ["ids"] * keep_ids
    alone = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row"), "offset": F.lit(0).cast("long")})
    done, rest = [alone.select("row", *[c for c in out if c != "ids"])], pieces.where(F.col("length") < capacity).drop("ids")
    count = rest.count()
    for salt in range(ROUNDS):
        blocks = max(1, -(-count // block))
        packed = store(_packed(rest, capacity, blocks, salt), "packed")
        placed = packed.select(*done[0].columns)
        left = packed.where(~F.col("closed"))
        more = 0 if blocks == 1 or salt == ROUNDS - 1 else left.count()
        if not more or 2 * more > count:
            done.append(placed)
            break
        done.append(placed.where(packed["closed"]))
        rest, count = left.select(*rest.columns), more
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return (result.join(pieces.select("row", "ids"), "row") if keep_ids else result).select(*out)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into as few sequences of 4096 tokens as the search finds."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op13_best_fit": op13_best_fit}
