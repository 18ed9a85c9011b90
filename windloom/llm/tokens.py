"""Token counts by a compiled finite-state transducer.

The merges of a piece model are compiled into a deterministic transducer over characters.  It rests on two facts about
merging by rank: a sequence of pieces is the encoding of its text exactly if each neighbouring pair is the encoding of
the pair's text, and the last piece of every prefix's encoding is therefore unique.  A state holds, for each position
from which a piece may still grow, the node reached in the piece tree, the last piece before that position and the
token count there relative to now; a transition carries the change of the token count.  States and transitions are made
when first met (the library decides on pairs of pieces) and kept up to a fixed number.

A text is cut into chunks of a fixed length.  A chunk's state map takes each state in which the transducer may enter it to
the state in which it leaves and the tokens counted on the way.  Which states those are is found in rounds over all
chunks at once: a chunk's exits may enter the next, and a walk from another state ends as soon as it meets the first one,
so maps stay small and each character is walked over a bounded number of times.  The maps, as integer arrays, compose
associatively and are joined by a parallel prefix scan, which gives the token offset of every chunk.  The path is the same
for texts of one chunk and of a million.

No piece runs across the end of a word into a space, so the transducer is back in its first state before each run of
spaces that follows another character, and after a character without a piece; between two such resets the count of a
word is remembered, within a bound in bytes.

Defined cases: null and empty texts have 0 bytes and 0 tokens; strings like ``<s>`` in a text are ordinary text; any
character without a piece counts one token per UTF-8 byte; repeated rows keep a row each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from windloom.llm.common import Remembered, slices

#: Characters of a chunk, and of the steps at which its first walk is noted; states that a task keeps before it starts
#: afresh; bytes of remembered words, and the longest of them.
CHUNK_CHARS, STEP, MAX_STATES, WORD_BYTES, WORD_CHARS = 32768, 64, 150_000, 96 << 20, 64
SPACE = "▁"
START = ((0, None, 0),)
_compiled: dict[str, Transducer] = {}


class Transducer:
    def __init__(self, model_file: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are compiled")
        self.prefix = " " if spec.add_dummy_prefix else ""  # what the library puts before a text that isn't empty
        spec.add_dummy_prefix = False
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[int] = [-1]
        size = self.library.get_piece_size()
        skip = [self.library.is_byte, self.library.is_control, self.library.is_unknown, self.library.is_unused]
        pieces = [(k, self.library.id_to_piece(k)) for k in range(size) if not any(f(k) for f in skip)]
        self.text = dict(pieces)
        self.known = {c for _, p in pieces for c in p}
        for k, p in pieces:
            node = 0
            for c in p:
                node = self._child(node, c)
            self.piece[node] = k
        if any(SPACE in p.lstrip(SPACE) for _, p in pieces):
            raise ValueError("a piece runs across a word's end; this model has no resets at spaces")
        self.newline = None if "\n" in self.known else len(self.library.encode("\n"))
        self.words = Remembered(WORD_BYTES)
        self.generation = 0
        self.reset()

    def _child(self, node: int, c: str) -> int:
        if c not in self.children[node]:
            self.children[node][c] = len(self.children)
            self.children.append({})
            self.piece.append(-1)
        return self.children[node][c]

    def reset(self) -> None:
        self.states, self.index, self.moves = [START], {START: 0}, [{}]
        self.pairs: dict[tuple, bool] = {}
        self.generation += 1

    def _state(self, key: tuple) -> int:
        k = self.index.setdefault(key, len(self.states))
        if k == len(self.states):
            self.states.append(key)
            self.moves.append({})
        return k

    def _string(self, token) -> str:
        return "" if token is None else token if isinstance(token, str) else self.text[token]

    def _ids(self, token) -> list[int]:
        return [] if token is None else self.library.encode(token) if isinstance(token, str) else [token]

    def _fit(self, a, b) -> bool:
        """Whether the pair of tokens is the encoding of its text."""
        if (a, b) not in self.pairs:
            self.pairs[a, b] = self.library.encode(self._string(a) + self._string(b)) == self._ids(a) + self._ids(b)
        return self.pairs[a, b]

    def _move(self, state: int, c: str) -> tuple[int, int]:
        if c not in self.known:
            return 0, len(c.encode())
        live, last, count = [], None, 0
        children, piece, pairs = self.children, self.piece, self.pairs
        for node, before, n in self.states[state]:
            to = children[node].get(c)
            if to is None:
                continue
            if last is None and (k := piece[to]) >= 0:
                fits = pairs.get((before, k))
                if self._fit(before, k) if fits is None else fits:
                    last, count = k, n + 1
            if children[to]:
                live.append((to, before, n))
        if last is None:  # the character is only known inside pieces
            last, count = c, self.states[state][-1][2] + len(c.encode())
        return self._state((*[(node, before, n - count) for node, before, n in live], (0, last, 0))), count

    def walk(self, text: str, state: int = 0) -> tuple[int, int]:
        """(state after, tokens) of ``text`` (spaces written as the piece model does), from ``state``."""
        total = 0
        moves = self.moves
        for c in text:
            move = moves[state].get(c)
            if move is None:
                move = moves[state][c] = self._move(state, c)
            state, n = move
            total += n
        return state, total

    def _fresh(self) -> None:
        """Start afresh where there are too many states."""
        if len(self.states) > MAX_STATES or len(self.pairs) > 4 * MAX_STATES:
            self.reset()

    def stretch(self, text: str, key: tuple, marks: list | None = None, known: list | None = None) -> tuple[tuple, int, int | None]:
        """(state after, tokens, None) of text without resets.  ``marks`` takes (generation, state, tokens) after each step;
        where the walk meets ``known`` marks it ends with the number of the mark instead of a full count."""
        self._fresh()
        state, total = self._state(key), 0
        for k, at in enumerate(range(0, len(text), STEP)):
            if len(self.states) > MAX_STATES + STEP:
                key = self.states[state]
                self._fresh()
                state = self._state(key)
            state, n = self.walk(text[at : at + STEP], state)
            total += n
            if marks is not None:
                marks.append((self.generation, state, total))
            if known and known[k][:2] == (self.generation, state):
                return self.states[state], total, k
        return self.states[state], total, None

    def _word(self, word: str) -> int:
        n = self.words.young.get(word)
        if n is None:
            n = self.words.old.get(word)
            if n is None:
                self._fresh()
                n = self.walk(SPACE + word)[1] if len(word) <= WORD_CHARS else self.stretch(SPACE + word, START)[1]
            if len(word) <= WORD_CHARS:
                self.words.put(word, n)
        return n

    def _after_resets(self, body: str) -> int:
        """Tokens of text that begins with a space and that the transducer enters and leaves in its first state."""
        words = body[1:].split(" ")
        if "  " not in body and body[-1] != " ":
            try:
                return sum(map(self.words.young.__getitem__, words))
            except KeyError:
                return sum(map(self._word, words))
        total = run = 0
        for word in words:
            if not word:
                run += 1
            elif run:
                total += self.stretch(SPACE * (run + 1) + word, START)[1]
                run = 0
            else:
                total += self._word(word)
        return total + (self.stretch(SPACE * run, START)[1] if run else 0)

    def _line(self, text: str) -> tuple[str, int, str]:
        """Head (up to the first space that follows another character), tokens from there to the last such, and tail."""
        first = _next_reset(text)
        if first < 0:
            return text, 0, ""
        last = _last_reset(text)
        return text[:first], self._after_resets(text[first:last]) if last > first else 0, text[last:]

    def _counted(self, text: str) -> int:
        """Tokens of a text without newlines from the first state."""
        head, count, tail = self._line(text)
        if head:
            count += self._word(head[1:]) if head[0] == " " and head[1:2] not in ("", " ") else self.stretch(head.replace(" ", SPACE), START)[1]
        return count + (self._word(tail[1:]) if tail[1:2] not in ("", " ") else self.stretch(tail.replace(" ", SPACE), START)[1] if tail else 0)


class Chunk:
    """The state map of one chunk, made for entry states as they are asked for."""

    def __init__(self, own: Transducer, text: str) -> None:
        # Up to the first reset the way depends on the entry; from there on it doesn't.
        self.own, self.rest, self.exit = own, 0, None
        if own.newline is not None and "\n" in text:  # a character without a piece is a reset too
            text, *lines = text.split("\n")
            tail = lines.pop()
            self.rest = own.newline * (len(lines) + 1) + sum(own._counted(x) for x in lines if x)
            before, count, last = own._line(tail)
            if last:
                count += own._counted(before) if before else 0
            else:
                last = before
            self.exit, n, _ = own.stretch(last.replace(" ", SPACE), START)
            self.rest += count + n
            head, count, last = own._line(text)
            self.rest += count + (own._counted(last) if last else 0)
        else:
            head, count, last = own._line(text)
            self.rest = count
            if last:
                self.exit, n, _ = own.stretch(last.replace(" ", SPACE), START)
                self.rest += n
        self.head = head.replace(" ", SPACE)
        self.marks: list = []
        self.map: dict[tuple, tuple[tuple, int]] = {}

    def __getitem__(self, entry: tuple) -> tuple[tuple, int]:
        """(exit state, tokens) for an entry state."""
        found = self.map.get(entry)
        if found is None:
            if self.map:
                state, n, met = self.own.stretch(self.head, entry, known=self.marks)
                if met is not None:
                    state, total = self.first
                    n += total - self.marks[met][2]
            else:
                state, n, _ = self.own.stretch(self.head, entry, marks=self.marks)
                self.first = state, n
            found = self.map[entry] = (state if self.exit is None else self.exit, n + self.rest)
        return found


def prefix_scan(exits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Tokens up to the end of every chunk, from the maps of n chunks with up to m entry states: ``exits[k, i]`` is the place
    of the exit among the entries of chunk k + 1, ``counts[k, i]`` the tokens.  Row k is composed with the row ``step`` before
    it, in log2 rounds of independent compositions; the text enters the first chunk by its entry 0."""
    exits, counts, step = exits.copy(), counts.copy(), 1
    while step < len(exits):
        via = exits[:-step]
        moved = np.take_along_axis(exits[step:], via, 1)
        total = counts[:-step] + np.take_along_axis(counts[step:], via, 1)
        exits[step:], counts[step:] = moved, total
        step *= 2
    return counts[:, 0]


def offsets(own: Transducer, text: str) -> list[int]:
    """Tokens of the text up to the end of each of its chunks; the last is its token count."""
    own.words.turn()
    text = own.prefix + text.replace(SPACE, " ")
    chunks = [Chunk(own, text[k : k + CHUNK_CHARS]) for k in range(0, len(text), CHUNK_CHARS)]
    entries: list[list[tuple]] = [[START] for _ in chunks]
    # Each chunk is first walked from the first state; every round then lets the new exits of all chunks into the next.
    fresh = [(k, START) for k in range(len(chunks))]
    while fresh:
        after = []
        for k, entry in fresh:
            leave = chunks[k][entry][0]
            if k + 1 < len(chunks) and leave not in entries[k + 1]:
                entries[k + 1].append(leave)
                after.append((k + 1, leave))
        fresh = after
    most = max(map(len, entries))
    exits, counts = np.zeros((len(chunks), most), np.int64), np.zeros((len(chunks), most), np.int64)
    for k, states in enumerate(entries):
        place = {s: i for i, s in enumerate(entries[k + 1])} if k + 1 < len(chunks) else {}
        for i, s in enumerate(states):
            leave, counts[k, i] = chunks[k][s]
            exits[k, i] = place.get(leave, 0)
    return prefix_scan(exits, counts).tolist()


def count(own: Transducer, text: str) -> int:
    return offsets(own, text)[-1] if text else 0


def _next_reset(s: str) -> int:
    """The first position of a space that follows another character, or -1."""
    k = s.find(" ")
    if k == 0:
        lead = len(s) - len(s.lstrip(" "))
        k = s.find(" ", lead) if lead < len(s) else -1
    return k


def _last_reset(s: str) -> int:
    """The last such position of a text that has one."""
    k = s.rfind(" ")
    return len(s[: k + 1].rstrip(" "))


def transducer(model_file: str) -> Transducer:
    if model_file not in _compiled:
        _compiled[model_file] = Transducer(model_file)
    return _compiled[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = transducer(model_file)
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = np.array([count(own, t) for t in texts], np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document as the 32k piece model counts them."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op1_token_counts": op1_token_counts}
