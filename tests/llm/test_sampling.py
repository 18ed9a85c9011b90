"""Resampling, the audit of sources and best-fit packing against brute force and the library."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from windloom.llm import bestfit, divergence, resampling

P = pytest.importorskip("public_tokenizers")
LONG = "Wort and word, été " * 30_000
TEXTS = [
    None, "", " ", "a", "The cat sat on the mat; the cat slept and the dog sat on the cat near a mat with one more dog or two.", "漢字 naïve ÜBER 🙂 x9 9x" * 12,
    "the the the THE The " * 20, LONG, "…–", "zero\x00byte\tNaïve\r\nline", "A-B_c d'accord it's <|endoftext|>x <|ENDOFTEXT|> don't 3.14",
]


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls everywhere, ties, repeated rows, and columns whose names clash with the operators' own."""
    langs, sources = ["en", "de", None], ["s0", "s1", None, ""]
    rows = [(k, t, langs[k % 3], sources[k % 4], k, "x", 1) for k, t in enumerate(TEXTS)]
    rows += [(100 + k, TEXTS[4] + f" word{k % 7}", "en", f"s{k % 3}", k, "y", None) for k in range(60)]
    rows += [(4, TEXTS[4], "en", "s0", 1, "x", 1), (4, TEXTS[4], "en", "s0", 1, "x", 1), (None, TEXTS[4], "de", "s1", None, None, None), (200, "Ü!", "fr", "s0", 1, "x", 1), (201, "--", "xx", "s5", 1, "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row int, score string, total int")


def brute_weights(rows, target, longest, buckets):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return w, [zlib.crc32(" ".join(w[a : a + n]).encode()) % buckets for n in range(1, longest + 1) for a in range(len(w) - n + 1)]

    s, t = collections.Counter(), collections.Counter()
    for r in rows:
        s.update(found(r.text)[1])
    for x in target:
        t.update(found(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for r in rows:
        words, own = found(r.text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in own]
        h = int(hashlib.sha256(f"2024:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        weight = math.floor(sum(gain) / len(gain)) if gain else 0
        out.append((r.doc_id, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


@pytest.mark.parametrize(("longest", "buckets", "per_cent"), [(1, 10_000, 10), (3, 70_000, 50), (1, 1, 100), (1, 97, 0)])
def test_resampling_equals_brute_force(spark, docs, longest, buckets, per_cent):
    target = ["The dog sat.", None, "", "été Wort dog"]
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), per_cent, buckets, longest).collect()
    want = brute_weights(docs.collect(), target, longest, buckets)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score) for r in got], key=key) == sorted([(d, f, w, s) for d, _, f, w, s in want], key=key)
    able = sorted((-s, d is None, d or 0) for d, n, _, _, s in want if n >= 20)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, per_cent * len(able) // 100 + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in drawn] == able[: len(drawn)]


def test_resampling_of_nothing(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.where("false"), none).count() == 0
    assert resampling.resample(docs, none).count() == docs.count()
    with pytest.raises(ValueError, match="share"):
        resampling.resample(docs, none, per_cent=101)


def brute_audit(rows, least, top):
    n, in_docs, groups = collections.Counter(), collections.Counter(), set()
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(r.text or ""))
        n.update((lang, source, t) for t in found)
        in_docs.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for (a, t), k in in_docs.items() if a == lang and k >= least), key=lambda t: t.encode())
        sources = sorted(s for a, s in groups if a == lang)
        share = lambda counts: [1 + 10**9 * (c + 1) // (sum(counts) + len(counts)) for c in counts]
        counts = {s: [n[lang, s, t] for t in kept] for s in sources}
        p, q = {s: share(c) for s, c in counts.items()}, share([sum(c) for c in zip(*counts.values(), strict=True)])
        for s in sources:
            pairs = [(-sum((x - y) ** 2 // y for x, y in zip(p[s], p[o], strict=True)), o) for o in sources if o != s]
            terms = [(-((x - y) ** 2 // y), t) for t, c, x, y in zip(kept, counts[s], p[s], q, strict=True) if c and x > y]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms, key=lambda v: (v[0], v[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(3, 200), (1, 5), (10_000, 3)])
def test_divergence_equals_brute_force(docs, least, top):
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(docs, least, top).collect())
    assert got == brute_audit(docs.collect(), least, top)


def test_divergence_of_many_sources_and_of_nothing(spark, docs):
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)]
    rows = [(k, " ".join(rng.choice(words, 60, p=None)), "l", f"s{k % 40}") for k in range(400)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(divergence, "PAIRS_AT_ONCE", 1000)
        got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.audit(many, 3, 10).collect())
    assert got == brute_audit(many.collect(), 3, 10)
    assert divergence.audit(docs.where("false")).count() == 0
    assert {r.value for r in divergence.audit(docs.select("text")).where("part = 'pair'").collect()} == set()


def test_word_encoder_equals_the_library():
    from tokenizers import Tokenizer

    file = P.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(file), bestfit.WordEncoder(file)
    assert own.whole is None
    ids = lambda b: np.frombuffer(b, "<u2").tolist()
    made = [f"ab{chr(c)}cd é{chr(c)} 1'S{chr(c)}{chr(c)}Don't" for c in [*range(1, 0x500), 0x2028, 0x3000, 0x1F642, 0x130, 0x3A3, 0xFB01, 0xAC00]]
    rng = np.random.default_rng(4)
    parts = ["a", "É", "ing", "'S", "''", "…", " ", "\n", "\x1c", "1", "½", "ª", "Σ", "é", "́", "<|endoftext|>", "<|startoftext|", "|>", "漢", "🙂", " ", "ß", "İ"]
    made += ["".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(400)] + [t for t in TEXTS if t] + ["x" * 50_000, "é" * 20_000]
    for t in made:
        assert ids(own.encode(t)) == library.encode(t, add_special_tokens=False).ids, t[:80]
    with pytest.MonkeyPatch.context() as m:  # words forgotten all the time
        m.setattr(bestfit, "REMEMBERED", 4000)
        small = bestfit.WordEncoder(file)
        assert [small.encode(t) for t in made[:200]] == [own.encode(t) for t in made[:200]]


def checked(got, docs, capacity, encode):
    texts = collections.Counter()
    for r in docs.collect():
        ids = encode(r.text or "") + [1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            texts[(r.doc_id, k, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == texts
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in got) // capacity)


@pytest.mark.parametrize(("capacity", "block"), [(4096, 8192), (64, 8), (50, 1000), (1, 5)])
def test_best_fit_packing(docs, capacity, block):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    some = docs if capacity > 1 else docs.where("doc_id between 100 and 103")
    got = bestfit.pack(some, capacity=capacity, block=block, keep_ids=True).collect()
    n, least = checked(got, some, capacity, lambda t: library.encode(t, add_special_tokens=False).ids)
    assert least <= n <= least * 1.25 + 1
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert bestfit.pack(docs.where("false")).count() == 0


def test_best_fit_packing_of_other_vocabularies(docs):
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(file)
    got = bestfit.pack(docs, file=file, capacity=100).collect()
    checked(got, docs, 100, lambda t: library.encode(t, add_special_tokens=False).ids)


def bins_needed(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = [len(sizes)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in sorted({b: i for i, b in enumerate(bins)}.values()):
            if bins[i] + sizes[k] <= capacity:
                place(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        place(k + 1, [*bins, sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best[0]


def test_local_search_beats_best_fit_and_nears_the_optimum():
    rng, better, over = np.random.default_rng(5), 0, 0
    for _ in range(120):
        sizes = rng.integers(15, 60, 14).tolist()
        first = bestfit.best_fit(sizes, 100)
        search = bestfit.LocalSearch([list(b) for b in first], sizes, 100)
        before = (search.fill**2).sum()
        final = search.run()
        assert sorted(itertools.chain(*final)) == list(range(14))
        assert all(sum(sizes[k] for k in b) <= 100 for b in final)
        assert len(final) <= len(first)
        assert (search.fill**2).sum() >= before
        better += len(final) < len(first)
        over += len(final) - bins_needed(sizes, 100)
    assert better >= 3
    assert over <= 10


def test_every_exchange_raises_the_squares():
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 50, 60).tolist()
    search = bestfit.LocalSearch([[k] for k in range(60)], sizes, 100)
    met = set()
    for _ in range(500):
        able = np.flatnonzero((search.fill > 0) & (search.fill < 100))
        giver = min(able.tolist(), key=lambda b: (search.fill[b], b), default=None)
        found = None if giver is None else search.best_exchange(giver)
        if found is None:
            break
        before = (search.fill**2).sum()
        search.exchange(giver, *found)
        assert (search.fill**2).sum() > before
        assert search.fill.tolist() == [sum(sizes[k] for k in b) for b in search.bins]
        met.add((len(found[1]), len(found[2])))
    assert (1, 0) in met


def test_queries_over_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert resampling.op11_resampling(spark, sf).count() == docs.count()
    assert divergence.op12_source_divergence(spark, sf).where("part = 'pair'").count() > 0
    assert bestfit.op13_best_fit(spark, sf).agg(F.countDistinct("doc_id")).first()[0] == docs.count()


def test_ranked_samples_are_a_bijection_and_shorter():
    from windloom.llm import media

    everything = bytes(range(256)) * 4
    for ranked in (False, True):
        assert sorted(media.as_samples(bytes(range(256)), ranked)) == list(range(256))
        assert media.as_payload(media.as_samples(everything, ranked), ranked) == everything
        assert media.as_payload(media.decode(media.encode([everything], ranked))[0][0], ranked) == everything
    assert media.as_samples(b" ea", True) == bytes([0, 255, 1])
    text = media.padded(TEXTS[4].encode() * 20)
    assert len(media.encode([text], True)[0]) < 0.8 * len(media.encode([text])[0])


def test_similar_links_at_any_size_and_across_tiles(spark, monkeypatch):
    """Chains of near copies above 64 nodes, in one tile and in many, against exact similarities."""
    from windloom.llm import simhash

    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(3):
        own = rng.choice(words, 120).tolist()
        for _ in range(40):
            texts.append(" ".join(own))
            own[int(rng.integers(0, 120))] = str(rng.choice(words))
    texts += [" ".join(rng.choice(words, 60)) for _ in range(20)]
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (2**21, 4000):
        monkeypatch.setattr(simhash, "TILE_SHINGLES", tile)
        assert sorted(r.doc_id for r in simhash.dedup(docs).collect()) == sorted(set(root))


def test_toxicity_recall_and_precision(spark):
    """On held-out rows: most toxic texts are found and hardly a clean one is."""
    from windloom.llm import toxicity

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(truth[r.doc_id], r.predicted) for r in toxicity.op8_toxicity(spark, sf).where("held_out").collect() if r.doc_id in truth]
    found = sum(t and p for t, p in rows)
    assert found >= 0.6 * sum(t for t, _ in rows)
    assert found >= 0.9 * sum(p for _, p in rows)
