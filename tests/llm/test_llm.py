"""Operators on texts against libraries, brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import base64
import collections
import hashlib
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from windloom.llm import bpe, common, embeddings, flac, media, packing, quality, sharding, simhash, tokens, toxicity, urls

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "a", "Don't stop  now\n\n\tplease ", "The cat sat on the mat. " * 40, "The cat sat on the mat. " * 40, "naïve Ünïcode 漢字 🙂 ▁x", "<s> </s> <|endoftext|> <0x41>",
    "x" * 3000, "ab " * 20000, "  lead and   gaps  \r\n end", "zero\x00byte", "A B C", "a b c",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(k, t, f"s{k % 3}" if k % 4 else None, k, "x") for k, t in enumerate(TEXTS)] + [(3, "a", "s0", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int, fp string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_token_counts_equal_the_library(docs, empty):
    import sentencepiece

    file = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=file), texts_of(docs)
    got = tokens.token_counts(docs, file).collect()
    assert len(got) == docs.count()
    for r in got:
        n = len(library.encode(own[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(own[r.doc_id].encode()), n, n > 4096)
    assert tokens.token_counts(empty, file).count() == 0


def brute_fingerprint(text: str) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(spark, docs, empty):
    own = {k: brute_fingerprint(t) for k, t in texts_of(docs).items()}
    root = {k: k for k in own}
    for _ in own:
        for a in own:
            for b in own:
                if (own[a] ^ own[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.fingerprint, r.component_id) == (f"{own[r.doc_id]:016x}", root[r.doc_id])
    assert simhash.near_duplicates(empty).count() == 0


def test_token_counts_of_texts_without_spaces():
    """Any cut into chunks, any bound on states, and long unspaced texts in linear time, as the library counts them."""
    import sentencepiece

    file = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=file), tokens.Transducer(file)
    rng = np.random.default_rng(2)
    parts = ["a", "b", " ", "  ", "\n", "é", "漢", "字", "🙂", "1", "ation", "the", "ing", "▁", "中文", "x" * 40, "<s>"]
    made = ["".join(rng.choice(parts, rng.integers(1, 120))) for _ in range(300)]
    for chunk, states in ((7, 400), (64, 150_000), (200, 400)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(tokens, "CHUNK_CHARS", chunk)
            m.setattr(tokens, "MAX_STATES", states)
            for t in made:
                assert tokens.count(own, t) == len(library.encode(t)), (chunk, t)
    letters = [chr(c) for c in rng.integers(0x4E00, 0x9FA5, 3000)]
    for t in ("".join(rng.choice(letters, 300_000)), "".join(rng.choice(list("abcdefXYZ0129+/"), 200_000)), " " * 100_000):
        started = time.process_time()
        assert tokens.count(own, t) == len(library.encode(t))
        assert time.process_time() - started < 20
    first = tokens.offsets(own, made[0] + "漢" * 70_000)
    assert len(first) == 3 and first == sorted(first)


def test_long_words_by_spans():
    import tiktoken

    file = P.path("byte_bpe_50k.tiktoken")
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own, rng = bpe.Codec(file, P.PATTERN), np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyzABC")
    words = ["".join(rng.choice(letters, n)) for n in (64, 65, 95, 96, 97, 128, 129, 1000, 30_000)]
    words += ["a" * n for n in (65, 128, 5001)] + ["ab" * 300, "=" * 1000, "漢字" * 200, "🙂" * 100, "abc" * 111]
    for w, got in zip(words, own.encode(words), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(w), w[:40]
    assert own.decode(own.encode(words)) == [w.encode() for w in words]
    for w, got in zip(words[:8] + words[9:], own._contract([w.encode() for w in words[:8] + words[9:]], bpe.ENCODE_ALL), strict=True):
        assert got.tolist() == library.encode_ordinary(w), w[:40]


def test_slices_are_bounded_in_rows_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * (50 if k != 500 else 10_000) for k in range(1000)]), pa.array([[1, 2]] * 1000)], ["a", "b", "c"])
    parts = list(common.slices([batch], 100, 4000))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(p.num_rows for p in parts) <= 100
    assert [p.num_rows for p in parts if common.row_bytes(p).sum() > 4000] == [1]
    memory = common.Remembered(2000)
    for k in range(100):
        memory.turn()
        assert memory.missing({f"k{k}", "always"}) == [x for x in {f"k{k}", "always"} if x == f"k{k}" or k == 0]
        for x in {f"k{k}", "always"}.difference(memory.young):
            memory.put(x, b"v")
        assert len(memory.young) + len(memory.old) < 20


def test_cluster_needs_a_shared_folder():
    class Context:
        master, _dir = "spark://host:7077", None

        def getCheckpointDir(self):
            return self._dir

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(Session())


@pytest.mark.parametrize("tile", [16384, 40])
def test_block_links_of_large_blocks(spark, monkeypatch, tile):
    """One block of 300 fingerprints, whole and in pairs of tiles: the components of brute force."""
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**62, 60)
    prints = [int(x) for x in base] + [int(base[k % 60]) ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))) for k in range(240)]
    root = list(range(300))
    for _ in range(8):
        for a in range(300):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    blocks = spark.createDataFrame([(1, k, x) for k, x in enumerate(prints)] + [(2, 900, 5), (2, 901, 5)], "key long, node long, w0 long")
    got = {r.node: r.root for r in common.connected_components(simhash.block_links(blocks, 3, 1)).collect()}
    assert got.pop(901) == got.pop(900) == 900
    assert [got.get(k, k) for k in range(300)] == root


def test_connected_components(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(1000, k) for k in range(1001, 1100)]
    edges = spark.createDataFrame([*chain, *star, (5, 4), (7, 7), (3000, 2999), (None, 1)], "a long, b long")
    got = {r.node: r.root for r in common.connected_components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 1000 for k in range(1000, 1100)} | {2999: 2999, 3000: 2999}
    assert common.connected_components(edges.where("false")).count() == 0


def test_dedup_keeps_columns_of_any_name(spark):
    rows = [(3, "a b c d e f", 7, "x", 1), (1, "a b c d e f", 8, "y", 2), (2, "other words are in this text", 9, "z", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __wl_id int, __wl_sum string, first int")
    out = simhash.dedup(frame)
    assert out.columns == frame.columns
    assert sorted(map(tuple, out.collect())) == [rows[1], rows[2]]


def test_radius_two_links_are_whole(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**62, 40)]
    prints = base + [x ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for x in base for _ in range(4)]
    root = list(range(len(prints)))
    for _ in range(6):
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    rows = spark.createDataFrame([(k, x - 2**64 if x >= 2**63 else x) for k, x in enumerate(prints)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in rows.join(simhash.components(rows), "fp").collect()}
    assert got == dict(enumerate(root))


def test_dedup_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 7))
    texts = [[word() for _ in range(300)] for _ in range(6)]
    near = [[*t[:290], word(), *t[291:]] for t in texts]
    rows = [(k, " ".join(t), k) for k, t in enumerate(texts + near)] + [(0, " ".join(texts[0]), 0), (50, None, 1), (51, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, node int")
    out = simhash.dedup(frame)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3, 4, 5, 50]
    assert simhash.dedup(frame.where("false")).count() == 0


def test_dedup_counts_the_similarity(spark):
    """Pairs at 0.75 stay, pairs at 0.8 go, and repeats of a line don't count: the sets of shingles decide."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 7))
    rows = []
    for k in range(60):
        t = [word() for _ in range(204)]
        rows += [(4 * k, " ".join(t)), (4 * k + 1, " ".join([*t[:175], *(word() for _ in range(29))]))]  # 171 of 229
        u = [word() for _ in range(204)]
        rows += [(4 * k + 2, " ".join(u)), (4 * k + 3, " ".join([*u[:183], *(word() for _ in range(21))]))]  # 179 of 221
    line = [word() for _ in range(14)]
    body = [word() for _ in range(250)]
    rows += [(1000, " ".join(line * 2 + body)), (1001, " ".join(line * 12 + body))]
    sets = {}
    for k, t in rows:
        w = t.split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    assert sets[1000] == sets[1001]
    gone = {b for b in sets for a in sets if a < b and near(a, b)}
    assert gone == {4 * k + 3 for k in range(60)} | {1001}
    kept = {r.doc_id for r in simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(sets) - gone


def test_logistic_ends_on_separable_classes():
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 1, (5000, 2)), rng.normal(30, 1, (500, 2))]
    y = np.r_[np.zeros(5000), np.ones(500)]
    beta = quality.logistic(x, y)
    assert (beta[:2] > 0).all()
    assert ((x @ beta[:2] + beta[2] > 0) == (y == 1)).all()
    mixed = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:4000, 0]))).astype(float)
    assert quality.logistic(x[:4000, :1], mixed) == pytest.approx([2, 0], abs=0.25)


def test_more_evidence_never_lowers_the_score():
    rng = np.random.default_rng(3)
    a = rng.exponential(1, 2000)
    x = np.column_stack([a, a + rng.normal(0, 0.05, 2000)])
    y = (rng.random(2000) < 1 / (1 + np.exp(3 - 2 * x[:, 0] + 0.5 * (x[:, 1] - x[:, 0]) * 40))).astype(float)
    plain, curve = quality.logistic(x, y), toxicity.rising_curve(x, y)
    assert plain[:2].min() < 0 <= curve[:2].min() and curve[:2].max() > 0


@pytest.mark.parametrize(("module", "target", "modulus", "held"), [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_classifiers_on_held_out_rows(spark, empty, docs, module, target, modulus, held):
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = module.fit(table, labels)
    rows = (module.scored(table, model, modulus, held, 0.3)).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % modulus == held and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[target] for r in rows]) >= 0.9
    assert module.scored(docs, model, modulus, held, 0.3).count() == docs.count()
    assert module.scored(empty, model, modulus, held, 0.3).count() == 0
    keep = quality.keep_good if module is quality else toxicity.keep_clean
    assert keep(empty, labels).count() == 0 and keep(empty, labels).columns == docs.columns
    none = module.fit(docs, labels.where("false"))
    assert {round(r.score, 6) for r in module.scored(docs, none, modulus, held, 0.3).collect()} == {0.5}


def test_segments_are_maximal():
    found = toxicity.segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0]))
    assert found == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    assert toxicity.segments(np.array([])) == toxicity.segments(np.array([-1.0])) == []


def test_shards_are_minimax_for_their_order(docs, empty):
    own = texts_of(docs)
    got = sharding.shard(docs, 4).collect()
    assert len(got) == docs.count()
    group: dict[str, int] = collections.Counter()
    for r in got:
        t = own[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        group[hashlib.sha256(t).hexdigest()] += len(t) + 1
    sizes = [group[h] for h in sorted(group)]

    def shards(capacity: int) -> int:
        n, held = 1, 0
        for s in sizes:
            n, held = (n + 1, s) if held + s > capacity else (n, held + s)
        return n

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if shards(c) <= 4)
    total: dict[int, int] = collections.Counter()
    for r in got:
        total[r["shard"]] += r["size"]
    assert max(total.values()) == best
    for s in total:
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard(empty, 4).count() == 0


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 64))
    rows = [(k, (base[k % 30] + 0.05 * rng.standard_normal(64)).tolist(), k % 2) for k in range(240)]
    rows += [(300, rows[0][1], 0), (301, None, 0), (302, [0.0] * 64, 0), (303, [float("nan")] * 64, 0), (304, rows[0][1], None), (305, [None, *rows[0][1][1:]], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    root, degree = {r[0]: r[0] for r in rows}, collections.Counter()
    fine = [(k, np.array(v) / np.linalg.norm(v), y) for k, v, y in rows if k <= 300]
    pairs = [(a, b) for i, (a, x, y) in enumerate(fine) for b, z, w in fine[:i] if y == w and x @ z >= 0.98]
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    for _ in range(len(rows)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = embeddings.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= 0.99 * 2 * len(pairs) > 0
    assert all(r.n_links <= degree[r.vec_id] and r.kept == (r.vec_id == r.component_id) for r in got)
    assert np.mean([r.component_id == root[r.vec_id] for r in got]) >= 0.99
    assert embeddings.near_duplicates(frame.where("false")).count() == 0


@pytest.mark.parametrize(("threshold", "noise", "tile"), [(0.98, 0.05, 4096), (0.9, 0.2, 4096), (0.98, 0.02, 50)])
def test_embedding_counts_in_dense_groups(spark, monkeypatch, threshold, noise, tile):
    """Groups of some hundred close vectors, whole and in pairs of tiles: links counted once, none below the threshold."""
    monkeypatch.setattr(embeddings, "TILE_ROWS", tile)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((4, 64))
    x = (base[rng.integers(0, 4, 500)] + noise * rng.standard_normal((500, 64))).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist(), "one") for k, v in enumerate(x)] + [(900, x[0].tolist(), "one")], "vec_id long, embedding array<float>, label string")
    x = np.concatenate([x, x[:1]]).astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= threshold).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame, threshold).collect()}
    got = np.array([got[k] for k in [*range(500), 900]])
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum() > 1000 and got[0] == got[-1]


def test_byte_bpe_equals_the_library_and_round_trips(docs, empty):
    import tiktoken

    file, own = P.path("byte_bpe_50k.tiktoken"), texts_of(docs)
    with open(file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.round_trip(docs, file, P.PATTERN, keep_ids=True).collect()
    assert len(got) == docs.count()
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(own[r.doc_id])
        assert bytes(r.decoded) == own[r.doc_id].encode()
    assert bpe.round_trip(empty, file, P.PATTERN).count() == 0


def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme.net/": ("", "", None, "allow"), "http://A.NET/x": ("a.net", "/x", "net/", "block"), "http://net": ("net", "", None, "allow"),
        "http://www.example.net/en/a?b#c": ("www.example.net", "/en/a", "example.net/en/", "allow"), "http://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "ftp://x.example.com/de/y": ("x.example.com", "/de/y", "example.com/de/", "block"), "http://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"),
    }
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(cases)] + [(0, None, "clash")], "page_id long, url string, rule string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = urls.url_filter(pages, rules).collect()
    assert len(got) == len(cases) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id] for r in got)
    assert {r.verdict for r in urls.url_filter(pages, rules.where("false")).collect()} == {"allow"}
    assert urls.url_filter(pages.where("false"), rules).count() == 0
    clash = pages.withColumns({c: F.lit(c) for c in ("best", "host", "Verdict", "digest", "short", "e_host", "r_path", "one", "__wl_best")})
    out = urls.url_filter(clash, rules)
    assert out.columns == ["page_id", "url", "best", "digest", "short", "e_host", "r_path", "one", "__wl_best", "host", "path", "rule", "verdict"]
    assert all((r.best, r.one) == ("best", "one") and (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id] for r in out.collect())


def test_flac_round_trip_and_checksums(docs, empty):
    own = texts_of(docs)
    for r in media.described(docs).collect():
        b = own[r.doc_id].encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    stream = media.encode([media.padded(TEXTS[5].encode())])[0]
    assert stream[:4] == b"fLaC"
    for at in (len(stream) - 1, len(stream) // 2 + len(stream) // 4):
        bad = bytearray(stream)
        bad[at] ^= 1
        with pytest.raises((ValueError, IndexError)):
            media.decode([bytes(bad)])
    table = media.stored(docs.where("doc_id in (4, 5, 10)"))
    streams = {r.doc_id: bytes(r.media) for r in table.collect()}
    for k, data in streams.items():
        blocks = media.pcm_blocks(table.where(f"doc_id = {k}")).orderBy("block").collect()
        samples = (np.frombuffer(media.padded(own[k].encode()), np.uint8) - np.uint8(128)).tobytes()
        assert [r.sample_offset for r in blocks] == list(range(0, len(samples), flac.BLOCK))
        ends = [r.byte_offset for r in blocks[1:]] + [None]
        for r, end in zip(blocks, ends, strict=True):
            assert bytes(r.pcm) == samples[r.sample_offset : r.sample_offset + flac.BLOCK] == media.seek(data, r.byte_offset, end)
    nothing = table.sparkSession.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert media.decoded(nothing).first().blocks is None and media.pcm_blocks(nothing).count() == 0
    assert media.described(empty).count() == 0


def test_flac_reads_every_kind_of_frame():
    """Linear prediction with partitions, both parameter widths, escapes; fixed and verbatim kinds; and what is written."""
    rng = np.random.default_rng(4)
    wave = (60 * np.sin(np.arange(256) / 9) + rng.integers(-3, 4, 256)).astype(int)
    frames = []
    for order in (1, 2, 5, 8):
        taps = [700, -200, 60, -30, 20, 5, -4, 3][:order]
        for parts, method, escape in ((0, 0, None), (3, 0, None), (2, 1, None), (1, 0, 10), (2, 1, 9)):
            frames.append(flac.encode_lpc(wave.tolist(), 7, taps, 9, 3, 12, parts, method, escape))
    samples, sizes, numbers = flac.decode_frames(frames)
    assert (sizes == 256).all() and (numbers == 7).all() and (samples == wave[None, :]).all()
    bad = bytearray(frames[3])
    bad[20] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        flac.decode_frames([bytes(bad)])
    kinds = np.zeros((5, flac.BLOCK), np.int32)
    kinds[1] = np.arange(flac.BLOCK) % 100
    kinds[2] = rng.integers(-128, 128, flac.BLOCK)
    kinds[3] = 90 * np.sin(np.arange(flac.BLOCK) / 3)
    kinds[4] = 60 * np.sin(np.arange(flac.BLOCK) / 40)
    written = flac.encode_frames(kinds, np.array([1024, 1024, 1024, 1024, 64]), np.arange(5))
    samples, sizes, numbers = flac.decode_frames(written)
    kinds[4, 64:] = 0
    assert (samples == kinds).all() and sizes.tolist() == [1024] * 4 + [64] and numbers.tolist() == list(range(5))
    # Bits of the subframe headers: constant, and the linear predictor for the fast wave.
    assert written[0][5 + 1] >> 1 == 0 and written[3][5 + 1] >> 1 == 32 | (flac.LPC_ORDER - 1)


def test_packing_covers_every_id_once(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    unique = docs.dropDuplicates(["doc_id"])
    own = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for k, t in texts_of(unique).items()}
    got = packing.pack(unique).collect()
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(own[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(own[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for k, ids in own.items():
        at = 0
        for start, n in sorted(pieces[k]):
            assert start == at
            at += n
        assert at == len(ids)
    total = sum(map(len, own.values()))
    assert sorted(windows) == list(range(-(-total // 2048)))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pack(docs).agg({"length": "sum"}).first()[0] == total + 2  # the repeated row is a document of its own
    assert packing.pack(empty).count() == 0


def test_mixture_stays_on_target(spark):
    rows = [(k, "word " * (20 + k % 50), "big" if k % 3 else "small") for k in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(frame, packet=64).join(frame.select("doc_id", "source"), "doc_id").groupBy("sequence_id", "source").sum("length").collect()
    total = {s: sum(r[2] for r in got if r.source == s) for s in ("big", "small")}
    share, last = total["big"] / sum(total.values()), max(r.sequence_id for r in got)
    for r in got:
        if r.source == "big" and r.sequence_id < last:
            assert abs(r[2] / 2048 - share) < 0.1


def test_mixture_that_is_asked_for(spark):
    rows = [(k, "word " * 60, "a" if k < 300 else "b" if k < 600 else None) for k in range(700)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source string, share double")
    got = packing.pack(frame, window=512, packet=64, mixture=mixture).join(frame.select("doc_id", "source"), "doc_id")
    early = got.where("sequence_id < 20").groupBy("source").sum("length").collect()
    share = {r.source: r[1] for r in early}
    assert share["a"] / share["b"] == pytest.approx(3, rel=0.1) and share[None] / share["b"] == pytest.approx(1, rel=0.15)
    assert got.agg({"length": "sum"}).first()[0] == packing.pack(frame).agg({"length": "sum"}).first()[0]
    assert packing.pack(frame.where("false"), mixture=mixture).count() == 0


def test_packing_tokenizer_on_long_spaces_and_special_strings():
    from tokenizers import Tokenizer

    file = P.path("byte_bpe_50k.json")
    library, own, rng = Tokenizer.from_file(file), packing.Tokenizer(file), np.random.default_rng(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "🙂", "1", "23", ".", "<|endoftext|>", "'s", "\u00a0", "\u3000", "x" * 40, "Word"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(500)] + [" " * 50_000 + "a", "\n" * 70_000, "a " * 9 + " " * 20_000 + "x y"]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "simhash_near_dedup", "packing"]
    good, clean = quality.fit(docs, labels), None
    own = {(r.doc_id, r.text) for r in docs.collect() if good.score((r.text or "").encode()) >= 0.3}
    stage = corpus_pipeline.quality_stage(spark, docs, SF)
    assert stage.columns == docs.columns
    assert {(r.doc_id, r.text) for r in stage.collect()} == own
    clean = toxicity.fit(docs, labels)
    stage = corpus_pipeline.toxicity_stage(spark, docs, SF)
    assert {r.doc_id for r in stage.collect()} == {r.doc_id for r in docs.collect() if clean.score((r.text or "").encode()) < 0.3}
    kept = {r.doc_id: r.text or "" for r in corpus_pipeline.near_dedup_stage(spark, docs, SF).collect()}

    def shingles(t: str) -> set:
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = {k: shingles(t) for k, t in texts_of(docs).items()}
    ids = sorted(kept)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            assert len(sets[a] & sets[b]) < 0.8 * len(sets[a] | sets[b])
    for gone in set(sets) - set(kept):
        assert any(len(sets[gone] & sets[b]) >= 0.8 * len(sets[gone] | sets[b]) for b in sets if b != gone)
