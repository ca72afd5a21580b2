"""Operators that SQL can't express, against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from loreline.llm import common, exact_dedup, hnsw, lm_score, mixing, pii, sentencepiece, simhash, toxicity, warc
from loreline.llm.components import components
from loreline.llm.queries import QUERIES, piece_model

SF_DIR = "/root/testdata/sf0.001"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def linked(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


# SentencePiece


def test_pieces_as_the_library_gives_them(spark):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=piece_model())
    table = sentencepiece.pieces(piece_model())
    draw = random.Random(1)
    bits = [" ", "  ", "a", "e", "th", "the", "ing", "é", "▁", "\n", "0", "12", "的", "🦙", "##", "\x00", "<s>", "<0x41>", "x" * 30, " " * 17, "====="]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(3000)] + [t for _, t in documents(spark)]
    for t in texts:
        ids = model.encode(t)
        assert table.encode(t).tolist() == ids
        assert table.decode(np.array(ids, dtype=np.int32)) == model.decode(ids)
    for _ in range(2000):
        ids = [draw.choice([draw.randint(0, 260), draw.randint(0, 31999)]) for _ in range(draw.randint(0, 8))]
        assert table.decode(np.array(ids, dtype=np.int32)) == model.decode(ids)


def test_slow_pair_test_agrees():
    table = sentencepiece.pieces(piece_model())
    draw = random.Random(2)
    whole = sorted(table.right)
    for _ in range(3000):
        a, b = draw.choice(whole), draw.choice(whole)
        assert table.compatible(a, b) == (table.merged(a + b) == (a, b))


def test_piece_query(spark):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=piece_model())

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want = {(i, len(x := model.encode(t)), sha(",".join(map(str, x))), sha(model.decode(x))) for i, t in documents(spark)}
    assert {tuple(r) for r in QUERIES["op4_sentencepiece"](spark, SF_DIR).collect()} == want


def test_encode_and_decode_columns(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "text string")
    rows = df.select("text", sentencepiece.encode("text", piece_model()).alias("ids")).select("text", "ids", sentencepiece.decode("ids", piece_model()).alias("back")).collect()
    assert [(r.text or "") == r.back for r in rows] == [True] * 3


# SimHash


def plain_print(text, n, bits=64):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(bits) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_query(spark):
    prints = {i: plain_print(t, 3) for i, t in documents(spark)}
    ids = sorted(prints)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = linked(ids, pairs)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op9_simhash"](spark, SF_DIR).collect()}
    assert got == {(i, f"{prints[i]:016x}", root[i]) for i in ids}


@pytest.mark.parametrize(("bits", "radius"), [(64, 3), (256, 52)])
def test_tiles_lose_no_link(spark, monkeypatch, bits, radius):
    # Many tiles of few rows, chains of flipped bits among random fingerprints.
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    draw = random.Random(5)
    values = [draw.getrandbits(bits) for _ in range(150)]
    for _ in range(150):
        v = draw.choice(values)
        for b in draw.sample(range(bits), draw.randint(1, radius + 2)):
            v ^= 1 << b
        values.append(v)
    values = sorted(set(values))
    raw = [v.to_bytes(bits // 8, "big") for v in values]
    tiles = simhash.tile_of(simhash.unpacked(b"".join(raw), bits), bits == 64).tolist()
    prints = spark.createDataFrame([(bytearray(r), t) for r, t in zip(raw, tiles, strict=True)], "fp binary, tile int")
    got = {bytes(r.node): bytes(r.root) for r in components(simhash.links(prints, bits, radius)).collect()}
    pairs = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if (a ^ b).bit_count() <= radius]
    want = linked(values, pairs)
    assert {int.from_bytes(k, "big"): int.from_bytes(v, "big") for k, v in got.items()} == {v: want[v] for pair in pairs for v in pair}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1200), 1000)}


def test_one_row_of_each_group_stays(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 4, 30, 300])))) for i in range(120)]
    docs += [(1000 + i, " ".join(t.split()[:-1])) for i, t in docs] + [(7, docs[7][1])] * 3 + [(8, "another text for eight")]
    docs += [(None, docs[9][1]), (None, "no id and no copy here"), (500, None), (400, " "), (450, "")]
    rows = [(at, i, t) for at, (i, t) in enumerate(docs)]
    prints = [plain_print(t or "", 3) for _, _, t in rows]
    pairs = [(a, b) for b in range(len(rows)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 3]
    root = linked(range(len(rows)), pairs)
    groups = collections.defaultdict(list)
    for at, i, t in rows:
        groups[root[at]].append((i is None, i or 0, t))
    assert len(groups) < len(rows)
    want = collections.Counter((None if none else i) for none, i, _ in (min(g, key=lambda r: r[:2]) for g in groups.values()))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert collections.Counter(r.doc_id for r in simhash.without_near_copies(frame).collect()) == want


@pytest.mark.parametrize("rows", [1, 127, 128, 1000])
def test_runs_of_a_tile_lose_no_pair(rows):
    draw = random.Random(rows)
    base = [draw.getrandbits(64) for _ in range(rows)]
    other = [v ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 5))) for v in base]
    a, b = (b"".join(v.to_bytes(8, "big") for v in side) for side in (base, other))
    x, y = simhash.Sorted(a, 64), simhash.Sorted(b, 64)
    found = {(int(x.values[i, 0]), int(y.values[j, 0])) for u, v in simhash.near_pairs(x, y, 3) for i, j in zip(u, v, strict=True)}
    assert found == {(p, q) for p in base for q in other if (p ^ q).bit_count() <= 3}


# Exact duplicates


def test_golomb_round_trip():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 100, 5000):
        for top in (1 << 20, 1 << 63):
            values = np.unique(draw.integers(0, top, n).astype(np.uint64))
            assert np.array_equal(exact_dedup.golomb_decode(exact_dedup.golomb_encode(values)), values)
    wide = np.array([0, 1, 2**64 - 1], dtype=np.uint64)
    assert np.array_equal(exact_dedup.golomb_decode(exact_dedup.golomb_encode(wide)), wide)


def test_suspects_are_the_repeated_prints(spark):
    draw = random.Random(4)
    rows = [(draw.choice([draw.getrandbits(63) - 2**62, draw.randint(0, 50)]), draw.randint(0, 20)) for _ in range(2000)]
    want = {fp for fp, n in collections.Counter(fp for fp, _ in rows).items() if n > 1}
    got = exact_dedup.suspects(spark.createDataFrame(rows, "fp long, part int"), 5).collect()
    assert sorted(r.fp for r in got) == sorted(want)


# Mixing


def test_mix_keeps_to_targets_and_limits(spark):
    rows = [(i, "w " * (1 + i % 50), ["a", "b", "c", None][min(3, i % 7)]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = mixing.mix(docs).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert len(out) == 4000
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50
        assert own[0].target <= 3 * own[0].source_size + 1e-6
        assert len({r.taken // r.size for r in own}) <= 2
    again = mixing.mix(docs.repartition(3)).select("row.doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.taken) for r in out)


# Personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}
            if fits[kind]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans(spark):
    draw = random.Random(3)
    bits = ["a", "b.c", "@", "x@y.z", "a@b.c_d@e.f", ".", "..", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "0255.00001.1.1", "4111 1111 1111 1111", "41111111111111111", "+1 (415) 555-0100", "+1", "(", "é", "🦙", " ", "-", "_", "12", "  ", "9"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 12))) for _ in range(1500)]
    texts += ["", None, "1 " * 3000, "a@b" + ".c" * 3000, "1." * 2000, "+1" + "(" * 3000, *[t for _, t in documents(spark)]]
    got = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: [tuple(s) for s in r.base] for r in got} == {i: plain_spans(t) for i, t in enumerate(texts)}


def test_contexts_find_more(spark):
    seeds = [f"please mail me at user{i}@mail.org ok" for i in range(20)]
    texts = [*seeds, "please mail me at user@localhost today", "room 4b is at 12 degrees"]
    got = pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    more = {r.doc_id: [tuple(s) for s in r.more] for r in got if r.more}
    assert more == {20: [(18, 0, 32)]}


# Language-model scores


def plain_scores(texts, order, least):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = collections.Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))

    def s(gram):
        if len(gram) == 1:
            return np.log(counts[gram] / total)
        return np.log(counts[gram] / counts[gram[:-1]]) if counts[gram] >= least else np.log(0.4) + s(gram[1:])

    return [(len(w), sum(s(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w)))) for w in words]


@pytest.mark.parametrize(("order", "least"), [(3, 2), (1, 2), (2, 1), (4, 3)])
def test_scores(spark, order, least):
    draw = random.Random(order)
    texts = [" ".join(draw.choices("a b c d e f g".split(), k=draw.choice([0, 1, 2, 3, 30]))) for _ in range(80)] + [None, " ", "a\tb\n c", "a b " * 300]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    got = lm_score.lm_scores(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3), order=order, least_count=least)
    want = sorted((i is None, i or 0, n, round(s, 6)) for i, (n, s) in zip(ids, plain_scores(texts, order, least), strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, round(r.score, 6)) for r in got.collect()) == want


@pytest.mark.parametrize(("share", "least_share", "passes"), [(62, 62, 1), (4, 62, 3), (0, 0, 3)])
@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_scores_in_passes(spark, monkeypatch, order, share, least_share, passes):
    """From every n-gram frequent to none, with rows of one n-gram in several passes and tasks."""
    draw = random.Random(share)
    texts = [" ".join(draw.choices("the of a b c d e f g h i j k l".split(), [40, 20, *[1] * 12], k=draw.choice([0, 1, 2, 40]))) for _ in range(60)]
    texts += [None, "the", "the of", "the of " * 100, *["the of a b c d e f g h"] * 5]
    monkeypatch.setattr(lm_score, "SHARE", share)
    monkeypatch.setattr(lm_score, "LEAST_SHARE", least_share)
    monkeypatch.setattr(lm_score, "PASS_WORDS", 1 + sum(len((t or "").split()) for t in texts) // passes)
    monkeypatch.setattr(lm_score, "TASK_ROWS", 200)
    got = lm_score.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), order=order).collect()
    want = plain_scores(texts, order, 2)
    assert sorted((r.doc_id, r.n_words, round(r.score, 6)) for r in got) == [(i, n, round(s, 6)) for i, (n, s) in enumerate(want)]


def test_scores_hold_a_part_on_disk(spark, monkeypatch):
    """Each pass deals out its share of the rows, and common pairs of words don't meet in one task."""
    draw = random.Random(5)
    texts = [" ".join(["the of", *draw.choices([f"w{k}" for k in range(3000)], k=20)] * 2) for _ in range(400)]
    seen = []

    def watch(df, name):
        out = stored(df, name)
        seen.append((name.rsplit("-", 1)[0], df.sparkSession.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")))
        return out

    stored = lm_score.stored
    monkeypatch.setattr(lm_score, "stored", watch)
    monkeypatch.setattr(lm_score, "PASS_WORDS", 4000)
    dealt, rows = lm_score._dealt, []
    monkeypatch.setattr(lm_score, "_dealt", lambda *a: rows.append(dealt(*a)) or rows[-1])
    got = lm_score.lm_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert [(r.n_words, round(r.score, 6)) for r in sorted(got)] == [(n, round(s, 6)) for n, s in plain_scores(texts, 3, 2)]
    assert [name for name, _ in seen].count("lm-sums") == 4 and {on for name, on in seen if name == "lm-sums"} == {"true"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    counts = [df.count() for df, _ in rows]
    assert sum(counts) < 2.2 * 44 * 400 and max(counts) < 0.5 * sum(counts)
    largest = max(df.groupBy(key.alias("k")).count().agg({"count": "max"}).first()[0] for df, key in rows)
    assert largest < 400



# WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a\r\nb c", "<p>x"), (2, None, "<p>x"), (3, "y", None), (4, "z", "é" * 300_000), (4, "z", "é" * 300_000), (9, "z", "é" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = warc.write_warc(pages, f"file://{tmp_path}/warc")
    got = {(r.page, r.record_type, r.refers_to, r.payload) for r in warc.read_warc(manifest).collect()}
    assert got == {("1", "revisit", "2", None), ("2", "response", None, "<p>x"), ("3", "response", None, ""), ("4", "revisit", "9", None), ("9", "response", None, "é" * 300_000)}
    assert manifest.agg({"records": "sum"}).first()[0] == 6


def test_warc_damage_is_seen(tmp_path):
    import io

    record = warc.member("1", "http://a", "2024-01-01T00:00:00Z", b"payload", None)
    assert [r["payload"] for r in warc.records(io.BytesIO(record + record))] == [b"payload"] * 2
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.records(io.BytesIO(record[:-20])))


# Vectors


def test_near_vectors(spark):
    draw = np.random.default_rng(1)
    center = draw.normal(size=16)
    rows = [(i, draw.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, (center + draw.normal(size=16) * 0.1).astype(np.float32).tolist()) for i in range(200)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    v = np.array([np.array(x, dtype=np.float32) for _, x in rows], dtype=np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    root = linked(ids, [(ids[a], ids[b]) for a, b in np.argwhere(near)])
    found = sum(n for n, _, _ in got.values())
    assert found >= 0.98 * near.sum()
    assert all(got[i][0] <= k for i, k in zip(ids, near.sum(axis=1), strict=True))
    assert {i: c for i, (_, c, _) in got.items()} == root


def test_lost_pairs_are_seen_beside_a_large_group(monkeypatch):
    draw = np.random.default_rng(2)
    center = draw.normal(size=24)
    large = center + draw.normal(size=(400, 24)) * 0.02
    twins = np.repeat(draw.normal(size=(400, 24)), 2, axis=0)
    twins[1::2] += draw.normal(size=(400, 24)) * 0.01
    v = np.concatenate([large, twins])
    u = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph, plain = hnsw.Graph.build(u), hnsw.Graph.within

    def lossy(self, q, least, first):
        for r, c in plain(self, q, least, first):
            if first == hnsw.FIRST_BEAM:
                # Twins lose each other and keep themselves.
                keep = (c < 400) | (np.abs((q[r] * self.x[c]).sum(axis=1) - 1) < 1e-6)
                r, c = r[keep], c[keep]
            yield r, c

    monkeypatch.setattr(hnsw.Graph, "within", lossy)
    found = {pair for r, c in graph.audited(u, 0.95, np.arange(len(u))) for pair in zip(r.tolist(), c.tolist(), strict=True)}
    assert np.mean([(i, i ^ 1) in found for i in range(400, 1200)]) >= 0.98


def test_a_dense_group_takes_little_memory(monkeypatch):
    import tracemalloc

    draw = np.random.default_rng(6)
    v = draw.normal(size=(1, 64)) + draw.normal(size=(4000, 64)) * 0.02
    graph = hnsw.Graph.build((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32))
    monkeypatch.setattr(hnsw, "SEEN_CELLS", 1 << 20)

    class Pair:
        width, nodes, copies = 64, np.arange(4000, dtype="<i8").tobytes(), np.ones(4000, "<i8").tobytes()
        vectors = q_vectors = v.astype("<f8").tobytes()
        q_nodes = nodes

    tracemalloc.start()
    out = hnsw._linked(graph, Pair, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All 16 million pairs at once would take 256 MB as places alone.
    assert peak < 150e6
    assert out[out["links"] > 0]["links"].tolist() == [3999] * 4000 and out["other"].notna().sum() == 3999


def test_wide_vectors(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 400_000)
    monkeypatch.setattr(hnsw, "SLICE_BYTES", 200_000)
    draw = np.random.default_rng(7)
    v = draw.normal(size=(120, 1536))
    v[60:] = v[:60] + draw.normal(size=(60, 1536)) * 0.05
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, [1.0, 2.0]), (501, [1.0, 2.001])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (1, i % 60) for i in range(120)} | {500: (1, 500), 501: (1, 500)}


def test_a_shard_goes_in_small_rows_and_comes_back_whole():
    draw = np.random.default_rng(8)
    v = draw.normal(size=(3000, 64)).astype("<f4")
    v[1::2] = v[::2] + draw.normal(size=(1500, 64)).astype("<f4") * 0.02
    rows = pd.DataFrame({"width": 64, "shard": 3, "turn": draw.permutation(3000), "node": np.arange(3000) + 7, "copies": 1, "vector": [x.tobytes() for x in v]})
    frames = list(hnsw._build(iter([rows[:1000], rows[1000:]])))
    made = pd.concat(frames)
    sizes = [sum(len(x) for x in frame["data"] if x is not None) for frame in frames]
    assert made["data"].dropna().map(len).max() <= hnsw.PIECE_BYTES and max(sizes) <= hnsw.PIECES * hnsw.PIECE_BYTES
    # In all little more than vectors, links of the ground level, node and copies: no second copy of the vectors.
    assert 1.05 * v.nbytes < sum(sizes) < 3000 * (64 * 4 + 24 * 4 + 16) * 1.1
    assert made["part"].isna().tolist() == [False] * (len(made) - 1) + [True]

    asked = [hnsw._slice(rows[i : i + 1500]).iloc[0] for i in (0, 1500)]
    plain = made[:-1].assign(q_nodes=None, q_vectors=None)
    ends = pd.concat([made[-1:].assign(q_nodes=[x.q_nodes], q_vectors=[x.q_vectors]) for x in asked])
    found = pd.concat(hnsw._search(0.95)(iter([plain[:5], plain[5:], ends])))
    links = found.groupby("node")["links"].sum()
    assert (links > 0).sum() >= 0.98 * 3000 and links.max() == 1
    assert all(((r.node - 7) ^ 1) == r.other - 7 for r in found[found["other"].notna()].itertuples())
    for broken in (plain[:-1], pd.concat([plain, plain[:1]])):
        with pytest.raises(RuntimeError, match="whole"):
            list(hnsw._search(0.95)(iter([broken, ends])))


def test_graphs_of_wide_vectors_take_little_memory():
    import tracemalloc

    draw = np.random.default_rng(9)
    x = draw.normal(size=(1500, 1024)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    graph = hnsw.Graph.build(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # What 512 nodes meet in one step would take 200 MB.
    assert peak < 100e6
    assert all(len(table) == (graph.level > 0).sum() for table in graph.near[1:])


def test_shards_of_several_rows_meet_slices_of_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SLICE_BYTES", 400_000)
    draw = np.random.default_rng(10)
    v = draw.normal(size=(300, 2048)).astype(np.float32)
    v[150:] = v[:150] + draw.normal(size=(150, 2048)).astype(np.float32) * 0.05
    assert v.nbytes / hnsw.LEAST_SHARDS > 2 * hnsw.PIECE_BYTES
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, [1.0, 2.0]), (501, [1.0, 2.001]), (502, [])]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600k")
    try:
        got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {i: (1, i % 150) for i in range(300)} | {500: (1, 500), 501: (1, 500), 502: (0, 502)}


# Toxicity


def test_toxic_words_are_learned_from_the_training_fold(spark):
    draw = random.Random(7)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(600):
        toxic = i % 6 == 0
        text = [draw.choice(words) for _ in range(40)] + ([f"zorgu{draw.choice('abcdef')}" for _ in range(3)] if toxic else [])
        draw.shuffle(text)
        rows.append((i, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows if out[r[0]].held_out]
    assert 60 < len(held) < 180
    assert sum(out[i].predicted == y for i, _, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    unseen = labels.where(~toxicity.is_held_out("doc_id"))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, unseen).collect()}
    assert again == {i: r.score for i, r in out.items()}


# Memory of a worker


def test_counted_words_are_passed_on_in_pieces():
    texts = [" ".join(f"{'xyz'[i % 3]}{i + k}" for i in range(9000)) for k in (0, 4000, 50_000)]
    batches = [pd.DataFrame({"text": texts, "toxic": [0, 1, 1]})]
    found = list(toxicity._count_words(iter(batches)))
    assert max(map(len, found)) <= 10_000
    got = pd.concat(found).groupby("word")[["clean", "toxic"]].sum()
    want = [collections.Counter(toxicity.marks_of(texts[0])), collections.Counter(m for t in texts[1:] for m in toxicity.marks_of(t))]
    assert {w: (c, t) for w, c, t in got.itertuples()} == {w: (want[0][w], want[1][w]) for w in want[0] | want[1]}


def test_toxic_words_are_learned_by_ids_of_any_type(spark):
    rows = [(f"d{i}", f"plain words here {'zorgua' if i % 5 == 0 else 'calm'}", int(i % 5 == 0)) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id string, toxic int")
    learned = dict(toxicity.learn_words(docs, toxicity.training_labels(labels), 1000))
    assert b"zorgua " in learned and b"calm " not in learned


def test_kept_chunks_are_bounded():
    import sentencepiece as library

    table = sentencepiece.PieceTable(piece_model())
    model = library.SentencePieceProcessor(model_file=piece_model())
    for gap in (" ", "  "):
        texts = [gap.join(f"w{i}" for i in range(k, k + 20_000)) for k in range(0, 240_000, 20_000)]
        for t in texts:
            assert table.encode(t).tolist() == model.encode(t)
    assert max(len(table.words), len(table.known)) <= 200_000


def test_batches_are_bounded_in_bytes(spark):
    common.table(spark, SF_DIR, "documents")

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"bytes": [int(batch["text"].str.len().sum())]})

    wide = spark.range(0, 200, 1, 1).select(F.concat(F.repeat(F.lit("x"), 1 << 17), F.col("id").cast("string")).alias("text"))
    found = [r.bytes for r in wide.mapInPandas(sizes, "bytes long").collect()]
    assert sum(found) > 200 << 17
    assert max(found) <= 5 << 20
