"""Ranked lexical search and exact top lists against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreline.llm import exact_search, lexical_search
from loreline.llm.toplists import TopLists

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ranking(docs, items, k):
    counts = [Counter(TERM.findall(lowered(t))) for _, t in docs]
    n, total = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        asked, found = TERM.findall(lowered(text)), []
        for (i, _), c in zip(docs, counts, strict=True):
            m = 75 + 25 * sum(c.values()) * n // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ünd", "été", "你好", "a-b", "x_y", "A1"]
    docs = [(i, " ".join(draw.choices(words, k=draw.choice([0, 1, 5, 40, 300])))) for i in range(n)]
    same = " ".join(draw.choices(words, k=20))
    docs += [(n + i, same) for i in range(200)] + [(None, same), (None, None), (3, same + " END")]
    items = [(i, " ".join(draw.choices(words, k=draw.choice([1, 3, 12])))) for i in range(30)] + [(30, same), (30, same + " " + same), (None, "w1 w1 w2")]
    return docs, items


@pytest.mark.parametrize("k", [1, 20])
def test_ranked_search(spark, monkeypatch, k):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 64)
    monkeypatch.setattr(lexical_search, "TILE_ITEMS", 8)
    docs, items = corpus(1, 900)
    found = lexical_search.ranked_search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), k=k
    )
    assert sorted(map(tuple, found.collect()), key=str) == ranking(docs, items, k)


def block_of(docs):
    hashes = lexical_search.Hashes()
    found = [lexical_search.counted(t or "", hashes) for _, t in docs]
    sizes = np.array([tf.sum() for _, tf in found])

    class Block:
        id, known = np.array([i or 0 for i, _ in docs], "<i8").tobytes(), np.array([i is not None for i, _ in docs], "u1").tobytes()
        size, ends = sizes.astype("<i8").tobytes(), np.cumsum([len(h) for h, _ in found]).astype("<i8").tobytes()
        hash, tf = np.concatenate([h for h, _ in found]).astype("<u8").tobytes(), np.concatenate([t for _, t in found]).astype("<u4").tobytes()

    return Block, int((sizes > 0).sum()), int(sizes.sum()), hashes


def test_bounds_hold_and_scoring_stops_early():
    docs, items = corpus(2, 2000)
    block, n, total, hashes = block_of(docs)
    terms, df = np.unique(np.frombuffer(block.hash, "<u8"), return_counts=True)
    common = df > 20
    sketched = lexical_search.Sketched(block, n, total, (terms[common], lexical_search.weight(n, df[common])))
    for _, text in items:
        h, times = lexical_search.counted(text, hashes)
        h, times = h[np.isin(h, terms)], times[np.isin(h, terms)]
        single = lexical_search.weight(n, df[np.searchsorted(terms, h)])
        bounds = sum(t * sketched.bounds(h[i : i + 1], single[i : i + 1]) for i, t in enumerate(times))
        exact = sketched.exact(np.arange(len(docs)), h, single * times)
        assert (bounds >= exact).all()
        place, scores, done = lexical_search.search_block(sketched, h, single * times, single, 20, 0)
        assert sorted(scores.tolist())[-20:] == sorted(exact[exact > 0].tolist())[-20:]
        if len(h) > 8:
            assert done < len(docs) / 2


def test_search_of_rows_without_terms(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " .!")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, None)], "item_id long, text string")
    assert lexical_search.ranked_search(docs, items).collect() == []


# Exact top lists


def nearest(rows, asks, k, scale=64):
    whole = [(at, i, [math.floor(scale * x) for x in v]) for at, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(scale * x) for x in v)]
    out = []
    for at, i, v in whole:
        if asks(i):
            found = [(min(2**63 - 1, max(-(2**63), sum(x * y for x, y in zip(v, w, strict=True)))), j) for b, j, w in whole if b != at and len(v) == len(w)]
            found.sort(key=lambda f: (-f[0], f[1] is None, f[1] or 0))
            out += [(i, rank + 1, j, s) for rank, (s, j) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "k"), [(1.0, 20), (1e4, 3), (1e9, 20), (1e300, 5)])
def test_top_products(spark, monkeypatch, size, k):
    monkeypatch.setattr(exact_search, "SHARD_ROWS", 50)
    monkeypatch.setattr(exact_search, "TILE_ROWS", 7)
    draw = random.Random(size)
    rows = [(i, [draw.gauss(0, size) if draw.random() < 0.3 else draw.gauss(0, 1) for _ in range(6)]) for i in range(250)]
    rows += [(i % 90, [0.5] * 6) for i in range(120)] + [(2**60 + 1, [1.0] * 6), (None, [2.0] * 6), (20, [1.0]), (40, [2.0]), (60, []), (80, [])]
    rows += [(100, None), (120, [None] * 6), (140, [float("nan")] * 6), (160, [float("inf")] * 6), (180, [1e307] * 6)]
    found = exact_search.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=k)
    assert sorted(map(tuple, found.collect()), key=str) == nearest(rows, lambda i: i is not None and i % 20 == 0, k)


def test_lists_merge_in_any_order():
    draw = np.random.default_rng(3)
    whole, parts = TopLists(5), [TopLists(5) for _ in range(4)]
    for i in range(40):
        entry = {"owner": draw.integers(0, 3, 6), "score": draw.integers(-4, 4, 6), "id": np.arange(6) + 6 * i, "known": draw.integers(0, 2, 6)}
        whole.add(**entry)
        parts[i % 4].add(**entry)
    joined = TopLists(5)
    for part in reversed(parts):
        joined.add(**part.lists)
    assert all((joined.lists[n] == whole.lists[n]).all() for n in whole.lists)
