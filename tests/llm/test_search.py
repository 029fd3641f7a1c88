"""Ranked search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from docloom.llm import search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string, item int", "item_id long, text string, rank string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    N, L = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, b, n in bags:
            m = 75 + 25 * n * N // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return out


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [chr(97 + k // 26) + chr(97 + k % 26) for k in range(80)] + ["Über", "naïve", "X9"]
    draw = lambda m: " ".join(words[min(len(words) - 1, int(rng.expovariate(0.08)))] for _ in range(m))
    docs = [(i, draw(rng.choice((0, 1, 3, 8, 30)))) for i in range(n)]
    docs += [(n + k, docs[k % 7][1]) for k in range(60)]  # ties
    items = [(k, draw(rng.choice((1, 4, 12)))) for k in range(12)] + [(50, "zz-unknown"), (51, "")]
    return docs, items


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*q, "x") for q in items], ITEMS)


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_against_all(spark, monkeypatch, seed, small):
    """Small: many segments, queries in several blocks, one posting a step."""
    if small:
        for name, value in (("SEGMENT_DOCS", 20), ("BLOCK_CHARS", 100), ("STEP", 1)):
            monkeypatch.setattr(S, name, value)
    docs, items = corpus(seed)
    got = rows(S.search(*frames(spark, docs, items), k=5))
    assert got == sorted(brute(docs, items, 5), key=str)


def test_nra_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size, k, lists, total = int(rng.integers(1, 300)), int(rng.integers(1, 8)), [], None
        total = np.zeros(size, np.int64)
        for _ in range(rng.integers(1, 7)):
            docs = rng.permutation(size)[: rng.integers(0, size + 1)]
            gains = np.sort(rng.integers(1, 6, len(docs)))[::-1]
            total[docs] += gains
            lists.append((docs, gains))
        floor = int(rng.integers(0, 8))
        docs, scores = S.nra(lists, size, k, floor)
        assert (total[docs] == scores).all()
        best = max(1, floor, np.sort(total)[-k] if size >= k else 0)
        assert sorted(docs.tolist()) == np.flatnonzero(total >= best).tolist()


def test_odd_rows(spark):
    docs = [(None, "one two"), (1, "one two"), (1, "one two"), (2, None), (3, ""), (4, "..."), (None, "one"), (5, "one " * 40_000 + "two"), (6, "ONE two é")]
    items = [(None, "one two one"), (7, None), (8, "one"), (8, "two"), (9, "one two one")]
    got = rows(S.search(*frames(spark, docs, items)))
    assert got == sorted(brute(docs, items, 20), key=str)
    d, i = frames(spark, docs, items)
    assert S.search(d.limit(0), i).collect() == S.search(d, i.limit(0)).collect() == []


def test_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert rows(S.op11_nra_search(spark, sf)) == sorted(brute(docs, items, 20), key=str)
