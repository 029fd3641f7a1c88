"""Exact dedup: the filters' own promise, and the operator against a plain grouping of texts."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import exactdedup as X

SCHEMA = "doc_id long, text string, digest string, keep_id int"


def test_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 1000, 200_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        data = X.fuse_filter(np.concatenate((keys, keys[: n // 2])))
        assert X.may_hold(data, keys).all()
        others = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
        assert X.may_hold(data, others).mean() < 0.006
    assert len(data) < 1.2 * 200_000


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[ \t-\r]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), k == 0, sha) for k, i in enumerate(ids)]
    return out


def order(rows):
    return sorted(rows, key=str)


def corpus(seed, n=400):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 3))) for _ in range(60)] + ["long " * 30_000, "é x", "é x", " lead", "lead"]
    return [(i, rng.choice([rng.choice(texts), "hot text", rng.choice(texts).replace(" ", "\n \t"), None])) for i in rng.sample(range(-n, n), n)]


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_against_plain_grouping(spark, batches):
    rows = corpus(batches)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    assert order(map(tuple, X.deduplicate(docs, batches).collect())) == order(brute(rows))


def test_odd_ids(spark):
    rows = [(None, "a"), (1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c"), (3, "d"), (3, "e"), (0, "e")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert order(map(tuple, X.deduplicate(docs).collect())) == order(brute(rows))
    assert X.deduplicate(docs.limit(0)).collect() == []


def test_many_buckets_and_slices(spark, monkeypatch):
    """Small buckets: several for each snapshot, and batches that meet a filter in slices."""
    monkeypatch.setattr(X, "BUCKET_KEYS", 5)
    rows = [(i, f"t {i % 150}") for i in range(300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    first = F.when(F.col("row") < 8, 0).otherwise(1)  # the first batch is much smaller than the second
    assert order(map(tuple, X.deduplicate(docs, 2, first).collect())) == order(brute(rows))


def test_filters_screen_and_bytes_decide(spark):
    """A false positive of a filter finds no equal digest; equal digests with unlike texts (made here) are told apart by their bytes."""
    groups = spark.createDataFrame([(bytes([k]) * 32, (k, k), 1) for k in range(200)], "digest binary, first struct<row:long,id:long>, n long")
    old = X.snapshot(groups.where("n = 1 AND first.row < 100"))
    passed = {r["first"]["row"] for r in X.screened(groups, 200, old).collect()}
    assert passed >= set(range(100)) and len(passed) < 110
    texts = spark.createDataFrame([(1, "a  b"), (2, "a\nb"), (3, "a c")], "row long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "row long, of long")
    assert [tuple(r) for r in X.same_bytes(pairs, texts).select("row", "of").collect()] == [(1, 2)]
