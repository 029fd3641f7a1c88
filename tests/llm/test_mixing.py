"""Cube mixing: targets against a plain loop, totals against targets, and the flight's own promises."""

import numpy as np
import pytest

from docloom.llm import mixing as M


def targets(sizes):
    """Reshare by weight until no source is above three times its size. sizes: name -> words."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    out, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in out]
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}


def test_flight():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 400):
        sizes, p = [float(x) for x in rng.integers(1, 1000, n)], [0.37] * n
        out = M.flight(sizes, p, np.random.default_rng(4))
        assert sum(0 < v < 1 for v in out) <= 2 and all(0 <= v <= 1 for v in out)
        assert sum(out) == pytest.approx(sum(p)) and np.dot(sizes, out) == pytest.approx(np.dot(sizes, p))
        assert all(v in (0, 1) for v in M.flight(sizes, p, np.random.default_rng(4), land=True))
    ends = [M.flight([3.0, 9.0, 4.0, 8.0], [0.25] * 4, np.random.default_rng(k), land=True) for k in range(3000)]
    assert np.mean(ends, 0) == pytest.approx([0.25] * 4, abs=0.03)


def test_targets_and_totals(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 40)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), str(rng.choice(["b", "a", "Z", "é", "tiny"], p=[0.5, 0.2, 0.1, 0.19, 0.01]))) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", "a"), (5002, "x y", None), (5003, "x \t y z", None), (None, "one", "b"), (None, "one", "b"), (9, "one two", "b"), (9, "one two", "b"), (5004, "", "empty")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, taken int").repartition(3)
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    by = {}
    for r in M.mix(docs).select("source_size", "target", "size", "taken", "doc_id").collect():
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        by.setdefault(r.source_size, [r.target, 0])[1] += r.taken
    for s, n in sizes.items():
        if list(sizes.values()).count(n) == 1:
            assert by[n][0] == pytest.approx(want[s]) and abs(by[n][1] - want[s]) <= 120
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, M.mix(docs).collect()), key=repr)
    one, two = (sorted(map(repr, M.mix(docs.repartition(n)).collect())) for n in (2, 7))
    assert one == two


def test_equal_rows_are_spread(spark, monkeypatch):
    """A third of all rows are one row: they fly in blocks like all others, and reruns agree however rows lie."""
    monkeypatch.setattr(M, "BLOCK", 50)
    monkeypatch.setattr(M, "RUN", 70)
    rows = [(1, "same text", "a")] * 500 + [(None, "no id", "a")] * 300 + [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(2, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = M.numbered(docs.selectExpr("doc_id", "source", "2L AS size", "xxhash64(text, doc_id) AS h"))
    assert sizes.count() == len(rows) == sizes.select("deal").distinct().count()
    one, two = (sorted(map(repr, M.mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert one == two and len(one) == len(rows)


def test_mixed_documents(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 3 == 0], "x", i) for i in range(60)]
    odd = [(3, "again here", "a", "x", 1), (None, "q r", "a", "x", 1), (70, None, "a", "x", 1)]
    schema = "doc_id long, text string, source string, lang string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    got, seen = M.mixed_documents(docs), {}
    assert got.columns == docs.columns
    for r in got.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {r.doc_id: r.copies for r in M.mix(docs).collect() if r.copies}
    more = M.mixed_documents(spark.createDataFrame(rows + odd, schema)).collect()
    assert {(r.doc_id, r.text) for r in more} <= {(i, t) for i, t, *_ in rows + odd if t}
    assert abs(sum(len(r.text.split()) for r in more) - sum(len((t or "").split()) for _, t, *_ in rows + odd)) <= 14


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(none).collect() == [] and M.mixed_documents(none).collect() == []
