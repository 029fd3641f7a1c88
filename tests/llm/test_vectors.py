"""Sorted projection passes against all pairs: no false link, and nearly all true ones."""

import numpy as np

from docloom.llm import vectors as V


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    up = {i: i for i, _ in rows if i is not None}
    links = {i: 0 for i, _ in rows if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, v) in enumerate(ok):
        for j, w in ok[:n]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows if i is not None}


def rows_of(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(150):
        base = rng.standard_normal(32)
        rows.append(base)
        for _ in range(int(rng.choice((0, 0, 1, 3, 60), p=(0.4, 0.3, 0.2, 0.08, 0.02)))):
            rows.append(base + rng.standard_normal(32) * rng.choice((0.05, 0.15, 0.25)))
    return [(int(i) + 10, [float(x) for x in v]) for i, v in enumerate(rows)]


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_against_all_pairs(spark):
    rows = rows_of(2)
    rows += [(1, None), (2, []), (3, [0.0] * 32), (4, [float("nan")] * 32), (5, [None] * 32), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, rows[0][1]), (9, rows[0][1])]
    got = result(V.near_vectors(spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<double>, node int")))
    want = brute(rows)
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * there
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False) and got[1] == (0, 1, True)


def test_exact_step_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, [float(x) for x in base + rng.standard_normal(16) * rng.choice((0.02, 0.1, 0.2))]) for i in range(120)]
    got = result(V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    want = brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows])
    assert sum(got[i] != want[i] for i in want) <= 2


def test_near_copies_of_one_vector_are_never_compared(spark, monkeypatch):
    """Work follows the rows: a cluster twice as large makes about twice as many rows of pairs and none of the exact step."""
    rng = np.random.default_rng(6)
    base, made = rng.standard_normal(64), []
    chosen = V.window_pairs
    monkeypatch.setattr(V, "window_pairs", lambda *x: made.append(chosen(*x)) or made[-1])
    for n in (300, 600):
        rows = [(i, [float(x) for x in base + rng.standard_normal(64) * 0.1]) for i in range(n)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert set(result(V.near_vectors(df)).values()) == {(n - 1, 0, True), (n - 1, 0, False)}
        nodes = V.raw_vectors(df, "vec_id", "embedding").selectExpr("vec_id AS node", "dim", "raw", "1L AS copies")
        roots = spark.createDataFrame([(i, 0) for i in range(n)], "node long, root long")
        assert V.cluster_links(nodes, roots, 0.95).where(f"links <> {n - 1}").count() == 0
    assert made[1].count() <= 2.2 * made[0].count() <= 2.2 * 300


def test_null_id_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert result(V.near_vectors(df)) == {None: (0, None, None), 3: (0, 3, True)}
    assert result(V.near_vectors(df.limit(0))) == {}


def test_recall_at_the_threshold_as_rows_outgrow_the_window(spark):
    """Isolated planted pairs just above the threshold; a window of 2 in 6,000 rows is as 32 in 96,000."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((3000, 64))
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.951 * base + np.sqrt(1 - 0.951**2) * side
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate((base, near)))]
    got = result(V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), window=2))
    found = sum(got[i + 3000] == (1, i, False) for i in range(3000))
    assert found >= 0.99 * 3000
