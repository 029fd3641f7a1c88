"""Quality classifier: features against a plain tokeniser, held-out accuracy, and odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa

from docloom.llm import quality as Q
from docloom.llm import textkit


def test_features_count_tokens_and_pairs():
    texts = ["", "One two, two!! two", None, "é%%% é%%%", "a b c d e f", "g g g"]
    buf_off = list(textkit.pieces(pa.array(texts)))
    assert len(buf_off) == 1
    f, at = Q.tokens(*buf_off[0][2:])
    names = {}
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]+", (t or "").lower())
        want = Counter(words) + Counter("same" if x == y else (x, y) for x, y in zip(words, words[1:], strict=False))
        got = Counter(f[a:b].tolist())
        assert sorted(got.values()) == sorted(want.values())
        for k, n in Counter(words).items():
            names.setdefault(k, set()).update(i for i, m in got.items() if m == n)
    assert names["é"] and 1 in f  # a repeated token has a feature of its own


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.quality_scores(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.95
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (2, "", "y"), (3, "long " * 50000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 0)], "doc_id long, quality int")
    rows = Q.quality_scores(docs, labels).collect()
    assert len(rows) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert Q.quality_scores(docs.limit(0), labels.limit(0)).collect() == []


def test_ftrl_against_a_plain_loop():
    """Weights after some examples, and the score of a text, by dictionaries and the published update."""
    import math
    import random

    rng = random.Random(2)
    data = [(sorted(rng.sample(range(60), rng.randint(1, 8))), rng.randint(0, 1)) for _ in range(300)]
    data = [(at, [rng.uniform(0.1, 2) for _ in at], y) for at, y in data]
    model, z, n = Q.Ftrl(), {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= Q.L1:
            return 0.0
        return -(z[i] - math.copysign(Q.L1, z[i])) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    for at, x, y in data:
        model.learn(np.array(at), np.array(x), y)
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
        for i, wi, xi in zip(at, w, x, strict=True):
            g = (p - y) * xi
            before = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / Q.ALPHA * wi
            n[i] = before + g * g
    assert np.allclose(model.weights(np.arange(60)), [weight(i) if i in z else 0.0 for i in range(60)], atol=1e-12)


def test_scores_against_a_plain_sum(spark):
    """A score is the bias and the mean weight of a text's features, five times, through the logistic function."""
    rng = np.random.default_rng(4)
    weights = rng.normal(0, 1, Q.BUCKETS + 1).astype(np.float32)
    texts = ["one two two three.", "%%% a b a b", "", None, "é ü " * 500]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in Q.score(docs, weights).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        features, at = Q.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        mean = sum(float(weights[f]) for f in features) / max(1, len(features))
        assert abs(got[k] - 1 / (1 + np.exp(-(float(weights[-1]) + 5 * mean)))) < 1e-6
