"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are runs of letters, digits and non-ASCII bytes, and runs of other marks ("%%%" is a token, as is
"."); A-Z fold to a-z. Features are the hashes, modulo 2^18, of single tokens and of pairs of neighbours,
and one feature for a token that repeats the one before it. A text is the vector of its features' counts
over its number of tokens, so length doesn't weigh. A score is a sparse dot product; whole texts are
hashed in numpy passes, and weights are looked up and added without a loop over words.

The model is fitted on at most `TRAIN_ROWS` labelled rows, those with the least hash of their id, in that
order; their features are collected (a bounded sample, a documented parameter), all else runs on all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.shared import residue, table

BUCKETS = 1 << 18
TRAIN_ROWS = 8000
EPOCHS = 3
#: FTRL-proximal: learning rate, its smoothing, and the two regularisers.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.002, 0.001
THRESHOLD = 0.3
_U = np.uint64


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature of every token and pair, offsets of each text in them)."""
    word, w_off, w_at, _ = textkit.word_hashes(buf, off, textkit.MARKS)
    mark, m_off, m_at, _ = textkit.word_hashes(buf, off, _NO_MARK)
    at = np.concatenate((w_at, m_at))
    order = np.argsort(at, kind="stable")
    h, at = np.concatenate((word, mark))[order], at[order]
    t_off = w_off + m_off
    text = np.repeat(np.arange(len(off) - 1), np.diff(t_off))
    pair = textkit.mix(h[:-1] * _U(3) + h[1:] * _U(0x9E3779B97F4A7C15)) if len(h) else h
    if len(h):
        pair[h[:-1] == h[1:]] = _U(1)
        pair = pair[text[:-1] == text[1:]]
    p_off = t_off - np.minimum(np.arange(len(t_off)), np.cumsum(np.concatenate(([0], np.diff(t_off) > 0))))
    features = np.empty(len(h) + len(pair), np.int64)
    f_off = t_off + p_off
    spot = np.arange(len(h)) + np.repeat(p_off[:-1], np.diff(t_off))
    features[spot] = (h % _U(BUCKETS)).astype(np.int64)
    rest = np.ones(len(features), bool)
    rest[spot] = False
    features[rest] = (pair % _U(BUCKETS)).astype(np.int64)
    return features, f_off


_NO_MARK = ~(textkit.MARKS & ~textkit.SPACES)


def samples(docs: DataFrame) -> DataFrame:
    """doc_id, label, feature (binary int32), share (binary float32) of labelled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, shares = [], []
            for _, _, buf, off in textkit.pieces(batch.column(2)):
                f, at = tokens(buf, off)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    x, n = np.unique(f[a:b], return_counts=True)
                    features.append(x.astype(np.int32).tobytes())
                    shares.append((n / max(1, b - a)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(features, pa.binary()), pa.array(shares, pa.binary())], ["doc_id", "label", "feature", "share"])

    return docs.mapInArrow(run, "doc_id long, label int, feature binary, share binary")


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights (the last is the bias). A doc_id with several labels has the largest; null labels and ids are left out."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (residue("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")  # at most TRAIN_ROWS ids
    got = sorted(samples(chosen).collect(), key=lambda r: (hash_order(r.doc_id), r.doc_id))
    model = Ftrl()
    data = [(np.append(np.frombuffer(r.feature, np.int32), BUCKETS), np.append(np.frombuffer(r.share, np.float32), 0.2) * 5.0, r.label) for r in got]
    for _ in range(EPOCHS):
        for at, x, y in data:
            model.learn(at, x, y)
    return model.weights().astype(np.float32)


def hash_order(i: int) -> int:
    return int(textkit.mix(np.array([i], np.int64).astype(_U))[0])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value.astype(np.float64)
        for batch in batches:
            out = []
            for _, _, buf, off in textkit.pieces(batch.column(1)):
                f, at = tokens(buf, off)
                total = np.concatenate(([0.0], np.cumsum(w[f])))
                n = np.diff(at)
                out.append(w[-1] + 5.0 * (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1))
            s = 1 / (1 + np.exp(-np.clip(np.concatenate(out), -35, 35))) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(s, 9))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Null and empty texts score the bias alone. A null id counts as not held out. Without any usable label all
    weights are zero and every score is 0.5. Repeated rows are each scored. Columns other than doc_id and text
    (of labels: doc_id and quality) are not looked at.
    """
    scored = score(docs, fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality")))
    return scored.select("doc_id", F.coalesce(residue("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLES: dict[str, str] = {}
