"""Phrase mining against plain counting of all runs of words."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docloom.llm import phrases as P

SCHEMA = "text string, lang string, phrase string, n int"


def brute(rows, least, top):
    counts = defaultdict(Counter)
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(w)):
                for d in range(1, 6):
                    if i + d <= len(w):
                        counts[lang or "und"][tuple(w[i : i + d])] += 1
    out = []
    for lang, f in counts.items():
        n, found = sum(v for p, v in f.items() if len(p) == 1), []
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = {(p[i : i + e], a) for p, a in frequent.items() for e in range(2, len(p)) for i in range(len(p) - e + 1)}
        for p, a in frequent.items():
            if (p, a) not in inner:
                score, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus(seed, n=500):
    rng = random.Random(seed)
    words = ["a", "b", "c", "The", "x-y", "é", "日本", "it's"]
    out = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ", ", "\n"]) for _ in range(rng.randint(0, 25))), rng.choice(["en", "en", "de", None, "und"])) for _ in range(n)]
    return out + [("one very common passage of many words", "en")] * 120 + [(None, "en"), ("", None), ("a b " * 20_000, "de"), ("   ...", "fr"), ("lone words only", "es")]


@pytest.mark.parametrize("mode", ["plain", "many ranges", "hashes"])
def test_against_plain_counts(spark, monkeypatch, mode):
    """Many ranges: of a few suffixes each, and suffixes that end several; hashes: as with more words than may
    be sent."""
    if mode != "plain":
        monkeypatch.setattr(P, "RANGE", 60)
        monkeypatch.setattr(P, "GATHERED", 300)
        monkeypatch.setattr(P, "WORDS_HELD", 5)
        monkeypatch.setattr(P, "PIECE", 1000)
    if mode == "hashes":
        monkeypatch.setattr(P, "VOCABULARY", 0)
    rows = corpus(len(mode))
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, P.collocations(docs, 30, 40).collect()))
    assert got == brute(rows, 30, 40)


def test_empty(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_quicksort_and_edges():
    rng = np.random.default_rng(5)
    for _ in range(60):
        rows = rng.integers(0, 4, (int(rng.integers(1, 400)), P.DEPTH)).astype(np.uint32)
        rows[np.cumsum(rows == 0, axis=1) > 0] = 0
        rows = rows[rows[:, 1] > 0]
        n, least = rng.integers(1, 5, len(rows)), int(rng.integers(1, 30))
        want = Counter()
        for r, k in zip(rows.tolist(), n.tolist(), strict=True):
            for d in range(2, P.DEPTH + 1):
                if r[d - 1]:
                    want[tuple(r[:d])] += k
        found, a = P.counts_in_range(rows, n, least)
        got = {tuple(x for x in r if x): k for r, k in zip(found.tolist(), a.tolist(), strict=True)}
        ends = {tuple(r[:d]) for r in (min(rows.tolist()), max(rows.tolist())) for d in range(2, P.DEPTH + 1) if r[d - 1]} if len(rows) else set()
        assert got == {p: k for p, k in want.items() if k >= least or p in ends}


def test_counted_survives_equal_hashes(monkeypatch):
    rows = np.array([[1, 2, 0, 0, 0], [1, 3, 0, 0, 0], [1, 2, 0, 0, 0]], np.uint32)
    monkeypatch.setattr(P.textkit, "mix", lambda h: np.zeros_like(h))
    found, n = P.counted(rows, np.ones(3))
    assert {tuple(r): k for r, k in zip(found.tolist(), n.tolist(), strict=True)} == {(1, 2, 0, 0, 0): 2, (1, 3, 0, 0, 0): 1}


def test_scores_beyond_64_bits(spark):
    """1000 * a * n is over 2^63 in the same expression that scores phrases."""
    got = spark.sql(f"SELECT {P.SCORE} AS s FROM VALUES (5000000000000L, 90000000000000L, 6000000000000L, 7000000000000L) AS t(a, n, l, r)").first().s
    assert got == 1000 * 5000000000000 * 90000000000000 // (6000000000000 * 7000000000000)
