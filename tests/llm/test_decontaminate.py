"""Spaced-seed decontamination against brute force over all windows of all documents and items."""

import itertools
import random
import re
from collections import Counter

import numpy as np

from docloom.llm import decontaminate as D
from docloom.llm import textkit

VOCABULARY = [f"w{i}" for i in range(3000)]


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    """(doc, item) for every pair of rows with an aligned stretch of at least 13 words (or the whole item) of which four in five agree. Masks have no part in it."""
    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            for shift in range(-len(v) + 1, len(w)) if v else ():
                a, b = max(0, shift), min(len(w), shift + len(v))
                same = [w[x] == v[x - shift] for x in range(a, b)]
                n = len(same)
                if any(same[x] and same[y - 1] and sum(same[x:y]) * 5 >= (y - x) * 4 for x in range(n) for y in range(x + min(D.LEAST, len(v)), n + 1)):
                    out.append((d, i))
                    break
    return Counter(out)


def case(seed):
    rng = random.Random(seed)
    pick = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [(k, " ".join(pick(rng.choice((3, 8, 15, 40, 59))))) for k in range(25)]
    docs = []
    for k in range(80):
        w = pick(rng.randrange(0, 80))
        if rng.random() < 0.7:
            v = items[rng.randrange(25)][1].split()
            a = rng.randrange(len(v))
            part = v if rng.random() < 0.6 else v[a:]
            part = [rng.choice(VOCABULARY) if rng.random() < rng.choice((0, 0.05, 0.15, 0.3)) else x.upper() + rng.choice(("", ",", "!")) for x in part]
            at = rng.randrange(len(w) + 1)
            w = w[:at] + part + w[at:]
        docs.append((k, " ".join(w)))
    return docs, items


def both_ways(docs, items):
    """All rows found, sorted; sending the tests and joining them must agree row for row."""
    rows = D.contaminated(docs, items).collect()
    sent, D.SENT = D.SENT, -1
    try:
        joined = D.contaminated(docs, items).collect()
    finally:
        D.SENT = sent
    order = lambda r: [(x is not None, x) for x in r]
    assert sorted(rows, key=order) == sorted(joined, key=order)
    return rows


def test_against_brute_force(spark):
    docs, items = case(4)
    rows = [*docs, (900, None), (901, ""), (None, items[3][1]), (902, items[3][1]), (902, items[3][1]), (902, items[4][1])]
    # Item ids that repeat with other texts and with the same one, a null id, null and empty texts.
    items += [(3, items[9][1]), (3, items[3][1]), (None, items[4][1]), (77, None), (78, ""), (79, ". !")]
    left = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, item_id int").repartition(3)
    right = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, test int").repartition(2)
    want = brute(rows, items)
    assert Counter((r.doc_id, r.item_id) for r in both_ways(left, right)) == want and len(want) > 20


def test_repeated_ids_lose_nothing(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(20)) for x in "ab")
    docs = spark.createDataFrame([(10, a), (11, b), (12, a), (12, a)], "doc_id long, text string")
    items = spark.createDataFrame([(1, a), (1, b)], "item_id long, text string")
    assert sorted(r.doc_id for r in both_ways(docs, items)) == [10, 11, 12, 12]
    assert D.clean(docs, items).collect() == []


def test_very_long_text(spark):
    item = " ".join(f"i{k}" for k in range(30))
    text = "filler " * 300_000 + item + " filler" * 300_000
    docs = spark.createDataFrame([(1, text), (2, "filler " * 400_000)], "doc_id long, text string")
    assert [tuple(r) for r in both_ways(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))] == [(1, 7, 300_000, 30, 30)]


def test_every_single_substitution_is_found(spark):
    item = [f"t{i}" for i in range(15)]
    docs = [(k, " ".join(["x", *item[:k], "other", *item[k + 1 :], "y"])) for k in range(15)]
    got = both_ways(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id for r in got} == set(range(15))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.contaminated(none, items).collect() == []
    assert D.contaminated(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), items.limit(0)).collect() == []


def passages(n):
    """Every placing of as many substitutions as a passage of n words may have, its ends agreeing."""
    for gone in itertools.combinations(range(1, n - 1), n // 5):
        yield [k not in gone for k in range(n)]


def test_masks_lose_no_passage():
    for n in range(D.SPAN, 22):
        for same in passages(n):
            assert any(all(same[x + j] for j, c in enumerate(m) if c == "1") for m in D.MASKS for x in range(n - len(m) + 1)), same
    assert D.SPAN // 5 <= 1 and (D.SPAN - 1) // 5 == 0


def test_every_placing_of_allowed_substitutions_is_found(spark):
    docs, items, want = [], [], set()
    for n in (5, 8, 12, 13, 15, 16):
        item = [f"t{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for same in passages(n):
            docs.append((len(docs), " ".join(["x", *(w if s else "other" for w, s in zip(item, same, strict=True)), "y"])))
            want.add((len(docs) - 1, n, 1, n, n - n // 5))
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in both_ways(left, right)} == want


def test_diagonals_against_all_meetings():
    """Runs that meet runs give the diagonals that single meetings give, each once and in order."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        items = {int(i): textkit.mix(rng.integers(0, 3, int(rng.integers(1, 30))).astype(np.uint64)) for i in rng.choice(50, 4, replace=False)}
        tests = D.Tests(items)
        lengths = rng.integers(0, 40, 5)
        woff = np.concatenate(([0], np.cumsum(lengths)))
        h = textkit.mix(rng.integers(0, 3, int(woff[-1])).astype(np.uint64))
        want = set()
        for p, s in tests.windows(h):
            for x, y in zip(p.tolist(), s.tolist(), strict=True):
                for k in np.flatnonzero(tests.hash == np.uint64(y)):
                    want.add((int(np.searchsorted(woff, x, "right")) - 1, int(tests.item[k]), x - int(tests.at[k])))
        got = list(tests.diagonals(h, woff))
        assert got == sorted(want)


def test_equal_words_take_no_product_of_lengths():
    import time

    word = textkit.mix(np.array([5], np.uint64))
    tests = D.Tests({1: np.repeat(word, 1000)})
    h = np.repeat(word, 20_000)
    began = time.process_time()
    assert list(tests.hits(h, np.array([0, 20_000]))) == [(0, 1, 0, 1000, 1000)]
    assert time.process_time() - began < 1
