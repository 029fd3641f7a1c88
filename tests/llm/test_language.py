"""Cross-parsing language ID: automata against substring search, held-out accuracy, and odd rows."""

import random

import numpy as np

from docloom.llm import language as L


def greedy(text, source):
    """Phrases of text: from each end of the last, the longest match in source (one character if there is none)."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in source:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases_against_substring_search():
    rng = random.Random(1)
    sources = {k: "".join(rng.choice(a) for _ in range(400)) for k, a in (("x", "abcd "), ("y", "cdefé "))}
    model = L.Model(sources)
    texts = ["", "a", "zzz", "abzcd", *("".join(rng.choice("abcdefé z") for _ in range(rng.randrange(1, 900))) for _ in range(40))]
    h, letters = model.entropies(texts)
    for t, row, n in zip(texts, h, letters, strict=True):
        assert n == sum(c.isalpha() for c in t)
        for k, got in zip(model.languages, row, strict=True):
            weight = np.log2(max(2, sum(c in "abcdefé " for c in sources[k])))
            assert round(got * max(1, len(t)) / weight) == greedy(t, sources[k])


def test_scripts_of_thousands_of_letters(spark):
    """Two languages of 2,000 letters each, from the same range: phrases by substring search, and the language by them."""
    rng = random.Random(2)
    scripts = {k: [chr(0x4E00 + 2 * i + o) for i in range(2000)] for o, k in enumerate("xy")}
    common = [chr(0x7000 + i) for i in range(400)]
    words = {k: ["".join(rng.choice(v if rng.random() < 0.5 else common) for _ in range(3)) for _ in range(4000)] for k, v in scripts.items()}
    text = lambda k, n: " ".join(words[k][int(4000 * rng.random() ** 2)] for _ in range(n))
    sources = {k: text(k, 4000)[:16000] for k in words}
    model = L.Model(sources)
    assert model.symbols > 3000 and len(model.rare)
    texts = [text(k, 60) for k in "xyxy"] + ["".join(rng.choice(common) for _ in range(40)), "abc"]
    h, _ = model.entropies(texts)
    for t, row in zip(texts, h, strict=True):
        for k, got in zip(model.languages, row, strict=True):
            assert round(got * len(t) / np.log2(len(sources[k]))) == greedy(t, sources[k])
    docs = spark.createDataFrame([(i, text("xy"[i % 2], 50), "xy"[i % 2]) for i in range(200)], "doc_id long, text string, lang string")
    assert all(r.lang_pred == "xy"[r.doc_id % 2] for r in L.languages(docs).collect())


def test_stretches_restart_the_parse():
    model = L.Model({"x": "abc" * 900})
    h, _ = model.entropies(["abc" * 700])
    assert round(h[0, 0] * 2100 / model.weight[0]) == 3  # 2,100 characters: three stretches


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "hello there", "en", 0), (2, None, None, 0), (3, "12 %%", "en", 0), (None, "hello", None, 0), (1, "hello there", "en", 0), (4, "", "en", 0)], "doc_id long, text string, lang string, score int")
    rows = L.languages(docs).collect()
    assert len(rows) == 6
    assert {(r.doc_id, r.lang_pred) for r in rows} == {(1, "en"), (2, "und"), (3, "und"), (None, "en"), (4, "und")}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert L.languages(docs.limit(0)).collect() == []
    assert [r.lang_pred for r in L.languages(docs.select("doc_id", "text", docs.text.substr(0, 0).alias("lang")).where("doc_id = 2")).collect()] == ["und"]
