"""The shingle join against all pairs of a small table, with edits of every strength around 0.8."""

import random
import re

import numpy as np

from docloom.llm import shinglejoin as J


def brute(rows):
    """rows: (id, text). id -> (n_shingles, component), by comparing all pairs."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i), d) if d is not None or s else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def edited(rng, words, share):
    out = list(words)
    for _ in range(max(1, int(len(words) * share))):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.5:
            out[i] = f"x{rng.randrange(10**6)}"
        elif kind < 0.75 and len(out) > 1:
            del out[i]
        else:
            out.insert(i, f"y{rng.randrange(10**6)}")
    return out


def rows_of(seed):
    rng = random.Random(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 5, 8, 12, 20, 40, 90, 200, 500)))]
        if rng.random() < 0.3:
            base = passage + base
        rows.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            rows.append(" ".join(edited(rng, base, rng.choice((0.005, 0.01, 0.02, 0.03, 0.05)))))
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


def test_against_all_pairs(spark):
    rows = rows_of(1) + [(7, None), (8, ""), (9, " \t"), (10, "One two"), (11, "one TWO"), (12, "one two"), (None, "one two"), (12, "one two"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, node long, component_id string").repartition(5)
    assert result(J.near_duplicates(docs)) == brute(rows)


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 20)
    rng = random.Random(5)
    base = [f"w{rng.randrange(9999)}" for _ in range(120)]
    rows = [(i, " ".join(edited(rng, base, 0.02))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(J.near_duplicates(docs)) == brute(rows)


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(J.near_duplicates(docs)) == brute(rows)


def test_index_finds_every_link():
    """Any two linked sets share at least `need` keys of one scheme, whatever the sizes."""
    rng = np.random.default_rng(3)
    for size in (5, 9, 14, 17, 19, 22, 24, 30, 64, 150, 400, 1200):
        for _ in range(40 if size < 40 else 12):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            cut, add = rng.integers(0, size // 9 + 1), rng.integers(0, size // 9 + 1)
            a, b = np.unique(base), np.unique(np.concatenate((base[cut:], rng.integers(0, 1 << 63, add, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or len(a) == len(b) == both:
                continue
            key, entity, kind, scheme, need = J.index_entries([a, b])
            best = False
            for x in (0, 1):
                for y in (2, 3):
                    if scheme[x] == scheme[y]:
                        left, right = dict(zip(key[entity == x].tolist(), kind[entity == x].tolist(), strict=True)), dict(zip(key[entity == y].tolist(), kind[entity == y].tolist(), strict=True))
                        hits = [k for k in left.keys() & right.keys() if (left[k] | right[k]) & 1]
                        best |= len(hits) >= max(need[x], need[y]) and bool((left[hits[0]] | right[hits[0]]) & 2)
            assert best, (size, cut, add)


def test_short_sets_share_no_key_by_being_short(spark):
    """Unrelated texts of 6 to 25 words, and of up to 60: no family, where keys of empty segments would tie hundreds."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**7)}"
    rows = [(i, " ".join(word() for _ in range(rng.randrange(6, 26 if i < 5000 else 60)))) for i in range(7000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    families = J.families(J.shared_keys(docs, J.fingerprints(docs)))
    assert max([n for _, n in families.groupBy("root").count().collect()], default=0) <= 3


def test_short_sets_of_every_size(spark):
    """All sizes below and around the limit of the small scheme, with edits: all links, against all pairs."""
    rng, rows = random.Random(9), []
    for n in range(4, 36):
        for _ in range(6):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows += [" ".join(base), " ".join(base[1:]), " ".join([*base, "z"]), " ".join(["y", *base, "z"]), " ".join(edited(rng, base, 0.05)), " ".join([*base, "a", "b", "c"])]
    rows = [*enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(J.near_duplicates(docs)) == brute(rows)


def test_hot_class_and_long_text(spark, monkeypatch):
    """Classes with more rows than HOT are met apart; a text of a million words is taken whole."""
    monkeypatch.setattr(J, "HOT", 5)
    long = " ".join(f"l{i % 5000}" for i in range(1_000_000))
    base = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(base)) for i in range(40, 10, -1)] + [(5, " ".join(["z", *base])), (60, "a b"), (61, "a b"), (62, None), (63, ""), (70, long), (71, long + " end"), (72, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(J.near_duplicates(docs)) == brute(rows)


def test_bloom(spark):
    ids = spark.range(0, 5000, 5).selectExpr("id * 7919 - 3000 AS node")
    bits = np.frombuffer(J.bloom(ids, "node"), np.uint8)
    assert J.in_bloom(bits, np.arange(0, 5000, 5) * 7919 - 3000).all()
    assert J.in_bloom(bits, np.arange(10**12, 10**12 + 20000)).mean() < 0.01
