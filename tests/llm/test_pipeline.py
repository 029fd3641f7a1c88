"""The pipeline, stage by stage, against brute force on a small table."""

import corpus_pipeline as C
from test_decontaminate import brute as shared_passages
from test_records import brute as encoded
from test_shinglejoin import brute as near_copies

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    more = spark.createDataFrame([(None, "some words without an id here", "en", "src1", 3), (None, "some words without an id here", "en", "src1", 3), (9000, None, None, None, None), (9001, "12 34", "en", "src1", 5), (1, "this id is taken by another one", "en", "src2", 2)], docs.schema)
    docs = docs.unionByName(more)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names, (one, two, three, four, five) = zip(*C.STAGES, strict=True)
    assert len(names) == 5

    def step(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    a = step(one(spark, docs, str(tmp_path)), "a")
    assert a.columns == docs.columns
    kept = sorted((r.doc_id or -1, r.text) for r in a.collect())
    assert kept == sorted((r.doc_id or -1, r.text) for r in docs.collect() if any(c.isalpha() for c in r.text or ""))

    b = step(two(spark, a, str(tmp_path)), "b")
    rows = [(i, r.text) for i, r in enumerate(sorted(a.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)))]
    components = {c for _, _, c in near_copies(rows)}
    assert b.columns == docs.columns and sorted(r.text for r in b.collect()) == sorted(rows[c][1] for c in components)

    c = step(three(spark, b, str(tmp_path)), "c")
    rows = [(i, r.text) for i, r in enumerate(b.collect())]
    hit = {d for d, _ in shared_passages(rows, bench)}
    assert sorted(r.text for r in c.collect()) == sorted(t for i, t in rows if i not in hit) and hit

    d = step(four(spark, c, str(tmp_path)), "d")
    assert d.columns == docs.columns
    before, after = c.collect(), d.collect()
    size = lambda rows: sum(len(r.text.split()) for r in rows)
    assert {r.text for r in after} <= {r.text for r in before} and abs(size(after) - size(before)) < 0.2 * size(before)

    e = step(five(spark, d, str(tmp_path)), "e")
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in e.collect() if r.doc_id is not None)
    assert got == sorted((i, n, crc) for i, _, n, crc in encoded([(r.doc_id, r.text) for r in after]) if i is not None) and e.count() == d.count()

    assert C.run(spark, str(tmp_path)).count() == e.count()
