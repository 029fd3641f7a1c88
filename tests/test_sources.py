"""Rejected records, sinks that survive a replay, and types by bands."""

import json

import numpy as np
from pyspark.sql import functions as F

from docloom.operators import geometry as G
from docloom.operators import matching as M
from docloom.plans import documents
from docloom.sources import io


def test_rejected_records(spark, tmp_path):
    good = [{"scan_id": k, "text": f"t{k}", "blocks": [{"text": "a", "boundingBox": {"left": 1.0, "top": 2.0, "right": 3.0, "bottom": 4.0}, "lines": []}]} for k in range(4)] + [{"scan_id": 9}]
    wrong = {"scan_id": 5, "blocks": [{"boundingBox": {"left": "far"}}]}
    (tmp_path / "a.json").write_text("\n".join([*map(json.dumps, good), "", "no json", json.dumps(wrong)]))
    (tmp_path / "b.json").write_text(json.dumps(good[0]) + "\n" + json.dumps(good[1])[:40])
    scans, rejects = io.read_scans_checked(spark, str(tmp_path))
    assert {(r.file[-6:], r.reason) for r in rejects.collect()} == {("a.json", "not JSON"), ("a.json", "wrong type"), ("b.json", "cut off")} and rejects.count() == 3
    assert {r.raw for r in rejects.where("reason = 'wrong type'").collect()} == {json.dumps(wrong)}
    plain = io.read_scans(spark, str(tmp_path)).where("text IS NOT NULL OR scan_id = 9")
    key = lambda r: (r.scan_id, str(r))
    assert sorted(scans.collect(), key=key) == sorted(plain.collect(), key=key) and scans.count() == 6


def test_rejected_records_of_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"scan_id": 1, "text": "x"}, {"scan_id": [2]}, {"scan_id": 3}]))
    (tmp_path / "b.json").write_text(json.dumps([{"scan_id": 4}])[:-3])
    scans, rejects = io.read_scans_checked(spark, str(tmp_path), multi_line=True)
    assert sorted(r.scan_id for r in scans.collect()) == [1, 3] and sorted((r.file[-6:], r.reason) for r in rejects.collect()) == [("a.json", "wrong type"), ("b.json", "cut off")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "t.json").write_text(json.dumps([{"format": "a", "blocks": []}, {"format": "b", "formatId": "x"}, {"format": "c", "blocks": [{"blockType": "k"}]}]))
    templates, rejects = io.read_templates_checked(spark, str(tmp_path / "t"))
    assert sorted((r.template_index, r.format) for r in templates.collect()) == [(0, "a"), (2, "c")] and [(r.position, r.reason) for r in rejects.collect()] == [(1, "wrong type")]
    assert {t["template_index"]: t["format"] for t in M.load_templates(templates)} == {0: "a", 2: "c"}


def test_replayed_batches_add_no_rows(spark, tmp_path):
    """A stream whose second batch fails after its results were written: they don't count, and the replay writes them once."""
    source, path, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(k, f"f{k % 3}") for k in range(90)], "k int, format string")
    read = lambda: spark.readStream.schema(rows.schema).parquet(source)
    rows.where("k < 30").coalesce(1).write.parquet(source)
    io.write_stream(read(), path, state).trigger(availableNow=True).start().awaitTermination(60)
    rows.where("k >= 30").coalesce(1).write.mode("append").parquet(source)

    def fails(df, batch_id):
        io.write_results(df, f"{path}/results/batch_id={batch_id}", "format", "overwrite")
        raise RuntimeError("lost")

    q = read().writeStream.option("checkpointLocation", state).foreachBatch(fails).trigger(availableNow=True).start()
    try:
        q.awaitTermination(60)
    except Exception:
        assert "lost" in str(q.exception())
    assert io.read_batches(spark, path, rows.schema).count() == 30
    io.write_stream(read(), path, state).trigger(availableNow=True).start().awaitTermination(60)
    io.write_stream(read(), path, state).trigger(availableNow=True).start().awaitTermination(60)
    got = io.read_batches(spark, path, rows.schema)
    assert sorted(r.k for r in got.collect()) == list(range(90)) and got.where("format = concat('f', k % 3)").count() == 90


def test_write_results(spark, tmp_path):
    results = M.process_documents(documents.nested(spark, "/root/testdata/sf0.001").where("scan_id % 9 = 0"), documents.TEMPLATES)
    io.write_results(results, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.count() == results.count() > 50 and {p.name for p in (tmp_path / "r").iterdir() if p.is_dir()} == {f"format={r.format}" for r in results.select("format").distinct().collect()}


def test_many_types_in_bands(spark):
    """100,000 types: the nearest and all near ones as all pairs give them, by an equi-join."""
    rng = np.random.default_rng(2)
    ratios = np.round(np.concatenate((rng.uniform(0.3, 3, 90_000), rng.normal(1.42, 0.001, 10_000))), 6)
    ids = np.array([f"t{k:06d}" for k in rng.permutation(len(ratios))])
    types = spark.createDataFrame([(i, float(r)) for i, r in zip(ids, ratios, strict=True)] + [("w", 0.0)], "id string, aspect_ratio double")
    detected = np.round(np.concatenate((rng.uniform(0.1, 4, 400), rng.choice(ratios, 100))), 4)
    quads = spark.createDataFrame([(k, float(d)) for k, d in enumerate(detected)] * 2, "frame_id int, detected double").unionByName(spark.createDataFrame([(-1, None)], "frame_id int, detected double"))
    got = G.match_document_type(quads, types)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    order = np.lexsort((ids, ratios))
    best = {r.frame_id: (r.type_id, round(r.gap, 9)) for r in got.where("frame_id >= 0").collect()}
    for k, d in enumerate(detected):
        gap = np.abs(d - ratios)
        near = [(gap.min(), min(ids[np.flatnonzero(gap == gap.min())].tolist()))] if gap.min() <= 0.15 else []
        want = min((round(g, 12), i) for g, i in [*near, (d, "w")])
        assert best[k] == (want[1], round(want[0], 9)), (k, d)
    assert got.where("frame_id = 3").count() == 2 and len(order) == len(ids)
    few = spark.createDataFrame([(i, float(r)) for i, r in zip(ids[:3000], ratios[:3000], strict=True)], "id string, aspect_ratio double")
    for mode, tolerance in (("absolute", 0.01), ("relative", 0.02)):
        rows = {(r.frame_id, r.type_id) for r in G.match_document_type(quads.distinct(), few, tolerance, mode, best=False).collect()}
        near = np.abs(detected[:, None] - ratios[None, :3000])
        near = near <= tolerance if mode == "absolute" else near < tolerance * ratios[None, :3000]
        assert rows == {(int(k), ids[t]) for k, t in zip(*np.nonzero(near), strict=True)}


def test_outlines_against_kernels(spark):
    """Hulls and simplified outlines as columns against the same in numpy, degenerate ones too."""
    from docloom.functions import kernels

    rng = np.random.default_rng(6)
    shapes = [np.round(rng.uniform(0, 50, (n, 2)) * 4) / 4 for n in (3, 4, 5, 12, 60)] + [np.array([[0, 0], [4, 0], [8, 0], [8, 8], [4, 8.0], [0, 8]]), np.array([[0, 0], [1, 1], [2, 2], [3, 3.0]]), np.array([[5.0, 5], [5, 5], [5, 5], [5, 5]]), np.array([[1.0, 2]])]
    t = np.linspace(0, 2 * np.pi, 64, endpoint=False)
    shapes.append(np.round(np.stack((100 + 50 * np.cos(t), 100 + 30 * np.sin(t)), 1) * 8) / 8)
    df = spark.createDataFrame([(k, [tuple(map(float, p)) for p in s]) for k, s in enumerate(shapes)], "k int, points array<struct<x:double,y:double>>")
    for tolerance in (0.5, 5.0):
        for r in df.select("k", G.hull(F.col("points")).alias("h"), G.simplified(F.col("points"), F.lit(tolerance)).alias("s")).collect():
            shape = shapes[r.k]
            assert [tuple(p) for p in r.s] == [tuple(p) for p in kernels.simplified(shape, tolerance)], (r.k, tolerance)
            if len(np.unique(shape, axis=0)) >= 3:
                assert {tuple(p) for p in r.h} == {tuple(p) for p in kernels.hull(shape)}, r.k
    assert df.select(G.hull(F.lit(None).cast("array<struct<x:double,y:double>>"))).first()[0] is None
