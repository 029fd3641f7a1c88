"""Session folds: hand-made scripts, and streams over split files against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docloom.streaming import frames as T

SCHEMA = "session_id long, event_id long, ts timestamp, has_quad boolean, is_valid boolean, is_blurry boolean, message string"
T0 = dt.datetime(2024, 1, 1)


def script(kinds, session=1, step_ms=50):
    """v valid, b blurry, i invalid, n no quadrilateral."""
    return [(session, k, T0 + dt.timedelta(milliseconds=step_ms * k), c != "n", c in "vb", c == "b", c) for k, c in enumerate(kinds)]


def test_stability(spark):
    run = lambda kinds, **kw: sorted((r.event_id, r.kind) for r in T.capture_stability(spark.createDataFrame(script(kinds), SCHEMA), **kw).collect())
    assert [k for k, kind in run("vvvvvv") if kind == "capture"] == [4]
    assert [k for k, kind in run("vvvvbvv") if kind == "capture"] == [6]
    assert run("nnn") == [(0, "clear"), (1, "clear"), (2, "clear")]
    assert [k for k, kind in run("vvvvv", needed=3, auto=False) if kind == "capture"] == [2, 4]
    assert run("vi") == [(0, "contour")]


def test_rate_and_feedback(spark):
    frames = spark.createDataFrame(script("vvvvvv", step_ms=40) + script("vv", session=2), SCHEMA)
    assert sorted(map(tuple, T.rate_gate(frames).collect())) == [(1, 0), (1, 3), (2, 0)]
    shown = T.feedback_dedup(spark.createDataFrame(script("vvbbv", step_ms=1500), SCHEMA)).collect()
    assert sorted(r.event_id for r in shown) == [0, 2, 4]
    assert T.rate_gate(frames.limit(0)).collect() == []


def test_nulls_and_large_ids(spark, tmp_path):
    big = 2**53 + 1
    rows = [(None, big + k, T0 + dt.timedelta(seconds=k), None if k == 2 else True, True, None, "m") for k in range(5)]
    rows += [(big, k, T0, True, True, False, "m") for k in (1, 2)] + [(1, None, T0, True, True, False, "m"), (1, 5, None, True, True, False, "m")]
    events = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, T.feedback_dedup(events, 60_000).collect()), key=repr)
    assert got == sorted([(None, big, "m"), (big, 1, "m")], key=repr)
    kinds = sorted((r.event_id, r.kind) for r in T.capture_stability(events, 3).where("session_id IS NULL").collect())
    assert kinds == [(big, "contour"), (big + 1, "contour"), (big + 3, "contour"), (big + 4, "capture"), (big + 4, "contour")]
    later = spark.createDataFrame([(-1, 9, T0 + dt.timedelta(days=9), True, True, False, "m")], SCHEMA)  # moves the watermark on
    got_stream = streamed(spark, tmp_path, [events, later], lambda f: T.feedback_dedup(f, 60_000))
    assert sorted((r for r in got_stream if r[0] != -1), key=repr) == got


@pytest.mark.parametrize("of", [lambda f, **kw: T.rate_gate(f, 3_600_000, **kw), lambda f, **kw: T.capture_stability(f, 3, **kw), lambda f, **kw: T.feedback_dedup(f, 7_200_000, **kw)])
def test_stream_equals_batch(spark, tmp_path, of):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    frames = events.selectExpr("user_id AS session_id", "event_id", "CAST(ts AS timestamp) AS ts", "event_type <> 'signup' AS has_quad", "event_type IN ('view', 'click', 'error') AS is_valid", "event_type = 'error' AS is_blurry", "event_type AS message")
    # Micro-batches whose events overlap in time; the last one moves the watermark past all others.
    parts = [frames.where(w) for w in ("event_id < 300 OR event_id % 7 = 0 AND event_id < 400", "event_id BETWEEN 300 AND 650 AND (event_id % 7 <> 0 OR event_id >= 400)", "event_id > 650")]
    last = frames.agg(F.max("ts")).first()[0] + dt.timedelta(days=40)
    later = spark.createDataFrame([(-1, -1, last, True, True, False, "m")], "session_id long, event_id long, ts timestamp, has_quad boolean, is_valid boolean, is_blurry boolean, message string")
    got = streamed(spark, tmp_path, [*parts, later], lambda f: of(f, lateness="30 days"))
    assert sorted(r for r in got if r[0] != -1) == sorted(map(tuple, of(frames).collect()))


def streamed(spark, tmp_path, parts, of):
    """Rows of a stream that meets one part after the other, each in a query of its own: state comes from the checkpoint."""
    target = tmp_path / "in"
    target.mkdir(exist_ok=True)
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/{k}")
        for f in (tmp_path / str(k)).glob("part-*"):
            f.rename(target / f"{k}-{f.name}")
        q = of(spark.readStream.schema(parts[0].schema).parquet(str(target))).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination(120)
        streamed.last = q
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]


def test_late_events_and_silent_sessions(spark, tmp_path):
    """Late events inside the lateness take their place, later ones are dropped; the state of silent sessions goes."""
    at = lambda s, session, k: (session, k, T0 + dt.timedelta(seconds=s), True, True, False, f"m{session}")
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    parts = [frame(at(0, 1, 0), at(20, 1, 2), at(5, 2, 10)), frame(at(15, 1, 1), at(40, 1, 3)), frame(at(2, 2, 11), at(60, 1, 4)), frame(at(4000, 3, 20)), frame(at(9000, 3, 21)), frame(at(20000, 4, 30))]
    got = streamed(spark, tmp_path, parts, lambda f: T.rate_gate(f, 10_000, lateness="10 seconds", idle_ms=600_000))
    # 15 came after 20 and in time: 0, 15, 40 and 60 are kept (20 is 5 s after 15); session 2's second event came too late.
    assert sorted(r for r in got if r[0] < 4) == [(1, 0), (1, 1), (1, 3), (1, 4), (2, 10), (3, 20), (3, 21)]
    left = streamed.last.lastProgress["stateOperators"][0]["customMetrics"]
    assert streamed.last.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6, left  # nothing but session 4's own event, timer and their counts


@pytest.mark.parametrize("hot", [1.0, 0.4])
@pytest.mark.parametrize("of", [lambda f: T.rate_gate(f, 3_000), lambda f: T.rate_gate(f, 0), lambda f: T.capture_stability(f, 4), lambda f: T.capture_stability(f, 3, auto=False), lambda f: T.capture_stability(f, 1, auto=False), lambda f: T.feedback_dedup(f, 2_000)])
def test_long_sessions_in_ranges(spark, monkeypatch, of, hot):
    """One session of all (or many) events, cut into ranges, folds as it does in one task, and as a plain loop does."""
    rng = random.Random(7)
    rows, ms = [], 0
    for k in range(3000):
        ms += rng.choice((0, 1, 50, 900, 2500))
        session = None if rng.random() < hot else rng.randint(1, 40)
        rows.append((session, k, T0 + dt.timedelta(milliseconds=ms), rng.random() < 0.9, rng.random() < 0.95, rng.random() < 0.1, rng.choice(["a", "a", "a", "b", None]) if k > 1200 else "a"))
    events = spark.createDataFrame(rows, SCHEMA).repartition(4)
    if hot < 1:
        events = events.withColumn("final_blurry", F.col("event_id") % 9 == 0)
    key = lambda r: tuple(map(str, r))
    want = sorted(map(tuple, of(events).collect()), key=key)
    monkeypatch.setattr(T, "SESSION_ROWS", 150)
    assert sorted(map(tuple, of(events).collect()), key=key) == want
    assert want == sorted(plain(sorted(map(tuple, events.collect()), key=lambda r: (r[2], r[1])), of), key=key)


def plain(rows, of):
    """The folds as a loop, event by event."""
    fold = {}
    monkey = type("Seen", (), {"isStreaming": False, "columns": ["final_blurry"] if rows and len(rows[0]) > 7 else []})
    T_batch = T._batch
    T._batch = lambda events, f: fold.setdefault("f", f)
    try:
        of(monkey)
    finally:
        T._batch = T_batch
    f, state, out = fold["f"], {}, []
    for r in rows:
        session, event, us, quad, valid, blurry, message = r[0], r[1], round((r[2] - T0).total_seconds() * 1e6), *r[3:7]
        if isinstance(f, T.RateGate):
            last = state.get(session)
            if last is None or us - last >= f.wait:
                state[session] = us
                out.append((session, event))
        elif isinstance(f, T.Feedback):
            last, when = state.get(session, (None, None))
            if last is None or message != last or us - when >= f.wait:
                state[session] = message, us
                out.append((session, event, message))
        else:
            n = state.get(session, 0)
            if not (quad and valid and not blurry):
                n = max(0, n - 1)
                if not quad and n == 0:
                    out.append((session, event, "clear"))
            else:
                n, seen = n + 1, True
                if n >= f.needed:
                    if f.final and r[7]:
                        n, seen = max(0, n - 2), False
                    else:
                        out.append((session, event, "capture"))
                        n = 0 if f.auto else max(1, n - 2)
                if seen:
                    out.append((session, event, "contour"))
            state[session] = n
    return out


def test_stream_documents_equals_batch(spark, tmp_path):
    from docloom.operators.matching import process_documents
    from docloom.plans import documents

    scans = documents.nested(spark, "/root/testdata/sf0.001").where("scan_id % 20 = 0")
    scans.write.parquet(f"{tmp_path}/scans")
    stored = spark.read.parquet(f"{tmp_path}/scans")
    stream = T.stream_documents(spark.readStream.schema(stored.schema).parquet(f"{tmp_path}/scans"), documents.TEMPLATES)
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(240)
    rows = lambda df: sorted(map(tuple, documents.flat_results(df).collect()))
    got = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert got == rows(process_documents(stored, documents.TEMPLATES)) and len(got) > 50
