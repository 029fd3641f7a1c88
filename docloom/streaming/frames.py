"""Camera sessions: rate gate, capture stability and feedback, on tables and on streams.

Each is a fold over one session's events in time order (streaming.folds). On a table, sessions are sorted in one
shuffle and folded in pieces, so a session of any length takes constant memory. Sessions of more than
`SESSION_ROWS` events are cut into ranges of time instead: every range is summed up as a function of the state in
which it begins, the driver applies these functions one after the other (a row a range), and all ranges of
a session emit at once. On a stream, events wait in the state until the watermark has passed them, so that
late ones inside the allowed lateness fall into their place; a session that is silent long enough is forgotten.

Events without a session are a session of their own; those without an id or a time have no place in the order
and are left out; a mark (has_quad, is_valid, is_blurry) that is null counts as false.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.sources.folders import written
from docloom.streaming.folds import Events, Feedback, RateGate, Stability

Fold = RateGate | Feedback | Stability
#: Events of a session that one task folds; a longer one is cut into ranges of about as many.
SESSION_ROWS = 2_000_000
#: How late an event of a stream may come, and after how long a silence its session is forgotten.
LATENESS, IDLE = "10 seconds", 3_600_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = {"kind": "string", "message": "string"}
_TYPES = {"has_quad": "boolean", "is_valid": "boolean", "is_blurry": "boolean", "final_blurry": "boolean", "message": "string"}
_ORDER = ("session_id", "us", "event_id")


def _time() -> Column:
    # Times may be without zone; the arithmetic needs only differences.
    return F.col("ts").cast("timestamp")


def _prepared(events: DataFrame, fold: Fold, *more: Column) -> DataFrame:
    reads = (F.col(c).cast(_TYPES[c]).alias(c) for c in fold.reads)
    return events.where("event_id IS NOT NULL AND ts IS NOT NULL").select(F.col("session_id").cast("long"), F.col("event_id").cast("long"), F.unix_micros(_time()).alias("us"), *more, *reads)


def _schema(fold: Fold) -> str:
    return ", ".join(["session_id long", "event_id long", *(f"{c} {_OUT[c]}" for c in fold.out)])


def _begins(session: pa.Array) -> np.ndarray:
    """Whether each row begins a session, told from the row before; row 0 does."""
    first = np.ones(len(session), bool)
    if len(session) > 1:
        null, value = session.is_null().to_numpy(zero_copy_only=False), session.fill_null(0).to_numpy()
        first[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return first


def _events(part: pa.RecordBatch, fold: Fold) -> Events:
    return Events(part.column("us").to_numpy(), _begins(part.column("session_id")), {c: part.column(c) for c in fold.reads})


def _emitted(part: pa.RecordBatch, fold: Fold, state: Any, goes_on: bool) -> tuple[pa.RecordBatch, Any]:
    """What a fold emits of sorted events; `goes_on`: whether `state` is that of their first session."""
    events = _events(part, fold)
    events.first[0] = not goes_on
    at, more, state = fold.run(events, state if goes_on else fold.start)
    take = pa.array(at)
    return pa.RecordBatch.from_arrays([part.column("session_id").take(take), part.column("event_id").take(take), *(more[c] for c in fold.out)], ["session_id", "event_id", *fold.out]), state


def _one(part: pa.Table) -> pa.RecordBatch:
    return part.sort_by([(c, "ascending") for c in _ORDER]).combine_chunks().to_batches(max_chunksize=None)[0]


def _whole(rows: DataFrame, fold: Fold) -> DataFrame:
    """Sessions folded by one task each, a batch of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Scalar | None = None
        state = None
        for batch in batches:
            if batch.num_rows:
                session = batch.column("session_id")
                out, state = _emitted(batch, fold, state, last is not None and last.as_py() == session[0].as_py())
                last = session[len(session) - 1]
                yield out

    return rows.repartition("session_id").sortWithinPartitions(*_ORDER).mapInArrow(run, _schema(fold))


def _ranged(rows: DataFrame, count: int, fold: Fold) -> DataFrame:
    """Long sessions folded range by range."""
    ranges = math.ceil(count / SESSION_ROWS) + 1
    cut = written(rows.repartitionByRange(ranges, *_ORDER).withColumn("range", F.spark_partition_id()), "ranges")

    def sum_up(part: pa.Table) -> pa.Table:
        whole = _one(part)
        begins = np.flatnonzero(_begins(whole.column("session_id")))
        summary = fold.summary(_events(whole.slice(int(begins[-1])), fold))
        ends = whole.column("session_id").take(pa.array([0, len(whole) - 1]))
        return pa.table([part["range"][:1], ends[:1], ends[1:], pa.array([len(begins)]), pa.array([pickle.dumps(summary)])], ["range", "first", "last", "sessions", "summary"])

    told = cut.groupBy("range").applyInArrow(sum_up, "range int, first long, last long, sessions long, summary binary").collect()  # a row a range
    carried: dict[int, Any] = {}
    state, session, begun = fold.start, None, False
    for r in sorted(told, key=lambda r: r["range"]):
        goes_on = begun and r["first"] == session
        if goes_on:
            carried[r["range"]] = state
        state = fold.after(pickle.loads(r["summary"]), state if goes_on and r["sessions"] == 1 else fold.start)
        session, begun = r["last"], True
    sent = rows.sparkSession.sparkContext.broadcast(carried)

    def emit(part: pa.Table) -> pa.Table:
        k = part["range"][0].as_py()
        out, _ = _emitted(_one(part), fold, sent.value.get(k), k in sent.value)
        return pa.Table.from_batches([out])

    return cut.groupBy("range").applyInArrow(emit, _schema(fold))


def _batch(events: DataFrame, fold: Fold) -> DataFrame:
    rows = _prepared(events, fold)
    # At most one session in SESSION_ROWS rows is long.
    long = rows.groupBy("session_id").agg(F.count("*").alias("__n")).where(F.col("__n") > SESSION_ROWS)
    long = written(long, "long-sessions")
    count = long.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    if not count:
        return _whole(rows, fold)
    key = long.select(F.struct("session_id").alias("__s"))
    mine = F.struct("session_id") == F.col("__s")
    return _whole(rows.join(F.broadcast(key), mine, "left_anti"), fold).unionByName(_ranged(rows.join(F.broadcast(key), mine, "left_semi"), count, fold))


class _Folded(StatefulProcessor):
    """A session of a stream: the fold's state, the time of its last event, and events that the watermark hasn't passed."""

    def __init__(self, fold: Fold, idle_ms: int):
        self.fold, self.idle = fold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state binary, us long")
        self.waiting = handle.getListState("waiting", ", ".join(["us long", "event_id long", *(f"{c} {_TYPES[c]}" for c in self.fold.reads)]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        columns, least = ["us", "event_id", *self.fold.reads], None
        for part in rows:
            if len(part):
                plain = part[columns].astype(object).where(part[columns].notna(), None)
                self.waiting.appendList(list(plain.itertuples(index=False, name=None)))
                least = min(int(part["us"].min()), least if least is not None else 1 << 62)
        if least is not None:
            self.handle.registerTimer(least // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get() if self.waiting.exists() else (), key=lambda r: (r[0], r[1]))
        ready, rest = [r for r in rows if r[0] < watermark * 1000], [r for r in rows if r[0] >= watermark * 1000]
        state, us = self.state.get() if self.state.exists() else (None, None)
        if ready:
            session = None if pd.isna(key[0]) else int(key[0])
            names = ["us", "event_id", *self.fold.reads]
            kinds = [pa.int64(), pa.int64(), *(pa.bool_() if _TYPES[c] == "boolean" else pa.string() for c in self.fold.reads)]
            arrays = [pa.array([r[k] for r in ready], kind) for k, kind in enumerate(kinds)]
            part = pa.RecordBatch.from_arrays([pa.array([session] * len(ready), pa.int64()), *arrays], ["session_id", *names])
            out, now = _emitted(part, self.fold, None if state is None else pickle.loads(bytes(state)), state is not None)
            us = ready[-1][0]
            self.state.update((pickle.dumps(now), us))
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            if out.num_rows:
                yield out.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif us is not None and us // 1000 + self.idle <= watermark:
            self.state.clear()
            self.waiting.clear()
        elif us is not None:
            self.handle.registerTimer(us // 1000 + self.idle)


def _stream(events: DataFrame, fold: Fold, lateness: str, idle_ms: int) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # timers need it
    timed = events.withColumn("ts", _time()).withWatermark("ts", lateness)
    return _prepared(timed, fold, F.col("ts")).groupBy("session_id").transformWithStateInPandas(_Folded(fold, idle_ms), _schema(fold), "Append", "EventTime")


def _folded(events: DataFrame, fold: Fold, lateness: str, idle_ms: int) -> DataFrame:
    return _stream(events, fold, lateness, idle_ms) if events.isStreaming else _batch(events, fold)


def rate_gate(frames: DataFrame, interval_ms: int = 100, lateness: str = LATENESS, idle_ms: int = IDLE) -> DataFrame:
    """session_id, event_id of the frames kept: those at least the interval after the last kept one; for a stream or a table."""
    return _folded(frames, RateGate(interval_ms), lateness, idle_ms)


def capture_stability(frames: DataFrame, needed: int = 5, auto: bool = True, lateness: str = LATENESS, idle_ms: int = IDLE) -> DataFrame:
    """session_id, event_id, kind: captures, contours and clearings."""
    return _folded(frames, Stability(needed, auto, "final_blurry" in frames.columns), lateness, idle_ms)


def feedback_dedup(messages: DataFrame, gap_ms: int = 2000, lateness: str = LATENESS, idle_ms: int = IDLE) -> DataFrame:
    """session_id, event_id, message of the messages shown."""
    return _folded(messages, Feedback(gap_ms), lateness, idle_ms)


def stream_documents(scans: DataFrame, templates: list[dict], known: DataFrame | None = None) -> DataFrame:
    """process_documents on arriving scans: no state and no shuffle, so each scan is answered in its micro-batch. `known`: what
    matching.known_facts has found in scans of earlier times, which spares the work on texts that come again."""
    from docloom.operators.matching import process_documents

    return process_documents(scans, templates, known)
