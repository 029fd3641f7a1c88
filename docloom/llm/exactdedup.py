"""Exact dedup: static binary-fuse filters over immutable snapshots, exact buckets behind them.

Documents come in batches. A batch is grouped by the SHA-256 digest of its normalised texts, so that copies
inside it meet by a map-side combined aggregation, whatever the size of a group. Its distinct digests are then
screened by the filters of every earlier snapshot. What a filter lets pass joins the snapshot's exact buckets
by digest, and the texts themselves are compared, byte by byte; all else is new and becomes, with filters of
its own, the next snapshot, which never changes again.

A snapshot's buckets are parts of the digests' hash range with about `BUCKET_KEYS` digests each. A filter (three
slots a key, eight bits a slot, about 1.13 bytes a key) is built and probed where Spark has put its bucket: neither
digests nor filters pass through the driver, and an incoming batch larger than a snapshot meets each filter in
several slices. Digests are distinct before they are dealt to buckets, so no bucket is hot.

Inside a batch a SHA-256 digest stands for its text; across batches equal digests with unlike texts stay apart.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.shared import residue, sent_if_few, table, with_row_ids, written
from docloom.llm.textkit import mix

BUCKET_KEYS = 1 << 21
#: Batches in which the query takes its table; each but the last is a snapshot to those after it.
BATCHES = 3
_U = np.uint64
_HEAD = "<QIII"


def normal(text: Column) -> Column:
    """A text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _places(keys: np.ndarray, seed: int, segment: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots (n, 3), in three neighbouring segments, and the eight-bit print of each key."""
    a = mix(keys ^ mix(np.array([seed], _U)))
    b = mix(a + _U(0x9E3779B97F4A7C15))
    start = ((a >> _U(32)) * _U(span)) >> _U(32)
    base, low = start // _U(segment), _U(segment - 1)
    slots = np.stack((start, (base + _U(1)) * _U(segment) + (a & low), (base + _U(2)) * _U(segment) + (b & low)), axis=1)
    return slots.astype(np.int64), (b >> _U(56)).astype(np.uint8)


def fuse_filter(keys: np.ndarray) -> bytes:
    """The static filter of a set of 64-bit keys. Keys are peeled in rounds: all slots that one key alone holds at once."""
    keys = np.unique(keys.astype(_U))
    n = max(len(keys), 2)
    segment = 1 << min(18, int(math.log(n) / math.log(3.33) + 2.25))
    wanted = max(32, math.ceil(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))))
    span = max(1, math.ceil(wanted / segment) - 2) * segment
    size = span + 2 * segment
    for seed in range(1, 1000):
        slots, prints = _places(keys, seed, segment, span)
        degree = np.bincount(slots.ravel(), minlength=size)
        # The sum of the numbers of a slot's keys: with one key left, its number.
        total = np.bincount(slots.ravel(), np.repeat(np.arange(len(keys)), 3), size).astype(np.int64)
        rounds, left, free = [], len(keys), np.flatnonzero(degree == 1)
        while len(free):
            who, first = np.unique(total[free], return_index=True)
            rounds.append((who, free[first]))
            left -= len(who)
            touched = slots[who].ravel()
            np.subtract.at(degree, touched, 1)
            np.subtract.at(total, touched, np.repeat(who, 3))
            touched = np.unique(touched)
            free = touched[degree[touched] == 1]
        if not left:
            break
    else:
        raise RuntimeError("no seed peels these keys")
    table = np.zeros(size, np.uint8)
    for who, slot in reversed(rounds):
        s = slots[who]
        table[slot] = prints[who] ^ table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]
    return struct.pack(_HEAD, seed, segment, span, size) + table.tobytes()


def may_hold(data: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key passes the filter: every key of its set does, another one in 256."""
    seed, segment, span, size = struct.unpack_from(_HEAD, data)
    table = np.frombuffer(data, np.uint8, size, struct.calcsize(_HEAD))
    slots, prints = _places(keys.astype(_U), seed, segment, span)
    return table[slots[:, 0]] ^ table[slots[:, 1]] ^ table[slots[:, 2]] == prints


@dataclass(frozen=True)
class Snapshot:
    """Digests of texts that earlier batches don't have. `groups`: digest, first (struct<row, id> of the least row), n,
    bucket; `filters`: bucket, filter. Both are written tables."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64("digest"), 20), F.lit(buckets)).cast("int")


def snapshot(groups: DataFrame) -> Snapshot:
    """A snapshot of distinct digests (digest, first, n)."""
    buckets = max(1, math.ceil(groups.count() / BUCKET_KEYS))
    exact = written(groups.withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", "digest"), "buckets")

    def build(part: pa.Table) -> pa.Table:
        return pa.table({"bucket": part["bucket"][:1], "filter": pa.array([fuse_filter(part["key"].to_numpy().view(_U))], pa.binary())})

    keys = exact.select("bucket", F.xxhash64("digest").alias("key"))
    return Snapshot(exact, written(keys.groupBy("bucket").applyInArrow(build, "bucket int, filter binary"), "filters"), buckets)


def screened(groups: DataFrame, rows: int, of: Snapshot) -> DataFrame:
    """The groups (digest, first, n; distinct digests, `rows` of them) whose digest passes the snapshot's filters, with their bucket."""
    slices = max(1, math.ceil(rows / (of.buckets * BUCKET_KEYS)))
    coming = groups.select("digest", "first", "n", F.xxhash64("digest").alias("key"), _bucket(of.buckets).alias("bucket"), F.pmod(F.xxhash64("digest"), F.lit(slices)).cast("int").alias("slice"))
    filters = of.filters.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def probe(part: pa.Table, filter: pa.Table) -> pa.Table:
        names = ["digest", "first", "n", "bucket"]
        if not len(part) or not len(filter):
            return part.select(names).slice(0, 0)
        passed = may_hold(filter["filter"][0].as_py(), part["key"].to_numpy().view(_U))
        return part.select(names).filter(pa.array(passed))

    schema = f"digest binary, first {groups.schema['first'].dataType.simpleString()}, n long, bucket int"
    return coming.groupBy("bucket", "slice").cogroup(filters.groupBy("bucket", "slice")).applyInArrow(probe, schema)


def same_bytes(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (batch row `row`, snapshot row `of`, and more), those whose normalised texts are equal. `texts`: row, text.

    Texts of the rows asked for alone leave their place; their ids are sent while few."""
    wanted = sent_if_few(written(pairs.select(F.explode(F.array("row", "of")).alias("row")).distinct(), "wanted"))
    found = written(texts.join(wanted, "row").select("row", normal(F.col("text")).alias("bytes")), "texts")
    both = pairs.join(found, "row").join(found.select(F.col("row").alias("of"), F.col("bytes").alias("other")), "of")
    return both.where(F.col("bytes") == F.col("other")).drop("bytes", "other")


def deduplicate(docs: DataFrame, batches: int = BATCHES, batch: Column | None = None, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs.

    `batch`: the batch, 0 to batches - 1, of a row, by the columns row, doc_id and text (row is the id, or a number above
    all ids where that is null or repeated); without one rows are dealt by a hash of their number. The result
    doesn't depend on it. Null and empty texts are equal to each other. Of equal texts the row with the least id stays;
    rows with a null id, and all rows of a repeated id but one, rank after all others, so exactly one row of a group is
    kept, and keep_id is its id (null if that is). An empty table gives no rows. Other columns are not looked at.
    """
    rows, row = with_row_ids(docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    rows = rows.select(F.col(row).alias("row"), "doc_id", "text")
    turn = F.pmod(residue("row", batches) if batch is None else batch, F.lit(batches)).cast("int")
    prints = written(rows.select("row", "doc_id", F.unhex(F.sha2(normal(F.col("text")), 256)).alias("digest"), turn.alias("batch")), "digests")
    texts, past, homes = rows.select("row", "text"), [], None
    for k in range(batches):
        groups = written(prints.where(F.col("batch") == k).groupBy("digest").agg(F.min(F.struct("row", F.col("doc_id").alias("id"))).alias("first"), F.count("*").alias("n")), "groups")
        size, hits = groups.count(), None
        for home, old in enumerate(past):
            passed = screened(groups, size, old)
            met = passed.join(old.groups.select("bucket", "digest", F.col("first.row").alias("of")), ["bucket", "digest"]).select("digest", F.col("first.row").alias("row"), "of", F.lit(home).alias("home"))
            hits = met if hits is None else hits.unionByName(met)
        told = groups.withColumns({"batch": F.lit(k), "home": F.lit(k)})
        if hits is not None:
            same = written(same_bytes(written(hits, "positives"), texts).groupBy("digest").agg(F.min("home").alias("at")), "same")
            told = groups.withColumn("batch", F.lit(k)).join(same, "digest", "left").withColumn("home", F.coalesce("at", F.lit(k))).drop("at")
        told = written(told, "told")
        if k + 1 < batches:
            past.append(snapshot(told.where(F.col("home") == k).select("digest", "first", "n")))
        homes = told if homes is None else homes.unionByName(told)
    # Only groups of several rows are told to their rows; any other row is its own.
    classes = homes.groupBy("digest", "home").agg(F.min("first").alias("keep"), F.sum("n").alias("size")).where("size > 1")
    copies = sent_if_few(written(homes.select("digest", "batch", "home").join(classes, ["digest", "home"]).drop("home"), "copies"))
    out = prints.join(copies, ["digest", "batch"], "left")
    own = F.col("keep").isNull()
    return out.select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("keep.id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("keep.row") == F.col("row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op13_fuse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


QUERIES = {"op13_fuse_dedup": op13_fuse_dedup}
ORACLES = {
    "op13_fuse_dedup": r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""
}
