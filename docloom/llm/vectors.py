"""Embedding near-dedup by sorted projection passes.

A pass hashes each vector to 63 sign bits of random projections, most significant first, and orders the
vectors by that number, so that vectors at a small angle stand close together. Each is compared with the
next `WINDOW` in the order; pairs whose cosine is at least the threshold are linked. Passes with other
projections find what one pass parts, and a union over all passes joins the pairs into clusters. The number of
passes follows from the counted distinct vectors, so that a pair at the threshold is found as often in a large
table as in a small one (`passes_for`).

Only hashes are sorted (a range sort by pass, hash and id, so ties spread too); the sort gives each row its
place in the order, places are cut into chunks of one size, and a chunk's last rows are also sent to the
next chunk, so that windows reach over its edge. Equal vectors are one row from the start: their copies
count in n_links, and a vector that a third of all rows repeat stands in one place.

Clusters larger than a window would lose links by it. An exact step follows: in a cluster the angle of every
vector to the pivot (the cluster's mean direction) is known. Two vectors whose angles to the pivot add up to no
more than the threshold angle are linked without a comparison: the core, all within half that angle. A cluster
of near copies of one vector is all core, whatever its size. The others, the fringe, are compared with the
members of their cluster in blocks, and links are counted where they are found, never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.graph import components
from docloom.llm.shared import partitions, sent_if_few, table, written
from docloom.llm.shinglejoin import forest

COSINE = 0.95
#: Least passes; more are taken as the table grows.
PASSES = 8
#: Share of pairs exactly at the threshold that the passes find where vectors spread evenly.
RECALL = 0.995
BITS = 63
WINDOW = 32
#: Places in a chunk of the order.
CHUNK = 8192
#: Fringe or member vectors in a block of the exact step.
BLOCK = 2000
#: Slack for angles that are added up in floating point; pairs so near to the threshold are compared.
EPSILON = 1e-9
#: Bytes of clusters' mean vectors that a join may send to every task.
SENT = 32_000_000


def raw_vectors(df: DataFrame, id: str, embedding: str) -> DataFrame:
    """vec_id, dim, raw: the components' bytes (float or double, as the column has them); null where the vector can't link."""
    double = "double" in dict(df.dtypes)[embedding]
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, raw = [], []
            for x in batch.column(1).to_pylist():
                v = None if not x or None in x else np.array(x, kind)
                ok = v is not None and np.isfinite(v).all() and v.any()
                dim.append(len(v) if ok else None)
                raw.append((v + kind(0)).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dim, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "dim", "raw"])

    return df.select(F.col(id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{'double' if double else 'float'}>")).mapInArrow(run, "vec_id long, dim int, raw binary")


def unit(raw: list[bytes], dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), np.float64 if len(raw[0]) == 8 * dim else np.float32).reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def passes_for(n: int, threshold: float, window: int) -> int:
    """Passes that find RECALL of the pairs at the threshold among n distinct vectors.

    A bit parts two vectors with the probability angle / pi. Evenly spread, n vectors stand within a window once
    log2(n / window) leading bits agree, so a pass finds a pair with at least (1 - angle / pi) to that power.
    """
    bits = math.log2(max(n / window, 1))
    found = (1 - math.acos(threshold) / math.pi) ** bits
    return max(PASSES, math.ceil(math.log(1 - RECALL) / math.log1p(-found))) if found < 1 else PASSES


def sign_bits(v: np.ndarray, p: int) -> np.ndarray:
    """Pass p's hash of each row of v."""
    planes = np.random.default_rng((v.shape[1], p)).standard_normal((v.shape[1], BITS))
    return (v @ planes > 0).astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def hashes(nodes: DataFrame, passes: int) -> DataFrame:
    """lane (pass and dimension), hash, node: every vector once for each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1).to_pylist())
            for dim in np.unique(dims).tolist():
                rows = batch.take(pa.array(np.flatnonzero(dims == dim)))
                v = unit(rows.column(2).to_pylist(), dim)
                for p in range(passes):
                    h = sign_bits(v, p)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), dim * 1000 + p)), pa.array(h), rows.column(0)], ["lane", "hash", "node"])

    return nodes.select("node", "dim", "raw").mapInArrow(run, "lane long, hash long, node long")


def places(rows: DataFrame) -> DataFrame:
    """lane, node, place: the rows' places in the order of (lane, hash, node), by a range sort and the partitions' sizes."""
    n = partitions(rows.sparkSession)
    at = rows.repartitionByRange(n, "lane", "hash", "node").sortWithinPartitions("lane", "hash", "node").select("lane", "node", F.monotonically_increasing_id().alias("m"))
    at = written(at.select("lane", "node", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("row")), "order")
    sizes = sorted(at.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row for each partition
    begins, total = {}, 0
    for part, size in sizes:
        begins[part], total = total, total + size
    if not begins:
        return at.select("lane", "node", F.col("row").alias("place"))
    begin = F.create_map(*(F.lit(x).cast("long") for kv in begins.items() for x in kv))
    return at.select("lane", "node", (begin[F.col("part")] + F.col("row")).alias("place"))


def window_pairs(nodes: DataFrame, threshold: float, passes: int, window: int) -> DataFrame:
    """a, b: pairs that stand within a window of each other in some pass and whose cosine reaches the threshold."""
    n = partitions(nodes.sparkSession)
    at = places(hashes(nodes, passes))
    chunk = F.floor(F.col("place") / CHUNK)
    chunks = F.when(F.col("place") % CHUNK >= CHUNK - window, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    rows = at.join(nodes.select("node", "dim", "raw"), "node").select(F.explode(chunks).alias("chunk"), "place", "lane", "node", "dim", "raw")

    def compare(rows: list[tuple]) -> pa.RecordBatch | None:
        a, b = [], []
        lanes = np.array([r[2] for r in rows])
        for lane in np.unique(lanes).tolist():
            own = [rows[i] for i in np.flatnonzero(lanes == lane)]
            ids, v = np.array([r[3] for r in own]), unit([r[5] for r in own], own[0][4])
            for k in range(1, min(window, len(own) - 1) + 1):
                hit = np.flatnonzero(np.einsum("ij,ij->i", v[:-k], v[k:]) >= threshold)
                a.append(ids[hit])
                b.append(ids[hit + k])
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        if not len(a):
            return None
        # Of a chunk's pairs those that join its clusters are enough: no more than it has vectors.
        names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        a, b = names[np.array(forest(len(names), at.reshape(2, -1).T))].T
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 1):
            if (out := compare(rows)) is not None:
                yield out

    return rows.repartition(n, "chunk").sortWithinPartitions("chunk", "place").mapInArrow(run, "a long, b long").distinct()


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows whose first columns are equal, from sorted batches."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield held
                key, held = row[:keys], []
            held.append(row)
    if held:
        yield held


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """root, dim, total: sums of unit vectors by cluster."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        root, dim = (np.array(batch.column(k).to_pylist()) for k in (0, 2))
        for d in np.unique(dim).tolist():
            at = np.flatnonzero(dim == d)
            order = at[np.argsort(root[at], kind="stable")]
            names, first = np.unique(root[order], return_index=True)
            for name, x in zip(names.tolist(), np.add.reduceat(unit(batch.column(3).take(pa.array(order)).to_pylist(), d), first), strict=True):
                total[name, d] = total.get((name, d), 0) + x
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total]), pa.array([d for _, d in total], pa.int32()), pa.array([*total.values()], pa.list_(pa.float64()))], ["root", "dim", "total"])


def _sums_of_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """root, pivot: rows of _sums, sorted by root, added up."""
    for rows in _groups(batches, 1):
        total = np.sum([r[2] for r in rows], 0)
        total[0] += not total.any()
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([total.tobytes()], pa.binary())], ["root", "pivot"])


def cluster_links(nodes: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """node, links: the rows linked with a vector of the node, other copies of its own vector left out, over all vectors of its cluster."""
    spark, n = nodes.sparkSession, partitions(nodes.sparkSession)
    most = math.acos(threshold)
    members = nodes.join(roots, "node").select("root", "node", "dim", "raw", "copies")
    # A task's vectors of one cluster are summed before the shuffle.
    sums = members.mapInArrow(_sums, "root long, dim int, total array<double>")
    pivots = sums.repartition(n, "root").sortWithinPartitions("root").mapInArrow(_sums_of_sums, "root long, pivot binary")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root, pivot, node, dim, raw, copies = batch.columns
            angle = np.zeros(batch.num_rows)
            dims = np.array(dim.to_pylist())
            for d in np.unique(dims).tolist():
                at = pa.array(np.flatnonzero(dims == d))
                cos = np.einsum("ij,ij->i", unit(raw.take(at).to_pylist(), d), unit(pivot.take(at).to_pylist(), d))
                angle[at.to_numpy()] = np.arccos(np.clip(cos, -1, 1))
            yield pa.RecordBatch.from_arrays([root, node, dim, raw, copies, pa.array(angle), pa.array(angle <= most / 2 - EPSILON)], ["root", "node", "dim", "raw", "copies", "angle", "core"])

    pivots = written(pivots, "pivots")
    small = (pivots.agg(F.sum(F.length("pivot"))).first()[0] or 0) <= SENT
    placed = members.join(F.broadcast(pivots) if small else pivots, "root").select("root", "pivot", "node", "dim", "raw", "copies")
    placed = written(placed.mapInArrow(angles, "root long, node long, dim int, raw binary, copies long, angle double, core boolean"), "clusters")
    totals = placed.where("core").groupBy("root").agg(F.sum("copies").alias("total"))
    core = placed.where("core").select("root", "node", "copies").join(sent_if_few(totals), "root").select("node", (F.col("total") - F.col("copies")).alias("links"))

    sizes = placed.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(~F.col("core")) / BLOCK).cast("int").alias("edges")).where("edges > 0")
    cut = placed.join(sent_if_few(sizes), "root").withColumn("h", F.xxhash64("node"))
    own = lambda c: F.pmod("h", F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    fringe = cut.where("NOT core").withColumn("f", own("edges")).withColumn("m", every("blocks")).withColumn("side", F.lit(0))
    member = cut.withColumn("m", own("blocks")).withColumn("f", every("edges")).withColumn("side", F.lit(1))
    tasks = fringe.unionByName(member).select("root", "f", "m", "side", "node", "dim", "raw", "copies", "core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            left, right = [r for r in rows if r[3] == 0], [r for r in rows if r[3] == 1]
            if not left or not right:
                continue
            linked = unit([r[6] for r in left], left[0][5]) @ unit([r[6] for r in right], right[0][5]).T >= threshold
            a, b = np.array([r[4] for r in left]), np.array([r[4] for r in right])
            linked &= a[:, None] != b[None, :]
            weight_a, weight_b, core = np.array([r[7] for r in left]), np.array([r[7] for r in right]), np.array([r[8] for r in right])
            of_a, of_b = linked @ weight_b, np.where(core, weight_a @ linked, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, b))), pa.array(np.concatenate((of_a, of_b)).astype(np.int64))], ["node", "links"])

    compared = tasks.repartition(n, "root", "f", "m").sortWithinPartitions("root", "f", "m", "side").mapInArrow(run, "node long, links long")
    return core.unionByName(compared).groupBy("node").agg(F.sum("links").alias("links"))


def near_vectors(df: DataFrame, id: str = "vec_id", embedding: str = "embedding", threshold: float = COSINE, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of df.

    Without `passes`, their number follows from the number of distinct vectors.

    Vectors that are null, empty or zero, or hold a null or non-finite component, and rows without an id,
    link with nothing; each is its own component and kept (a null id gives nulls). Vectors of different
    lengths don't link. Repeated vectors link with each other. Ties have no effect: the order of a pass ends
    with the id. Other columns are not looked at.
    """
    rows = raw_vectors(df, id, embedding).withColumn("k", F.xxhash64("raw")).withColumn("k2", F.xxhash64(F.lit(7), "raw"))
    prints = written(rows.select("vec_id", "k", "k2", F.expr("raw IS NOT NULL AND vec_id IS NOT NULL").alias("links_at_all")), "vector-prints")
    nodes = written(rows.where("raw IS NOT NULL AND vec_id IS NOT NULL").groupBy("k", "k2").agg(F.min("vec_id").alias("node"), F.first("raw").alias("raw"), F.first("dim").alias("dim"), F.count("*").alias("copies")), "vectors")
    passes = passes or passes_for(nodes.count(), threshold, window)
    roots = written(components(window_pairs(nodes, threshold, passes, window)), "clusters-of")
    links = cluster_links(nodes, roots, threshold)
    known = nodes.select("k", "k2", "node", "copies").join(roots, "node", "left").join(links, "node", "left")
    known = known.select("k", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("root"), F.lit(True).alias("links_at_all"))
    out = prints.join(known, ["k", "k2", "links_at_all"], "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn("kept", F.expr("vec_id = component_id"))


def op6_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op6_sorted_projections": op6_sorted_projections}
ORACLES: dict[str, str] = {}
