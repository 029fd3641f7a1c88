"""Mixing sources to target weights by the cube method.

A source's target over its size is the number of copies r that each of its documents gets on average. Every
document is taken floor(r) times, and once more with inclusion probability r - floor(r). The extra copies are
drawn by the cube method: inclusion probabilities of a source are a point of a cube; it is moved through the
null space of two balancing constraints, the number of documents and the number of words, until a corner is
reached but for at most two coordinates. So a source's taken words equal its target but for at most two
documents.

The flight runs in blocks of about `BLOCK` documents of one source, in parallel; what a block leaves undecided
(two documents at most) meets the rest of other blocks of its source in the next round. Rounds go on while a
source has more than one block, three for 10^10 documents. The landing, with two documents at most for each
source, drops the constraint on words first, then the one on documents. Random numbers are seeded by the
documents of a block, so reruns agree, however the rows lie.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.shared import WORD, sent_if_few, table, with_row_ids, written

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BLOCK = 2000
#: Equal rows that are numbered in one task.
RUN = 10_000


def flight(sizes: list[float], p: list[float], rng: np.random.Generator, land: bool = False) -> list[float]:
    """Inclusion probabilities after a flight: 0 or 1, but for at most two coordinates, or for none if it lands.

    Three undecided coordinates at a time move along the null vector of (their sizes, ones)."""
    out, near = list(p), 1e-9
    active: list[int] = []

    def settle(u: list[float]) -> None:
        up = min(((1 - out[k]) / x if x > 0 else out[k] / -x) for k, x in zip(active, u, strict=True) if x)
        down = min((out[k] / x if x > 0 else (1 - out[k]) / -x) for k, x in zip(active, u, strict=True) if x)
        step = up if rng.random() * (up + down) < down else -down
        for k, x in zip(active, u, strict=True):
            v = out[k] + step * x
            out[k] = 0.0 if v < near else 1.0 if v > 1 - near else v
        active[:] = [k for k in active if 0 < out[k] < 1]

    for i, v in enumerate(out):
        if not 0 < v < 1:
            continue
        active.append(i)
        while len(active) == 3:
            a, b, c = (sizes[k] for k in active)
            u = [b - c, c - a, a - b]
            scale = max(map(abs, u))
            settle([x / scale for x in u] if scale else [1.0, -1.0, 0.0])
    if land:
        if len(active) == 2:
            settle([1.0, -1.0])
        for k in active:
            out[k] = float(rng.random() < out[k])
    return out


def source_targets(rows: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target: one row for each source.

    Targets share the total by weight, none above `most` times its source's size. With sources in the order
    of that bound over weight, cutting off the first k leaves a level (what is left of the total over the
    weights left) that rises while the cut ones were above their bound and falls after, so the largest is it."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("bound", F.col("source_size") * float(most)).withColumn("ratio", F.col("bound") / F.col("weight"))
    before = Window.orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return s.select("source", F.col("source_size").cast("long").alias("source_size"), F.greatest(F.lit(0.0), F.least("bound", F.col("level") * F.col("weight"))).alias("target"))


def _fly(land: bool, columns: list[str]):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["deal", "size", "doc_id", "k"], kind="stable")
        seed = int(block["deal"].to_numpy(np.int64).astype(np.uint64).sum() % np.uint64(1 << 63))
        block["p"] = flight(block["size"].astype(float).tolist(), block["p"].tolist(), np.random.default_rng((seed, len(block))), land)
        return block[columns]

    return run


def draw(rows: DataFrame) -> DataFrame:
    """rows with p moved to 0 or 1. Columns: source, size, doc_id, deal (a hash), k, p and others."""
    todo, done, schema = rows.where("p > 0 AND p < 1"), [rows.where("NOT (p > 0 AND p < 1)")], rows.schema
    while True:
        blocks = todo.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        most = blocks.agg(F.max("blocks")).first()[0]
        if most is None:
            break
        one = sent_if_few(written(blocks.withColumnRenamed("source", "of").withColumnRenamed("blocks", "n_blocks"), "blocks"))
        cut = todo.join(one, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("deal", F.lit(most)), "n_blocks")).select(*rows.columns, "block")
        flown = written(cut.groupBy("source", "block").applyInPandas(_fly(most == 1, rows.columns), schema), "flight")
        done.append(flown.where("NOT (p > 0 AND p < 1)"))
        todo = flown.where("p > 0 AND p < 1")
        if most == 1:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, h) with deal, a hash that also tells equal rows apart by a number: they are
    counted, and spread again by runs of `RUN` numbers, so that many equal rows are no group of one task."""
    runs = written(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("n")), "sizes").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long"))))
    alone = runs.where("n = 1").withColumn("k", F.lit(0).cast("long"))
    many = runs.where("n > 1").repartition("h", "run").withColumn("k", F.explode(F.sequence("run", F.least(F.col("run") + RUN, F.col("n")) - 1)))
    deal = F.when(F.col("k") == 0, F.col("h")).otherwise(F.xxhash64("h", "k"))
    return alone.unionByName(many).select("doc_id", "source", "size", "h", deal.alias("deal"), "k")


def mix(docs: DataFrame, text: str = "text", id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (= copies x size) for every row of docs.

    Null and empty texts have size 0 and are taken 0 words; a null source is a source of its own, last in
    order. Repeated rows, with the same id or another, are drawn one by one. Without any word all targets are
    0. Other columns are not looked at.
    """
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(text), F.col(id)).alias("h"))
    rows = numbered(rows)
    targets = written(source_targets(rows).withColumnRenamed("source", "of"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # A row a source: sent while few, so that a source with most of the documents is no key of a shuffle.
    joined = rows.join(sent_if_few(targets), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rate)
    joined = joined.withColumn("whole", F.floor("rate").cast("long")).withColumn("p", F.when(F.col("size") == 0, 0.0).otherwise(F.col("rate") - F.floor("rate")))
    drawn = draw(joined.select("doc_id", "source", "size", "h", "deal", "k", "source_size", "target", "whole", "p"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.round("p").cast("long"))
    return drawn.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; documents that it takes no time, or that have no words, are left out."""
    rows, key = with_row_ids(docs)
    taken = written(mix(rows, id=key).where("copies > 0").select(F.col("doc_id").alias("__id"), "copies"), "taken")
    joined = rows.join(sent_if_few(taken), F.col(key) == F.col("__id"))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def op4_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_cube_mixing": op4_cube_mixing}
ORACLES: dict[str, str] = {}
