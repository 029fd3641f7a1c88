"""Ranked lexical search: NRA (no random access) over impact-sorted lists of document segments.

Documents are indexed where they lie: a segment holds the postings (term, document, occurrences) of up to
`SEGMENT_DOCS` documents for the terms that the queries ask for, packed in one row of a written table, so that
a frequent term has a list in every segment and no list grows with the corpus. Document and occurrence counts
are summed over segments; a posting's impact follows from them.

In a segment each query reads its terms' lists side by side, in falling order of impact and in growing steps.
A document met so far has a score of at least the impacts read, and of at most these and the next impact of
every list in which it wasn't met. One whose upper end is below the k-th best lower end is out; when the sum of
the next impacts is below it too, no unmet document can get in, and the rest of the lists is read for the
documents left alone. A segment ends when their two ends meet in all of them, so that membership, ties and
scores are exact. The best scores of a task's earlier segments count as found already; a task hands on `k`
documents of each query, which a window ranks.

Terms are compared by 64-bit hashes. Queries are taken in blocks of about `BLOCK_CHARS` characters of text, so
that what a task is sent stays bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.shared import sent_if_few, table, with_row_ids, written

TOP = 20
SEGMENT_DOCS = 8192
SEGMENT_POSTINGS = 1 << 21
BLOCK_CHARS = 1 << 24
#: Postings of each list read in the first step; every step reads twice as many as the one before.
STEP = 64
_U = np.uint64
#: A term is a run of ASCII letters and digits and of any other characters beyond ASCII.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A posting's relative impact, (10^9 tf) div (1000 tf + 12 m), is below 2^20, since m is at least 75.
_SHIFT = 20


def term_counts(items: DataFrame) -> DataFrame:
    """item, term (packed uint64, distinct), times (packed int64) of rows item, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, times = [], []
            for _, _, buf, off in textkit.pieces(batch.column(1)):
                h, at, _, _ = textkit.word_hashes(buf, off, SEPARATORS)
                for a, b in zip(at[:-1], at[1:], strict=True):
                    x, n = np.unique(h[a:b], return_counts=True)
                    terms.append(x.tobytes())
                    times.append(n.astype(np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.binary()), pa.array(times, pa.binary())], ["item", "term", "times"])

    return items.select("item", "text").mapInArrow(run, "item long, term binary, times binary")


def segments(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Index segments of rows doc_id, text for a sorted vocabulary of term hashes: id, is_null and n (of the documents
    with terms), term (place in the vocabulary), doc (place in the segment), tf; all packed."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def packed(ids: list, sizes: list, posts: list) -> pa.RecordBatch:
        ids, n = pa.chunked_array(ids, pa.int64()).combine_chunks(), np.concatenate(sizes)
        term, doc, tf = (np.concatenate(x) for x in zip(*posts, strict=True))
        columns = (ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), n.astype(np.int64), term.astype(np.int32), doc.astype(np.int32), tf.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["id", "is_null", "n", "term", "doc", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        ids, sizes, posts, docs, count = [], [], [], 0, 0
        for batch in batches:
            for a, b, buf, off in textkit.pieces(batch.column(1)):
                h, at, _, _ = textkit.word_hashes(buf, off, SEPARATORS)
                n = np.diff(at)
                some = np.flatnonzero(n)
                owner = np.repeat(np.arange(len(some)), n[some])
                place = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                hit = words[place] == h if len(words) else np.zeros(len(h), bool)
                key, tf = np.unique(owner[hit] * len(words) + place[hit], return_counts=True)
                doc, term = np.divmod(key, max(1, len(words)))
                ids.append(batch.column(0).slice(a, b - a).take(pa.array(some)))
                sizes.append(n[some])
                posts.append((term, doc + docs, tf))
                docs, count = docs + len(some), count + len(key)
                if docs >= SEGMENT_DOCS or count >= SEGMENT_POSTINGS:
                    yield packed(ids, sizes, posts)
                    ids, sizes, posts, docs, count = [], [], [], 0, 0
        if docs:
            yield packed(ids, sizes, posts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "id binary, is_null binary, n binary, term binary, doc binary, tf binary")


def statistics(index: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with terms, terms of all documents, documents of each vocabulary term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        df = np.zeros(terms, np.int64)
        for batch in batches:
            for n, term in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.frombuffer(n, np.int64)
                docs, total = docs + len(n), total + int(n.sum())
                df += np.bincount(np.frombuffer(term, np.int32), minlength=terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": [-2, -1, *some.tolist()], "sum": [docs, total, *df[some].tolist()]})

    sums = dict(index.select("n", "term").mapInArrow(run, "term long, sum long").groupBy("term").agg(F.sum("sum")).collect())  # at most a row for each term of the block
    df = np.zeros(terms, np.int64)
    for t, n in sums.items():
        if t >= 0:
            df[t] = n
    return sums.get(-2, 0), sums.get(-1, 0), df


def weights(docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


def nra(lists: list[tuple[np.ndarray, np.ndarray]], size: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores): all documents of a segment of `size` whose score is above 0, among the k best of the segment (ties
    with the last included) and at least `floor`. lists: (documents, impacts falling) of each term; sums stay below 2^53."""
    low, seen, alive = np.zeros(size), np.zeros((size, len(lists)), bool), np.zeros(size, bool)
    at, ahead = [0] * len(lists), np.array([g[0] if len(g) else 0 for _, g in lists], float)
    step, unmet = STEP, True  # unmet: documents not met yet may still get in
    while True:
        for t, (docs, gains) in enumerate(lists):
            a = at[t]
            if a == len(docs):
                continue
            b = at[t] = min(len(docs), a + step)
            d, g = docs[a:b], gains[a:b]
            if unmet:
                alive[d] = True
            else:
                mine = alive[d]
                d, g = d[mine], g[mine]
            low[d] += g
            seen[d, t] = True
            ahead[t] = gains[b] if b < len(docs) else 0
        who = np.flatnonzero(alive)
        have, more = low[who], ~seen[who] @ ahead
        best = max(floor, 1, np.partition(have, -k)[-k] if len(who) >= k else 0)
        stay = have + more >= best
        alive[who[~stay]] = False
        unmet = unmet and ahead.sum() >= best
        if not unmet and not more[stay].any():
            return who[stay], have[stay].astype(np.int64)
        step *= 2


def ranked_in_tasks(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], docs: int, total: int, weight: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score: the k best documents of each query in each task. queries: (item, places of its terms, times of each)."""
    sent = index.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = sent.value
        found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                id, null, n, term, doc, tf = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, bool, np.int64, np.int32, np.int32, np.int32), strict=True))
                m = 75 + 25 * n * docs // total
                tf = tf.astype(np.int64)
                part = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
                order = np.argsort((term.astype(np.int64) << _SHIFT) - part, kind="stable")
                doc, part = doc[order], part[order]
                ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(weight)))))
                for item, places, times in queries:
                    lists = [(doc[ends[p] : ends[p + 1]], part[ends[p] : ends[p + 1]] * (c * weight[p])) for p, c in zip(places.tolist(), times.tolist(), strict=True) if ends[p] < ends[p + 1] and weight[p]]
                    if not lists:
                        continue
                    s, x, i = old = found.get(item, (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)))
                    d, score = nra(lists, len(id), k, int(s[-1]) if len(s) == k else 0)
                    if len(d):
                        s, x, i = (np.concatenate(y) for y in zip(old, (score, null[d], id[d]), strict=True))
                        best = np.lexsort((i, x, -s))[:k]
                        found[item] = s[best], x[best], i[best]
        for item, (s, x, i) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(s), pa.int64()), pa.array(i, pa.int64(), mask=x), pa.array(s, pa.int64())], ["item", "doc_id", "score"])

    return index.select("id", "is_null", "n", "term", "doc", "tf").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, text: str = "text", id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (all, if fewer have a score above 0) for each row of items.

    Equal scores are ranked by ascending id, null ids last. Every row of docs is ranked, rows that repeat an id too; every
    row of items is a query of its own, with repeated and null item_ids. Null texts and texts without terms have no
    result and are found by none; they don't count as documents. Empty tables give no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    rows, row = with_row_ids(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")), "item_id")
    rows = rows.select(F.col(row).cast("long").alias("item"), "item_id", "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, out = max(1, math.ceil(chars / BLOCK_CHARS)), None
    for block in range(blocks):
        asked = term_counts(rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)).collect()  # a block of bounded size
        asked = [(r["item"], np.frombuffer(r["term"], _U), np.frombuffer(r["times"], np.int64)) for r in asked]
        vocabulary = np.unique(np.concatenate([t for _, t, _ in asked])) if asked else np.zeros(0, _U)
        index = written(segments(docs, vocabulary), "segments")
        n, total, df = statistics(index, len(vocabulary))
        queries = [(item, np.searchsorted(vocabulary, t), times) for item, t, times in asked]
        part = ranked_in_tasks(index, queries, n, total, weights(n, df), k)
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = out.withColumn("rank", rank).where(F.col("rank") <= k)
    names = sent_if_few(written(rows.select("item", "item_id"), "items"))
    return best.join(names, "item").select("item_id", "rank", "doc_id", "score")


def op11_nra_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op11_nra_search": op11_nra_search}
ORACLES = {
    "op11_nra_search": f"""
WITH asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark), words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
posts AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM posts, totals GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total))))) AS BIGINT) AS score
  FROM asked JOIN posts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY ALL
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
}
