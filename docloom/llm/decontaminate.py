"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters, digits and non-ASCII bytes, A-Z folded, so punctuation and white space don't
count. A seed is a mask over a few consecutive words that looks at some positions and ignores the others; its
hash is equal for two windows that differ only at ignored positions. Windows of test items and of documents
are hashed under each of a few fixed masks and meet by hash. A hit fixes a diagonal (document position minus
item position), and along it the words are compared: a passage is a stretch that begins and ends with words that
agree, with no more than one word in five substituted, and holds at least `least` words of the item, or the
whole item where that is shorter.

The masks lose no passage. Of n words at most k = n // 5 are substituted, so n - k words agree in at most k + 1
runs; beyond 15 words n - k > 3 (k + 1), and some run has four words. From 5 to 15 words every placing of the
substitutions has been tried (in the tests): where no run has four, one of the masks with a gap fits. Items of
fewer than 5 words may have no substitution at all by that share, and have one hash, of all their words.

Items with the same words are one test, with a number of its own; item ids come back by that number at the end,
so that repeated and missing ids lose nothing. Tests are sent to every task while their hashes are fewer than
`SENT` (counted first, 16 bytes each). Beyond it, a filter of fixed size lets few document windows through,
which meet test hashes in a shuffle join; texts are told apart by two hashes, so that of many copies one is
verified, and every row of such a text gets what it found. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.shared import sent_if_few, table, with_row_ids, written
from docloom.llm.shinglejoin import bloom, in_bloom

#: The seeds; 1 is looked at.
MASKS = ("1111", "11101", "11011", "10111")
#: Items of fewer words have one hash.
SPAN = 5
#: Fewest words of an overlap, and the share of its words that must agree.
LEAST = 13
AGREE = 0.8
#: Test hashes that may be sent to all tasks (16 bytes each).
SENT = 4_000_000
_U = np.uint64


def item_words(bench: DataFrame, text: str = "text", id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """(test, words: binary of uint64 word hashes) of different items with words, and (test, item_id) of every row that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, buf, off in textkit.pieces(batch.column(1)):
                h, woff, _, _ = textkit.word_hashes(buf, off, textkit.MARKS)
                out += [h[a:b].tobytes() for a, b in zip(woff[:-1], woff[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["item_id", "words"])

    rows = bench.select(F.col(id).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(run, "item_id long, words binary").where("length(words) > 0")
    rows = written(rows, "items")
    tests = written(rows.select("words").distinct().select(F.monotonically_increasing_id().alias("test"), "words"), "tests")
    return tests, written(rows.join(tests, "words").select("test", "item_id"), "test-ids")


def seed_hashes(h: np.ndarray) -> Iterator[np.ndarray]:
    """For each mask the hashes of all windows of h."""
    for k, m in enumerate(MASKS):
        n = len(h) - len(m) + 1
        out = np.full(max(n, 0), _U(k * 2654435761 + 17), _U)
        if n > 0:
            for j, c in enumerate(m):
                if c == "1":
                    out = out * _U(0x9E3779B97F4A7C15) + h[j : n + j]
        yield textkit.mix(out)


def test_seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of an item; one shorter than SPAN has one hash, of all its words."""
    if len(words) < SPAN:
        return textkit.combine(words, len(words)), np.zeros(1, np.int64)
    found = list(seed_hashes(words))
    return np.concatenate(found), np.concatenate([np.arange(len(x)) for x in found])


def passage(doc: np.ndarray, at: int, item: np.ndarray, j: int) -> tuple[int, int, int] | None:
    """The longest passage on the diagonal through doc[at], item[j]: (first word of doc, words, words that agree)."""
    lo = -min(at, j)
    hi = min(len(doc) - at, len(item) - j)
    same = doc[at + lo : at + hi] == item[j + lo : j + hi]
    # The best stretch by +1 for a word that agrees and -4 for one that doesn't ends and begins with agreement;
    # 4 = AGREE / (1 - AGREE): a stretch at the least agreement scores 0.
    total = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -AGREE / (1 - AGREE)))))
    ends = np.flatnonzero(same) + 1
    starts = ends - 1
    # Longest stretch with a non-negative score around the hit: earliest start with total <= that of the latest end.
    best = None
    low = np.minimum.accumulate(total[starts]) if len(starts) else np.zeros(0)
    for e in ends[::-1]:
        if best and e - starts[0] <= best[1]:
            break
        k = int(np.searchsorted(-low, -(total[e] + 1e-9)))
        if k < len(starts) and starts[k] < e:
            n = int(e - starts[k])
            if best is None or n > best[1]:
                best = at + lo + int(starts[k]), n, int(same[starts[k] : e].sum())
    if best and best[1] >= min(LEAST, len(item)):
        return best
    return None


def _merged(doc: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges (a to b) of each text and item, in order, those that meet or follow each other made one."""
    order = np.lexsort((a, item, doc))
    doc, item, a, b = doc[order], item[order], a[order], b[order]
    group = np.cumsum(np.concatenate((np.zeros(min(1, len(doc)), np.int64), (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))))
    wide = int(max(b.max(initial=0), -a.min(initial=0))) * 2 + 4
    reach = np.maximum.accumulate(group * wide + b)
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(doc)), bool), (group * wide + a)[1:] > reach[:-1] + 1)))
    return doc[begin], item[begin], a[begin], (reach[np.append(begin[1:], len(doc)) - 1] - (group * wide)[begin]) if len(doc) else b


#: Meetings of windows looked at in one step.
PAIRS = 1 << 20


class Tests:
    """Sorted test hashes with a bit table in front: most windows of a document end there."""

    BITS = 22

    def __init__(self, items: dict[int, np.ndarray]):
        parts = [(h, np.full(len(h), i, np.int64), p) for i, w in items.items() for h, p in (test_seeds(w),)]
        self.items = items
        self.hash, self.item, self.at = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((self.at, self.item, self.hash))
        self.hash, self.item, self.at = self.hash[order], self.item[order], self.at[order]
        # Runs: equal windows of an item that follow each other, as where one word repeats.
        n = len(self.hash)
        goes_on = (self.hash[1:] == self.hash[:-1]) & (self.item[1:] == self.item[:-1]) & (self.at[1:] == self.at[:-1] + 1)
        self.run = np.flatnonzero(np.concatenate((np.ones(min(1, n), bool), ~goes_on)))
        self.run_last = self.at[np.append(self.run[1:], n) - 1] if n else self.at
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[self.hash >> _U(64 - self.BITS)] = True
        self.short = sorted({len(w) for w in items.values() if len(w) < SPAN})

    def windows(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, hashes) of windows that occur among the tests."""
        for s in [*seed_hashes(h), *(textkit.combine(h, n) for n in self.short if n <= len(h))]:
            p = np.flatnonzero(self.table[s >> _U(64 - self.BITS)])
            if len(p):
                k = np.searchsorted(self.hash, s[p])
                ok = self.hash[np.minimum(k, len(self.hash) - 1)] == s[p]
                yield p[ok], s[p[ok]]

    def diagonals(self, h: np.ndarray, woff: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, first place in the texts minus place in the item) at which windows meet, each once, in order. Runs of equal
        windows meet runs in one step, since they meet on all diagonals between two."""
        parts, run_hash = [], self.hash[self.run]
        for p, s in self.windows(h):
            doc = np.searchsorted(woff, p, "right") - 1
            new = np.ones(len(p), bool)
            new[1:] = (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1) | (doc[1:] != doc[:-1])
            begin = np.flatnonzero(new)
            first, last = p[begin], p[np.append(begin[1:], len(p)) - 1] if len(p) else p
            lo, hi = np.searchsorted(run_hash, s[begin], "left"), np.searchsorted(run_hash, s[begin], "right")
            ends = np.cumsum(hi - lo)
            for a in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(a, min(a + PAIRS, int(ends[-1])))
                mine = np.searchsorted(ends, pair, "right")
                k = pair - (ends - (hi - lo))[mine] + lo[mine]
                parts.append(_merged(doc[begin][mine], self.item[self.run[k]], first[mine] - self.run_last[k], last[mine] - self.at[self.run[k]]))
        if parts:
            for d, i, a, b in zip(*(x.tolist() for x in _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))), strict=True):
                for shift in range(a, b + 1):
                    yield d, i, shift

    def hits(self, h: np.ndarray, woff: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, words that agree) of every passage in texts whose word hashes follow each other in h; the longest for each text and item."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, shift in self.diagonals(h, woff):
            words, item = h[woff[d] : woff[d + 1]], self.items[i]
            at = shift - int(woff[d])
            j = max(0, -at)
            room, known = min(len(words) - at - j, len(item) - j), best.get((d, i))
            # Diagonals come in order: one can't be better without room for more, nor behind a whole and equal item.
            if room <= 0 or known and (room < known[1] or known[1] == known[2] == len(item)):
                continue
            got = passage(words, at + j, item, j)
            if got and (known is None or (*got[1:], -got[0]) > (*known[1:], -known[0])):
                best[d, i] = got
        for (d, i), (first, n, agree) in best.items():
            yield d, i, first, n, agree


class Sent:
    """Tests on their way to the tasks: their words; each Python worker, which serves many tasks, builds the hashes once."""

    def __init__(self, words: tuple[tuple[int, bytes], ...]):
        self.words, self.built = words, None

    def __getstate__(self) -> tuple:
        return self.words

    def __setstate__(self, words: tuple) -> None:
        self.words, self.built = words, None

    def tests(self) -> Tests:
        if self.built is None:
            self.built = Tests({i: np.frombuffer(w, _U) for i, w in self.words})
        return self.built


_FOUND = "test long, first_word long, n_words long, n_agree long"


def _out(rows: list[tuple], key: str, kinds: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    names = [c.split()[0] for c in f"{key}, {_FOUND}".split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [*kinds, *[pa.int64()] * 4], strict=True)], names)


def _sent(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """doc_id, test, first_word, n_words, n_agree; tests are sent to every task."""
    sent = docs.sparkSession.sparkContext.broadcast(Sent(tuple(sorted((r.test, bytes(r.words)) for r in tests.collect()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = sent.value.tests()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for a, _, buf, off in textkit.pieces(batch.column(1)):
                h, woff, _, _ = textkit.word_hashes(buf, off, textkit.MARKS)
                rows += [(ids[a + d], *r) for d, *r in tests.hits(h, woff)]
            if rows:
                yield _out(rows, "doc_id long", (pa.int64(),))

    return docs.mapInArrow(run, f"doc_id long, {_FOUND}")


def _joined(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The same rows when test hashes are too many to send."""
    spark, two = docs.sparkSession, ["h1", "h2"]
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(5), "text").alias("h2"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, at = test_seeds(np.frombuffer(w, _U))
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(np.full(len(h), i)), pa.array(at)], ["hash", "test", "at"])

    right = tests.mapInArrow(hashed, "hash long, test long, at long")
    sent = spark.sparkContext.broadcast(bloom(right, "hash"))
    lengths = [r.n for r in tests.select((F.length("words") / 8).cast("int").alias("n")).where(f"n < {SPAN}").distinct().collect()]  # below SPAN different values

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = np.frombuffer(sent.value, np.uint8), set()
        for batch in batches:
            names = [*zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True)]
            fresh = [i for i, x in enumerate(names) if not (x in seen or seen.add(x))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            for a, _, buf, off in textkit.pieces(batch.column(2)):
                h, woff, _, _ = textkit.word_hashes(buf, off, textkit.MARKS)
                for s in [*seed_hashes(h), *(textkit.combine(h, n) for n in lengths if n <= len(h))]:
                    p = np.flatnonzero(in_bloom(wanted, s.astype(np.int64)))
                    d = np.searchsorted(woff, p, "right") - 1
                    at = pa.array(a + d)
                    yield pa.RecordBatch.from_arrays([pa.array(s[p].astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(p - woff[d])], ["hash", *two, "pos"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, (h1, h2, test, shifts, words) = [], (batch.column(k).to_pylist() for k in range(5))
            for a, _, buf, off in textkit.pieces(batch.column(5)):
                h, woff, _, _ = textkit.word_hashes(buf, off, textkit.MARKS)
                for d in range(len(woff) - 1):
                    w, item = h[woff[d] : woff[d + 1]], np.frombuffer(words[a + d], _U)
                    at, j = max(0, shifts[a + d]), max(0, -shifts[a + d])
                    if at < len(w) and j < len(item) and (got := passage(w, at, item, j)):
                        rows.append((h1[a + d], h2[a + d], test[a + d], *got))
            if rows:
                yield _out(rows, "h1 long, h2 long", (pa.int64(),) * 2)

    met = docs.select(*two, "text").mapInArrow(windows, "hash long, h1 long, h2 long, pos long").join(right, "hash").select(*two, "test", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    met = written(met, "met")
    # A text that met a test, once: the filter lets few others through, and copies fall together before the shuffle.
    one = sifted(docs.select(*two, "text"), bloom(met, "h1")).groupBy(*two).agg(F.first("text").alias("text"))
    found = one.join(met.join(tests, "test"), two).select(*two, "test", "shift", "words", "text").mapInArrow(verify, f"h1 long, h2 long, {_FOUND}")
    best = F.max_by(F.struct("first_word", "n_words", "n_agree"), F.struct("n_words", "n_agree", -F.col("first_word")))
    found = written(found.groupBy(*two, "test").agg(best.alias("b")).select(*two, "test", "b.*"), "passages")
    return docs.select("doc_id", *two).join(sent_if_few(found), two).select("doc_id", "test", "first_word", "n_words", "n_agree")


def sifted(docs: DataFrame, filter: bytes) -> DataFrame:
    """Rows whose first column passes a filter of `bloom`."""
    sent = docs.sparkSession.sparkContext.broadcast(filter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(in_bloom(wanted, batch.column(0).to_numpy())))

    return docs.mapInArrow(run, docs.schema)


def contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, first_word, n_words, n_agree: the longest passage that each document row shares with each item row.

    Null and empty texts share nothing, on either side. Documents and items without an id are reported with a
    null id. Rows that repeat, with the same id or another, on either side, are each reported. Of passages of one
    length that with most agreement is told, then the first. An item of fewer than 5 words must occur whole and
    unchanged. Other columns are not looked at.
    """
    tests, ids = item_words(bench, item_text, item_id)
    size = tests.agg(F.sum(F.length("words") / 8 * len(MASKS))).first()[0] or 0
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = (_sent if size <= SENT else _joined)(rows, tests)
    return found.join(sent_if_few(ids), "test").select("doc_id", "item_id", "first_word", "n_words", "n_agree")


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without those that share a passage with a test item."""
    rows, key = with_row_ids(docs)
    gone = written(contaminated(rows, bench, id=key).select(F.col("doc_id").alias("__id")).distinct(), "contaminated")
    return rows.join(sent_if_few(gone), F.col(key) == F.col("__id"), "left_anti").select(*docs.columns)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that a document of the whole table shares with a test item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
ORACLES: dict[str, str] = {}
