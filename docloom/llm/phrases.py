"""Phrase collocation mining: multikey three-way quicksort of suffixes, to a depth of five words.

1. Words of every language are counted (combined in the tasks first). A word seen less than `LEAST` times is in
   no frequent phrase; the others get numbers, which are sent to the tasks while they are few (`VOCABULARY`);
   beyond that words go by their 64-bit hashes and none is left out here.
2. Every place in a piece of text with two or more such words begins a suffix of at most five. Equal suffixes of
   a task are counted together first, so a passage that repeats everywhere is a row a task. Suffixes are
   routed by their leading words to ranges of the order of all suffixes; the range ends come from a bounded
   sample and decide nothing but balance. A suffix that is itself a range end, perhaps of several ranges, is dealt
   among these.
3. A range is sorted by a three-way quicksort on one word after the other, run on all its open partitions at once:
   the partition equal to its pivot goes one word deeper, and its size is the count of the phrase so far; a partition
   smaller than `LEAST` is abandoned. Those at the edge of a range, which may go on in the next, are handed on
   whatever their size and added up.
4. Scores come from joins of phrases with the counts of their parts, in exact decimals.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm import textkit
from docloom.llm.shared import partitions, sent_if_few, table, written

DEPTH = 5
LEAST = 100
TOP = 2000
#: Words that are sent to the tasks as a dictionary.
VOCABULARY = 2_000_000
#: Suffixes gathered in a task before equal ones are counted together, and distinct words before their counts leave it.
GATHERED = 1 << 20
WORDS_HELD = 1 << 18
#: Bytes of text that are counted at once.
PIECE = 1 << 22
#: Suffixes that a range should hold, and documents and suffixes of the sample that places the ends of ranges.
RANGE = 1 << 20
SAMPLE_DOCS = 4000
SAMPLE = 200_000
#: Exact for counts of up to 17 digits.
SCORE = "1000 * cast(a AS decimal(17,0)) * cast(n AS decimal(17,0)) DIV (cast(l AS decimal(17,0)) * cast(r AS decimal(17,0)))"
PARTS = 32
_U = np.uint64
#: Pieces end at .,;:!? and line ends; words end at blanks and tabs too.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(10, 14)]] = True
SEPARATORS = ENDS.copy()
SEPARATORS[[9, 32]] = True
_NONE = np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, object)


def _with_lang(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, hash, word, n of rows lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (h, n, w) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(w, pa.string()), pa.array(n)], ["lang", "hash", "word", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            kinds, kind = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            for a, b, buf, off in textkit.pieces(batch.column(1), PIECE):
                h, at, start, end = textkit.word_hashes(buf, off, SEPARATORS)
                of = np.repeat(kind[a:b], np.diff(at))
                for k in np.unique(of).tolist():
                    mine = np.flatnonzero(of == k)
                    x, first, n = np.unique(h[mine], return_index=True, return_counts=True)
                    old, sums, words = held.get(kinds[k], _NONE)
                    spot = np.searchsorted(old, x)
                    known = np.append(old, x[-1:] + _U(1))[spot] == x
                    sums[spot[known]] += n[known]
                    # Only words that are new to the task are read out.
                    new = [buf[start[i] : end[i]].tobytes().lower().decode(errors="replace") for i in mine[first[~known]].tolist()]
                    both = np.concatenate((old, x[~known]))
                    order = np.argsort(both, kind="stable")
                    held[kinds[k]] = both[order], np.concatenate((sums, n[~known]))[order], np.concatenate((words, np.array(new, object)))[order]
            if sum(len(h) for h, _, _ in held.values()) > WORDS_HELD:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, hash long, word string, n long").groupBy("lang", "hash").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


class Dictionary:
    """Numbers, from 1, of the frequent words (a table of lang and hash); without one a word's key is its hash. 0 is no key."""

    def __init__(self, words: pa.Table | None):
        self.kind = np.dtype("<u8" if words is None else "<u4")
        self.of: dict[str, tuple[int, np.ndarray]] | None = None
        if words is not None:
            lang, hashes, self.of, self.back = words["lang"].combine_chunks().dictionary_encode(), words["hash"].to_numpy().view(_U), {}, np.zeros(1, _U)
            for k, name in enumerate(lang.dictionary.to_pylist()):
                mine = np.sort(hashes[lang.indices.to_numpy() == k])
                self.of[name] = len(self.back), mine
                self.back = np.concatenate((self.back, mine))

    def keys(self, lang: str, hashes: np.ndarray) -> np.ndarray:
        if self.of is None:
            return hashes
        first, known = self.of.get(lang, (0, hashes[:0]))
        if not len(known):
            return np.zeros(len(hashes), self.kind)
        spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[spot] == hashes, spot + first, 0).astype(self.kind)

    def hashes(self, keys: np.ndarray) -> np.ndarray:
        return (keys if self.of is None else self.back[keys]).astype(_U)


def _packed(rows: np.ndarray) -> np.ndarray:
    """Rows of keys as byte strings that sort as the rows do."""
    return np.ascontiguousarray(rows.astype(rows.dtype.newbyteorder(">"))).view(f"S{rows.dtype.itemsize * rows.shape[1]}").ravel()


def counted(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a matrix of keys, with the sums of their counts."""
    if not len(rows):
        return rows, n
    h = textkit.mix(rows[:, 0].astype(_U))
    for c in range(1, rows.shape[1]):
        h = textkit.mix(h + rows[:, c].astype(_U) + _U(c))
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    if (rows[first][back] != rows).any():  # two rows of one hash: sort the rows themselves
        _, first, back = np.unique(_packed(rows), return_index=True, return_inverse=True)
    return rows[first], np.bincount(back, n, len(first)).astype(np.int64)


def suffixes(lang: str, dictionary: Dictionary, h: np.ndarray, at: np.ndarray, start: np.ndarray, ends_before: np.ndarray) -> np.ndarray:
    """Rows of DEPTH keys, 0 behind the end of a piece or before a word without a key; those of fewer than two words are left out."""
    key = dictionary.keys(lang, h)
    if len(key) < 2:
        return np.zeros((0, DEPTH), dictionary.kind)
    # Words of one text and one piece have one number.
    piece = ends_before[start] + np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.zeros((len(key), DEPTH), dictionary.kind)
    out[:, 0] = key
    open_ = key != 0
    for d in range(1, min(DEPTH, len(key))):
        open_ = open_[: len(key) - d] & (key[d:] != 0) & (piece[d:] == piece[: len(key) - d])
        out[: len(key) - d, d][open_] = key[d:][open_]
    return out[out[:, 1] != 0]


def _gathered(batches: Iterator[pa.RecordBatch], dictionary: Dictionary) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, distinct suffixes, counts) of about GATHERED suffixes at a time."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        kinds, kind = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        # Texts of one language side by side, so that a piece of the batch has one.
        order = np.argsort(kind, kind="stable")
        for k in np.unique(kind).tolist():
            texts = batch.column(1).take(pa.array(order[kind[order] == k]))
            for _, _, buf, off in textkit.pieces(texts):
                h, at, start, _ = textkit.word_hashes(buf, off, SEPARATORS)
                rows = suffixes(kinds[k], dictionary, h, at, start, np.cumsum(ENDS[buf]))
                if len(rows):
                    held.setdefault(kinds[k], []).append(rows)
                size += len(rows)
                if size >= GATHERED:
                    yield from ((lang, *counted(x := np.concatenate(part), np.ones(len(x)))) for lang, part in held.items())
                    held, size = {}, 0
    yield from ((lang, *counted(x := np.concatenate(part), np.ones(len(x)))) for lang, part in held.items())


def range_ends(docs: DataFrame, dictionary: Dictionary, rows: int, places: int, ranges: int) -> dict[str, np.ndarray]:
    """Per language, sorted byte strings at which its ranges end, from about SAMPLE suffixes of about SAMPLE_DOCS of `rows` documents
    with `places` suffixes."""
    share = min(1.0, SAMPLE_DOCS / max(1, rows))
    pick = min(1.0, SAMPLE / max(1, places * share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        for lang, found, n in _gathered(batches, dictionary):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([found[rng.random(len(found)) < pick].tobytes()], pa.binary()), pa.array([int(n.sum())], pa.int64())], ["lang", "rows", "n"])

    found = docs.sample(share, seed=7).mapInArrow(run, "lang string, rows binary, n long").collect()  # a sample of bounded size
    every, out = sum(r["n"] for r in found), {}
    for lang in {r["lang"] for r in found}:
        mine = [r for r in found if r["lang"] == lang]
        rows = np.sort(_packed(np.concatenate([np.frombuffer(r["rows"], dictionary.kind).reshape(-1, DEPTH) for r in mine])))
        n = max(1, round(ranges * sum(r["n"] for r in mine) / max(1, every)))
        out[lang] = rows[(np.arange(1, n) * len(rows)) // n] if len(rows) else rows
    return out


def routed(docs: DataFrame, dictionary: Broadcast[Dictionary], ends: dict[str, np.ndarray]) -> DataFrame:
    """lang, range, rows, n: packed suffixes and their counts, a partition for each range. Languages that the sample hasn't met have a
    range each among those of the others."""
    total, first = 0, {}
    for lang, edge in sorted(ends.items()):
        first[lang], total = total, total + len(edge) + 1
    total = max(total, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for lang, rows, n in _gathered(batches, dictionary.value):
            edge, base = ends.get(lang, np.zeros(0, "S1")), first.get(lang, zlib.crc32(lang.encode()) % total)
            keys = _packed(rows)
            low, high = np.searchsorted(edge, keys, "left"), np.searchsorted(edge, keys, "right")
            # A suffix that is the end of several ranges may lie in each of them: tasks take turns.
            turn += 1
            to = low + turn % (high - low + 1)
            order = np.argsort(to, kind="stable")
            rows, n, to = rows[order], n[order].astype(np.uint32), to[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(to)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([base + int(to[a])], pa.int32()), pa.array([rows[a:b].tobytes()], pa.binary()), pa.array([n[a:b].tobytes()], pa.binary())], ["lang", "range", "rows", "n"])

    return docs.mapInArrow(run, "lang string, range int, rows binary, n binary").repartitionById(total, F.col("range"))


def sorted_partitions(rows: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of all open partitions at once: yields (a row of each, depth, count) of partitions of equal leading
    words as they are found, of `least` or more, by depths 2 and beyond. `rows` are distinct, 0 behind a suffix's end."""
    edges = np.array([0, len(rows)])
    depth = np.zeros(1, np.int64)  # words in which a partition's rows are known to agree
    while len(rows):
        size = np.diff(edges)
        part = np.repeat(np.arange(len(size)), size)
        value = rows[np.arange(len(rows)), depth[part]]
        # Pivot: the median of a partition's first, middle and last word, one of them and so never beyond all.
        three = np.stack((value[edges[:-1]], value[edges[:-1] + size // 2], value[edges[1:] - 1]))
        pivot = np.sort(three, axis=0)[1]
        side = np.where(value < pivot[part], 0, np.where(value == pivot[part], 1, 2))
        # Stable places by (partition, side).
        slot = part * 3 + side
        order = np.argsort(slot, kind="stable")
        rows, n, slot = rows[order], n[order], slot[order]
        starts = np.flatnonzero(np.diff(slot, prepend=-1))
        kind, weight = slot[starts], np.add.reduceat(n, starts)
        old, equal = kind // 3, kind % 3 == 1
        now = depth[old] + equal
        ended = equal & (pivot[old] == 0)  # suffixes that end here
        told = equal & ~ended & (weight >= least) & (now >= 2)
        if told.any():
            yield rows[starts[told]], now[told], weight[told]
        keep = (weight >= least) & ~ended & (now < DEPTH)
        lens = np.diff(np.append(starts, len(rows)))
        stay = np.repeat(keep, lens)
        rows, n = rows[stay], n[stay]
        edges, depth = np.concatenate(([0], np.cumsum(lens[keep]))), now[keep]


def counts_in_range(rows: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrases as rows with 0 behind them, counts): those of at least `least` in the range, and all that its first or last row begins
    with, which other ranges may have too."""
    rows, n = counted(rows, n)
    if not len(rows):
        return rows, n
    found, sums = [], []
    for row, depth, count in sorted_partitions(rows, n, least):
        found.append(np.where(np.arange(DEPTH) < depth[:, None], row, rows.dtype.type(0)))
        sums.append(count)
    keys = _packed(rows)
    for edge in (rows[np.argmin(keys)], rows[np.argmax(keys)]):
        for d in range(2, DEPTH + 1):
            if edge[d - 1]:
                begun = (rows[:, :d] == edge[:d]).all(axis=1)
                found.append(np.where(np.arange(DEPTH) < d, edge, rows.dtype.type(0))[None])
                sums.append(np.array([n[begun].sum()]))
    found, sums = np.concatenate(found), np.concatenate(sums)
    _, first = np.unique(_packed(found), return_index=True)
    return found[first], sums[first].astype(np.int64)


def phrase_counts(docs: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """lang, hashes (of 2 to DEPTH words), a: all phrases of frequent words (words: lang, hash, n) seen at least `least` times."""
    known, places = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    dictionary = Dictionary(words.select("lang", "hash").toArrow() if known <= VOCABULARY else None)
    ranges = max(partitions(docs.sparkSession), math.ceil(places / RANGE))
    ends, kind = range_ends(docs, dictionary, docs.count(), places, ranges), dictionary.kind
    sent = docs.sparkSession.sparkContext.broadcast(dictionary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[bytes, bytes]]] = {}  # a partition is one range
        for batch in batches:
            for lang, rows, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "rows", "n")), strict=True):
                held.setdefault(lang, []).append((rows, n))
        for lang in list(held):
            rows, n = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held.pop(lang), strict=True), (kind, np.uint32), strict=True))
            found, a = counts_in_range(rows.reshape(-1, DEPTH), n.astype(np.int64), least)
            size = np.concatenate(([0], np.cumsum((found != 0).sum(axis=1))))
            hashes = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(sent.value.hashes(found[found != 0]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), hashes, pa.array(a)], ["lang", "hashes", "a"])

    parts = routed(docs, sent, ends).mapInArrow(count, "lang string, hashes array<long>, a long")
    return parts.groupBy("lang", "hashes").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _joined(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases.

    Null languages are `und`, together with those so named. Null and empty texts have no words. Every row counts, repeated
    rows too. Phrases of one score and count are ranked by their bytes, so no tie is left. A language without a phrase of
    `least` occurrences, and an empty table, have no rows. Other columns are not looked at.
    """
    docs = _with_lang(docs, text, lang)
    counts = written(word_counts(docs), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = written(counts.where(F.col("n") >= least), "frequent")
    found = written(phrase_counts(docs, frequent, least), "found")
    names = sent_if_few(frequent.select("lang", "hash", "word"))
    spelt = found.select("lang", "hashes", "a", F.posexplode("hashes").alias("at", "hash")).join(names, ["lang", "hash"])
    spelt = spelt.groupBy("lang", "hashes", "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))
    spelt = written(spelt.select("lang", "words", F.array_join("words", " ").alias("phrase"), "a"), "phrases")
    # A phrase is dropped if one word more, at either end, loses no occurrence: longer ones then needn't be looked at.
    size = F.size("words")
    longer = spelt.where(size > 2).select("lang", "a", F.explode(F.array(_joined(F.col("words"), F.lit(1), size - 1), _joined(F.col("words"), F.lit(2), size - 1))).alias("phrase")).distinct()
    kept = written(spelt.join(longer, ["lang", "phrase", "a"], "left_anti"), "kept")
    # Counts of parts: words and phrases; as a rule few enough to be sent.
    parts = sent_if_few(written(frequent.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(spelt.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))), "parts"))
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("words"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(F.broadcast(totals), "lang").withColumn("score", F.expr(SCORE))
    worst = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = worst.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
    # First within parts of a language, so that the last ranking meets no more than PARTS * top phrases of each.
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    first = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", place("lang", "part")).where(F.col("rank") <= top)
    return first.withColumn("rank", place("lang")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_suffix_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op12_suffix_phrases": op12_suffix_phrases}
ORACLES = {
    "op12_suffix_phrases": rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, text FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS text FROM documents)
), split AS (SELECT lang, regexp_extract_all(text, '[^\x20\x09]+') AS words FROM pieces),
grams AS (
  SELECT lang, array_to_string(words[i : i + d - 1], ' ') AS phrase, d
  FROM split, unnest(range(1, len(words) + 1)) AS s(i), unnest([1, 2, 3, 4, 5]) AS t(d) WHERE i + d - 1 <= len(words)
), counts AS (SELECT lang, phrase, d, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE d = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, d, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE d >= 2 AND f >= {LEAST}),
inner_parts AS (
  SELECT DISTINCT lang, a, array_to_string(words[i : i + e - 1], ' ') AS phrase
  FROM candidates, unnest([1, 2, 3]) AS s(i), unnest([2, 3, 4]) AS t(e) WHERE e < d AND i + e - 1 <= d
), kept AS (SELECT c.* FROM candidates c ANTI JOIN inner_parts p ON c.lang = p.lang AND c.phrase = p.phrase AND 100 * p.a >= 100 * c.a),
cuts AS (
  SELECT kept.lang, kept.phrase, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score
  FROM kept JOIN totals USING (lang), unnest([1, 2, 3, 4]) AS s(k), counts x, counts y
  WHERE k < kept.d AND x.lang = kept.lang AND x.phrase = array_to_string(words[1 : k], ' ') AND y.lang = kept.lang AND y.phrase = array_to_string(words[k + 1 : kept.d], ' ')
), worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM worst WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}"""
}
