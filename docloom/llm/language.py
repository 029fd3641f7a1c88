"""Language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text recognises every substring of it. A text is parsed
greedily: the longest match from where the last phrase ended is the next phrase. A text in the language of
the automaton falls into few long phrases; the language with the fewest phrases, normalised by the logarithm
of its labelled text's length, wins.

Letters are lower-cased, everything else counts as a space. Whole texts are parsed, in stretches of 1,024
characters (a stretch begins a new phrase), so that thousands of stretches advance one character at a time
through a transition table, for all languages at once. All letters of the labelled text are told apart.

Labelled text is a bounded sample: at most `SAMPLE_DOCS` documents of a language, shorter ones than
`SAMPLE_LENGTH` first, by the hash of their id, together at most `SAMPLE_CHARS` characters.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.shared import residue, sent_if_few, table, with_row_ids, written

SAMPLE_DOCS = 24
SAMPLE_LENGTH = 4000
SAMPLE_CHARS = 16_000
STRETCH = 1024
#: Stretches in one pass over the table.
LANES = 1024
#: Characters parsed side by side; memory of a task follows it.
SLICE = 1_000_000
#: Letters with a column in the transition table.
DENSE = 250


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton; state 0 is none, 1 the root."""
    go: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in symbols:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if not p:
            link[new] = 1
        elif length[q := go[p][c]] == length[p] + 1:
            link[new] = q
        else:
            copy = len(go)
            go.append(dict(go[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            while p and go[p].get(c) == q:
                go[p][c] = copy
                p = link[p]
            link[q] = link[new] = copy
        last = new
    return go


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Model:
    """Automata of all languages in one transition table, and the table of symbols.

    The `DENSE` most frequent letters have a column each in the table; transitions by other letters, in scripts of
    thousands, are sorted keys that are searched."""

    def __init__(self, texts: dict[str, str], rows: dict[str, int] | None = None):
        self.languages = sorted(texts, key=lambda k: (-(rows or {}).get(k, 0), k))
        is_letter, lower = letters(), {k: t.lower() for k, t in texts.items()}
        counts = Counter(c for t in lower.values() for c in t if c.isalpha())
        known = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
        # Symbols: 0 an unseen letter, 1 anything that is no letter, then letters with a column; the next pads a stretch; then all other letters.
        self.width = min(len(known), DENSE) + 3
        self.symbol = np.where(is_letter, 0, 1).astype(np.uint8 if len(known) <= DENSE else np.int32)
        for i, c in enumerate(known):
            self.symbol[ord(c)] = i + 2 if i < DENSE else i + 3
        self.letter, self.symbols = is_letter, len(known) + 3
        tables, keys, ends, self.base, self.weight, at = [], [], [], [], [], 0
        for k in self.languages:
            s = self.symbol[code_points(lower[k])]
            states = automaton(s[s > 0].tolist())
            go = np.zeros((len(states), self.width), np.int32)
            for i, of in enumerate(states):
                for c, to in of.items():
                    if c < self.width:
                        go[i, c] = to
                    else:
                        keys.append((at + i) * self.symbols + c)
                        ends.append(to)
            go[1:, -1] = np.arange(1, len(go))
            tables.append(go)
            self.base.append(at)
            self.weight.append(math.log2(max(2, len(s))))
            at += len(go)
        self.go = np.concatenate(tables).astype(np.uint16 if max(map(len, tables), default=0) < 65536 else np.int32).ravel() if tables else np.zeros(0, np.uint16)
        order = np.argsort(np.array(keys, np.int64))
        self.rare, self.rare_to = np.array(keys, np.int64)[order], np.array(ends, np.int32)[order]

    def rare_steps(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where states of each language (languages, n) get by letters c (n) without a column; 0 is nowhere."""
        key = (np.array(self.base, np.int64)[:, None] + state) * self.symbols + c
        k = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
        return np.where(self.rare[k] == key, self.rare_to[k], 0)

    def phrases(self, stretches: np.ndarray) -> np.ndarray:
        """(languages, stretches): phrases of each column of symbols (steps, stretches)."""
        steps, n = stretches.shape
        width, base = self.width, np.array(self.base, np.int64)[:, None] * self.width
        state = np.ones((len(base), n), np.int64)
        count = np.zeros((len(base), n), np.int32)
        open = np.zeros((len(base), n), bool)
        for c in stretches.astype(np.int64):
            rare = np.flatnonzero(c >= width) if len(self.rare) else ()
            at = base + (np.where(c < width, c, 0) if len(rare) else c)
            new = self.go.take(state * width + at)
            again = self.go.take(at + width)  # the same character from the root; one that is never seen is a phrase of its own
            if len(rare):
                new, again = new.astype(np.int64), again.astype(np.int64)
                new[:, rare] = self.rare_steps(state[:, rare], c[rare])
                again[:, rare] = self.rare_steps(np.ones((len(base), len(rare)), np.int64), c[rare])
            ended = new == 0
            lone = ended & (again == 0)
            count += ended & open
            count += lone
            state = np.where(ended, np.maximum(again, 1), new).astype(np.int64)
            open |= c != width - 1
            open &= ~lone
        return count + open

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """((texts, languages) phrases x log n / characters, letters of each text)."""
        points = code_points("".join(t := [x.lower() for x in texts]))
        size = np.array([len(x) for x in t])
        off = np.concatenate(([0], np.cumsum(size)))
        symbols = self.symbol[points]
        seen = np.concatenate(([0], np.cumsum(self.letter[points])))
        pieces = -(-size // STRETCH)
        text = np.repeat(np.arange(len(t)), pieces)
        first = off[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        n = np.minimum(STRETCH, off[text + 1] - first)
        order = np.argsort(-n, kind="stable")
        total = np.zeros((len(t), len(self.languages)))
        for a in range(0, len(order), LANES):
            some = order[a : a + LANES]
            steps = int(n[some].max())
            grid = first[some][None, :] + np.arange(steps)[:, None]
            padded = np.where(np.arange(steps)[:, None] < n[some][None, :], symbols[np.minimum(grid, len(symbols) - 1)], self.width - 1)
            np.add.at(total, text[some], self.phrases(padded).T)
        return total * np.array(self.weight) / np.maximum(size, 1)[:, None], seen[off[1:]] - seen[off[:-1]]


def learn(docs: DataFrame) -> Model:
    """The model from documents with a language whose crc32(doc_id) mod 4 is not 2."""
    rows = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").where(residue("doc_id", 4) != 2)
    order = Window.partitionBy("lang").orderBy("over", F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang", F.greatest(F.length("text") - SAMPLE_LENGTH, F.lit(0)).alias("over")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_DOCS).select("doc_id", "lang", "n")
    got = rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "n", "text").collect()  # at most SAMPLE_DOCS a language
    texts: dict[str, str] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.n, r.text)):
        texts[r.lang] = (texts.get(r.lang, "") + " " + r.text)[:SAMPLE_CHARS]
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    return Model(texts, counts)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score of every row; `keep`: columns that are passed on in front."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            column, a = batch.column(batch.num_columns - 1), 0
            sizes = np.array([0 if x is None else x for x in pa.compute.utf8_length(column).to_pylist()])
            while a < batch.num_rows:
                b = max(a + 1, a + int(np.searchsorted(np.cumsum(sizes[a:]), SLICE, "right")))
                h, n = model.entropies([t or "" for t in column.slice(a, b - a).to_pylist()])
                if not model.languages:
                    best, score = np.full(len(n), -1), np.zeros(len(n))
                else:
                    ranked = np.sort(h, 1)
                    best = np.where(n > 0, np.argmin(h, 1), -1)
                    score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12) if h.shape[1] > 1 else np.ones(len(n))
                    score = np.where(n > 0, np.clip(score, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), pa.array(names[best].tolist(), pa.string()), pa.array(np.round(score, 9))], [*batch.schema.names[:-1], "lang_pred", "score"])
                a = b

    rows = docs.select(*(F.col(c) for c in keep), F.col(text).alias("__text"))
    kinds = dict(docs.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double"]))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    `und` with score 0 if the text is null or has no letter, or if nothing could be learned. The score is one
    less the ratio of the fewest normalised phrases to the second fewest; with one language, 1. Ties go to the
    language with more labelled rows. A null id counts as not held out. Repeated rows are each predicted; columns other
    than doc_id, text and lang are not looked at, and lang only for learning.
    """
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(docs.select("doc_id", "text", "lang")), keep=("doc_id",))
    return found.select("doc_id", F.coalesce(residue("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def in_a_language(docs: DataFrame) -> DataFrame:
    """docs without those that have no language (`und`). Only ids of such rows come back from the workers, no text."""
    rows, key = with_row_ids(docs)
    gone = written(predict(rows, learn(docs), keep=(key,)).where("lang_pred = 'und'").select(F.col(key).alias("__id")), "no-language")
    return rows.join(sent_if_few(gone), F.col(key) == F.col("__id"), "left_anti").select(*docs.columns)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
