"""Scans judged in numpy, an Arrow batch at a time.

Blocks come as rows, those of a scan one after the other and in order, as a generator yields them; whole scans are
taken from the batches, whatever their size, and no row is shuffled. For each scan this tells its layout and the best
fit of its blocks by rule, its best template (by the index), and for each typed block of that template the block that
fits it best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from docloom.operators.facts import RuleBook
from docloom.operators.templates import TemplateIndex, centre, typed

#: Pairs of a template's block and a scan's block that are compared at once.
PAIRS = 1_000_000


def whole_scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that begin and end with a scan: at a row whose pos is 0, or null for a scan without blocks."""
    waiting: list[pa.RecordBatch] = []
    joined = lambda: pa.Table.from_batches(waiting).combine_chunks().to_batches(max_chunksize=None)[0]
    for batch in batches:
        begins = np.flatnonzero(batch.column("pos").fill_null(0).to_numpy(zero_copy_only=False) == 0)
        if len(begins):
            waiting.append(batch.slice(0, begins[-1]))
            if any(b.num_rows for b in waiting):
                yield joined()
            waiting, batch = [], batch.slice(begins[-1])
        waiting.append(batch)
    if any(b.num_rows for b in waiting):
        yield joined()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of several ranges, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Scans:
    """The scans of a batch of rows scan_id, pos, x, y, seen (whether there is a text), facts."""

    def __init__(self, rows: pa.RecordBatch, rules: int):
        pos = rows.column("pos")
        at = pos.fill_null(0).to_numpy(zero_copy_only=False)
        self.start = np.flatnonzero(at == 0)
        self.size = np.diff(self.start, append=rows.num_rows)
        if not np.array_equal(at, np.arange(rows.num_rows) - np.repeat(self.start, self.size)):
            raise RuntimeError("blocks of a scan are not in order")
        self.id = rows.column("scan_id").take(pa.array(self.start))
        self.empty = pos.is_null().to_numpy(zero_copy_only=False)[self.start]
        self.x, self.y = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
        self.placed = rows.column("x").is_valid().to_numpy(zero_copy_only=False) & rows.column("y").is_valid().to_numpy(zero_copy_only=False)
        self.seen = rows.column("seen").to_numpy(zero_copy_only=False)
        scores, self.values = rows.column("facts").flatten().flatten()
        self.scores = scores.to_numpy(zero_copy_only=False).reshape(rows.num_rows, rules)
        self.best = np.maximum.reduceat(self.scores, self.start, axis=0)
        self.layout = self._layout()

    def _layout(self) -> np.ndarray:
        """Mean x, share on the left, number of the blocks with boxes; NaN without. Sums go in the order of the blocks."""
        scan, x = np.repeat(np.arange(len(self.start)), self.size)[self.placed], self.x[self.placed]
        n = np.bincount(scan, minlength=len(self.start))
        with np.errstate(all="ignore"):
            mean = np.bincount(scan, x, len(self.start)) / n
            left = (x < mean[scan]) | (np.isnan(mean[scan]) & ~np.isnan(x))  # as columns compare: NaN is above all numbers
            return np.stack((mean, np.bincount(scan, left, len(self.start)) / n, np.where(n, n, np.nan)), axis=1)


class Judge:
    """Templates as the tasks need them."""

    def __init__(self, templates: list[dict], book: RuleBook):
        self.rules, self.index = len(book.rules), TemplateIndex(templates, book)
        used = [t for t in templates if t["blocks"]]
        blocks = [typed(t) for t in used]
        self.order = np.argsort(self.index.index, kind="stable")
        self.format, self.format_id = pa.array([t["format"] for t in used], pa.string()), pa.array([t["format_id"] for t in used], pa.int32())
        self.size = np.array([len(b) for b in blocks], np.int64)
        self.start = np.cumsum(self.size) - self.size
        every = [(b, t) for t, bs in zip(used, blocks, strict=True) for b in bs]
        self.rule = np.array([book.number((t["rules"] or {}).get(b["blockType"])) for b, t in every], np.int64)
        self.kind = pa.array([b["blockType"] for b, _ in every], pa.string())
        #: The place of the first block of a block's kind in its template: the order of fields.
        self.rank = np.array([[b["blockType"] for b in bs].index(b["blockType"]) for bs in blocks for b in bs], np.int64)
        x, y = (pa.array([centre(b, *sides) for b, _ in every], pa.float64()) for sides in (("left", "right"), ("top", "bottom")))
        self.placed = x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False)
        self.x, self.y = x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)

    def best(self, scans: Scans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template_index or -1, score, place of the template here) of each scan; none for a scan without blocks."""
        found, score, _ = self.index.best(scans.layout, scans.best)
        found = np.where(scans.empty, -1, found)
        place = self.order[np.searchsorted(self.index.index, np.maximum(found, 0), sorter=self.order).clip(max=max(len(self.order) - 1, 0))] if len(self.order) else np.zeros(len(found), np.int64)
        return found, score, place

    def _nearest(self, scans: Scans, scan: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, score) of the best block of a scan for a template's block, the first of equals, by fit and nearness."""
        size = scans.size[scan]
        row, pair = _ranges(scans.start[scan], size), np.repeat(np.arange(len(scan)), size)
        b = block[pair]
        with np.errstate(all="ignore"):
            dx, dy = (scans.x[row] - self.x[b]) / 1000, (scans.y[row] - self.y[b]) / 1000
            near = np.maximum(0.0, 1 - np.sqrt(dx * dx + dy * dy))
        near[~(scans.placed[row] & self.placed[b])] = 0.0
        total = scans.scores[row, self.rule[b]] * 0.7 + near * 0.3
        total = np.where(scans.seen[row], np.where(np.isnan(total), np.inf, total), -np.inf)
        top = np.maximum.reduceat(total, np.cumsum(size) - size)
        hit = np.flatnonzero(total == top[pair])
        return row[hit[np.flatnonzero(np.diff(pair[hit], prepend=-1))]], top

    def picked(self, scans: Scans, found: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(scan, template block, value) of the typed blocks of each scan's template whose best block has a score above 0.1 and a value."""
        won = np.flatnonzero(found >= 0)
        size = self.size[place[won]]
        scan, block = np.repeat(won, size), _ranges(self.start[place[won]], size)
        done = np.cumsum(scans.size[scan]) // PAIRS
        parts = [self._nearest(scans, scan[done == k], block[done == k]) for k in np.unique(done)]
        row, top = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0))
        value = scans.values.take(pa.array(row * self.rules + self.rule[block]))
        kept = np.flatnonzero((top > 0.1) & value.is_valid().to_numpy(zero_copy_only=False))
        return scan[kept], block[kept], value.take(pa.array(kept))

    def judged(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """scan_id, empty, template_index, format, format_id, match_score, fields, matched of each scan; where none matches, nulls and
        empty fields."""
        for rows in whole_scans(batches):
            scans = Scans(rows, self.rules)
            found, score, place = self.best(scans)
            none = found < 0
            scan, block, value = self.picked(scans, found, place)
            ends = lambda at: pa.array(np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(found))))).astype(np.int32))
            # Of one kind the last value counts.
            order = np.lexsort((np.arange(len(scan)), self.rank[block], scan))
            s, r = scan[order], self.rank[block[order]]
            last = order[np.append((s[1:] != s[:-1]) | (r[1:] != r[:-1]), True)] if len(order) else order
            fields = pa.MapArray.from_arrays(ends(scan[last]), self.kind.take(pa.array(block[last])), value.take(pa.array(last)))
            matched = pa.ListArray.from_arrays(ends(scan), self.kind.take(pa.array(block)))
            of = lambda column: column.take(pa.array(place, mask=none))
            arrays = [scans.id, pa.array(scans.empty), pa.array(found.astype(np.int32), mask=none), of(self.format), of(self.format_id), pa.array(score, mask=none), fields, matched]
            yield pa.RecordBatch.from_arrays(arrays, ["scan_id", "empty", "template_index", "format", "format_id", "match_score", "fields", "matched"])

    def chosen(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """scan_id, template_index, score of the scans that a template fits."""
        for rows in whole_scans(batches):
            scans = Scans(rows, self.rules)
            found, score, _ = self.best(scans)
            won = np.flatnonzero(found >= 0)
            yield pa.RecordBatch.from_arrays([scans.id.take(pa.array(won)), pa.array(found[won].astype(np.int32)), pa.array(score[won])], ["scan_id", "template_index", "score"])


def measured(rules: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """scan_id, avg_x, left_ratio, n (null without boxes), __best (best fit of any block, by rule) of each scan."""
    for rows in whole_scans(batches):
        scans = Scans(rows, rules)
        bare = np.isnan(scans.layout[:, 2])
        x, left, n = scans.layout.T
        best = pa.ListArray.from_arrays(pa.array(np.arange(len(bare) + 1, dtype=np.int32) * rules), pa.array(scans.best.ravel()))
        yield pa.RecordBatch.from_arrays([scans.id, pa.array(x, mask=bare), pa.array(left, mask=bare), pa.array(np.where(bare, 0, n).astype(np.int32), mask=bare), best], ["scan_id", "avg_x", "left_ratio", "n", "__best"])
