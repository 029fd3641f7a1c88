"""Templates as data: tables that joins meet, and an index that finds a scan's best one among many.

A template's score for a scan is 0.8 of the likeness of layouts and 0.2 of the likeness of contents. Content
depends on a template by its kinds of blocks and their rules alone, so templates that share these (a signature)
have equal content for a scan and differ by layout. Layouts are points (mean x, share on the left, number of
blocks); the index keeps each signature's points in cells. A cell's distance to a scan gives an exact upper
bound of the scores inside. The cell with the best bound is searched first, and then only cells whose bound
reaches the score found there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.facts import RuleBook

#: Sides of a cell: pixels of mean x, share on the left; numbers of blocks are cut at powers of this.
CELL_X, CELL_LEFT, CELL_N = 25.0, 0.05, 1.2
#: Scans searched at once.
CHUNK = 256
#: Above any rounding error of a bound.
_SLACK = 1e-9


def typed(template: dict) -> list[dict]:
    return [b for b in template["blocks"] or () if b and b["blockType"]]


def features(template: dict) -> dict | None:
    """n, avg_x, avg_y, left_ratio of a template's blocks with boxes; None without."""
    boxes = [b["boundingBox"] for b in template["blocks"] or () if b and b["boundingBox"]]
    if not boxes:
        return None
    xs, n = [(b["left"] + b["right"]) / 2 for b in boxes], len(boxes)
    x = sum(xs) / n
    return {"n": n, "avg_x": x, "left_ratio": sum(v < x for v in xs) / n, "avg_y": sum((b["top"] + b["bottom"]) / 2 for b in boxes) / n}


def kinds(template: dict, book: RuleBook) -> dict[int, int]:
    """How many typed blocks each rule (its number) has."""
    out: dict[int, int] = {}
    for b in typed(template):
        k = book.number(template["rules"].get(b["blockType"]))
        out[k] = out.get(k, 0) + 1
    return out


def centre(block: dict, low: str, high: str) -> float | None:
    """The middle of a block's box between two sides; None without a box."""
    box = block["boundingBox"]
    return (box[low] + box[high]) / 2 if box else None


_ROW = "template_index int, n int, avg_x double, left_ratio double, kinds array<struct<rule:int,times:int>>"


def template_table(spark: SparkSession, templates: list[dict], book: RuleBook) -> DataFrame:
    """A row for each template with blocks: its layout, its rules with their numbers of blocks."""
    rows = []
    for t in templates:
        if t["blocks"]:
            f = features(t) or {"n": None, "avg_x": None, "left_ratio": None}
            rows.append((t["template_index"], f["n"], f["avg_x"], f["left_ratio"], list(kinds(t, book).items())))
    return spark.createDataFrame(rows, _ROW)


def structural(of: Column, n: Column, avg_x: Column, left_ratio: Column) -> Column:
    """Likeness of a scan's layout to a template's: position, share on the left, number of blocks. May be negative; 0 without blocks on a side."""
    position = 1 - F.abs(of["avg_x"] - avg_x) / 1000
    left = 1 - F.abs(of["left_ratio"] - left_ratio)
    count = 1 - F.abs(of["n"] - n) / F.greatest(of["n"], n)
    return F.coalesce((position + left + count) / 3, F.lit(0.0))


def content(best: Column, kinds: Column) -> Column:
    """Mean over a template's typed blocks of the best fit of any block of the scan; best: by rule."""
    times = F.aggregate(kinds, F.lit(0), lambda a, k: a + k["times"])
    total = F.aggregate(kinds, F.lit(0.0), lambda a, k: a + F.coalesce(F.get(best, k["rule"]), F.lit(0.0)) * k["times"])
    return F.when(times > 0, total / times).otherwise(0.0)


@dataclass
class _Cells:
    """Points of all signatures by cell: order of the templates, edges of the cells in it, bounds and signature of each cell."""

    order: np.ndarray
    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray
    signature: np.ndarray


class TemplateIndex:
    def __init__(self, templates: list[dict], book: RuleBook):
        used = [t for t in templates if t["blocks"]]
        found = [features(t) for t in used]
        self.index = np.array([t["template_index"] for t in used], np.int64)
        self.points = np.array([(f["avg_x"], f["left_ratio"], f["n"]) if f else (np.nan,) * 3 for f in found], float).reshape(-1, 3)
        signatures: dict[tuple, int] = {}
        self.signature = np.array([signatures.setdefault(tuple(sorted(kinds(t, book).items())), len(signatures)) for t in used], np.int64)
        #: Content of a signature is its row times the best fits by rule.
        self.weight = np.zeros((len(signatures), len(book.rules)))
        for s, row in zip(signatures, self.weight, strict=True):
            for rule, times in s:
                row[rule] = times / sum(n for _, n in s)
        self.kinds = list(signatures)
        self.cells = self._cells()

    def _cells(self) -> _Cells:
        x, left, n = self.points.T if len(self.points) else np.zeros((3, 0))
        bare = np.isnan(x)
        cell = np.stack((self.signature, np.floor(np.where(bare, -1e6, x) / CELL_X), np.floor(np.where(bare, 0, left) / CELL_LEFT), np.floor(np.log(np.where(bare, 1, n)) / np.log(CELL_N))), axis=1).astype(np.int64)
        order = np.lexsort(cell.T[::-1])
        cell, points = cell[order], self.points[order]
        first = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]).any(axis=1)))) if len(cell) else np.zeros(0, np.int64)
        low, high = (f.reduceat(points, first, axis=0) if len(first) else points for f in (np.minimum, np.maximum))
        return _Cells(order, np.append(first, len(order)), low, high, cell[first, 0] if len(first) else first)

    def contents(self, best: np.ndarray) -> np.ndarray:
        """Content (scans, signatures), summed in the order of the rules as the row-wise column does."""
        out = np.zeros((len(best), len(self.kinds)))
        for s, pairs in enumerate(self.kinds):
            times = sum(n for _, n in pairs)
            for rule, n in pairs:
                out[:, s] += best[:, rule] * n
            if times:
                out[:, s] /= times
        return out

    @staticmethod
    def _layout(scan: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Likeness of layouts (x, share, number), 0 where one is missing."""
        position = 1 - np.abs(scan[..., 0] - point[..., 0]) / 1000
        left = 1 - np.abs(scan[..., 1] - point[..., 1])
        count = 1 - np.abs(scan[..., 2] - point[..., 2]) / np.maximum(scan[..., 2], point[..., 2])
        return np.nan_to_num((position + left + count) / 3, nan=0.0)

    def _bound(self, scan: np.ndarray) -> np.ndarray:
        """The layout that a cell's best place would have, for each scan: exact up to rounding."""
        c = self.cells
        # The number of blocks is likest where it is nearest, inside or at an end of the cell.
        return self._layout(scan[:, None, :], np.clip(scan[:, None, :], c.low[None], c.high[None]))

    def best(self, scan: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(template_index or -1, score) of each scan, and how many templates were scored. scan: rows of mean x, share, number
        (NaN without blocks); best: rows of the best fits by rule. The highest score above 0 wins, the lowest index among equals."""
        index, score, met = np.full(len(scan), -1, np.int64), np.zeros(len(scan)), 0
        for a in range(0, len(scan) if len(self.index) else 0, CHUNK):
            i, s, n = self._chunk(scan[a : a + CHUNK], self.contents(best[a : a + CHUNK]))
            index[a : a + CHUNK], score[a : a + CHUNK], met = i, s, met + n
        return index, score, met

    def _scores(self, scan: np.ndarray, content: np.ndarray, row: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, template, score) of all templates in pairs of rows and cells."""
        size = np.diff(self.cells.edges)[cell]
        which = np.repeat(np.arange(len(row)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + self.cells.edges[cell][which]
        t, r = self.cells.order[at], row[which]
        return r, t, self._layout(scan[r], self.points[t]) * 0.8 + content[r, self.signature[t]] * 0.2

    def _chunk(self, scan: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        bound = self._bound(scan) * 0.8 + content[:, self.cells.signature] * 0.2 + _SLACK
        first = bound.argmax(axis=1)
        r, t, s = self._scores(scan, content, np.arange(len(scan)), first)
        reached = np.full(len(scan), -np.inf)
        np.maximum.at(reached, r, s)
        open_ = bound >= np.maximum(reached, 0)[:, None]
        open_[np.arange(len(scan)), first] = False
        row, cell = np.nonzero(open_)
        r2, t2, s2 = self._scores(scan, content, row, cell)
        r, t, s = np.concatenate((r, r2)), np.concatenate((t, t2)), np.concatenate((s, s2))
        order = np.lexsort((self.index[t], -s, r))
        r, t, s = r[order], t[order], s[order]
        head = np.flatnonzero(np.diff(r, prepend=-1))
        won = s[head] > 0
        index, score = np.full(len(scan), -1, np.int64), np.zeros(len(scan))
        index[r[head][won]], score[r[head][won]] = self.index[t[head][won]], s[head][won]
        return index, score, len(s)
