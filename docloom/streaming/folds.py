"""Session folds as functions that can be composed, in numpy over sorted events: no step by row.

A fold takes a run of events, in order of session and time, with the state in which its first session begins;
it returns which events it emits, as what, and the last session's state. A long session is cut into ranges of
time. What a range does to a state it hasn't met yet is a function of that state (`summary`): small, since
counters are small, and since any rate gate that begins inside an interval soon falls into the steps of
another. Applied one after the other, the functions of a session's ranges give each range its first state
(`after`), and all ranges emit at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa

#: Cells of the counter's maps worked on at once.
CELLS = 1 << 20


@dataclass
class Events:
    """Sorted events: us (microseconds), first (whether a session begins), and the columns a fold reads."""

    us: np.ndarray
    first: np.ndarray
    columns: dict[str, pa.Array]

    def slice(self, a: int, b: int) -> Events:
        return Events(self.us[a:b], self.first[a:b], {k: c.slice(a, b - a) for k, c in self.columns.items()})


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    """For every row, where its group ends. starts: first rows of groups, row 0 among them."""
    return np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))


def _next(us: np.ndarray, ends: np.ndarray, wait: int) -> np.ndarray:
    """For every row, the first one of its group at least `wait` later; the number of rows if there is none."""
    low, high = np.arange(1, len(us) + 1), ends.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        early = open_ & (us[np.minimum(middle, len(us) - 1)] - us < wait)
        low, high = np.where(early, middle + 1, low), np.where(open_ & ~early, middle, high)
    return np.where(low < ends, low, len(us))


def gate(us: np.ndarray, starts: np.ndarray, wait: int, last: int | None) -> tuple[np.ndarray, int | None]:
    """(kept, time of the last kept row of the last group): rows at least `wait` after the last kept one of their group.

    `last`: when the first group's last kept row, before these, was. Kept rows are followed by pointers that double."""
    n = len(us)
    jump, at = np.append(_next(us, _ends(starts, n), wait), n), starts
    if last is not None:
        end = starts[1] if len(starts) > 1 else n
        begin = int(np.searchsorted(us[:end], last + wait))
        at = starts[1:] if begin == end else np.append(begin, starts[1:])
    kept = np.zeros(n + 1, bool)
    while len(at):
        kept[at] = True
        more = jump[at]
        more = more[more < n]
        if not len(more):
            break
        at, jump = np.concatenate((at, more)), jump[jump]
    kept = kept[:n]
    tail = np.flatnonzero(kept[starts[-1] :])
    return kept, int(us[starts[-1] + tail[-1]]) if len(tail) else last


def gate_function(us: np.ndarray, wait: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, results): a gate over one group as a function of the time of the last kept row before it. From `last` the result is
    that of the first edge at or after last + wait; past all edges it is `last`. It has an entry for each change of the
    result among rows within `wait` of the first."""
    n = len(us)
    last = _next(us, np.full(n, n), wait)
    last = np.where(last < n, last, np.arange(n))
    for _ in range(max(1, n).bit_length()):
        last = last[last]
    some = min(n, int(np.searchsorted(us, us[0] + wait)) + 1)
    result = us[last[:some]]
    change = np.append(np.flatnonzero(np.diff(result)), some - 1)
    return us[change], result[change]


def apply_gate(function: tuple[np.ndarray, np.ndarray], last: int | None, wait: int) -> int | None:
    edges, results = function
    k = 0 if last is None else int(np.searchsorted(edges, last + wait))
    return last if k == len(edges) else int(results[k])


class RateGate:
    """Keeps an event at least the interval after the last kept one. State: its time."""

    start: Any = None
    reads: tuple[str, ...] = ()
    out: tuple[str, ...] = ()

    def __init__(self, interval_ms: int):
        self.wait = interval_ms * 1000

    def run(self, e: Events, state: Any) -> tuple[np.ndarray, dict[str, pa.Array], Any]:
        kept, last = gate(e.us, _starts(e), self.wait, state)
        return np.flatnonzero(kept), {}, last

    def summary(self, e: Events) -> Any:
        return gate_function(e.us, self.wait)

    def after(self, summary: Any, state: Any) -> Any:
        return apply_gate(summary, state, self.wait)


def _starts(e: Events) -> np.ndarray:
    first = e.first.copy()
    first[0] = True
    return np.flatnonzero(first)


class Feedback:
    """Emits a message that differs from the last emitted one, or comes more than the gap after it. State: (message, time).

    The last emitted message is always that of the event before: if it wasn't emitted, it was equal. So runs of equal
    messages are rate gates of their own; a null message is a run by itself."""

    start: Any = (None, None)
    reads: tuple[str, ...] = ("message",)
    out: tuple[str, ...] = ("message",)

    def __init__(self, gap_ms: int):
        self.wait = gap_ms * 1000 + 1

    def _runs(self, e: Events) -> tuple[np.ndarray, pa.Array]:
        message = e.columns["message"]
        code = message.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new = e.first.copy()
        new[0] = True
        new[1:] |= (code[1:] != code[:-1]) | (code[1:] < 0)
        return np.flatnonzero(new), message

    def run(self, e: Events, state: Any) -> tuple[np.ndarray, dict[str, pa.Array], Any]:
        runs, message = self._runs(e)
        goes_on = state[0] is not None and message[0].as_py() == state[0]
        kept, last = gate(e.us, runs, self.wait, state[1] if goes_on else None)
        at = np.flatnonzero(kept)
        return at, {"message": message.take(pa.array(at))}, (message[len(message) - 1].as_py(), last)

    def summary(self, e: Events) -> Any:
        runs, message = self._runs(e)
        if len(runs) > 1 or message[0].as_py() is None:  # the last run begins inside, whatever came before
            return None, self.run(e, self.start)[2]
        return gate_function(e.us, self.wait), (message[0].as_py(), None)

    def after(self, summary: Any, state: Any) -> Any:
        function, told = summary
        if function is None:
            return told
        return told[0], apply_gate(function, state[1] if state[0] == told[0] else None, self.wait)


class Stability:
    """Counts sharp valid frames up and all others down to 0; from `needed` on a frame is captured, and the count starts again at 0
    (auto) or two lower, at least 1. State: the count.

    Emits "capture", "contour" for each sharp valid frame, "clear" for a frame without a quadrilateral while the count is
    0. With a `final_blurry` mark, a frame that reaches the count but is blurry on the second look lowers it by two."""

    start: Any = 0
    out: tuple[str, ...] = ("kind",)

    def __init__(self, needed: int, auto: bool, final: bool):
        self.needed, self.auto, self.final = needed, auto, final
        self.reads = ("has_quad", "is_valid", "is_blurry", *(["final_blurry"] if final else []))
        n = np.arange(max(needed, 1) + 1)
        up = n + 1
        reached = up >= needed
        #: What a frame does to each count: no or unsharp quadrilateral, sharp, sharp but blurry on the second look.
        self.maps = np.stack((np.maximum(0, n - 1), np.where(reached, 0 if auto else np.maximum(1, up - 2), up), np.where(reached, np.maximum(0, up - 2), up)))

    def _kinds(self, e: Events) -> tuple[np.ndarray, np.ndarray]:
        mark = lambda c: e.columns[c].fill_null(False).to_numpy(zero_copy_only=False)
        sharp = mark("has_quad") & mark("is_valid") & ~mark("is_blurry")
        return np.where(sharp, 1 + (mark("final_blurry") if self.final else np.zeros(len(sharp), bool)), 0), mark("has_quad")

    def _before(self, kind: np.ndarray, first: np.ndarray, state: int) -> tuple[np.ndarray, np.ndarray]:
        """(count before each frame; what all of them do to each count). A session's first frame takes any count as 0."""
        maps = self.maps[kind]
        at = np.flatnonzero(first)
        maps[at] = maps[at, :1]
        step = 1
        while step < len(maps):
            maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
            step *= 2
        before = np.append(state, maps[:-1, state])
        return np.where(first, 0, before), maps[-1]

    def _pieces(self, n: int) -> range:
        return range(0, n, max(1, CELLS // self.maps.shape[1]))

    def run(self, e: Events, state: Any) -> tuple[np.ndarray, dict[str, pa.Array], Any]:
        kind, quad = self._kinds(e)
        before, step = [], self._pieces(len(kind)).step
        for a in self._pieces(len(kind)):
            counts, whole = self._before(kind[a : a + step], e.first[a : a + step], state)
            before.append(counts)
            state = int(whole[state])
        n = np.concatenate(before)
        reached = n + 1 >= self.needed
        capture, contour, clear = (kind == 1) & reached, (kind > 0) & ~((kind == 2) & reached), ~quad & (n <= 1)
        at = np.concatenate([np.flatnonzero(x) for x in (capture, contour, clear)])
        names = np.repeat(["capture", "contour", "clear"], [x.sum() for x in (capture, contour, clear)])
        return at, {"kind": pa.array(names.tolist(), pa.string())}, state

    def summary(self, e: Events) -> Any:
        kind, _ = self._kinds(e)
        whole, step = np.arange(self.maps.shape[1]), self._pieces(len(kind)).step
        for a in self._pieces(len(kind)):
            whole = self._before(kind[a : a + step], np.zeros(len(kind[a : a + step]), bool), 0)[1][whole]
        return whole

    def after(self, summary: Any, state: Any) -> Any:
        return int(summary[state])
