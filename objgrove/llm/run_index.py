"""A run-length index: a run-compressed Burrows-Wheeler transform whose sampled run ends answer the queries.

Rows are sorted by their first MATCH - 1 symbols, and by falling text position where these are equal, so that rows of equal
context are an interval and an interval's last row is its earliest. No run goes on past an interval. Of a run the index
keeps its symbol, the sample of its last row, and the interval that its backward step leads to; of an interval its first
run. Nothing is kept of single rows, so memory follows the runs, however often they are repeated.

Windows of MATCH symbols are streamed through it from right to left. The interval of a window's last MATCH - 1 symbols is
known; its last run of the window's first symbol ends in the earliest row that has the window. That run's sample is the
answer, and its step leads to the next window's interval.
"""

from __future__ import annotations

import numpy as np

MATCH = 50
STEP = 7
DEPTH = MATCH - 1  # STEP, doubled twice, and the rest
END = 0  # ends every segment; bytes are stored one higher


def rows_sorted(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text positions by their first DEPTH symbols, falling where these are equal; the first row of each interval).

    By doubling; rows that are alone in their place are not sorted again.
    """
    n = len(text)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(STEP, np.int64)])
    for i in range(STEP):
        key *= 257
        key += padded[i : i + n]
    order = np.argsort(key)
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    rank, done = np.zeros(n + DEPTH, np.int64), STEP  # a row's rank is the first row of its group, from 1 on
    rank[order] = np.repeat(first, np.diff(np.r_[first, n])) + 1
    del key, k, first
    slots = np.arange(n)
    while True:
        r = rank[order[slots]]
        same = r[1:] == r[:-1]
        slots = slots[np.r_[False, same] | np.r_[same, False]]
        at = order[slots]
        if done == DEPTH or not len(slots):
            break
        step = min(done, DEPTH - done)
        group, key = rank[at], rank[at] * (n + 2) + rank[at + step]
        o = np.argsort(key)
        at, key, group = at[o], key[o], group[o]
        order[slots] = at
        # the first slot of each new group names it
        new = np.r_[True, key[1:] != key[:-1]]
        ranks = slots[np.flatnonzero(new)][np.cumsum(new) - 1] + 1
        rank[at] = ranks
        done += step
    order[slots] = at[np.argsort(rank[at] * (n + 1) - at)]
    return order.astype(np.int32), np.flatnonzero(rank[order] == np.arange(1, n + 1)).astype(np.int32)


class RunIndex:
    """The index of segments, of which each has a value; smallest() gives a window's smallest value."""

    def __init__(self, segments: list[bytes], values: np.ndarray):
        values = np.asarray(values)
        by = np.argsort(values, kind="stable")  # so that an earlier position has no larger value
        segments, values = [segments[i] for i in by.tolist()], values[by]
        raw = np.frombuffer(b"\x00".join(segments) + b"\x00", np.uint8).astype(np.uint16) + 1
        lengths = np.array([len(s) for s in segments], np.int64) + 1
        ends = np.cumsum(lengths) - 1
        raw[ends] = END
        self.n = len(raw)
        order, first = rows_sorted(raw)
        last = raw[order - 1]  # the first position is preceded by the last symbol, an END
        opens = np.zeros(self.n, bool)
        opens[first] = True
        edge = opens | np.r_[True, last[1:] != last[:-1]]
        starts = np.flatnonzero(edge).astype(np.int32)
        sizes = np.diff(starts, append=np.int32(self.n))
        heads, tops = last[starts], order[starts + sizes - 1]
        interval_of, segment_of = _numbers(opens), np.repeat(np.arange(len(ends), dtype=np.int32), lengths)
        # runs by symbol; the rows of smaller symbols and of the same before a run are where its backward step leads
        by = np.argsort(heads, kind="stable")
        leads = interval_of[np.cumsum(sizes[by]) - sizes[by]]
        # intervals whose context runs past its segment have no window, and no window begins before a segment
        at = order[first]
        del order, last, sizes, opens
        whole = ends[segment_of[at]] - at >= DEPTH
        use = whole[interval_of[starts]] & (heads != END)
        kept, run = by[use[by]], _numbers(use)
        self.runs = len(kept)
        #: each interval's first run
        self.first = np.r_[(run + ~use)[_numbers(edge)[first[whole]]], self.runs].astype(np.int32)
        #: by symbol and row: the run's key, the value at its sampled end, and the interval that it leads to
        self.keys = heads[kept].astype(np.int64) * (self.runs + 1) + run[kept]
        self.samples = values[segment_of[tops[kept]]]
        self.leads = _numbers(whole)[leads[use[by]]]
        # intervals by the hash of their context, for windows that no step leads to
        seeds = _grams(raw, DEPTH)[at[whole]]
        by = np.argsort(seeds)
        self.seeds, self.seed_at = seeds[by], by.astype(np.int32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.first, self.keys, self.samples, self.leads, self.seeds, self.seed_at))

    def back(self, symbol: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The last run of a symbol in an interval, as a place among the keys, or -1 where the interval has none."""
        here, base = np.maximum(group, 0), symbol * (self.runs + 1)
        at = np.searchsorted(self.keys, base + self.first[here + 1]) - 1
        found = (group >= 0) & (at >= 0) & (self.keys[np.maximum(at, 0)] >= base + self.first[here])
        return np.where(found, at, -1)

    def smallest(self, patterns: list[bytes], missing: int) -> np.ndarray:
        """The smallest value of the segments that have a window, for every window of every pattern, in order.

        Streams matching statistics of all patterns at once, from their ends. A window that has no match leaves no
        interval to go on from; the next one starts from the contexts' hashes, as a pattern's last window does.
        """
        lengths = np.array([len(p) for p in patterns], np.int64)
        windows = np.maximum(lengths - MATCH + 1, 0)
        first = np.cumsum(windows) - windows
        out = np.full(int(windows.sum()), missing, np.int64)
        text = np.frombuffer(b"".join(patterns), np.uint8).astype(np.int64) + 1
        if not windows.any() or not self.runs:
            return out
        seeds = _grams(text, DEPTH)
        offset = np.cumsum(lengths) - lengths
        live = np.flatnonzero(windows)
        at = windows[live] - 1  # the window that each pattern is at
        group = self._seed(seeds[offset[live] + at + 1])
        while len(live):
            run = self.back(text[offset[live] + at], group)
            hit = run >= 0
            out[first[live[hit]] + at[hit]] = self.samples[run[hit]]
            more = at > 0
            live, at, run = live[more], at[more] - 1, run[more]
            group = self.leads[np.maximum(run, 0)]
            lost = np.flatnonzero(run < 0)
            group[lost] = self._seed(seeds[offset[live[lost]] + at[lost] + 1])
        return out

    def _seed(self, grams: np.ndarray) -> np.ndarray:
        """The interval of a context, or -1."""
        at = np.minimum(np.searchsorted(self.seeds, grams), len(self.seeds) - 1)
        return np.where(self.seeds[at] == grams, self.seed_at[at], -1)


def _numbers(flags: np.ndarray) -> np.ndarray:
    """How many flags there are up to each place, less one."""
    return np.cumsum(flags, dtype=np.int32) - np.int32(1)


def _grams(text: np.ndarray, length: int) -> np.ndarray:
    """The hash of so many symbols from each position on, with ENDs after the text."""
    from objgrove.llm.words import mix, prefix

    n = len(text)
    sums, down = prefix(np.concatenate([text, np.zeros(length, text.dtype)]))
    return mix((sums[length : length + n] - sums[:n]) * down[:n])
