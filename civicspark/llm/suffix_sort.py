"""Suffix sorting by hashes: prefix polynomial hashes and binary search give common extensions in few steps."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
LETTER = _rng.integers(1, 2**63, size=257, dtype=np.uint64) | np.uint64(1)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Contexts:
    """Byte strings around a common column, one per row, with prefix hashes of each row.

    Row i holds its string in the columns from at - left[i] to at + right[i]; bucket[i] groups rows.
    """

    def __init__(self, strings: list[bytes], left: np.ndarray, bucket: np.ndarray, at: int, width: int):
        self.n, self.at, self.width, self.bucket = len(strings), at, width, bucket
        self.left = left.astype(np.int64)
        size = np.fromiter(map(len, strings), dtype=np.int64, count=self.n)
        self.right = size - self.left
        flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        cells = np.arange(width)[None, :]
        inside = (cells >= (at - self.left)[:, None]) & (cells < (at + self.right)[:, None])
        self.text = np.full((self.n, width), 256, dtype=np.int16)
        self.text[inside] = flat
        self.power = powers(width)
        self.prefix = np.zeros((self.n, width + 1), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(0, self.n, 512):  # in parts, so that no second table of this size is held
                part = np.s_[lo : lo + 512]
                np.cumsum(LETTER[self.text[part]] * self.power[None, :width], axis=1, out=self.prefix[part, 1:])

    def same(self, i: np.ndarray, j: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the columns from lo to hi hash alike in rows i and j."""
        p = self.prefix
        with np.errstate(over="ignore"):
            return p[i, hi] - p[i, lo] == p[j, hi] - p[j, lo]

    def common(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Length of the common extension of rows i and j from the column `at` on, or back from it."""
        low = np.zeros(len(i), dtype=np.int64)
        high = np.minimum(self.right[i], self.right[j]) if forward else np.minimum(self.left[i], self.left[j])
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            a = np.full(len(mid), self.at)
            yes = self.same(i[open_], j[open_], a if forward else a - mid, a + mid if forward else a)
            low[open_[yes]] = mid[yes]
            high[open_[~yes]] = mid[~yes] - 1

    def less(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Whether the extension of row i sorts before that of row j; the shorter first, equal ones by row."""
        k = self.common(i, j, forward)
        end_i, end_j = (self.right[i], self.right[j]) if forward else (self.left[i], self.left[j])
        ended = (k == end_i) | (k == end_j)
        column = np.where(ended, 0, self.at + k if forward else self.at - 1 - k)
        by_byte = self.text[i, column] < self.text[j, column]
        return np.where(ended, np.where(end_i == end_j, i < j, end_i < end_j), by_byte)


def sort_rows(c: Contexts, forward: bool) -> np.ndarray:
    """Rows by bucket and then by extension: mergesort, all runs of one level merged at once.

    A row's place in a merged run is its place in its own run and its rank in the sibling run, found by
    binary search; buckets smaller than a level's runs are left alone.
    """
    order = np.argsort(c.bucket, kind="stable")
    sorted_bucket = c.bucket[order]
    first = np.flatnonzero(np.r_[True, sorted_bucket[1:] != sorted_bucket[:-1]]) if c.n else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[first, c.n])
    start, size = np.repeat(first, size), np.repeat(size, size)
    width = 1
    while c.n and width < size.max():
        x = np.flatnonzero(size > width)
        place = x - start[x]
        run = place // width
        even = run % 2 == 0
        pair = start[x] + (run // 2) * 2 * width
        end = start[x] + size[x]
        lo = np.where(even, np.minimum(pair + width, end), pair)
        hi = np.where(even, np.minimum(pair + 2 * width, end), np.minimum(pair + width, end))
        base, rows = lo.copy(), order[x]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            before = c.less(order[mid], rows[open_], forward)
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        new = order.copy()
        new[pair + place % width + (lo - base)] = rows
        order = new
        width *= 2
    return order


def neighbours(c: Contexts, order: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Common extension of each sorted row with the one before it (-1 where a bucket begins), and the buckets where hashes erred.

    Both the extensions and the order of neighbours are verified on the bytes; if all neighbours of a bucket
    are in order, so is the bucket, and the least extension between two rows is what they have in common.
    """
    out = np.full(len(order), -1, dtype=np.int64)
    same = np.flatnonzero(c.bucket[order[1:]] == c.bucket[order[:-1]]) + 1
    i, j = order[same - 1], order[same]
    out[same] = c.common(i, j, forward)
    columns = np.arange(c.at, c.width) if forward else np.arange(c.at - 1, -1, -1)
    end_i, end_j = (c.right[i], c.right[j]) if forward else (c.left[i], c.left[j])
    wrong = np.zeros(len(same), dtype=bool)
    for lo in range(0, len(same), 1024):
        part = np.s_[lo : lo + 1024]
        a, b = c.text[i[part][:, None], columns], c.text[j[part][:, None], columns]
        differ = np.column_stack([a != b, np.ones(len(a), dtype=bool)]).argmax(axis=1)
        shared = np.minimum(differ, np.minimum(end_i[part], end_j[part]))
        ended = (shared == end_i[part]) | (shared == end_j[part])
        at = np.minimum(shared, len(columns) - 1)
        rows = np.arange(len(a))
        by_byte = a[rows, at] < b[rows, at] if len(columns) else np.ones(len(a), dtype=bool)
        by_end = (end_i[part] < end_j[part]) | (end_i[part] == end_j[part]) & (i[part] < j[part])
        wrong[part] = (shared != out[same[part]]) | ~np.where(ended, by_end, by_byte)
    return out, np.unique(c.bucket[j[wrong]])


def _exact(c: Contexts, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """repeats() on the bytes themselves, for buckets in which hashes collide."""
    low, high = np.full(len(rows), -1), np.full(len(rows), -1)
    for s in range(c.at + 1):
        seen: dict[bytes, list[int]] = {}
        for k, r in enumerate(rows):
            if s <= c.left[r] and length - s <= c.right[r]:
                seen.setdefault(c.text[r, c.at - s : c.at - s + length].tobytes(), []).append(k)
        for same in seen.values():
            if len(same) > 1:
                high[same] = s
                low[same] = np.where(low[same] < 0, s, low[same])
    return low, high


def repeats(c: Contexts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) s of each row such that another row of its bucket has the same `length` bytes from column at - s on; -1: none.

    Rows agree on such a string if they agree on s bytes back from the column and on length - s from it
    on. Both suffix orders give classes of rows by neighbours' common extensions, so a string repeats where
    two rows share both classes. Buckets in which hashes collide are compared byte by byte instead.
    """
    low, high = np.full(c.n, -1, dtype=np.int64), np.full(c.n, -1, dtype=np.int64)
    if c.n < 2:
        return low, high
    order = [sort_rows(c, f) for f in (False, True)]
    common, wrong = zip(*(neighbours(c, o, f) for o, f in zip(order, (False, True))))
    wrong = np.union1d(*wrong)
    reach = []
    for o, lcp in zip(order, common):
        best = np.empty(c.n, dtype=np.int64)
        best[o] = np.maximum(lcp, np.r_[lcp[1:], -1])
        reach.append(best)
    hopeful = np.isin(c.bucket, np.setdiff1d(c.bucket[reach[0] + reach[1] >= length], wrong))
    kept = [h[hopeful[h]] for h in order]
    common = [lcp[hopeful[h]] for lcp, h in zip(common, order)]
    rows = np.flatnonzero(hopeful)
    number = np.empty(c.n, dtype=np.int64)
    number[rows] = np.arange(len(rows))
    kept = [number[k] for k in kept]
    classes = [np.empty(len(rows), dtype=np.int64) for _ in range(2)]
    left, right = c.left[rows], c.right[rows]
    for s in range(c.at + 1):
        for side, need in ((0, s), (1, length - s)):
            classes[side][kept[side]] = np.cumsum(common[side] < need)
        fit = np.flatnonzero((left >= s) & (right >= length - s))
        key = classes[0][fit] * (len(rows) + 1) + classes[1][fit]
        by = np.argsort(key, kind="stable")
        twin = np.flatnonzero(key[by[1:]] == key[by[:-1]])
        found = rows[fit[by[np.union1d(twin, twin + 1)]]]
        low[found] = np.where(low[found] < 0, s, low[found])
        high[found] = s
    for b in wrong:
        rows = np.flatnonzero(c.bucket == b)
        low[rows], high[rows] = _exact(c, rows, length)
    return low, high
