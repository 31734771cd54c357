"""Bit-sliced Hamming comparison of 64-bit fingerprints, and links kept as a forest."""

from __future__ import annotations

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Pairs of one fingerprint with one word of 64 lanes that are compared at a time.
CHUNK = 1 << 16


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes [64, words]: bit b of fingerprint r is bit r % 64 of planes[b, r // 64]."""
    n_words = -(-len(fps) // 64)
    bits = np.zeros((64, n_words * 64), dtype=np.uint8)
    for b in range(64):
        bits[b, : len(fps)] = (fps >> np.uint64(b)) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _below(k: np.ndarray) -> np.ndarray:
    """Words whose lanes under k are set; k from 0 to 64."""
    k = np.clip(k, 0, 64)
    return np.where(k == 64, ONES, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))


def near_lanes(plane: np.ndarray, query: np.ndarray, word: np.ndarray, dead: np.ndarray, radius: int, every: int = 4):
    """Lanes of each (query, word) pair within radius: yields (pair numbers, lane masks).

    dead: lanes that do not count. Saturating carry-save counters add one bit plane of differences to
    all lanes at once; a pair is abandoned once all its lanes exceed the radius.
    """
    n_bits = max(1, (radius + 1).bit_length())
    start = np.uint64((1 << n_bits) - 1 - radius)  # counters start so that radius + 1 differences overflow them
    at = np.arange(len(query))
    over = dead.copy()
    counters = [np.full(len(query), ONES if (int(start) >> j) & 1 else 0, dtype=np.uint64) for j in range(n_bits)]
    for b in range(64):
        carry = plane[b][word] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
        for c in counters:
            carry_out = c & carry
            c ^= carry
            carry = carry_out
        over |= carry
        if b % every == every - 1:
            alive = over != ONES
            if not alive.all():
                at, query, word, over = at[alive], query[alive], word[alive], over[alive]
                counters = [c[alive] for c in counters]
                if not len(at):
                    return at, over
    return at, ~over


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i] in place; parent[i] becomes the smallest member of i's tree."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def link_buckets(bucket: np.ndarray, fps: np.ndarray, radius: int, last: np.ndarray | None = None) -> np.ndarray:
    """Parent of each row: rows of one bucket within radius share a tree. Rows must be sorted by bucket.

    last: a row meets only the rows before this number, if given.
    """
    n = len(fps)
    parent = np.arange(n)
    if n < 2:
        return parent
    plane = planes(fps)
    edge = np.flatnonzero(np.diff(bucket)) + 1
    end = np.repeat(np.append(edge, n), np.diff(np.concatenate(([0], edge, [n]))))
    end = end if last is None else np.minimum(end, last)
    first_word, last_word = (np.arange(n) + 1) // 64, (end - 1) // 64
    count = np.where(np.arange(n) + 1 < end, last_word - first_word + 1, 0)
    upto = np.cumsum(count)
    for lo in range(0, int(upto[-1]), CHUNK):
        pair = np.arange(lo, min(lo + CHUNK, int(upto[-1])))
        row = np.searchsorted(upto, pair, side="right")
        word = first_word[row] + (pair - (upto[row] - count[row]))
        dead = _below(row + 1 - word * 64) | ~_below(end[row] - word * 64)
        at, mask = near_lanes(plane, fps[row], word, dead, radius)
        if len(at):
            lanes = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, lane = np.nonzero(lanes)
            merge(parent, row[at[k]], word[at[k]] * 64 + lane)
    return parent
