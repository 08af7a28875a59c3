"""Suffix sorting in two stages, and what repeats in a buffer of byte strings."""

from __future__ import annotations

import numpy as np


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """For each suffix, whether it is smaller than the one a byte later; the last one counts as smaller."""
    n = len(t)
    up = np.empty(n, bool)
    up[-1] = True
    up[:-1] = t[:-1] < t[1:]
    # in a run of equal bytes, the byte after the run decides
    differs = np.append(t[:-1] != t[1:], True)
    decided = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    return up[decided]


def suffix_order(buffer: bytes, depth: int, starts: np.ndarray | None = None) -> np.ndarray:
    """Suffix starts in the order of their first `depth` bytes (equal ones next to each other).

    First stage: only suffixes smaller than their successors are sorted directly. Second stage: the
    rest is induced by one scan over the buckets of first bytes; a suffix larger than its successor
    follows it in the scan, so it is appended to its bucket in the right order. With `starts`, only
    these suffixes and those that they are induced from (up to the next smaller one) take part.
    """
    t = np.frombuffer(buffer, np.uint8)
    if not len(t):
        return np.empty(0, np.int64)
    smaller = smaller_than_next(t)
    if starts is None:
        keep = np.ones(len(t), bool)
    else:
        # each start keeps the suffixes up to the next directly sorted one
        ahead = np.minimum.accumulate(np.where(smaller, np.arange(len(t)), len(t))[::-1])[::-1]
        marks = np.zeros(len(t) + 1, np.int32)
        np.add.at(marks, starts, 1)
        np.add.at(marks, ahead[starts] + 1, -1)
        keep = np.cumsum(marks[:-1]) > 0
    direct = np.array(sorted(np.flatnonzero(smaller & keep).tolist(), key=lambda i: buffer[i : i + depth]), np.int64)
    edges = np.searchsorted(t[direct], np.arange(257))
    induced = keep & ~smaller
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        scanned = []
        while len(part):
            scanned.append(part)
            before = part[part > 0] - 1
            part = before[(t[before] == c) & induced[before]]
        bucket = np.concatenate([*scanned, direct[edges[c] : edges[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[(t[before] > c) & induced[before]]
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for d in np.unique(first).tolist():
            lo, hi = np.searchsorted(first, [d, d + 1])
            waiting[d].append(before[lo:hi])
    return np.concatenate(out)


def repeated(buffer: bytes, starts: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Of the candidate `starts`, a mask of those whose next `length` bytes also start at another place.

    `places` names the true place of each candidate: copies of one place in the buffer are no repeat.
    """
    mask = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return mask
    at = np.full(len(buffer), -1, np.int64)
    at[starts] = np.arange(len(starts))
    order = at[suffix_order(buffer, length, starts)]
    order = order[order >= 0]
    s = starts[order].tolist()
    # neighbours with a common prefix of `length` bytes
    common = np.array([buffer[a : a + length] == buffer[b : b + length] for a, b in zip(s, s[1:])])
    first = np.flatnonzero(np.concatenate(([True], ~common)))
    p = places[order]
    several = np.minimum.reduceat(p, first) != np.maximum.reduceat(p, first)
    mask[order] = np.repeat(several, np.diff(np.append(first, len(p))))
    return mask
