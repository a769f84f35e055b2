"""Periodic runs of words, by descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period q that is at least ``min_exponent * q`` and ``min_length`` words long and
that no neighbouring word extends. With q <= ``length - q`` equal words at its first two starts, both suffixes there
share ``length - q`` words, so only suffixes that share at least ``least_lcp`` words matter.

For the documents of a batch at a time:

1. Documents without two equal windows of ``least_lcp`` words (found by hashes, which can only let too many through) have no run.
2. Prefix doubling ranks the suffixes of the others, documents kept apart; the ranks of all lengths give the longest
   common prefix (LCP) of neighbours in suffix order.
3. Neighbours are united by decreasing LCP in a union-find whose classes are sorted lists of positions, the smaller
   inserted into the larger, its greatest position first. At level LCP a class holds the places where the same LCP words stand.
   Two positions that become neighbours at a distance d <= LCP seed a run: period d from the first to the second plus LCP.
   A position between them with a smaller period would share more words and so be in the class already; that
   is why d is the smallest period of every run that is long enough.
4. Seeds with the same end and period are one run, which starts at the first of them: levels fall, so it comes first.

A document is a value, so one task holds it whole; time is n log n in its words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: Words of a batch that are ranked together.
BATCH_WORDS = 1 << 18

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def least_lcp(min_length: int, min_exponent: int) -> int:
    """The least number of words that the suffixes at the first two starts of a run share."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def _window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` ids from every position on that has as many."""
    if len(ids) < size:
        return np.zeros(0, dtype=np.uint64)
    value = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(29)
    have, found, taken = 1, np.zeros(0, dtype=np.uint64), 0
    while size:
        if size & 1:
            n = len(ids) - taken - have + 1
            part = value[taken : taken + n]
            found = part if not taken else found[:n] * np.uint64(0xD6E8FEB86659FD93) + part
            taken += have
        size >>= 1
        if size:
            value = value[: len(value) - have] * np.uint64(0xA0761D6478BD642F + 2 * have) + value[have:]
            value ^= value >> np.uint64(32)
            have *= 2
    return found


def repeating(ids: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the documents ``ids[bounds[i]:bounds[i + 1]]`` that may hold two equal windows of ``size`` words."""
    hashes = _window_hashes(ids, size)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.flatnonzero(doc[: len(hashes)] == doc[size - 1 :][: len(hashes)])
    doc = doc[inside]
    key = hashes[inside] ^ (doc.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    return np.unique(doc[order[1:][same]])


def suffix_ranks(values: np.ndarray) -> list[np.ndarray]:
    """Ranks of the substrings of 1, 2, 4, ... values from every position on, until all differ.

    A substring that the end cuts short sorts before its continuations.
    """
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    levels, size, n = [rank], 1, len(values)
    while n and size < n and levels[-1].max() + 1 < n:
        rank = levels[-1]
        second = np.zeros(n, dtype=np.int64)
        second[: n - size] = rank[size:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        levels.append(fresh)
        size *= 2
    return levels


def common_prefixes(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in suffix order, and the LCP of each with the next."""
    n = len(levels[0])
    order = np.argsort(levels[-1], kind="stable")
    left, right = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(max(0, n - 1), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[k], -1)
        alive = np.flatnonzero((left < n) & (right < n))
        same = alive[rank[left[alive]] == rank[right[alive]]]
        # Equal ranks mean equal substrings of full length, or the same cut one, which only one position has.
        lcp[same] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
        left, right = np.minimum(left, n), np.minimum(right, n)
    return order, lcp


def kruskal_runs(order: np.ndarray, lcp: np.ndarray, min_length: int, min_exponent: int) -> dict[tuple[int, int], int]:
    """Start of every run by (end, period)."""
    edges = np.flatnonzero(lcp >= least_lcp(min_length, min_exponent))
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    classes: dict[int, list[int]] = {}
    root: dict[int, int] = {}
    starts: dict[tuple[int, int], int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for a, b, level in zip(order[edges].tolist(), order[edges + 1].tolist(), lcp[edges].tolist()):
        a, b = find(a), find(b)
        large, small = classes.pop(a, None) or [a], classes.pop(b, None) or [b]
        if len(large) < len(small):
            large, small, a, b = small, large, b, a
        last = -1
        for x in reversed(small):
            at = bisect_left(large, x)
            if at:
                d = x - large[at - 1]
                if d * (min_exponent - 1) <= level and d + level >= min_length:
                    starts.setdefault((x + level, d), x - d)
            if at < len(large) and large[at] != last:  # the last one was a neighbour before
                d = large[at] - x
                if d * (min_exponent - 1) <= level and d + level >= min_length:
                    starts.setdefault((x + d + level, d), x)
            large.insert(at, x)
            last = x
        root[b] = a
        classes[a] = large
    return starts


def document_runs(ids: np.ndarray, bounds: np.ndarray, min_length: int, min_exponent: int) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of every document that has some, by start, then period."""
    size = least_lcp(min_length, min_exponent)
    found: dict[int, list[tuple[int, int, int]]] = {}
    numbers = repeating(ids, bounds, size)
    if not len(numbers):
        return found
    chosen = [ids[bounds[i] : bounds[i + 1]] for i in numbers]
    lengths = np.array([len(c) for c in chosen])
    # Words of different documents differ, so that no class holds positions of two.
    values = np.concatenate(chosen) + np.repeat(np.arange(len(chosen)), lengths) * (int(ids.max()) + 1)
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    starts = kruskal_runs(*common_prefixes(suffix_ranks(values)), min_length, min_exponent)
    for (end, period), start in starts.items():
        at = int(np.searchsorted(firsts, start, side="right")) - 1
        found.setdefault(int(numbers[at]), []).append((start - int(firsts[at]), end - start, period))
    return {number: sorted(runs, key=lambda r: (r[0], r[2])) for number, runs in found.items()}


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run contains after its first period."""
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def _find(min_length: int, min_exponent: int):
    def batch(texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int, int]]], list[bytes]]:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        words = [t.split() for t in texts]
        bounds = np.cumsum([0, *map(len, words)])
        ids = np.fromiter((number[w] for ws in words for w in ws), dtype=np.int64, count=int(bounds[-1]))
        found = document_runs(ids, bounds, min_length, min_exponent)
        runs = [found.get(i, []) for i in range(len(texts))]
        collapsed = [b" ".join(kept_words(w, r) if r else w) for w, r in zip(words, runs)]
        return [len(w) for w in words], runs, collapsed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = pc.fill_null(whole.column(1).cast(pa.binary()), b"")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(texts):
                # About BATCH_WORDS words, as a word takes some six bytes.
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + 6 * BATCH_WORDS, side="right")))
                n, runs, collapsed = batch(texts.slice(start, stop - start).to_pylist())
                rows = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).slice(start, stop - start), pa.array(n, pa.int64()), pa.array(rows, pa.list_(_RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                start = stop

    return run


def find_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3) -> DataFrame:
    """Runs of every document of ``docs`` (doc_id, text): doc_id, n_words, runs and ``collapsed``.

    Words are what ASCII white space separates. ``runs`` are (start, length, period) in words, by start, then period. ``collapsed`` is the text
    without what repeats the first period of a run, its words joined by one space. A null or blank text has no words, no
    runs and an empty ``collapsed``; every row is judged by itself, so repeated rows and null ids stay; other columns are ignored.
    """
    if min_length < 1 or min_exponent < 2:
        raise ValueError("min_length must be at least 1, min_exponent at least 2")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_find(min_length, min_exponent), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
