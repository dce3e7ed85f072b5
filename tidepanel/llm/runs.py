"""Runs of repeated words by the branching-tandem test on an enhanced suffix array; no tree is built.

Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch of words with smallest period q that no neighbouring word extends keeping the period, with at least
`least_words` words and `least_exponent` periods.

The texts of a batch are laid side by side, and a word of one text is another symbol than the same word of any other, so suffixes of different texts
share nothing and no separators are needed.

1. Suffix array by prefix doubling; only places whose rank is still shared are sorted again. The ranks of every doubling are kept: they tell
   whether two stretches of 2^k words are equal, which gives common prefixes (LCP) and, backwards, common suffixes by halving steps.
2. Each place of the LCP array with value l splits the interval of suffixes around it that share l words in a left and a right part. For each suffix i of
   the smaller part, ISA[i + l] and ISA[i - l] are looked up: if they lie in the other part, a square of period l starts at the lesser of both places,
   and it branches: the word after it breaks the period. The smaller parts have O(n log n) members together.
3. Such a square is the last one of its stretch; it is rotated to the left as far as the words agree, which gives the first place. Equal stretches are
   merged into the one with the smallest period.

Null, empty and blank texts have no words and no runs; repeated rows are texts of their own. A text is worked off as a whole: about 200 bytes a word,
and 4 more for each doubling that its longest repeat needs.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import spread, texts
from tidepanel.llm.trie import left_extent, right_extent, sparse_table

#: Words whose suffixes are sorted at once (a longer text alone), and tests made at once.
SLICE, TESTS = 1 << 18, 1 << 20


def symbols(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The texts side by side, a number for each word and text, and where each text starts."""
    numbers = defaultdict(itertools.count().__next__)
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(sizes.sum()))
    flat += np.repeat(np.arange(len(words)), sizes) * len(numbers)
    return flat, np.r_[0, np.cumsum(sizes)]


def doubled_ranks(flat: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for each k the ranks of all stretches of 2^k words; equal stretches have equal ranks."""
    n = len(flat)
    order = np.argsort(flat, kind="stable")
    new = np.r_[True, flat[order[1:]] != flat[order[:-1]]]
    rank = np.empty(n, np.int32)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    ranks, step = [rank], 1
    while True:
        # Places in the order that belong to a group of several equal stretches.
        group = np.cumsum(new) - 1
        at = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(at):
            return order, ranks
        who = order[at]
        after = who + step
        key = rank[who].astype(np.int64) * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        key, who = key[sort], who[sort]
        order[at] = who
        fresh = np.r_[True, key[1:] != key[:-1]]
        new = np.ones(n, bool)
        new[at] = fresh
        rank = rank.copy()
        rank[who] = at[fresh][np.cumsum(fresh) - 1]
        ranks.append(rank)
        step *= 2


def common_prefix(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the suffixes at i and j (different ones) share."""
    n, i, j = len(ranks[0]), i.copy(), j.copy()
    start = i.copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = (i < n) & (j < n)
        same = inside & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])
        i[same] += 1 << k
        j[same] += 1 << k
    return i - start


def common_suffix(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i are the same as those before j."""
    i, j = i.copy(), j.copy()
    start = i.copy()
    for k in range(len(ranks) - 1, -1, -1):
        size = 1 << k
        while True:  # once for all but the longest stretches
            inside = (i >= size) & (j >= size)
            same = inside & (ranks[k][np.maximum(i - size, 0)] == ranks[k][np.maximum(j - size, 0)])
            if not same.any():
                break
            i[same] -= size
            j[same] -= size
    return start - i


def branching_squares(order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and period of every square whose period the next word breaks. shared[k] is the common prefix of suffixes k - 1 and k of the order; shared[0] < 0."""
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    levels = sparse_table(shared.astype(np.int32))
    k = np.flatnonzero(shared > 0)
    depth = shared[k]
    # Left part: all values between are above or equal; right part: above, so that a value met twice splits from the right.
    lo, hi = left_extent(levels, k - 1, depth), right_extent(levels, k, depth + 1)
    small_left = k - lo <= hi - k + 1
    own_lo, own_size = np.where(small_left, lo, k), np.where(small_left, k - lo, hi - k + 1)
    other_lo, other_hi = np.where(small_left, k, lo), np.where(small_left, hi, k - 1)
    starts, periods = [], []
    done = np.r_[0, np.cumsum(own_size)]
    a = 0
    while a < len(k):
        b = max(a + 1, int(np.searchsorted(done, done[a] + TESTS, side="right")) - 1)
        which = np.repeat(np.arange(a, b), own_size[a:b])
        i, period = order[spread(own_lo[a:b], own_size[a:b])], depth[which]
        for j, first in ((i + period, i), (i - period, i - period)):
            place = inverse[np.clip(j, 0, n - 1)]
            hit = (j >= 0) & (j < n) & (place >= other_lo[which]) & (place <= other_hi[which])
            starts.append(first[hit])
            periods.append(period[hit])
        a = b
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.empty(0, np.int64), np.empty(0, np.int64))


def runs_of(words: list[list[bytes]], least_words: int, least_exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start, then period."""
    flat, at = symbols(words)
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    if not len(flat):
        return found
    order, ranks = doubled_ranks(flat)
    shared = np.r_[-1, common_prefix(ranks, order[:-1], order[1:])]
    first, period = branching_squares(order, shared)
    end = first + 2 * period
    start = first - common_suffix(ranks, first, first + period)
    long = end - start >= np.maximum(least_words, least_exponent * period)
    start, end, period = start[long], end[long], period[long]
    best = np.lexsort((period, end, start))
    start, end, period = start[best], end[best], period[best]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    text = np.searchsorted(at, start[fresh], side="right") - 1
    for t, s, e, p in zip(text.tolist(), start[fresh].tolist(), end[fresh].tolist(), period[fresh].tolist()):
        found[t].append((s - int(at[t]), e - s, p))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join(itertools.compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, text_col: str = "text", least_words: int = 6, least_exponent: int = 4) -> DataFrame:
    """Every row in `row` with its runs (start, length, period; by start, then period) and the collapsed text."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text_col].alias("text"))
    spans = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.encode().split() for t in texts(batch)]
            found, a, size = [], 0, 0
            for b in range(1, len(words) + 1):
                size += len(words[b - 1])
                if b == len(words) or size + len(words[b]) > SLICE:
                    found += runs_of(words[a:b], least_words, least_exponent)
                    a, size = b, 0
            told = [[dict(zip(("start", "length", "period"), r)) for r in runs] for runs in found]
            short = [collapsed(w, r).decode() for w, r in zip(words, found)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(told, pa.list_(spans)), pa.array(short, pa.string())], names=["row", "runs", "collapsed"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
