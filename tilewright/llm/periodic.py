"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

The suffix array of the words of many texts is sorted by doubling; the ranks of each doubling step
(classes of equal blocks of 1, 2, 4 ... words) are kept and give common prefixes, which make the LCP
array, and common left contexts. An LCP interval of depth d holds all suffixes that share their first d
words. Two suffixes i and i + d of one interval in different child intervals are a square of period d
that cannot be moved right. For every interval, all children but the largest are listed, and for each
suffix i of them the inverse suffix array tells whether i + d or i - d lies in the interval and in
another child. Rotating a square left as far as it goes gives a run; of squares with the same run the
one with the least period counts. There are no tree nodes: intervals are pairs of array bounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.naming import unused

#: Texts are worked on together up to about so many words.
BATCH_WORDS = 1 << 16
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows 0, 1 ... each repeated ``size`` times, and first, first + 1 ... in each."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[row]


def block_ranks(text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of all texts, and for k = 0, 1 ... the ranks of the blocks of 2**k words at each place.

    ``text`` is the number of the text that each word is in; a block ends with its text, and those of
    different texts differ. The last ranks are the inverse suffix array. Each array has one more place
    at its end, with rank -1.
    """
    n = len(word)
    key = text.astype(np.int64) * (int(word.max(initial=0)) + 1) + word
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    place = np.arange(n)
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    ranks, span, open_ = [rank], 1, place[~(new & np.append(new[1:], True))]
    while len(open_):
        at = order[open_]
        nxt = np.minimum(at + span, n)
        behind = np.where((nxt < n) & (text[np.minimum(nxt, n - 1)] == text[at]), rank[nxt], -1)
        key = rank[at] * (n + 1) + behind + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        order[open_] = at
        rank = rank.copy()
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        ranks.append(rank)
        span *= 2
        open_ = open_[~(new & np.append(new[1:], True))]
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """For each place of the suffix array the number of words that its suffix shares with the one before; 0 at the first."""
    lcp = np.zeros(len(order), np.int64)
    near = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]])
    a, b = order[near].copy(), order[near + 1].copy()
    for k in range(len(ranks) - 1, -1, -1):
        same = ranks[k][a] == ranks[k][b]
        a[same] += 1 << k
        b[same] += 1 << k
    lcp[near + 1] = a - order[near]
    return lcp


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, end): each place with a common prefix and the bounds of the LCP interval of that depth around it."""
    n = len(lcp)
    place = np.flatnonzero(lcp)
    zeros = np.flatnonzero(np.concatenate(([0], lcp, [0])) == 0)
    steps = int(np.diff(zeros).max()).bit_length()
    least = [lcp]  # least[k][i]: least of lcp[i : i + 2**k]
    for k in range(steps - 1):
        half = 1 << k
        last = least[-1]
        least.append(np.minimum(last, np.append(last[half:], np.zeros(min(half, n), lcp.dtype))[:n]))
    depth, first, end = lcp[place], place.copy(), place + 1
    for k in range(len(least) - 1, -1, -1):
        back = first - (1 << k)
        go = (back >= 0) & (least[k][np.maximum(back, 0)] >= depth)
        first[go] = back[go]
        go = (end < n) & (least[k][np.minimum(end, n - 1)] >= depth)
        end[go] += 1 << k
    return place, first - 1, end


def branching_squares(order: np.ndarray, rank: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of all squares whose next word breaks the period, each once."""
    n = len(order)
    place, first, end = intervals(lcp)
    if not len(place):
        return place, place
    key = first * (n + 1) + end
    by = np.argsort(key, kind="stable")  # the places of an interval follow one another in order
    place, first, end, key = place[by], first[by], end[by], key[by]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    # Children of an interval: from its first bound to the first place, between places, from the last place to its end.
    lo = np.empty(len(place) + len(head), np.int64)
    hi, owner = lo.copy(), lo.copy()
    t = np.arange(len(place))
    lo[t + of + 1], owner[t + of + 1] = place, of
    lo[head + np.arange(len(head))], owner[head + np.arange(len(head))] = first[head], np.arange(len(head))
    hi[t + of] = place
    hi[np.append(head[1:], len(place)) + np.arange(len(head))] = end[head]
    size = hi - lo
    starts = head + np.arange(len(head))
    largest = np.flatnonzero(size == np.maximum.reduceat(size, starts)[owner])
    small = np.ones(len(lo), bool)
    small[largest[np.unique(owner[largest], return_index=True)[1]]] = False
    lo, hi, owner = lo[small], hi[small], owner[small]
    row, k = spread(lo, hi - lo)
    i, d = order[k], lcp[place[head]][owner][row]
    lo, hi, left, right = lo[row], hi[row], first[head][owner][row], end[head][owner][row]

    def tandem(p: np.ndarray) -> np.ndarray:
        r = np.where((p >= 0) & (p < n), rank[np.clip(p, 0, n)], -1)
        return (r >= left) & (r < right) & ((r < lo) | (r >= hi))

    forward, backward = tandem(i + d), tandem(i - d)
    start, period = np.concatenate((i[forward], (i - d)[backward])), np.concatenate((d[forward], d[backward]))
    one = np.unique(start * (n + 1) + period)
    return one // (n + 1), one % (n + 1)


def periodic_runs(text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the maximal runs of at least two periods in the words of all texts, by start and period."""
    none = np.zeros(0, np.int64)
    if not len(word):
        return none, none, none
    order, ranks = block_ranks(text, word)
    start, period = branching_squares(order, ranks[-1], common_prefixes(order, ranks))
    end = start + 2 * period
    for k in range(len(ranks) - 1, -1, -1):  # rotate left while the word before equals the one a period later
        back = start - (1 << k)
        same = (back >= 0) & (ranks[k][np.maximum(back, 0)] == ranks[k][np.maximum(back, 0) + period])
        start = np.where(same, back, start)
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def collapsed_runs(docs: DataFrame, text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """``docs`` with n_words, runs (start, length, period by start and period) and collapsed (the text without repeats).

    Words end at spaces and the control characters 9 to 13. A run is a maximal stretch of words with a
    smallest period; those of ``least_length`` words and ``least_exponent`` periods or more are
    returned. A word is left out of ``collapsed`` if a run holds it after the run's first period; the
    others are joined by one space. Null and empty texts have no words, no runs and an empty
    ``collapsed``. Each row is worked on by itself: equal rows get equal results, an empty table stays
    empty, and a very long text takes memory in proportion to its words times the logarithm of its longest repeat.
    All columns of ``docs`` are kept; one that has a name of the new columns is an error.
    """
    taken = {"n_words", "runs", "collapsed"} & set(docs.columns)
    if taken:
        raise ValueError(f"the table has columns {sorted(taken)} already")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(name)
            at = 0
            while at < batch.num_rows:
                number: defaultdict[bytes, int] = defaultdict(count().__next__)
                held, first, ids = [], at, []
                n = 0
                while at < batch.num_rows and n < BATCH_WORDS:
                    words = (column[at].as_py() or b"").split()
                    held.append(words)
                    ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                    n += len(words)
                    at += 1
                size = np.array([len(w) for w in held])
                edge = np.concatenate(([0], np.cumsum(size)))
                start, end, period = periodic_runs(np.repeat(np.arange(len(held)), size), np.concatenate(ids))
                use = end - start >= np.maximum(least_length, least_exponent * period)
                start, end, period = start[use], end[use], period[use]
                gone = np.zeros(n + 1, np.int32)
                np.add.at(gone, start + period, 1)
                np.add.at(gone, end, -1)
                keep = np.cumsum(gone)[:n] == 0
                cut = np.searchsorted(start, edge)
                of = np.searchsorted(edge, start, "right") - 1
                runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(start - edge[of]), pa.array(end - start), pa.array(period)], ["start", "length", "period"]))
                text = [b" ".join(w if cut[k] == cut[k + 1] else compress(w, keep[edge[k] : edge[k + 1]].tolist())) for k, w in enumerate(held)]
                new = [pa.array(size, pa.int64()), runs, pa.array(text, pa.binary()).cast(pa.string())]
                rest = batch.slice(first, at - first)
                yield pa.RecordBatch.from_arrays([*(c for c, f in zip(rest.columns, rest.schema, strict=True) if f.name != name), *new], [*(f.name for f in rest.schema if f.name != name), "n_words", "runs", "collapsed"])

    name = unused(docs, "_bytes")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words bigint", f"runs {RUNS}", "collapsed string"])
    return docs.withColumn(name, F.col(text_col).cast("binary")).mapInArrow(find, schema)
