"""Periodic runs of words, found with suffix trees.

A run is a stretch with smallest period q and at least ``min_length`` words and ``min_times`` periods
that no neighbouring word extends.  A text is read in three steps:

1. Every run repeats some GRAM words at a distance of at most its period all along, so hashed grams and
   their next occurrence name the segments outside which no run can lie (``repeating_segments``).
   Most texts have none.
2. A segment gets a suffix tree of itself and one of its reversal, built online with suffix links
   (``SuffixTree``); the depths along an Euler tour turn the longest common extension of two places into a
   range minimum, which two overlapping table entries answer in constant time, for all pairs at once.
3. Every run has a Lyndon root, under the order of the words or under its reverse: the longest Lyndon
   word at some place, which ends before the next suffix that is smaller.  Each such candidate is
   extended to both sides by its common extensions; long enough ones are runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import NULL_ID, map_batches, narrow, real_id

MIN_LENGTH = 24
MIN_TIMES = 3
#: A run of q words' period repeats at least ``least_repeat`` words; grams may have no more.
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def least_repeat(min_length: int, min_times: int) -> int:
    """Words that every run is sure to repeat one period later: the least of max(min_length, min_times * q) - q over q."""
    turn = min_length // min_times
    return min(max(min_length, min_times * q) - q for q in (max(turn, 1), turn + 1))


class SuffixTree:
    """The suffix tree of ``symbols`` and a last symbol of its own (0; the others are positive), built from left to right.

    ``rank`` orders the suffixes; ``common`` gives longest common extensions.
    """

    def __init__(self, symbols: list[int]) -> None:
        s = self.symbols = [*symbols, 0]
        n = len(s)
        start, end, link = [0], [0], [0]  # of each node: its edge's symbols; where its suffix link leads
        kids: list[dict[int, int] | None] = [{}]
        leaf = []
        node = edge = length = left = 0
        for i, c in enumerate(s):
            left += 1
            last = 0
            while left:
                if not length:
                    edge = i
                at = kids[node]
                down = at.get(s[edge])
                if down is None:
                    at[s[edge]] = len(start)
                    leaf.append(len(start))
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    kids.append(None)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    a = start[down]
                    size = (end[down] if end[down] <= i else i + 1) - a
                    if length >= size:  # walk down
                        edge += size
                        length -= size
                        node = down
                        continue
                    if s[a + length] == c:  # the suffix is there already
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    at[s[edge]] = split
                    start += (a, i)
                    end += (a + length, n)
                    link += (0, 0)
                    kids += ({s[a + length]: down, c: split + 1}, None)
                    leaf.append(split + 1)
                    start[down] = a + length
                    if last:
                        link[last] = split
                    last = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - left + 1
        self._tour(start, end, kids, leaf)

    def _tour(self, start: list[int], end: list[int], kids: list[dict[int, int] | None], leaf: list[int]) -> None:
        """Symbols above every stop of an Euler tour, where each leaf is in it, and the leaves' order."""
        depth, stops, first, order = [0], [0], [0] * len(start), []
        stack = [(0, iter(sorted(kids[0].items())))]
        while stack:
            for _, v in stack[-1][1]:
                if kids[v] is None:
                    first[v] = len(stops)
                    order.append(v)
                    stops += (depth[-1] + end[v] - start[v], depth[-1])
                else:
                    depth.append(depth[-1] + end[v] - start[v])
                    stops.append(depth[-1])
                    stack.append((v, iter(sorted(kids[v].items()))))
                    break
            else:
                stack.pop()
                depth.pop()
                if depth:
                    stops.append(depth[-1])
        place = np.empty(len(start), np.int64)
        place[order] = np.arange(len(order))
        self.rank = place[leaf]
        self._at = np.array(first, np.int64)[leaf]
        self._low = RangeMinimum(np.array(stops, np.int32))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at i and j (different places) share: the depth of their lowest common ancestor."""
        a, b = self._at[i], self._at[j]
        return self._low.least(np.minimum(a, b), np.maximum(a, b))


class RangeMinimum:
    """Minima of ranges: a table of doubling ranges over blocks, running minima inside blocks; memory in proportion to the values."""

    BLOCK = 32

    def __init__(self, x: np.ndarray) -> None:
        w = self.BLOCK
        high = np.iinfo(x.dtype).max
        self.x = np.concatenate([x, np.full(-len(x) % w, high, x.dtype)]).reshape(-1, w)
        self.left = np.minimum.accumulate(self.x, 1).ravel()
        self.right = np.minimum.accumulate(self.x[:, ::-1], 1)[:, ::-1].ravel()
        self.table = [self.x.min(1)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):
            t, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-step], t[step:]))
        self.x = self.x.ravel()

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of x[a..b], both ends included."""
        w = self.BLOCK
        p, q = a // w, b // w
        out = np.minimum(self.right[a], self.left[b])
        far = (q - p > 1).nonzero()[0]
        if len(far):
            lo, hi = p[far] + 1, q[far]
            k = np.frexp((hi - lo).astype(np.float64))[1] - 1
            for level in np.unique(k):
                m = k == level
                t = self.table[level]
                out[far[m]] = np.minimum(out[far[m]], np.minimum(t[lo[m]], t[hi[m] - (1 << int(level))]))
        near = (p == q).nonzero()[0]
        if len(near):
            lo, hi = a[near], b[near]
            best = self.x[lo]
            for step in range(1, w):
                best = np.minimum(best, self.x[np.minimum(lo + step, hi)])
            out[near] = best
        return out


def _next_smaller(rank: list[int]) -> list[int]:
    """Of each place the next one with a smaller value; the length where there is none."""
    n = len(rank)
    out, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs(symbols: list[int], min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``symbols`` (positive integers), in that order of sorting by start and period."""
    n = len(symbols)
    if n < max(min_length, min_times):
        return []
    ahead = SuffixTree(symbols)
    place = np.arange(n)
    found = []
    for rank in (ahead.rank, -ahead.rank):
        stop = np.array(_next_smaller(rank.tolist()), np.int64)[:n]
        keep = (stop < n) & ((stop - place) * min_times <= n)
        found.append(np.stack([place[keep], stop[keep]]))
    i, j = np.unique(np.concatenate(found, 1), axis=1)
    if not len(i):
        return []
    back = SuffixTree(symbols[::-1])
    period = j - i
    size = period + ahead.common(i, j)
    left = np.zeros(len(i), np.int64)
    inner = i > 0
    left[inner] = back.common(n - i[inner], n - j[inner])
    size += left
    good = (size >= min_length) & (size >= min_times * period)
    return sorted(set(zip((i - left)[good].tolist(), size[good].tolist(), period[good].tolist(), strict=True)), key=lambda r: (r[0], r[2]))


def repeating_segments(hashes: np.ndarray, gram: int, least: int) -> list[tuple[int, int]]:
    """Disjoint (start, end) stretches of at least ``least`` words that together hold every run: the places from each gram
    to the end of its next occurrence, united.  Equal words have equal hashes, so what differs can only add stretches."""
    n = len(hashes) - gram + 1
    if n < 2:
        return []
    h, have = hashes, 1
    while have < gram:
        step = min(have, gram - have)
        h = (h[:-step] * _ODD ^ (h[step:] + _MIX)) * _MIX
        h ^= h >> np.uint64(31)
        have += step
    order = np.argsort(h, kind="stable")
    same = (h[order[1:]] == h[order[:-1]]).nonzero()[0]
    if not len(same):
        return []
    reach = np.zeros(n, np.int64)
    reach[order[same]] = order[same + 1] + gram
    starts = reach.nonzero()[0]
    far = np.maximum.accumulate(reach[starts])
    new = np.concatenate([[True], starts[1:] > far[:-1]]).nonzero()[0]
    ends = far[np.concatenate([new[1:] - 1, [len(starts) - 1]])]
    return [(int(a), int(z)) for a, z in zip(starts[new], ends, strict=True) if z - a >= least]


def text_runs(words: list[bytes], min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """The runs of a text's words, by start, then period."""
    if len(words) < max(min_length, min_times):
        return []
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    out = []
    for a, z in repeating_segments(hashes, least_repeat(min_length, min_times), min_length):
        number: dict[bytes, int] = {}
        symbols = [number.setdefault(w, len(number) + 1) for w in words[a:z]]
        out += [(a + start, length, period) for start, length, period in runs(symbols, min_length, min_times)]
    return out


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int, list[bytes]], list[bytes]] | None = None, min_length: int = MIN_LENGTH,
         min_times: int = MIN_TIMES, keep: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_runs``, the run of most periods (``start``, ``length``, ``period``, ``exponent_milli``), the digests
    ``runs_sha256`` and ``collapsed_sha256``, and with ``keep`` the ``runs`` and the ``collapsed`` text.

    Words are parted by ASCII white space.  ``rewrite`` may change a text's words (by its id, when it has one) before
    they are read.  Collapsing drops every word that lies in a run after the run's first period.  Null and
    empty texts, and texts without a run, have 0 runs, four nulls and their words as they are; of runs with
    equally many periods the first counts, then that of smaller period; repeated rows give equal rows.
    A very long text takes about 100 bytes a word, and some 700 a word of its longest repeating segment.
    """
    if min_times < 2 or min_length < min_times:
        raise ValueError("a run has at least two periods, and as many words as periods")

    def run(x):
        out = {n: [] for n in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")}
        for doc, raw in zip(x["doc_id"], x["text"], strict=True):
            words = raw.split()
            if rewrite and doc != NULL_ID:
                words = rewrite(doc, words)
            found = text_runs(words, min_length, min_times)
            best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
            left = words
            if found:
                gone = np.zeros(len(words) + 1, np.int64)
                for start, length, period in found:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                left = [words[i] for i in (np.cumsum(gone[:-1]) == 0).nonzero()[0].tolist()]
            text = b" ".join(left)
            told = "".join(f"{a},{n},{q}\n" for a, n, q in found)
            row = {
                "doc_id": doc, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2], "exponent_milli": 1000 * best[1] // best[2] if found else None,
                "runs_sha256": hashlib.sha256(told.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(text).hexdigest(),
                "runs": [{"start": a, "length": n, "period": q} for a, n, q in found] if keep else None, "collapsed": text.decode("utf-8") if keep else None,
            }
            for name, value in row.items():
                out[name].append(value)
        return out

    kinds = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    docs = narrow(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    done = map_batches(docs, run, kinds + ", runs array<struct<start: long, length: long, period: long>>, collapsed string")
    done = done.select(real_id(), *[c for c in done.columns if c != "doc_id"])
    return done if keep else done.drop("runs", "collapsed")
