"""Runs of repeated words, found by longest common extensions on suffix trees.

A run is a maximal stretch with a smallest period. By the theorem on runs, every run of two
periods or more holds, for one of two orders of the words, a Lyndon root that is the longest
Lyndon word at its start. So each position gives one candidate root for each order; a candidate
is extended to the right by the longest common prefix of the suffixes before and after it, and
to the left by the longest common suffix. Both are string depths of lowest common ancestors, in
Ukkonen trees of the words and of the reversed words, by Euler tours and range minima.

Trees take time and memory for every word, so they are grown over the stretches of a document
that can hold a run: in a run of at least max(6, 4 q) words every three neighbouring words come
at least three times, so a word that is in no such triple is in no run. Cutting these words out
loses none, and is repeated within what is left.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

#: Words and periods that a run has at least.
LEAST, PERIODS = 6, 4
#: Words of a block of the range minima.
_BLOCK = 16


class Minima:
    """Least value of any range of an array, in constant time."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.int32)
        whole = -(-len(values) // _BLOCK) * _BLOCK
        padded = np.full(whole, np.iinfo(np.int32).max, np.int32)
        padded[: len(values)] = self.values
        self.table = [padded.reshape(-1, _BLOCK).min(1)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            last, step = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least of values[low] to values[high], both included; low <= high."""
        out = np.minimum(self.values[low], self.values[high])
        for step in range(1, _BLOCK):  # the ends' own blocks
            at = np.minimum(low + step, high)
            out = np.minimum(out, np.where(at // _BLOCK == low // _BLOCK, self.values[at], out))
            at = np.maximum(high - step, low)
            out = np.minimum(out, np.where(at // _BLOCK == high // _BLOCK, self.values[at], out))
        first, last = low // _BLOCK + 1, high // _BLOCK - 1
        rows = np.flatnonzero(first <= last)
        if len(rows):
            size = last[rows] - first[rows] + 1
            level = np.frexp(size.astype(float))[1] - 1
            for k in np.unique(level):
                own = rows[level == k]
                row = self.table[k]
                out[own] = np.minimum(out[own], np.minimum(row[first[own]], row[last[own] - (1 << k) + 1]))
        return out


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers from 1, with 0 after its end.

    ``lce`` gives longest common prefixes of suffixes; ``rank`` orders the suffixes with the end
    before all numbers, ``late`` with the end after all numbers.
    """

    def __init__(self, sequence: list[int]):
        self._grow([*sequence, 0])
        self._tour(len(sequence) + 1)

    def _grow(self, s: list[int]) -> None:
        n, wide = len(s), max(s) + 1
        start, stop, link, edges = [0], [0], [0], {}
        node = edge = length = waiting = 0
        for i, symbol in enumerate(s):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    edge = i
                key = node * wide + s[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(i)
                    stop.append(n)
                    link.append(0)
                    if last:
                        link[last], last = node, 0
                else:
                    at = start[child]
                    size = stop[child] - at
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[at + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    split = len(start)
                    start += (at, i)
                    stop += (at + length, n)
                    link += (0, 0)
                    edges[key] = split
                    edges[split * wide + symbol] = split + 1
                    start[child] = at + length
                    edges[split * wide + s[at + length]] = child
                    if last:
                        link[last] = split
                    last = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        child = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)
        keys, self.child = keys[order], child[order].tolist()
        self.ends = (keys % wide == 0).tolist()
        self.first = np.searchsorted(keys // wide, np.arange(len(start) + 1)).tolist()
        self.size = (np.array(stop) - np.array(start)).tolist()

    def _tour(self, n: int) -> None:
        """Euler tour of string depths; a leaf's depth tells its suffix."""
        child, ends, size, first = self.child, self.ends, self.size, self.first
        at, depth, tour, path = first[:-1].copy(), [0] * len(size), [0], []
        place, rank, late = [0] * n, [0] * n, [0] * n
        node, seen, seen_late, held = 0, 0, 0, {}
        while True:
            k = at[node]
            if k < first[node + 1]:
                at[node] = k + 1
                below = child[k]
                depth[below] = d = depth[node] + size[below]
                tour.append(d)
                if first[below] == first[below + 1]:
                    suffix = n - d
                    place[suffix], rank[suffix] = len(tour) - 1, seen
                    seen += 1
                    if ends[k]:
                        held[node] = suffix
                    else:
                        late[suffix] = seen_late
                        seen_late += 1
                    tour.append(depth[node])
                else:
                    path.append(node)
                    node = below
            else:
                if node in held:
                    late[held[node]] = seen_late
                    seen_late += 1
                if not path:
                    break
                node = path.pop()
                tour.append(depth[node])
        self.place, self.rank, self.late = np.array(place), rank, late
        self.least = Minima(np.array(tour))
        del self.child, self.ends, self.first, self.size

    def lce(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from two different positions on; a position may be the end."""
        a, b = self.place[a], self.place[b]
        return self.least(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def _next(order: list[int], n: int, sign: int) -> np.ndarray:
    """For each of n positions the next one whose order is smaller, or larger with sign -1; else n."""
    out = [n] * n
    for i in range(n - 1, -1, -1):
        j, own = i + 1, sign * order[i]
        while j < n and sign * order[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def _by_start(run: tuple[int, int, int]) -> tuple[int, int]:
    return run[0], run[2]


def runs(words: list[int], least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers from 1, by start, then period.

    ``periods`` is at least 2. The sequence is held in memory with two trees over it.
    """
    n = len(words)
    if n < least:
        return []
    tree, back = SuffixTree(words), SuffixTree(words[::-1])
    at = np.arange(n)
    found = []
    for ends in (_next(tree.rank, n, 1), _next(tree.late, n, -1)):
        period = ends - at
        right = tree.lce(at, ends)
        left = back.lce(n - at, n - ends)
        length = period + left + right
        good = length >= np.maximum(least, periods * period)
        found += zip((at - left)[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True)
    return sorted(set(found), key=_by_start)


def stretches(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(first, end) of the stretches that may hold a run of at least max(6, 4 q) words.

    In such a run each triple of neighbours comes three times or more: with period 1 it has
    four triples or more, else at least 3 q. So all runs lie in what such triples cover, and
    again in each stretch of that, until nothing more falls away.
    """
    n = len(words)
    if n < least:
        return []
    pair = np.unique(words[:-1] * (int(words.max()) + 1) + words[1:], return_inverse=True)[1]
    triple = np.unique(pair[:-1] * (int(words.max()) + 1) + words[2:], return_inverse=True)[1]
    edges = np.array([[0, n]])
    while len(edges):
        part = np.full(n, -1)
        for k, (a, b) in enumerate(edges.tolist()):
            part[a:b] = k
        here = np.flatnonzero((part[:-2] >= 0) & (part[:-2] == part[2:]))
        key = part[here] * (int(triple.max()) + 1) + triple[here]
        _, where, count = np.unique(key, return_inverse=True, return_counts=True)
        rich = here[count[where] >= 3]
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, rich, 1)
        np.add.at(step, rich + 3, -1)
        covered = np.concatenate([[0], (step.cumsum()[:-1] > 0).astype(np.int8), [0]])
        covered[1:-1] *= part >= 0
        edge = np.flatnonzero(np.diff(covered))
        new = edge.reshape(-1, 2)
        new = new[new[:, 1] - new[:, 0] >= least]
        if len(new) == len(edges) and (new == edges).all():
            break
        edges = new
    return [tuple(x) for x in edges.tolist()]


def document_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a document, by start, then period."""
    if len(words) < LEAST:
        return []
    known: dict[bytes, int] = {}
    numbers = np.array([known.setdefault(w, len(known) + 1) for w in words], np.int64)
    if len(numbers) - len(known) < LEAST - 2:  # a run repeats that many words at least
        return []
    found = []
    for first, end in stretches(numbers):
        own = np.unique(numbers[first:end], return_inverse=True)[1] + 1
        found += [(first + s, size, p) for s, size, p in runs(own.tolist())]
    return sorted(found, key=_by_start)


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return step[:-1].cumsum() == 0


def greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the largest length over period; ties by smaller start, then period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(words: list[bytes], doc_id: object) -> list[bytes]:
    """One document in ten gets a periodic end, by the checksum of its id; none without an id."""
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if not n or h is None or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a: a + p] * (-(-(n - a) // p)))[: n - a]


def detect(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text",
    change: Callable[[list[bytes], object], list[bytes]] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_runs, the greatest run, and digests of runs and kept words.

    Words are runs of other characters than ASCII white space. start, length, period and
    exponent_milli are those of the run of the greatest exact exponent, null without one;
    runs_sha256 is over a line ``start,length,period`` of every run, collapsed_sha256 over the
    words outside repeats joined by one space. ``change`` alters the words of a document, given
    its id, before. Null and empty texts have no words: no run, and the digests of nothing.
    Repeated rows are reported each, with their ids as they are; an empty table gives an empty
    result, and other columns are not looked at. A document is one task's work and never moves:
    a stretch that may hold a run takes some 700 bytes a word in its trees while it is looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long,"
              " runs_sha256 string, collapsed_sha256 string")

    def one(doc_id: object, body: str | None) -> tuple:
        words = (body or "").encode("utf-8", "surrogatepass").split()
        words = change(words, doc_id) if change else words
        found = document_runs(words)
        told = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
        if found:
            words = [words[i] for i in np.flatnonzero(kept(len(words), found))]
        best = greatest(found)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return len(found), *first, hashlib.sha256(told).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        columns = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
        names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return by_batch(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), work, schema)
