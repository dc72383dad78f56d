"""SentencePiece encoding and decoding by streaming Viterbi.

A model gives pieces with scores; the best segmentation maximises their sum. Only boundaries
within the longest piece of the frontier can still be used, so only those are live; whenever the
back pointers of all live boundaries run into one boundary, the ids before it are committed and
forgotten. The space before a word is such a boundary whenever no piece reaches over it, so
paths always converge there: words are then independent, and each different word of a step of
text is solved once, all of them side by side in arrays.

The public model is a merge list: its scores are ranks. Here a piece of rank r scores
-log(r + 2), as frequencies fall with rank; ids are valid for the model and decode to the text
exactly, but the segmentation is the likeliest one and not that of the merges.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import by_batch, steps, utf8
from .words import prefix_hash, raw_hash, span_hash

#: Score of a byte piece, which stands for a sign that has no piece, and uncommitted signs at
#: which convergence is looked for.
BYTE_SCORE, CHECK = -25.0, 64
#: Bytes of a word that is solved side by side with others; longer ones are streamed. Bytes of
#: different words that are solved at once: their edges take some hundred times as many.
SHORT, AT_ONCE = 96, 300_000
#: Text bytes of a step.
STEP = 1_500_000

SPACE = "\u2581"  # a space in pieces


class Model(NamedTuple):
    pieces: dict[str, tuple[float, int]]
    bytes: list[int]          # id of each byte
    reach: dict[str, int]     # longest piece by its first two signs, or the sign alone
    longest: int
    text: list[bytes]         # what each id decodes to
    split: bool               # no piece has a space after another sign


def load(path: str) -> Model:
    """Read a model on the driver; what executors need of it travels with the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, data, text = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            data[int(piece[3:5], 16)] = i
            text.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i):
            text.append(b"")
        else:
            pieces[piece] = (-math.log(2 - model.get_score(i)), i)
            text.append(piece.replace(SPACE, " ").encode())
    return build(pieces, data, text)


def build(pieces: dict[str, tuple[float, int]], data: list[int], text: list[bytes]) -> Model:
    reach: dict[str, int] = {}
    for piece in pieces:
        for key in {piece[:1], piece[:2]}:
            reach[key] = max(reach.get(key, 0), len(piece))
    return Model(pieces, data, reach, max(map(len, pieces), default=1), text,
                 all(SPACE not in p.lstrip(SPACE) for p in pieces))


def stream(model: Model, signs: str, check: int = CHECK) -> Iterator[list[int]]:
    """Ids of one word or text in committed runs; spaces are given as SPACE."""
    best, back = {0: 0.0}, {}
    done, n = 0, len(signs)
    for start in range(n):
        score = best[start]
        top = model.reach.get(signs[start: start + 2], model.reach.get(signs[start], 0))
        single = False
        for end in range(start + 1, min(start + top, n) + 1):
            found = model.pieces.get(signs[start:end])
            if found:
                single |= end == start + 1
                total = score + found[0]
                if total > best.get(end, -math.inf):
                    best[end], back[end] = total, (start, [found[1]])
        if not single:
            raw = signs[start].encode("utf-8", "surrogateescape")
            total = score + BYTE_SCORE * len(raw)
            if total > best.get(start + 1, -math.inf):
                best[start + 1], back[start + 1] = total, (start, [model.bytes[b] for b in raw])
        if start + 1 - done >= check and start + 1 < n:
            meet = _meeting([b for b in best if b > start], back)
            if meet > done:
                yield _path(back, done, meet)
                for old in [b for b in best if b < meet or b <= start]:
                    del best[old]
                for old in [b for b in back if b <= meet]:
                    del back[old]
                done = meet
    if n:
        yield _path(back, done, n)


def _meeting(live: list[int], back: dict) -> int:
    """The last boundary that the paths to all live boundaries have in common."""
    heap = [-b for b in live]
    heapq.heapify(heap)
    while True:
        top = heapq.heappop(heap)
        while heap and heap[0] == top:
            heapq.heappop(heap)
        if not heap or -top not in back:
            return -top
        heapq.heappush(heap, -back[-top][0])


def _path(back: dict, start: int, end: int) -> list[int]:
    out = []
    while end > start:
        end, ids = back[end]
        out.append(ids)
    return [i for ids in reversed(out) for i in ids]


def encode_word(model: Model, word: bytes) -> list[int]:
    """Ids of a run of spaces and what follows them, up to the next space.

    A text may hold the sign that pieces write for a space. No piece stands for that sign itself,
    so it is spelled in bytes, and what lies on its two sides is encoded apart.
    """
    head, *rest = word.decode("utf-8", "surrogateescape").split(SPACE)
    out = []
    for i, part in enumerate([head, *rest]):
        out += [model.bytes[b] for b in SPACE.encode()] if i else []
        out += [x for ids in stream(model, part.replace(" ", SPACE)) for x in ids]
    return out


def _spans(offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """offsets[k] to offsets[k] + counts[k] - 1 for each k, end to end."""
    ends = np.cumsum(counts)
    return np.repeat(offsets - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class _Lookup:
    """Ids and scores of pieces by hash of their bytes; built where it is used, travels empty.

    A slot holds one piece; pieces of a slot that has several are found by bisection.
    """

    SLOTS = 18

    def __init__(self) -> None:
        self.model: Model | None = None

    def __reduce__(self) -> tuple:
        return _Lookup, ()

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def of(self, model: Model) -> _Lookup:
        if self.model is model:
            return self
        self.model = model
        ids = np.array([i for _, i in model.pieces.values()], np.int64)
        raw = [model.text[i] for i in ids.tolist()]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        h = raw_hash(prefix_hash(data), ends - size, ends)
        score = np.array([s for s, _ in model.pieces.values()])
        slot = self._slot(h)
        self.hash = np.zeros(1 << self.SLOTS, np.uint64)
        self.piece = np.full(1 << self.SLOTS, -1, np.int64)
        self.hash[slot], self.piece[slot] = h, np.arange(len(h))
        self.shared = np.bincount(slot, minlength=1 << self.SLOTS) > 1
        order = np.argsort(h)
        self.sorted, self.order = h[order], order
        self.ids, self.score = ids, score
        self.longest = int(size.max(initial=1))
        self.reach = np.zeros(1 << 16, np.int64)
        first = data[ends - size].astype(np.int64) << 8
        for low in range(256):  # a piece of one byte fits any second byte
            one = first[size == 1] | low
            self.reach[one] = np.maximum(self.reach[one], 1)
        more = size > 1
        np.maximum.at(self.reach, first[more] | data[(ends - size)[more] + 1], size[more])
        return self

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none."""
        slot = self._slot(h)
        out = np.where(self.hash[slot] == h, self.piece[slot], -1)
        again = np.flatnonzero((out < 0) & self.shared[slot])
        at = np.minimum(np.searchsorted(self.sorted, h[again]), len(self.sorted) - 1)
        out[again] = np.where(self.sorted[at] == h[again], self.order[at], -1)
        return out


_lookup = _Lookup()


def encode_words(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each word) of words that lie end to end in ``data``, solved side by side.

    An edge is a piece between two boundaries of a word. Edges are relaxed by their distance from
    the word's start, so that one step advances all words, longer pieces first, as ``stream`` does.
    """
    table, n = _lookup.of(model), len(data)
    word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end_of = offsets[1:][word]
    prefix, place = prefix_hash(data), np.arange(n)
    after = np.append(data[1:], 0).astype(np.int64)
    top = np.minimum(table.reach[data.astype(np.int64) << 8 | after], end_of - place)
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][np.diff(offsets) > 0]] = True
    heads = np.flatnonzero(lead)
    width = np.zeros(n, np.int64)
    width[heads] = np.diff(np.append(heads, n))
    alone, live, edges = lead.copy(), heads, []
    for size in range(1, table.longest + 1):
        live = live[top[live] >= size]
        found = table.find(raw_hash(prefix, live, live + size))
        hit = found >= 0
        start = live[hit]
        alone[start[width[start] == size]] = False
        edges.append((start, np.full(len(start), size), table.ids[found[hit]], table.score[found[hit]]))
    spelled = np.flatnonzero(alone)
    edges.append((spelled, width[spelled], np.full(len(spelled), -1), BYTE_SCORE * width[spelled]))
    start, size, ids, score = (np.concatenate(x) for x in zip(*edges, strict=True))
    far = start + size - offsets[:-1][word[start]]
    order = np.lexsort((-size, far))
    start, size, ids, score, far = start[order], size[order], ids[order], score[order], far[order]
    best, back = np.full(n + len(offsets), -np.inf), np.full(n + len(offsets), -1)
    best[offsets[:-1] + np.arange(len(offsets) - 1)] = 0.0
    source = start + word[start]  # a word of k bytes has k + 1 boundaries
    cut = np.flatnonzero((np.diff(far) != 0) | (np.diff(size) != 0)) + 1
    for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(start)).tolist(), strict=True):
        total, to = best[source[a:b]] + score[a:b], source[a:b] + size[a:b]
        better = total > best[to]
        best[to[better]] = total[better]
        back[to[better]] = np.arange(a, b)[better]
    taken, at = [], (offsets[1:] + np.arange(len(offsets) - 1))[np.diff(offsets) > 0]
    while len(at):
        edge = back[at]
        taken.append(edge)
        at = source[edge]
        at = at[back[at] >= 0]
    taken = np.concatenate([np.zeros(0, np.int64), *taken])
    taken = taken[np.argsort(start[taken], kind="stable")]
    count = np.where(ids[taken] < 0, size[taken], 1)
    out = np.repeat(ids[taken], count)
    by_byte = np.flatnonzero(out < 0)
    if len(by_byte):
        own = _spans(start[taken], count)
        out[by_byte] = np.array(model.bytes)[data[own[by_byte]]]
    return out.astype(np.int32), np.bincount(word[start[taken]], weights=count, minlength=len(offsets) - 1).astype(np.int64)


def encode(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts in one byte array; each text is led by a space of its own."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    lead = (length > 0).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(length + lead)])
    led = np.full(starts[-1], 32, np.uint8)
    led[np.arange(len(data)) + np.repeat(np.cumsum(lead), length)] = data
    space = led == 32
    edge = np.zeros(len(led) + 1, bool)
    edge[starts] = True
    if model.split:
        edge[:-1] |= space & ~np.concatenate([[False], space[:-1]])
    begin = np.flatnonzero(edge[:-1])
    end = np.append(begin[1:], len(led))
    text = np.searchsorted(starts, begin, "right") - 1
    _, first, where = np.unique(span_hash(prefix_hash(led), begin, end), return_index=True, return_inverse=True)
    begin, end = begin[first], end[first]
    raw = led.tobytes()
    odd = (end - begin > SHORT) | (not model.split)
    sign = np.frombuffer(SPACE.encode(), np.uint8)
    literal = np.flatnonzero((led[:-2] == sign[0]) & (led[1:-1] == sign[1]) & (led[2:] == sign[2])) if len(led) > 2 else []
    if len(literal):
        odd |= np.searchsorted(literal, begin) < np.searchsorted(literal, end)
    count, plain = np.zeros(len(begin), np.int64), np.flatnonzero(~odd)
    size = (end - begin)[plain]
    parts, held, base = [np.zeros(0, np.int32)], 0, np.zeros(len(begin), np.int64)
    for part in steps(size, AT_ONCE):
        own, sizes = plain[part], size[part]
        words = led[_spans(begin[own], sizes)]
        flat, count[own] = encode_words(model, words, np.concatenate([[0], np.cumsum(sizes)]))
        base[own] = held + np.cumsum(count[own]) - count[own]
        parts.append(flat)
        held += len(flat)
    for i in np.flatnonzero(odd).tolist():
        ids = encode_word(model, raw[begin[i]: end[i]])
        parts.append(np.array(ids, np.int32))
        base[i], count[i] = held, len(ids)
        held += len(ids)
    flat = np.concatenate(parts)
    out = flat[_spans(base[where], count[where])]
    total = np.bincount(text, weights=count[where], minlength=n).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(total)])


def decode(model: Model, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts that lists of ids stand for; the leading space goes."""
    size = np.array([len(t) for t in model.text], np.int64)
    table = np.frombuffer(b"".join(model.text), np.uint8)
    at = np.cumsum(size) - size
    led = table[_spans(at[ids], size[ids])]
    ends = np.concatenate([[0], np.cumsum(size[ids])])[offsets]
    keep = np.ones(len(led), bool)
    heads = ends[:-1][np.diff(ends) > 0]
    heads = heads[led[heads] == 32]
    keep[heads] = False
    return led[keep], ends - np.searchsorted(heads, ends, "left")


def encoded(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ids, n_ids and exact; such columns are replaced.

    exact tells that decoding the ids gives the text's bytes again. A null text has null ids, no
    ids counted and is exact; an empty one has an empty list. Repeated rows are encoded each.
    """
    docs = docs.drop("ids", "n_ids", "exact")
    at, rest = docs.columns.index(text), [c for c in docs.columns if c != text]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, lists, exact = batch.column(at), [], []
        data, offsets = utf8(column)
        for part in steps(np.diff(offsets), STEP):
            own = offsets[part.start: part.stop + 1]
            body, own = data[own[0]: own[-1]], own - own[0]
            ids, of = encode(model, body, own)
            back, back_of = decode(model, ids, of)
            lists.append(pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(ids)))
            same = len(back) == len(body) and bool((back == body).all() and (back_of == own).all())
            exact += [same] * (len(own) - 1) if same else [
                back[back_of[i]: back_of[i + 1]].tobytes() == body[own[i]: own[i + 1]].tobytes()
                for i in range(len(own) - 1)
            ]
        ids = pa.concat_arrays(lists)
        count = ids.value_lengths()
        ids = pc.if_else(column.is_null(), pa.scalar(None, ids.type), ids) if column.null_count else ids
        others = [c for i, c in enumerate(batch.columns) if i != at]
        return pa.RecordBatch.from_arrays([*others, ids, count, pa.array(exact)], [*rest, "ids", "n_ids", "exact"])

    return by_batch(docs, work, ", ".join([*fields, "ids array<int>", "n_ids int", "exact boolean"]))


def decoded(lists: DataFrame, model: Model, ids: str = "ids", text: str = "text") -> DataFrame:
    """The columns of ``lists`` with ``text``, what the ids stand for; null ids give null.

    Ids outside the model are an error; bytes that are no UTF-8 become replacement signs.
    """
    lists = lists.drop(text)
    at, names = lists.columns.index(ids), lists.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for own in batch.column(at):
            if not own.is_valid:
                out.append(None)
                continue
            flat = own.values.to_numpy(zero_copy_only=False)
            if len(flat) and not 0 <= flat.min() <= flat.max() < len(model.text):
                raise ValueError("an id is not in the model")
            out.append(decode(model, flat, np.array([0, len(flat)]))[0].tobytes().decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*names, text])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in lists.schema.fields]
    return by_batch(lists, work, ", ".join([*fields, f"`{text}` string"]))
