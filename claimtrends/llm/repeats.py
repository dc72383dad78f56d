"""Bytes of texts that lie in long strings which also start elsewhere, by sharded suffix arrays.

Every string of ``length`` bytes has an anchor: the leftmost of its ``gram``-byte pieces with the
smallest hash. Equal strings have equal anchors. Neighbouring strings of a text with one anchor
make a context, the bytes from the start of the first to the end of the last; contexts of one
anchor hash go to one shard. So a shard has all occurrences of each of its strings, and texts are
never compared in full. Anchors that come once are dropped before any bytes move, and equal
contexts enter a shard once, with their number. A shard is one suffix array by induced sorting;
permuted common prefixes tell which strings start elsewhere in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages, by_batch, steps
from .suffix import repeated
from .words import mix, prefix_hash, span_hash

#: Bytes of a string that counts as repeated, and of an anchor.
LENGTH, GRAM = 200, 32
#: Context bytes of a shard; an anchor with more than HOT context bytes is split.
SHARD, HOT = 1_000_000, 8_000_000
#: Text bytes that one vectorised step looks at, and starts of one of its blocks.
_STEP, _BLOCK, _BITS = 1_000_000, 1 << 20, np.uint64((1 << 24) - 1)


class Runs(NamedTuple):
    """Strings with one anchor: anchor hash, its place, first and last start, text number, and
    the hash of the context."""

    anchor: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    context: np.ndarray


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Runs:
    """All runs of the texts in one byte array; places are within that array."""
    parts = []
    for start in range(0, max(0, len(data) - length + 1), _BLOCK):
        parts.append(_block(data[start: start + _BLOCK + length - 1], offsets, start, length, gram))
    if not parts:
        return Runs(*[np.zeros(0, np.uint64 if i in (0, 5) else np.int64) for i in range(6)])
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _block(data: np.ndarray, offsets: np.ndarray, base: int, length: int, gram: int) -> Runs:
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    h = span_hash(prefix, at, at + gram)
    width = length - gram + 1
    key = (h & ~_BITS) | at.astype(np.uint64)
    pad = -len(key) % width
    grid = np.concatenate([key, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    count = len(key) - width + 1
    least = (np.minimum(behind[:count], ahead[width - 1: width - 1 + count]) & _BITS).astype(np.int64)
    start = np.arange(count)
    text = np.searchsorted(offsets, start + base, "right") - 1
    whole = start + base + length <= offsets[text + 1]
    fresh = whole & np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]])
    first = np.flatnonzero(fresh)
    last = first + np.bincount(np.cumsum(fresh)[whole] - 1, minlength=len(first)) - 1 if len(first) else first
    return Runs(h[least[first]], least[first] + base, first + base, last + base, text[first],
                span_hash(prefix, first, last + length))


def starts_elsewhere(contexts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each context the starts of strings that also start elsewhere in the shard.

    Contexts are laid end to end with a sign between them that no text has; a context that stands
    for several has all its strings elsewhere too.
    """
    if not contexts:
        return []
    size = np.array([len(c) for c in contexts], np.int64)
    base = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.zeros(base[-1] + 1, np.uint16)
    body = np.frombuffer(b"".join(contexts), np.uint8)
    text[:-1] = 1
    text[np.arange(len(body)) + np.repeat(np.arange(len(size)), size)] = body.astype(np.uint16) + 2
    found = repeated(text, length)
    out = []
    for i, (at, n) in enumerate(zip(base.tolist(), size.tolist(), strict=False)):
        own = found[at: at + n - length + 1]
        out.append(np.arange(len(own)) if counts[i] > 1 else np.flatnonzero(own))
    return out


def _joined(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


# Jobs --------------------------------------------------------------------------------------


def _texts(docs: DataFrame, stages: Stages, length: int) -> DataFrame:
    """(key, z, copies): each distinct text of at least ``length`` bytes, packed."""
    packer = {}

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        zstd = packer.setdefault("z", zstandard.ZstdCompressor(level=1))
        keys = {}
        for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = keys.setdefault(key, [t, 0])
            own[1] += 1
        z = [zstd.compress(t.as_buffer()) for t, _ in keys.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(keys), pa.binary()), pa.array(z, pa.binary()), pa.array([n for _, n in keys.values()], pa.int64())],
            ["key", "z", "copies"],
        )

    long = docs.where(F.octet_length("text") >= length).select("key", "text")
    packed = by_batch(long, pack, "key binary, z binary, copies long")
    return stages.save(packed.groupBy("key").agg(F.first("z").alias("z"), F.sum("copies").alias("copies")), "texts")


def _unpacked(column: pa.Array) -> Iterator[bytes]:
    zstd = zstandard.ZstdDecompressor()
    for z in column:
        yield zstd.decompress(z.as_buffer())


def _occurrences(texts: DataFrame, stages: Stages, length: int, gram: int) -> DataFrame:
    """(m, c, key, a, p, w): anchor, context, text, first start, place of the anchor, starts.

    Only anchors that come more than once; a text in several copies is one.
    """

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, packed = batch.column(0), batch.column(1)
        data = list(_unpacked(packed))
        size = np.array([len(d) for d in data], np.int64)
        found = []
        for part in steps(size, _STEP):
            offsets = np.concatenate([[0], np.cumsum(size[part])])
            own = runs(np.frombuffer(b"".join(data[part]), np.uint8), offsets, length, gram)
            base = offsets[own.text]
            found.append((own.anchor, own.context, own.text + part.start, own.first - base, own.at - base, own.last - own.first + 1))
        m, c, text, a, p, w = (np.concatenate(x) for x in zip(*found, strict=True))
        columns = [pa.array(m.view(np.int64)), pa.array(c.view(np.int64)), keys.take(pa.array(text)),
                   *[pa.array(x.astype(np.int32)) for x in (a, p, w)]]
        return pa.RecordBatch.from_arrays(columns, ["m", "c", "key", "a", "p", "w"])

    every = stages.save(by_batch(texts.select("key", "z"), find, "m long, c long, key binary, a int, p int, w int"), "anchors")
    again = every.groupBy("m").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("m")
    again = stages.save(again, "again")  # a join of stored tables splits a common anchor's rows
    out = stages.save(every.join(again, "m", "left_semi"), "occurrences")
    stages.drop("anchors")
    return out


_FIELDS = {
    "m": ("long", pa.int64()), "c": ("long", pa.int64()), "n": ("long", pa.int64()),
    "at": ("int", pa.int32()), "s": ("int", pa.int32()), "body": ("binary", pa.binary()),
}
_CONTEXTS = ", ".join(f"{name} {kind}" for name, (kind, _) in _FIELDS.items())
_PIECES = "pm long, pc long, off int, " + _CONTEXTS


def _contexts(seen: DataFrame, texts: DataFrame, stages: Stages, length: int, gram: int) -> DataFrame:
    """(m, c, n, at, s, body): each distinct context with its bytes, read from one text.

    n is the number of its occurrences, at and s the place and length of the anchor in the body.
    """
    rep = F.min(F.struct("key", "a", "p", "w")).alias("rep")
    each = seen.groupBy("m", "c").agg(F.count(F.lit(1)).alias("n"), rep)
    own = each.groupBy("rep.key").agg(F.collect_list(F.struct("m", "c", "n", "rep.a", "rep.p", "rep.w")).alias("own"))

    def cut(text: bytes, row: pa.ListScalar) -> pa.RecordBatch:
        m, c, n, a, p, w = (row.values.field(i) for i in range(6))
        start = a.to_numpy(zero_copy_only=False)
        ends = start + w.to_numpy(zero_copy_only=False) - 1 + length
        body = [text[s:e] for s, e in zip(start.tolist(), ends.tolist(), strict=True)]
        at = p.to_numpy(zero_copy_only=False) - start
        return pa.RecordBatch.from_arrays(
            [m, c, n, pa.array(at.astype(np.int32)), pa.array(np.full(len(at), gram, np.int32)), pa.array(body, pa.binary())],
            list(_FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text, row in zip(_unpacked(batch.column(0)), batch.column(1), strict=True):
                held.append(cut(text, row))
                size += held[-1].nbytes
                if size > 4_000_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return stages.save(texts.select("key", "z").join(own, "key").select("z", "own").mapInArrow(run, _CONTEXTS), "contexts")


def _split(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts of too common anchors, each in up to two pieces (_PIECES) with longer anchors.

    Of the bytes around an anchor a string has half to its left, or else the other half to its
    right. Either way the anchor grows by them, and only strings that share them meet again. An
    anchor as long as the strings has one string.
    """

    def halves(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for m, c, n, at, s, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            left = (length - s) // 2
            right = length - s - left
            limit = at - left  # starts up to here have the left half
            last = len(body) - length
            for side, lo, hi, begin, end in (
                (1, 0, min(limit, last), at - left, at + s),
                (2, max(0, limit + 1), last, at, at + s + right),
            ):
                if lo > hi:
                    continue
                own = np.frombuffer(body, np.uint8)[lo: hi + length]
                h = span_hash(prefix_hash(own), np.array([begin - lo, 0]), np.array([end - lo, len(own)]))
                h = mix(h + np.array([side, begin - lo], np.uint64)).view(np.int64).tolist()
                rows.append((m, c, lo, *h, n, begin - lo, end - begin, own.tobytes()))
        types = [pa.int64(), pa.int64(), pa.int32(), *[t for _, t in _FIELDS.values()]]
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["pm", "pc", "off", *_FIELDS])

    return by_batch(contexts, halves, _PIECES)


def _search(contexts: DataFrame, stages: Stages, name: str, length: int) -> DataFrame:
    """(m, c, low, high): runs of starts, counted from a context's first, that start elsewhere."""
    total = contexts.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = int(total // SHARD) + 1

    def work(shard: pd.DataFrame) -> pd.DataFrame:
        where = starts_elsewhere(shard["body"].tolist(), shard["n"].to_numpy(), length)
        found = [(m, c, lo, hi) for m, c, starts in zip(shard["m"].tolist(), shard["c"].tolist(), where, strict=True)
                 for lo, hi in _joined(starts)]
        return pd.DataFrame(found, columns=["m", "c", "low", "high"])

    dealt = contexts.select("m", "c", "n", "body", F.pmod(F.xxhash64("m"), F.lit(shards)).alias("shard"))
    return stages.save(dealt.groupBy("shard").applyInPandas(work, "m long, c long, low int, high int"), name)


def _found(contexts: DataFrame, stages: Stages, length: int, level: int = 0) -> DataFrame:
    """``_search``, with anchors of more than HOT bytes split again and again before."""
    size = contexts.groupBy("m").agg(F.sum(F.length("body")).alias("size")).where(F.col("size") > HOT)
    hot = stages.save(size.select("m"), f"hot{level}")
    if hot.isEmpty():
        return _search(contexts, stages, f"found{level}", length)
    cold = _search(contexts.join(hot, "m", "left_anti"), stages, f"found{level}", length)
    pieces = stages.save(_split(contexts.join(hot, "m", "left_semi").select(*_FIELDS), length), f"pieces{level}")
    merged = pieces.groupBy("m", "c").agg(
        F.sum("n").alias("n"), *[F.first(x).alias(x) for x in ("at", "s", "body")])
    merged = stages.save(merged.select(*_FIELDS), f"merged{level}")
    inner = _found(merged, stages, length, level + 1)
    up = inner.join(pieces.select("pm", "pc", "off", "m", "c"), ["m", "c"]).select(
        F.col("pm").alias("m"), F.col("pc").alias("c"), (F.col("low") + F.col("off")).alias("low"), (F.col("high") + F.col("off")).alias("high"))
    return cold.unionAll(stages.save(up, f"up{level}"))


def _covered(low: list[int], high: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by [low, high)."""
    out = []
    for s, e in sorted(zip(low, high, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Two tables: the rows of ``docs`` without the text, with ``_key`` and ``_bytes``, and for
    each ``_key`` of a text with repeated bytes its ``spans`` and the bytes ``kept``.

    spans are maximal runs (start, end) of bytes that lie in a string of ``length`` bytes which
    also starts elsewhere in the table, the same text included; kept are the others. Null is
    empty, shorter texts have none, copies of a text repeat it wholly. Equal contexts and anchors
    are told by two 64-bit hashes together. Only texts with anchors that come again are unpacked
    for their contexts.
    """
    stages = Stages(docs.sparkSession, "repeats")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.drop("_key", "_bytes").withColumns({
        "_key": F.unhex(F.md5(body.cast("binary"))), "_bytes": F.octet_length(body).cast("long"),
    })
    texts = _texts(keyed.select(F.col("_key").alias("key"), body.alias("text")), stages, length)
    seen = _occurrences(texts, stages, length, gram)
    contexts = _contexts(seen, texts, stages, length, gram)
    found = _found(contexts, stages, length)
    stages.drop("contexts")
    spans = seen.join(found, ["m", "c"]).select("key", (F.col("a") + F.col("low")).alias("low"), (F.col("a") + F.col("high") + length).alias("high"))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("found"))
    rows = texts.join(spans, "key", "left").where("found is not null or copies > 1").select("key", "z", "copies", "found")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def take(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_spans, kept = [], []
        for t, copies, own in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if copies > 1:
                runs_ = [(0, len(t))]
            else:
                low, high = (own.values.field(i).to_pylist() for i in range(2))
                runs_ = _covered(low, high)
            all_spans.append([{"start": s, "end": e} for s, e in runs_])
            edges = [0, *[x for r in runs_ for x in r], len(t)]
            kept.append(b"".join(t[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_spans, kind), pa.array(kept, pa.binary())], ["_key", "spans", "kept"])

    cuts = by_batch(rows, take, "_key binary, spans array<struct<start:int,end:int>>, kept binary")
    return keyed.drop(text), cuts


def digests(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, from ``repeats``."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    whole = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    members, cuts = repeats(own.withColumn("whole", whole), length=length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    cuts = Stages(docs.sparkSession, "repeats").save(cuts.select(
        "_key", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("sha")
    ), "cuts")
    return members.join(cuts, "_key", "left").select(
        "doc_id", F.col("_bytes").alias("n_bytes"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"),
    )
