"""Language of each word by a linear-chain conditional random field.

A word's features are its affixes of one to three bytes, its byte trigrams, and the lexicons of
frequent words that tell a language, all learned with the transitions between languages from
sequences in which spans of different languages alternate. Forward and backward run over the
whole text: blocks of words are multiplied into transfer matrices, the blocks are scanned, and
each block is filled in, so that long texts cost no more per word and nothing is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, sampled, steps, utf8
from .words import LETTER, LOWER, prefix_hash, runs, span_hash

#: Buckets of hashed features, and words in a language's lexicon at most.
BUCKETS, LEXICON = 1 << 15, 4_000
#: Documents learned from at most, sequences cut from them, words of each, spans between switches.
SAMPLE, SEQUENCES, LENGTH, SPAN = 3_000, 6_000, 32, (4, 24)
#: Bytes of the texts learned from at most, all in one task.
SAMPLE_BYTES = 48_000_000
#: Adagrad: step, ridge, passes and sequences of a batch.
RATE, RIDGE, PASSES, BATCH = 0.3, 1e-5, 3, 128
#: Words of a block of the scan.
BLOCK = 64

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray      # feature bucket x label
    lexicon: np.ndarray      # sorted word hashes
    lexicon_label: np.ndarray
    lexicon_weights: np.ndarray  # label of the lexicon, or none, x label
    transitions: np.ndarray
    start: np.ndarray


def _small(data: np.ndarray) -> np.ndarray:
    """Capitals of ASCII and of two-byte Latin letters made small."""
    data = LOWER[data]
    after = np.concatenate([[False], data[:-1] == 0xC3])
    return np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), data + 32, data).astype(np.uint8)


def _parts(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers in order, feature buckets) by kind of feature."""
    length, n = ends - starts, np.arange(len(starts))
    for kind, size in enumerate((1, 2, 3)):
        long = length >= size
        for side, at in enumerate((starts[long], ends[long] - size)):
            h = span_hash(prefix, at, at + size) + np.uint64(0x9E3779B97F4A7C15 * (2 * kind + side + 1) % 2**64)
            yield n[long], (h >> np.uint64(40)) % np.uint64(BUCKETS)
    count = np.maximum(length - 2, 0)
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    yield np.repeat(n, count), (span_hash(prefix, at, at + 3) >> np.uint64(20)) % np.uint64(BUCKETS)


def _lexical(model: Model, words: np.ndarray) -> np.ndarray:
    """The label of the lexicon that holds each word; one past the labels for none."""
    if not len(model.lexicon):
        return np.full(len(words), len(model.labels))
    at = np.minimum(np.searchsorted(model.lexicon, words), len(model.lexicon) - 1)
    return np.where(model.lexicon[at] == words, model.lexicon_label[at], len(model.labels))


def emissions(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Score of each label for each word; repeated words are looked at once."""
    prefix = prefix_hash(data)
    words, first, where = np.unique(span_hash(prefix, starts, ends), return_index=True, return_inverse=True)
    out = model.lexicon_weights[_lexical(model, words)].astype(np.float64)
    for at, bucket in _parts(prefix, starts[first], ends[first]):
        total = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(model.weights[bucket], 0)])
        edge = np.searchsorted(at, np.arange(len(words) + 1))
        out += total[edge[1:]] - total[edge[:-1]]
    return out[where]


def marginals(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word of sequences laid end to end, by forward-backward."""
    size = scores.shape[1]
    blocks = -(-lengths // BLOCK)
    at = np.repeat(np.cumsum(blocks) - blocks, lengths) * BLOCK
    at += np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    total, seq = int(blocks.sum()), len(lengths)
    emit = np.ones((total * BLOCK, size))
    emit[at] = np.exp(scores - scores.max(1, keepdims=True))
    emit = emit.reshape(total, BLOCK, size)
    used = np.zeros(total * BLOCK, bool)
    used[at] = True
    used = used.reshape(total, BLOCK)
    heads = np.zeros((total, BLOCK), bool)
    first = np.cumsum(blocks) - blocks
    heads[first, 0] = True
    moves, stay = np.exp(transitions), np.eye(size)

    def move(t: int) -> np.ndarray:
        """Which blocks move by transitions before word t; the others, heads and padding, stay."""
        return used[:, t] & ~heads[:, t]

    matrix = np.broadcast_to(stay, (total, size, size)).copy()
    for t in range(BLOCK):
        on = move(t)
        if on.all():
            matrix = matrix @ moves
        elif on.any():
            matrix[on] = matrix[on] @ moves
        matrix *= emit[:, None, t]
        matrix /= matrix.sum((1, 2), keepdims=True)
    into, out = np.empty((total, size)), np.empty((total, size))
    order = np.argsort(-blocks, kind="stable")
    ahead = np.broadcast_to(np.exp(start - start.max()), (seq, size)).copy()
    back = np.ones((seq, size))
    live = np.searchsorted(-blocks[order], -np.arange(1, blocks.max(initial=0) + 1), "right")
    for k, n in enumerate(live):
        own = order[:n]
        into[first[own] + k] = ahead[own]
        nxt = np.einsum("ni,nij->nj", ahead[own], matrix[first[own] + k])
        ahead[own] = nxt / nxt.sum(1, keepdims=True)
    for k in range(len(live) - 1, -1, -1):
        own = order[: live[k]]
        out[first[own] + k] = back[own]
        nxt = np.einsum("nij,nj->ni", matrix[first[own] + k], back[own])
        back[own] = nxt / nxt.sum(1, keepdims=True)
    forward = np.empty((total, BLOCK, size))
    for t in range(BLOCK):
        on = move(t)
        into = np.where(on[:, None], into @ moves, into) * emit[:, t]
        into /= into.sum(1, keepdims=True)
        forward[:, t] = into
    for t in range(BLOCK - 1, -1, -1):
        forward[:, t] *= out
        back_of = out * emit[:, t]
        out = np.where(move(t)[:, None], back_of @ moves.T, back_of)
        out /= out.sum(1, keepdims=True)
    found = forward.reshape(-1, size)[at]
    return found / found.sum(1, keepdims=True)


# Learning ----------------------------------------------------------------------------------


def learn(texts: list[str], langs: list[str], seed: int = 1) -> Model:
    """A model of labelled texts: lexicons first, then all weights by Adagrad on the likelihood."""
    rng, labels = np.random.default_rng(seed), sorted(set(langs))
    size = len(labels)
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    data = _small(data)
    starts, ends, text = runs(data, offsets, LETTER)
    gold = np.array([labels.index(x) for x in langs], np.int64)[text]
    prefix = prefix_hash(data)
    words = span_hash(prefix, starts, ends)
    lexicon, lexicon_label = _lexicon(words, gold, size)
    model = Model(labels, np.zeros((BUCKETS, size)), lexicon, lexicon_label, np.zeros((size + 1, size)),
                  np.zeros((size, size)), np.zeros(size))
    if not len(words):
        return model
    used, chain = np.unique(_switching(text, rng), return_inverse=True)
    chain = chain.reshape(-1, LENGTH)
    starts, ends, gold, words = starts[used], ends[used], gold[used], words[used]
    parts = list(zip(*_parts(prefix, starts, ends), strict=True))
    where = np.concatenate(parts[0])
    bucket = np.concatenate(parts[1]).astype(np.int64)
    order = np.argsort(where, kind="stable")
    bucket, edge = bucket[order], np.searchsorted(where[order], np.arange(len(words) + 1))
    lexical = _lexical(model, words)
    params = [model.weights, model.lexicon_weights, model.transitions, model.start]
    sums = [np.full_like(p, 1e-6) for p in params]
    for _ in range(PASSES):
        for batch in np.array_split(rng.permutation(len(chain)), max(1, len(chain) // BATCH)):
            at = chain[batch].ravel()
            count = edge[at + 1] - edge[at]
            own = np.repeat(np.arange(len(at)), count)
            of = bucket[np.repeat(edge[at] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
            scores = np.stack([np.bincount(own, model.weights[of, k], len(at)) for k in range(size)], 1)
            scores += model.lexicon_weights[lexical[at]]
            grads = _gradient(scores.reshape(len(batch), -1, size), gold[at].reshape(len(batch), -1), model)
            miss = grads[0].reshape(-1, size)
            steps_ = [
                np.stack([np.bincount(of, miss[own, k], BUCKETS) for k in range(size)], 1),
                np.stack([np.bincount(lexical[at], miss[:, k], size + 1) for k in range(size)], 1),
                grads[1], grads[2],
            ]
            for p, s, g in zip(params, sums, steps_, strict=True):
                g = g / len(batch) - RIDGE * p
                s += g * g
                p += RATE * g / np.sqrt(s)
    return model


def _lexicon(words: np.ndarray, gold: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent words of which one language has four fifths, by hash, with that language."""
    known, where = np.unique(words, return_inverse=True)
    counts = np.stack([np.bincount(where[gold == k], minlength=len(known)) for k in range(size)], 1)
    best, total = counts.argmax(1), counts.sum(1)
    good = (total >= 3) & (counts.max(1) >= 0.8 * total)
    keep = [np.flatnonzero(good & (best == k)) for k in range(size)]
    keep = np.sort(np.concatenate([x[np.argsort(-total[x], kind="stable")[:LEXICON]] for x in keep]))
    return known[keep], best[keep]


def _switching(text: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Word numbers of sequences that switch between random spans of random texts."""
    words = np.concatenate([
        np.arange(s, min(s + n, len(text)))
        for s, n in zip(rng.integers(0, len(text), SEQUENCES * LENGTH // SPAN[0]),
                        rng.integers(*SPAN, SEQUENCES * LENGTH // SPAN[0]), strict=True)
    ])
    count = min(SEQUENCES, max(1, len(words) // LENGTH), max(1, 4 * len(text) // LENGTH))
    return np.resize(words, count * LENGTH).reshape(count, LENGTH)


def _gradient(scores: np.ndarray, gold: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gold less expected counts: of labels at words, of transitions, of first labels."""
    n, length, size = scores.shape
    emit = np.exp(scores - scores.max(2, keepdims=True))
    moves = np.exp(model.transitions)
    ahead, back = np.empty_like(emit), np.empty_like(emit)
    state = np.exp(model.start) * emit[:, 0]
    for t in range(length):
        state = state if t == 0 else (state @ moves) * emit[:, t]
        state = state / state.sum(1, keepdims=True)
        ahead[:, t] = state
    state = np.ones((n, size))
    for t in range(length - 1, -1, -1):
        back[:, t] = state
        state = (state * emit[:, t]) @ moves.T
        state = state / state.sum(1, keepdims=True)
    post = ahead * back
    post /= post.sum(2, keepdims=True)
    pair = ahead[:, :-1, :, None] * moves * (emit * back)[:, 1:, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    hot = np.eye(size)[gold]
    true_pair = np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:])
    return hot - post, true_pair - pair.sum((0, 1)), (hot[:, 0] - post[:, 0]).sum(0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of (doc_id, text, lang) rows; None if no row has all of them and a letter.

    At most ``sample`` rows of different ids are learned from, those whose ids hash lowest, in one
    task; their texts have SAMPLE_BYTES at most, and one that does not fit is left out whole.
    """
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    rows = sampled(rows.where(F.col("text").rlike(r"\p{L}")), "doc_id", sample, "text", SAMPLE_BYTES)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text", "lang"], kind="stable")
        model = learn(rows["text"].tolist(), rows["lang"].tolist())
        out = [x.astype("<f8").tobytes() for x in model[1:2] + model[4:]]
        return pd.DataFrame([[model.labels, model.lexicon.tobytes(), model.lexicon_label.astype("<i8").tobytes(), *out]],
                            columns=["labels", "words", "of", "w", "lw", "t", "s"])

    schema = "labels array<string>, words binary, of binary, w binary, lw binary, t binary, s binary"
    found = rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, schema).collect()
    if not found:
        return None
    r, size = found[0], len(found[0].labels)
    return Model(
        list(r.labels), np.frombuffer(r.w).reshape(BUCKETS, size).astype(np.float32),
        np.frombuffer(r.words, np.uint64), np.frombuffer(r.of, np.int64),
        np.frombuffer(r.lw).reshape(size + 1, size), np.frombuffer(r.t).reshape(size, size), np.frombuffer(r.s),
    )


# Labelling ---------------------------------------------------------------------------------


def label_words(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and posteriors of all words of the texts in one byte array."""
    data = _small(data)
    starts, ends, text = runs(data, offsets, LETTER)
    if not len(starts):
        return text, np.zeros((0, len(model.labels)))
    lengths = np.bincount(text, minlength=len(offsets) - 1)
    scores = emissions(model, data, starts, ends)
    return text, marginals(scores, lengths[lengths > 0], model.transitions, model.start)


def _spans(labels: list[str], best: np.ndarray) -> list[dict]:
    if not len(best):
        return []
    edge = np.flatnonzero(np.diff(best)) + 1
    return [
        {"first": int(a), "last": int(b) - 1, "lang": labels[best[a]]}
        for a, b in zip([0, *edge], [*edge, len(best)], strict=True)
    ]


def identify(
    docs: DataFrame, model: Model | None, text: str = "text", spans: bool = False,
    names: tuple[str, str] = ("lang_pred", "score"), certainty: str | None = None,
) -> DataFrame:
    """The columns of ``docs`` and lang_pred and score; columns of these ``names`` are replaced.

    lang_pred is the label with the largest summed posterior over a text's words, score its mean
    posterior. A null text, one without a letter, and every text without a model get ``und`` and 0.
    ``spans`` adds the runs of words, by number from 0, whose likeliest labels agree; ``certainty``
    names a column for the mean of each word's largest posterior, 0 where the score is 0.
    """
    more = [certainty] if certainty else []
    docs = docs.drop(*names, *["lang_spans"] * spans, *more)
    at, out_names = docs.columns.index(text), [*docs.columns, *names, *["lang_spans"] * spans, *more]
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        column, langs, scores, found, sure = batch.column(at), [], [], [], []
        data, offsets = utf8(column)
        for part in steps(np.diff(offsets)):
            own = offsets[part.start: part.stop + 1]
            n = len(own) - 1
            plain = data[own[0]: own[-1]]
            if model is None:
                text_of, post, labels = np.zeros(0, np.int64), np.zeros((0, 1)), [UNKNOWN]
            else:
                text_of, post = label_words(model, plain, own - own[0])
                labels = model.labels
            total = np.stack([np.bincount(text_of, post[:, k], n) for k in range(post.shape[1])], 1)
            count = np.bincount(text_of, minlength=n)
            best = total.argmax(1)
            mean = np.clip(total[np.arange(n), best] / np.maximum(count, 1), 0, 1)
            edge = np.searchsorted(text_of, np.arange(n + 1))
            likeliest = post.argmax(1)
            if more:
                clear = np.bincount(text_of, post.max(1), n) / np.maximum(count, 1)
            for i in range(n):
                there = count[i] > 0
                if there:
                    body = plain[own[i] - own[0]: own[i + 1] - own[0]]
                    there = bool(_ASCII[body].any()) or bool(_LETTER.search(body.tobytes().decode()))
                langs.append(labels[best[i]] if there else UNKNOWN)
                scores.append(float(mean[i]) if there else 0.0)
                if more:
                    sure.append(float(min(clear[i], 1)) if there else 0.0)
                if spans:
                    found.append(_spans(labels, likeliest[edge[i]: edge[i + 1]]) if there else [])
        new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *[pa.array(found, kind)] * spans]
        new += [pa.array(sure, pa.float64())] * len(more)
        return pa.RecordBatch.from_arrays([*batch.columns, *new], out_names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    fields += [f"`{names[0]}` string", f"`{names[1]}` double"]
    fields += ["lang_spans array<struct<first:int,last:int,lang:string>>"] * spans
    fields += [f"`{name}` double" for name in more]
    return by_batch(docs, work, ", ".join(fields))


_ASCII = LETTER & (np.arange(256) < 128)
