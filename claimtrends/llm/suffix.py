"""Suffix arrays by induced sorting, on whole arrays at a time.

A suffix is S if it is smaller than the next one and L if larger; a leftmost S (LMS) suffix
follows an L. LMS substrings, from one LMS position to the next, are named by rank; if names tie,
the text of the names, at most half as long, is sorted by the same algorithm, which orders the
LMS suffixes. From them one scan of the buckets induces the L suffixes, and one backwards the S
suffixes. A scan takes as many buckets at a time as induce nothing among themselves, since the
alphabet of a text of names is nearly as large as the text.
"""

from __future__ import annotations

import numpy as np


def _kinds(text: np.ndarray) -> np.ndarray:
    """True where the suffix is S. The text ends with its one smallest symbol."""
    step = text[1:].astype(np.int32) - text[:-1]
    at = np.where(step != 0, np.arange(len(step)), len(step))
    later = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(step[later] > 0, True)


def _refine(rank: np.ndarray, rows: np.ndarray, key: np.ndarray) -> None:
    """Order rows of equal rank by ``key``; a rank is the number of rows that are smaller."""
    order = np.lexsort((key, rank[rows]))
    rows, key = rows[order], key[order]
    own = rank[rows]
    fresh = np.concatenate([[True], own[1:] != own[:-1]])
    differs = fresh | np.concatenate([[True], key[1:] != key[:-1]])
    at = np.arange(len(rows))
    group = np.maximum.accumulate(np.where(fresh, at, 0))
    rank[rows] = own + np.maximum.accumulate(np.where(differs, at, 0)) - group


def _tied(rank: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows that share their rank with another row."""
    count = np.bincount(rank, minlength=len(rank))
    return rows[count[rank[rows]] > 1]


def _names(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The rank of each LMS substring, by symbols and kinds; equal substrings share theirs."""
    count = len(lms)
    length = np.append(np.diff(lms) + 1, 1)
    bits = (2 * int(text.max()) + 1).bit_length()
    wide = 62 // bits
    rank, rows, done = np.zeros(count, np.int64), np.arange(count), 0
    while len(rows):
        key = np.zeros(len(rows), np.uint64)
        for j in range(wide):
            inside = done + j < length[rows]
            at = lms[rows] + np.where(inside, done + j, 0)
            sign = text[at].astype(np.uint64) * np.uint64(2) + small[at]
            key = key << np.uint64(bits) | np.where(inside, sign, 0).astype(np.uint64)
        _refine(rank, rows, key)
        done += wide
        rows = _tied(rank, rows[length[rows] > done])
    return rank


def order_lms(text: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The LMS positions in the order of their suffixes."""
    rank = _names(text, small, lms)
    used = np.bincount(rank, minlength=len(lms)) > 0
    if used.all():
        return lms[np.argsort(rank, kind="stable")]
    names = np.cumsum(used)[rank] - 1  # the last substring is the end alone, and so the only 0
    return lms[suffix_array(names.astype(np.int32))]


def _put(order: np.ndarray, head: np.ndarray, positions: np.ndarray, symbol: np.ndarray) -> None:
    """Positions to the heads of their symbols' buckets, in the order given."""
    if not len(positions):
        return
    by = np.argsort(symbol, kind="stable")
    positions, symbol = positions[by], symbol[by]
    first = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
    count = np.diff(np.append(first, len(symbol)))
    order[head[symbol] + np.arange(len(symbol)) - np.repeat(first, count)] = positions
    head[symbol[first]] += count


def _chains(text: np.ndarray, run: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What a bucket's positions induce within it: first all one step back, then all two steps."""
    back = before[run]
    on = np.flatnonzero(back)
    owner = np.repeat(on, back[on])
    step = np.arange(len(owner)) - np.repeat(np.cumsum(back[on]) - back[on], back[on]) + 1
    by = np.argsort(step, kind="stable")
    return run[owner[by]] - step[by]


def _induce(text: np.ndarray, wanted: np.ndarray, order: np.ndarray, start: np.ndarray) -> None:
    """Fill the heads of the buckets of ``order`` by one scan; -1 marks what is empty.

    ``wanted`` are the suffixes to place; what stands at the ends of the buckets is there already.
    A wanted suffix lies in the bucket of the one that induces it, or in a later one.
    """
    head, symbols = start[:-1].copy(), len(start) - 1
    # how many equal symbols go before a position; their suffixes are of its kind
    at = np.arange(len(text))
    change = np.concatenate([[True], text[1:] != text[:-1]])
    before = at - np.maximum.accumulate(np.where(change, at, 0))
    low, size = 0, 1
    while low < symbols:
        high = min(symbols, low + size)
        seen = order[start[low]:start[high]]
        seen = seen[seen > 0]
        made = seen - 1
        made = made[wanted[made]]
        symbol = text[made]
        least = int(symbol.min()) if len(symbol) else symbols
        if least >= high:
            _put(order, head, made, symbol)
            low, size = high, 2 * size
        elif least > low:
            size = least - low
        else:
            run = order[start[low]:head[low]]
            more = _chains(text, run, before)
            order[head[low]:head[low] + len(more)] = more
            head[low] += len(more)
            seen = order[start[low]:start[low + 1]]
            made = seen[seen > 0] - 1
            made = made[wanted[made] & (text[made] != low)]
            _put(order, head, made, text[made])
            low, size = low + 1, max(1, size // 2)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes in order. The last symbol is 0 and the only one."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    small = _kinds(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    lms = order_lms(text, small, lms)
    symbols = int(text.max()) + 1
    start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
    order = np.full(n, -1, np.int32 if n < 2**31 else np.int64)
    owner = text[lms].astype(np.int64)
    later = np.searchsorted(owner, owner, "right") - np.arange(len(lms))
    order[start[owner + 1] - later] = lms
    _induce(text, ~small, order, start)
    order[(order >= 0) & small[order]] = -1
    # backwards, the same scan places the S suffixes
    _induce((symbols - 1 - text.astype(np.int32)), small, order[::-1], (n - start)[::-1])
    order[0] = n - 1
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text position: the preceding suffix in the array, and the length of their common prefix.

    A position whose suffix and predecessor are led by equal symbols has one less than the position
    before it; only the others are compared, four symbols at a time.
    """
    n = len(text)
    previous = np.full(n, -1, np.int64)
    previous[order[1:]] = order[:-1]
    has = previous >= 0
    own = np.flatnonzero(has)
    led = (own > 0) & (previous[own] > 0)
    led[led] = text[own[led] - 1] == text[previous[own[led]] - 1]
    base = own[~led]
    wide = np.concatenate([text.astype(np.uint16), np.zeros(4, np.uint16)])
    four = np.lib.stride_tricks.as_strided(wide.view(np.uint8), (n + 1, 8), (2, 1)).copy().view(np.uint64)[:, 0]
    length, rows = np.zeros(len(base), np.int64), np.arange(len(base))
    while len(rows):
        rows = rows[four[base[rows] + length[rows]] == four[previous[base[rows]] + length[rows]]]
        length[rows] += 4
    for _ in range(3):
        same = wide[base + length] == wide[previous[base] + length]
        length += same
        if not same.any():
            break
    out = np.zeros(n, np.int64)
    out[base] = length
    start = np.full(n, -1, np.int64)
    start[base] = base
    start = np.maximum.accumulate(start)
    rest = own[led]
    out[rest] = out[start[rest]] - (rest - start[rest])
    return previous, out


def repeated(text: np.ndarray, least: int) -> np.ndarray:
    """Which positions share at least ``least`` symbols with another position's suffix."""
    previous, length = common_prefixes(text, suffix_array(text))
    out = length >= least
    out[previous[out]] = True
    return out
