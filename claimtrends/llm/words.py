"""Words of many texts at once: their bounds in a byte array, and hashes of words and n-grams."""

from __future__ import annotations

import numpy as np

#: ASCII capitals to small letters; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FACTORS = np.random.default_rng(6).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def byte_table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Bytes of a word: ASCII letters and digits, and every byte of other characters.
WORD = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
#: Bytes of letters: the same without digits.
LETTER = WORD & ~byte_table(b"0123456789")


class _Powers:
    """Powers of the hash base and of its inverse, as far as asked for; travels empty."""

    def __init__(self) -> None:
        self.held = (np.ones(1, np.uint64),) * 2

    def __reduce__(self) -> tuple:
        return _Powers, ()

    def __call__(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held[0]) <= size:
            count, out = 1 << max(16, int(size).bit_length()), []
            for base in (_BASE, pow(_BASE, -1, 2**64)):
                table = np.ones(count + 1, np.uint64)
                np.multiply.accumulate(np.full(count, base, np.uint64), out=table[1:])
                out.append(table)
            self.held = out[0], out[1]
        return self.held


powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of maximal runs of the table's bytes; none crosses texts."""
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hash(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(len(data))[0][: len(data)], out=total[1:])
    return total


def raw_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hash`` before mixing: as good for equality, not for its bits."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever the bytes stand."""
    return mix(raw_hash(prefix, starts, ends))


def grams(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words within a text, and the first word of each."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(hashes) - n + 1
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out += hashes[j: j + count] * _FACTORS[j]
    first = np.flatnonzero(text[:count] == text[n - 1:])
    return mix(out[first]), first
