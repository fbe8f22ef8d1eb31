"""64-bit hashes of words and word shingles, for all bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit number for each of 64 places in a word and each byte there, an odd multiplier for places further on, and one
#: odd multiplier for each place in a shingle.
_CELLS = _rng.integers(0, 1 << 64, 64 * 256, np.uint64)
_TURN = np.uint64(int(_rng.integers(0, 1 << 63)) * 2 + 1)
_PLACES = _rng.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of them (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(texts: list[bytes] | list[str], size: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `size` bytes (characters), one text at least."""
    first = total = 0
    for i, text in enumerate(texts):
        if i > first and total + len(text) > size:
            yield first, i
            first, total = i, 0
        total += len(text)
    if len(texts) > first:
        yield first, len(texts)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first words of the texts and the end, starts, ends) of the words of `texts`, A-Z lowered.

    Words are runs of other bytes than space and U+0009 to U+000D. Starts and ends are places in b" ".join(texts).
    A word's hash adds up a random number for each of its bytes at its place (tabulation; from place 64 on mixed with the
    round), so no pattern of letters cancels out, and one running sum over all bytes gives all of them.
    """
    data = LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    white = _IS_WHITE[data]
    inside = np.concatenate([[False], ~white, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    firsts = np.searchsorted(starts, bounds)
    begin = np.zeros(len(data), np.int64)
    begin[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(begin)
    value = _CELLS[((place & 63) << 8) | data]
    far = np.flatnonzero((place > 63) & ~white)
    if len(far):
        value[far] = mix(value[far] + (place[far] >> 6).astype(np.uint64) * _TURN)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return mix(run[ends] - run[starts] + (ends - starts).astype(np.uint64)), firsts, starts, ends


def numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the distinct strings one behind the other, their offsets, number of each string among them) of the strings
    that lie in `data` from one offset to the next."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers).dictionary_encode()
    own = coded.dictionary
    ends = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1) if len(own) else np.zeros(1, np.int64)
    return np.frombuffer(own.buffers()[2], np.uint8, ends[-1]) if len(own) else np.zeros(0, np.uint8), ends, coded.indices.to_numpy()


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the distinct words, their offsets, number of every word among them, first words of the texts and the end); words
    as in `words`, but no letter is lowered."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    inside = np.concatenate([[False], ~_IS_WHITE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    own = numbered(data[inside[1:-1]], np.concatenate([[0], np.cumsum(ends - starts)]))
    return *own, np.searchsorted(starts, bounds)


def strung(values: list[bytes], number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the 32-bit numbers of values[k] for each k of `number`, one behind the other, their offsets)."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) >> 2
    begin = np.cumsum(sizes) - sizes
    offsets = np.concatenate([[0], np.cumsum(sizes[number])])
    at = np.repeat(begin[number] - offsets[:-1], sizes[number])
    return np.frombuffer(b"".join(values), "<u4")[at + np.arange(len(at))], offsets


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first shingles of the texts and the end) of all windows of `width` words; shorter texts are one shingle, if they have words."""
    counts = np.diff(firsts)
    n = len(hashes)
    total = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        total += hashes[k : k + len(total)] * _PLACES[k]
    number = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(number)])
    long = np.flatnonzero(counts >= width)
    out = np.empty(int(bounds[-1]), np.uint64)
    keep = np.zeros(len(total) + 1, np.int64)
    np.add.at(keep, firsts[:-1][long], 1)
    np.add.at(keep, firsts[1:][long] - width + 1, -1)
    inside = np.cumsum(keep[:-1]) > 0 if len(total) else np.zeros(0, bool)
    slot = np.ones(len(out), bool)
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = hashes[firsts[i] : firsts[i + 1]]
        out[bounds[i]] = np.sum(own * _PLACES[: len(own)], dtype=np.uint64) + np.uint64(len(own))
        slot[bounds[i]] = False
    out[slot] = total[inside]
    return mix(out), bounds
