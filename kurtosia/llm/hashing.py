"""Vectorised word hashes and rolling (Rabin-Karp) window hashes over the UTF-8 bytes of an Arrow string column.

All functions run inside Spark tasks on one slice of documents at a time.  A word's
hash sums one pseudo-random number for each byte and place in the word: no pattern
of bytes cancels out, as patterns do in a polynomial modulo 2**64.  The rolling hash
of items x_s..x_{e-1} is sum(x_j * B**(j-s)) modulo 2**64; prefix sums make every
window of a slice one subtraction and one multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
GOLDEN = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93 | 1
SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: For each of the first 64 places in a word and each byte, its number; ``code`` is place * 256 + byte.
_BYTE_AT = mix(np.arange(1, 64 * 256 + 1, dtype=U) * U(GOLDEN))


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, SLICE_BYTES)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(n, b, dtype=U)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        have = _powers[base] = (out[0], out[1])
    return have


def rolling(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of x[starts[i]:ends[i]] (uint64), before mixing."""
    power, inverse = _power_tables(base, len(x) + 1)
    total = np.empty(len(x) + 1, dtype=U)
    total[0] = 0
    np.cumsum(x * power[: len(x)], out=total[1:])
    return (total[ends] - total[starts]) * inverse[starts]


def utf8_slices(column: pa.ChunkedArray | pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes; nulls read as empty texts.

    A longer single text is one slice of its own: texts are never cut.
    """
    row = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.fill_null("") if part.null_count else part
        wide = pa.types.is_large_string(part.type)
        _, offsets, data = part.buffers()
        n = len(part)
        if not n:
            continue
        offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[part.offset : part.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < n:
            to = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
            to = min(n, max(to, at + 1))
            yield row + at, raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
        row += n


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a slice, and each document's bounds among them."""
    n = len(data)
    inside = ~_SEPARATOR[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True  # a document's first byte never continues the word before it
    before = np.concatenate(([False], inside[:-1])) if n else inside
    start = inside & (~before | first[:n])
    after = np.concatenate((inside[1:], [False])) if n else inside
    end = inside & (~after | first[1:])
    s = np.flatnonzero(start)
    return s, np.flatnonzero(end) + 1, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A mixed 64-bit hash of every word; ``lower`` folds A-Z first."""
    place = np.zeros(len(data), dtype=np.int64)
    place[starts] = starts
    place = np.arange(len(data)) - np.maximum.accumulate(place)
    code = place * 256 + (_LOWER[data] if lower else data)
    short = len(_BYTE_AT) > (int(code.max()) if len(code) else 0)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_BYTE_AT[code] if short else mix((code + 1).astype(U) * U(GOLDEN)), out=total[1:])
    return mix(total[ends] - total[starts] + (ends - starts).astype(U))


def window_hashes(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (word index) and mixed hash of every window of ``width`` words that lies in one document."""
    lengths = np.diff(bounds)
    n = np.maximum(lengths - width + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    begin = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(total)
    return begin, mix(rolling(h, begin, begin + width, WORD_BASE) + U(width))


def other_window_hashes(h: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """A second hash of the windows that start at ``begin``, of another kind: the exclusive or of the words' numbers, each turned by its place."""
    g = mix(h ^ U(0xA0761D6478BD642F))
    turn = (np.arange(len(g), dtype=U) & U(63)).astype(U)
    total = np.zeros(len(g) + 1, dtype=U)
    np.bitwise_xor.accumulate(_turned(g, turn), out=total[1:])
    back = (U(64) - (begin.astype(U) & U(63))) & U(63)
    return mix(_turned(total[begin + width] ^ total[begin], back))


def _turned(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Rotation of the 64 bits to the left."""
    return (x << by) | (x >> ((U(64) - by) & U(63)))


def kept_texts(data: np.ndarray, s: np.ndarray, e: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by one space."""
    k = np.flatnonzero(keep)
    kept_bounds = np.searchsorted(k, bounds)
    size = e[k] - s[k] + 1
    filled = kept_bounds[1:] > kept_bounds[:-1]
    last = kept_bounds[1:][filled] - 1
    size[last] -= 1  # no space after a document's last word
    end = np.cumsum(size)
    source = np.repeat(s[k] - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)
    out = np.concatenate((data, np.zeros(1, dtype=np.uint8)))[source]
    spaced = np.ones(len(k), dtype=bool)
    spaced[last] = False
    out[end[spaced] - 1] = 0x20
    offsets = np.concatenate(([0], end))[kept_bounds].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])
