"""Words and their 64-bit hashes straight from Arrow string buffers, in NumPy, without a Python object per word.

A word is a maximal run of bytes of a class. Classes are sets of ASCII bytes plus all or none of 0x80-0xFF, so a run never
cuts a UTF-8 character. Memory is bounded by the piece size, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(predicate) -> np.ndarray:
    """A table of 256 booleans: which bytes belong to words."""
    return np.array([bool(predicate(b)) for b in range(256)])


#: Anything but the blank and the control blanks 0x09-0x0D.
NOT_BLANK = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Digits, a-z and every byte of a non-ASCII character (after lower-casing A-Z).
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def _power(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
        out[0] = 1
        have = _powers[name] = np.cumprod(out, dtype=np.uint64)
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[start:end] for each span; equal bytes give equal hashes in any process."""
    n = len(data)
    up, down = _power(_BASE, n + 1, "up"), _power(_INVERSE, n + 1, "down")
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def pieces(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that cut no word: at the ends of texts or between words."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + PIECE, n)
        if to < n:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:
                out = np.flatnonzero(~inside[data[at:to]])
                if len(out):
                    to = at + int(out[-1]) + 1
                else:  # one word longer than a piece
                    end = int(offsets[k + 1])
                    while to < end and inside[data[to]]:
                        more = np.flatnonzero(~inside[data[to : min(to + PIECE, end)]])
                        to = to + int(more[0]) if len(more) else min(to + PIECE, end)
        yield at, to
        at = to


def spans(offsets: np.ndarray, data: np.ndarray, at: int, to: int, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, from at, of the words of data[at:to]; the end of a text ends a word."""
    flags = np.zeros(to - at + 1, dtype=bool)
    flags[:-1] = inside[data[at:to]]
    first = flags[:-1].copy()
    first[1:] &= ~flags[:-2]
    last = flags[:-1] & ~flags[1:]
    lo, hi = np.searchsorted(offsets, at, "right"), np.searchsorted(offsets, to, "left")
    cuts = offsets[lo:hi] - at  # the texts that begin inside
    if len(cuts):
        first[cuts] = flags[cuts]
        last[cuts - 1] |= flags[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(texts: pa.Array, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its text's index) over all texts, in order."""
    offsets, data = buffers(texts)
    hashes, owners = [], []
    for at, to in pieces(offsets, data, inside) if not lower else pieces(offsets, data, inside | inside[LOWER]):
        piece = LOWER[data[at:to]] if lower else data[at:to]
        s, e = spans(offsets - at, piece, 0, to - at, inside)
        if len(s):
            hashes.append(span_hashes(piece, s, e))
            owners.append((np.searchsorted(offsets, s + at, "right") - 1).astype(np.int64))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def small_batches(batches, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows so that one holds about limit bytes of the column, or one row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        offsets, _ = buffers(b.column(b.schema.get_field_index(column)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield b.slice(at, to - at)
            at = to
