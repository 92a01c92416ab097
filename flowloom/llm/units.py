"""Texts as arrays of units: words or bytes of a whole Arrow batch at a time, hashed with numpy.

A hash of a sequence is the polynomial of its unit values modulo 2^64, from running sums, then mixed.
Unit values are random 64-bit numbers, so that no text is special. Two different sequences agree with
a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _random.integers(0, 1 << 64, 256, dtype=U64) | U64(1)
#: Odd bases of the polynomials: of words from bytes, of sequences, and of a second hash of sequences.
BASES = [int(x) | 1 for x in _random.integers(0, 1 << 64, 3, dtype=U64)]

#: Word characters as bytes of UTF-8: all but space and tab to carriage return.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, lower-case letters and everything beyond ASCII.
ALNUM_BYTES = np.zeros(256, bool)
ALNUM_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: Bytes of text handled at once; a longer text is a block of its own. Memory is some 60 times that.
BLOCK = 256 << 10


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(which: int, sign: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base, or of its inverse."""
    have = _powers.get((which, sign))
    if have is None or len(have) < n:
        base = BASES[which] if sign > 0 else pow(BASES[which], -1, 1 << 64)
        have = np.full(max(n, BLOCK + 1), base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if n <= 4 * BLOCK:
            _powers[which, sign] = have
    return have[:n]


def sums(values: np.ndarray, which: int) -> np.ndarray:
    """Running sums from which ``spans`` takes the hash of any range."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(which, 1, len(values)), out=out[1:])
    return out


def spans(running: np.ndarray, which: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the ranges from ``starts`` to before ``ends``; the length counts."""
    poly = (running[ends] - running[starts]) * powers(which, -1, len(running))[starts]
    return mixed(poly + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes, and row bounds of successive blocks of a text column. Null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
        yield row, raw[bounds[row]:bounds[stop]], bounds[row:stop + 1] - bounds[row]
        row = stop


def word_bounds(data: np.ndarray, bounds: np.ndarray, letters: np.ndarray = WORD_BYTES):
    """Starts and ends of words in the bytes, and the bounds of each row's words among them."""
    inside = letters[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    filled = bounds[:-1] < bounds[1:]
    before[bounds[:-1][filled]] = False
    after[bounds[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans(sums(BYTE_VALUES[data], 0), 0, starts, ends)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each unit."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def grams(units: np.ndarray, bounds: np.ndarray, n: int):
    """Hashes of all runs of ``n`` units within a row, and the bounds of each row's runs among them.

    A row of fewer units, but not none, gives one run: all it has.
    """
    sizes = np.diff(bounds)
    counts = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    row = row_of(out)
    starts = np.arange(out[-1]) - out[:-1][row] + bounds[:-1][row]
    ends = np.minimum(starts + n, bounds[1:][row])
    return spans(sums(units, 1), 1, starts, ends), out


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every ``width`` successive ones."""
    n = len(keys)
    if n < width:
        return np.zeros(0, keys.dtype)
    whole = np.full(-(-n // width) * width, np.iinfo(keys.dtype).max, keys.dtype)
    whole[:n] = keys
    table = whole.reshape(-1, width)
    prefix = np.minimum.accumulate(table, axis=1).ravel()
    suffix = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n - width + 1], prefix[width - 1:n])
