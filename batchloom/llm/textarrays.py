"""Whole Arrow columns of texts as flat numpy arrays.

A word is a maximal run of bytes other than ASCII white space. Everything here
works on whole texts; null texts count as empty.
"""

from __future__ import annotations

import builtins
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
WORD_BASE = 0x9E3779B97F4A7C15 | 1
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _cache() -> dict:
    """Tables kept for the life of a worker process, outside of what is pickled."""
    return builtins.__dict__.setdefault("_batchloom_tables", {})


def _space() -> np.ndarray:
    tables = _cache()
    if "space" not in tables:
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        tables["space"] = space
    return tables["space"]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64, for k < n at least."""
    tables = _cache()
    known = tables.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16, 0 if known is None else min(2 * len(known[0]), 1 << 21))
        with np.errstate(over="ignore"):
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                row = np.full(size, b, U64)
                row[0] = 1
                both.append(np.multiply.accumulate(row))
        known = tables[base] = (both[0], both[1])
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the n + 1 offsets of the rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def sliced(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive runs of rows with about ``most`` bytes of text, a row at least."""
    if not batch.num_rows:
        return
    _, off = flat(batch.column(text))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def pieces(batch: pa.RecordBatch, overlap: int = 0, text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(bytes, offsets, first row, number of its first word) of runs of rows with about ``most`` bytes.

    A longer row comes in pieces of its own, cut between words; each but the first
    repeats the last ``overlap`` words of the one before, so that every run of ``overlap`` + 1 words lies in one piece
    and no task holds more than a piece in any wider form.
    """
    if not batch.num_rows:
        return
    data, off = flat(batch.column(text))
    at = 0
    while at < batch.num_rows:
        if off[at + 1] - off[at] > 2 * most:
            for low, high, base in _cuts(data[off[at] : off[at + 1]], overlap, most):
                part = data[off[at] + low : off[at] + high]
                yield part, np.array([0, len(part)]), at, base
            at += 1
            continue
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield data[off[at] : off[end]], off[at : end + 1] - off[at], at, 0
        at = end


def _cuts(data: np.ndarray, overlap: int, most: int) -> Iterator[tuple[int, int, int]]:
    """First and last byte of each piece of a long text, and the number of its first word."""
    at, size, base = 0, most, 0
    while True:
        end = min(at + size, len(data))
        while end < len(data):  # on to the end of a word
            blank = np.flatnonzero(_space()[data[end : end + most]])
            end += int(blank[0]) if len(blank) else min(most, len(data) - end)
            if len(blank):
                break
        starts = words(data[at:end], np.array([0, end - at]))[0]
        if end < len(data) and len(starts) <= overlap:
            size *= 2
            continue
        yield at, end, base
        if end == len(data):
            return
        base += len(starts) - overlap
        at, size = at + int(starts[len(starts) - overlap]) if overlap else end, most


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 offsets of the rows in these."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ink = ~_space()[data]
    begin, end = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1]
    end[:-1] &= ~ink[1:]
    edge = off[(off > 0) & (off < len(data))]
    begin[edge] = ink[edge]
    end[edge - 1] = ink[edge - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), U64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + SLICE_BYTES, "right")))
            high = ends[to - 1]
            if high - low > 4 * SLICE_BYTES:  # one long word, in blocks
                up, _ = powers(WORD_BASE, SLICE_BYTES)
                total, size = 0, int(high - low)
                for a in range(0, size, SLICE_BYTES):
                    part = data[low + a : min(low + a + SLICE_BYTES, high)]
                    total += int(((part + U64(1)) * up[: len(part)]).sum(dtype=U64)) * pow(WORD_BASE, a, 1 << 64)
                out[at] = mix(np.array([(total + size) % (1 << 64)], U64))[0]
                at = to
                continue
            up, down = powers(WORD_BASE, int(high - low) + 1)
            total = np.empty(high - low + 1, U64)
            total[0] = 0
            np.cumsum((data[low:high] + U64(1)) * up[: high - low], out=total[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            out[at:to] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64))
            at = to
    return out


def window_hashes(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each run of ``width`` words, for starts 0 .. n - width, rows aside."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64)
    out = np.empty(n - width + 1, U64)
    step = 1 << 20
    with np.errstate(over="ignore"):
        for at in range(0, len(out), step):
            part = hashes[at : at + step + width - 1]
            up, down = powers(base, len(part) + 1)
            total = np.empty(len(part) + 1, U64)
            total[0] = 0
            np.cumsum(part * up[: len(part)], out=total[1:])
            m = len(part) - width + 1
            out[at : at + m] = mix((total[width:] - total[:m]) * down[:m])
    return out


def window_starts(word_off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and row of each window that lies within one row."""
    counts = np.maximum(np.diff(word_off) - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return word_off[row] + within, row
