"""Repeated word windows: count-min prefilter (5) and depth-limited radix sort (7).

Both find every window of ``width`` consecutive words that occurs twice or more
in the corpus, and both report per document the maximal runs of repeated
windows. They share one layout, in which nothing is broadcast and no task holds
more than one shard or one chunk of documents:

1. Documents are hashed into chunks of about ``chunk_bytes`` of text.
2. Each chunk sends, per shard of the key space, its cells (hash digits of its
   windows) as one sorted, bit-coded blob: the sparse form of a partition's
   sketch or histogram. The sender keeps two of equal cells, as only "once" and
   "more" matter.
3. Each shard adds up its blobs and returns to each chunk the cells counted
   twice or more. A window whose cell is missing from what returns occurs once:
   counts are never too low, so no repeated window is lost.
4. Each chunk sends the full keys of the remaining windows, each key once, with
   the least place where the chunk has it and whether it has it twice: a hot window costs a row
   a chunk, not one an occurrence. Shards group these exactly and answer in two bits a
   key, in the order sent: repeated, and first of all. What a chunk must know again
   later (which windows it sent) it sends to itself, as one bit a window.

The sketch (5) has ``depth`` rows of cells keyed by whole windows. The radix sort (7) takes a window
for a suffix cut at ``width`` words and goes by digits of words, the most
significant first: words 1 to 10, then 11 to 25, then the rest (``digits``). A pass
over the cluster counts the groups of a digit (steps 2 and 3) and only suffixes in groups
still shared go on to the next; the last digit is sorted within the shards,
in passes of 16 bits over the groups still equal.

A digit's code is a 64-bit hash of its words: any order of words that is the same
everywhere gives the same groups. Equal windows are told by codes of 128 bits, for the sketch two
independent ones of the window, for the radix sort that of the digits before the last
and that of the last. Words themselves are not compared: over 2.5e13 windows (100 TB
or so) the chance of one false group is below 1e-11 for independent
windows, and 2.5e13 / 2**64 for each window that shares half its words with all others.

All of this is linear in the corpus. The number of shards follows from its number of words,
which one narrow aggregate finds. Every chunk writes to every shard, so beyond
``EVEN_WORDS`` words both chunks and shards grow with the square root of the
corpus, by ``most_growth`` at most, lest blobs become all header: at 2.5e13 words (100 TB or so) they are 64
times as large, a blob holds hundreds of cells, and a task needs some 8 GB.

Defined cases: null and blank texts, and texts of fewer than ``width`` words,
have no windows. Rows without a doc_id are left out. Words compare by bytes.
Rows that repeat a doc_id are occurrences at the same place, so the window
counts as repeated, and the first place is kept in each such row. Long texts are hashed in overlapping pieces.
Other columns aren't read, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.textarrays import U64, WINDOW_BASES, mix, pieces, window_hashes, window_starts, word_hashes, words

CHUNK_BYTES = 8 << 20
SHARD_CELLS = 4 << 20
EVEN_WORDS = 6_000_000_000
BLOB = "shard int, chunk int, cells binary"
FOUND = "shard int, chunk int, first binary, second binary, ids binary, owners binary, places binary, twice binary"
SPANS = "doc_id bigint, start_word int, end_word int, n_windows int, is_first boolean"


def encode(cells: np.ndarray) -> bytes:
    """Sorted cells as bytes: their low bits in planes, the steps of the rest in unary, which is within half a bit of the least."""
    if not len(cells):
        return b""
    cells = cells.astype(np.uint32)
    low = max(0, int(np.log2((int(cells[-1]) + 1) / len(cells))))
    high = (cells >> np.uint32(low)).astype(np.int64) + np.arange(len(cells))
    unary = np.zeros(int(high[-1]) + 1, np.uint8)
    unary[high] = 1
    planes = [(cells >> np.uint32(k)).astype(np.uint8).tobytes() for k in range(0, low - 7, 8)]
    planes += [np.packbits((cells >> np.uint32(k)).astype(np.uint8) & 1).tobytes() for k in range(low // 8 * 8, low)]
    return bytes([low]) + len(cells).to_bytes(4, "little") + b"".join(planes) + np.packbits(unary).tobytes()


def decode(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    low, n = blob[0], int.from_bytes(blob[1:5], "little")
    raw, at = np.frombuffer(blob, np.uint8, offset=5), 0
    rest = np.zeros(n, np.uint32)
    for k in range(0, low - 7, 8):
        rest |= raw[at : at + n].astype(np.uint32) << np.uint32(k)
        at += n
    for k in range(low // 8 * 8, low):
        rest |= np.unpackbits(raw[at : at + (n + 7) // 8], count=n).astype(np.uint32) << np.uint32(k)
        at += (n + 7) // 8
    high = np.flatnonzero(np.unpackbits(raw[at:])) - np.arange(n)
    return (high << low) + rest


def _at_most_two(cells: np.ndarray) -> np.ndarray:
    """Sorted cells without the third and later of equal ones."""
    keep = np.ones(len(cells), bool)
    keep[2:] = cells[2:] != cells[:-2]
    return cells[keep]


class Layout:
    """Sizes that follow from the number of windows; see the module."""

    def __init__(self, n_bytes: int, n_words: int, rows: int, load: int, chunk_bytes: int, shard_cells: int, most_growth: float):
        self.rows = rows
        growth = min(max(1.0, math.sqrt(n_words / EVEN_WORDS)), most_growth)
        self.chunk_bytes = int(chunk_bytes * growth)
        self.chunks = max(1, math.ceil(n_bytes / self.chunk_bytes))
        self.shards = max(1, math.ceil(n_words / (shard_cells * growth)))
        self.span = load * math.ceil(max(n_words, 1) / self.shards)

    def cells(self, key: np.ndarray, row: int) -> np.ndarray:
        """The cell of each key in a row of the sketch, in 0 .. shards * span - 1."""
        with np.errstate(over="ignore"):
            spread = mix(key + U64(0x632BE59BD9B4E019) * U64(row + 1))
        return ((spread >> U64(12)).astype(np.float64) * (self.shards * self.span / 2.0**52)).astype(np.int64)

    def shard_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The shard of the exact grouping, by all of a key: windows that share some words only are spread."""
        with np.errstate(over="ignore"):
            spread = mix(first * U64(0x9E3779B97F4A7C15) ^ second)
        return ((spread >> U64(32)) * U64(self.shards) >> U64(32)).astype(np.int64)


@dataclass(frozen=True)
class Digits:
    """Windows of ``width`` words, and where their digits end; without ``ends`` a window has one digit, its whole."""

    width: int
    ends: tuple[int, ...] = ()

    def codes(self, hashes: np.ndarray, begin: np.ndarray, upto: int) -> np.ndarray:
        """The code of the first ``upto`` digits of each window: a chain of the codes of their words."""
        code, at = None, 0
        for end in (self.ends or (self.width,))[:upto]:
            digit = window_hashes(hashes, end - at, WINDOW_BASES[0])[begin + at]
            with np.errstate(over="ignore"):
                code = digit if code is None else mix(code * U64(0x9E3779B97F4A7C15) + digit)
            at = end
        return code

    def key(self, hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two codes of each window: of the digits before the last and of the last, or two of the whole."""
        last = self.ends[-1] if self.ends else self.width
        if last < self.width:
            return self.codes(hashes, begin, len(self.ends)), window_hashes(hashes, self.width - last, WINDOW_BASES[0])[begin + last]
        return self.codes(hashes, begin, len(self.ends) or 1), window_hashes(hashes, self.width, WINDOW_BASES[1])[begin]

    @property
    def passes(self) -> int:
        return max(1, len(self.ends))


def _windows(batches: list[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """For pieces of the rows: word hashes, the word that each window begins with, its row, its first word's number."""
    at = 0
    for batch in batches:
        for data, off, row, base in pieces(batch, width - 1):
            starts, ends, word_off = words(data, off)
            begin, owner = window_starts(word_off, width)
            if len(begin):
                yield word_hashes(data, starts, ends), begin, owner + row + at, begin - word_off[owner] + base
        at += batch.num_rows


def _in_order(table: pa.Table) -> list[pa.RecordBatch]:
    """The rows of a chunk in an order that is the same in every pass."""
    return table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks().to_batches()


def _by_shard(cells: np.ndarray, row: int, layout: Layout) -> Iterator[tuple[int, bytes]]:
    cells = _at_most_two(np.sort(cells))
    edges = np.searchsorted(cells, np.arange(layout.shards + 1) * layout.span)
    for shard in np.flatnonzero(np.diff(edges)):
        yield int(row * layout.shards + shard), encode(cells[edges[shard] : edges[shard + 1]] - shard * layout.span)


def _first_cells(batches: list[pa.RecordBatch], digits: Digits, layout: Layout) -> Iterator[tuple[int, bytes]]:
    found = [digits.codes(hashes, begin, 1) for hashes, begin, *_ in _windows(batches, digits.width)]
    if found:
        code = np.concatenate(found)
        for row in range(layout.rows):
            yield from _by_shard(layout.cells(code, row), row, layout)


def _shard_counts(blobs: list[bytes], span: int) -> Iterator[bytes]:
    """For each blob, those of its cells that all blobs together count at least twice."""
    counts = np.zeros(span, np.uint8)
    for blob in blobs:
        cells = decode(blob)
        again = cells[1:][cells[1:] == cells[:-1]]
        counts[cells] = np.minimum(counts[cells], 1) + 1
        counts[again] = 2
    for blob in blobs:
        cells = decode(blob)
        hit = np.unique(cells[counts[cells] > 1])
        yield encode(hit) if len(hit) else b""


class Open:
    """The windows of a chunk that are still open: those of the mask (null: all) whose cells have all come back."""

    def __init__(self, back: list[tuple[int, bytes]], layout: Layout):
        self.layout = layout
        self.mask: np.ndarray | None = None
        parts: list[list[np.ndarray]] = [[] for _ in range(layout.rows)]
        for shard, blob in back:
            if shard < 0:
                self.mask = np.unpackbits(np.frombuffer(blob, np.uint8)).astype(bool)
            else:
                parts[shard // layout.shards].append(decode(blob) + (shard % layout.shards) * layout.span)
        self.cells = [np.unique(np.concatenate(p)) if p else np.zeros(0, np.int64) for p in parts]

    def hits(self, code: np.ndarray, at: int) -> np.ndarray:
        """Flags of the windows with these codes, the first of which has number ``at`` in the chunk."""
        hit = np.ones(len(code), bool) if self.mask is None else self.mask[at : at + len(code)].copy()
        for row, known in enumerate(self.cells):
            if not len(known):
                return np.zeros(len(code), bool)
            cells = self.layout.cells(code[hit], row)
            hit[hit] = known[np.minimum(np.searchsorted(known, cells), len(known) - 1)] == cells
        return hit


def _next_cells(batches: list[pa.RecordBatch], back: list[tuple[int, bytes]], digits: Digits, upto: int, layout: Layout) -> Iterator[tuple[int, bytes | None]]:
    """The cells of one digit more, of windows still open after ``upto`` digits; with shard -1 which these are."""
    known, at, flags, found = Open(back, layout), 0, [], []
    for hashes, begin, *_ in _windows(batches, digits.width):
        hit = known.hits(digits.codes(hashes, begin, upto), at)
        at += len(hit)
        flags.append(hit)
        found.append(digits.codes(hashes, begin[hit], upto + 1))
    if found and any(map(len, found)):
        yield -1, np.packbits(np.concatenate(flags)).tobytes()
        yield from _by_shard(layout.cells(np.concatenate(found), 0), 0, layout)


def _keys(batches: list[pa.RecordBatch], pick, digits: Digits) -> tuple[np.ndarray, ...] | None:
    """First and second code, document and place of the windows that ``pick`` takes (hashes, begin, number of the first)."""
    at, kept = 0, []
    ids = np.concatenate([b.column("doc_id").to_numpy() for b in batches] or [np.zeros(0, np.int64)])
    for hashes, begin, row, place in _windows(batches, digits.width):
        hit = pick(hashes, begin, at)
        at += len(hit)
        if hit.any():
            kept.append((*digits.key(hashes, begin[hit]), ids[row[hit]], place[hit].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*kept)) if kept else None


def _sorted_keys(first: np.ndarray, second: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by shard and key, a flag at the first of equal keys, and the shards in this order; of equal keys the order is kept."""
    order = np.lexsort((second, first))
    shard = layout.shard_of(first[order], second[order])
    by_shard = np.argsort(shard, kind="stable")
    order, shard = order[by_shard], shard[by_shard]
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    return order, new, shard


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by their bytes, the highest together, so that they compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _chunk_found(batches: list[pa.RecordBatch], back: list[tuple[int, bytes]], digits: Digits, layout: Layout) -> Iterator[tuple]:
    """The distinct keys of the open windows, for each shard; with shard -1 which windows these are."""
    known, flags = Open(back, layout), []

    def pick(hashes: np.ndarray, begin: np.ndarray, at: int) -> np.ndarray:
        flags.append(known.hits(digits.codes(hashes, begin, digits.passes), at))
        return flags[-1]

    got = _keys(batches, pick, digits)
    if got is None:
        return
    yield -1, np.packbits(np.concatenate(flags)).tobytes(), None, None, None, None, None
    first, second, ids, place = got
    order, new, shard = _sorted_keys(first, second, layout)
    begin = np.flatnonzero(new)
    least = order[begin]  # windows come in order of document and place
    twice = np.diff(np.append(begin, len(order))) > 1
    edges = np.searchsorted(shard[begin], np.arange(layout.shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        mine = least[edges[s] : edges[s + 1]]
        docs, owner = np.unique(ids[mine], return_inverse=True)
        yield int(s), first[mine].tobytes(), second[mine].tobytes(), docs.tobytes(), planes(owner), planes(place[mine]), np.packbits(twice[edges[s] : edges[s + 1]]).tobytes()


def _radix(*columns: np.ndarray) -> np.ndarray:
    """Order of keys of 64-bit columns by most-significant-digit passes; groups of one are final after any pass.

    A pass sorts by the next 16 bits within the groups that the passes before
    it left equal; numpy sorts 16-bit digits by counting.
    """
    n = len(columns[0])
    order, group, todo = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for keys, shift in ((c, s) for c in columns for s in (48, 32, 16, 0)):
        if not len(todo):
            break
        index = order[todo]
        digit = ((keys[index] >> U64(shift)) & U64(0xFFFF)).astype(np.uint16)
        by_digit = np.argsort(digit, kind="stable")
        # groups are runs of positions, so a stable sort by group restores them
        by_group = np.argsort(group[todo][by_digit], kind="stable")
        step = by_digit[by_group]
        order[todo] = index[step]
        digit, owner = digit[step], group[todo]
        new = np.ones(len(todo), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(todo)))
        group[todo] = np.repeat(todo[first], size)
        todo = todo[np.repeat(size > 1, size)]
    return order


def _exact(table: pa.Table, radix: bool) -> Iterator[tuple[bytes, bytes]]:
    """For each chunk's keys in a shard, two bits each: whether the window occurs twice or more, and whether the chunk has its first."""
    columns = {k: table.column(k).to_pylist() for k in ("first", "second", "ids", "owners", "places", "twice")}
    sizes = [len(x) // 8 for x in columns["first"]]
    first, second = (np.concatenate([np.frombuffer(x, U64) for x in columns[k]]) for k in ("first", "second"))
    ids = np.concatenate([np.frombuffer(i, np.int64)[unplaned(o)] for i, o in zip(columns["ids"], columns["owners"])])
    places = np.concatenate([unplaned(x) for x in columns["places"]])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(columns["twice"], sizes)]).astype(bool)
    order = _radix(first, second) if radix else np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    ids, places = ids[order], places[order]
    again = (size > 1) | np.logical_or.reduceat(twice[order], begin)
    low_id = np.repeat(np.minimum.reduceat(ids, begin), size)
    low = np.where(ids == low_id, places, np.iinfo(np.int64).max)
    leads = (ids == low_id) & (places == np.repeat(np.minimum.reduceat(low, begin), size))
    out = np.zeros((2, len(order)), bool)
    out[0, order], out[1, order] = np.repeat(again, size), leads
    for a, b in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes)):
        yield np.packbits(out[0, a:b]).tobytes(), np.packbits(out[1, a:b]).tobytes()


def _chunk_spans(batches: list[pa.RecordBatch], said: list[tuple], digits: Digits, layout: Layout) -> pa.Table:
    """The spans of a chunk's repeated windows, from what the shards said of the keys that it sent."""
    mask = np.unpackbits(np.frombuffer(next(a for s, a, _ in said if s < 0), np.uint8)).astype(bool)
    got = _keys(batches, lambda hashes, begin, at: mask[at : at + len(begin)], digits)
    first, second, ids, place = got
    order, new, shard = _sorted_keys(first, second, layout)
    begin = np.flatnonzero(new)
    counts = np.bincount(shard[begin], minlength=layout.shards)
    flags = np.zeros((2, len(begin)), bool)
    for s, *bits in said:
        if s >= 0:
            a = int(counts[:s].sum())
            for k in (0, 1):
                flags[k, a : a + counts[s]] = np.unpackbits(np.frombuffer(bits[k], np.uint8))[: counts[s]]
    size = np.diff(np.append(begin, len(order)))
    again, leads = (np.repeat(f, size) for f in flags)
    least = np.repeat(order[begin], size)
    leads = leads & (ids[order] == ids[least]) & (place[order] == place[least])
    keep = order[again]
    return _runs(ids[keep], place[keep], leads[again], digits.width)


def _runs(ids: np.ndarray, places: np.ndarray, first: np.ndarray, width: int) -> pa.Table:
    order = np.lexsort((places, ids, first))
    ids, places, first = ids[order], places[order], first[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (first[1:] != first[:-1]) | (places[1:] > places[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(ids)).astype(np.int64)[: len(begin)] - 1
    return pa.table({"doc_id": ids[begin], "start_word": places[begin].astype(np.int32), "end_word": (places[last] + width).astype(np.int32), "n_windows": (places[last] - places[begin] + 1).astype(np.int32), "is_first": first[begin].astype(bool)})


def _table(chunk: int, rows: list[tuple], names: list[str]) -> pa.Table:
    """Rows of (shard, binaries); what a chunk sends to itself goes by its number below zero, so that such rows are spread."""
    columns = {"shard": pa.array([-1 - chunk if r[0] < 0 else r[0] for r in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32())}
    return pa.table(columns | {n: pa.array([r[k + 1] for r in rows], pa.binary()) for k, n in enumerate(names)})


def repeated_spans(docs: DataFrame, *, width: int = 50, method: str = "sketch", digits: tuple[int, ...] = (10, 15), depth: int = 2, load: int = 4, chunk_bytes: int = CHUNK_BYTES, shard_cells: int = SHARD_CELLS, most_growth: float = 64) -> DataFrame:
    """(doc_id, start_word, end_word, n_windows, is_first): maximal runs of repeated windows.

    Words are numbered from 0 and end_word is exclusive. ``is_first`` tells the
    runs of windows that are the first of their group, by doc_id and place,
    from the runs of later ones.

    method "sketch": ``depth`` rows of a count-min sketch with ``load`` cells
    for each window, keyed by whole windows. method "radix": a pass for each digit of
    ``digits`` words, most significant first, then passes over the rest of the words up to ``width``.
    """
    if method not in ("sketch", "radix"):
        raise ValueError(f"unknown method {method!r}")
    radix = method == "radix"
    made = Digits(width, tuple(sorted({min(width, sum(digits[: k + 1])) for k in range(len(digits))}))) if radix else Digits(width)
    mine = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    size = F.octet_length("text").cast("bigint")
    n_bytes, n_words = mine.agg(F.sum(size), F.sum(size - F.octet_length(F.translate("text", " \n\t\r", "")) + 1)).first()
    layout = Layout(n_bytes or 0, n_words or 0, 1 if radix else depth, load * (2 if radix else 1), chunk_bytes, shard_cells, most_growth)
    limit = max(layout.chunk_bytes, CHUNK_BYTES)
    base = mine.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(layout.chunks)).cast("int")).repartition(layout.chunks, "chunk")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        held: dict[int, int] = {}

        def out(chunk: int) -> Iterator[pa.RecordBatch]:
            for shard, blob in _first_cells(waiting.pop(chunk), made, layout):
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([chunk], pa.int32()), pa.array([blob], pa.binary())], ["shard", "chunk", "cells"])
            held.pop(chunk)

        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            for chunk in np.unique(chunks):
                part = batch if (chunks == chunk).all() else batch.filter(pa.array(chunks == chunk))
                waiting.setdefault(int(chunk), []).append(part)
                held[int(chunk)] = held.get(int(chunk), 0) + part.nbytes
                if held[int(chunk)] > 4 * limit or sum(held.values()) > 8 * limit:
                    yield from out(int(chunk))
        for chunk in list(waiting):
            yield from out(chunk)

    def add(table: pa.Table) -> pa.Table:
        if not table.num_rows or table.column("shard")[0].as_py() < 0:
            return table
        hits = list(_shard_counts(table.column("cells").to_pylist(), layout.span))
        out = pa.table({"shard": table.column("shard"), "chunk": table.column("chunk"), "cells": pa.array(hits, pa.binary())})
        return out.filter(pa.array([bool(x) for x in hits], pa.bool_()))

    def meet(left: pa.Table, right: pa.Table, names: list[str], f) -> pa.Table:
        # a chunk that nothing came back to has nothing to say
        if not left.num_rows or not right.num_rows:
            return _table(0, [], names)
        back = list(zip(right.column("shard").to_pylist(), right.column("cells").to_pylist()))
        return _table(left.column("chunk")[0].as_py(), list(f(_in_order(left), back)), names)

    found_names = [x.split()[0] for x in FOUND.split(", ")[2:]]

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        return meet(left, right, found_names, lambda batches, back: _chunk_found(batches, back, made, layout))

    def group(table: pa.Table) -> pa.Table:
        both = [(x, None) for x in table.column("first").to_pylist()] if table.column("shard")[0].as_py() < 0 else list(_exact(table, radix))
        return pa.table({"shard": table.column("shard"), "chunk": table.column("chunk"), "again": pa.array([x[0] for x in both], pa.binary()), "leads": pa.array([x[1] for x in both], pa.binary())})

    def spans(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), width)
        said = list(zip(*(right.column(k).to_pylist() for k in ("shard", "again", "leads"))))
        return _chunk_spans(_in_order(left), said, made, layout)

    texts = base.groupBy("chunk")
    back = base.mapInArrow(send, BLOB).groupBy("shard").applyInArrow(add, BLOB)
    def after(upto: int):
        def go_on(left: pa.Table, right: pa.Table) -> pa.Table:
            return meet(left, right, ["cells"], lambda batches, back: _next_cells(batches, back, made, upto, layout))

        return go_on

    for upto in range(1, made.passes):
        back = texts.cogroup(back.groupBy("chunk")).applyInArrow(after(upto), BLOB).groupBy("shard").applyInArrow(add, BLOB)
    found = texts.cogroup(back.groupBy("chunk")).applyInArrow(pick, FOUND)
    grouped = found.groupBy("shard").applyInArrow(group, "shard int, chunk int, again binary, leads binary")
    return texts.cogroup(grouped.groupBy("chunk")).applyInArrow(spans, SPANS)


def cut_repeats(docs: DataFrame, spans: DataFrame, *, keep_words: int = 1) -> DataFrame:
    """``docs`` without the words of later occurrences; a first occurrence stays whole.

    Words of a run that is not first go, unless a first run of the same
    document covers them. The text between the remaining words stays as it is,
    n_chars follows, and a document left with fewer than ``keep_words`` words
    goes. Documents without a later run stay untouched, those without a doc_id
    too.
    """
    names = docs.columns
    cut = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word", "is_first"))).alias("cut_spans"), F.bool_or(~F.col("is_first")).alias("later")).where("later").drop("later").withColumnRenamed("doc_id", "cut_doc_id")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("bigint").alias("cut_key"))
    unlike = "x" * (1 + max(map(len, names)))  # longer than any name, so that none clashes
    parts = [F.expr(f"transform(cut_spans, s -> s.{k})").alias(f"{k}_{unlike}") for k in ("start_word", "end_word", "is_first")]
    joined = held.join(cut.hint("shuffle_hash"), F.col("cut_key") == F.col("cut_doc_id"), "left").select("row.*", *parts)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("text", "n_chars")}
            begin, end, first = batch.columns[len(names) :]
            rows = np.flatnonzero(begin.is_valid().to_numpy(zero_copy_only=False))
            columns = list(batch.columns[: len(names)])
            if len(rows):
                texts = columns[at["text"]].to_pylist()
                chars = columns[at["n_chars"]].to_pylist() if at["n_chars"] >= 0 else None
                alive = np.ones(batch.num_rows, bool)
                for r in rows:
                    text, alive[r] = _without(texts[r] or "", begin[int(r)].as_py(), end[int(r)].as_py(), first[int(r)].as_py(), keep_words)
                    texts[r] = text
                    if chars is not None:
                        chars[r] = len(text)
                columns[at["text"]] = pa.array(texts, columns[at["text"]].type)
                if chars is not None:
                    columns[at["n_chars"]] = pa.array(chars, columns[at["n_chars"]].type)
                out = pa.RecordBatch.from_arrays(columns, names)
                yield out.filter(pa.array(alive))
            else:
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(shorten, docs.schema)


def _without(text: str, begin: list[int], end: list[int], first: list[bool], keep_words: int) -> tuple[str, bool]:
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    gone = np.zeros(len(starts) + 1, bool)
    for flag in (False, True):
        for b, e, f in zip(begin, end, first):
            if f == flag:
                gone[b:e] = not flag
    gone = gone[: len(starts)]
    if not gone.any():
        return text, True
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    pieces, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        pieces.append(raw[at : starts[a]])
        at = starts[b] if b < len(starts) else len(raw)
    pieces.append(raw[at:])
    return b"".join(pieces).decode(), bool((~gone).sum() >= keep_words)
