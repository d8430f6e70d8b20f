"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are compared by bytes, ASCII letters in lower case and ASCII
white space as a blank. A segment begins at every byte of a longer item, so that
any copied part of a segment's length or more is found too; items of up to one and
a half segments are looked up as a whole besides, with the edits of their length. A
segment of m bytes that lies in a text with k edits or fewer shares at least
m + 1 - q * (k + 1) of its q-grams with it, on diagonals that differ by k at
most. So each worker

1. hashes the q-grams of its texts and looks them up in a table of those of the
   items,
2. gathers the hits by text, item and diagonal band; bands are 2(k + 1) wide
   and overlap by half, so that any k + 1 neighbouring diagonals share one,
3. keeps the segments whose own q-grams reach the bound in a band, and
4. verifies these by alignment within the band, for all at once.

A kept segment is the only way to k edits or fewer, so nothing is lost. An item shorter than q bytes is found
where it lies as it is, and no letter, digit or byte beyond ASCII is beside it. One narrow
pass over the documents.

The index of q-grams travels with the tasks in parts. A part has ``part_bytes`` at most, by the size
of what is sent, not of the items; a worker holds one part at a time, whatever the number of
parts, and goes through them for every ``HELD_BYTES`` of text. A benchmark of more than ``PASS_PARTS``
parts takes a pass over the documents for each so many, whose outcome is written to the shared folder.

Defined cases: null and blank texts and items have no segments and no hits; an
item too short for the bound to be 1 at least is looked up with the most edits
for which it is. Rows are searched one
by one, so repeated rows repeat their result; several rows of one item_id count
as parts of one item. An item of more than ``STRETCH`` bytes, or of more than a part of the index holds, is looked up as several and
may have a row for each. Long texts are searched in overlapping pieces. Items and documents without an id are left out of the
result, though such documents are kept by ``drop_leaks``. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import islice
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.shared import cut
from batchloom.llm.textarrays import SLICE_BYTES, U64, flat, mix, sliced

#: Bytes of a part of the index as it is sent, parts of a pass, bytes of text for which the parts are gone through, and bytes of an item that are one stretch.
PART_BYTES, PASS_PARTS, HELD_BYTES, STRETCH = 128 << 20, 64, 64 << 20, 1 << 20
#: Bytes of a q-gram and of a segment (13 words or so), and the edit budget as a share of a segment's bytes.
Q, SEGMENT, RATE = 9, 80, 0.08
LEAKS = "doc_id bigint, item_id bigint, n_segments int, start_byte bigint, end_byte bigint, edits int"


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII letters in lower case and white space as a blank."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9:14] = 32
    return table[data]


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes (8 to 16) from each place."""
    if len(data) < q:
        return np.zeros(0, U64)
    eights = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    n = len(data) - q + 1
    with np.errstate(over="ignore"):
        return (eights[:n] * U64(0x9E3779B97F4A7C15) ^ eights[q - 8 : q - 8 + n]) * U64(0xD6E8FEB86659FD93)


@dataclass
class Segments:
    """Stretches, of which every run of ``length`` bytes is a segment, and the index of their q-grams."""

    q: int
    data: np.ndarray  # the bytes of all stretches
    off: np.ndarray
    ids: np.ndarray  # the item of each stretch
    length: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    nth: np.ndarray  # number of each stretch's first segment
    bits: int
    table: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray

    def stretch(self, seg: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.nth, seg, "right") - 1

    def rows(self, seg: np.ndarray, width: int) -> np.ndarray:
        """One row of ``width`` bytes for each segment, padded with 0."""
        own = self.stretch(seg)
        at = (self.off[own] + seg - self.nth[own])[:, None] + np.arange(width)
        return np.where(np.arange(width) < self.length[own][:, None], self.data[np.minimum(at, len(self.data) - 1)], 0)

    @cached_property
    def item(self) -> np.ndarray:
        return np.repeat(self.ids, np.diff(self.nth))

    @cached_property
    def size(self) -> np.ndarray:
        return np.repeat(self.length, np.diff(self.nth))

    @cached_property
    def edits(self) -> np.ndarray:
        return np.repeat(self.budget, np.diff(self.nth))

    @cached_property
    def text(self) -> np.ndarray:
        return self.rows(np.arange(self.nth[-1]), int(self.length.max(initial=1)))


def segments(items: list[tuple[int, str | bytes]], *, q: int, segment: int, rate: float) -> Segments:
    """The index of (item_id, text)."""
    found: set[tuple[int, bytes, int]] = set()
    for item, text in items:
        data = text if isinstance(text, bytes) else (text or "").encode()
        raw = fold(np.frombuffer(data, np.uint8)).tobytes().strip()
        if item is None or not raw:
            continue
        found.add((item, raw, min(len(raw), segment)))
        if segment < len(raw) and len(raw) * 2 <= segment * 3:
            found.add((item, raw, len(raw)))
    parts = sorted(found)
    length = np.array([n for _, _, n in parts], np.int64)
    off = np.cumsum([0, *(len(x) for _, x, _ in parts)])
    data = np.frombuffer(b"".join(x for _, x, _ in parts), np.uint8)
    nth = np.append(0, np.cumsum(np.diff(off) - length + 1))
    budget = np.maximum(np.minimum((length * rate).astype(np.int64), length // q - 1), 0)
    bound = length + 1 - q * (budget + 1)
    hashes = [gram_hashes(data[x:y], q) for x, y in zip(off[:-1], off[1:], strict=True)]
    owner = np.repeat(np.arange(len(parts)), np.array([len(h) for h in hashes], np.int64))
    place = np.concatenate([np.arange(len(h)) for h in hashes] or [np.zeros(0, np.int64)])
    every = np.concatenate([*hashes, np.zeros(0, U64)])
    order = np.argsort(every, kind="stable")
    every, owner, place = every[order], owner[order].astype(np.int32), place[order].astype(np.int32)
    grams, first = np.unique(every, return_index=True)
    bits = max(12, ceil(np.log2(max(len(grams), 1) * 32)))
    flags = np.zeros(1 << bits, bool)
    flags[(grams >> U64(64 - bits)).astype(np.int64)] = True
    ids = np.array([i for i, _, _ in parts], np.int64)
    return Segments(q, data, off, ids, length, budget, bound, nth, bits, np.packbits(flags, bitorder="little"), grams, np.append(first, len(every)).astype(np.int32), owner, place)


def index_bytes(n: int, segment: int) -> int:
    """What an item of ``n`` bytes adds to the index at most: a q-gram takes 20 bytes and up to 8 of the table."""
    return (60 if segment < n <= segment * 3 // 2 else 30) * n + 256


def align(pattern: np.ndarray, size: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edits of each pattern (a row, of ``size`` bytes) within its region (a row), inside the band.

    Column c of step j stands for a region that ends before byte j + c; start
    and end in the region are free. Each text row has 2w - 1 bytes more than its
    pattern, w diagonals being allowed.
    """
    width = text.shape[1] - pattern.shape[1] + 1
    across = np.arange(width)
    row = np.zeros((len(pattern), width), np.int32)
    best = np.full(len(pattern), np.iinfo(np.int32).max, np.int32)
    for j in range(1, pattern.shape[1] + 1):
        new = row + (text[:, j - 1 : j - 1 + width] != pattern[:, j - 1 : j])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - across, axis=1).astype(np.int32) + across.astype(np.int32)
        done = size == j
        if done.any():
            best[done] = row[done].min(axis=1)
    return best


def search(part: pa.RecordBatch, known: Segments, most: int = SLICE_BYTES) -> tuple[np.ndarray, ...]:
    """(row, segment, start, end, edits) of every segment found in a row, best region first come; a long row's may repeat."""
    data, off = flat(part.column("text"))
    found = []
    reach = int((known.length + known.budget).max(initial=0)) + known.q
    for low, high, a, b in _stretches(off, most, reach):
        row, seg, start, end, edits = (np.concatenate(x) for x in zip(_short(data[a:b], np.minimum(np.maximum(off[low : high + 1], a), b) - a, known, a > off[low], b < off[high]), _search(data[a:b], np.minimum(np.maximum(off[low : high + 1], a), b) - a, known)))
        shift = a - off[low]
        found.append((row + low, seg, start + shift, end + shift, edits))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(5))


def _stretches(off: np.ndarray, most: int, reach: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of rows and their bytes; a long row in pieces that overlap by ``reach``."""
    at, n = 0, len(off) - 1
    while at < n:
        if off[at + 1] - off[at] > 2 * most:
            for a in range(int(off[at]), int(off[at + 1]), most):
                yield at, at + 1, a, min(a + most + reach, int(off[at + 1]))
            at += 1
            continue
        end = at + 1
        while end < n and off[end + 1] - off[at] <= 2 * most:
            end += 1
        yield at, end, int(off[at]), int(off[end])
        at = end


def _short(data: np.ndarray, off: np.ndarray, known: Segments, more_before: bool, more_after: bool) -> tuple[np.ndarray, ...]:
    """As ``search``, for items shorter than a q-gram: their bytes as they are, between boundaries."""
    found = [tuple(np.zeros(0, np.int64) for _ in range(5))]
    short = np.flatnonzero(known.length < known.q)
    if len(short) and len(data):
        low = fold(data)
        solid = (low >= 97) & (low <= 122) | (low >= 48) & (low <= 57) | (low >= 128)
        padded = np.concatenate([low, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(low),), "<u8", padded, strides=(1,))
        for n in np.unique(known.length[short]).tolist():
            mine = short[known.length[short] == n]
            mask = U64((1 << 8 * n) - 1)
            codes = np.array([int.from_bytes(known.data[known.off[k] : known.off[k + 1]].tobytes(), "little") for k in mine], U64)
            at = np.flatnonzero(np.isin(eights & mask, codes))
            row = np.searchsorted(off, at, "right") - 1
            left, right = off[row], off[row + 1]
            before = np.where(at > left, solid[np.maximum(at - 1, 0)], more_before)
            after = np.where(at + n < right, solid[np.minimum(at + n, len(low) - 1)], more_after)
            good = (at + n <= right) & ~before & ~after
            at, row = at[good], row[good]
            for k, code in zip(mine.tolist(), codes):
                hit = (eights[at] & mask) == code
                found.append((row[hit], np.full(int(hit.sum()), known.nth[k]), at[hit] - off[row[hit]], at[hit] + n - off[row[hit]], np.zeros(int(hit.sum()), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _search(data: np.ndarray, off: np.ndarray, known: Segments) -> tuple[np.ndarray, ...]:
    """As ``search``, for rows of moderate size and items of a q-gram at least."""
    low = fold(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = gram_hashes(low, known.q)
    if not len(hashes) or not len(known.grams):
        return none
    cell = (hashes >> U64(64 - known.bits)).astype(np.int64)
    at = np.flatnonzero(known.table[cell >> 3] >> (cell & 7).astype(np.uint8) & 1)
    slot = np.minimum(np.searchsorted(known.grams, hashes[at]), len(known.grams) - 1)
    same = known.grams[slot] == hashes[at]
    at, slot = at[same], slot[same]
    row = np.searchsorted(off, at, "right") - 1
    whole = at + known.q <= off[row + 1]
    at, slot, row = at[whole], slot[whole], row[whole]
    many = (known.first[slot + 1] - known.first[slot]).astype(np.int64)
    index = np.repeat(known.first[slot].astype(np.int64), many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    place, row, owner, own_place = np.repeat(at, many), np.repeat(row, many), known.owner[index].astype(np.int64), known.place[index].astype(np.int64)
    if not len(owner):
        return none
    half = known.budget[owner] + 1
    shift = int(np.diff(known.off).max()) + int(known.budget.max()) + 1  # no band is negative
    band = (place - own_place + shift) // half
    spread = len(data) + 2 * shift + 2
    keys = np.concatenate([owner * spread + band, owner * spread + band - 1])
    order = np.lexsort((np.tile(place, 2), keys))  # places part the rows that a band spans
    keys, rows = keys[order], np.tile(row, 2)[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(keys)))
    owner = keys[begin] // spread
    enough = count >= known.bound[owner]
    begin, count, owner = begin[enough], count[enough], owner[enough]
    band, row = keys[begin] % spread, rows[begin]
    # the hits of these bands, by their places in the item
    group = np.repeat(np.arange(len(begin)), count)
    hit = order[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(len(group))] % len(place)
    by_place = np.lexsort((own_place[hit], group))
    hit = hit[by_place]
    own_place, place = own_place[hit], place[hit]
    seg, of = _reached(known, owner, group, own_place)
    if not len(seg):
        return none
    owner, band, row = owner[of], band[of], row[of]
    within = seg - known.nth[owner]
    low_key, wide = of * shift + within, known.length[owner] - known.q
    ends = np.stack([np.searchsorted(group * shift + own_place, low_key), np.searchsorted(group * shift + own_place, low_key + wide, "right")], axis=1).ravel()
    start = np.minimum.reduceat(np.append(place, len(data)), ends)[::2]
    end = np.maximum.reduceat(np.append(place, 0), ends)[::2] + known.q
    out = np.zeros(len(seg), np.int64)
    for k in np.unique(known.budget[owner]):
        those = np.flatnonzero(known.budget[owner] == k)
        for a in range(0, len(those), 2048):
            pick = those[a : a + 2048]
            o, m = owner[pick], int(known.length[owner[pick]].max())
            # the band's 2(k + 1) diagonals and k on either side for the free ends
            left = band[pick] * (k + 1) - shift - k + within[pick]
            index = left[:, None] + np.arange(m + 4 * k + 1)
            inside = (index >= off[row[pick]][:, None]) & (index < off[row[pick] + 1][:, None])
            region = np.where(inside, low[np.clip(index, 0, len(low) - 1)], 255)
            out[pick] = align(known.rows(seg[pick], m), known.length[o], region)
    good = out <= known.budget[owner]
    return row[good], seg[good], start[good] - off[row[good]], end[good] - off[row[good]], out[good]


def _reached(known: Segments, owner: np.ndarray, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments with as many hits as their bound, and the group of each. Hits are in order of group and place."""
    own = owner[group]
    last = np.arange(len(group)) + known.bound[own] - 1
    at = np.flatnonzero(last < len(group))
    at = at[group[last[at]] == group[at]]
    wide = known.length[own[at]] - known.q
    near = place[last[at]] - place[at] <= wide
    at, wide = at[near], wide[near]
    group, own = group[at], own[at]
    size = known.off[own + 1] - known.off[own]
    low = np.maximum(place[last[at]] - wide, 0)
    high = np.minimum(place[at], size - known.length[own])
    # neither ever falls within a group, so each run goes on after the one before
    same = group[1:] == group[:-1]
    low[1:] = np.where(same, np.maximum(low[1:], high[:-1] + 1), low[1:])
    many = np.maximum(high - low + 1, 0)
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(known.nth[own] + low, many) + within, np.repeat(group, many)


def parts_of(items: Iterator[tuple[int, bytes]], *, segment: int, part_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items, in order of their ids, in lists whose index is within ``part_bytes``; one of them may hold a single stretch that isn't."""
    part: list[tuple[int, bytes]] = []
    held = start = since = 0  # bytes of the index, the place in the part of the item's first stretch, and the bytes before that
    for item, text in items:
        for at in range(0, max(len(text), 1), STRETCH):
            stretch = text[at : at + STRETCH + segment - 1]
            size = index_bytes(len(stretch), segment)
            if part and part[-1][0] != item:
                start, since = len(part), held
            if part and held + size > part_bytes:
                # an item's rows stay together where they fit into a part
                rest = part[start:] if part[-1][0] == item and 0 < start and held - since + size <= part_bytes else []
                yield part[: len(part) - len(rest)]
                part, held, start, since = rest, (held - since if rest else 0), 0, 0
            part.append((item, stretch))
            held += size
    if part:
        yield part


def _shared(benchmark: DataFrame, q: int, segment: int, rate: float, part_bytes: int) -> Iterator:
    """The parts of the index, each as a broadcast; the driver holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).orderBy("item_id", "text")
    items = ((r.item_id, r.text.encode()) for r in rows.toLocalIterator())
    for part in parts_of(items, segment=segment, part_bytes=part_bytes):
        yield benchmark.sparkSession.sparkContext.broadcast(segments(part, q=q, segment=segment, rate=rate))


def _in_turn(batches: Iterator[pa.RecordBatch], shared: list) -> Iterator[tuple[list[pa.RecordBatch], Segments]]:
    """Some batches with each part of the index; a worker holds one part, and reads it again where there are several."""
    if len(shared) == 1:
        for batch in batches:
            yield [batch], shared[0].value
        return
    held: list[pa.RecordBatch] = []
    while True:
        held = list(islice(batches, 1))
        while held and sum(b.nbytes for b in held) < HELD_BYTES and (more := next(batches, None)) is not None:
            held.append(more)
        if not held:
            return
        for one in shared:
            yield held, one.load_from_path(one._path)


def _passes(benchmark: DataFrame, out: DataFrame | None, run, *args) -> list[DataFrame]:
    """``run`` with the parts of each pass; all but the last outcome are written, and their parts let go."""
    parts, done = _shared(benchmark, *args), []
    now = list(islice(parts, PASS_PARTS))
    while now:
        then = list(islice(parts, PASS_PARTS))
        found = run(out, now)
        if then:
            found = cut(found)
            for one in now:
                one.destroy()
        done.append(found)
        out, now = found, then
    return done


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, segment: int = SEGMENT, rate: float = RATE, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, n_segments, start_byte, end_byte, edits): items of which a segment lies in a document.

    ``edits`` is the least among the segments found, start and end span their
    shared q-grams. ``rate`` is the edit budget, a share of a segment's bytes.
    """
    mine = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    def run(_, shared: list) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held, known in _in_turn(batches, shared):
                for batch in held:
                    for part in sliced(batch):
                        row, seg, start, end, edits = search(part, known)
                        if len(row):
                            yield _by_item(part, known, row, seg, start, end, edits)

        return mine.mapInArrow(find, LEAKS)

    found = _passes(benchmark, None, run, q, segment, rate, part_bytes)
    return reduce(DataFrame.unionAll, found) if found else docs.sparkSession.createDataFrame([], LEAKS)


def _by_item(part: pa.RecordBatch, known: Segments, row: np.ndarray, seg: np.ndarray, start: np.ndarray, end: np.ndarray, edits: np.ndarray) -> pa.RecordBatch:
    item = known.ids[known.stretch(seg)]
    order = np.lexsort((seg, item, row))
    row, seg, item, start, end, edits = (x[order] for x in (row, seg, item, start, end, edits))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    begin = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= seg[1:] != seg[:-1]
    columns = [
        part.column("doc_id").take(pa.array(row[begin])),
        pa.array(item[begin]),
        pa.array(np.add.reduceat(other.astype(np.int32), begin), pa.int32()),
        pa.array(np.minimum.reduceat(start, begin)),
        pa.array(np.maximum.reduceat(end, begin)),
        pa.array(np.minimum.reduceat(edits, begin), pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_segments", "start_byte", "end_byte", "edits"])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, segment: int = SEGMENT, rate: float = RATE, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text holds no segment of an item, all columns as they are.

    Rows are judged by their own text, in the pass that searches them: no join.
    """

    def run(out: DataFrame, shared: list) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            clean: list[np.ndarray] = []
            before = None
            for held, known in _in_turn(batches, shared):
                if held is not before:
                    yield from _rows(before, clean)
                    before, clean = held, [np.ones(b.num_rows, bool) for b in held]
                for batch, good in zip(held, clean, strict=True):
                    at = 0
                    for piece in sliced(batch.select(["text"])):
                        good[at + search(piece, known)[0]] = False
                        at += piece.num_rows
            yield from _rows(before, clean)

        return out.mapInArrow(keep, docs.schema)

    out = (_passes(benchmark, docs, run, q, segment, rate, part_bytes) or [docs])[-1]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _rows(batches: list[pa.RecordBatch] | None, good: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch, flags in zip(batches or [], good, strict=True):
        yield batch.filter(pa.array(flags))
