"""Near-duplicates by BagMinHash signatures of word-pair multisets.

A document is the multiset of its pairs of neighbouring words, counts being the
weights. Each weight is cut into levels [0, 1), [1, 2), [2, 4), [4, 8) ..., and
every (pair, level range) owns a Poisson process of points in time, at
``slots`` points a time unit for each unit of its width. A point carries a slot and a
height; it counts for a document if its height is below the document's
weight, so documents share the points below their lesser weight. The signature
holds, per slot, the first point that counts. Two signatures agree in a slot
with a probability of exactly the weighted Jaccard index of the multisets.

It is quick because points come in order of time: a document stops when all its
slots are filled, after slots * ln(slots) points or so whatever its length, and
most processes end at their first point.

Groups are found in this order:

1. Signatures, in one narrow pass, become ``bands`` keys of ``rows_per_band``
   slots a document, written once beside a 128-bit hash of the multiset. Texts aren't moved.
2. Documents of equal multisets are a class, told by that hash; its least doc_id stands for it from here
   on, so a thousand copies have the keys of one. Classes come from an aggregate that combines before its shuffle.
3. Classes with equal keys are candidates. A first round verifies one edge a
   class, to the least among those that share most keys with it; a
   second the edges to the least of each key; a third all that remain with an equal key: of keys
   with few classes as pairs, of others in blocks of ``BLOCK`` against each other, each block
   pair a group of its own, of which only what is verified comes out.
   Every round skips pairs that earlier ones have joined, so the groups are the
   connected components of all verified candidate pairs, while large groups
   cost a few edges a class. Many classes that share a key but stay below the threshold
   cost a comparison a pair, spread over the blocks: no link may be lost, and no bound
   on it is known that would spare that near the threshold.
4. Verification computes the weighted Jaccard index of the two multisets, elements being
   32-bit hashes (two documents of n elements share n * n / 2**32 by chance).
   Those of classes with candidates are written once, 4 bytes a pair of words,
   for all rounds.
5. Components of up to ``GATHER`` edges (32 MB) come from one task, so that the driver plans
   and compiles a few queries and not some for each step. Those of more come from alternating large-star and
   small-star steps, until so few edges are left or nothing changes; each writes
   its edges to the shared folder. The least neighbours come from aggregates.

The recall of a pair is 1 - (1 - J ** rows_per_band) ** bands: 0.92 at J = 0.5
and above 0.99 from J = 0.6, before what transitivity adds.

Defined cases: null and blank texts have no signature and form no group; a text
of one word is the multiset of that word. Rows of one doc_id are one document
for grouping, alike to another if any of its rows is. Rows without a doc_id form no
group and are kept. Words compare by bytes. Long texts are hashed in pieces. Other columns aren't read, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.shared import cut, scratch
from batchloom.llm.textarrays import SLICE_BYTES, U64, flat, mix, pieces, sliced, word_hashes, words

BANDS, ROWS_PER_BAND, THRESHOLD = 40, 4, 0.5
PAIR = U64(0x9E3779B97F4A7C15)
#: Classes of a key that are compared as pairs, of a block beyond that; elements that signatures are made of at once.
FEW, BLOCK, ELEMENTS = 32, 256, 1 << 20
#: Edges that one task joins to components; more are brought down in steps first, or to the end.
GATHER = 1 << 21
SIGNED = "doc_id bigint, h1 bigint, h2 bigint, keys array<bigint>"


def multisets(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, count) of every distinct pair of neighbouring words, by row and element."""
    data, off = flat(column)
    starts, ends, word_off = words(data, off)
    hashes = word_hashes(data, starts, ends)
    counts = np.diff(word_off)
    owner = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        pair = mix(hashes[:-1] * PAIR + hashes[1:]) if len(hashes) > 1 else np.zeros(0, U64)
    inner = owner[:-1] == owner[1:] if len(owner) > 1 else np.zeros(0, bool)
    lone = word_off[:-1][counts == 1]
    element = np.concatenate([pair[inner], hashes[lone]])
    row = np.concatenate([owner[:-1][inner] if len(owner) > 1 else owner[:0], owner[lone]])
    order = np.lexsort((element, row))
    element, row = element[order], row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (element[1:] != element[:-1])
    begin = np.flatnonzero(new)
    return row[begin], element[begin], np.diff(np.append(begin, len(row)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    element, count = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(element, kind="stable")
    element, count = element[order], count[order]
    begin = np.flatnonzero(np.append(True, element[1:] != element[:-1])[: len(element)])
    return element[begin], np.add.reduceat(count, begin) if len(begin) else count


def _long_bag(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Elements and counts of a batch of one long row, in pieces."""
    parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, U64), np.zeros(0, np.int64))]
    held = several = 0
    for data, off, _, base in pieces(batch, 1):
        starts, ends, _ = words(data, off)
        hashes = word_hashes(data, starts, ends)
        several += base > 0 or len(hashes) > 1
        with np.errstate(over="ignore"):
            pair = mix(hashes[:-1] * PAIR + hashes[1:]) if len(hashes) > 1 else np.zeros(0, U64)
        parts.append((pair, np.ones(len(pair), np.int64)) if several else (hashes, np.ones(len(hashes), np.int64)))
        held += len(pair)
        if held > 4 * ELEMENTS:
            parts, held = [_merged(parts)], 0
    return _merged(parts)


def bagged(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the batch, a few at a time, with (row, element, count) of their multisets."""
    for part in sliced(batch):
        if part.num_rows == 1 and part.nbytes > 2 * SLICE_BYTES:
            element, count = _long_bag(part)
            yield part, np.zeros(len(element), np.int64), element, count
        else:
            yield part, *multisets(part.column("text"))


def _ranges(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Element number and level range (0 for [0, 1), k for [2**(k-1), 2**k)) of all ranges below the weights."""
    n = 1 + np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 2))), 0).astype(np.int64)
    element = np.repeat(np.arange(len(weight)), n)
    return element, np.arange(len(element)) - np.repeat(np.cumsum(n) - n, n)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, slots: int) -> np.ndarray:
    """One row of 32-bit values for each document; rows without elements stay 0."""
    out = np.zeros((n_rows, slots), np.uint32)
    total = np.bincount(row, weight, n_rows)
    span = np.log(slots) + 3.0
    todo = total > 0
    while todo.any():
        end = span / np.maximum(total, 1)
        best, value = np.full(n_rows * slots, np.inf), np.zeros(n_rows * slots, np.uint32)
        for a in range(0, len(row), ELEMENTS):
            some = np.flatnonzero(todo[row[a : a + ELEMENTS]]) + a
            _first_points(row[some], element[some], weight[some], end, slots, best, value)
        full = (best.reshape(n_rows, slots) < np.inf).all(axis=1) & todo
        out[full] = value.reshape(n_rows, slots)[full]
        todo &= ~full
        span *= 2
    return out


def _first_points(row: np.ndarray, element: np.ndarray, weight: np.ndarray, end: np.ndarray, slots: int, best: np.ndarray, value: np.ndarray) -> None:
    """Brings the time and value of the first point of each slot up to date with these elements' points up to ``end``."""
    points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore", divide="ignore"):
        which, level = _ranges(weight)
        seeds = mix(element[which] ^ mix(level.astype(U64) + U64(0x5851F42D4C957F2D)))
        low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
        width = np.where(level > 0, low, 1.0)
        bounded = low + width > weight[which]
        at = np.arange(len(which))
        time = np.zeros(len(at))
        k = 0
        while len(at):
            draw = mix(seeds[at] + U64(0x9E3779B97F4A7C15) * U64(2 * k + 1))
            time += -np.log(((draw >> U64(11)).astype(np.float64) + 0.5) / 2.0**53) / (slots * width[at])
            more = time <= end[row[which[at]]]
            at, time, draw = at[more], time[more], draw[more]
            if not len(at):
                break
            second = mix(draw ^ U64(0xD1342543DE82EF95))
            slot = ((second & U64(0xFFFFFFFF)) * U64(slots) >> U64(32)).astype(np.int64)
            counted = np.ones(len(at), bool)
            some = np.flatnonzero(bounded[at])
            if len(some):
                index = at[some]
                height = low[index] + (second[some] >> U64(32)).astype(np.float64) / 2.0**32 * width[index]
                counted[some] = height < weight[which[index]]
            cell = row[which[at[counted]]] * slots + slot[counted]
            np.minimum.at(best, cell, time[counted])
            points.append((cell, time[counted], mix(second[counted] + PAIR).astype(np.uint32)))
            k += 1
    for cell, t, v in points:
        first = t == best[cell]
        value[cell[first]] = v[first]


def band_keys(signature: np.ndarray, bands: int, rows_per_band: int) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    part = signature.reshape(len(signature), bands, rows_per_band).astype(U64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), part.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for r in range(rows_per_band):
            key = mix(key * PAIR + part[:, :, r])
    return key


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def signed(docs: DataFrame, bands: int, rows_per_band: int) -> DataFrame:
    """(doc_id, h1, h2, keys) of every document that isn't blank: a hash of its multiset and the keys of its bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, element, weight in bagged(batch):
                some = np.unique(row)
                if not len(some):
                    continue
                keys = band_keys(signatures(row, element, weight, part.num_rows, bands * rows_per_band)[some], bands, rows_per_band)
                begin = np.searchsorted(row, some)
                with np.errstate(over="ignore"):
                    whole = [np.add.reduceat(mix(element ^ U64(salt)) * weight.astype(U64), begin).view(np.int64) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                listed = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * bands, pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(part.column("doc_id").to_numpy()[some]), *map(pa.array, whole), listed], ["doc_id", "h1", "h2", "keys"])

    return _texts(docs).mapInArrow(sign, SIGNED)


def _runs(column, row_bits: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (row, element) codes of a column of bags, their counts, and the size of each bag."""
    data, off = flat(column)
    element, off = data.view("<u4").astype(U64), off // 4
    code = np.repeat(np.arange(len(off) - 1, dtype=U64), np.diff(off)) << U64(row_bits) | element
    begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[begin], np.diff(np.append(begin, len(code))), np.diff(off)


def jaccards(left, right) -> np.ndarray:
    """Weighted Jaccard index of each pair of bags (sorted 32-bit elements, each repeated by its count); 0 for two empty ones."""
    (x, n, size_x), (y, m, size_y) = _runs(left), _runs(right)
    if not len(x) or not len(y):
        return np.zeros(len(size_x))
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    common = np.bincount((y[same] >> U64(32)).astype(np.int64), np.minimum(n[at[same]], m[same]), len(size_x))
    return common / np.maximum(size_x + size_y - common, 1)


def _bags(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(bag_id, bag): the multiset of each row of the documents in ``ids``, 4 bytes for each occurrence."""
    wanted = _texts(docs).join(ids.hint("shuffle_hash"), "doc_id", "left_semi")  # the ids grow with the corpus: never broadcast

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row, element, weight in bagged(batch):
                every = np.repeat((element >> U64(32)).astype(np.uint32), weight)
                edge = np.concatenate([[0], np.cumsum(np.bincount(row, weight, part.num_rows).astype(np.int64))])
                found = [every[edge[i] : edge[i + 1]].tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.binary())], ["bag_id", "bag"])

    return wanted.mapInArrow(bag, "bag_id bigint, bag binary")


def verified(bags: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose multisets overlap enough."""
    held = pairs.join(bags.select(F.col("bag_id").alias("a"), F.col("bag").alias("bag_a")).hint("merge"), "a")
    held = held.join(bags.select(F.col("bag_id").alias("b"), F.col("bag").alias("bag_b")).hint("merge"), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in sliced(batch, "bag_a", 4 * SLICE_BYTES):
                rows = batch.slice(at, part.num_rows)
                at += part.num_rows
                yield rows.select(["a", "b"]).filter(pa.array(jaccards(rows.column("bag_a"), rows.column("bag_b")) >= threshold))

    return held.select("a", "b", "bag_a", "bag_b").mapInArrow(compare, "a bigint, b bigint").distinct()


def overlaps(bags: list[bytes]) -> np.ndarray:
    """The sizes of all common multisets of some bags, by products of matrices over the elements that two have at least."""
    _, off = flat(pa.array(bags, pa.binary()))
    code, count, _ = _runs(pa.array(bags, pa.binary()))
    owner = np.repeat(code >> U64(32), count).astype(np.int64)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)  # a second occurrence is an element of its own
    with np.errstate(over="ignore"):
        element = np.repeat(code & U64(0xFFFFFFFF), count) << U64(32) | nth.astype(U64)
    _, place, found = np.unique(element, return_inverse=True, return_counts=True)
    shared = found[place] > 1
    _, place = np.unique(place[shared], return_inverse=True)
    owner, out = owner[shared], np.zeros((len(off) - 1,) * 2)
    for a in range(0, int(place.max(initial=-1)) + 1, 4096):
        some = (place >= a) & (place < a + 4096)
        held = np.zeros((len(off) - 1, 4096), np.float32)
        held[owner[some], place[some] - a] = 1
        out += held @ held.T
    return out


def _in_blocks(open_keys: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different groups that share a key with many classes and overlap enough; (key, doc_id, group, n)."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    held = open_keys.select("key", "doc_id", "group", mine.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    held = held.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "group")
    held = held.join(bags.withColumnRenamed("bag_id", "doc_id").hint("merge"), "doc_id")

    def compare(table: pa.Table) -> pa.Table:
        ids, groups, block = (table.column(k).to_numpy() for k in ("doc_id", "group", "block"))
        found = table.column("bag").to_pylist()
        size = np.array([len(x) // 4 for x in found])
        common = overlaps(found)
        alike = common >= threshold * (size[:, None] + size - common)
        alike &= (groups[:, None] != groups) & (ids[:, None] < ids)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            alike &= block[:, None] != block
        a, b = np.nonzero(alike)
        return pa.table({"a": ids[a], "b": ids[b]})

    return held.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least neighbour of each vertex."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex of the component of each of ``n`` vertices, by the edges from ``a`` to ``b``."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := root[root]) != root).any():
            root = up


def _gathered(stars: DataFrame) -> DataFrame:
    """(u, v): every vertex but the least of its component, and that one, in a single task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64),) * 2, *((b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches)]
        u, v = (np.concatenate(x) for x in zip(*held))
        ids, place = np.unique(np.append(u, v), return_inverse=True)
        root = roots(len(ids), place[: len(u)], place[len(u) :])
        below = np.flatnonzero(root != np.arange(len(ids)))
        for i in range(0, len(below), 1 << 16):
            some = below[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[root[some]])], ["u", "v"])

    return stars.coalesce(1).mapInArrow(join, "u bigint, v bigint")


def components(edges: DataFrame, *, gather: int = GATHER) -> DataFrame:
    """(doc_id, group_id) of every document with an edge; group_id is the least doc_id of the component."""
    stars, before = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), None
    with scratch(edges.sparkSession):
        stars = cut(stars)
        while stars.count() > gather:
            both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
            linked = large.join(_least(large), "u")
            small = linked.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
            stars = cut(small)
            state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if state == before:
                break
            before = state
        else:
            stars = cut(_gathered(stars))
        groups = stars.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id"))
        return cut(groups.unionAll(groups.select("group_id").distinct().select(F.col("group_id").alias("doc_id"), "group_id")), keep=True)


def _crossing(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(key, doc_id, group, n) of the keys that more than one group has, n being its documents; documents without a group are their own."""
    held = keys.join(known, "doc_id", "left").select("key", "doc_id", F.coalesce("group_id", "doc_id").alias("group"))
    many = held.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
    return held.join(many, "key")


def near_groups(docs: DataFrame, *, threshold: float = THRESHOLD, bands: int = BANDS, rows_per_band: int = ROWS_PER_BAND) -> DataFrame:
    """(doc_id, group_id, is_kept) of the documents that have a near-duplicate; the least doc_id of a group is kept."""
    with scratch(docs.sparkSession):
        made = cut(signed(docs, bands, rows_per_band))
        slim = made.select("doc_id", "h1", "h2").distinct()
        classes = cut(made.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most"), F.any_value("keys").alias("keys")))
        # copies and those they are copies of; rows of one doc_id with unlike texts tie their classes together
        copies = cut(slim.join(classes.where("rep <> most").select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", "rep").distinct())
        several = slim.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
        tied = slim.join(several.hint("shuffle_hash"), "doc_id", "left_semi").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        # keys that several classes have; the aggregate combines before its shuffle, so that a hot key costs a row a task
        every = classes.select(F.explode("keys").alias("key"), F.col("rep").alias("doc_id"))
        least = every.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most").select("key", "least")
        keys = cut(every.join(least.hint("shuffle_hash"), "key").distinct())
        # whoever has candidates; texts are moved this once
        bags = cut(_bags(docs, keys.select("doc_id").distinct()))
        stars = cut(keys.where("doc_id <> least").groupBy(F.col("least").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("n")))
        best = stars.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
        edges = cut(verified(bags, best, threshold).unionAll(tied))
        groups = components(edges)
        # edges from each key's least document to those that aren't yet in its group
        a, b = (groups.select(F.col("doc_id").alias(x), F.col("group_id").alias(f"group_{x}")) for x in "ab")
        own = lambda x: F.coalesce(f"group_{x}", x)
        left = cut(stars.join(best, ["a", "b"], "left_anti").join(a, "a", "left").join(b, "b", "left").where(own("a") != own("b")).select("a", "b"))
        if not left.isEmpty():
            edges = cut(edges.unionAll(verified(bags, left, threshold)))
            groups = components(edges)
        # whatever else has equal keys; pairs of the rounds before have failed already
        open_keys = cut(_crossing(keys.select("key", "doc_id"), groups))
        few = open_keys.where(F.col("n") <= FEW)
        x = few.select("key", F.col("doc_id").alias("a"), F.col("group").alias("group_a"))
        y = few.select("key", F.col("doc_id").alias("b"), F.col("group").alias("group_b"))
        rest = x.join(y, "key").where("group_a <> group_b AND a < b").select("a", "b").distinct()
        rest = cut(rest.join(best, ["a", "b"], "left_anti").join(left, ["a", "b"], "left_anti"))
        more = cut(_in_blocks(open_keys.where(F.col("n") > FEW), bags, threshold))
        if not rest.isEmpty():
            more = more.unionAll(verified(bags, rest, threshold))
            groups = components(edges.unionAll(more))
        elif not more.isEmpty():
            groups = components(edges.unionAll(more))
        # each copy goes where its class goes
        placed = copies.join(groups.select(F.col("doc_id").alias("rep"), "group_id"), "rep", "left").select("doc_id", F.coalesce("group_id", "rep").alias("group_id"))
        out = groups.select("doc_id", "group_id").unionAll(placed).distinct()
        return cut(out.select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("is_kept")), keep=True)


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` without the documents of ``groups`` that aren't kept."""
    gone = groups.where(~F.col("is_kept")).select(F.col("doc_id").alias("gone_id"))
    mine: list[Column] = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(F.struct(*mine).alias("row"), F.col("doc_id").cast("bigint").alias("row_id"))
    return held.join(gone.hint("shuffle_hash"), F.col("row_id") == F.col("gone_id"), "left_anti").select("row.*")
