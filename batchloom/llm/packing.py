"""Conflict-constrained best-fit packing of documents into training sequences.

Lengths are numbers of words (maximal runs of characters other than ASCII white space), or
a length column. Whole texts are packed: a document longer than a bin fills
bins of its own and its remainder is packed like any document. A bin carries a
bitmap of sources and one of duplicate clusters, and takes no second piece of a
source or a cluster that it has already.

Best-fit decreasing runs within shards, whose number follows from the number of
documents, so each holds about ``shard_docs`` however large the corpus. Within
one, bins lie in lists by what room they have left; a bitmap of the rooms in use
gives the least room that is enough, and its successors are visited until a bin
without conflict is found: the tightest one. Rooms where every bin has the
source are skipped by count. Only ids, lengths and hashes are shuffled, never texts.

A cluster is the set of documents whose words are equal but for the case, or a
cluster column; near copies of unlike words are of one cluster only by such a column (the pipeline has removed them by then). Pieces of one document are of one cluster.

Defined cases: documents without words, and those of null text, have length 0
and go to no bin: bin_id is null and so is piece. A null source is a source of
its own; a null cluster conflicts with none. Rows without a doc_id are packed
too. Repeated rows are packed one by one, in different bins as they share a
cluster, and lie in shards by their number among their like. Ties go to the bin opened first. Extra columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY, SHARD_DOCS = 2048, 8192
PACKED = "bin_id string, doc_id bigint, piece int, n_words bigint, room bigint"
SPACE = "[\\t\\n\\x0B\\f\\r ]+"


def pack(pieces: Iterable[tuple[int, int, int | None]], capacity: int) -> tuple[list[int], list[int]]:
    """The bin of each (length, source, cluster), in the order given, and the room left in each bin.

    Sources and clusters are small numbers, the places of their bits; no cluster is None.
    """
    bins: list[int] = []
    room: list[int] = []
    sources: list[int] = []
    clusters: list[int] = []
    by_room: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # keeps the order of arrival
    with_source: dict[tuple[int, int], int] = defaultdict(int)
    in_use = 0
    for size, source, cluster in pieces:
        source_bit, cluster_bit = 1 << source, 0 if cluster is None else 1 << cluster
        found = -1
        rooms = in_use >> size << size
        while rooms:
            r = (rooms & -rooms).bit_length() - 1
            rooms &= rooms - 1
            if with_source[r, source] == len(by_room[r]):
                continue
            fits = [b for b in by_room[r] if not sources[b] & source_bit and not clusters[b] & cluster_bit]
            if fits:
                found = min(fits)
                break
        if found < 0:
            found = len(room)
            room.append(capacity)
            sources.append(0)
            clusters.append(0)
        else:
            r = room[found]
            del by_room[r][found]
            if not by_room[r]:
                in_use &= ~(1 << r)
            for s in _bits(sources[found]):
                with_source[r, s] -= 1
        bins.append(found)
        room[found] -= size
        sources[found] |= source_bit
        clusters[found] |= cluster_bit
        r = room[found]
        if r:
            by_room[r][found] = None
            in_use |= 1 << r
            for s in _bits(sources[found]):
                with_source[r, s] += 1
    return bins, room


def _bits(bitmap: int) -> Iterator[int]:
    while bitmap:
        low = bitmap & -bitmap
        yield low.bit_length() - 1
        bitmap ^= low


def _pack_shard(table: pa.Table, capacity: int) -> pa.Table:
    columns = table.to_pydict()
    rows = sorted(zip(columns["n_words"], columns["doc_id"], columns["source"], columns["cluster"]), key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2] is None, x[2] or "", x[3] or 0))
    shared: dict = defaultdict(int)
    for n, _, _, cluster in rows:
        shared[cluster] += ceil(n / capacity)
    place: dict = {}
    for cluster, n in shared.items():
        if cluster is not None and n > 1:
            place[cluster] = len(place)
    source_of: dict = {}
    pieces = []
    for i, (n, _, source, cluster) in enumerate(rows):
        bit = source_of.setdefault(source, len(source_of))
        for k in range(ceil(n / capacity)):
            pieces.append((min(capacity, n - k * capacity), bit, place.get(cluster), i, k))
    pieces.sort(key=lambda p: -p[0])
    bins, room = pack([p[:3] for p in pieces], capacity)
    shard = columns["shard"][0]
    bare = [r for r in rows if not r[0]]
    none = [None] * len(bare)
    return pa.table(
        {
            "bin_id": pa.array([f"{shard}-{b}" for b in bins] + none, pa.string()),
            "doc_id": pa.array([rows[p[3]][1] for p in pieces] + [r[1] for r in bare], pa.int64()),
            "piece": pa.array([p[4] for p in pieces] + none, pa.int32()),
            "n_words": pa.array([p[0] for p in pieces] + [0] * len(bare), pa.int64()),
            "room": pa.array([room[b] for b in bins] + none, pa.int64()),
        }
    )


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\t\\n\\x0B\\f\\r ]+")), F.lit(0)).cast("bigint")


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, length: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """(bin_id, doc_id, piece, n_words, room): each piece of each document, its bin, and what room that has left."""
    text = F.col("text")
    words = n_words(text) if length is None else F.greatest(F.coalesce(length.cast("bigint"), F.lit(0)), F.lit(0))
    same = F.xxhash64(F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))) if cluster is None else F.xxhash64(cluster)
    if cluster is not None:
        same = F.when(cluster.isNotNull(), same)
    shards = max(1, ceil(docs.count() / shard_docs))
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("n_words"), same.alias("cluster"))
    # repeated rows are counted before the shuffle and numbered after it, so that however many there are, they are spread
    each = slim.groupBy(*slim.columns).count().withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("count")))).drop("count")
    # rows of one cluster lie in one shard only by chance; those in different shards can't meet
    slim = each.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "n_words", "cluster", "nth"), F.lit(shards)).cast("int")).drop("nth")

    def one(table: pa.Table) -> pa.Table:
        return _pack_shard(table, capacity)

    return slim.groupBy("shard").applyInArrow(one, PACKED)
