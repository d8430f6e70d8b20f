"""Token counts of sections by offset-mapped attribution.

A document is encoded once and whole. The tokens of a byte-level vocabulary
spell the text byte for byte, so their lengths add up to their spans; sections
are spans of characters, carried over to bytes. Tokens and sections meet in an
interval join within the row (both sides are sorted, so two binary searches
find the tokens of a section): one narrow pass, no shuffle, nothing broadcast
but the name of the vocabulary file.

A token that meets several sections is allocated by ``rule``:

- "majority": to the section that holds most of its bytes, of equals the first;
- "first": to the first section that it meets;
- "split": to each section, by the share of its bytes in sections that lie there.

Tokens that meet no section (line ends, blank lines) count under section -1, so
the counts of a row add up to the tokens of its text.

Defined cases: a null text counts as empty; an empty text gives one row with
section -1 and no tokens, and so does a row whose list of sections is null or
empty and whose text is empty. Spans are cut to the text; null sections, and
those with a null end, are left out but keep their number; sections may overlap
and are then met in order of their start. Repeated rows are counted one by one.
Of the input only ``id_column``, ``text_column`` and ``sections`` are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.textarrays import _cache, flat, sliced

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("majority", "first", "split")
COUNTS = "section int, start_char int, end_char int, n_tokens double, n_crossing int"
#: White space runs of this length are cut out by hand: the encoder's pattern matches them by backtracking.
LONG_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}"


def encoder(path: str):
    """The encoding of a file of ranks, and the length of each token in bytes; kept for the life of the process."""
    known = _cache()
    if ("tokens", path) not in known:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            size[rank] = len(token)
        known["tokens", path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size
    return known["tokens", path]


def encode(text: str, path: str) -> np.ndarray:
    """Token ids of the whole text."""
    made, _ = encoder(path)
    ids: list[int] = []
    at = 0
    for run in re.finditer(LONG_SPACE, text):
        # the pattern takes a run as one piece, all but the last character where something follows
        end = run.end() if run.end() == len(text) else run.end() - 1
        ids += made.encode_ordinary(text[at : run.start()])
        ids += made._encode_single_piece(text[run.start() : end])
        at = end
    return np.array(ids + made.encode_ordinary(text[at:]), np.int64)


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (bytes) of every line that isn't empty."""
    cut = data == 10
    begin, end = ~cut, ~cut
    begin[1:] &= cut[:-1]
    end[:-1] &= cut[1:]
    edge = off[(off > 0) & (off < len(data))]
    begin[edge] = ~cut[edge]
    end[edge - 1] = ~cut[edge - 1]
    starts = np.flatnonzero(begin)
    return np.searchsorted(off, starts, "right") - 1, starts, np.flatnonzero(end) + 1


def _given_spans(column, char_at: np.ndarray, off: np.ndarray, byte_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, number, start and end (bytes) of the sections in a column of lists of (start, end)."""
    row, number, starts, ends = [], [], [], []
    for r, spans in enumerate(column.to_pylist()):
        base, most = char_at[off[r]], char_at[off[r + 1]] - char_at[off[r]]
        for k, s in enumerate(spans or []):
            if s is None or s["start"] is None or s["end"] is None:
                continue
            a = min(max(s["start"], 0), most)
            b = min(max(s["end"], a), most)
            row.append(r)
            number.append(k)
            starts.append(byte_of[base + a])
            ends.append(byte_of[base + b])
    out = [np.array(x, np.int64) for x in (row, number, starts, ends)]
    order = np.lexsort((out[1], out[2], out[0]))
    return tuple(x[order] for x in out)


def allocate(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each section, those of them that aren't wholly inside, and a flag for tokens that meet a section.

    Tokens are consecutive: begin and end both rise. Sections are in order of start.
    """
    low = np.searchsorted(end, starts, "right")
    high = np.searchsorted(begin, ends, "left")
    many = np.where(ends > starts, np.maximum(high - low, 0), 0)
    section = np.repeat(np.arange(len(starts)), many)
    token = np.arange(len(section)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    held = np.minimum(end[token], ends[section]) - np.maximum(begin[token], starts[section])
    met = np.bincount(token, minlength=len(begin))
    inside = held == end[token] - begin[token]
    several = met[token] > 1
    share = np.ones(len(token))
    if several.any():
        at = np.flatnonzero(several)
        if rule == "split":
            total = np.bincount(token[at], held[at], len(begin))
            share[at] = held[at] / total[token[at]]
        else:
            weight = -held[at] if rule == "majority" else np.zeros(len(at), np.int64)
            order = at[np.lexsort((section[at], weight, token[at]))]
            lost = np.zeros(len(order), bool)
            lost[1:] = token[order][1:] == token[order][:-1]
            share[order[lost]] = 0
    used = share > 0
    return np.bincount(section, share, len(starts)), np.bincount(section[used & ~inside], minlength=len(starts)), met > 0


def _count(part: pa.RecordBatch, vocabulary: str, rule: str, given: bool) -> tuple[np.ndarray, ...]:
    """Row, section, start and end (characters), tokens and crossing tokens of every result row."""
    data, off = flat(part.column("text"))
    lead = (data & 0xC0) != 0x80
    char_at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=char_at[1:])
    _, size = encoder(vocabulary)
    ids = [encode(t, vocabulary) if t else np.zeros(0, np.int64) for t in part.column("text").to_pylist()]
    n_tokens = np.array([len(x) for x in ids], np.int64)
    end = np.cumsum(size[np.concatenate(ids)])
    begin = end - size[np.concatenate(ids)]
    if len(end) and end[-1] != len(data):
        raise ValueError("the vocabulary doesn't spell every byte")
    if given:
        byte_of = np.append(np.flatnonzero(lead), len(data))
        row, number, starts, ends = _given_spans(part.column("sections"), char_at, off, byte_of)
    else:
        row, starts, ends = line_spans(data, off)
        number = np.arange(len(row)) - np.searchsorted(row, row)
    counts, crossing, met = allocate(begin, end, starts, ends, rule)
    owner = np.repeat(np.arange(part.num_rows), n_tokens)
    rest = np.bincount(owner[~met], minlength=part.num_rows)
    bare = np.flatnonzero((rest > 0) | (n_tokens == 0) & (np.bincount(row, minlength=part.num_rows) == 0))
    base = char_at[off[:-1]]
    none = np.full(len(bare), -1)
    return (
        np.concatenate([row, bare]),
        np.concatenate([number, none]),
        np.concatenate([char_at[starts] - base[row], none]),
        np.concatenate([char_at[ends] - base[row], none]),
        np.concatenate([counts, rest[bare].astype(float)]),
        np.concatenate([crossing, np.zeros(len(bare), np.int64)]),
    )


def section_tokens(docs: DataFrame, *, vocabulary: str, rule: str = "majority", sections: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, section, start_char, end_char, n_tokens, n_crossing) for each section of each row.

    ``vocabulary`` is a file of byte-level ranks that every executor can read.
    ``sections`` names a column of lists of (start, end) characters; without
    it the lines that aren't empty are the sections. ``n_crossing`` counts the
    tokens of a section that reach beyond it. Section -1 has spans of -1.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    chosen = [F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text")]
    if sections:
        chosen.append(F.transform(F.col(f"`{sections}`"), lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"))).alias("sections"))
    mine = docs.select(*chosen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                row, *rest = _count(part, vocabulary, rule, bool(sections))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *(pa.array(x, t) for x, t in zip(rest, kinds))], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing"])

    out = mine.mapInArrow(count, f"doc_id {mine.schema['doc_id'].dataType.simpleString()}, {COUNTS}")
    return out.withColumnRenamed("doc_id", id_column)
