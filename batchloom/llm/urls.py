"""URL filter with a weighted vocabulary of strict and soft terms.

An Aho-Corasick automaton finds every term in one pass over the lower-case
URLs of a batch. A hit counts if neither neighbour is an ASCII letter or digit.
A URL is rejected on one strict hit, or on ``distinct_soft`` soft terms that
differ. The scan reads two columns; no shuffle, and the vocabulary is checked to
be small before it travels with the task.

Defined cases: a null or empty URL has no hits and is kept. A term given as
strict and as soft is strict. Upper and lower case are the same for ASCII
letters only. Repeated rows are judged one by one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.textarrays import _cache, flat

STRICT = {"cheap-pills": 10, "casino-win": 10, "adult-x": 10, "spam-farm": 8, "free-bets": 8, "xxx": 10, "porn": 10, "viagra": 10}
SOFT = {"ads": 2, "track": 1, "casino": 3, "bets": 3, "pills": 3, "spam": 3, "adult": 2, "cheap": 1, "free": 1, "win": 1, "bonus": 1, "promo": 1, "feed": 1, "ref": 1}
#: Terms that a task may carry; a longer vocabulary belongs in a file on the executors.
MOST_TERMS = 200_000
FOUND = "strict_hits int, soft_hits int, soft_terms int, score bigint, rejected boolean"


def automaton(terms: tuple[str, ...]):
    known = _cache()
    if ("terms", terms) not in known:
        import ahocorasick

        made = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            # one character for each byte, so that places are those of the bytes
            made.add_word(term.encode().decode("latin-1"), k)
        made.make_automaton()
        known["terms", terms] = made
    return known["terms", terms]


def term_hits(column, terms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row and term of every hit between boundaries."""
    data, off = flat(column)
    text = data.tobytes().lower()
    found = list(automaton(terms).iter(text.decode("latin-1"))) if text and terms else []
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last, term = np.array(found, np.int64).T
    size = np.array([len(t.encode()) for t in terms], np.int64)[term]
    start, end = last - size + 1, last + 1
    row = np.searchsorted(off, start, "right") - 1
    low = np.frombuffer(text, np.uint8)
    solid = np.zeros(len(low) + 2, bool)  # place i + 1 is byte i
    solid[1:-1] = (low >= 97) & (low <= 122) | (low >= 48) & (low <= 57)
    good = (end <= off[row + 1]) & ~(solid[start] & (start > off[row])) & ~(solid[end + 1] & (end < off[row + 1]))
    return row[good], term[good]


def judge_urls(pages: DataFrame, *, strict: Mapping[str, int] = STRICT, soft: Mapping[str, int] = SOFT, distinct_soft: int = 2, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """(id, strict_hits, soft_hits, soft_terms, score, rejected) of every row; score is the sum of the weights of all hits."""
    low = lambda term: term.encode().lower().decode()  # noqa: E731  ASCII letters only, as in the URLs
    weights = {low(k): int(v) for k, v in soft.items() if k} | {low(k): int(v) for k, v in strict.items() if k}
    if len(weights) > MOST_TERMS:
        raise ValueError(f"{len(weights)} terms; at most {MOST_TERMS} travel with a task")
    terms, hard = tuple(weights), np.array([k in set(map(low, strict)) for k in weights], bool)
    weight = np.array(list(weights.values()), np.int64)
    mine = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            row, term = term_hits(batch.column("url"), terms)
            is_hard = hard[term] if len(term) else np.zeros(0, bool)
            n_strict = np.bincount(row[is_hard], minlength=n)
            n_soft = np.bincount(row[~is_hard], minlength=n)
            differ = np.unique(row[~is_hard] * len(terms) + term[~is_hard])
            n_terms = np.bincount(differ // max(len(terms), 1), minlength=n)
            score = np.bincount(row, weight[term] if len(term) else None, n).astype(np.int64)
            out = [pa.array(n_strict, pa.int32()), pa.array(n_soft, pa.int32()), pa.array(n_terms, pa.int32()), pa.array(score), pa.array((n_strict > 0) | (n_terms >= distinct_soft))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *out], ["page_id", "strict_hits", "soft_hits", "soft_terms", "score", "rejected"])

    out = mine.mapInArrow(judge, f"page_id {mine.schema['page_id'].dataType.simpleString()}, {FOUND}")
    return out.withColumnRenamed("page_id", id_column)


def judge_sql(strict: Mapping[str, int] = STRICT, soft: Mapping[str, int] = SOFT, distinct_soft: int = 2) -> str:
    """The same over ``pages`` in SQL, for terms of ASCII letters, digits and inner hyphens."""
    # underscores count as letters for \b
    hits = {t: f"len(regexp_extract_all(u, '\\b{t}\\b'))" for t in [*strict, *soft]}
    both = ", ".join(f'{x} AS "{t}"' for t, x in hits.items())
    total = lambda ts: " + ".join(f'"{t}"' for t in ts)
    differ = " + ".join(f'CAST("{t}" > 0 AS INTEGER)' for t in soft)
    score = " + ".join(f'{w} * "{t}"' for t, w in [*strict.items(), *soft.items()])
    return f"""
WITH u AS (SELECT page_id, replace(lower(coalesce(url, '')), '_', '-') AS u FROM pages),
h AS (SELECT page_id, {both} FROM u),
s AS (SELECT page_id, {total(strict)} AS strict_hits, {total(soft)} AS soft_hits, {differ} AS soft_terms, {score} AS score FROM h)
SELECT page_id, CAST(strict_hits AS INTEGER) AS strict_hits, CAST(soft_hits AS INTEGER) AS soft_hits, CAST(soft_terms AS INTEGER) AS soft_terms,
  CAST(score AS BIGINT) AS score, strict_hits > 0 OR soft_terms >= {distinct_soft} AS rejected FROM s
"""
