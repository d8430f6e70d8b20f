"""Array helpers of truncation and collation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from batchloom.config import IGNORE


def head(ids: Column, n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(ids, 1, F.greatest(n, F.lit(0)).cast("int"))


def set_last(ids: Column, value: int) -> Column:
    """Ids with the last one replaced; an empty sequence becomes [value]."""
    return F.concat(head(ids, F.size(ids) - 1), F.array(F.lit(value)))


def repeat(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)).cast("int"))


def pad_to(ids: Column, length: Column, value: int) -> Column:
    """Right-padded ids; longer ones stay."""
    return F.concat(ids, repeat(value, length - F.size(ids)))


def mask_to(n_real: Column, length: Column) -> Column:
    return F.concat(repeat(1, n_real), repeat(0, length - n_real))


def response_labels(n_prompt: Column, response: Column, length: Column) -> Column:
    """The response's ids in their place, and the ignored label elsewhere."""
    return F.concat(repeat(IGNORE, n_prompt), response, repeat(IGNORE, length - n_prompt - F.size(response)))


def masked_labels(ids: Column, n_prompt: Column) -> Column:
    """Ids with the first ``n_prompt`` ignored."""
    n = F.least(n_prompt, F.size(ids))
    return F.concat(repeat(IGNORE, n), F.slice(ids, n + 1, F.greatest(F.size(ids) - n, F.lit(0))))


def digest(ids: Column) -> Column:
    return F.md5(F.array_join(ids.cast("array<string>"), ",").cast("binary"))


def to_tensor(ids: Column) -> Column:
    return ids.cast("array<bigint>")
