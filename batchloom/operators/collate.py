"""Collation into padded batches, one row for each sample (long) or batch (wide).

The length of a batch is a window maximum over its samples; arrays are made
after that, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.functions.arrays import head, mask_to, masked_labels, pad_to, response_labels
from batchloom.operators.truncate import trim_lengths


def _longest(length: Column, by: list[str]) -> Column:
    return F.max(length).over(Window.partitionBy(*by))


def collate_pairs(df: DataFrame, by: list[str], *, pad: int = 0) -> DataFrame:
    """prompt_ids, response_ids to input_ids, attention_mask, labels and batch_len."""
    p, r, n = F.size("prompt_ids"), F.size("response_ids"), F.col("batch_len")
    both = F.concat("prompt_ids", "response_ids")
    out = df.withColumn("batch_len", _longest(p + r, by))
    return out.withColumns({"input_ids": pad_to(both, n, pad), "attention_mask": mask_to(p + r, n), "labels": response_labels(p, F.col("response_ids"), n)}).drop("prompt_ids", "response_ids")


def collate_trimmed(df: DataFrame, by: list[str], most: int, *, pad: int = 0) -> DataFrame:
    """As ``collate_pairs`` with batches cut to ``most``: the prompt first takes what there is."""
    p, r = F.size("prompt_ids"), F.size("response_ids")
    length, kept, rest = trim_lengths(p, r, _longest(p + r, by), most)
    out = df.withColumn("batch_len", length)
    length, kept, rest = trim_lengths(p, r, F.col("batch_len"), most)
    out = out.withColumns({"prompt_ids": head(F.col("prompt_ids"), kept), "response_ids": head(F.col("response_ids"), rest)})
    p, r, n = F.size("prompt_ids"), F.size("response_ids"), F.col("batch_len")
    both = F.concat("prompt_ids", "response_ids")
    return out.withColumns({"input_ids": pad_to(both, n, pad), "attention_mask": mask_to(p + r, n), "labels": response_labels(p, F.col("response_ids"), n)}).drop("prompt_ids", "response_ids")


def collate_preference(df: DataFrame, by: list[str], *, pad: int = 0, labels: bool = False) -> DataFrame:
    """Prompt and chosen, prompt and rejected, each side padded to its own longest; with labels for direct preference."""
    out = df
    for side in ("chosen", "rejected"):
        n = F.size("prompt_ids") + F.size(f"{side}_ids")
        out = out.withColumn(f"{side}_len", _longest(n, by))
    columns = {}
    for side in ("chosen", "rejected"):
        n, length = F.size("prompt_ids") + F.size(f"{side}_ids"), F.col(f"{side}_len")
        columns[f"{side}_input_ids"] = pad_to(F.concat("prompt_ids", f"{side}_ids"), length, pad)
        columns[f"{side}_mask"] = mask_to(n, length)
        if labels:
            columns[f"{side}_labels"] = response_labels(F.size("prompt_ids"), F.col(f"{side}_ids"), length)
    return out.withColumns(columns).drop("prompt_ids", "chosen_ids", "rejected_ids")


def pad_sequences(df: DataFrame, ids: str, by: list[str], *, pad: int = 0) -> DataFrame:
    """A column padded to the longest of its group, and its mask."""
    out = df.withColumn("batch_len", _longest(F.size(ids), by))
    return out.withColumns({ids: pad_to(F.col(ids), F.col("batch_len"), pad), "attention_mask": mask_to(F.size(ids), F.col("batch_len"))})


def build_labels(ids: Column, n_prompt: Column) -> Column:
    return masked_labels(ids, n_prompt)


def stack(df: DataFrame, by: list[str], columns: list[str], *, order: str = "slot") -> DataFrame:
    """One row for each batch: its samples' arrays in order, as a matrix of 64-bit integers. Batches are small by design."""
    held = F.array_sort(F.collect_list(F.struct(order, *[F.col(c).cast("array<bigint>").alias(c) for c in columns])))
    out = df.groupBy(*by).agg(held.alias("samples"))
    return out.select(*by, *[F.col("samples")[c].alias(c) for c in columns])
