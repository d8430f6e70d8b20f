"""Length statistics before truncation.

Percentiles are of the nearest-rank kind: the sorted value at min(n * p div 100, n - 1).
Lengths have few distinct values, so they come exactly from counts by value and
running sums, whatever the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERCENTILES = (50, 75, 90, 95, 99)


def unpivot_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, len), one row for each column of each row."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("bigint").alias("len")) for c in columns])).alias("x")).select("x.*")


def length_stats(df: DataFrame, columns: list[str], percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(field, n, min_len, max_len, mean_len, p50 ...) of each column."""
    counts = unpivot_lengths(df, columns).groupBy("field", "len").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("field").orderBy("len").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("field")
    held = counts.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(whole)})
    at = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    ranks = [F.min(F.when(F.col("upto") > at(p), F.col("len"))).alias(f"p{p}") for p in percentiles]
    mean = F.sum(F.col("len") * F.col("c")) / F.sum("c")
    return held.groupBy("field").agg(F.max("n").alias("n"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), mean.alias("mean_len"), *ranks)


def first_rows(df: DataFrame, key: str, most: int) -> DataFrame:
    """The rows with the ``most`` least keys, as a report's sample; all rows where ``most`` isn't above 0."""
    return df.orderBy(key).limit(most) if most > 0 else df


def truncation_impact(df: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(field, n_over, pct_over, tokens_lost) of each column."""
    over = F.count_if(F.col("len") > most)
    return unpivot_lengths(df, columns).groupBy("field").agg(over.alias("n_over"), (100.0 * over / F.count("*")).alias("pct_over"), F.sum(F.greatest(F.col("len") - most, F.lit(0))).alias("tokens_lost"))


def length_histogram(df: DataFrame, length: Column, boundaries: tuple[int, ...]) -> DataFrame:
    """(bucket, label, n, pct): half-open (previous, boundary]; empty buckets are there, lengths of 0 in none."""
    edges = [(f"<={b}", boundaries[i - 1] if i else 0, b) for i, b in enumerate(boundaries)] + [(f">{boundaries[-1]}", boundaries[-1], 1 << 60)]
    # one pass and one row, which then becomes a row for each bucket
    counts = [F.count_if((length > low) & (length <= high)).alias(f"n{i}") for i, (_, low, high) in enumerate(edges)]
    row = df.agg(F.count("*").alias("total"), *counts)
    each = F.array(*[F.struct(F.lit(i).alias("bucket"), F.lit(name).alias("label"), F.col(f"n{i}").alias("n")) for i, (name, _, _) in enumerate(edges)])
    return row.select("total", F.explode(each).alias("x")).select("x.*", F.coalesce(F.try_divide(100.0 * F.col("x.n"), F.col("total")), F.lit(0.0)).alias("pct"))


def token_totals(df: DataFrame, ok: Column, prompt: Column, response: Column) -> DataFrame:
    """(processed, skipped, prompt_tokens, response_tokens); tokens of skipped rows don't count."""
    return df.agg(F.count_if(ok).alias("processed"), F.count_if(~ok).alias("skipped"), F.coalesce(F.sum(F.when(ok, prompt)), F.lit(0)).cast("bigint").alias("prompt_tokens"), F.coalesce(F.sum(F.when(ok, response)), F.lit(0)).cast("bigint").alias("response_tokens"))


def long_ratio(df: DataFrame, length: Column, most: int, *, threshold: float = 0.20, force: str | None = None) -> DataFrame:
    """(n, n_long, ratio, strategy): COMPRESS from ``threshold`` on, else TRUNCATE; ``force`` names the one to take."""
    if force not in (None, "TRUNCATE", "COMPRESS"):
        raise ValueError(f"unknown strategy {force!r}")
    n, over = F.count("*"), F.count_if(length > most)
    ratio = F.coalesce(F.try_divide(over.cast("double"), n), F.lit(0.0))
    strategy = F.lit(force) if force else F.when(ratio >= threshold, "COMPRESS").otherwise("TRUNCATE")
    return df.agg(n.alias("n"), over.alias("n_long"), ratio.alias("ratio"), strategy.alias("strategy"))
