"""From raw records to shards, in one call for each of the four modes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.config import MODES, MOST_IDS, LoaderConfig
from batchloom.functions import text
from batchloom.operators.extract import adapt
from batchloom.operators.truncate import first_ids
from batchloom.plans.ranks import dense_index, global_rank, order_key
from batchloom.plans.settle import cut, scratch
from batchloom.sources import records


def tokenised(raw: DataFrame, mode: str, cfg: LoaderConfig, *, tokenise: Callable[[Column], Column] | None = None) -> DataFrame:
    """(idx, the mode's ids) of the rows that have all its texts; sides that are answers end with EOS."""
    tokenise = tokenise or (lambda c: text.token_ids(c, cfg.vocab_size))
    ids = {c: tokenise(F.col(c)) for c in records.MODE_TEXTS[mode]}
    made = {c: x if c == "prompt" else text.ensure_eos(x, cfg.eos_id) for c, x in ids.items()}
    return records.usable(raw, mode).select("idx", *[x.alias(f"{c}_ids") for c, x in made.items()])


def prepare(raw: DataFrame, mode: str, path: str, cfg: LoaderConfig, *, adapter: str | None = None, tokenise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Writes a mode's shards and their manifest to ``path``; returns (field, n_truncated), one row for each field.

    Raw rows have ``idx`` and whatever the adapter reads (or the mode's texts). Ids of a field beyond the most are dropped from its end and
    counted by field. Samples are numbered anew, in the seeded order of ``cfg`` (or that of idx where it doesn't shuffle), and cut into shards of ``cfg.shard_size``.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    spark = raw.sparkSession
    most = min(cfg.max_prompt_len if mode == "rollout" else cfg.max_seq_len, MOST_IDS)
    fields = records.MODE_COLUMNS[mode]
    with scratch(spark):
        source = cut(raw)
        whole = cut(tokenised(adapt(adapter, source) if adapter else source, mode, cfg, tokenise=tokenise))
        counted = whole.agg(F.count("*").alias("n"), *[F.count_if(F.size(c) > most).alias(c) for c in fields]).first()
        order = global_rank(whole.select("idx"), order_key(cfg.seed, cfg.epoch, F.col("idx")), ["idx"], name="place") if cfg.shuffle else dense_index(whole.select("idx"), "idx", name="place")
        placed = whole.join(order, "idx").select(F.col("place").alias("idx"), F.col("idx").alias("source_idx"), *[first_ids(F.col(c), most).alias(c) for c in fields])
        manifest = {"mode": mode, "max_seq_len": cfg.max_seq_len, "pad_token_id": cfg.pad_id, "eos_token_id": cfg.eos_id, "vocab_size": cfg.vocab_size, "shard_size": cfg.shard_size, "seed": cfg.seed, "total": counted.n, "skipped": source.count() - counted.n, "truncated": {c: counted[c] for c in fields}}
        records.write_shards(records.with_shard(placed, cfg.shard_size), path, manifest=manifest)
    return spark.createDataFrame([(c, counted[c]) for c in fields], "field string, n_truncated bigint")


def prepare_sources(spark: SparkSession, sources: list[str], mode: str, path: str, cfg: LoaderConfig, *, split: str = "train", limits: dict[str, int] | None = None, **rest) -> DataFrame:
    """As ``prepare``, from named sources, JSON lines and Parquet paths, numbered in the order of source and text."""
    found = {s: records.resolve(spark, s, split).select(*records.MODE_TEXTS[mode]) for s in sources}
    with scratch(spark):
        texts = cut(records.union_sources(found, limits=limits))
        keyed = texts.withColumn("key", F.struct("source", *records.MODE_TEXTS[mode]))
        return prepare(dense_index(keyed, "key").drop("key"), mode, path, cfg, **rest)
