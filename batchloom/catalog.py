"""The registered queries of the engine; their SQL is in ``catalog_sql``.

Settings are those of the worked examples: most 128 tokens, boundaries 32, 64
and 128, batches of 8, seed 42, four ranks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom import catalog_sql
from batchloom.config import LoaderConfig
from batchloom.functions import arrays, text
from batchloom.operators import collate, extract, lengths, metrics, patches, rollout, truncate
from batchloom.plans import batches, ranks
from batchloom.plans.settle import cut, place

CFG = LoaderConfig(max_seq_len=128, max_prompt_len=48, max_gen_len=16, boundaries=(32, 64, 128), world_size=4, shard_size=64, window_size=2)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
M, BS = CFG.max_seq_len, CFG.batch_size


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, prompt, response); idx is the conversation."""
    return extract.turns_to_pairs(turns(spark, sf_dir)).withColumnRenamed("conv_id", "idx")


def pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, prompt_ids, response_ids), the response with EOS."""
    p, r = (text.token_ids(F.col(c), CFG.vocab_size) for c in ("prompt", "response"))
    return pairs(spark, sf_dir).select("idx", p.alias("prompt_ids"), text.ensure_eos(r, CFG.eos_id).alias("response_ids"))


def pair_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, p, r), the response with EOS; no ids are made."""
    return pairs(spark, sf_dir).select("idx", text.n_words(F.col("prompt")).alias("p"), (text.n_words(F.col("response")) + 1).alias("r"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, system, prompt, chosen, rejected): first user turn, first and second turn of the assistant."""
    r, t = F.lower(text.strip(F.col("role"))), text.strip(F.col("text"))
    held = turns(spark, sf_dir).where(F.length(t) > 0).select("conv_id", "turn", r.alias("r"), t.alias("t"))
    said = F.array_sort(F.collect_list(F.when(F.col("r") == "assistant", F.struct("turn", "t"))))
    out = held.groupBy(F.col("conv_id").alias("idx")).agg(F.min_by(F.when(F.col("r") == "system", F.col("t")), F.when(F.col("r") == "system", F.col("turn"))).alias("system"), F.min_by(F.when(F.col("r") == "user", F.col("t")), F.when(F.col("r") == "user", F.col("turn"))).alias("prompt"), said.alias("said"))
    return out.select("idx", "system", "prompt", F.get("said", F.lit(0))["t"].alias("chosen"), F.get("said", F.lit(1))["t"].alias("rejected"))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples(spark, sf_dir).where("prompt IS NOT NULL AND chosen IS NOT NULL AND rejected IS NOT NULL")


def preference_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = {c: text.token_ids(F.col(c), CFG.vocab_size) for c in ("prompt", "chosen", "rejected")}
    return preferences(spark, sf_dir).select("idx", ids["prompt"].alias("prompt_ids"), *[text.add_eos(ids[c], CFG.eos_id).alias(f"{c}_ids") for c in ("chosen", "rejected")])


def documents_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "source", "lang", text.n_words(F.col("text")).alias("len"))


def planned(spark: SparkSession, sf_dir: str, batch_size: int = BS, bucketed: bool = True, held: DataFrame | None = None) -> DataFrame:
    """(idx, p, r, len, bucket, batch, slot) of the pairs, cut with the response yielding first; ``held`` has lengths made before."""
    p, r = truncate.instruction_first_lengths(F.col("p"), F.col("r"), M)
    held = (pair_lengths(spark, sf_dir) if held is None else held).select("idx", p.alias("p"), r.alias("r")).withColumn("len", F.col("p") + F.col("r"))
    held = held.withColumn("bucket", batches.bucket(F.col("len"), CFG.boundaries) if bucketed else F.lit(0))
    return batches.bucket_batches(held, "idx", batch_size, by=["bucket"], seed=CFG.seed)


def stepped(spark: SparkSession, sf_dir: str, batch_size: int = BS, bucketed: bool = True) -> DataFrame:
    """One row for each batch, with its step."""
    each = metrics.batch_table(planned(spark, sf_dir, batch_size, bucketed), ["bucket", "batch"], "len")
    return ranks.global_rank(each, ranks.order_key(CFG.seed, CFG.epoch, F.col("bucket"), F.col("batch")), ["bucket", "batch"], name="step")


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, shard, p, r, len) of the pairs by dense index."""
    placed = ranks.dense_index(pair_lengths(spark, sf_dir).withColumnRenamed("idx", "conv_id"), "conv_id")
    p, r = F.least("p", F.lit(M)), F.least("r", F.lit(M))
    return placed.select("idx", F.floor(F.col("idx") / CFG.shard_size).cast("int").alias("shard"), p.alias("p"), r.alias("r"), (p + r).alias("len"))


def digests(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as digest and length, all other columns as they are."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *[arrays.digest(F.col(c)).alias(f"{c}_md5") for c in columns], *[F.size(c).cast("bigint").alias(f"{c}_n") for c in columns])


# Extraction


@query
def sft_pairs(spark, sf_dir):
    return pairs(spark, sf_dir)


@query
def nested_chat_pairs(spark, sf_dir):
    return extract.adapt("chat", extract.nest_turns(turns(spark, sf_dir)).withColumnRenamed("conv_id", "idx"))


@query
def extracted_pairs(spark, sf_dir):
    raw = extract.nest_turns(turns(spark, sf_dir)).withColumnRenamed("conv_id", "idx")
    return extract.extract_pairs(raw).select("idx", "prompt", "response")


@query
def alpaca_style_pairs(spark, sf_dir):
    raw = triples(spark, sf_dir).select("idx", F.col("prompt").alias("instruction"), F.col("system").alias("input"), F.col("chosen").alias("output"))
    return extract.extract_pairs(raw).select("idx", "prompt", "response")


@query
def instruction_adapter(spark, sf_dir):
    raw = triples(spark, sf_dir).select("idx", F.col("prompt").alias("instruction"), F.col("system").alias("input"), F.col("chosen").alias("output"))
    return extract.adapt("instruction", raw)


@query
def inputs_targets_adapter(spark, sf_dir):
    return extract.adapt("inputs_targets", triples(spark, sf_dir).select("idx", F.col("prompt").alias("inputs"), F.col("rejected").alias("targets")))


@query
def orca_prompts(spark, sf_dir):
    raw = triples(spark, sf_dir).select("idx", "system", F.col("prompt").alias("question"), "chosen", "rejected")
    return extract.adapt("system_question", raw)


@query
def trajectory_prompts(spark, sf_dir):
    nested = extract.nest_turns(turns(spark, sf_dir)).select(F.col("conv_id").alias("idx"), F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value"))).alias("trajectory"))
    return extract.adapt("trajectory", nested.join(triples(spark, sf_dir).select("idx", "chosen", "rejected"), "idx"))


@query
def shp_swap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").hint("shuffle_hash"), "doc_id")
    raw = docs.select(F.col("doc_id").alias("idx"), F.col("lang").alias("history"), F.col("text").alias("human_ref_A"), F.col("source").alias("human_ref_B"), F.col("quality").alias("labels"))
    return extract.adapt("votes", raw)


def _dialogues(spark, sf_dir):
    nested = extract.nest_turns(turns(spark, sf_dir))
    line = lambda m: F.concat(F.when(m["role"] == "assistant", "\n\nAssistant: ").otherwise("\n\nHuman: "), m["content"])
    whole = F.array_join(F.transform("messages", line), "")
    return nested.select(F.col("conv_id").alias("idx"), whole.alias("chosen"), F.concat(whole, F.lit(" No.")).alias("rejected"))


@query
def hh_split(spark, sf_dir):
    return extract.adapt("dialogue_text", _dialogues(spark, sf_dir))


@query
def binarised_adapter(spark, sf_dir):
    nested = extract.nest_turns(turns(spark, sf_dir)).select(F.col("conv_id").alias("idx"), F.col("messages").alias("chosen"))
    return extract.adapt("binarised", nested.join(triples(spark, sf_dir).select("idx", "prompt", "rejected"), "idx"))


@query
def preference_to_sft(spark, sf_dir):
    return extract.preference_to_pairs(preferences(spark, sf_dir)).select("idx", "prompt", "response")


@query
def skip_counts(spark, sf_dir):
    raw = triples(spark, sf_dir)
    return extract.skip_counts(raw, "system", "rejected")


@query
def token_totals(spark, sf_dir):
    ok = text.filled(F.col("prompt")) & text.filled(F.col("rejected"))
    return lengths.token_totals(triples(spark, sf_dir), ok, text.n_words(F.col("prompt")), text.n_words(F.col("rejected")))


# Tokens and lengths


@query
def token_lengths(spark, sf_dir):
    return documents_lengths(spark, sf_dir).select("idx", F.col("len").cast("bigint").alias("len"))


@query
def token_ids_digest(spark, sf_dir):
    return digests(pair_ids(spark, sf_dir), "prompt_ids", "response_ids")


@query
def ensure_eos(spark, sf_dir):
    cut = pair_ids(spark, sf_dir).select("idx", F.when(F.col("idx") % 2 == 0, F.col("response_ids")).otherwise(arrays.head(F.col("response_ids"), F.size("response_ids") - 1)).alias("ids"))
    return digests(cut.select("idx", text.ensure_eos(F.col("ids"), CFG.eos_id).alias("ids")), "ids")


@query
def decoded(spark, sf_dir):
    held = pairs(spark, sf_dir)
    vocab = text.vocabulary(held, "prompt", CFG.vocab_size)
    return text.decode(held.select("idx", text.token_ids(F.col("prompt"), CFG.vocab_size).alias("ids")), vocab)


def _three(spark, sf_dir):
    return pair_lengths(spark, sf_dir).select("p", "r", (F.col("p") + F.col("r")).alias("total"))


@query
def length_stats(spark, sf_dir):
    return lengths.length_stats(_three(spark, sf_dir), ["p", "r", "total"])


@query
def document_length_stats(spark, sf_dir):
    return lengths.length_stats(documents_lengths(spark, sf_dir), ["len"])


@query
def truncation_impact(spark, sf_dir):
    return lengths.truncation_impact(_three(spark, sf_dir), ["p", "r", "total"], M)


@query
def length_hist(spark, sf_dir):
    return lengths.length_histogram(documents_lengths(spark, sf_dir), F.col("len"), (64, 128, 256, 512, 1024, 2048))


@query
def length_hist_by_lang(spark, sf_dir):
    held = documents_lengths(spark, sf_dir).withColumn("label", batches.bucket_label(F.col("len"), (64, 128, 256, 512, 1024, 2048)))
    return held.groupBy("lang", "label").agg(F.count("*").alias("n"), F.sum("len").cast("bigint").alias("tokens"))


@query
def sample_lengths_sft(spark, sf_dir):
    return pair_lengths(spark, sf_dir).select("idx", batches.pair_length(F.col("p"), F.col("r"), M).cast("bigint").alias("len"))


@query
def sample_lengths_pref(spark, sf_dir):
    n = {c: text.n_words(F.col(c)) for c in ("prompt", "chosen", "rejected")}
    return preferences(spark, sf_dir).select("idx", batches.preference_length(n["prompt"], n["chosen"] + 1, n["rejected"] + 1, M).cast("bigint").alias("len"))


@query
def sample_lengths_rollout(spark, sf_dir):
    return pair_lengths(spark, sf_dir).select("idx", batches.rollout_length(F.col("p"), CFG.max_prompt_len).cast("bigint").alias("len"))


@query
def long_ratio_decision(spark, sf_dir):
    return lengths.long_ratio(documents_lengths(spark, sf_dir), F.col("len"), 512)


@query
def source_union_mix(spark, sf_dir):
    held = documents_lengths(spark, sf_dir).select("idx", "source", "len").unionByName(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.lit("benchmark").alias("source"), text.n_words(F.col("text")).alias("len")))
    by = held.groupBy("source").agg(F.count("*").alias("n"), F.sum("len").cast("bigint").alias("tokens"), F.coalesce(F.stddev_samp("len"), F.lit(0.0)).alias("std_len"))
    return by.withColumn("mixed", F.col("std_len") > 30)


# Truncation


def _cut(spark, sf_dir, f):
    p, r, *rest = f(F.col("prompt_ids"), F.col("response_ids"))
    out = pair_ids(spark, sf_dir).select("idx", p.alias("prompt_ids"), r.alias("response_ids"), *[x.alias("was_cut") for x in rest])
    return digests(out, "prompt_ids", "response_ids")


@query
def trunc_instruction_first(spark, sf_dir):
    return _cut(spark, sf_dir, lambda p, r: truncate.instruction_first(p, r, M, CFG.eos_id))


@query
def trunc_response_first(spark, sf_dir):
    return _cut(spark, sf_dir, lambda p, r: truncate.response_first(p, r, M, CFG.eos_id))


@query
def trunc_independent(spark, sf_dir):
    def both(p, r):
        (a, x), (b, y) = truncate.independent(p, 48, CFG.eos_id), truncate.independent(r, 48, CFG.eos_id)
        return a, b, x | y

    return _cut(spark, sf_dir, both)


@query
def trunc_budget_tail(spark, sf_dir):
    return _cut(spark, sf_dir, lambda p, r: truncate.budget_aware(p, r, M, CFG.eos_id))


@query
def trunc_budget_head(spark, sf_dir):
    return _cut(spark, sf_dir, lambda p, r: truncate.budget_aware(p, r, M, CFG.eos_id, keep="head"))


@query
def trunc_writer_head(spark, sf_dir):
    return _cut(spark, sf_dir, lambda p, r: (truncate.first_ids(p, 48), truncate.first_ids(r, 48)))


@query
def trunc_preference(spark, sf_dir):
    p, c, j = truncate.preference(F.col("prompt_ids"), F.col("chosen_ids"), F.col("rejected_ids"), M, CFG.eos_id)
    return digests(preference_ids(spark, sf_dir).select("idx", p.alias("prompt_ids"), c.alias("chosen_ids"), j.alias("rejected_ids")), "prompt_ids", "chosen_ids", "rejected_ids")


@query
def rollout_leftpad(spark, sf_dir):
    ids, mask = truncate.rollout_prompt(F.col("prompt_ids"), CFG.max_prompt_len, CFG.max_gen_len, CFG.pad_id)
    return digests(pair_ids(spark, sf_dir).select("idx", ids.alias("ids"), mask.alias("mask")), "ids", "mask")


# Plans


@query
def seeded_order(spark, sf_dir):
    return ranks.global_rank(documents_lengths(spark, sf_dir).select("idx", "lang"), ranks.order_key(CFG.seed, 1, F.col("idx")), ["idx"], by=["lang"])


@query
def dense_index(spark, sf_dir):
    return ranks.dense_index(pairs(spark, sf_dir).select(F.col("idx").alias("conv_id")), "conv_id")


def _ranked(spark, sf_dir, pad, shuffle=True):
    return batches.rank_shards(pairs(spark, sf_dir).select("idx"), "idx", CFG.world_size, seed=CFG.seed, pad=pad, shuffle=shuffle)


@query
def rank_shards_cyclic(spark, sf_dir):
    return _ranked(spark, sf_dir, "cyclic")


@query
def rank_shards_first(spark, sf_dir):
    return _ranked(spark, sf_dir, "first")


@query
def rank_shards_in_order(spark, sf_dir):
    return _ranked(spark, sf_dir, "cyclic", shuffle=False)


def _buckets(spark, sf_dir, overflow):
    held = documents_lengths(spark, sf_dir)
    return held.select("idx", batches.bucket(F.col("len"), (64, 128, 256, 512, 1024, 2048), overflow=overflow).alias("bucket"))


@query
def bucket_assign_clamp(spark, sf_dir):
    return _buckets(spark, sf_dir, False)


@query
def bucket_assign_overflow(spark, sf_dir):
    return _buckets(spark, sf_dir, True)


@query
def bucket_batches(spark, sf_dir):
    return planned(spark, sf_dir).select("idx", "bucket", "batch", "slot")


@query
def rank_bucket_batches(spark, sf_dir):
    """Buckets and batches within each rank, as a worker sees them."""
    held = cut(planned(spark, sf_dir).select("idx", "bucket"))
    held = batches.rank_shards(held, "idx", CFG.world_size, seed=CFG.seed)
    return batches.bucket_batches(held.select("pos", "idx", "rank", "bucket"), "pos", BS, by=["rank", "bucket"], seed=CFG.seed)


@query
def batch_order(spark, sf_dir):
    return batches.batch_order(planned(spark, sf_dir), ["bucket", "batch"], seed=CFG.seed)


@query
def num_batches(spark, sf_dir):
    return batches.num_batches(planned(spark, sf_dir), BS, ["bucket"])


@query
def shard_aware_batches(spark, sf_dir):
    return batches.shard_aware_batches(sharded(spark, sf_dir).select("idx", "shard"), "idx", BS, seed=CFG.seed)


@query
def window_shard_batches(spark, sf_dir):
    return batches.window_batches(sharded(spark, sf_dir).select("idx", "shard"), "idx", BS, CFG.window_size, seed=CFG.seed)


@query
def shard_manifest(spark, sf_dir):
    return metrics.manifest_totals(sharded(spark, sf_dir))


@query
def shard_offsets(spark, sf_dir):
    return batches.shard_offsets(batches.shard_sizes(sharded(spark, sf_dir)))


@query
def locate_index(spark, sf_dir):
    held = sharded(spark, sf_dir)
    return batches.locate(held.select("idx"), batches.shard_offsets(batches.shard_sizes(held)))


@query
def positional_zip(spark, sf_dir):
    left = pair_ids(spark, sf_dir).select(F.col("idx").alias("seq_idx"), F.size("prompt_ids").cast("bigint").alias("p"))
    right = pair_ids(spark, sf_dir).select(F.col("idx").alias("seq_idx"), F.size("response_ids").cast("bigint").alias("r"))
    return batches.zip_sequences(left, right)


@query
def first_batches(spark, sf_dir):
    """A preview: the first five steps."""
    return stepped(spark, sf_dir).orderBy("step").limit(5)


# Collation


def _with_batches(spark, sf_dir, ids):
    return planned(spark, sf_dir).select("idx", "bucket", "batch", "slot").join(ids, "idx")


@query
def collate_sft(spark, sf_dir):
    p, r = truncate.instruction_first(F.col("prompt_ids"), F.col("response_ids"), M, CFG.eos_id)
    ids = pair_ids(spark, sf_dir).select("idx", p.alias("prompt_ids"), r.alias("response_ids"))
    return digests(collate.collate_pairs(_with_batches(spark, sf_dir, ids), ["bucket", "batch"], pad=CFG.pad_id), "input_ids", "attention_mask", "labels")


@query
def collate_trim(spark, sf_dir):
    out = collate.collate_trimmed(_with_batches(spark, sf_dir, pair_ids(spark, sf_dir)), ["bucket", "batch"], 96, pad=CFG.pad_id)
    return digests(out, "input_ids", "attention_mask", "labels")


def _preference_batches(spark, sf_dir):
    held = preference_ids(spark, sf_dir)
    p, c, j = truncate.preference(F.col("prompt_ids"), F.col("chosen_ids"), F.col("rejected_ids"), M, CFG.eos_id)
    cut = held.select("idx", p.alias("prompt_ids"), c.alias("chosen_ids"), j.alias("rejected_ids"))
    return batches.bucket_batches(cut.withColumn("bucket", F.lit(0)), "idx", BS, by=["bucket"], seed=CFG.seed)


@query
def collate_reward(spark, sf_dir):
    out = collate.collate_preference(_preference_batches(spark, sf_dir), ["bucket", "batch"], pad=CFG.pad_id)
    return digests(out, "chosen_input_ids", "chosen_mask", "rejected_input_ids", "rejected_mask")


@query
def collate_dpo(spark, sf_dir):
    out = collate.collate_preference(_preference_batches(spark, sf_dir), ["bucket", "batch"], pad=CFG.pad_id, labels=True)
    return digests(out, "chosen_input_ids", "chosen_mask", "chosen_labels", "rejected_input_ids", "rejected_mask", "rejected_labels")


@query
def collate_rollout(spark, sf_dir):
    """Wide batches, as digests of their matrices row by row."""
    ids, mask = truncate.rollout_prompt(F.col("prompt_ids"), CFG.max_prompt_len, CFG.max_gen_len, CFG.pad_id)
    held = _with_batches(spark, sf_dir, pair_ids(spark, sf_dir).select("idx", ids.alias("ids"), mask.alias("mask")))
    out = collate.stack(held, ["bucket", "batch"], ["ids", "mask"])
    return out.select("bucket", "batch", F.size("ids").cast("bigint").alias("n"), arrays.digest(F.flatten("ids")).alias("ids_md5"), arrays.digest(F.flatten("mask")).alias("mask_md5"))


@query
def pad_sequences(spark, sf_dir):
    held = _with_batches(spark, sf_dir, pair_ids(spark, sf_dir).select("idx", F.col("prompt_ids").alias("ids")))
    return digests(collate.pad_sequences(held, "ids", ["bucket", "batch"], pad=CFG.pad_id), "ids", "attention_mask")


@query
def build_labels(spark, sf_dir):
    ids = F.concat("prompt_ids", "response_ids")
    return digests(pair_ids(spark, sf_dir).select("idx", collate.build_labels(ids, F.size("prompt_ids")).alias("labels")), "labels")


# Metrics


@query
def batch_padding(spark, sf_dir):
    return stepped(spark, sf_dir)


@query
def epoch_summary(spark, sf_dir):
    return metrics.epoch_summary(stepped(spark, sf_dir))


@query
def bucket_breakdown(spark, sf_dir):
    return metrics.bucket_breakdown(stepped(spark, sf_dir), (16, *CFG.boundaries))


@query
def bucket_padding(spark, sf_dir):
    """Padding by assigned bucket."""
    each = metrics.batch_table(planned(spark, sf_dir), ["bucket", "batch"], "len")
    padded = F.sum(F.col("n") * F.col("L"))
    return each.groupBy("bucket").agg(F.count("*").alias("batches"), F.sum("n").alias("samples"), padded.alias("padded"), F.sum("real").alias("real"), (100.0 * (padded - F.sum("real")) / padded).alias("padding_pct"))


@query
def proxy_cost(spark, sf_dir):
    return metrics.proxy_cost(stepped(spark, sf_dir), alpha=2.791e-05, beta=0.0604, gamma=2.361e-08)


@query
def batch_size_sweep(spark, sf_dir):
    out, held = None, cut(pair_lengths(spark, sf_dir))
    for size in (8, 16, 32, 64):
        one = metrics.proxy_cost(metrics.batch_table(planned(spark, sf_dir, size, held=held), ["bucket", "batch"], "len")).withColumn("batch_size", F.lit(size))
        out = one if out is None else out.unionByName(one)
    return out.select("batch_size", "batches", "padded", "real", "padding_pct")


@query
def sweep_choice(spark, sf_dir):
    return metrics.sweep_choice(batch_size_sweep(spark, sf_dir))


@query
def storage_sizes(spark, sf_dir):
    return metrics.storage_by_shard(sharded(spark, sf_dir))


@query
def vram_sizes(spark, sf_dir):
    return metrics.vram(stepped(spark, sf_dir))


@query
def cache_hits(spark, sf_dir):
    return metrics.cache_hits(batches.shard_aware_batches(sharded(spark, sf_dir).select("idx", "shard"), "idx", BS, seed=CFG.seed))


@query
def pipeline_compare(spark, sf_dir):
    """Without buckets against with buckets."""
    held = cut(pair_lengths(spark, sf_dir))
    cost = lambda bucketed: metrics.proxy_cost(metrics.batch_table(planned(spark, sf_dir, bucketed=bucketed, held=held), ["bucket", "batch"], "len"), alpha=2.791e-05, beta=0.0604, gamma=2.361e-08)
    return metrics.compare(cost(False), cost(True))


@query
def mixing_check(spark, sf_dir):
    return metrics.mixing(pair_lengths(spark, sf_dir).withColumn("both", F.col("p") + F.col("r")), "both")


# Patches


@query
def patch_plan(spark, sf_dir):
    return patches.plan_patches(documents_lengths(spark, sf_dir).select("idx", F.col("len").cast("bigint").alias("len")), "len", 512)


@query
def global_patch(spark, sf_dir):
    return patches.global_patch_size(documents_lengths(spark, sf_dir), F.col("len").cast("bigint"), 512)


@query
def patch_split(spark, sf_dir):
    ids = pair_ids(spark, sf_dir).select("idx", F.concat("prompt_ids", "response_ids").alias("ids"))
    split = patches.split_patches(F.col("ids"), patches.patch_size(F.size("ids"), 32))
    each = ids.select("idx", F.posexplode(split).alias("patch_no", "patch"))
    return digests(each, "patch")


@query
def training_patches(spark, sf_dir):
    ids = pair_ids(spark, sf_dir).select(F.concat("prompt_ids", "response_ids").alias("ids"))
    return patches.training_patches(ids, "ids", 64).groupBy(F.size("patch").cast("bigint").alias("patch_size")).agg(F.count("*").alias("n"))


@query
def compress_counts(spark, sf_dir):
    return patches.plan_patches(documents_lengths(spark, sf_dir), "len", 512).groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("n_patches"), F.lit(0)).cast("bigint").alias("patches"))


@query
def truncate_counts(spark, sf_dir):
    ids = pair_ids(spark, sf_dir).select("idx", F.concat("prompt_ids", "response_ids").alias("ids"))
    return patches.truncate_records(ids, "ids", 64).groupBy("was_cut").agg(F.count("*").alias("n"), F.sum(F.size("ids")).cast("bigint").alias("tokens"))


@query
def patch_encode(spark, sf_dir):
    """Records with a vector for each patch; a neural net has no SQL."""
    ids = pair_ids(spark, sf_dir).select("idx", F.concat("prompt_ids", "response_ids").alias("ids"))
    return patches.compress(ids, "ids", 64, patches.EncoderWeights(vocab_size=CFG.vocab_size + 3, dim=16, heads=2, layers=1, most_positions=64).initialise())


# Rollouts


def _rollouts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("group"), F.col("embedding").cast("array<double>").alias("advantages"))


@query
def adv_normalise(spark, sf_dir):
    out = rollout.normalise_advantages(_rollouts(spark, sf_dir))
    return out.select("row_id", F.round(rollout.array_sum(F.col("advantages")), 6).alias("total"), F.round(F.get("advantages", F.lit(0)), 6).alias("first"), F.size("advantages").cast("bigint").alias("n"))


@query
def rollout_minibatches(spark, sf_dir):
    return rollout.minibatches(_rollouts(spark, sf_dir).select("row_id"), "row_id", 8, seed=CFG.seed, epoch=1)


@query
def grpo_advantage(spark, sf_dir):
    held = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return rollout.group_baseline(held, "user_id", "value").select("event_id", "user_id", F.round("advantage", 10).alias("advantage"))


@query
def grpo_groups(spark, sf_dir):
    held = batches.group_expand(pairs(spark, sf_dir).select("idx"), CFG.group_size)
    reward = held.withColumn("reward", ((F.col("idx") * 7 + F.col("copy") * 3) % 5).cast("double"))
    return rollout.group_baseline(reward, "idx", "reward")


@query
def reward_loss(spark, sf_dir):
    a = F.col("advantages")
    return _rollouts(spark, sf_dir).select("row_id", F.round(rollout.reward_model_loss(F.get(a, F.lit(0)), F.get(a, F.lit(1))), 6).alias("loss"))


@query
def preference_loss(spark, sf_dir):
    part = lambda k: F.slice("advantages", k * 16 + 1, 16)
    return _rollouts(spark, sf_dir).select("row_id", F.round(rollout.preference_loss(part(0), part(1), part(2), part(3)), 6).alias("loss"))


# Sources and streams


@query
def tokenbin_roundtrip(spark, sf_dir):
    from batchloom.sources import tokenbin

    tokenbin.register(spark)
    at = place(spark)
    pair_ids(spark, sf_dir).select("prompt_ids", "response_ids").write.format("tokenbin").option("format", "samples").mode("append").save(at)
    back = spark.read.format("tokenbin").option("format", "samples").load(at)
    return digests(back.select("prompt_ids", "response_ids"), "prompt_ids", "response_ids")


@query
def shards_roundtrip(spark, sf_dir):
    from batchloom.sources import records

    at = place(spark)
    ids = ranks.dense_index(pair_ids(spark, sf_dir).withColumnRenamed("idx", "conv_id"), "conv_id")
    records.write_shards(records.with_shard(ids, CFG.shard_size), at, manifest={"max_seq_len": M, "pad_token_id": CFG.pad_id})
    return digests(records.load_samples(spark, at, "sft"), "prompt_ids", "response_ids")


@query
def stream_shuffle(spark, sf_dir):
    """Rows of two streams and their place in the shuffled output, which is one micro-batch here."""
    from batchloom.streaming import merge

    at = place(spark)
    for name in ("documents", "benchmark"):
        key = "doc_id" if name == "documents" else "item_id"
        table(spark, sf_dir, name).select(F.concat_ws(":", F.lit(name), F.col(key)).alias("id"), "text").write.parquet(f"{at}/in/{name}")
    schema = spark.read.parquet(f"{at}/in/benchmark").schema
    stream = merge.stream_sources(spark, {n: f"{at}/in/{n}" for n in ("documents", "benchmark")}, schema, files_per_trigger=100_000)
    merge.write_shuffled(stream, "id", f"{at}/out", f"{at}/state").awaitTermination()
    out = spark.read.parquet(f"{at}/out").select("id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"), "micro_batch", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    # files are in order and rows within: the rows of the files before, then the row's own place
    sizes = out.groupBy("micro_batch", "file").agg(F.count("*").alias("n"))
    before = sizes.select("micro_batch", "file", F.coalesce(F.sum("n").over(Window.partitionBy("micro_batch").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return out.join(before, ["micro_batch", "file"]).select("id", "source", "text_md5", (F.col("start") + F.col("row")).alias("pos"))


def _tokenbin(df: DataFrame, kind: str) -> DataFrame:
    """Rows written in a binary format and read again, with ``part``, the number of their file's task."""
    from batchloom.sources import tokenbin

    spark = df.sparkSession
    tokenbin.register(spark)
    at = place(spark)
    df.write.format("tokenbin").option("format", kind).mode("append").save(at)
    return spark.read.format("tokenbin").option("format", "sample_lengths" if kind == "samples" else kind).load(at).withColumn("part", F.regexp_extract("file", r"part-(\d+-\d+)-", 1))


@query
def sequences_zip(spark, sf_dir):
    """Prompts and responses as two sets of files of sequences, joined again by file and place."""
    ids = cut(pair_ids(spark, sf_dir).repartitionByRange("idx").sortWithinPartitions("idx"))
    left, right = (_tokenbin(ids.select(F.col(f"{c}_ids").alias("ids")), "sequences").select(F.concat_ws("-", "part", "seq_idx").alias("seq_idx"), F.col("ids").alias(f"{c}_ids")) for c in ("prompt", "response"))
    return digests(batches.zip_sequences(left, right).drop("seq_idx"), "prompt_ids", "response_ids")


@query
def lengths_roundtrip(spark, sf_dir):
    """Lengths as a file of their own, and as the heads of the samples' records."""
    ids = pair_ids(spark, sf_dir).select("prompt_ids", "response_ids")
    own = _tokenbin(ids.select(F.size("prompt_ids").alias("prompt_len"), F.size("response_ids").alias("response_len")), "lengths")
    heads = _tokenbin(ids, "samples")
    return own.select(F.lit("lengths").alias("kind"), "prompt_len", "response_len").unionAll(heads.select(F.lit("samples"), "prompt_len", "response_len"))


@query
def compressed_roundtrip(spark, sf_dir):
    """Even vectors as four patches of sixteen, odd ones as ids."""
    odd, v = F.col("vec_id") % 2 == 1, F.col("embedding").cast("array<float>")
    four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice(v, k * 16 + 1, 16))
    made = table(spark, sf_dir, "embeddings").select(
        F.when(odd, 0).otherwise(1).cast("tinyint").alias("type"),
        F.when(odd, F.array(F.col("vec_id").cast("int"), F.col("label").cast("int"))).alias("ids"),
        F.when(~odd, 5).alias("patch_size"),
        F.when(~odd, 16).alias("embed_dim"),
        F.when(~odd, four).alias("vectors"),
    )
    out = _tokenbin(made, "compressed")
    scaled = F.transform(F.flatten("vectors"), lambda x: F.floor(x.cast("double") * 1024).cast("bigint"))
    return out.select(F.col("type").cast("int").alias("type"), arrays.digest(F.col("ids")).alias("ids_md5"), "patch_size", "embed_dim", F.size("vectors").cast("bigint").alias("steps"), arrays.digest(scaled).alias("vectors_md5"))


@query
def permissive_read(spark, sf_dir):
    """A file of the nations' names that lacks its last byte: what is whole is read."""
    from batchloom.sources import storage, tokenbin

    tokenbin.register(spark)
    at = place(spark)
    names = table(spark, sf_dir, "nation").orderBy("n_nationkey").select(text.token_ids(F.concat_ws(" ", "n_name", "n_name"), CFG.vocab_size).alias("ids"))
    names.coalesce(1).write.format("tokenbin").option("format", "sequences").mode("append").save(f"{at}/whole")
    system, _ = storage.open_system(at)
    with system.open_input_stream(tokenbin.files(f"{at}/whole")[0]) as f:
        storage.write(f"{at}/short/a.bin", f.read()[:-1])
    back = spark.read.format("tokenbin").option("format", "sequences").option("mode", "PERMISSIVE").load(f"{at}/short")
    return digests(back.select("seq_idx", "ids"), "ids")


@query
def jsonl_roundtrip(spark, sf_dir):
    """Triples as JSON lines, read strictly by what direct preference needs, and as pairs by name."""
    from batchloom.sources import records

    at = place(spark)
    records.write_jsonl(triples(spark, sf_dir), f"{at}/a.jsonl")
    strict = records.read_jsonl(spark, f"{at}/a.jsonl", mode="dpo").select(F.lit("strict").alias("kind"), "prompt", F.col("chosen").alias("response"))
    return strict.unionAll(records.read_jsonl_pairs(spark, f"{at}/a.jsonl", "prompt", "rejected").select(F.lit("pairs"), "prompt", "response"))


@query
def resolved_sources(spark, sf_dir):
    """One source by its registered name, whose training split has another name, and one by its path."""
    from batchloom.sources import records

    at = place(spark)
    raw = triples(spark, sf_dir).select("idx", F.col("prompt").alias("instruction"), F.col("system").alias("input"), F.col("chosen").alias("output"))
    raw.write.parquet(f"{at}/named/split=train_sft")
    preference_to_sft(spark, sf_dir).write.parquet(f"{at}/plain")
    records.register_source("instructions", f"{at}/named", "instruction", "train_sft")
    found = {"named": records.resolve(spark, "instructions"), "path": records.resolve(spark, f"{at}/plain")}
    return records.union_sources({k: v.select("idx", "prompt", "response") for k, v in found.items()})


@query
def source_limits(spark, sf_dir):
    """A cap of seven rows on one source, in the order of its keys, and none on the other: the cap is the feature."""
    from batchloom.sources import records

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx")).orderBy("idx")
    return records.union_sources({"documents": docs, "benchmark": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"))}, limits={"documents": 7})


@query
def stats_sample(spark, sf_dir):
    """Length statistics of a sample: the feature is its limit, of a hundred documents."""
    return lengths.length_stats(lengths.first_rows(documents_lengths(spark, sf_dir), "idx", 100), ["len"])


@query
def rollout_buffer(spark, sf_dir):
    """Two pushes, sealed; all minibatches of the second pass, one after the other."""
    rows = _rollouts(spark, sf_dir).select("row_id")
    buffer = rollout.RolloutBuffer(minibatch_size=100, normalize_adv=False)
    for k in (0, 1):
        buffer.push(rows.where(F.col("row_id") % 2 == k))
    buffer.seal()
    buffer.reset_cursor()
    return buffer.rest().select("row_id", "minibatch", "slot")


@query
def throughput(spark, sf_dir):
    """Of measured seconds by phase; these are given, so that the result is the same everywhere."""
    return metrics.throughput(stepped(spark, sf_dir), {"read": 1.5, "collate": 0.5})


@query
def tokenizer_ids(spark, sf_dir):
    """A tokenizer in Python, a batch at a time: the same ids as by built-in expressions."""

    def make():
        import hashlib

        return lambda texts: [[3 + int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % CFG.vocab_size for w in t.split()] for t in texts]

    ids = text.tokenizer_udf(make)(F.col("prompt"))
    return digests(pairs(spark, sf_dir).select("idx", ids.alias("prompt_ids")), "prompt_ids")


@query
def cache_hits_lru(spark, sf_dir):
    """A cache of three shards under samples in a seeded order."""
    held = sharded(spark, sf_dir).select("idx", "shard")
    return metrics.cache_hits(ranks.global_rank(held, ranks.order_key(CFG.seed, 0, F.col("idx")), ["idx"]), capacity=3)


# Loaders and preparation


def _samples(spark, sf_dir):
    ids = pair_ids(spark, sf_dir).withColumnRenamed("idx", "conv_id")
    return ranks.dense_index(ids, "conv_id").drop("conv_id")


def _loader_plan(spark, sf_dir, **args):
    from batchloom import loader

    return loader.plan(_samples(spark, sf_dir), "sft", loader.with_epoch(CFG, args.pop("epoch", 0)), rank=1, **args)


@query
def loader_bucketed(spark, sf_dir):
    """The third epoch of the second rank."""
    return _loader_plan(spark, sf_dir, epoch=3)


@query
def loader_sharded(spark, sf_dir):
    return _loader_plan(spark, sf_dir, order="sharded")


@query
def loader_windowed(spark, sf_dir):
    return _loader_plan(spark, sf_dir, order="windowed")


@query
def loader_batches(spark, sf_dir):
    """Tensors of the second rank's batches, as the training process gets them, as digests."""
    from batchloom import loader

    out = loader.build_rollout_dataloader(_samples(spark, sf_dir), CFG, rank=1, order="sharded")
    return out.select("step", F.size("ids").cast("bigint").alias("n"), arrays.digest(F.flatten("ids")).alias("ids_md5"), arrays.digest(F.flatten("mask")).alias("mask_md5"))


def _prepared(spark, sf_dir, mode, raw, adapter=None):
    from batchloom.prepare import prepare
    from batchloom.sources import records

    at = place(spark)
    cut_counts = prepare(raw, mode, at, CFG, adapter=adapter)
    samples = records.load_samples(spark, at, mode)
    return cut_counts, digests(samples, *records.MODE_COLUMNS[mode])


@query
def prepare_sft(spark, sf_dir):
    """Raw turns through the chat adapter to shards, read again by their manifest."""
    raw = extract.nest_turns(turns(spark, sf_dir)).withColumnRenamed("conv_id", "idx")
    return _prepared(spark, sf_dir, "sft", raw, "chat")[1]


@query
def prepare_reward(spark, sf_dir):
    return _prepared(spark, sf_dir, "reward_model", triples(spark, sf_dir))[1]


@query
def prepare_dpo(spark, sf_dir):
    return _prepared(spark, sf_dir, "dpo", triples(spark, sf_dir))[1]


@query
def prepare_rollout(spark, sf_dir):
    return _prepared(spark, sf_dir, "rollout", triples(spark, sf_dir))[1]


@query
def prepare_truncations(spark, sf_dir):
    """How many samples lost ids, by field."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("prompt"), F.col("source").alias("response"))
    return _prepared(spark, sf_dir, "sft", docs)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return catalog_sql.all_sql()
