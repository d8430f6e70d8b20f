from __future__ import annotations

import struct

import pytest
from batchloom.config import LoaderConfig
from batchloom.prepare import prepare, prepare_sources
from batchloom.sources import records, tokenbin
from batchloom.streaming import merge
from pyspark.sql import functions as F

SEQUENCES = [[1, 2, 3], [], [70000]]


def packed(sequences):
    return struct.pack("<I", len(sequences)) + b"".join(struct.pack(f"<H{len(s)}I", len(s), *s) for s in sequences)


@pytest.fixture(autouse=True)
def registered(spark):
    tokenbin.register(spark)


def read(spark, path, **options):
    return spark.read.format("tokenbin").options(**options).load(str(path))


def test_sequences_from_bytes(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(packed(SEQUENCES))
    got = read(spark, tmp_path / "a.bin").orderBy("seq_idx").collect()
    assert [r.ids for r in got] == SEQUENCES and [r.seq_idx for r in got] == [0, 1, 2]


def test_short_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(packed(SEQUENCES)[:-1])
    with pytest.raises(Exception, match="ends within a record"):
        read(spark, tmp_path / "a.bin").collect()
    assert read(spark, tmp_path / "a.bin", mode="PERMISSIVE").count() == 2
    (tmp_path / "a.bin").write_bytes(b"\1")
    assert read(spark, tmp_path / "a.bin", mode="permissive").count() == 0
    with pytest.raises(Exception, match="none.bin"):
        read(spark, tmp_path / "none.bin").collect()
    with pytest.raises(Exception, match="unknown format"):
        read(spark, tmp_path, format="other").collect()


@pytest.mark.parametrize("kind", ["sequences", "samples", "lengths", "compressed"])
def test_round_trips(spark, tmp_path, kind):
    made = {
        "sequences": spark.createDataFrame([([1, 2],), ([],)], "ids array<int>"),
        "samples": spark.createDataFrame([([1, 2], [3]), ([], [])], "prompt_ids array<int>, response_ids array<int>"),
        "lengths": spark.createDataFrame([(1, 65535), (0, 2)], "prompt_len int, response_len int"),
        "compressed": spark.createDataFrame([(0, [1, 2], None, None, None), (1, None, 3, 2, [[0.5, 1.0], [2.0, -1.0]])], "type tinyint, ids array<int>, patch_size int, embed_dim int, vectors array<array<float>>"),
    }[kind]
    at = str(tmp_path / kind)
    made.write.format("tokenbin").option("format", kind).mode("overwrite").save(at)
    made.write.format("tokenbin").option("format", kind).mode("overwrite").save(at)
    back = read(spark, at, format=kind).select(*made.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, made.collect()))
    if kind == "samples":
        found = read(spark, at, format="sample_lengths").select("prompt_len", "response_len").collect()
        assert sorted(map(tuple, found)) == [(0, 0), (2, 1)]
        with pytest.raises(Exception, match="to read only"):
            found = spark.range(1).write.format("tokenbin").option("format", "sample_lengths").mode("append").save(at)
    made.write.format("tokenbin").option("format", kind).mode("append").save(at)
    assert read(spark, at, format=kind).count() == 4


def test_too_long_for_the_format(spark, tmp_path):
    with pytest.raises(Exception, match="65536 ids"):
        spark.range(1).select(F.array_repeat(F.lit(1), 65536).alias("ids")).write.format("tokenbin").mode("append").save(str(tmp_path / "x"))
    with pytest.raises(Exception, match="missing"):
        spark.range(1).write.format("tokenbin").mode("append").save(str(tmp_path / "x"))


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "p", "chosen": "c", "rejected": "r"}\n\n{"prompt": "p", "chosen": "", "rejected": "r"}\n')
    assert records.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 1
    assert records.read_jsonl(spark, str(tmp_path / "a.jsonl"), mode="rollout").count() == 2
    assert records.read_jsonl(spark, str(tmp_path / "a.jsonl"), mode="sft").count() == 0
    assert records.resolve(spark, str(tmp_path / "a.jsonl")).count() >= 2
    (tmp_path / "b.jsonl").write_text('{"question": "q", "answer": " a "}\n{"question": "q", "answer": " "}\n')
    assert [tuple(r) for r in records.read_jsonl_pairs(spark, str(tmp_path / "b.jsonl")).collect()] == [("q", "a")]
    records.write_jsonl(spark.range(9), str(tmp_path / "out"), limit=4)
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_registered_sources(spark, tmp_path):
    raw = spark.createDataFrame([("i", "t")], "inputs string, targets string")
    raw.write.parquet(f"{tmp_path}/lib/split=train_prefs")
    records.register_source("lib", f"{tmp_path}/lib", "inputs_targets", "train_prefs")
    assert records.resolve(spark, "lib").first().prompt == "i"
    with pytest.raises(ValueError):
        records.resolve(spark, "none such")
    with pytest.raises(ValueError):
        records.register_source("x", "y", "none such")


def test_union_with_limits(spark):
    got = records.union_sources({"a": spark.range(5), "b": spark.range(3).withColumn("x", F.lit(1))}, limits={"a": 2, "b": 0})
    assert {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 3}
    with pytest.raises(ValueError):
        records.union_sources({})


def test_shards_and_manifest(spark, tmp_path):
    at = str(tmp_path / "shards")
    df = spark.range(10).select(F.col("id").alias("idx"), F.array(F.lit(1)).alias("prompt_ids"), F.array(F.lit(2)).alias("response_ids"))
    records.write_shards(records.with_shard(df, 4), at, manifest={"max_seq_len": 8})
    manifest = records.read_manifest(spark, f"{at}/manifest.json").collect()
    assert [(r.shard, r.n_samples, r.max_seq_len) for r in manifest] == [(0, 4, 8), (1, 4, 8), (2, 2, 8)]
    assert records.load_samples(spark, at, "rollout").columns == ["idx", "prompt_ids", "shard"]
    assert sorted(r.idx for r in records.load_samples(spark, at, "sft", shard=1).collect()) == [4, 5, 6, 7]
    one = records.load_samples(spark, at, "sft", shard=1, check=False)
    assert "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().toString()
    df.limit(1).withColumn("shard", F.lit(0)).write.mode("append").partitionBy("shard").parquet(at)
    with pytest.raises(ValueError):
        records.load_samples(spark, at, "sft")
    assert records.with_shard(df, 0).select("shard").distinct().count() == 1


def test_streams_lose_and_repeat_nothing(spark, tmp_path):
    for name, n in (("a", 30), ("b", 20)):
        for k in range(3):
            spark.range(n * k, n * (k + 1)).write.mode("append").parquet(f"{tmp_path}/{name}")
    schema = spark.range(1).schema
    stream = merge.stream_sources(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}, schema, files_per_trigger=2)
    merge.write_shuffled(stream, "id", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert {r.source: (r.n, r.d) for r in got} == {"a": (90, 90), "b": (60, 60)}
    merge.write_shuffled(merge.stream_sources(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}, schema), "id", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 150
    with pytest.raises(ValueError):
        merge.stream_sources(spark, {}, schema)


def test_shuffled_rows(spark):
    order = [r.id for r in merge.shuffle_rows(spark.range(50), "id").collect()]
    assert sorted(order) == list(range(50)) and order != sorted(order)
    assert order == [r.id for r in merge.shuffle_rows(spark.range(50).repartition(3), "id").collect()]


def test_other_schemes_are_served_or_refused(spark, tmp_path):
    made = spark.createDataFrame([([1, 2],), ([],), (None,)], "ids array<int>")
    for at in (f"file://{tmp_path}/a", f"file:{tmp_path}/b", f"{tmp_path}/c"):
        made.write.format("tokenbin").option("format", "sequences").mode("append").save(at)
        assert sorted(r.ids for r in read(spark, at, format="sequences").collect()) == [[], [], [1, 2]]
    with pytest.raises(Exception, match="[Uu]nrecognized|unknown|nowhere"):
        made.write.format("tokenbin").option("format", "sequences").mode("append").save("nowhere://x/y")
    assert not (tmp_path / "nowhere:").exists()


def test_files_of_bounded_size(spark, tmp_path, monkeypatch):
    rows = [([i] * 50, [i]) for i in range(500)]
    df = spark.createDataFrame(rows, "prompt_ids array<int>, response_ids array<int>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        writer = tokenbin._Writer(str(tmp_path), "samples", False)
        monkeypatch.setattr(tokenbin, "FILE_BYTES", 20_000)
        monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 3})())
        done = writer.write(iter(df.toArrow().to_batches(max_chunksize=50)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(done.moves) > 3 and not read(spark, tmp_path, format="samples").count()
    writer.commit([done])
    got = read(spark, tmp_path, format="samples").collect()
    assert sorted((r.prompt_ids, r.response_ids) for r in got) == sorted(rows)


def test_manifest_settings(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("idx"), F.array(F.lit(1)).alias("prompt_ids"), F.array(F.lit(2)).alias("response_ids"))
    records.write_shards(records.with_shard(df, 2), f"file://{tmp_path}/s", manifest={"max_seq_len": 77, "pad_token_id": 9, "note": "x"})
    cfg = records.manifest_settings(f"file://{tmp_path}/s", LoaderConfig(batch_size=3))
    assert (cfg.max_seq_len, cfg.pad_id, cfg.batch_size, cfg.eos_id) == (77, 9, 3, 2)
    (tmp_path / "s" / "shard=1").rename(tmp_path / "gone")
    with pytest.raises(ValueError, match="manifest"):
        records.load_samples(spark, f"file://{tmp_path}/s", "sft")


@pytest.mark.parametrize("mode", ["sft", "reward_model", "dpo", "rollout"])
def test_prepare_from_texts_to_shards(spark, tmp_path, mode):
    texts = [(i, f"p{i} " * (i + 1), "c d", "r", "r s") for i in range(9)] + [(9, "", "x", "x", "x"), (10, None, None, "y", None)]
    raw = spark.createDataFrame(texts, "idx bigint, prompt string, chosen string, rejected string, response string")
    cfg = LoaderConfig(max_seq_len=5, max_prompt_len=4, shard_size=4)
    cut = prepare(raw, mode, f"file://{tmp_path}/s", cfg)
    most = 4 if mode == "rollout" else 5
    assert {r.field: r.n_truncated for r in cut.collect()}["prompt_ids"] == 9 - most
    got = records.load_samples(spark, f"file://{tmp_path}/s", mode).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(9)) and [r.shard for r in got] == [0] * 4 + [1] * 4 + [2]
    assert sorted(len(r.prompt_ids) for r in got) == sorted(min(i + 1, most) for i in range(9))
    assert all(x[-1] == 2 for r in got for k, x in r.asDict().items() if k.endswith("_ids") and k != "prompt_ids")
    said = records.read_manifest(spark, f"file://{tmp_path}/s/manifest.json").first()
    assert said.total == 9 and said.skipped == 2 and records.manifest_settings(f"file://{tmp_path}/s", LoaderConfig()).max_seq_len == 5


def test_prepare_from_named_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"prompt": "a b", "response": "c"}\n{"prompt": "d", "response": "e"}\n')
    spark.createDataFrame([("x", "y")], "prompt string, response string").write.parquet(f"{tmp_path}/b")
    prepare_sources(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/b"], "sft", f"{tmp_path}/out", LoaderConfig(shard_size=2), limits={f"{tmp_path}/a.jsonl": 1})
    assert records.load_samples(spark, f"{tmp_path}/out", "sft").count() == 2
