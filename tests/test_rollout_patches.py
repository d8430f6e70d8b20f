from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from batchloom.operators import patches, rollout
from pyspark.sql import functions as F


def rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_id bigint, advantages array<double>")


def test_normalise(spark):
    got = rollout.normalise_advantages(rows(spark, [[1.0, 2.0], [3.0, 4.0]])).orderBy("row_id").collect()
    assert np.allclose([r.advantages for r in got], [[-1.161895, -0.387298], [0.387298, 1.161895]], atol=1e-6)
    assert rollout.normalise_advantages(rows(spark, [[5.0]])).first().advantages == [0.0]
    assert rollout.normalise_advantages(rows(spark, [[], None, [1.0, 1.0]])).count() == 3


def test_buffer(spark):
    buffer = rollout.RolloutBuffer(minibatch_size=4)
    with pytest.raises(RuntimeError):
        buffer.seal()
    buffer.push(rows(spark, [[float(i)] for i in range(6)]))
    buffer.push(rows(spark, [[float(i)] for i in range(5)]).withColumn("row_id", F.col("row_id") + 6))
    assert buffer.num_minibatches() == 0
    buffer.seal()
    with pytest.raises(RuntimeError):
        buffer.push(rows(spark, [[1.0]]))
    first = []
    while (batch := buffer.next_minibatch()) is not None:
        first.append([r.row_id for r in batch.collect()])
    assert [len(b) for b in first] == [4, 4, 3] and sorted(sum(first, [])) == list(range(11))
    buffer.reset_cursor()
    again = [r.row_id for r in buffer.next_minibatch().collect()]
    assert set(again) != set(first[0])
    buffer.clear()
    assert not buffer.is_sealed and buffer.total_samples == 0


def test_rest_of_a_pass(spark):
    buffer = rollout.RolloutBuffer(minibatch_size=4, normalize_adv=False)
    buffer.push(rows(spark, [[float(i)] for i in range(43)]))
    buffer.seal()
    each = []
    while (batch := buffer.next_minibatch()) is not None:
        each.append([(r.row_id, r.minibatch, r.slot) for r in batch.collect()])
    assert buffer.rest().count() == 0
    buffer.cursor = 3
    rest = buffer.rest()
    assert [(r.row_id, r.minibatch, r.slot) for r in rest.collect()] == sum(each[3:], []) and len(each) == 11
    assert buffer.cursor == 11 and buffer.next_minibatch() is None


def test_a_pass_is_one_scan(spark, tmp_path):
    from batchloom import catalog

    spark.range(450).selectExpr("id AS vec_id", "0 AS label", "array(0.5) AS embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = catalog.rollout_buffer(spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert [(r.minibatch, r.slot) for r in out.collect()] == [(k // 100, k % 100) for k in range(450)]


def test_group_baseline(spark):
    df = spark.createDataFrame([(0, r) for r in (1.0, 0.0, 1.0, 0.0)], "g int, reward double")
    assert [r.advantage for r in rollout.group_baseline(df, "g", "reward").collect()] == [0.5, -0.5, 0.5, -0.5]


def test_losses(spark):
    df = spark.range(1)
    for gap in (-800.0, -1.5, 0.0, 2.0, 800.0):
        expected = math.log1p(math.exp(-gap)) if abs(gap) < 500 else max(-gap, 0.0)
        assert df.select(rollout.reward_model_loss(F.lit(gap), F.lit(0.0))).first()[0] == pytest.approx(expected)
    p = [F.array(*[F.lit(float(v)) for v in x]) for x in ([-1, -2], [-3], [-2, -2], [-2.5])]
    expected = math.log1p(math.exp(-0.1 * ((-3 - -4) - (-3 - -2.5))))
    assert df.select(rollout.preference_loss(*p)).first()[0] == pytest.approx(expected)


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1025, 4000])
def test_patches_fit(spark, n):
    ids = F.array_repeat(F.lit(7), n)
    size = patches.patch_size(F.size(ids), 512)
    row = spark.range(1).select(patches.split_patches(ids, size).alias("p"), size.alias("s")).first()
    assert row.s == max(1, -(-n // 512)) and len(row.p) <= 512
    flat = sum(row.p, [])
    assert flat[:n] == [7] * n and not any(flat[n:]) and len(flat) == -(-n // row.s) * row.s
    if n == 1025:
        assert (row.s, len(row.p), len(flat)) == (3, 342, 1026)


def plain_encoder(patch, w):
    """One patch, by loops over heads and positions."""
    v, d = w.values, w.dim
    x = np.stack([v["class"], *[v["token"][i if 0 <= i < w.vocab_size else 0] for i in patch]]) + v["position"][: len(patch) + 1]

    def norm(y, name):
        return np.stack([(r - r.mean()) / np.sqrt(r.var() + 1e-5) for r in y]) * v[f"{name}.gain"] + v[f"{name}.bias"]

    for i in range(w.layers):
        y = norm(x, f"{i}.norm1") @ v[f"{i}.qkv.weight"].T + v[f"{i}.qkv.bias"]
        out = np.zeros_like(x)
        h = d // w.heads
        for k in range(w.heads):
            q, key, u = (y[:, j * d + k * h : j * d + (k + 1) * h] for j in range(3))
            for a in range(len(x)):
                e = np.exp([q[a] @ key[b] / np.sqrt(h) for b in range(len(x))])
                out[a, k * h : (k + 1) * h] = (e / e.sum()) @ u
        x = x + out @ v[f"{i}.out.weight"].T + v[f"{i}.out.bias"]
        y = norm(x, f"{i}.norm2") @ v[f"{i}.up.weight"].T + v[f"{i}.up.bias"]
        y = 0.5 * y * (1 + np.tanh(np.sqrt(2 / np.pi) * (y + 0.044715 * y**3)))
        x = x + y @ v[f"{i}.down.weight"].T + v[f"{i}.down.bias"]
    return norm(x[:1] @ v["proj.weight"].T + v["proj.bias"], "norm")[0]


def test_encoder_and_weights(tmp_path):
    w = patches.EncoderWeights(50, 8, heads=2, layers=2, most_positions=16).initialise()
    rng = np.random.default_rng(3)
    for name, x in w.values.items():
        w.values[name] = (x + rng.normal(0, 0.3, x.shape)).astype(np.float32)
    batch = rng.integers(-3, 55, (6, 5))
    assert np.allclose(patches.encode_patches(batch, w), [plain_encoder(p, w) for p in batch], atol=1e-4)
    w.save(f"{tmp_path}/w.bin")
    back = patches.EncoderWeights(50, 8, heads=2, layers=2, most_positions=16).load(f"{tmp_path}/w.bin")
    assert all((back.values[k] == w.values[k]).all() for k in w.values)
    with pytest.raises(ValueError):
        patches.EncoderWeights(51, 8, heads=2, layers=2, most_positions=16).load(f"{tmp_path}/w.bin")


def test_compress(spark):
    w = patches.EncoderWeights(50, 8, heads=2, layers=1, most_positions=16).initialise()
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, [5] * 9 + [6] * 3)], "idx int, ids array<int>")
    got = {r.idx: r for r in patches.compress(df, "ids", 4, w).collect()}
    assert got[0].ids == [1, 2, 3] and got[0].vectors is None and got[1].type == 0
    expected = patches.encode_patches(np.array([[5] * 3] * 3 + [[6] * 3]), w)
    assert got[2].ids is None and got[2].patch_size == 3 and np.allclose(got[2].vectors, expected)
    assert patches.training_patches(df, "ids", 4).count() == 4


def varied_weights():
    w = patches.EncoderWeights(50, 8, heads=2, layers=2, most_positions=16).initialise()
    rng = np.random.default_rng(5)
    w.values = {name: (x + rng.normal(0, 0.3, x.shape)).astype(np.float32) for name, x in w.values.items()}
    return w


@pytest.mark.parametrize("shape", [(1, 2500), (40_000, 5)])
def test_memory_of_the_encoder(shape):
    ids = np.random.default_rng(1).integers(0, 50, shape)
    w = varied_weights()
    tracemalloc.start()
    got = patches.encode_patches(ids, w)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.shape == (shape[0], 8) and most < 60e6


@pytest.mark.parametrize("most", [1, 100, 1 << 19])
def test_slices_change_no_vector(monkeypatch, most):
    rng = np.random.default_rng(2)
    records = [[rng.integers(-3, 55, size).tolist() for _ in range(n)] for n, size in [(0, 0), (4, 3), (1, 70), (0, 0), (5, 3), (2, 9), (0, 0)] * 3]
    w = varied_weights()
    expected = [patches.encode_patches(np.array(r), w) if r else np.zeros((0, 8)) for r in records]
    monkeypatch.setattr(patches, "MOST_NUMBERS", most)
    split = pa.array([[[1]], *records, [[1]]], pa.list_(pa.list_(pa.int32()))).slice(1, len(records))
    parts = list(patches.record_slices(split, w.dim))
    assert sum(map(len, parts)) == len(records) and (len(parts) == 1) == (most > 100)
    got = [v for p in parts for v in patches.encode_records(p, w).to_pylist()]
    assert len(got) == len(records) and all(len(g) == len(e) and np.allclose(np.reshape(g, (-1, 8)), e, atol=1e-5) for g, e in zip(got, expected))
    assert not list(patches.record_slices(split.slice(0, 0), w.dim))


def test_compress_in_many_slices(spark):
    """Records of one batch come back in their order with their own vectors."""
    w = patches.EncoderWeights(50, 64, heads=2, layers=1, most_positions=16).initialise()
    df = spark.range(0, 600, numPartitions=1).select(F.col("id").alias("idx"), F.transform(F.sequence(F.lit(1), (F.col("id") % 60 + 1).cast("int")), lambda x: ((F.col("id") * 7 + x) % 50).cast("int")).alias("ids"))
    got = patches.compress(df, "ids", 20, w).collect()
    assert [r.idx for r in got] == list(range(600))
    for r in got:
        whole = [(r.idx * 7 + x) % 50 for x in range(1, r.idx % 60 + 2)]
        if len(whole) <= 20:
            assert r.ids == whole and r.vectors is None
        else:
            size = -(-len(whole) // 20)
            n = -(-len(whole) // size)
            each = np.array(whole + [0] * (n * size - len(whole))).reshape(n, size)
            assert r.patch_size == size and np.allclose(r.vectors, patches.encode_patches(each, w), atol=1e-5)
