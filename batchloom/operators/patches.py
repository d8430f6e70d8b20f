"""Patch compression of long sequences.

Planning and splitting are expressions. The encoder is a small transformer: token
embeddings with a leading class token and positions, pre-norm attention and feed-forward
layers with the tanh GELU, a projection of the class token, and a last norm. It
runs over slices of Arrow batches, its weights broadcast (fixed size), so that a worker's
memory depends neither on how many records a batch has nor on how long its patches are squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.arrays import head, repeat

#: Numbers that the widest array of the encoder has at once, and ids and numbers of vectors in a slice of records; a single place or record may have more.
MOST_NUMBERS = 1 << 19


def patch_size(length: Column, most: int) -> Column:
    """ceil(length / M), 1 at least: no more than M patches."""
    return F.greatest(F.ceil(length / most), F.lit(1)).cast("int")


def split_patches(ids: Column, size: Column) -> Column:
    """Chunks of ``size`` ids, the last padded with 0; none of an empty sequence."""
    n = F.ceil(F.size(ids) / size).cast("int")
    padded = F.concat(ids, repeat(0, n * size - F.size(ids)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(padded, i * size + 1, size))).otherwise(F.array().cast("array<array<int>>"))


def plan_patches(df: DataFrame, length: str, most: int) -> DataFrame:
    """``df`` with kind (0 as it is, 1 compressed), patch_size, n_patches and padded_len."""
    size = patch_size(F.col(length), most)
    long = F.col(length) > most
    n = F.ceil(F.col(length) / size).cast("int")
    return df.withColumns({"kind": F.when(long, 1).otherwise(0), "patch_size": F.when(long, size), "n_patches": F.when(long, n), "padded_len": F.when(long, n * size)})


def global_patch_size(df: DataFrame, length: Column, most: int) -> DataFrame:
    """(max_len, patch_size) over all rows."""
    return df.agg(F.max(length).alias("max_len")).withColumn("patch_size", patch_size(F.col("max_len"), most))


def truncate_records(df: DataFrame, ids: str, most: int) -> DataFrame:
    """The truncating arm: records as they are, cut to M without an EOS."""
    return df.withColumns({"was_cut": F.size(ids) > most, ids: head(F.col(ids), most)}).withColumn("type", F.lit(0).cast("tinyint"))


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count("*").alias("n"))


def training_patches(df: DataFrame, ids: str, most: int) -> DataFrame:
    """(patch) of the long sequences only: what an encoder is trained on."""
    long = df.where(F.size(ids) > most)
    return long.select(F.explode(split_patches(F.col(ids), patch_size(F.size(ids), most))).alias("patch"))


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
    mean = x.mean(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5) * gain + bias


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def linear(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return x @ weight.T + bias


@dataclass
class EncoderWeights:
    """Weights by name, in the order of their file."""

    vocab_size: int
    dim: int
    heads: int = 4
    layers: int = 2
    most_positions: int = 512
    values: dict[str, np.ndarray] = field(default_factory=dict)

    def shapes(self) -> dict[str, tuple[int, ...]]:
        d, out = self.dim, {"token": (self.vocab_size, self.dim), "class": (self.dim,), "position": (self.most_positions + 1, self.dim)}
        for i in range(self.layers):
            out |= {f"{i}.norm1.gain": (d,), f"{i}.norm1.bias": (d,), f"{i}.qkv.weight": (3 * d, d), f"{i}.qkv.bias": (3 * d,), f"{i}.out.weight": (d, d), f"{i}.out.bias": (d,)}
            out |= {f"{i}.norm2.gain": (d,), f"{i}.norm2.bias": (d,), f"{i}.up.weight": (4 * d, d), f"{i}.up.bias": (4 * d,), f"{i}.down.weight": (d, 4 * d), f"{i}.down.bias": (d,)}
        return out | {"proj.weight": (d, d), "proj.bias": (d,), "norm.gain": (d,), "norm.bias": (d,)}

    def initialise(self, seed: int = 42) -> EncoderWeights:
        """Normal weights of deviation 0.02, gains 1 and biases 0."""
        rng = np.random.default_rng(seed)
        for name, shape in self.shapes().items():
            if name.endswith("gain"):
                self.values[name] = np.ones(shape, np.float32)
            elif name.endswith("bias"):
                self.values[name] = np.zeros(shape, np.float32)
            else:
                self.values[name] = rng.normal(0, 0.02, shape).astype(np.float32)
        return self

    def save(self, path: str) -> None:
        """Headerless little-endian float32, one array after the other."""
        with Path(path).open("wb") as out:
            for name in self.shapes():
                out.write(self.values[name].astype("<f4").tobytes())

    def load(self, path: str) -> EncoderWeights:
        flat, at = np.fromfile(path, "<f4"), 0
        wanted = sum(int(np.prod(s)) for s in self.shapes().values())
        if len(flat) != wanted:
            raise ValueError(f"{len(flat)} numbers in {path}; {wanted} wanted")
        for name, shape in self.shapes().items():
            n = int(np.prod(shape))
            self.values[name] = flat[at : at + n].reshape(shape)
            at += n
        return self


def attend(q: np.ndarray, k: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Attention of (n, heads, size, dim of a head) arrays, with scores for some places at a time where patches are long."""
    n, heads, size, dim = q.shape
    step = max(1, MOST_NUMBERS // (n * heads * size))
    each = [softmax(q[:, :, i : i + step] @ k.transpose(0, 1, 3, 2) / np.sqrt(dim)) @ u for i in range(0, size, step)]
    return np.concatenate(each, axis=2)


def _encode(patches: np.ndarray, w: EncoderWeights) -> np.ndarray:
    v, (n, size) = w.values, patches.shape
    ids = np.where((patches < 0) | (patches >= w.vocab_size), 0, patches)
    x = np.concatenate([np.broadcast_to(v["class"], (n, 1, w.dim)), v["token"][ids]], axis=1)
    x = x + v["position"][np.minimum(np.arange(size + 1), w.most_positions)]
    for i in range(w.layers):
        y = linear(layer_norm(x, v[f"{i}.norm1.gain"], v[f"{i}.norm1.bias"]), v[f"{i}.qkv.weight"], v[f"{i}.qkv.bias"])
        q, k, u = (part.reshape(n, size + 1, w.heads, -1).transpose(0, 2, 1, 3) for part in np.split(y, 3, axis=-1))
        mixed = attend(q, k, u)
        x = x + linear(mixed.transpose(0, 2, 1, 3).reshape(n, size + 1, w.dim), v[f"{i}.out.weight"], v[f"{i}.out.bias"])
        y = gelu(linear(layer_norm(x, v[f"{i}.norm2.gain"], v[f"{i}.norm2.bias"]), v[f"{i}.up.weight"], v[f"{i}.up.bias"]))
        x = x + linear(y, v[f"{i}.down.weight"], v[f"{i}.down.bias"])
    return layer_norm(linear(x[:, 0], v["proj.weight"], v["proj.bias"]), v["norm.gain"], v["norm.bias"]).astype(np.float32)


def encode_patches(patches: np.ndarray, w: EncoderWeights) -> np.ndarray:
    """(n, dim) vectors of (n, size) patches; ids outside of the vocabulary count as 0."""
    n, size = patches.shape
    step = max(1, MOST_NUMBERS // ((size + 1) * max(w.heads * (size + 1), 4 * w.dim)))
    out = np.empty((n, w.dim), np.float32)
    for i in range(0, n, step):
        out[i : i + step] = _encode(patches[i : i + step], w)
    return out


def record_slices(split: pa.Array, dim: int) -> Iterator[pa.Array]:
    """Runs of records that have MOST_NUMBERS ids and numbers of vectors or so, a record at least."""
    upto = np.cumsum(split.value_lengths().fill_null(0).to_numpy())  # patches to the end of each record
    ids = np.append(0, np.cumsum(split.flatten().value_lengths().to_numpy(), dtype=np.int64))
    run = np.append(0, (ids[upto] + upto.astype(np.int64) * dim)[:-1]) // MOST_NUMBERS
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1), len(split)]
    for i, j in zip(edges, edges[1:]):
        if j > i:
            yield split.slice(i, j - i)


def encode_records(split: pa.Array, w: EncoderWeights) -> pa.Array:
    """For each list of patches the list of their vectors; patches of one size are encoded together."""
    each = split.flatten()
    sizes = each.value_lengths().to_numpy().astype(np.int64)
    ids, begin = each.flatten().fill_null(0).to_numpy(), np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), w.dim), np.float32)
    for size in np.unique(sizes):
        some = np.flatnonzero(sizes == size)
        out[some] = encode_patches(ids[begin[some, None] + np.arange(size)], w)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * w.dim), pa.array(out.ravel()))
    upto = np.cumsum(split.value_lengths().fill_null(0).to_numpy(), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), upto)), vectors)


def compress(df: DataFrame, ids: str, most: int, weights: EncoderWeights) -> DataFrame:
    """Records (type, ids, patch_size, embed_dim, vectors): short sequences as ids, long ones as a vector for each patch."""
    size = patch_size(F.size(ids), most)
    long = F.size(ids) > most
    shared, dim = df.sparkSession.sparkContext.broadcast(weights), weights.dim

    @F.arrow_udf("array<array<float>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in record_slices(batch, dim):
                yield encode_records(part, shared.value)

    others = [F.col(f"`{c}`") for c in df.columns if c != ids]
    split = split_patches(F.when(long, F.col(ids)).otherwise(F.array().cast("array<int>")), size)
    # the split has a name of its own, lest the new ids stand in for the old within it
    held = df.select(*others, F.col(ids).alias("whole_ids"), F.when(long, size).alias("patch_size"), split.alias("split_ids"))
    return held.select(
        *others,
        F.when(F.col("patch_size").isNotNull(), 1).otherwise(0).cast("tinyint").alias("type"),
        F.when(F.col("patch_size").isNull(), F.col("whole_ids")).alias("ids"),
        "patch_size",
        F.when(F.col("patch_size").isNotNull(), weights.dim).alias("embed_dim"),
        F.when(F.col("patch_size").isNotNull(), encode("split_ids")).alias("vectors"),
    )
