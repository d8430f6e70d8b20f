"""The binary formats of token sequences as a Spark data source, ``tokenbin``.

Options: ``format`` sequences (one id list a record), samples (prompt and response),
lengths, compressed, or sample_lengths (of samples, whose ids are passed over; to read only); ``mode`` FAILFAST (an error where a file is short) or
PERMISSIVE (what is whole is read). A path is a file, or a folder of ``.bin`` files, of any scheme that ``storage`` serves. One task
reads one file, in pieces of bounded size. All numbers are little-endian.

Writing packs whole Arrow batches. A task writes files of ``FILE_BYTES`` or so, ``part-<task>-<number>-<unique>.bin``, each with its count at its
head; sequences longer than 65535 ids are an error. A
failed or repeated task leaves nothing behind, as files appear on commit only.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from batchloom.config import MOST_IDS
from batchloom.sources import storage

SCHEMAS = {
    "sequences": "file string, seq_idx bigint, ids array<int>",
    "samples": "file string, seq_idx bigint, prompt_ids array<int>, response_ids array<int>",
    "lengths": "file string, seq_idx bigint, prompt_len int, response_len int",
    "sample_lengths": "file string, seq_idx bigint, prompt_len int, response_len int",
    "compressed": "file string, seq_idx bigint, type tinyint, ids array<int>, patch_size int, embed_dim int, vectors array<array<float>>",
}
WRITTEN = {
    "sequences": ("ids",),
    "samples": ("prompt_ids", "response_ids"),
    "lengths": ("prompt_len", "response_len"),
    "compressed": ("type", "ids", "patch_size", "embed_dim", "vectors"),
}
ROWS = 4096
FILE_BYTES, READ_BYTES = 64 << 20, 1 << 20


class ShortFile(ValueError):
    pass


def files(path: str) -> list[str]:
    return storage.listed(path, ".bin")


def _read(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise ShortFile("a file ends within a record")
    return data


def _ids(f) -> list[int]:
    n = struct.unpack("<H", _read(f, 2))[0]
    found = np.frombuffer(_read(f, 4 * n), "<u4")
    if len(found) and found.max() > 0x7FFFFFFF:
        raise ValueError("an id of 2**31 or more")
    return found.astype(np.int32).tolist()


def _compressed(f) -> tuple:
    kind, steps = struct.unpack("<BH", _read(f, 3))
    if kind == 0:
        return 0, np.frombuffer(_read(f, 4 * steps), "<u4").astype(np.int32).tolist(), None, None, None
    size, dim = struct.unpack("<II", _read(f, 8))
    return 1, None, size, dim, np.frombuffer(_read(f, 4 * steps * dim), "<f4").reshape(steps, dim).tolist()


def _skip_ids(f) -> int:
    """The length of a sequence, its ids passed over."""
    n = struct.unpack("<H", _read(f, 2))[0]
    if n:
        f.seek(f.tell() + 4 * n - 1)
        _read(f, 1)
    return n


READERS = {
    "sequences": lambda f: (_ids(f),),
    "samples": lambda f: (_ids(f), _ids(f)),
    "lengths": lambda f: struct.unpack("<HH", _read(f, 4)),
    "sample_lengths": lambda f: (_skip_ids(f), _skip_ids(f)),
    "compressed": _compressed,
}


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column as unsigned numbers, and the number of each row's; null lists are empty."""
    column = column.cast(pa.large_list(pa.int32()))
    off = column.offsets.to_numpy()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(off), 0)
    if len(size) and size.max() > MOST_IDS:
        raise ValueError(f"{size.max()} ids; the format holds {MOST_IDS}")
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]].astype("<u4"), size


def _pack_ids(*columns: pa.Array) -> bytes:
    """Records of some id lists, each with its number of ids before it; all in 16-bit words."""
    lists = [_lists(c) for c in columns]
    width = sum(1 + 2 * size for _, size in lists)
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), "<u2")
    for values, size in lists:
        out[at] = size
        to = np.repeat(at + 1 - 2 * (np.cumsum(size) - size), size) + 2 * np.arange(len(values))
        out[to], out[to + 1] = values & 0xFFFF, values >> 16
        at = at + 1 + 2 * size
    return out.tobytes()


def _pack_lengths(prompt: pa.Array, response: pa.Array) -> bytes:
    both = np.stack([c.fill_null(0).to_numpy() for c in (prompt, response)], axis=1)
    if both.size and (both.min() < 0 or both.max() > MOST_IDS):
        raise ValueError(f"a length below 0 or above {MOST_IDS}")
    return both.astype("<u2").tobytes()


def _pack_compressed(kind: pa.Array, ids: pa.Array, size: pa.Array, dim: pa.Array, vectors: pa.Array) -> bytes:
    out = []
    for i, k in enumerate(kind.to_pylist()):
        if k == 0:
            out.append(b"\0" + _pack_ids(ids.slice(i, 1)))
        else:
            rows = vectors[i].values
            flat = rows.flatten().to_numpy(zero_copy_only=False)
            out.append(struct.pack("<BHII", 1, len(rows), size[i].as_py(), dim[i].as_py()) + flat.astype("<f4").tobytes())
    return b"".join(out)


PACKERS = {"sequences": _pack_ids, "samples": _pack_ids, "lengths": _pack_lengths, "compressed": _pack_compressed}


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, strict: bool, schema: pa.Schema):
        self.path, self.kind, self.strict, self.schema = path, kind, strict, schema

    def partitions(self) -> list[_File]:
        return [_File(p) for p in files(self.path)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        record = READERS[self.kind]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(self.schema)], schema=self.schema)

        system, _ = storage.open_system(self.path)
        with system.open_input_file(partition.value) as raw, pa.BufferedInputStream(raw, READ_BYTES) if self.kind != "sample_lengths" else raw as f:
            try:
                for i in range(struct.unpack("<I", _read(f, 4))[0]):
                    rows.append((partition.value, i, *record(f)))
                    if len(rows) == ROWS:
                        yield out()
                        rows = []
            except ShortFile:
                if self.strict:
                    raise
        if rows:
            yield out()


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, overwrite: bool):
        self.path, self.kind, self.overwrite = path.rstrip("/"), kind, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        task, pack, moves = TaskContext.get().partitionId(), PACKERS[self.kind], []
        held, size, rows = [], 0, 0

        def out() -> None:
            name = f"part-{task:05d}-{len(moves):05d}-{uuid.uuid4().hex[:12]}.bin"
            storage.write(f"{self.path}/.{name}", rows.to_bytes(4, "little") + b"".join(held))
            moves.append((f"{self.path}/.{name}", f"{self.path}/{name}"))

        for batch in batches:
            data = pack(*(batch.column(c) for c in WRITTEN[self.kind]))
            held.append(data)
            size, rows = size + len(data), rows + batch.num_rows
            if size > FILE_BYTES:
                out()
                held, size, rows = [], 0, 0
        if rows or not moves:
            out()
        return _Written(moves)

    def commit(self, messages) -> None:
        old = files(self.path) if self.overwrite and storage.exists(self.path) else []
        for m in messages:
            for hidden, final in m.moves if m is not None else []:
                storage.move(hidden, final)
        system, _ = storage.open_system(self.path)
        for p in old:
            system.delete_file(p)

    def abort(self, messages) -> None:
        for m in messages:
            for hidden, _ in m.moves if m is not None else []:
                storage.delete(hidden)


class TokenBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenbin"

    def _kind(self) -> str:
        kind = self.options.get("format", "sequences")
        if kind not in SCHEMAS:
            raise ValueError(f"unknown format {kind!r}; there are {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _Reader(self.options["path"], self._kind(), self.options.get("mode", "FAILFAST").upper() != "PERMISSIVE", to_arrow_schema(schema))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if self._kind() not in WRITTEN:
            raise ValueError(f"format {self._kind()!r} is to read only")
        missing = set(WRITTEN[self._kind()]) - set(schema.names)
        if missing:
            raise ValueError(f"columns {sorted(missing)} are missing")
        return _Writer(self.options["path"], self._kind(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenBin)
