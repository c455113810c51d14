"""A sink and source of dense arrays: numpy files of fixed-shape rows, made visible by a manifest when the job commits."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "manifest.json"


def _dense(name: str, a: pa.Array) -> np.ndarray:
    """A column of numbers, or of lists of one length at each level, as one array."""
    shape = [len(a)]
    while pa.types.is_list(a.type) or pa.types.is_large_list(a.type):
        lengths = pc.unique(pc.list_value_length(a))
        if a.null_count or len(lengths) > 1:
            raise ValueError(f"{name} has lists of several lengths, or nulls")
        shape.append(lengths[0].as_py() if len(lengths) else 0)
        a = a.flatten()
    if a.null_count:
        raise ValueError(f"{name} has nulls")
    return a.to_numpy(zero_copy_only=False).reshape(shape)


def _lists(a: np.ndarray) -> pa.Array:
    """What _dense() undoes."""
    out = pa.array(a.reshape(-1))
    for k in range(a.ndim - 1, 0, -1):
        count = int(np.prod(a.shape[:k]))
        out = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * a.shape[k]), out)
    return out


def _manifest(folder: str) -> dict | None:
    files, at = fs.FileSystem.from_uri(folder)
    if files.get_file_info(f"{at}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with files.open_input_stream(f"{at}/{MANIFEST}") as f:
        return json.loads(f.read())


def _delete(folder: str, shards: list[dict]) -> None:
    files, at = fs.FileSystem.from_uri(folder)
    for s in shards:
        for name in s["files"]:
            files.delete_file(f"{at}/{name}")


@dataclass
class _Shards(WriterCommitMessage):
    shards: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: T.StructType, rows: int, overwrite: bool):
        self.folder, self.schema, self.rows, self.overwrite = folder, schema, rows, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Shards:
        part, made, held, count = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], [], 0
        for batch in iterator:
            while batch.num_rows:
                held.append(batch.slice(0, self.rows - count))
                batch = batch.slice(held[-1].num_rows)
                count += held[-1].num_rows
                if count == self.rows:
                    made.append(self._shard(f"{part}-{len(made)}", held))
                    held, count = [], 0
        if count:
            made.append(self._shard(f"{part}-{len(made)}", held))
        return _Shards(made)

    def _shard(self, name: str, batches: list[pa.RecordBatch]) -> dict:
        files, at = fs.FileSystem.from_uri(self.folder)
        files.create_dir(at, recursive=True)
        out = {"rows": sum(b.num_rows for b in batches), "files": [], "shapes": []}
        for k, field in enumerate(self.schema.names):
            parts = [_dense(field, b.column(k)) for b in batches]
            if len({p.shape[1:] for p in parts}) > 1:
                raise ValueError(f"{field} has lists of several lengths")
            out["files"].append(f"{name}.{k}.npy")
            out["shapes"].append(list(parts[0].shape[1:]))
            with files.open_output_stream(f"{at}/{out['files'][-1]}") as f:
                np.save(f, np.concatenate(parts))
        return out

    def commit(self, messages: list[_Shards | None]) -> None:
        old = _manifest(self.folder)
        new = [s for m in messages if m is not None for s in m.shards]
        kept = old["shards"] if old and not self.overwrite else []
        shapes = {json.dumps(s["shapes"]) for s in kept + new}
        if len(shapes) > 1 or (kept and old["schema"] != self.schema.jsonValue()):
            _delete(self.folder, new)
            raise ValueError(f"rows of several shapes: {sorted(shapes)[:5]}")
        files, at = fs.FileSystem.from_uri(self.folder)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{MANIFEST}.new") as f:
            f.write(json.dumps({"schema": self.schema.jsonValue(), "shards": kept + new}).encode())
        files.move(f"{at}/{MANIFEST}.new", f"{at}/{MANIFEST}")
        if old and self.overwrite:
            _delete(self.folder, old["shards"])

    def abort(self, messages: list[_Shards | None]) -> None:
        _delete(self.folder, [s for m in messages if m is not None for s in m.shards])


class _Shard(InputPartition):
    def __init__(self, shard: dict):
        self.shard = shard


class _Reader(DataSourceReader):
    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.names = folder, schema.names

    def partitions(self) -> list[_Shard]:
        return [_Shard(s) for s in (_manifest(self.folder) or {"shards": []})["shards"]]

    def read(self, partition: _Shard) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, _Shard):  # no shards
            return
        files, at = fs.FileSystem.from_uri(self.folder)
        columns = []
        for name in partition.shard["files"]:
            with files.open_input_file(f"{at}/{name}") as f:
                columns.append(_lists(np.load(f)))
        yield pa.RecordBatch.from_arrays(columns, self.names)


class DenseShards(DataSource):
    """Format seqprep_dense: option path, and rows (of a shard, 65,536 if missing).

    Fields are numbers, or lists of numbers of one shape in all rows; nulls and other shapes are errors. A task writes its rows in shards of at most rows and holds one shard at a time.
    The manifest names the shards of the tasks that the job took: those of lost or repeated tasks are never read. Folders are ones that all workers share.
    """

    @classmethod
    def name(cls) -> str:
        return "seqprep_dense"

    def schema(self) -> T.StructType:
        found = _manifest(self.options["path"])
        if found is None:
            raise ValueError(f"no dense rows in {self.options['path']}")
        return T.StructType.fromJson(found["schema"])

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema, int(self.options.get("rows", 65_536)), overwrite)


def write_dense(df: DataFrame, path: str, rows: int = 65_536, mode: str = "append") -> None:
    """Write a DataFrame of dense fields; mode is append or overwrite."""
    df.sparkSession.dataSource.register(DenseShards)
    df.write.format(DenseShards.name()).option("rows", rows).mode(mode).save(path)


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(DenseShards)
    return spark.read.format(DenseShards.name()).load(path)
