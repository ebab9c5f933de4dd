"""Dense arrays with an index of their rows: `.npy` files read by ranges of rows, and written by partitions.

An index table says which key stands in which row of which file. A file's header is read on the driver, where a bad one is
rejected; tasks read byte ranges of whole rows, so a file of any size is many partitions. Files are opened through Arrow's
file systems, by URI.
"""

from __future__ import annotations

import ast
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
MAGIC = b"\x93NUMPY"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_header(data: bytes, name: str = "") -> tuple[int, np.dtype, int, int]:
    """(offset of the values, type, rows, columns) of an .npy file from its first bytes; ValueError if it isn't a matrix in row order."""
    if data[:6] != MAGIC or len(data) < 12:
        raise ValueError(f"no array file: {name}")
    size, start = (int.from_bytes(data[8:10], "little"), 10) if data[6] == 1 else (int.from_bytes(data[8:12], "little"), 12)
    if len(data) < start + size:
        raise ValueError(f"cut header: {name}")
    try:
        said = ast.literal_eval(data[start : start + size].decode("latin1"))
        kind, shape = np.dtype(said["descr"]), said["shape"]
    except (SyntaxError, ValueError, KeyError, TypeError) as e:
        raise ValueError(f"bad header: {name}") from e
    if len(shape) != 2 or said["fortran_order"] or kind.kind not in "fiu":
        raise ValueError(f"not a matrix of numbers in row order: {name}")
    return start + size, kind, *shape


class _Range(InputPartition):
    def __init__(self, uri: str, file: str, offset: int, kind: str, first: int, rows: int, columns: int):
        self.uri, self.file, self.offset, self.kind, self.first, self.rows, self.columns = uri, file, offset, kind, first, rows, columns


class ArrayReader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.folder)
        out: list[InputPartition] = []
        for info in fs.get_file_info(pafs.FileSelector(path)):
            if not info.base_name.endswith(".npy"):
                continue
            with fs.open_input_file(info.path) as f:
                offset, kind, rows, columns = read_header(f.read(1 << 16), info.path)
            if info.size != offset + rows * columns * kind.itemsize:
                raise ValueError(f"{info.path} has {info.size} bytes")
            step = max(1, self.most // max(1, columns * kind.itemsize))
            out += [_Range(self.folder, info.base_name, offset, kind.str, a, min(step, rows - a), columns) for a in range(0, rows, step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        fs, path = _open(partition.uri)
        kind = np.dtype(partition.kind)
        width = partition.columns * kind.itemsize
        with fs.open_input_file(f"{path}/{partition.file}") as f:
            step = max(1, (4 << 20) // max(1, width))
            for a in range(partition.first, partition.first + partition.rows, step):
                n = min(step, partition.first + partition.rows - a)
                f.seek(partition.offset + a * width)
                values = np.frombuffer(f.read(n * width), kind).astype(np.float64 if kind.itemsize > 4 or kind.kind != "f" else np.float32).astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * partition.columns, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * n), pa.array(np.arange(a, a + n)), lists], names=["file", "row", "values"])


class ArraySource(DataSource):
    """Format `arrays`: (file, row, values) of all .npy files in a folder."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return "file string, row long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))


def write_arrays(df: DataFrame, folder: str, key: str, values: str) -> None:
    """One .npy file (float32) for each partition, and the index (key, file, row) as Parquet; rows whose values are null are left out."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts = [], []
        for b in batches:
            keys += b[key].to_pylist()
            parts.append(np.array(b[values].to_pylist(), np.float32).reshape(b.num_rows, -1))
        if keys:
            file = f"part-{uuid.uuid4().hex}.npy"
            whole = io.BytesIO()
            np.save(whole, np.concatenate([p for p in parts if len(p)]))
            fs, path = _open(folder)
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{file}") as f:
                f.write(whole.getbuffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([file] * len(keys)), pa.array(np.arange(len(keys)))], names=[key, "file", "row"])

    rows = df.where(F.col(values).isNotNull()).select(F.col(key).cast("long").alias(key), values)
    rows.mapInArrow(write, f"`{key}` long, file string, row long").write.parquet(f"{folder}/index")


def read_arrays(spark: SparkSession, folder: str, key: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(key, values) of a folder that write_arrays wrote; files that the index doesn't name, as of a task that ran twice, are not joined."""
    spark.dataSource.register(ArraySource)
    rows = spark.read.format("arrays").option("range_bytes", range_bytes).load(folder)
    return spark.read.parquet(f"{folder}/index").join(rows, ["file", "row"]).select(key, "values")
