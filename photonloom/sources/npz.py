"""A Spark data source for NumPy archives: one partition for each stretch of rows of each file."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Rows(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _load(path: str):
    import io

    import numpy as np
    from pyarrow.fs import FileSystem

    fs, name = FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_file(name) as f:
        return np.load(io.BytesIO(f.read()), allow_pickle=False)


class NpzDataSource(DataSource):
    """format("npz").option("array", name).load(path): (row, values) with each row of the array flattened."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "row long, values array<float>"

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(self.options)


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.array = options["path"], options["array"]
        self.rows = int(options.get("rowsperpartition", 4096))

    def partitions(self) -> list[InputPartition]:
        n = _load(self.path)[self.array].shape[0]
        return [_Rows(self.path, k, min(n, k + self.rows)) for k in range(0, n, self.rows)] or [_Rows(self.path, 0, 0)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        values = _load(part.path)[self.array][part.start : part.stop]
        for k, row in enumerate(values.reshape(len(values), -1)):
            yield part.start + k, [float(v) for v in row]


def register(spark) -> None:
    spark.dataSource.register(NpzDataSource)
