"""Files of big-endian unsigned 32-bit integers, read and written in parts.

A file of any size is read by many tasks, each a range of whole integers. A path may be a
file or a folder, whose files follow in the order of their names.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "big_endian_ints"
#: Bytes of a task, and of what it holds at once.
SPLIT, CHUNK = 128 << 20, 4 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, which driver and workers reach, and the path there."""
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    """Integers of a file from byte ``start`` to below ``end``; the first is the ``at``-th of all."""

    def __init__(self, path: str, start: int, end: int, at: int):
        super().__init__((path, start, end, at))


class IntsReader(DataSourceReader):
    def __init__(self, path: str, count: int | None, split: int):
        self.path, self.count, self.split = path, count, max(4, split // 4 * 4)

    def partitions(self) -> list[Range]:
        """Ranges of whole integers. A file that ends inside one is an error, unless all that is
        wanted lies before."""
        where, path = _place(self.path)
        info = where.get_file_info(path)
        if info.type == fs.FileType.Directory:
            found = [f for f in where.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        elif info.is_file:
            found = [info]
        else:
            raise FileNotFoundError(self.path)
        out, at = [], 0
        for f in sorted(found, key=lambda f: f.path):
            end = f.size if self.count is None else min(f.size, 4 * (self.count - at))
            if end % 4:
                raise ValueError(f"{f.path} ends inside an integer")
            out += [Range(f.path, a, min(a + self.split, end), at + a // 4) for a in range(0, end, self.split)]
            at += end // 4
        if self.count is not None and at < self.count:
            raise ValueError(f"{self.path} holds {at} integers, not {self.count}")
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's way to say that there is nothing to read
            return
        path, start, end, at = partition.value
        with _place(self.path)[0].open_input_file(path) as f:
            f.seek(start)
            while start < end:
                raw = f.read(min(CHUNK, end - start))
                values = np.frombuffer(raw, dtype=">u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(values))), pa.array(values)], ["i", "value"])
                start, at = start + len(raw), at + len(values)


class Part(WriterCommitMessage):
    def __init__(self, made: str, name: str):
        self.made, self.name = made, name


class IntsWriter(DataSourceArrowWriter):
    """A file for each task, in the order of the partitions. Tasks write under a name of their
    own; the names become final when all have ended, so a task that is repeated leaves nothing."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        where, path = _place(self.path)
        where.create_dir(path, recursive=True)
        made = f"{path}/_{uuid.uuid4().hex}"
        with where.open_output_stream(made) as f:
            for b in batches:
                values = b.column("value").to_numpy(zero_copy_only=False)
                if len(values) and not (0 <= values.min() and values.max() < 1 << 32):
                    raise ValueError("values must fit 32 bits without a sign")
                f.write(values.astype(">u4").tobytes())
        return Part(made, f"part-{TaskContext.get().partitionId():07d}")

    def commit(self, messages: list) -> None:
        where, path = _place(self.path)
        for m in messages:
            where.move(m.made, f"{path}/{m.name}")

    def abort(self, messages: list) -> None:
        where, _ = _place(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(m.made)


class Ints(DataSource):
    """Options: path; count (integers to read; all); split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "i long, value long"

    def reader(self, schema) -> IntsReader:
        count = self.options.get("count")
        return IntsReader(self.options["path"], None if count is None else int(count), int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> IntsWriter:
        return IntsWriter(self.options["path"])


#: Workers get the classes with the plan, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_ints(spark: SparkSession, path: str, count: int | None = None, split: int = SPLIT) -> DataFrame:
    """(i, value) of the first ``count`` integers (None: all) of a file or folder."""
    spark.dataSource.register(Ints)
    reader = spark.read.format(FORMAT).option("split", split)
    return (reader if count is None else reader.option("count", count)).load(path)


def write_ints(rows: DataFrame, path: str) -> None:
    """Write the column ``value`` in the order of the partitions, a file for each, to a new folder."""
    rows.sparkSession.dataSource.register(Ints)
    rows.selectExpr("CAST(0 AS BIGINT) AS i", "CAST(value AS BIGINT) AS value").write.format(FORMAT).mode("append").save(path)
