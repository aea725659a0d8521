"""Stream sources and sinks of one's own: a log in splits that is read by offsets, and a folder that
shows whole batches or nothing of them.

Both keep their files in storage that driver and executors share; paths are URIs that pyarrow's
file systems know (``file``, ``hdfs``, ``s3``, ...), or plain paths of a shared mount.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


def register(spark: SparkSession) -> None:
    """Makes ``split_log`` and ``committed_folder`` known to ``readStream.format`` and ``writeStream.format``."""
    # Spark plans such sources in a Python process of its own, which finds no shipped package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(SplitLog)
    spark.dataSource.register(CommittedFolder)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _files(files: fs.FileSystem, folder: str) -> list[str]:
    """The files of a folder in the order of their names; none if it isn't there."""
    found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")))


def append_to_log(df: DataFrame, path: str, split: str, part: int) -> None:
    """Appends a part to the log that :class:`SplitLog` reads, with a folder for each value of the
    column ``split``; parts count up from 0. Within a part rows are in the order of the files' names."""
    df.withColumn("_split", F.col(split)).write.partitionBy("_split").parquet(f"{path}/part={part:06d}")


@dataclass
class _Range(InputPartition):
    split: str
    start: int
    end: int

    def __init__(self, split: str, start: int, end: int):
        super().__init__((split, start, end))
        self.split, self.start, self.end = split, start, end


class SplitLog(DataSource):
    """A log that was written by :func:`append_to_log`. Options: ``path``, and ``rows_per_split``, how
    many rows a batch takes from a split at most (no limit unless given; not for runs that read what is
    there now, to which Spark gives one batch of such a source).

    Besides the log's columns a row has ``split``, ``offset`` (its place in the split) and
    ``record_ts``, the time of the column that ``timestamp`` names, for a watermark; null where that
    is null or not named."""

    @classmethod
    def name(cls) -> str:
        return "split_log"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return SplitLogReader(self.options["path"], schema, int(self.options.get("rows_per_split", "0")), self.options.get("timestamp", ""))


class SplitLogReader(DataSourceStreamReader):
    """Offsets are rows read of each split: ``{split: rows}``. A batch is a range of rows of each split,
    and a task reads one such range, from the files that hold it alone."""

    def __init__(self, path: str, schema: StructType, limit: int, timestamp: str):
        self.path, self.schema, self.limit, self.timestamp = path, schema, limit, timestamp
        self.sizes: dict[str, int] = {}  # rows of files, which never change once they are there
        self.last: dict[str, int] = {}

    def _splits(self) -> dict[str, list[tuple[str, int]]]:
        """The files of each split, in order, with their numbers of rows."""
        files, root = _open(self.path)
        out: dict[str, list[tuple[str, int]]] = {}
        parts = sorted(x.path for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.base_name.startswith("part="))
        for part in parts:
            if files.get_file_info(f"{part}/_SUCCESS").type == fs.FileType.NotFound:
                break  # still being written, and so is whatever comes behind it
            for split in sorted(x.path for x in files.get_file_info(fs.FileSelector(part)) if x.type == fs.FileType.Directory):
                for file in _files(files, split):
                    if file not in self.sizes:
                        self.sizes[file] = pq.read_metadata(file, filesystem=files).num_rows
                    out.setdefault(split.rpartition("=")[2], []).append((file, self.sizes[file]))
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        ends = {split: sum(n for _, n in files) for split, files in self._splits().items()}
        if self.limit:
            ends = {split: min(end, self.last.get(split, 0) + self.limit) for split, end in ends.items()}
        return ends

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = dict(end)
        return [_Range(split, start.get(split, 0), n) for split, n in sorted(end.items()) if n > start.get(split, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        at = 0
        names = [f for f in self.schema.fieldNames() if f not in ("split", "offset", "record_ts")]
        types = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in self.schema.fields])
        for file, n in self._splits().get(partition.split, []):
            if at < partition.end and at + n > partition.start:
                place = at
                for batch in pq.ParquetFile(file, filesystem=files).iter_batches(columns=sorted({*names, *([self.timestamp] if self.timestamp else [])})):
                    first, last = max(0, partition.start - place), min(batch.num_rows, partition.end - place)
                    if first < last:
                        cut = batch.slice(first, last - first)
                        own = {"split": pa.array([partition.split] * cut.num_rows), "offset": pa.array(range(place + first, place + last), pa.int64()), "record_ts": cut.column(self.timestamp) if self.timestamp else pa.nulls(cut.num_rows)}
                        yield pa.RecordBatch.from_arrays([(own[f.name] if f.name in own else cut.column(f.name)).cast(f.type) for f in types], schema=types)
                    place += batch.num_rows
            at += n

    def commit(self, end: dict) -> None:
        """Nothing is deleted: other readers have offsets of their own."""


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_log(spark: SparkSession, path: str, schema: str, timestamp: str, delay: str, rows_per_split: int = 0) -> DataFrame:
    """A log as a stream, with ``split``, ``offset`` and ``record_ts``, which has the watermark."""
    reader = spark.readStream.format("split_log").schema(f"{schema}, split string, offset bigint, record_ts timestamp")
    return reader.option("path", path).option("timestamp", timestamp).option("rows_per_split", rows_per_split).load().withWatermark("record_ts", delay)


@dataclass
class Written(WriterCommitMessage):
    """The file that a task has written, or None if it had no row."""

    file: str | None
    rows: int


class CommittedFolder(DataSource):
    """A stream sink that shows a batch's rows once all of its tasks are done, and once only.
    Option: ``path``. :func:`committed` reads it."""

    @classmethod
    def name(cls) -> str:
        return "committed_folder"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return FolderWriter(self.options["path"], schema)


class FolderWriter(DataSourceStreamWriter):
    """First phase: each task writes a file of a name of its own under ``data``. Second phase: the
    driver writes the batch's manifest, ``commits/<batch>.json``, which lists these files; it is moved
    to its name whole. A batch that already has a manifest is done: files of another run of it go. What an
    aborted batch has written goes too, and what a lost driver leaves behind is in no manifest, so
    that no reader sees it."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = _open(self.path)
        types = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in self.schema.fields])
        name, rows, writer = f"{uuid.uuid4().hex}.parquet", 0, None
        held: list[dict] = []

        def flush() -> None:
            nonlocal writer
            if writer is None:
                files.create_dir(f"{root}/data", recursive=True)
                writer = pq.ParquetWriter(f"{root}/data/{name}", types, filesystem=files)
            writer.write_table(pa.Table.from_pylist(held, types))
            held.clear()

        for row in iterator:
            held.append(row.asDict())
            rows += 1
            if len(held) >= 10_000:
                flush()
        if held:
            flush()
        if writer is not None:
            writer.close()
        return Written(name if rows else None, rows)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        files, root = _open(self.path)
        files.create_dir(f"{root}/commits", recursive=True)
        mark = f"{root}/commits/{batchId:012d}.json"
        if files.get_file_info(mark).type == fs.FileType.File:
            self._remove(messages)
            return
        held = f"{root}/commits/_{uuid.uuid4().hex}"
        with files.open_output_stream(held) as out:
            out.write("".join(json.dumps({"batch": batchId, "file": m.file, "rows": m.rows}) + "\n" for m in messages if m is not None and m.file).encode())
        files.move(held, mark)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._remove(messages)

    def _remove(self, messages: list) -> None:
        files, root = _open(self.path)
        for m in messages:
            if m is not None and m.file and files.get_file_info(f"{root}/data/{m.file}").type == fs.FileType.File:
                files.delete_file(f"{root}/data/{m.file}")


def committed(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of committed batches, with their ``batch``; the files to read are told by the
    manifests, in a join, so that no list of files comes to the driver by this."""
    marks = spark.read.schema("batch bigint, file string").json(f"{path}/commits").where("file IS NOT NULL")
    data = spark.read.schema(schema).parquet(f"{path}/data").withColumn("_file", F.col("_metadata.file_name"))
    return data.join(marks, F.col("_file") == F.col("file")).drop("_file", "file")
