"""Sources, sinks, formats and catalog objects."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructField, StructType

from rillframe.operators.aggregates import draw
from rillframe.plans.scratch import fresh_path
from rillframe.streaming.drains import run_to_end


def from_elements(spark: SparkSession, rows: list, schema: str | StructType | None = None) -> DataFrame:
    """Inline rows, with given or inferred types."""
    return spark.createDataFrame(rows, schema)


def number_sequence(spark: SparkSession, start: int, end: int, partitions: int | None = None) -> DataFrame:
    """All numbers from start to end, both ends included."""
    return spark.range(start, end + 1, 1, partitions)


def generated(spark: SparkSession, rows: int, seed: int, **columns: Callable[[Column], Column]) -> DataFrame:
    """A bounded number of rows, each column a function of 32 random bits of seed, name and row."""
    named = spark.range(rows).select("id", *[F.lit(name).alias(f"_{name}") for name in columns])
    return named.select("id", *[make(draw(seed, f"_{name}", "id")).alias(name) for name, make in columns.items()])


def read_csv(spark: SparkSession, path: str, schema: str, delimiter: str = "|", comments: bool = True, strict: bool = False) -> DataFrame:
    """Delimited text with typed fields; lines that begin with # are comments. ``strict`` fails at
    the first bad field, else bad fields are null and the line is in ``_corrupt_record``."""
    reader = spark.read.option("sep", delimiter).option("mode", "FAILFAST" if strict else "PERMISSIVE")
    if comments:
        reader = reader.option("comment", "#")
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", files: int | None = None, overwrite: bool = False) -> None:
    """Delimited text in at most ``files`` files; an existing target is an error unless overwritten."""
    out = df if files is None else df.coalesce(files)
    out.write.mode("overwrite" if overwrite else "errorifexists").option("sep", delimiter).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def watch_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files that appear in a folder, as a stream."""
    return spark.readStream.text(folder)


def without_hidden_files(df: DataFrame) -> DataFrame:
    """Rows of files whose names don't begin with _ or a dot and aren't being copied, also of those
    that were named one by one, which Spark reads whatever their names."""
    name = F.col("_metadata.file_name")
    return df.where(~name.startswith("_") & ~name.startswith(".") & ~name.contains("_COPYING_"))


def json_encode(row: Column) -> Column:
    """A record as JSON, nulls written out."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def json_decode(text: Column, schema: str) -> Column:
    """A record from JSON; fields that are missing are null."""
    return F.from_json(text, schema)


def csv_encode(row: Column, delimiter: str = ",") -> Column:
    return F.to_csv(row, {"sep": delimiter})


def csv_decode(text: Column, schema: str, delimiter: str = ",") -> Column:
    return F.from_csv(text, schema, {"sep": delimiter})


def round_trip(df: DataFrame, form: str, **options: str) -> DataFrame:
    """Writes in a file format and reads back."""
    path = fresh_path(df.sparkSession, form)
    df.write.options(**options).format(form).save(path)
    return df.sparkSession.read.options(**options).schema(df.schema).format(form).load(path)


def discard(df: DataFrame) -> None:
    """Computes every row and keeps none."""
    df.write.format("noop").mode("overwrite").save()


def write_all(df: DataFrame, *sinks: Callable[[DataFrame], None]) -> None:
    """Several sinks of one input, which is computed once."""
    df = df.persist()
    try:
        for sink in sinks:
            sink(df)
    finally:
        df.unpersist()


def hybrid(history: DataFrame, live: DataFrame, ts: str, cut: Column) -> DataFrame:
    """First a bounded source up to the cut, then another from there on. Where ``live`` is a stream,
    history is written out first and the stream runs over what is there now into the same folder;
    the result has the ``batch`` of each row, 0 for history."""
    before, after = history.where(F.col(ts) < cut), live.where(F.col(ts) >= cut)
    if not live.isStreaming:
        return before.unionByName(after)
    out = fresh_path(history.sparkSession, "hybrid")
    before.write.parquet(f"{out}/source=history/batch=0")
    run_to_end(after, out=f"{out}/source=live")
    return history.sparkSession.read.parquet(out)


def upsert(spark: SparkSession, path: str | None, changes: DataFrame, key: str, version: Column) -> tuple[DataFrame, str]:
    """The table at ``path`` with the newest row of each key put in; written to a new folder, so a
    repeated batch changes nothing and readers never see a half-written table."""
    columns = changes.columns
    both = changes if path is None else spark.read.parquet(path).unionByName(changes)
    newest = both.withColumn("_version", version).groupBy(key).agg(F.max_by(F.struct(*columns), "_version").alias("_r")).select("_r.*")
    out = fresh_path(spark, "upserted")
    newest.write.parquet(out)
    return spark.read.parquet(out), out


def split_nulls(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the constraint, and rejects."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.col(c).isNotNull()
    return df.where(fine), df.where(~fine)


def explained(df: DataFrame, detail: str = "formatted") -> str:
    """The plan as text (``simple``, ``extended``, ``cost``, ``formatted``) or, for ``json``, as JSON."""
    execution = df._jdf.queryExecution()
    if detail == "json":
        return execution.optimizedPlan().toJSON()
    return execution.explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(detail))


def show_rows(df: DataFrame, rows: int = 20, prefix: str = "") -> None:
    """Prints the first rows, each behind a prefix."""
    for row in df.limit(rows).select(F.to_json(F.struct(*df.columns)).alias("line")).toLocalIterator():
        print(f"{prefix}{row['line']}")


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """Fails when a row with a null in one of the columns reaches the sink."""
    checks = {c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}"))).otherwise(F.col(c)) for c in columns}
    return df.withColumns(checks)


class _Split(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class SequenceSource(DataSource):
    """A partitioned source of one's own: squares of the numbers below ``rows`` in ``splits`` splits."""

    @classmethod
    def name(cls) -> str:
        return "squares"

    def schema(self) -> str:
        return "n bigint, square bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SequenceReader(int(self.options.get("rows", "0")), int(self.options.get("splits", "4")))


class _SequenceReader(DataSourceReader):
    def __init__(self, rows: int, splits: int):
        self.rows, self.splits = rows, splits

    def partitions(self) -> list[InputPartition]:
        step = -(-self.rows // self.splits) or 1
        return [_Split(k, min(k + step, self.rows)) for k in range(0, self.rows, step)] or [_Split(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n in range(partition.first, partition.end):
            yield n, n * n


class TwoPhaseSink:
    """Batches of a stream are written to a place of their own and count once a commit mark stands
    beside them; a batch that comes again is written anew or, once committed, left alone."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or fresh_path(spark, "two-phase")

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def __call__(self, batch: DataFrame, number: int) -> None:
        mark = f"{self.root}/commits/{number}"
        if self._exists(mark):
            return
        self.write(batch, number)
        self.spark.range(1).select(F.lit(number).cast("bigint").alias("batch"), F.lit(int(time.time())).alias("committed_at")).write.mode("overwrite").parquet(mark)

    def write(self, batch: DataFrame, number: int) -> None:
        """The first phase alone: rows that no reader sees yet."""
        batch.write.mode("overwrite").parquet(f"{self.root}/data/batch={number}")

    def read(self, schema: StructType) -> DataFrame:
        """The rows of committed batches: those whose mark is there."""
        marks = self.spark.read.schema("batch bigint").parquet(f"{self.root}/commits/*").distinct()
        data = self.spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", f"{self.root}/data").parquet(f"{self.root}/data/*")
        return data.join(marks, "batch", "left_semi").select(*schema.fieldNames())
