"""Running a stream over what is there now, and reading what came out."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from rillframe.plans.scratch import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that arbitrary state with timers asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_to_end(df: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None, idle_batches: bool = True) -> tuple[StreamingQuery, str, str]:
    """Runs a stream until its input is used up; every batch is appended to a Parquet folder with
    the number of the batch. Returns the finished query, the folder and the checkpoint.

    State with a time to live asks for batches without rows for as long as a query lives; turn
    ``idle_batches`` off for it, or the run has no end."""
    spark = df.sparkSession
    use_rocksdb(spark)
    out, checkpoint = out or fresh_path(spark, "stream"), checkpoint or fresh_path(spark, "checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(idle_batches).lower())
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query, out, checkpoint


def run_live(df: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> tuple[StreamingQuery, str, str]:
    """As :func:`run_to_end`, batch after batch as a stream runs on: until nothing is left to do, then
    it is stopped. For sources of one's own, which a run over what is there now gives one batch only."""
    spark = df.sparkSession
    use_rocksdb(spark)
    out, checkpoint = out or fresh_path(spark, "stream"), checkpoint or fresh_path(spark, "checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query, out, checkpoint


def run_in_parts(parts: list[DataFrame], build: Callable[[DataFrame, int], DataFrame], mode: str = "append", pause: float = 0.0, **options) -> DataFrame:
    """Input that arrives in parts: each is added to a folder, over which a new run of the stream goes
    on from the checkpoint of the last. Returns all rows put out, with their ``batch``. ``build`` makes
    the stream of the part's number; ``pause`` is seconds between runs."""
    spark = parts[0].sparkSession
    source, paths = fresh_path(spark, "parts"), {}
    for k, part in enumerate(parts):
        if k:
            time.sleep(pause)
        part.write.mode("append").parquet(source)
        made = build(spark.readStream.schema(part.schema).parquet(source), k)
        _, paths["out"], paths["checkpoint"] = run_to_end(made, mode, **paths, **options)
    return spark.read.schema(StructType([*made.schema.fields, StructField("batch", IntegerType())])).parquet(paths["out"])


def drain(df: DataFrame, mode: str = "append", **options) -> DataFrame:
    """The rows that a stream puts out until its input is used up, with their ``batch``."""
    _, out, _ = run_to_end(df, mode, **options)
    schema = StructType([*df.schema.fields, StructField("batch", IntegerType())])
    return df.sparkSession.read.schema(schema).parquet(out)
