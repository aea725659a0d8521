"""Rules that change while a stream runs: versions with times of validity, looked up batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rillframe.operators.joins import join_rules
from rillframe.plans.scratch import fresh_path


def valid_intervals(versions: DataFrame, key: str, valid_from: str, published: str | None = None) -> DataFrame:
    """Versions with ``valid_to``, the time at which the next version of the key begins (null for the
    last). Of versions that begin at the same time the one with the largest ``published`` counts."""
    if published is not None:
        columns = [c for c in versions.columns if c not in (key, valid_from, published)]
        versions = versions.groupBy(key, valid_from).agg(F.max_by(F.struct(*columns), published).alias("_r")).select(key, valid_from, "_r.*")
    return versions.withColumn("valid_to", F.lead(valid_from).over(Window.partitionBy(key).orderBy(valid_from)))


def join_valid(rows: DataFrame, intervals: DataFrame, key: str, ts: str, valid_from: str, how: str = "left") -> DataFrame:
    """Rows with the version of their key that holds at their time; none before the first begins.

    The intervals of a key don't overlap, so a row meets one at most. Rules are broadcast within
    the bounds of :func:`join_rules`; more of them are joined by key."""
    r = intervals.withColumnsRenamed({key: "_rule_key", valid_from: "_valid_from", "valid_to": "_valid_to"})
    on = (F.col(key) == F.col("_rule_key")) & (F.col(ts) >= F.col("_valid_from")) & (F.col("_valid_to").isNull() | (F.col(ts) < F.col("_valid_to")))
    return join_rules(rows, r, on, how).drop("_rule_key", "_valid_from", "_valid_to")


class RuleBook:
    """A table of rule versions in shared storage, which grows while streams read it.

    ``publish`` appends versions; a later publication for the same key and time replaces the earlier.
    Streams look the book up anew for each batch, so a version counts from the first batch after its
    publication on, for all rows of its time, old or new; what was put out before stays as it was."""

    def __init__(self, spark: SparkSession, schema: str, key: str, valid_from: str, path: str | None = None):
        self.spark, self.key, self.valid_from = spark, key, valid_from
        self.schema = StructType.fromDDL(schema).add("_published", "long")
        self.path = path or fresh_path(spark, "rules")
        self.number = 0

    def publish(self, versions: DataFrame) -> None:
        if self.number == 0:
            self.number = self.spark.read.schema(self.schema).parquet(self.path).agg(F.max("_published")).first()[0] or 0 if self._there() else 0
        self.number += 1
        versions.select(*(c for c in self.schema.fieldNames() if c != "_published")).withColumn("_published", F.lit(self.number).cast("bigint")).write.mode("append").parquet(self.path)

    def _there(self) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def intervals(self, spark: SparkSession | None = None) -> DataFrame:
        """All versions that are published now, with the time until which each holds."""
        spark = spark or self.spark
        versions = spark.read.schema(self.schema).parquet(self.path) if self._there() else spark.createDataFrame([], self.schema)
        return valid_intervals(versions, self.key, self.valid_from, "_published")

    def look_up(self, rows: DataFrame, ts: str, how: str = "left") -> DataFrame:
        """Rows with the version that holds at their time, of those that are published now."""
        return join_valid(rows, self.intervals(rows.sparkSession), self.key, ts, self.valid_from, how)

    def stream(self, rows: DataFrame, ts: str, out: str, checkpoint: str, how: str = "left") -> StreamingQuery:
        """Runs a stream of rows over what is there now, each batch with the rules of its moment; a batch that
        comes again overwrites its own folder. Goes on from ``checkpoint``."""

        def write(batch: DataFrame, number: int) -> None:
            self.look_up(batch, ts, how).write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        return query
