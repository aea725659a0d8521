"""The given tables as DataFrames and as names for SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables in a folder, each read when first asked for.

    ``events.ts`` becomes a timestamp, which watermarks ask for; the session's zone is to be UTC,
    so that windows lie where they do for zoneless times.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df

    def stream(self, name: str, files_per_trigger: int | None = None) -> DataFrame:
        """The same table as a stream of files."""
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        reader = self.spark.readStream.schema(schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        # A pattern, for streams take no plain path of a single file.
        df = reader.parquet(f"{self.folder}/{name}.parque[t]")
        return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df

    def sql(self, text: str, **views: DataFrame) -> DataFrame:
        """Runs SQL over the tables it names, and over ``views``."""
        for name in NAMES:
            if re.search(rf"\b{name}\b", text, re.I) and name not in views:
                self[name].createOrReplaceTempView(name)
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)
