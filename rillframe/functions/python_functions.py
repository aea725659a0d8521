"""Functions in Python: by row, by batch, with setup, over groups, and as tables."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _add_one(x):
    return None if x is None else x + 1


add_one = F.udf(_add_one, LongType())


@F.pandas_udf(DoubleType())
def net_price(price: pd.Series, discount: pd.Series) -> pd.Series:
    return price * (1 - discount)


@F.pandas_udf(LongType())
def with_model(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """What stands before the loop is done once a task."""
    slope, offset = 3, 7
    for batch in batches:
        yield batch * slope + offset


@F.pandas_udf(DoubleType())
def mean_of(values: pd.Series) -> float:
    return float(values.mean())


class _SplitWords:
    def eval(self, text: str):
        for k, word in enumerate((text or "").split(" ")):
            yield word, k


SplitWords = F.udtf(_SplitWords, returnType=StructType([StructField("word", StringType()), StructField("place", IntegerType())]))


def _best_two(group: pd.DataFrame) -> pd.DataFrame:
    return group.sort_values(["s_acctbal", "s_suppkey"], ascending=[False, True]).head(2)


def top_two(suppliers: DataFrame, salts: int = 32) -> DataFrame:
    """A table aggregate: two rows for each nation. Parts of a nation's rows are aggregated first, so no
    frame has to hold a nation."""
    rows = suppliers.select("s_nationkey", "s_suppkey", "s_acctbal").withColumn("part", F.pmod(F.xxhash64("s_suppkey"), F.lit(salts)))
    parts = rows.groupBy("s_nationkey", "part").applyInPandas(_best_two, rows.schema)

    def last(group: pd.DataFrame) -> pd.DataFrame:
        best = _best_two(group)
        return best[["s_nationkey", "s_suppkey"]].assign(place=range(1, len(best) + 1))

    return parts.groupBy("s_nationkey").applyInPandas(last, "s_nationkey int, s_suppkey bigint, place int")


def scale_by_file(df: DataFrame, factor: int) -> DataFrame:
    """Ships a file with a number to all tasks, which read it where Spark has put it."""
    path = os.path.join(tempfile.mkdtemp(prefix="rillframe-"), f"factor-{factor}.txt")
    with open(path, "w", encoding="utf-8") as f:
        f.write(str(factor))
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(SparkFiles.get(name), encoding="utf-8") as f:
            number = int(f.read())
        for batch in batches:
            yield pd.DataFrame({"n_nationkey": batch["n_nationkey"], "scaled": batch["n_regionkey"].astype("int64") * number})

    return df.mapInPandas(scale, "n_nationkey int, scaled bigint")
