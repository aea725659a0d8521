"""A corpus pipeline of five stages over ``documents``.

Each stage takes all rows that the stage before has kept and calls one operator of
``rillframe.llm``; between stages the rows are written as Parquet and read again. Each
stage that joins its decisions back first gives every row a number, so repeated rows, repeated ids
and null ids are rows of their own. Null texts count as empty, and
columns beyond those of ``documents`` pass through the filtering stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.llm import bpe, exact_dedup, minhash, mixing, toxicity
from rillframe.llm.common import Scratch, bounded_broadcast
from rillframe.operators.ranking import numbered

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


ROW = "pipeline_row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own: a file's place among the files and the row's in its file, which
    every reading finds again; rows that don't come from files are written out with a number first."""
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("pipeline_file"), F.col("_metadata.row_index").alias("pipeline_at"))
    except AnalysisException:
        return Scratch(docs.sparkSession).save(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    files = Scratch(docs.sparkSession).save(numbered(placed.select("pipeline_file").distinct(), "pipeline_file", name="pipeline_number"), "files")
    return placed.join(bounded_broadcast(files), "pipeline_file").withColumn(ROW, F.shiftleft("pipeline_number", 40) + F.col("pipeline_at")).select(*docs.columns, ROW)


def _only(docs: DataFrame, decided: DataFrame) -> DataFrame:
    return docs.join(decided.where("kept").select(ROW), ROW, "left_semi").drop(ROW)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the smallest id."""
    docs = _numbered(docs)
    return _only(docs, exact_dedup.sort_groups(docs, row=ROW))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest id stays: five words a shingle, similarity 0.8."""
    docs = _numbered(docs)
    near = minhash.near_groups(docs.withColumn("doc_id", F.col(ROW)), width=5, parts=80, whole=100)
    ids = near.select(F.col("doc_id").alias(ROW), "component_id").join(docs.select(ROW, "doc_id"), ROW)
    first = ids.groupBy("component_id").agg(F.min_by(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", ROW)).alias(ROW))
    return _only(docs, first.withColumn("kept", F.lit(True)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets; a document comes as often as it is taken from."""
    mixed = mixing.mixed_documents(_numbered(docs), row=ROW).drop(ROW)
    return mixed.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else mixed


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, and a digest of what they decode to."""
    coded = bpe.round_trip(docs)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL can express the classifier, the draws of the mix or the encoding; see tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
