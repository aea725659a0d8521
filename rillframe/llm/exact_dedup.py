"""Exact deduplication by a content sort.

Texts are equal when they are identical after blanks and the controls 9 to 13 have gone. Rows are
dealt out by range: Spark samples splitters over the first characters of the normalised text, its
digest and the row's id, keys of bounded size, so that the splitters the driver holds are small
however long the texts. The id in the key lets a large group of copies span many partitions.
Within a partition an external sort by these keys and then by the whole normalised text puts equal
texts side by side, the row to keep first, and each row is compared in full with its neighbour.
Groups inside a partition are then complete; the first and the last group of each partition, two at
most, may go on next door: one text of each is kept, these texts are compared in full, and what they
come to is joined back, by a broadcast up to ``EDGES`` such groups and by a merge join beyond.

Null texts count as empty; empty texts are equal to one another. Of equal texts the row with the
most code points in the original text stays, then the smallest id, a null id counting as the
smallest; rows that are equal in all of this are ties, of which one stays. Columns other than the
id and the text aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Scratch

#: Characters of the normalised text in the range key.
PREFIX = 24
#: Groups at partitions' ends up to which they are broadcast.
EDGES = 20_000


def normalised(column):
    """The text without blanks and the controls 9 to 13."""
    for character in " \t\n\x0b\x0c\r":
        column = F.replace(column, F.lit(character), F.lit(""))
    return column


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers runs of equal texts in one sorted partition; holds the rows of one run, without text."""
    part = TaskContext.get().partitionId()
    held: pa.Table | None = None  # the run that may go on
    last: pa.Scalar | None = None  # its text
    first: pa.Scalar | None = None  # the text of the partition's first run, until that is handed on
    runs = 0

    def closed(rows: pa.Table, starts: np.ndarray, at_end: bool) -> list[pa.RecordBatch]:
        nonlocal first, runs
        heads = np.flatnonzero(starts)
        run = np.cumsum(starts) - 1
        text: list[str | None] = [None] * len(heads)
        if at_end:
            text[-1] = last.as_py()
        if first is not None:
            text[0], first = first.as_py(), None
        edge = np.array([t is not None for t in text])
        kept = pa.array(text, pa.string()).take(pa.array(np.where(starts, run, -1), mask=~starts.astype(bool)))  # with the heads alone
        best = rows.take(pa.array(heads[run]))
        columns = [rows["id"], best["id"], best["n_chars"], pa.array(np.bincount(run)[run]), rows["sha"], pa.array(edge[run]), kept, pa.array(starts.astype(bool)), pa.array(np.full(len(run), part, np.int32)), pa.array(runs + run)]
        runs += len(heads)
        carried = [x for x in rows.column_names if x == "row"]
        return pa.Table.from_arrays([*columns, *(rows[x] for x in carried)], ["id", "keep", "keep_chars", "size", "sha", "edge", "text", "head", "part", "run", *carried]).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch.column("norm")
        starts = np.ones(batch.num_rows, bool)
        starts[1:] = ~pc.equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        if last is None:
            first = norm[0]
        else:
            starts[0] = last.as_py() != norm[0].as_py()
        names = [x for x in batch.schema.names if x != "norm"]
        rows = pa.Table.from_batches([batch.select(names)])
        if held is not None:
            rows = pa.concat_tables([held, rows])
            starts = np.concatenate([np.arange(held.num_rows) == 0, starts])
        last = norm[-1]
        cut = int(np.flatnonzero(starts)[-1])
        if cut:
            yield from closed(rows.slice(0, cut), starts[:cut], False)
        held = rows.slice(cut)
    if held is not None:
        yield from closed(held, np.arange(held.num_rows) == 0, True)


def sort_groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row: the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``, and the
    column ``row`` where one is named."""
    scratch = Scratch(df.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(id_column).alias("id"), F.length(body).alias("n_chars"), normalised(body).alias("norm"), *([F.col(row).alias("row")] if row else []))
    rows = rows.select("*", F.substring("norm", 1, PREFIX).alias("prefix"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    ordered = rows.repartitionByRange("prefix", "sha", "id").sortWithinPartitions("prefix", "sha", "norm", F.desc("n_chars"), F.asc_nulls_first("id"))
    kind = rows.schema["id"].dataType.simpleString()
    carried = ["row"] if row else []
    own = f", row {rows.schema['row'].dataType.simpleString()}" if row else ""
    found = ordered.select("id", "n_chars", "sha", "norm", *carried).mapInArrow(_runs, f"id {kind}, keep {kind}, keep_chars int, size bigint, sha string, edge boolean, text string, head boolean, part int, run bigint{own}")
    found = scratch.save(found, "runs")

    ends = found.where("edge AND head").select("part", "run", "sha", "text", "keep", "keep_chars", "size")
    order = F.struct(-F.col("keep_chars"), "keep", "part")
    groups = ends.groupBy("sha", "text").agg(F.min(order).alias("best"), F.sum("size").alias("all_size"))
    edges = ends.select("part", "run", "sha", "text").join(groups, ["sha", "text"]).select("part", "run", "all_size", F.col("best.keep").alias("all_keep"), F.col("best.part").alias("all_part"))
    edges = scratch.save(edges, "edges")
    edges = F.broadcast(edges) if edges.count() <= EDGES else edges.hint("merge")
    first = F.col("head") & (F.col("part") == F.col("all_part")) & F.col("keep").eqNullSafe(F.col("all_keep"))
    merged = found.where("edge").join(edges, ["part", "run"]).select("id", F.col("all_keep").alias("keep"), F.col("all_size").alias("size"), first.alias("kept"), "sha", *carried)
    whole = found.where("NOT edge").select("id", "keep", "size", F.col("head").alias("kept"), "sha", *carried)
    out = whole.unionByName(merged)
    return out.select(
        F.col("id").alias(id_column),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        "kept",
        F.col("sha").alias("text_sha256"),
        *([F.col("row").alias(row)] if row else []),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: groups of equal texts over every row of ``documents``."""
    return sort_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY n) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(n) AS text_sha256
FROM d WINDOW w AS (PARTITION BY n ORDER BY length(t) DESC, doc_id)
"""
