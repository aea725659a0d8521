"""Vector codes by codebooks that are learnt in whole numbers, entries found by a GNAT.

Vectors are cut into equal parts, and each part position has a codebook of entries, improved in
rounds: every part goes to its nearest entry, and every entry that was used becomes the mean of its
parts, rounded down. The nearest entry is found through a geometric near-neighbour access tree over
the codebook: a node has a few split points; the other entries belong to the subtree of their
nearest split point, and the node stores, for each split point and each subtree, the least and the
most distance between them. A query's distances to the split points then bound its distance to
anything in a subtree from below (by the triangle inequality), and a subtree goes only when some
bound is strictly beyond the best distance so far. Squared distances are whole numbers and exact;
only the bounds have roots, which are taken with a margin that errs towards looking. An entry at
the same distance is never cut off, so that ties fall to the lower index by comparison of whole
numbers.

The trees are built by the driver from the codebooks, whose size is a parameter. Vectors are read
once in each round; tasks add up their parts and the driver gets a row for each entry component.

Rows whose vector is null, empty or holds null or non-finite components are left out. The vectors'
length is the one most rows have among multiples of the number of parts (the greater one if two
are as frequent); rows of another length can't be cut into these parts and are left out as well.
The first codebook is made of the smallest ids; null ids come behind all others and rows of equal
id in the order of their vectors. With fewer rows than entries a codebook has as many entries as
rows. Repeated rows count as often as they come. An empty table, or one in which no row counts,
gives an empty result; columns other than id, vector and label aren't looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Scratch, map_batches, over_groups
from rillframe.llm.vectors import digest, floor_means, integer_row, integers, kept_vectors

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Split points of a node.
DEGREE = 4
#: Relative margin of bounds: many times what rounding of roots and differences can come to.
MARGIN = 1e-9


@dataclass
class Node:
    """Split points, and for each the subtree of entries that it is nearest to."""

    splits: list[int]
    children: list[Node | None] = field(default_factory=list)
    least: np.ndarray | None = None  # [split, subtree]: distances from the split point to the subtree's entries
    most: np.ndarray | None = None


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between the rows of a and b."""
    d = a[:, None, :] - b[None, :, :]
    return np.einsum("ijk,ijk->ij", d, d)


def build(entries: np.ndarray, members: list[int] | None = None, degree: int = DEGREE) -> Node:
    """The tree over the entries; split points are chosen far from each other."""
    members = list(range(len(entries))) if members is None else members
    between = squared(entries[members], entries[members])
    chosen = [0]
    while len(chosen) < min(degree, len(members)):
        gap = between[chosen].min(0)
        gap[chosen] = -1
        chosen.append(int(gap.argmax()))
    node = Node([members[k] for k in chosen])
    rest = [k for k in range(len(members)) if k not in chosen]
    if not rest:
        return node
    nearest = between[chosen].argmin(0)
    node.least, node.most = np.full((len(chosen), len(chosen)), np.inf), np.full((len(chosen), len(chosen)), -np.inf)
    for j in range(len(chosen)):
        own = [k for k in rest if nearest[k] == j]
        node.children.append(build(entries, [members[k] for k in own], degree) if own else None)
        if own:
            far = np.sqrt(between[np.ix_(chosen, own)].astype(float))
            node.least[:, j], node.most[:, j] = far.min(1), far.max(1)
    return node


def _better(distance: np.ndarray, index: int, best: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Takes an entry for those of ``rows`` to which it is nearer, or as near with a lower index."""
    wins = (distance < best[rows]) | ((distance == best[rows]) & (index < at[rows]))
    best[rows[wins]], at[rows[wins]] = distance[wins], index


def _visit(node: Node, x: np.ndarray, entries: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray, looked: np.ndarray) -> None:
    found = squared(x[rows], entries[node.splits])
    looked[rows] += len(node.splits)
    for k, index in enumerate(node.splits):
        _better(found[:, k], index, best, at, rows)
    if not node.children:
        return
    far = np.sqrt(found.astype(float))
    order = np.argsort(found, axis=1, kind="stable")
    for place in range(len(node.splits)):  # nearest subtrees first: they make the best distance small
        for j, child in enumerate(node.children):
            if child is None:
                continue
            mine = np.flatnonzero(order[:, place] == j)
            if not len(mine):
                continue
            d = far[mine]
            low = np.maximum(d - node.most[:, j], node.least[:, j] - d).max(1)
            margin = MARGIN * (d.max(1) + node.most[:, j].max()) + MARGIN
            out = low - margin > np.sqrt(best[rows[mine]].astype(float))
            if not out.all():
                _visit(child, x, entries, rows[mine[~out]], best, at, looked)


def nearest(tree: Node, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``x`` the index of the nearest entry (ties: the lower index), its squared
    distance, and how many entries were compared in full."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries))
    looked = np.zeros(len(x), np.int64)
    if len(x):
        _visit(tree, x, entries, np.arange(len(x)), best, at, looked)
    return at, best, looked


def _cells(books: np.ndarray):
    """Numbers the component of an entry that each component of a vector belongs to."""
    parts, entries, width = books.shape
    trees = [build(b) for b in books]

    def assign(x: np.ndarray) -> np.ndarray:
        cut = x.reshape(len(x), parts, width)
        at = np.stack([nearest(trees[p], books[p], cut[:, p])[0] for p in range(parts)], 1)
        return (((np.arange(parts) * entries + at) * width)[:, :, None] + np.arange(width)).reshape(x.shape)

    return assign


def common_length(df: DataFrame, vector: str, parts: int) -> int:
    """The length, a multiple of ``parts``, that most vectors that count have; 0 if none has one."""
    rows = kept_vectors(df.select(F.lit(0).alias("id"), F.col(vector).alias("v")), "id", "v", None)
    sizes = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("n")).count()
    top = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 0


def train(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """The codebooks [part, entry, component] of rows with ``id`` and ``v``."""
    first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    books = np.stack([integer_row(r.v, scale) for r in first]).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        means = floor_means(rows, dims, scale, books.size, _cells(books))
        books = np.array([old if new is None else new for old, new in zip(books.ravel().tolist(), means, strict=True)], np.int64).reshape(books.shape)
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``id``, ``label``, ``code`` (an index of two hex digits for each part) and ``error`` (the
    squared distances to the entries) of rows with ``id``, ``label`` and ``v``."""
    parts, _, width = books.shape
    trees = [build(b) for b in books]
    schema = f"id bigint, label {rows.schema['label'].dataType.simpleString()}, code string, error bigint"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = integers(batch.column("v"), parts * width, scale).reshape(batch.num_rows, parts, width)
        at, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
        for p in range(parts):
            at[:, p], d, _ = nearest(trees[p], books[p], x[:, p])
            error += d
        code = pa.array([row.tobytes().hex() for row in at], pa.string())
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), code, pa.array(error)], ["id", "label", "code", "error"])

    return map_batches(rows.select("id", "label", "v"), run, schema, 4096)


def compress(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """A row for each row that counts: id, ``code``, ``error``, ``label_error`` (errors summed over
    equal labels, nulls together) and ``codebooks_sha256`` of the codebooks' integers. At most 256
    entries a part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    dims = common_length(df, vector, parts)
    rows = kept_vectors(df, id_column, vector, dims, label=label)
    if not dims:
        empty = rows.select(F.col("id").alias(id_column), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return empty.where("false")
    books = train(rows, dims, parts, entries, rounds, scale)
    codes = Scratch(df.sparkSession).save(encode(rows, books, scale), "codes")
    out = over_groups(codes, "label", label_error=F.sum("error"))
    return out.select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: codes of every row of ``embeddings`` that counts."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """The contract's rounds as SQL over one row for each component."""
    floor = "(s - ((s % n) + n) % n) // n"
    sql = [
        f"""WITH v AS (SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(embedding) % {PARTS} = 0 AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // (d // {PARTS}) AS p, (i - 1) % (d // {PARTS}) AS k, CAST(floor({SCALE} * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT vec_id, e, len(e) AS d, unnest(range(1, len(e) + 1)) AS i FROM v)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS j FROM v QUALIFY j < {ENTRIES}),
b0 AS MATERIALIZED (SELECT p, j, k, x AS b FROM x JOIN f USING (vec_id))"""
    ]
    assigned = "SELECT vec_id, p, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT vec_id, p, j, sum((x - b) * (x - b)) AS d FROM x JOIN b{0} USING (p, k) GROUP BY ALL) GROUP BY ALL"
    for r in range(ROUNDS + 1):
        sql.append(f"a{r} AS MATERIALIZED ({assigned.format(r)})")
        if r < ROUNDS:
            sql.append(f"m{r} AS (SELECT p, j, k, {floor} AS b FROM (SELECT p, j, k, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{r} USING (vec_id, p) GROUP BY ALL))")
            sql.append(f"b{r + 1} AS MATERIALIZED (SELECT p, j, k, coalesce(m.b, o.b) AS b FROM b{r} o LEFT JOIN m{r} m USING (p, j, k))")
    sql.append(f"c AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)")
    return ",\n".join(sql) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(b AS VARCHAR), ',' ORDER BY p, j, k)) FROM b{ROUNDS}) AS codebooks_sha256 FROM c JOIN v USING (vec_id)"""


ORACLE = _oracle()
