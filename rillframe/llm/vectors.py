"""What the operators on integer vectors share: rows that count, and means rounded down.

A component x becomes the integer floor(scale * x), at most ``LIMIT`` in size, so that squared
distances of up to 512 components and their differences stay exact in 64 bits; a component beyond
that counts as ``LIMIT`` of its sign. Sums over rows are decimals of 38 digits. Everything is whole
numbers, so results don't depend on partitions, their order or tasks that ran twice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest size of an integer component: (2 * 2^26)^2 * 512 is 2^63.
LIMIT = (1 << 26) - 1


def kept_vectors(df: DataFrame, id_column: str, vector: str, dims: int | None, **columns: str) -> DataFrame:
    """``id``, the vector as ``v`` and further columns of rows whose vector has ``dims`` components,
    none of them null, NaN or infinite."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), v.alias("v"), *(F.col(old).alias(new) for new, old in columns.items()))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(finite if dims is None else (F.size("v") == dims) & finite)


def integers(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """The integer vectors of a batch, a row each."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
    return np.clip(np.floor(values * scale), -LIMIT, LIMIT).astype(np.int64)


def integer_row(vector: list[float], scale: int) -> np.ndarray:
    return integers(pa.array([vector], pa.list_(pa.float64())), len(vector), scale)[0]


def floor_means(rows: DataFrame, dims: int, scale: int, cells: int, assign: Callable[[np.ndarray], np.ndarray]) -> list[int | None]:
    """Sums by cell of all vectors, as floor(sum / count) for each cell, None for unused ones.

    ``assign`` gives for the integer vectors of a batch the cell of each component, of ``cells`` in
    all. A task adds up what it reads and puts out one row for each cell that it has used, Spark
    adds these up, and the driver gets ``cells`` rows at most, however many vectors there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = integers(batch.column("v").slice(at, 4096), dims, scale)
                cell = assign(x)
                np.add.at(sums, cell.ravel(), x.ravel())
                counts += np.bincount(cell.ravel(), minlength=cells)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used]), pa.array(counts[used])], ["cell", "total", "n"])

    found = rows.select("v").mapInArrow(run, "cell bigint, total bigint, n bigint")
    out: list[int | None] = [None] * cells
    for r in found.groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r.cell] = int(r.total) // r.n
    return out


def digest(values: np.ndarray) -> str:
    """sha256 of the decimal integers, joined by commas."""
    return hashlib.sha256(",".join(map(str, values.ravel().tolist())).encode()).hexdigest()
