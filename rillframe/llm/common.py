"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillframe.plans.scratch import Scratch

__all__ = ["Scratch", "bounded_broadcast", "coded_words", "held_out", "map_batches", "over_groups", "texts", "word_hashes", "words", "worker_state"]

_states: dict[str, dict] = {}


def worker_state(operator: str, key: str, build: Callable[[], object]):
    """What a Python worker keeps of one operator between batches and tasks. Workers live as long as
    their executor, so what they keep of another operator goes first."""
    if operator not in _states:
        _states.clear()
        gc.collect()
        _states[operator] = {}
    kept = _states[operator]
    if key not in kept:
        kept[key] = build()
    return kept[key]


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, rows: int = 1024) -> DataFrame:
    """Applies ``function`` to every Arrow batch, ``rows`` rows at a time at most, which bounds
    what a worker holds beside the batch it has been given."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = function(batch.slice(at, rows))
                if out is not None:
                    yield out

    return df.mapInArrow(each, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def held_out(id_column: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls into ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds == fold


#: Rows of a few numbers each that are broadcast at most: some tens of megabytes.
BROADCAST = 500_000


def bounded_broadcast(rows: DataFrame) -> DataFrame:
    """A saved table of a few numbers a row for a join: broadcast if it is counted to be small,
    merged if not."""
    return F.broadcast(rows) if rows.count() <= BROADCAST else rows.hint("merge")


def over_groups(rows: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """Adds aggregates over all rows of equal ``key``, nulls together; ``rows`` should be a saved
    table, which is read three times.

    Keys that hold more than a thousandth of all rows are fewer than a thousand: what belongs to them
    is broadcast, so that no hot key is shuffled. That of the others is joined by key.
    """
    totals = rows.groupBy(key).agg(*(a.alias(name) for name, a in aggregates.items()), F.count("*").alias("_rows"))
    in_all = totals.agg(F.sum("_rows").alias("n")).first()["n"] or 0
    of = totals.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    first = rows.join(F.broadcast(of.where(F.col("_rows") * 1000 > in_all)), same, "left")
    done = first.where("_rows IS NOT NULL").drop("_key", "_rows")
    rest = first.where("_rows IS NULL").select(*rows.columns)
    return done.unionByName(rest.join(of.where(F.col("_rows") * 1000 <= in_all), same).drop("_key", "_rows"))


def words(text: str) -> list[bytes]:
    """Lower-cases A-Z alone and splits at blanks and the controls 9 to 13, which is what bytes do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def coded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts of a column, cut as :func:`words` does: how many each text has, the
    number of each word, and the distinct words that these numbers stand for."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    kept = codes != coded.dictionary.index("").as_py()  # what stands before a leading or behind a trailing blank
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return np.diff(np.append(0, np.cumsum(kept))[offsets]), codes[kept], coded.dictionary


#: A random number for each byte at each of a word's first places.
_NUMBERS = np.random.default_rng(20_240_503).integers(0, 1 << 64, (64, 256), np.uint64)


def word_hashes(words: pa.Array) -> np.ndarray:
    """Signed 64-bit hashes: sums of the numbers of a word's bytes, and another hash for words
    that are longer than there are numbers."""
    words = words.cast(pa.string())
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    starts, lengths = ends[:-1] - ends[0], np.diff(ends)
    place = np.minimum(np.arange(len(data)) - np.repeat(starts, lengths), len(_NUMBERS) - 1)
    numbers = np.append(_NUMBERS.ravel().take(place * 256 + data), np.uint64(0))
    out = np.where(lengths > 0, np.add.reduceat(numbers, starts), np.uint64(0)) + lengths.astype(np.uint64)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    for k in np.flatnonzero(lengths > len(_NUMBERS)):
        out[k] = xxhash.xxh3_64_intdigest(words[k].as_py())
    return out.view(np.int64)
