"""Token counts by a map-side lookup in two tiers, without a shuffle of pre-tokens.

First tier: a table of the corpus's frequent units with their numbers of tokens, at most
``TABLE_UNITS`` of them, broadcast to all workers. Second tier: a cache in each worker, filled by
encoding the units that the first tier misses, a batch at a time; it starts anew beyond
``CACHE_UNITS``. A unit is a word with the blank before it, or what several blanks in a row leave
between two cuts (see :mod:`rillframe.llm.pretoken`), whose tokens don't depend on its neighbours, so the counts are exact, not estimates; the tiers
only decide how fast they are found. To fill the first tier every batch of the corpus reports its
``REPORT_UNITS`` most frequent units and the sums of these reports rank them: the shuffle holds
these short reports alone.

Nulls count as empty texts, which have no bytes and no tokens. Rows are independent: repeated
rows, null ids and empty tables need no special care, and other columns aren't looked at.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm import pretoken
from rillframe.llm.common import map_batches, texts, worker_state

VOCABULARY = "byte_bpe_50k.json"
TABLE_UNITS = 32_768
REPORT_UNITS = 1_024
CACHE_UNITS = 300_000
#: Characters of the longest unit that either tier keeps.
LONGEST = 48


@functools.cache
def worker_tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(pretoken.vocabulary_path(vocabulary))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class TwoTierCounts:
    """Numbers of tokens of texts: units are looked up, what is missed is encoded and kept."""

    def __init__(self, vocabulary: str, frequent: dict[str, int]):
        self.tokenizer = worker_tokenizer(vocabulary)
        self.specials = pretoken.special_tokens(vocabulary)
        self.frequent = frequent
        self.known = dict(frequent)

    def _encoded(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def count_all(self, many: list[str]) -> list[int]:
        cut: list[tuple[int, list[str]]] = []
        out = [0] * len(many)
        for k, text in enumerate(many):
            for part in pretoken.segments(text, self.specials):
                if isinstance(part, int):
                    out[k] += 1
                elif part:
                    head, *units = pretoken.units(part)
                    out[k] += self._encoded([head])[0] if head else 0
                    cut.append((k, units))
        if len(self.known) > len(self.frequent) + CACHE_UNITS:
            self.known = dict(self.frequent)
        missed = list({u for _, units in cut for u in set(units).difference(self.known)})
        known = self.known
        found = dict(zip(missed, self._encoded([" " + u for u in missed]), strict=True))
        known.update((u, n) for u, n in found.items() if len(u) <= LONGEST)
        found = {u: n for u, n in found.items() if len(u) > LONGEST}
        for k, units in cut:
            out[k] += sum(map(known.__getitem__, units)) if not found else sum(known[u] if u in known else found[u] for u in units)
        return out


def frequent_units(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> dict[str, int]:
    """The first tier: the corpus's most frequent units and their numbers of tokens."""

    def report(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter[str] = Counter()
        for t in texts(batch):
            seen.update(t.split(" ")[1:])
        top = [(u, n) for u, n in seen.most_common(REPORT_UNITS) if len(u) <= LONGEST]
        return pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["unit", "n"])

    reports = map_batches(df.select(F.col(text).cast("string").alias("text")), report, "unit string, n bigint")
    ranked = reports.groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit").limit(TABLE_UNITS)
    units = [row["unit"] for row in ranked.select("unit").toLocalIterator()]
    encoded = worker_tokenizer(vocabulary).encode_batch([" " + u for u in units], add_special_tokens=False)
    specials = pretoken.special_tokens(vocabulary)
    return {u: len(e.ids) for u, e in zip(units, encoded, strict=True) if not any(s in u for s in specials)}


def count_tokens(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = 512) -> DataFrame:
    """One row per row: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``."""
    table = df.sparkSession.sparkContext.broadcast(frequent_units(df, text, vocabulary))
    key = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = worker_state("token counts", key, lambda: TwoTierCounts(vocabulary, table.value))
        many = texts(batch)
        tokens = counts.count_all(many)
        columns = [batch.column(0), pa.array([len(t.encode()) for t in many], pa.int64()), pa.array(tokens, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens"])

    chosen = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    out = map_batches(chosen, run, f"id {chosen.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint", 256)
    return out.withColumnRenamed("id", id_column).withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: token counts of every row of ``documents``."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
