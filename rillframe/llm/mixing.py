"""Mixing sources to target weights, with DataFrame operations alone.

1. **Targets.** Sources in code-point order, null last, carry the weights in turn. They share
   ``ratio`` times all words by weight; none gets more than ``cap`` times what it has, and the
   excess is shared again until none is above. In order of (cap / weight) the capped sources come
   first, so two running sums give the end of that sharing at once.
2. **Blocks.** Each source's documents, in a pseudorandom order, form one stream of words that is
   cut into blocks of ``block`` words. Positions in the stream are prefix sums in two levels, over
   hash buckets and inside each, so a source with a third of all rows is never one task's.
3. **Counts per shard.** Each source's slots, as many blocks as its target asks for, fall on the
   output shards independently: its counts by shard are a multinomial draw whose total is the
   target, so the draw costs the mix no accuracy.
4. **Slots to blocks.** A source's slots are numbered through the shards; a permutation of block
   numbers for each pass over the source (a multiplier prime to their count, and an offset, both
   by hash) gives the block, and slots and blocks are joined by that number.

All draws are hashes of ids, so a rerun gives the same mix. Null and empty texts have no words and
are never taken; a null source is a source; repeated rows are rows of their own; an empty table
gives an empty mix; columns other than id, text and source aren't looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillframe.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Primes above any number of blocks that the 64-bit product of the permutation can hold.
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)
_WIDE = 1 << 31


#: Rows of a bucket, about, where a table has more than this for each of ``BUCKETS``; slots that a task numbers.
BUCKET_ROWS, BUCKETS, TASK_SLOTS = 100_000, 1024, 1 << 18


def word_sizes(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, row: str | None = None) -> DataFrame:
    """id, source, number of words, the row's place in the pseudorandom order, and ``row``: the
    column that tells rows apart where there is one, else a number given here."""
    size = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")
    order = F.xxhash64(F.lit(seed), F.col(id_column).cast("string"))
    return df.select(F.col(id_column).alias("id"), F.col(source).alias("source"), size.alias("size"), order.alias("place"), F.monotonically_increasing_id().alias("row") if row is None else F.col(row).alias("row"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its number ``s``, ``source_size`` and ``target``. The table has a row
    for each source, so its windows see as many rows as there are sources."""
    whole = Window.partitionBy()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("s", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("bigint"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("total", ratio * F.sum("source_size").over(whole)).withColumn("all_weight", F.sum("weight").over(whole))
    upto = Window.orderBy(F.col("most") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0))
    per = per.withColumn("level", (F.col("total") - before("most")) / (F.col("all_weight") - before("weight")))
    per = per.withColumn("capped", F.col("most") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return per.select("source", "s", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def pieces(sizes: DataFrame, plan: DataFrame, block: int = 64) -> DataFrame:
    """Which words of which document lie in which block: row, s, block, ``start`` within the
    document and ``n`` words. Buckets are as many as keep them small."""
    sizes = sizes.withColumn("bucket", F.pmod("place", F.lit(max(BUCKETS, sizes.count() // BUCKET_ROWS))))
    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    base = (F.sum("sum").over(Window.partitionBy("source").orderBy("bucket")) - F.col("sum")).alias("base")
    sums = sums.select(F.col("source").alias("from_source"), F.col("bucket").alias("from_bucket"), base)
    numbers = plan.select(F.col("source").alias("of_source"), "s")
    sums = sums.join(numbers, F.col("from_source").eqNullSafe(F.col("of_source"))).drop("of_source")
    rows = sizes.where("size > 0").join(sums, F.col("source").eqNullSafe(F.col("from_source")) & (F.col("bucket") == F.col("from_bucket")))
    inside = Window.partitionBy("s", "bucket").orderBy("place", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("row", "s", "size", (F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("at"))
    cut = rows.select("row", "s", "size", "at", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block"))
    start = F.greatest(F.col("block") * block - F.col("at"), F.lit(0))
    end = F.least((F.col("block") + 1) * block - F.col("at"), F.col("size"))
    return cut.select("row", "s", "block", start.alias("start"), (end - start).alias("n"))


def slots(plan: DataFrame, block: int = 64, slots_per_shard: int = 16_384, seed: int = 7) -> DataFrame:
    """shard, s, slot (the source's own numbering), ``pass`` and block, for every slot of the mix."""
    whole = Window.partitionBy()
    per = plan.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    per = per.withColumn("passes", F.floor(F.col("target") / F.col("source_size")))
    per = per.withColumn("full", F.greatest(F.floor(F.col("source_size") / block), F.lit(1)))
    rest = F.round((F.col("target") - F.col("passes") * F.col("source_size")) / F.least(F.lit(block), F.col("source_size"))).cast("bigint")
    per = per.withColumn("slots", F.col("passes") * F.col("blocks") + F.least(rest, F.col("full"))).where("slots > 0")
    per = per.withColumn("shards", F.ceil(F.sum("slots").over(whole) / slots_per_shard)).select("s", "blocks", "full", "passes", "slots", "shards")

    # A source's slots are drawn in chunks, each a row, which are dealt to tasks whose number is fixed
    # here: by the size of these few rows Spark would put them into one.
    chunk, tasks = slots_per_shard, (per.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]) // TASK_SLOTS + 1
    chunks = per.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {chunk}"))).alias("chunk")).repartition(tasks, "s", "chunk")
    draws = chunks.select("s", "blocks", "full", "passes", "shards", F.explode(F.sequence(F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.col("slots")) - 1)).alias("draw"))
    counts = draws.groupBy("s", "blocks", "full", "passes", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "s", "draw"), F.col("shards")).alias("shard")).agg(F.count("*").alias("n"))
    first = F.sum("n").over(Window.partitionBy("s").orderBy("shard")) - F.col("n")
    drawn = counts.select("s", "blocks", "full", "passes", "shard", "n", first.alias("first")).repartition(tasks, "s", "shard")
    numbered = drawn.select("s", "blocks", "full", "passes", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    # A pass that takes a part of the source is over its full blocks alone, so that it takes its due.
    numbered = numbered.select("shard", "s", "slot", F.expr("least(slot div blocks, passes)").alias("pass"), "blocks", "full", "passes")
    numbered = numbered.select("shard", "s", "slot", "pass", (F.col("slot") - F.col("pass") * F.col("blocks")).alias("index"), F.when(F.col("pass") < F.col("passes"), F.col("blocks")).otherwise(F.col("full")).alias("blocks"))
    pick = (F.pmod(F.xxhash64(F.lit(seed), F.lit("multiplier"), "s", "pass"), F.lit(len(_PRIMES))) + 1).cast("int")
    multiplier = F.element_at(F.array(*map(F.lit, _PRIMES)), pick)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), "s", "pass"), F.col("blocks"))
    narrow = F.pmod(multiplier, F.col("blocks")) * F.col("index") + offset
    wide = F.pmod(multiplier.cast("decimal(12,0)") * F.col("index").cast("decimal(20,0)") + offset.cast("decimal(20,0)"), F.col("blocks").cast("decimal(20,0)"))
    place = F.when(F.col("blocks") < _WIDE, F.pmod(narrow, F.col("blocks"))).otherwise(wide.cast("bigint"))
    return numbered.select("shard", "s", "slot", "pass", place.alias("block"))


class Mix:
    """A mix of ``df``: ``plan`` (targets by source), ``sizes`` (words by row) and ``placed``
    (the document pieces that each slot of each shard takes)."""

    def __init__(self, df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights=(5, 2, 1), ratio: float = 1.5, cap: float = 2.0, block: int = 64, seed: int = 7, row: str | None = None):
        if ratio > cap:
            raise ValueError("the sources can't give more than the cap")
        scratch = Scratch(df.sparkSession)
        self.sizes = scratch.save(word_sizes(df, id_column, text, source, seed, row=row), "sizes")
        self.plan = scratch.save(targets(self.sizes, weights, ratio, cap).coalesce(1), "plan")
        self.pieces = pieces(self.sizes, self.plan, block)
        # Merged, never broadcast: what these joins read grows after the shuffle that Spark sizes it by.
        self.placed = slots(self.plan, block, seed=seed).hint("merge").join(self.pieces, ["s", "block"])

    def taken(self, id_column: str = "doc_id") -> DataFrame:
        """One row per row: its id, size, ``source_size``, ``target`` and the words ``taken``."""
        sums = self.placed.groupBy("row").agg(F.sum("n").alias("taken"))
        plan = self.plan.select(F.col("source").alias("of_source"), "source_size", "target")
        out = self.sizes.join(plan, F.col("source").eqNullSafe(F.col("of_source"))).join(sums.hint("merge"), "row", "left")
        return out.select(F.col("id").alias(id_column), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None, **options) -> DataFrame:
    """The mix as rows of ``df``: for each pass over a document from which words are taken a row
    with these words as its text, a blank between them, or the text itself where all are taken.
    ``row`` is a column that tells rows apart; without it ids must, and a row with a null id isn't taken."""
    row = row or id_column
    mix = Mix(df, id_column, text, source, row=row, **options)
    taken = mix.placed.groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("parts"), F.sum("n").alias("taken"))
    taken = taken.join(mix.sizes.select("row", "size"), "row").select(F.col("row").alias("of_row"), "parts", (F.col("taken") >= F.col("size")).alias("all"))
    rows = df.join(taken, F.col(row) == F.col("of_row"))
    tokens = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # The words are an array's one element, so that a row is split once and not for each of its parts.
    some = F.transform(F.array(tokens), lambda words: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, p["start"].cast("int") + 1, p["n"].cast("int")))), " "))[0]
    return rows.withColumn(text, F.when(F.col("all"), F.col(text)).otherwise(some)).select(*df.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: what the mix takes of every row of ``documents``."""
    return Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
