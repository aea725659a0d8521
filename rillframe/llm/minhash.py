"""Near-duplicate documents by MinHash with tensored banding.

A table's key needs the agreement of ``2 * half`` minhashes. Instead of drawing these anew for
each of ``side * side`` tables, two collections of ``side`` half keys are computed, each from
``half`` minhashes, and every pair of one from each makes a table's key: ``2 * side * half``
minhashes serve ``side * side`` tables. Two documents of similarity s meet in some table unless
all half keys of one collection differ, so with 12 half keys of 4 minhashes the chance to miss a
pair is 0.0037 at 0.8 and 0.0003 at 0.85, and less above.

Documents of the same set are one class from the start, linked without comparison. Half keys that
only one class has can't make a candidate and go first. Classes that share keys are gathered in
blocks of a bounded number of sets and shingles, all full sets of which are compared with each
other by products of membership matrices. Groups larger than a block are joined up by a few
representatives of each block, which meet those of other blocks twice. Only components matter, so
what is left are keys whose classes are not yet in one, and classes that have such a key. These open
classes alone are dealt to blocks anew, by the component that they are in so far, small components
together; blocks that share a key are compared in full unless both are of one component, and a
comparison puts out links between different components only. So no pair of a large group is ever a
row, no pair is compared for each table anew, a few documents that share keys with a large group
meet its blocks but don't make these meet each other, and no candidate is dropped.

Words are cut at blanks and the controls 9 to 13 after lower-casing A-Z. Null and empty texts,
and texts without words, have an empty set and are linked with nothing; texts of fewer words than
a shingle have their whole sequence as the one member of their set. Shingles are compared by
64-bit hashes. Ids are integers; rows with the same id are one document, linked with whatever any
of its texts is linked with, and each has the number of shingles of its own text. A row with a null
id is a document of its own, which links others too: it takes the smallest id that links reach, or
null where they reach none. An empty table gives an empty result, and columns other than id and text
aren't looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Scratch, bounded_broadcast, coded_words, map_batches, over_groups, word_hashes
from rillframe.llm.components import components

SIDE, HALF = 12, 4
#: Shingles and sets of a block, about; representatives of a block, and blocks that send them to one place.
BLOCK, SETS, CHOSEN, MEETING = 100_000, 512, 16, 32
_SEED = 20_240_501


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``width`` words of a text with these word hashes."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = max(1, len(h) - width + 1)
    used = min(width, len(h))
    out = np.full(n, used, np.uint64)  # shorter sequences can't equal shingles
    for k in range(used):
        out = _mixed(out + h[k : k + n])
    return np.unique(out)


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    """The set of shingles of each text of a column."""
    sizes, codes, distinct = coded_words(column)
    h = word_hashes(distinct).view(np.uint64).take(codes)
    ends = np.cumsum(sizes)
    return [shingles(h[end - n : end], width) for end, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _multipliers(side: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(_SEED)
    return draw.integers(1, 1 << 63, 2 * side * half, dtype=np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, 2 * side * half, dtype=np.uint64)


def half_keys(sets: list[np.ndarray], side: int, half: int) -> np.ndarray:
    """The half keys of non-empty sets: the first ``side`` columns are one collection, the others
    the other."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    pool = np.concatenate(sets)
    factors, terms = _multipliers(side, half)
    keys = np.zeros((len(sets), 2 * side), np.uint64)
    for k, (a, b) in enumerate(zip(factors, terms, strict=True)):
        hashed = pool * a + b
        least = np.minimum.reduceat(hashed ^ (hashed >> np.uint64(32)), starts)
        keys[:, k // half] = _mixed(keys[:, k // half] * np.uint64(3) + least + np.uint64(k))
    return keys.view(np.int64)


def _digest(packed: bytes) -> bytes:
    return hashlib.blake2b(packed, digest_size=16).digest()


def signatures(df: DataFrame, id_column: str, text: str, width: int, side: int = SIDE, half: int = HALF) -> DataFrame:
    """id, number of shingles, class (a digest of the set, null if empty) and half keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = sets_of(batch.column("text"), width)
        full = [k for k, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        if full:
            for k, row in zip(full, half_keys([sets[k] for k in full], side, half), strict=True):
                keys[k] = row
        columns = [
            batch.column(0),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array(keys, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "n", "class", "keys"])

    rows = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, "id bigint, n bigint, class binary, keys array<bigint>", 256)


def full_sets(df: DataFrame, width: int) -> DataFrame:
    """The class and the whole set, as sorted packed hashes, of texts that have one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [s.tobytes() for s in sets_of(batch.column("text"), width) if len(s)]
        return pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["class", "set"])

    return map_batches(df.select("text"), run, "class binary, set binary", 256)


def linked_roots(sets: list[np.ndarray], parts: int, whole: int) -> np.ndarray:
    """For each set the first one that links between these sets reach."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    pool = np.concatenate(sets)
    order = np.argsort(pool, kind="stable")
    pool, owner = pool[order], owner[order]
    first = np.append(True, pool[1:] != pool[:-1])
    number = np.cumsum(first) - 1
    shared = np.bincount(number)[number] > 1  # what one set alone has can't be in an intersection
    both = np.zeros((len(sets), len(sets)), np.float32)  # exact: whole numbers below 2 to the 24th
    column = np.cumsum(first & shared)[shared] - 1
    owner = owner[shared]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        here = slice(*np.searchsorted(column, [at, at + 4096]))
        member = np.zeros((len(sets), 4096), np.float32)
        member[owner[here], column[here] - at] = 1
        both += member @ member.T
    linked = whole * both.astype(np.int64) >= parts * (sizes[:, None] + sizes[None, :] - both.astype(np.int64))
    roots = np.arange(len(sets))
    while True:
        least = np.where(linked, roots[None, :], len(sets)).min(1)
        least = np.minimum(least, roots)[np.minimum(least, roots)]
        if (least == roots).all():
            return roots
        roots = least


def _compared(parts: int, whole: int):
    """Links in and between blocks, as a star for each group that they make. Nodes stand for the
    component in ``roots`` that they are known to be in; what is known isn't put out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        links: set[tuple[int, int]] = set()
        for nodes, packed in zip(batch.column("roots").to_pylist(), batch.column("sets").to_pylist(), strict=True):
            if len(nodes) > 1:
                found = linked_roots([np.frombuffer(x, np.uint64) for x in packed], parts, whole)
                links |= {(nodes[k], nodes[r]) for k, r in enumerate(found.tolist()) if nodes[k] != nodes[r]}
        a, b = zip(*sorted(links), strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if links else None

    return run


def _open_blocks(open_: DataFrame, known: DataFrame, blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """Open classes in blocks of their own: ``c``, ``root``, ``block`` and ``set``. A component of
    more than half a block has blocks to itself, smaller ones of a home are dealt out whole."""
    found = scratch.save(open_.select("c").distinct().join(known, "c"), "open-classes")
    found = over_groups(found, "root", root_n=F.count("*"), root_size=F.sum("n"), shared=F.min("home"))
    found = scratch.save(found.withColumn("large", (F.col("root_n") * 2 > SETS) | (F.col("root_size") * 2 > BLOCK)), "open-roots")
    large = found.where("large").withColumn("parts", F.ceil(F.greatest(F.col("root_size") / BLOCK, F.col("root_n") / SETS)))
    small = over_groups(scratch.save(found.where("NOT large"), "open-small"), "shared", home_n=F.count("*"), home_size=F.sum("n"))
    small = small.withColumn("parts", F.ceil(F.greatest(F.col("home_size") / BLOCK, F.col("home_n") / SETS)))
    own = large.select("c", "root", F.xxhash64(F.lit(1), "root", F.pmod(F.xxhash64("c"), "parts")).alias("block"))
    placed = own.unionByName(small.select("c", "root", F.xxhash64(F.lit(2), "shared", F.pmod(F.xxhash64("root"), "parts")).alias("block")))
    placed = scratch.save(placed, "open-placed")
    sets = blocks.select(F.explode(F.arrays_zip("roots", "sets")).alias("m")).select(F.col("m.roots").alias("c"), F.col("m.sets").alias("set"))
    return scratch.save(sets.join(bounded_broadcast(placed), "c"), "open-sets")


def _pairs(at: DataFrame) -> DataFrame:
    """Pairs of blocks, a block with itself among them, that meet at a key with different components;
    ``at`` has a row for each key, block and component.

    At a key a block counts once, with its component or as mixed, however many of its classes have the
    key. Most keys of a group hold the same blocks: keys that do are told by two 64-bit digests and
    their number, and one of them is taken. Of the blocks that are of one component, those of the most
    frequent one are paired with others alone, so that blocks of one component never meet."""
    at = at.groupBy("key", "block").agg(F.min("root").alias("least"), F.max("root").alias("most")).select("key", "block", F.when(F.col("least") == F.col("most"), F.col("least")).alias("root"))
    named = F.struct("block", "root")
    digest = at.groupBy("key").agg(F.bit_xor(F.xxhash64(named)).alias("x"), F.bit_xor(F.xxhash64(named, F.lit(7))).alias("y"), F.count("*").alias("n"))
    at = at.join(digest.groupBy("x", "y", "n").agg(F.min("key").alias("key")).select("key"), "key")
    often = at.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.when(F.col("root").isNotNull(), F.struct("n", "root"))).alias("often"))
    minor = at.join(often, "key").where("root IS NULL OR root <> often").select("key", F.col("block").alias("a"), F.col("root").alias("a_root"))
    met = minor.join(at, "key").where("root IS NULL OR a_root IS NULL OR root <> a_root")
    return met.select(F.least("a", "block").alias("block"), F.greatest("a", "block").alias("other")).distinct()


def near_groups(df: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5, parts: int = 80, whole: int = 100, side: int = SIDE, half: int = HALF) -> DataFrame:
    """One row per row: the id, ``n_shingles``, ``component_id`` (the smallest id that links
    reach) and ``kept`` (the row has that id). Documents are linked if ``whole`` times the size of
    their sets' intersection is at least ``parts`` times that of the union."""
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(signatures(df, id_column, text, width, side, half), "signatures")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = scratch.save(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    halves = classes.select("c", F.posexplode("keys").alias("place", "h"))
    shared = halves.groupBy("place", "h").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("place", "h")
    alive = halves.join(shared, ["place", "h"]).groupBy("c").agg(F.collect_list(F.struct("place", "h")).alias("alive"))
    first, second = F.filter("alive", lambda x: x["place"] < side), F.filter("alive", lambda x: x["place"] >= side)
    tables = F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: F.xxhash64(x["place"], x["h"], y["place"], y["h"]))))
    entries = alive.select("c", F.explode(tables).alias("key"))
    busy = entries.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key")
    # Merged, never broadcast: entries are many more rows than the shuffle that Spark sizes them by.
    entries = scratch.save(entries.hint("merge").join(busy, "key"), "entries")

    # Classes that share keys get one home, by two steps towards the least key around; a home's
    # classes are dealt to blocks of about the same size.
    homes = entries.groupBy("c").agg(F.min("key").alias("home"))
    nearer = entries.join(homes, "c").groupBy("key").agg(F.min("home").alias("home"))
    homes = entries.join(nearer, "key").groupBy("c").agg(F.min("home").alias("home")).join(classes.select("c", "class", "node", "n"), "c")
    full = homes.groupBy("home").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / SETS)).alias("blocks"))
    placed = homes.join(full, "home").select("c", "class", "node", "home", "blocks", F.xxhash64("home", F.pmod(F.xxhash64("c"), F.col("blocks"))).alias("block"))
    placed = scratch.save(placed, "placed")

    # A class's text is found again by its smallest id; texts without an id are looked at all.
    source = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    chosen = source.join(placed.select(F.col("node").alias("id")).distinct(), "id", "left_semi").unionByName(source.where("id IS NULL"))
    sets = scratch.save(full_sets(chosen, width).join(placed.select("class", "c"), "class").dropDuplicates(["c"]).select("c", "set"), "sets")
    of_blocks = placed.join(sets, "c").groupBy("home", "blocks", "block").agg(F.collect_list(F.struct("c", "set")).alias("m"))
    blocks = scratch.save(of_blocks.select("home", "blocks", "block", F.col("m.c").alias("roots"), F.col("m.set").alias("sets")), "blocks")
    scratch.drop("sets")

    compare = lambda df: map_batches(df.select("roots", "sets"), _compared(parts, whole), "a bigint, b bigint", 16)
    turns = F.explode(F.array(F.lit(0), F.lit(1))).alias("turn")
    sent = blocks.where("blocks > 1").select("home", "blocks", "block", F.slice("roots", 1, CHOSEN).alias("roots"), F.slice("sets", 1, CHOSEN).alias("sets"), turns)
    met = sent.groupBy("home", "turn", F.pmod(F.xxhash64("block", "turn"), F.ceil(F.col("blocks") / MEETING)).alias("place")).agg(F.flatten(F.collect_list("roots")).alias("roots"), F.flatten(F.collect_list("sets")).alias("sets"))
    near = scratch.save(compare(blocks).unionByName(compare(met)).unionByName(_same_ids(rows, classes)), "near")
    roots = scratch.save(components(near), "roots")

    known = placed.join(roots.withColumnRenamed("node", "of_node"), F.col("c") == F.col("of_node"), "left").select("c", "home", F.coalesce("root", "c").alias("root"))
    known = scratch.save(known.join(classes.select("c", "n"), "c"), "known")
    rooted = entries.join(known.select("c", "root"), "c")
    several = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    open_ = scratch.save(rooted.join(several, "key").select("key", "c"), "open")
    final = classes.select("class", "c", "node").join(roots.withColumnRenamed("node", "of_node"), F.col("c") == F.col("of_node"), "left").select("class", "c", "node", "root")
    if not open_.isEmpty():
        members = _open_blocks(open_, known, blocks, scratch)
        at = scratch.save(open_.join(members.select("c", "block", "root"), "c").select("key", "block", "root").distinct(), "meetings")
        pairs = scratch.save(_pairs(at), "pairs")
        gathered = members.groupBy("block").agg(F.collect_list(F.struct("root", "set")).alias("m"))
        gathered = scratch.save(gathered.select("block", F.col("m.root").alias("roots"), F.col("m.set").alias("sets")), "open-blocks")
        others = gathered.select(F.col("block").alias("other"), F.col("roots").alias("roots_b"), F.col("sets").alias("sets_b"))
        between = pairs.where("block <> other").join(gathered, "block").join(others, "other").select(F.concat("roots", "roots_b").alias("roots"), F.concat("sets", "sets_b").alias("sets"))
        alone = gathered.join(pairs.where("block = other").select("block"), "block", "left_semi")
        late = scratch.save(compare(between).unionByName(compare(alone)), "late")
        if not late.isEmpty():  # links between components; few, for most are found before
            moved = scratch.save(components(late).select(F.col("node").alias("old"), F.col("root").alias("new")), "moved")
            final = final.join(bounded_broadcast(moved), F.coalesce("root", "c") == F.col("old"), "left").select("class", "c", "node", F.coalesce("new", "root").alias("root"))

    linked = scratch.save(final.where("root IS NOT NULL"), "linked")
    linked = over_groups(linked, "root", least=F.min("node")).select("class", "least")
    of_class = classes.select("class", "node").join(linked, "class", "left").select("class", F.coalesce("least", "node").alias("least"))
    out = rows.select("id", "n", "class").join(of_class, "class", "left")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _same_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that repeat an id with different texts; mostly none."""
    of = rows.where("class IS NOT NULL AND id IS NOT NULL").select("id", "class", F.xxhash64("class").alias("h"))
    several = of.groupBy("id").agg(F.min("h").alias("least"), F.max("h").alias("most")).where("least <> most").select("id")
    linked = of.join(several, "id").join(classes.select("class", "c"), "class").select("id", "c").distinct()
    least = linked.groupBy("id").agg(F.min("c").alias("least"))
    return linked.join(least, "id").where("c <> least").select(F.col("c").alias("a"), F.col("least").alias("b"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: near-duplicate groups over every row of ``documents``, by the contract's shingles of
    three words and its threshold of 85 in 100."""
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, parts=85)
