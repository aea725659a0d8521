"""Near-duplicate embeddings by lattice hashing.

Unit vectors are projected onto two random blocks of 8 dimensions for each of ``TABLES`` tables
and decoded to the nearest points of the E8 lattice; the two points and the label are a table's
cell. A vector also probes the neighbouring cells that lie nearest, ``PROBES`` for each block.
A pair of cosine 0.93 meets in a table with probability 0.41 (measured at 64 dimensions), so 12
tables miss one pair in 500; closer pairs are missed far less.

Dense groups cost no work per pair. Every vector is first compared with the leaders of its cells;
one whose angle to a leader is at most half the threshold's angle joins the leader's ball, and any
two vectors of a ball are within the threshold's angle of each other, hence linked. Where many small
balls share a cell, vectors that are near but not that near, they are put together in teams of
some hundred vectors; a large ball, and a small one without such neighbours, is a team of its own.
Teams whose members meet in a cell are then compared in blocks of some hundred vectors by matrix
products, which report link counts per vector and which balls are linked at all: each pair of teams
once, whatever the number of cells they share, so that pairs of vectors are never rows. No bucket or
partner count is capped. Rows of large balls meet what is known of their ball by salted keys, so
that a ball with a third of all rows is never one task's.

Disk stays in proportion to the table. Vectors are kept once, as they came, and made unit vectors by the
tasks; all else is rows of numbers. Cells that vectors probe are found anew from their blocks, some
tables at a time, and what is compared is sent in as many passes as keep a pass at about two copies of
the vectors; a pass leaves its result alone, since scratch tables let their shuffles go.

Vectors link only if their labels are equal and not null. Vectors that are null, empty, zero, or
hold null or non-finite components link with nothing, nor do vectors of different lengths.
Repeated rows are vectors of their own, also where they repeat an id; null ids never name a
component, so a component of null ids alone has a null one. An empty table gives an empty result;
columns other than id, vector and label aren't looked at.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from rillframe.llm.common import Scratch, map_batches
from rillframe.llm.components import components

TABLES, PROBES = 12, 2
#: Size of the projected unit sphere against the lattice, for 64 dimensions.
SCALE = 4.0
BLOCK = 192  # vectors that one side of a matrix product has, about
SMALL = 96  # vectors of a ball that can be in a team with others, at most
CROWD = 16  # small balls of a cell that make teams, at least
SALTS = 64  # ways in which the rows of a large ball are dealt out
AT_ONCE = 3  # tables whose probed cells are on disk together
PASS = 100_000  # vectors that are sent in a pass, at least
_SEED = 20_240_502


@functools.cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            found.append(v)
    found += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    error = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(error[odd]).argmax(1)
    near[odd, worst] += np.where(error[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 points: of the even points and those half a step beside, the nearer."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where(((x - a) ** 2).sum(1, keepdims=True) <= ((x - b) ** 2).sum(1, keepdims=True), a, b)


@functools.cache
def projections(dim: int, tables: int) -> np.ndarray:
    """tables x 2 x dim x 8, with orthonormal columns where the dimension allows it."""
    draw = np.random.default_rng(_SEED + dim)
    out = draw.standard_normal((tables, 2, dim, 8))
    for t, b in itertools.product(range(tables), range(2)):
        out[t, b] = np.linalg.qr(out[t, b])[0] if dim >= 8 else out[t, b] / np.sqrt(dim)
    return out * SCALE * np.sqrt(dim / 64)


def _cell(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    for column in np.rint(points * 2).astype(np.int64).T:
        h = (h ^ column.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return h


def cells(unit: np.ndarray, group: np.ndarray, tables: int = TABLES, probes: int = PROBES, first: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own cells (one a table) and the neighbouring cells that it probes, of the tables from
    ``first`` to before ``end``."""
    own, near = [], []
    around = shortest()
    for t, blocks in list(enumerate(projections(unit.shape[1], tables)))[first:end]:
        points, others = [], []
        for matrix in blocks:
            projected = unit @ matrix
            point = decode(projected)
            points.append(point)
            if not probes:
                continue
            order = np.argsort(-((projected - point) @ around.T), axis=1, kind="stable")[:, :probes]
            others.append([point + around[order[:, k]] for k in range(probes)])
        start = group.view(np.uint64) + np.uint64((t + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
        own.append(_cell(_cell(start, points[0]), points[1]))
        if probes:
            near += [_cell(_cell(start, p), points[1]) for p in others[0]] + [_cell(_cell(start, points[0]), p) for p in others[1]]
    return np.stack(own, 1).view(np.int64), np.stack(near, 1).view(np.int64) if near else np.empty((len(unit), 0), np.int64)


#: Turns the numbers of rows into numbers in no order, each into another one.
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _vectors(kind: type):
    """Rows under numbers in no order, so that the smallest of some is any of them, and the bytes of their
    vectors as numbers of ``kind``, null for those that link with nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for values in batch.column("v").to_pylist():
            raw = None
            if values and None not in values:
                x = np.array(values, kind)
                if np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
            out.append(raw)
        row = (batch.column("row").to_numpy().view(np.uint64) * _ODD).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(row), batch.column("id"), batch.column("g"), pa.array(out, pa.binary())], ["row", "id", "g", "raw"])

    return run


def _units(raw: list[bytes], kind: type) -> np.ndarray:
    """Unit vectors, a row each, of vectors of one length."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that the squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _cells_of(raw: list[bytes], group: np.ndarray, kind: type, **which: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of vectors the places of those that have it, and their own and probed cells."""
    lengths = np.array([len(x) for x in raw], np.int64)
    for size in np.unique(lengths):
        of = np.flatnonzero(lengths == size)
        # By the number of components times 8, whatever they are kept as.
        length = int(size) // np.dtype(kind).itemsize * 8
        yield of, *cells(_units([raw[k] for k in of], kind), group[of] ^ length, **which)


def _own(kind: type):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own: list = [None] * batch.num_rows
        for of, cells_, _ in _cells_of(batch.column("raw").to_pylist(), batch.column("g").to_numpy(), kind, probes=0):
            for k, x in zip(of, cells_, strict=True):
                own[k] = x
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own, pa.list_(pa.int64()))], ["row", "own"])

    return run


def _met(kind: type, first: int, probes: int):
    """The cells of each block's vectors, once for the block: those they are in, and with ``probes`` those
    that they probe as well."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = batch.column("raws").to_pylist()
        block = np.repeat(np.arange(len(raws)), [len(x) for x in raws])
        group, team = batch.column("g").to_numpy()[block], batch.column("team").to_numpy()
        keys, blocks = [], []
        for of, own, near in _cells_of([x for block_ in raws for x in block_], group, kind, probes=probes, first=first, end=first + AT_ONCE):
            both = np.concatenate([own, near], 1)
            keys.append(both.ravel())
            blocks.append(np.repeat(block[of], both.shape[1]))
        key, at = np.concatenate(keys), np.concatenate(blocks)
        order = np.lexsort([key, at])
        key, at = key[order], at[order]
        new = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(key[new]), pa.array(team[at[new]]), batch.column("large").take(pa.array(at[new]))], ["key", "team", "large"])

    return run


def _close(limit: float, kind: type):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = batch.column("raw_a").to_pylist(), batch.column("raw_b").to_pylist()
        lengths = np.array([len(x) for x in a], np.int64)
        fits = np.zeros(len(a), bool)
        for size in np.unique(lengths):
            of = np.flatnonzero(lengths == size)
            fits[of] = (_units([a[k] for k in of], kind) * _units([b[k] for k in of], kind)).sum(1) >= limit
        return batch.select(["row", "leader"]).filter(pa.array(fits))

    return run


def _first_reached(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row and column of a matrix of links the first row that links reach; the number of
    rows where there is none."""
    n = len(linked)
    rows = np.where(linked.any(1), np.arange(n), n)
    while True:
        columns = np.where(linked, rows[:, None], n).min(0)
        lower = np.minimum(rows, np.where(linked, columns[None, :], n).min(1))
        if (lower == rows).all():
            return rows, columns
        rows = lower


def _compared(threshold: float, kind: type):
    """Links between the vectors of two blocks, or within one if there is no other: how many each vector
    has with vectors of other balls, and links that join the same balls, a star for each group."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out: list[list] = [[], [], [], []]
        names = ("rows_a", "balls_a", "raws_a", "rows_b", "balls_b", "raws_b")
        for rows_a, balls_a, raws_a, rows_b, balls_b, raws_b in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            alone = rows_b is None
            if alone:
                rows_b, balls_b, raws_b = rows_a, balls_a, raws_a
            x = _units(raws_a, kind)
            y = x if alone else _units(raws_b, kind)
            p, q = np.array(balls_a), np.array(balls_b)
            linked = (x @ y.T >= threshold) & (p[:, None] != q[None, :])
            if alone:
                linked |= linked.T  # a product may round either way
            if linked.any():
                first, second = _first_reached(linked)
                joined = {(int(u), int(v)) for balls, reached in ((p, first), (q, second)) for u, v in zip(balls[reached < len(p)], p[reached[reached < len(p)]], strict=True) if u != v}
                a, b = zip(*sorted(joined), strict=True)
                counts = [linked.sum(1)] if alone else [linked.sum(1), linked.sum(0)]
                rows = [np.array(rows_a)] if alone else [np.array(rows_a), np.array(rows_b)]
                rows, counts = np.concatenate(rows), np.concatenate(counts)
                for held, new in zip(out, (a, b, rows[counts > 0], counts[counts > 0]), strict=True):
                    held.append(new)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64())) for x in out], ["a", "b", "rows", "counts"]) if out[0] else None

    return run


def _teams(balls: DataFrame, sizes: DataFrame, coded: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with ``team`` (of small balls of a crowded cell, or the ball itself), whether it is
    ``mixed`` or a ``large`` ball, and ``part``, the block that the row is in."""
    small = sizes.where(F.col("size") <= SMALL)
    at = coded.join(small.withColumnRenamed("ball", "row"), "row").select(F.col("row").alias("ball"), "size", F.explode("own").alias("key"))
    crowded = at.groupBy("key").agg(F.count("*").alias("crowd")).where(F.col("crowd") >= CROWD)
    homes = scratch.save(at.join(crowded, "key").groupBy("ball").agg(F.max_by("key", F.struct("crowd", "key")).alias("home"), F.first("size").alias("size")), "homes")
    full = homes.groupBy("home").agg(F.ceil(F.sum("size") / BLOCK).alias("n"))
    mixed = homes.join(full, "home").select("ball", F.xxhash64("home", F.pmod(F.xxhash64("ball"), "n")).alias("team"))
    tagged = scratch.save(_salted(balls, sizes.where(F.col("size") > SMALL), "left"), "tagged")
    few = tagged.where("size IS NULL").drop("size").join(mixed, "ball", "left").withColumn("mixed", F.col("team").isNotNull()).withColumn("team", F.coalesce("team", "ball"))
    # One key, or rows would stay dealt by ball.
    many = tagged.where("size IS NOT NULL").withColumn("part", F.xxhash64("ball", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK))))
    names = ("row", "ball", "team", "mixed", "large", "part")
    few = few.withColumns({"part": F.xxhash64("team"), "large": F.lit(False)}).select(*names)
    teams = scratch.save(few.unionByName(many.withColumns({"team": F.col("ball"), "mixed": F.lit(False), "large": F.lit(True)}).select(*names)), "teams")
    scratch.drop("homes")
    scratch.drop("tagged")
    return teams


def _salted(rows: DataFrame, balls: DataFrame, how: str) -> DataFrame:
    """Joins rows with what is known of their ball, where a row of ``balls`` is a large one: it is
    repeated for each salt, at most a third of it for every row of ``rows``."""
    spread = balls.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(SALTS))).join(spread, ["ball", "salt"], how).drop("salt")


def _passes(rows: DataFrame, name: str, vectors: int, whole: int, scratch: Scratch, of: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``run`` makes of ``rows``, in passes that each send about twice the ``whole`` vectors of the table."""
    n = max(1, math.ceil(vectors / max(PASS, 2 * whole)))
    parts = [scratch.save(run(rows.where(F.pmod(F.xxhash64(of, F.lit(2)), F.lit(n)) == k)), f"{name}-{k}") for k in range(n)]
    return functools.reduce(DataFrame.unionByName, parts)


def _pairs(blocks: DataFrame, kind: type, scratch: Scratch) -> DataFrame:
    """Teams of which a vector is in a cell that one of the other is in or probes, some tables at a time."""
    parts = []
    for first in range(0, TABLES, AT_ONCE):
        sides = []
        for probes in (0, PROBES):
            met = map_batches(blocks.select("team", "large", "g", "raws"), _met(kind, first, probes), "key bigint, team bigint, large boolean", 256)
            # A large ball's blocks meet the same cells; a team of another kind is one block.
            sides.append(met.where("NOT large").unionByName(met.where("large").distinct()).select("key", "team"))
        pairs = sides[0].join(sides[1].withColumnRenamed("team", "other"), "key").where("team <> other")
        parts.append(scratch.save(pairs.select(F.least("team", "other").alias("a"), F.greatest("team", "other").alias("b")).distinct(), f"pairs-{first}"))
    return scratch.save(functools.reduce(DataFrame.unionByName, parts).distinct(), "pairs")


def near_vectors(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per row: the id, ``n_links``, ``component_id`` and ``kept``."""
    scratch = Scratch(df.sparkSession)
    group = F.when(F.col(label).isNotNull(), F.xxhash64(F.col(label).cast("string")))
    kind = np.float32 if df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull) else np.float64
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("bigint").alias("id"), group.alias("g"), F.col(vector).cast(f"array<{'float' if kind is np.float32 else 'double'}>").alias("v"))
    vectors = scratch.save(map_batches(rows, _vectors(kind), "row bigint, id bigint, g bigint, raw binary"), "vectors")
    ids = scratch.save(vectors.select("row", "id"), "ids")
    valid = vectors.where("g IS NOT NULL AND raw IS NOT NULL").select("row", "g", "raw")
    coded = scratch.save(map_batches(valid, _own(kind), "row bigint, own array<bigint>"), "cells")
    whole = coded.count()

    own = coded.select("row", F.explode("own").alias("key"))
    leaders = own.groupBy("key").agg(F.min("row").alias("leader"), F.max("row").alias("most")).where("most <> leader")
    led = scratch.save(own.join(leaders.select("key", "leader"), "key").where("row <> leader").select("row", "leader").distinct(), "led")
    a, b = (valid.select(F.col("row").alias(k), F.col("raw").alias(r)) for k, r in (("row", "raw_a"), ("leader", "raw_b")))
    # Half the threshold's angle, with a margin far above rounding errors.
    half = float(np.cos(np.arccos(threshold) / 2)) + 1e-9
    close = lambda some: map_batches(some.join(a, "row").join(b, "leader").where("length(raw_a) = length(raw_b)").select("row", "leader", "raw_a", "raw_b"), _close(half, kind), "row bigint, leader bigint")
    near = _passes(led, "near", led.count(), whole, scratch, "row", close)
    chosen = near.groupBy("row").agg(F.min("leader").alias("leader"))
    balls = scratch.save(valid.select("row").join(chosen, "row", "left").select("row", F.coalesce("leader", "row").alias("ball")), "balls")
    sizes = scratch.save(balls.groupBy("ball").agg(F.count("*").alias("size")), "sizes")
    scratch.drop("led")
    teams = _teams(balls, sizes, coded, scratch)
    scratch.drop("cells")
    blocks = teams.join(valid, "row").groupBy("part").agg(*(F.first(c).alias(c) for c in ("team", "mixed", "large", "g")), F.collect_list(F.struct("row", "ball", "raw")).alias("m"))
    blocks = scratch.save(blocks.select("team", "mixed", "large", "g", F.col("m.row").alias("rows"), F.col("m.ball").alias("balls"), F.col("m.raw").alias("raws")), "blocks")
    scratch.drop("vectors")
    scratch.drop("teams")

    side = lambda of: blocks.select(F.col("team").alias(of), *(F.col(c).alias(f"{c}_{of}") for c in ("g", "rows", "balls", "raws")))
    columns = [f"{c}_{of}" for of in "ab" for c in ("rows", "balls", "raws")]
    compare = lambda df: map_batches(df, _compared(threshold, kind), "a array<bigint>, b array<bigint>, rows array<bigint>, counts array<bigint>", 64)
    pairs = _pairs(blocks, kind, scratch)
    # The vectors of a pair's one side are sent to the other.
    of = blocks.groupBy("team").agg(F.sum(F.size("rows")).alias("n"))
    sent = pairs.join(of.select(F.col("team").alias("a"), "n"), "a").agg(F.sum("n")).first()[0] or 0
    met = lambda some: compare(some.join(side("a"), "a").join(side("b"), "b").where("g_a = g_b AND length(raws_a[0]) = length(raws_b[0])").select(*columns))
    both = _passes(pairs, "linked", sent, whole, scratch, "b", met)
    alone = side("a").join(blocks.where("mixed").select(F.col("team").alias("a")), "a", "left_semi")
    alone = alone.select(*columns[:3], *(F.lit(None).cast(alone.schema[c.replace("_b", "_a")].dataType).alias(c) for c in columns[3:]))
    linked = both.unionByName(scratch.save(compare(alone), "alone"))

    counts = linked.select(F.explode(F.arrays_zip("rows", "counts")).alias("x")).groupBy(F.col("x.rows").alias("row")).agg(F.sum("x.counts").alias("more"))
    roots = components(linked.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b"))
    known = scratch.save(sizes.join(roots, F.col("ball") == F.col("node"), "left").select("ball", "size", "root"), "known")
    large, small = known.where(F.col("size") > BLOCK), known.where(F.col("size") <= BLOCK)
    of = _salted(balls.select("row", "ball"), large, "left").withColumn("large", F.col("size").isNotNull())
    placed = of.where("large").select("row", "ball", "size", "root").unionByName(of.where("NOT large").select("row", "ball").join(small, "ball").select("row", "ball", "size", "root"))
    placed = placed.join(counts, "row", "left").select("row", F.coalesce("root", "ball").alias("root"), (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    out = scratch.save(ids.join(placed, "row", "left"), "placed")
    smallest = out.where("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"))
    out = out.join(smallest, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: near-duplicate groups of every row of ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
