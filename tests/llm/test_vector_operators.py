"""Vector codes and centroids against brute force in plain Python integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from oracle import connect
from oracle import rows as plain

from rillframe.llm import gnat, threshold, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string, n string, cluster string, code string, error string, next string"


def whole(rows, dims):
    return [(i, [float(x) for x in v], label) for i, v, label in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]


def ints(v, scale):
    return [math.floor(Fraction(x) * scale) for x in v]


def far(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def rounds(points, first, times):
    held = [list(c) for c in first]
    for _ in range(times):
        at = [min(range(len(held)), key=lambda j: (far(p, held[j]), j)) for p in points]
        for j in range(len(held)):
            if own := [p for p, k in zip(points, at, strict=True) if k == j]:
                held[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    at = [min(range(len(held)), key=lambda j: (far(p, held[j]), j)) for p in points]
    return held, at, [far(p, held[j]) for p, j in zip(points, at, strict=True)]


def sha(numbers):
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def codes_by_force(rows, dims, parts=8, entries=16, times=6):
    kept = sorted(whole(rows, dims), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [ints(v, 4096) for _, v, _ in kept]
    width = dims // parts
    code, error, books = [""] * len(x), [0] * len(x), []
    for p in range(parts):
        cut = [v[p * width : (p + 1) * width] for v in x]
        held, at, d = rounds(cut, cut[:entries], times)
        books += [c for e in held for c in e]
        code = [c + f"{j:02x}" for c, j in zip(code, at, strict=True)]
        error = [e + y for e, y in zip(error, d, strict=True)]
    by = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] = by.get(label, 0) + e
    return sorted((str(i), c, e, by[label], sha(books)) for (i, _, label), c, e in zip(kept, code, error, strict=True))


def clusters_by_force(rows):
    kept = whole(rows, 64)
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    x = [ints(v, 1024) for _, v, _ in kept]
    held, at, d = rounds(x, [ints(v, 1024) for _, v, _ in order[:8]], 10)
    return sorted((str(i), j, e, sum(y for y, k in zip(d, at, strict=True) if k == j), sum(d), sha(held[j])) for (i, _, _), j, e in zip(kept, at, d, strict=True))


def table(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 7) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def vectors_with_odd_rows():
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(0, 0.2, 64).astype(np.float32).tolist(), None if k % 7 == 0 else k % 3) for k in range(90)]
    rows += [(200 + k, rows[3][1], 5) for k in range(25)]  # one vector many times
    rows += [rows[4], (rows[5][0], rows[6][1], 9), (None, rows[7][1], None), (None, rows[8][1], 1)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.5] * 63, 1), (303, [float("nan")] + [0.1] * 63, 1), (304, [float("inf")] + [0.1] * 63, 1), (305, [None] + [0.1] * 63, 1), (306, [0.0] * 64, 1), (307, [-0.0] * 64, 1), (308, [250.0, -250.0] * 32, 2)]
    return rows


def got(df, *names):
    return sorted((str(r[0]), *r[1:]) for r in df.select("vec_id", *names).collect())


def test_codes_match_brute_force(spark, vectors_with_odd_rows):
    rows = vectors_with_odd_rows
    for size in (len(rows), 5, 1):  # fewer rows than entries too
        found = gnat.compress(table(spark, rows[:size]))
        assert got(found, "code", "error", "label_error", "codebooks_sha256") == codes_by_force(rows[:size], 64)


def test_clusters_match_brute_force(spark, vectors_with_odd_rows):
    rows = vectors_with_odd_rows
    for size in (len(rows), 5, 1):
        found = threshold.cluster(table(spark, rows[:size]))
        assert got(found, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256") == clusters_by_force(rows[:size])


def test_partitions_change_nothing(spark, vectors_with_odd_rows):
    df = table(spark, vectors_with_odd_rows)
    for operator in (gnat.compress, threshold.cluster):
        assert sorted(map(str, operator(df.repartition(7)).collect())) == sorted(map(str, operator(df.coalesce(1)).collect()))


def test_no_vectors(spark):
    for rows in ([], [(1, None, 2)], [(1, [float("nan")] * 64, 2), (2, [], 1)], [(3, [1.0] * 9, 1)]):
        df = table(spark, rows)
        assert gnat.compress(df).collect() == [] and threshold.cluster(df).collect() == []
        assert gnat.compress(df).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_the_common_length_counts(spark):
    rows = [(k, [k / 10] * 16, 1) for k in range(6)] + [(k, [0.5] * 24, 1) for k in range(10, 13)] + [(k, [0.5] * 15, 1) for k in range(20, 40)]
    assert got(gnat.compress(table(spark, rows)), "code", "error", "label_error", "codebooks_sha256") == codes_by_force(rows, 16)


def test_huge_components_count_as_the_limit(spark):
    rows = [(k, [3e38 * (-1) ** k] * 64, 1) for k in range(4)] + [(9, [1e6] * 64, 1)]
    codes = {r.vec_id: r for r in gnat.compress(table(spark, rows)).collect()}
    assert codes[0].code == codes[2].code == codes[9].code != codes[1].code == codes[3].code and codes[0].error == 0
    assert {r.distance for r in threshold.cluster(table(spark, rows)).collect()} == {0}


@pytest.mark.parametrize("seed", range(6))
def test_nearest_with_ties(seed):
    """Few distinct values make many ties; far values make bounds large."""
    rng = np.random.default_rng(seed)
    spread = (2, 3, 50, 5000, 1 << 20, vectors.LIMIT)[seed]
    entries, x = rng.integers(-spread, spread + 1, (16, 8)), rng.integers(-spread, spread + 1, (3000, 8))
    x[:200] = entries[rng.integers(0, 16, 200)]
    d = gnat.squared(x, entries)
    want = d.argmin(1)
    for find in (lambda: gnat.nearest(gnat.build(entries), entries, x), lambda: threshold.Lists(entries).nearest(x)):
        at, distance, _ = find()
        assert (at == want).all() and (distance == d.min(1)).all()


def test_subtrees_and_walks_end_early():
    """Clustered entries: most are never compared in full, and results are those of all."""
    rng = np.random.default_rng(1)
    homes = rng.integers(-100_000, 100_000, (4, 8))
    entries = (homes[:, None] + rng.integers(-50, 50, (4, 4, 8))).reshape(16, 8)
    x = homes[rng.integers(0, 4, 2000)] + rng.integers(-50, 50, (2000, 8))
    want = gnat.squared(x, entries).argmin(1)
    at, _, looked = gnat.nearest(gnat.build(entries), entries, x)
    assert (at == want).all() and looked.mean() < 10
    at, _, looked = threshold.Lists(entries).nearest(x)
    assert (at == want).all() and looked.mean() < 10


def test_vector_sql(spark, sf_dir):
    for operator in (gnat, threshold):
        found, want = operator.query(spark, sf_dir).toPandas(), connect(sf_dir).sql(operator.ORACLE).df()
        assert sorted(found.columns) == sorted(want.columns) and len(found) > 0
        assert plain(found) == plain(want)
