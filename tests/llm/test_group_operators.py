"""Near and exact duplicates, mixing and the pipeline, against brute force."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillframe.llm import exact_dedup, lattice, minhash, mixing
from rillframe.llm.components import components


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(k, k + 1) for k in range(500, 520)] + [(900, k) for k in range(901, 940)]
    want = roots_of({x for e in links if e[0] != e[1] for x in e}, [e for e in links if e[0] != e[1]])
    assert {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("width, parts", [(3, 85), (5, 80)])
def test_minhash_matches_brute_force(docs, odd, width, parts):
    for df in (docs, odd):
        rows = [r for r in df.select("doc_id", "text").distinct().collect() if r.doc_id is not None]
        sets = {r.doc_id: shingle_set(r.text, width) for r in rows}
        near = lambda a, b: a and b and 100 * len(a & b) >= parts * len(a | b)
        want = roots_of(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if near(sets[a], sets[b])])
        got = minhash.near_groups(df, width=width, parts=parts).collect()
        assert len(got) == df.count()
        for r in got:
            if r.doc_id is not None:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_large_group(spark, nothing):
    """A group of copies that differ in a word each, with exact copies among them."""
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[: k % 100] + ["changed"] + base[k % 100 + 1 :]) if k % 3 else " ".join(base)) for k in range(600)]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), width=3, parts=85).collect()
    assert {r.component_id for r in got} == {0}
    assert minhash.near_groups(nothing).count() == 0


def test_minhash_repeated_ids(spark):
    """Rows with one id are one document, whichever of its texts links it."""
    a, b = (" ".join(f"{x}{k}" for k in range(200)) for x in "ab")
    df = spark.createDataFrame([(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, "other text of five words"), (None, a + " z"), (5, None), (5, a)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in minhash.near_groups(df).collect()}
    assert got == {(1, 196): 1, (2, 197): 1, (3, 197): 1, (4, 1): 4, (None, 197): 1, (5, 0): 5, (5, 196): 1}


def test_minhash_groups_of_many_blocks(spark, monkeypatch):
    """Blocks of a few sets each: large groups, and a chain of texts that only neighbours link."""
    monkeypatch.setattr(minhash, "SETS", 8)
    monkeypatch.setattr(minhash, "CHOSEN", 2)
    monkeypatch.setattr(minhash, "MEETING", 3)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base[:k], "changed", *base[k + 1 :]])) for k in range(150)]
    rows += [(1000 + k, " ".join(f"c{j}" for j in range(8 * k, 8 * k + 160))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {i: shingle_set(t, 5) for i, t in rows}
    want = roots_of(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in minhash.near_groups(df).collect()} == want
    assert len(set(want.values())) == 2


def test_minhash_links_through_null_ids(spark):
    """A row without an id links the rows on either side of it."""
    base = [f"w{k}" for k in range(200)]
    a, b, c = (" ".join(base[k:] + [f"x{j}" for j in range(k)]) for k in (0, 12, 24))
    for b_id, want in ((9, {1: 1, 2: 1, 9: 1}), (None, {1: 1, 2: 1, None: 1})):
        df = spark.createDataFrame([(1, a), (b_id, b), (2, c)], "doc_id bigint, text string")
        sets = [shingle_set(t, 5) for t in (a, b, c)]
        assert [100 * len(x & y) >= 80 * len(x | y) for x, y in itertools.combinations(sets, 2)] == [True, False, True]
        got = minhash.near_groups(df).collect()
        assert {r.doc_id: r.component_id for r in got} == want
        assert [r.kept for r in sorted(got, key=lambda r: r.doc_id or 99)] == [True, False, False]
    lone = spark.createDataFrame([(None, a), (None, b), (4, "others of five words here")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_groups(lone).collect()} == {(None, None), (4, 4)}


@pytest.mark.parametrize("copies", [1500, 3000])
def test_minhash_strays_of_a_large_group(spark, monkeypatch, copies):
    """Documents that share keys with a large group but aren't linked with it meet its blocks, and
    don't make its blocks meet each other; what is linked already is not put out again."""
    seen = {}
    saved, paired = minhash.Scratch.save, minhash._pairs

    def save(self, df, name, *rest):
        out = saved(self, df, name, *rest)
        if name in ("pairs", "late", "open-blocks", "blocks"):
            seen[name] = out.count()
        return out

    monkeypatch.setattr(minhash, "SETS", 32)
    monkeypatch.setattr(minhash.Scratch, "save", save)
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*base[: k % 300], f"c{k // 300}", *base[k % 300 + 1 :]])) for k in range(copies)]
    rows += [(10_000 + k, " ".join(base[: 300 - 55 - k] + [f"s{k}-{j}" for j in range(60)])) for k in range(20)]
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    sets = {i: shingle_set(t, 5) for i, t in rows}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    strays = {i: s for i, s in sets.items() if i >= 10_000}
    assert not any(near(s, sets[k]) for s in strays.values() for k in range(0, copies, 7))
    assert {got[k] for k in range(copies)} == {0} and {i: got[i] for i in strays} == roots_of(strays, [(a, b) for a, b in itertools.combinations(strays, 2) if near(sets[a], sets[b])])
    assert seen["blocks"] > copies / 32 - 1 and seen.get("open-blocks", 0) > copies / 64
    assert seen["pairs"] <= 4 * seen["open-blocks"] and seen["late"] <= 20


def test_minhash_pairs_of_blocks(spark):
    """Against all pairs of blocks at each key: mixed blocks with all, blocks of one component with others'."""
    rng = np.random.default_rng(5)
    rows = [(k, int(b), int(b) if b < 6 else int(b) % 2 + 100 if b < 12 else int(r)) for k in range(40) for b in rng.choice(15, 6, replace=False) for r in rng.integers(0, 50, 9)]
    rows += [(1000 + k, *r[1:]) for k in range(30) for r in rows if r[0] == 7]  # keys with the same blocks
    roots = defaultdict(set)
    for k, b, r in rows:
        roots[k, b].add(r)
    want = {(a, b) for k, a in roots for j, b in roots if j == k and a <= b and len(roots[k, a] | roots[k, b]) > 1}
    df = spark.createDataFrame(rows, "key bigint, block bigint, root bigint").distinct()
    assert {tuple(r) for r in minhash._pairs(df).collect()} == want


def test_lattice_points():
    draw = np.random.default_rng(2)
    points = draw.standard_normal((300, 8)) * 2
    near = lattice.decode(points)
    around = near[:, None, :] + lattice.shortest()[None]
    assert len(lattice.shortest()) == 240
    assert ((points - near) ** 2).sum(1).max() <= 1 + 1e-9  # the covering radius
    assert (((points[:, None] - around) ** 2).sum(2).min(1) >= ((points - near) ** 2).sum(1) - 1e-9).all()


def test_lattice_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((260, 64))
    rows = [(k, v.tolist(), int(k % 3)) for k, v in enumerate(base)]
    for k in range(80):  # borderline and close neighbours
        other = rng.standard_normal(64)
        unit = base[k] / np.linalg.norm(base[k])
        other -= other @ unit * unit
        c = 0.9305 + 0.06 * rng.random()
        rows.append((1000 + k, (c * unit + np.sqrt(1 - c * c) * other / np.linalg.norm(other)).tolist(), int(k % 3) if k % 5 else None))
    rows += [(2000 + k, (base[0] + rng.standard_normal(64) * 0.02).tolist(), 0) for k in range(150)]  # a dense group
    rows += [(3000, None, 0), (3001, [0.0] * 64, 0), (3002, [float("nan")] * 64, 0), (3003, [None] * 64, 0), (3004, [], 0), (3005, base[1].tolist()[:8], 1), (3006, base[1].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    good = {i: (np.array(v) / np.linalg.norm(v), label) for i, v, label in rows if v and label is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.93]
    count, want = Counter(x for e in links for x in e), roots_of([r[0] for r in rows], links)
    got = {r.vec_id: r for r in lattice.near_vectors(df).collect()}
    found = sum(r.n_links for r in got.values())
    assert found >= 0.9 * 2 * len(links) and all(r.n_links <= count[i] for i, r in got.items())
    assert sum(got[i].component_id == want[i] for i in want) >= 0.97 * len(want)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (3000, 3001, 3002, 3003, 3004, 3005))
    assert lattice.near_vectors(df.limit(0)).count() == 0


def test_lattice_many_vectors_just_below_the_threshold(spark, monkeypatch):
    """2,000 vectors of cosines about 0.90 with each other, some linked: few pairs of teams, links as by force."""
    rng, n = np.random.default_rng(7), 2000
    centre = np.zeros(64)
    centre[0] = 1
    away = rng.standard_normal((n, 64))
    away[:, 0] = 0
    v = np.sqrt(0.9) * centre + np.sqrt(0.1) * away / np.linalg.norm(away, axis=1, keepdims=True)
    v[:6] = v[0]  # a small ball among them
    seen, saved = {}, lattice.Scratch.save

    def save(self, df, name, *rest):
        out = saved(self, df, name, *rest)
        if name == "pairs":
            seen[name] = out.count()
        return out

    monkeypatch.setattr(lattice.Scratch, "save", save)
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id bigint, embedding array<double>, label int")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    want = roots_of(range(n), np.argwhere(linked).tolist())
    got = {r.vec_id: r for r in lattice.near_vectors(df).collect()}
    assert linked.sum() > 2000 and seen["pairs"] < 0.01 * n * n / 2
    assert sum(r.n_links for r in got.values()) >= 0.97 * linked.sum() and all(got[k].n_links <= linked[k].sum() for k in got)
    assert sum(got[k].n_links == linked[k].sum() for k in got) >= 0.95 * n and sum(got[k].component_id == want[k] for k in got) >= 0.95 * n


def test_lattice_hot_vector(spark):
    """Very many equal vectors: linked with each other and with two that are near."""
    n = 100_000
    hot = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(k == 0)) for k in range(8)]).alias("embedding"), F.lit(1).alias("label"))
    others = spark.createDataFrame([(n + 1, [0.95, 0.3] + [0.0] * 6, 1), (n + 2, [0.96, 0.0, 0.27] + [0.0] * 5, 1), (n + 3, [0.0, 1.0] + [0.0] * 6, 1), (n + 4, [1.0] + [0.0] * 7, 2)], "vec_id bigint, embedding array<double>, label int")
    got = lattice.near_vectors(hot.unionByName(others))
    counted = {tuple(r) for r in got.groupBy((F.col("vec_id") < n).alias("hot"), "n_links", "component_id").count().collect()}
    assert counted == {(True, n + 1, 0, n), (False, n, 0, 2), (False, 0, n + 3, 1), (False, 0, n + 4, 1)}


def test_exact_dedup(spark, docs, odd, nothing):
    for df in (docs, odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        groups = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
        got = {r.doc_id: r for r in exact_dedup.sort_groups(df).collect()}
        for norm, members in groups.items():
            keep = min(members)[1]
            for _, i in members:
                assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    repeated = exact_dedup.sort_groups(odd).collect()
    assert len(repeated) == odd.count() and exact_dedup.sort_groups(nothing).count() == 0
    assert Counter(r.text_sha256 for r in repeated if r.kept) == Counter(dict.fromkeys({r.text_sha256 for r in repeated}, 1))


def test_exact_dedup_group_over_many_partitions(spark):
    rows = [(k, "same text " * 20) for k in range(4000)] + [(k, f"other {k}") for k in range(4000, 4100)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.sort_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 4000} == {(0, 4000)}
    assert sum(r.kept for r in got) == 101


def water_filled(sizes, weights, ratio, cap):
    left, targets, total = dict(sizes), {}, ratio * sum(sizes.values())
    while left:
        share = total / sum(weights[s] for s in left)
        over = [s for s in left if share * weights[s] >= cap * left[s]]
        if not over:
            return targets | {s: share * weights[s] for s in left}
        for s in over:
            targets[s] = cap * left.pop(s)
            total -= targets[s]
    return targets


def test_mixing(docs, odd, nothing):
    order = lambda s: (s is None, (s or "").encode())
    for df, slack in ((docs, 0.03), (odd, 1.0)):
        words = Counter()
        for r in df.select("source", "text").collect():
            words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(words, key=order))}
        want = water_filled(words, weights, 1.5, 2.0)
        mix = mixing.Mix(df)
        got = mix.taken().collect()
        targets = {r.source: r.target for r in mix.plan.collect()}
        assert len(got) == df.count() and all(0 <= r.taken <= 2 * r.size for r in got)
        assert all(targets[s] == pytest.approx(want[s]) for s in want)
        sums = defaultdict(int)
        for r in mix.placed.join(mix.sizes.select("row", "source"), "row").groupBy("source").agg(F.sum("n").alias("n")).collect():
            sums[r.source] = r.n
        assert all(abs(sums[s] - want[s]) <= max(64, slack * want[s]) for s in want)
    again = Counter(tuple(r) for r in mixing.Mix(docs).taken().collect())
    assert again == Counter(tuple(r) for r in mixing.Mix(docs).taken().collect())
    assert mixing.Mix(nothing).taken().count() == 0


def test_mix_is_plain_spark(docs):
    plan = mixing.Mix(docs).taken()._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_mixed_documents(docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    whole = {r.doc_id: (r.text or "").split(" ") for r in docs.collect()}
    words = {i: Counter(re.findall(r"[^\x20\x09-\x0D]+", " ".join(w))) for i, w in whole.items()}
    taken = {r.doc_id: r.taken for r in mixing.Mix(docs, row="doc_id").taken().collect()}
    got = defaultdict(int)
    for r in mixed.collect():
        mine = Counter(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert not mine - words[r.doc_id]
        got[r.doc_id] += sum(mine.values())
    assert all(got[i] == n for i, n in taken.items())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids
        if name.endswith("dedup"):
            texts = [re.sub(r"\s", "", r.text or "") for r in after.select("text").collect()]
            assert len(texts) == len(set(texts))
        before = after
    assert corpus_pipeline.run(spark, sf_dir).count() == before.count()


@pytest.fixture(scope="module")
def schema(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").schema


def test_pipeline_odd_rows(spark, sf_dir, schema):
    """Nulls, empty texts, ties, repeated rows and ids, and a very long text, through every stage."""
    long = " ".join(f"w{k}" for k in range(60_000))
    some = " ".join(f"plain{k}" for k in range(40))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "   ", "en", "a", 3), (3, long, "en", "a", len(long)), (4, some, "en", None, 9), (4, some, "en", None, 9), (4, some + " more", "en", None, 9), (5, some.replace("plain", "other"), "de", "b", 9), (None, "a row without an id", "en", "b", 1)]
    docs = spark.createDataFrame(rows, schema)
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert Counter(map(tuple, clean.collect())) == Counter(rows)
    once = corpus_pipeline.drop_copies(spark, clean, sf_dir)
    # The null text, the empty one and the blanks are equal: the longest stays.
    assert Counter((r.doc_id, r.text) for r in once.collect()) == Counter([(2, "   "), *{(r[0], r[1]) for r in rows[3:]}])
    near = corpus_pipeline.drop_near_copies(spark, once, sf_dir)
    left = {(r.doc_id, len(r.text)) for r in near.collect()}
    assert {(2, 3), (3, len(long)), (5, len(rows[7][1])), (None, len(rows[8][1]))} < left and len(left) == 5
    mixed = corpus_pipeline.mix_sources(spark, near, sf_dir).collect()
    sizes = {r.doc_id: len(r.text.split()) for r in near.collect()}
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += len(r.text.split())
    assert all(n <= 2 * sizes[i] for i, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 128
    coded = corpus_pipeline.encode(spark, spark.createDataFrame(mixed, schema), sf_dir).collect()
    assert Counter(r.decoded_sha256 for r in coded) == Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in mixed)


def test_pipeline_without_rows(spark, sf_dir, schema):
    docs = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "bpe" or out.columns == docs.columns)


def test_pipeline_columns_of_other_names(spark, sf_dir, schema):
    """Columns beyond those of the documents pass through the filtering stages, whatever their names."""
    rows = [(k, f"text number {k} " + " ".join(f"v{k}x{j}" for j in range(30)), "en", "a", 5, f"own{k}", k, "z", 1.5, True, "s") for k in range(20)]
    extra = ["id", "row", "keep", "component_id", "score", "kept", "size"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    docs = spark.createDataFrame([r[:5] + (r[5], r[6], r[7], r[6], r[8], r[9], r[6]) for r in rows], f"{fields}, id string, row bigint, keep string, component_id bigint, score double, kept boolean, size bigint")
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and Counter(map(tuple, out.collect())) == Counter(map(tuple, docs.collect()))
    assert set(corpus_pipeline.mix_sources(spark, docs, sf_dir).columns) >= {*schema.names, *extra}


def test_mixed_long_text_is_split_once(spark):
    """Twice the words take about twice the time, also where a text is taken in parts."""
    import time

    def seconds(n):
        df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(n)), "ab"[k % 2]) for k in range(2)], "doc_id bigint, text string, source string")
        began = time.perf_counter()
        mixing.mixed_documents(df).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < seconds(20_000) + 20


def test_pipeline_tells_repeated_rows_apart(spark, sf_dir):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(1, text, "en", "a", 1)] * 3 + [(None, text.replace("w", "v"), "en", "a", 1)] * 2 + [(2, text.replace("w5 ", "changed "), "en", "a", 1)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    once = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    assert Counter(r.doc_id for r in once.collect()) == {1: 1, None: 1, 2: 1}
    near = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert len(near.collect()) == 2 and near.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir).collect()
    total = sum(len(r.text.split()) for r in mixed)
    assert abs(total - 1.5 * 1200) <= 64 and {r.doc_id for r in mixed} == {1, None, 2}
