"""Multiset fingerprints against counts of paragraphs and shingles."""

import base64
import hashlib
from collections import Counter

import numpy as np
import pytest

from rillframe.llm import multiset as M

WORDS = [f"word{k}" for k in range(400)]


def counts(text):
    out = Counter()
    for line in text.split("\n"):
        words = line.lower().split()
        out.update(tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2)) if words)
    return out


def alike(a, b):
    a, b = counts(a), counts(b)
    return 2 * sum(a[k] * b[k] for k in a) / (sum(x * x for x in a.values()) + sum(x * x for x in b.values()))


def prose(seed, lines=12):
    rng = np.random.default_rng(seed)
    return "\n".join(" ".join(rng.choice(WORDS, rng.integers(4, 30))) for _ in range(lines))


def test_order_insertion_and_deletion():
    lines = prose(1).split("\n")
    assert M.fingerprint("\n".join(lines)) == M.fingerprint("\n".join(lines[::-1]))
    assert M.plus(M.fingerprint("\n".join(lines[:5])), M.fingerprint("\n".join(lines[5:]))) == M.fingerprint("\n".join(lines))
    assert M.minus(M.fingerprint("\n".join(lines)), M.fingerprint("\n".join(lines[5:]))) == M.fingerprint("\n".join(lines[:5]))
    assert M.minus(M.fingerprint("a\nb"), M.fingerprint("a\nb")) == M.fingerprint("") == M.fingerprint(None) == bytes(M.SIZE)


def test_different_multisets_differ():
    texts = ["", "\n", "\n\n", "a", "A", "a ", "a\n", "a\na", "a\na\na", "a\nb", "ab", "a b", "b a", "a b c", "c b a", "\r\n", "a\r\nb", "é", "e"]
    assert len({M.fingerprint(t) for t in texts}) == len(texts)


def test_likeness():
    for seed in range(8):
        text, other = prose(seed), prose(seed + 100)
        changed = M.edited(text, other)
        assert M.likeness(M.fingerprint(text), M.fingerprint(text)) == 1
        assert abs(M.likeness(M.fingerprint(text), M.fingerprint(changed)) - alike(text, changed)) < 0.12
        assert M.likeness(M.fingerprint(text), M.fingerprint(other)) < 0.35
    assert M.likeness(M.fingerprint(""), M.fingerprint("")) == 1
    assert M.likeness(M.fingerprint(""), M.fingerprint("a")) == 0 == M.likeness(M.fingerprint("\n"), M.fingerprint(""))


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_matches_brute_force(docs, odd, parts):
    for df in (docs, odd):
        rows = df.select("doc_id", "text").collect()
        rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        found = M.fingerprints(df.repartition(parts)).collect()
        assert len(found) == len(rows)
        texts = [r.text or "" for r in rows]
        want = []
        for k, r in enumerate(rows):
            following = texts[(k + 1) % len(rows)]
            changed = M.edited(texts[k], following)
            prints = [M.fingerprint(x) for x in (texts[k], changed, following)]
            want.append((str(r.doc_id), len(texts[k]), hashlib.sha256(changed.encode()).hexdigest(), prints[0], prints[1], M.likeness(*prints[:2]), M.likeness(prints[0], prints[2])))
        assert sorted((str(r.doc_id), *r[1:3], bytes(r[3]), bytes(r[4]), *r[5:]) for r in found) == sorted(want)


def test_one_row_none_and_hot_ids(spark, nothing):
    assert M.fingerprints(nothing).collect() == []
    schema = "doc_id bigint, text string, id string, place string, next string, first string"
    extra = ("clash",) * 4
    (one,) = M.fingerprints(spark.createDataFrame([(3, "a b c d\ne f g h", *extra)], schema)).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a b c d\ne f a b").hexdigest()
    (one,) = M.fingerprints(spark.createDataFrame([(3, None, *extra)], schema)).collect()
    assert (one.n_chars, one.near_edited, one.near_next) == (0, 1, 1)
    hot = spark.createDataFrame([(7, f"row {k % 40} of one id", *extra) for k in range(3000)] + [(None, "none", *extra)] * 3, schema)
    found = M.fingerprints(hot).collect()
    assert len(found) == 3003 and sum(r.near_next == 1 for r in found) >= 3003 - 41


def test_a_long_text_among_short_ones(spark):
    long = "\n".join(prose(k) for k in range(400))
    df = spark.createDataFrame([(1, "short one here"), (2, long), (3, "last one here")], "doc_id bigint, text string")
    found = {r.doc_id: r for r in M.fingerprints(df).collect()}
    assert bytes(found[1].edited_fingerprint) == M.fingerprint(M.edited("short one here", long))
    assert bytes(found[2].fingerprint) == M.fingerprint(long) and found[2].near_edited > 0.6


def test_query(spark, sf_dir):
    rows = M.query(spark, sf_dir).collect()
    own = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(own)
    assert all(base64.b64decode(r.fingerprint) == M.fingerprint(own[r.doc_id]) for r in rows)
    long = [r for r in rows if r.n_chars > 2000]
    assert np.mean([r.near_edited for r in long]) > 0.6 > 0.3 > np.mean([r.near_next for r in long])
