"""Fingerprints of documents as homomorphic multiset hashes of their paragraphs.

A paragraph is a line of a text, without its line feed. Each paragraph has a wide vector that
depends on it alone, in two parts: ``WORDS`` numbers of 64 bits from a digest of its bytes, and
``LANES`` counts of 32 bits, in which each of its shingles of three words (lower-cased; fewer words
are one shingle) adds 1 to or takes 1 from one lane, both told by the shingle's hash. A text's
fingerprint is the sum of its paragraphs' vectors, the first part modulo 2^64 and the second modulo
2^32. So the order of paragraphs doesn't matter, equal multisets of paragraphs have equal
fingerprints, others differ but for a chance of the digest, and a paragraph is added or deleted
(:func:`plus`, :func:`minus`) without the rest of the text.

The difference of two fingerprints is that of the paragraphs they don't share, whose lanes' squares
add up, on average, to the squared difference of the shingles' counts. :func:`likeness` takes this
off the squares of both, 2ab / (aa + bb): 1 for equal fingerprints, about the share of the text in
common for edits, and near 0 for texts that share no three words in a row. With 256 lanes it is off
by 0.09 times the part that differs (a standard deviation).

An edited text is reckoned from its text's fingerprint: the paragraphs from the cut on are taken off,
and those that replace them are added. The next document is found in one sort by range of id; the
last row of each partition waits for the first of the next, and these rows, two of each partition,
are joined on.

Null texts count as empty; an empty text has no paragraph and the zero fingerprint, which is like
itself and nothing else. Null ids come before all others, rows of equal id in an order that their
texts alone decide. A table of one row has itself as the next. An empty table gives an empty result, and columns
other than id and text aren't looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Scratch, coded_words, word_hashes

#: 64-bit numbers of a digest, lanes of shingle counts, words of a shingle.
WORDS, LANES, WIDTH = 8, 256, 3
SIZE = 8 * WORDS + 4 * LANES


def paragraphs(text: str) -> list[str]:
    return text.split("\n") if text else []


def _shingle_cells(lines: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lane of its owner and the sign of every shingle of every line."""
    sizes, codes, distinct = coded_words(pa.array(lines, pa.string()))
    h = word_hashes(distinct).view(np.uint64).take(codes)
    line = np.repeat(np.arange(len(lines)), sizes)
    ends = np.cumsum(sizes)
    place = np.arange(len(h))
    short = np.minimum(sizes, WIDTH)[line]  # words of this line's shingles
    starts = place <= (ends[line] - short)
    place, line, short = place[starts], line[starts], short[starts]
    out = short.astype(np.uint64)
    for k in range(WIDTH):
        inside = short > k
        out[inside] += h[place[inside] + k]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return owner[line] * LANES + (out & np.uint64(LANES - 1)).astype(np.int64), 1 - 2 * ((out >> np.uint64(32)) & np.uint64(1)).astype(np.int64)


def sums(lines: list[str], owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of the sums of the lines' vectors, for each owner of lines."""
    high = np.zeros((owners, WORDS), np.uint64)
    if not lines:
        return high, np.zeros((owners, LANES), np.uint32)
    digests = b"".join([hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8 * WORDS).digest() for x in lines])
    np.add.at(high, owner, np.frombuffer(digests, "<u8").reshape(len(lines), WORDS))
    cells, signs = _shingle_cells(lines, owner)
    low = np.bincount(cells, weights=signs, minlength=owners * LANES).reshape(owners, LANES)
    return high, low.astype(np.int64).astype(np.uint32)


def packed(high: np.ndarray, low: np.ndarray) -> list[bytes]:
    return [a.astype("<u8").tobytes() + b.astype("<u4").tobytes() for a, b in zip(high, low, strict=True)]


def _parts(fingerprint: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(fingerprint, "<u8", WORDS), np.frombuffer(fingerprint, "<u4", LANES, 8 * WORDS)


def plus(a: bytes, b: bytes) -> bytes:
    """The fingerprint of the paragraphs of both."""
    (ah, al), (bh, bl) = _parts(a), _parts(b)
    return packed((ah + bh)[None], (al + bl)[None])[0]


def minus(a: bytes, b: bytes) -> bytes:
    """The fingerprint of the paragraphs of the first without those of the second."""
    (ah, al), (bh, bl) = _parts(a), _parts(b)
    return packed((ah - bh)[None], (al - bl)[None])[0]


def fingerprint(text: str | None) -> bytes:
    """A text's fingerprint."""
    lines = paragraphs(text or "")
    return packed(*sums(lines, np.zeros(len(lines), np.int64), 1))[0]


def _alike(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> np.ndarray:
    a, b, d = (x.astype(np.uint32).view(np.int32).astype(float) for x in (al, bl, al - bl))
    both = (a * a).sum(-1) + (b * b).sum(-1)
    same = (ah == bh).all(-1) & (al == bl).all(-1)
    return np.where(same, 1.0, np.clip(1 - (d * d).sum(-1) / np.where(both > 0, both, 1), 0, 1) * (both > 0))


def likeness(a: bytes, b: bytes) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    (ah, al), (bh, bl) = _parts(a), _parts(b)
    return float(_alike(ah[None], al[None], bh[None], bl[None])[0])


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the beginning of the other."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def followed(texts: list[str]) -> dict[str, list]:
    """For each text but the last, which is only followed: length, digest of the edited text,
    both fingerprints and both likenesses."""
    lines: list[str] = []
    owner: list[int] = []  # three sums for each text: what stays, what goes, what comes
    digests, sizes = [], []
    for k, text in enumerate(texts):
        at = paragraphs(text)
        if k + 1 == len(texts):
            stays, goes, comes = at, [], []
        else:
            n = len(text) // 4
            head = paragraphs(text[: len(text) - n])
            whole = max(0, len(head) - 1)  # the last paragraph of the head may be cut
            stays, goes = at[:whole], at[whole:]
            comes = paragraphs((head[-1] if head else "") + texts[k + 1][:n])
            if text and not comes:
                comes = [""]  # an empty last paragraph of a text that isn't empty
            sizes.append(len(text))
            digests.append(hashlib.sha256(edited(text, texts[k + 1]).encode("utf-8", "surrogatepass")).hexdigest())
        lines += stays + goes + comes
        owner += [3 * k] * len(stays) + [3 * k + 1] * len(goes) + [3 * k + 2] * len(comes)
    high, low = sums(lines, np.array(owner, np.int64), 3 * len(texts))
    high, low = high.reshape(-1, 3, WORDS), low.reshape(-1, 3, LANES)
    own, new = (high[:, 0] + high[:, 1], low[:, 0] + low[:, 1]), (high[:-1, 0] + high[:-1, 2], low[:-1, 0] + low[:-1, 2])
    before = (own[0][:-1], own[1][:-1])
    return {
        "n_chars": sizes,
        "edited_sha256": digests,
        "fingerprint": packed(*before),
        "edited_fingerprint": packed(*new),
        "near_edited": _alike(*before, *new).tolist(),
        "near_next": _alike(*before, own[0][1:], own[1][1:]).tolist(),
    }


FIELDS = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
#: Texts fingerprinted at once, and their characters, about.
ROWS, CHARACTERS = 256, 2_000_000


def _batch(ids: list, found: dict[str, list], kind: pa.DataType, place: int, first: str | None = None, last: str | None = None) -> pa.RecordBatch:
    """Result rows; ``first`` is the text of a partition's first row and ``last`` that of its last,
    which has no result yet."""
    n = len(ids)
    arrays = [pa.array(ids, kind), pa.array([place] * n, pa.int32()), pa.array([first, *[None] * (n - 1)], pa.string()), pa.array([*[None] * (n - 1), last], pa.string())]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.array(found[c], t) for c, t in zip(_NAMES, _TYPES, strict=True))], ["id", "place", "first", "last", *_NAMES])


def _walk(kind: pa.DataType):
    """Fingerprints a sorted partition, each row with the one that follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        ids, held, size = [], [], 0
        opening: str | None = None  # the partition's first text, until it is handed on
        started = False
        for piece in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for id_, text in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                if not started:
                    opening, started = text, True
                ids.append(id_)
                held.append(text)
                size += len(text)
                if len(held) > 1 and (len(held) > ROWS or size > CHARACTERS):
                    yield _batch(ids[:-1], followed(held), kind, place, opening)
                    ids, held, size, opening = ids[-1:], held[-1:], len(held[-1]), None
        if held:
            if len(held) > 1:
                yield _batch(ids[:-1], followed(held), kind, place, opening)
                opening = None
            yield _batch(ids[-1:], dict.fromkeys(_NAMES, [None]), kind, place, opening, held[-1])

    return run


def fingerprints(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row: the id and ``FIELDS``, fingerprints as bytes."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(id_column).cast("bigint").alias("id"), body.alias("text")).select("id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    # Rows of one id can be dealt out too, by hash and row; equal texts of one id are alike in all.
    ordered = rows.repartitionByRange(F.asc_nulls_first("id"), "h", "row").sortWithinPartitions(F.asc_nulls_first("id"), "h", "text", "row")
    walked = ordered.select("id", "text").mapInArrow(_walk(pa.int64()), f"id bigint, place int, first string, last string, {FIELDS}")
    found = scratch.save(walked, "walked", "zstd")

    # One number for each partition: which one comes next, the first again after the last.
    places = sorted(r.place for r in found.where("last IS NOT NULL").select("place").collect())
    pairs = spark.createDataFrame(list(zip(places, places[1:] + places[:1], strict=True)), "place int, next int")
    opening = found.where("first IS NOT NULL").select(F.col("place").alias("next"), F.col("first").alias("following"))
    ends = found.where("last IS NOT NULL").select("id", "place", F.col("last").alias("text")).join(pairs, "place").join(opening, "next")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = followed([batch.column("text")[k].as_py(), batch.column("following")[k].as_py()])
                yield pa.RecordBatch.from_arrays([batch.column("id")[k : k + 1], *(pa.array(own[c], t) for c, t in zip(_NAMES, _TYPES, strict=True))], ["id", *_NAMES])

    closed = ends.select("id", "text", "following").mapInArrow(close, f"id bigint, {FIELDS}")
    return found.where("last IS NULL").select("id", *_NAMES).unionByName(closed).withColumnRenamed("id", id_column)


def as_text(fingerprint: bytes) -> str:
    """A fingerprint as the query shows it."""
    return base64.b64encode(fingerprint).decode()


def query(spark, sf_dir: str) -> DataFrame:
    """op12: fingerprints of every whole text of ``documents``, as Base64."""
    found = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumns({c: F.base64(c) for c in ("fingerprint", "edited_fingerprint")})
