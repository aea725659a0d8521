"""Toxicity by a counterfactual-regularised classifier.

A logistic model over words and word beginnings, hashed into ``DIMENSIONS`` features, is fitted
to labelled rows. Every labelled text gets a counterfactual. Where it names a group of people,
each identity term becomes another term of its kind; where it names none, a term that a hash of
its words draws is added to it, and the counterfactual has another term of that kind instead (a
text is a set of words here, so a term has no place in it). The loss is the log loss of the texts
with their terms plus ``strength`` times the mean squared change of the log-odds between a text
and its counterfactual, and ``strength`` times the squared change that each identity term makes in a
text that names no group, summed over all terms: in a model that adds up words it is the same in
every text, so every term of every kind is in the penalty whichever of them the labelled rows have.
So the weights can't lean on which group is named nor on that one is, and neutral mentions don't
become false positives, also where few labelled rows name a group.

The model is fitted on at most ``sample`` labelled rows (the first in the order of a hash of
their ids) of at most ``longest`` characters each and ``TOTAL`` in all, which bounds what the driver
gets; every row is then scored over its whole text by a sum over its distinct words, whose weights each worker keeps.
Only the text is an input of a score. Null texts count as empty, which get the score of the bias
alone. Rows with a null label are not learnt from; a row labelled twice is learnt from twice; of
rows that repeat an id the least text is learnt from; where no labelled row, or only one label, is
left, the scores are the smoothed share of label 1. Repeated rows are scored alike, null ids count
as the empty text for the folds, and other columns aren't looked at.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillframe.llm.common import Scratch, held_out, map_batches, texts, worker_state

DIMENSIONS = 1 << 20
#: Rows of the labelled sample, characters of each, and characters in all.
SAMPLE, LONGEST, TOTAL = 10_000, 40_000, 64_000_000
#: Parts in which the driver gets the sample.
PARTS = 16
#: Entries of sparse rows that a product takes at a time.
BLOCK = 1 << 20
_STRIP = ".,;:!?|\"'()[]{}<>#&*%$~`-_=+/\\…“”‘’«»¿¡"
#: Identity terms by kind; a counterfactual stays within a line.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("blind", "deaf", "disabled", "autistic"),
    ("frau", "mann", "mädchen", "junge"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("femme", "homme", "fille", "garçon"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs", "bouddhistes", "athées"),
    ("mujer", "hombre", "chica", "chico"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos", "budistas", "ateos"),
)
_KIND = {term: (k, j) for k, terms in enumerate(IDENTITY_TERMS) for j, term in enumerate(terms)}


def tokens(text: str) -> set[str]:
    """The distinct words of a text, with what stands at them."""
    return set(text.lower().split())


def token_features(token: str) -> list[int]:
    """A word's hashed features: itself, and its beginnings of 4, 5 and 6 letters."""
    core = token.strip(_STRIP)
    if not core:
        return []
    names = ["w" + core] + [f"{n}{core[:n]}" for n in (4, 5, 6) if len(core) >= n]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMENSIONS for x in names]


def counterfactual(words: Iterable[str]) -> set[str] | None:
    """The words with each identity term replaced by the next of its kind; None if there is none."""
    out, changed = set(), False
    for word in words:
        core = word.strip(_STRIP)
        if core in _KIND:
            k, j = _KIND[core]
            word, changed = word.replace(core, IDENTITY_TERMS[k][(j + 1) % len(IDENTITY_TERMS[k])]), True
        out.add(word)
    return out if changed else None


def mention_and_swap(words: set[str]) -> tuple[set[str], set[str]]:
    """A text that names a group, and its counterfactual; a text that names none gets a term first."""
    other = counterfactual(words)
    if other is None:
        draw = zlib.crc32(" ".join(sorted(words)).encode("utf-8", "surrogatepass"))
        kind = IDENTITY_TERMS[draw % len(IDENTITY_TERMS)]
        words = words | {kind[(draw >> 12) % len(kind)]}
        other = counterfactual(words)
    return words, other


def _packed(words: Iterable[str]) -> bytes:
    return np.fromiter((f for w in sorted(words) for f in token_features(w)), "<i4").tobytes()


def learnt_from(words: set[str]) -> tuple[bytes, bytes, bytes]:
    """Packed features of a text that names a group, of the words of it that its counterfactual
    lacks, and of those that the counterfactual has instead."""
    mention, other = mention_and_swap(words)
    return _packed(mention), _packed(mention - other), _packed(other - mention)


class Rows:
    """Sparse rows of the chosen features, a feature counted once for each distinct word that has it."""

    def __init__(self, packed: list[bytes], number: np.ndarray):
        """``number``: each feature's place among the chosen ones, or -1."""
        self.n = len(packed)
        sizes = [int((number[np.frombuffer(x, "<i4")] >= 0).sum()) for x in packed]
        self.index = np.empty(sum(sizes), np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        end = 0
        for x, size in zip(packed, sizes, strict=True):
            index = number[np.frombuffer(x, "<i4")]
            self.index[end : end + size] = index[index >= 0]
            end += size

    def _blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The entries a block at a time, so that products hold no more than a block beside the rows."""
        for at in range(0, len(self.index), BLOCK):
            yield self.index[at : at + BLOCK], self.row[at : at + BLOCK]

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for index, row in self._blocks():
            first = row[0]
            part = np.bincount(row - first, weights[index])
            out[first : first + len(part)] += part
        return out

    def transposed_dot(self, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(size)
        for index, row in self._blocks():
            out += np.bincount(index, values[row], size)
        return out


def _document_frequency(packed: Iterable[bytes]) -> np.ndarray:
    out = np.zeros(DIMENSIONS, np.int32)
    for x in packed:
        out[np.unique(np.frombuffer(x, "<i4"))] += 1
    return out


def fit(packed: list[bytes], labels: np.ndarray, gone: list[bytes], come: list[bytes], strength: float = 1.0, ridge: float = 1e-5, steps: int = 400) -> tuple[dict[int, float], float]:
    """The weights of the chosen features and the bias; the same for the same rows in any order
    that the caller fixes. Features are chosen by how surely their share differs between the
    labels; those of identity terms are always in."""
    labels = np.asarray(labels, float)
    n, positives = len(labels), labels.sum()
    prior = float(np.log((positives + 0.5) / (n - positives + 0.5)))
    if not 0 < positives < n:
        return {}, prior
    pos = _document_frequency(x for x, y in zip(packed, labels, strict=True) if y)
    neg = _document_frequency(x for x, y in zip(packed, labels, strict=True) if not y)
    odds = np.log((pos + 0.5) / (positives + 1)) - np.log((neg + 0.5) / (n - positives + 1))
    sure = np.abs(odds) >= 3 * np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    terms = [_packed([t]) for kind in IDENTITY_TERMS for t in kind]
    sure[np.frombuffer(b"".join([*gone, *come, *terms]), "<i4")] = True
    chosen = np.flatnonzero(sure)
    number = np.full(DIMENSIONS, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    rows, same, other, alone = Rows(packed, number), Rows(gone, number), Rows(come, number), Rows(terms, number)

    size = len(chosen)
    weights, bias = np.zeros(size), prior
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):  # Adam on the full sample
        error = 1 / (1 + np.exp(-np.clip(rows.dot(weights) + bias, -40, 40))) - labels
        gradient = rows.transposed_dot(error, size) / n + ridge * weights
        change = 2 * strength * (same.dot(weights) - other.dot(weights)) / n
        gradient += same.transposed_dot(change, size) - other.transposed_dot(change, size)
        gradient += alone.transposed_dot(2 * strength * alone.dot(weights), size)
        gradient = np.append(gradient, error.mean())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return dict(zip(chosen.tolist(), weights.tolist(), strict=True)), float(bias)


class TokenScores(dict):
    """The log-odds that a word adds; kept for at most ``limit`` words."""

    def __init__(self, weights: dict[int, float], limit: int = 300_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, token: str) -> float:
        value = sum(self.weights.get(f, 0.0) for f in token_features(token))
        if len(self) >= self.limit:
            self.clear()
        if len(token) <= 64:
            self[token] = value
        return value


def labelled_sample(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, fold: int = 0, sample: int = SAMPLE, longest: int = LONGEST):
    """What :func:`fit` learns from: packed features, labels, and what counterfactuals lack and have
    instead, of at most ``sample`` rows outside the fold."""
    known = labels.select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("label")).where(F.col("label").isNotNull() & ~held_out("id", folds, fold))
    known = F.broadcast(known.orderBy(F.xxhash64("id"), "id", "label").limit(sample))  # the bound of both broadcasts
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.length("text") <= longest)
    rows = rows.join(known.select("id").distinct(), "id").groupBy("id").agg(F.min("text").alias("text")).join(known, "id")
    rows = Scratch(df.sparkSession).save(rows.withColumn("place", F.xxhash64("id", "label")), "labelled")
    # A running sum over the lengths of the sample's rows alone.
    within = rows.select("id", "label", F.length("text").alias("size"), "place").withColumn("upto", F.sum("size").over(Window.orderBy("place", "id", "label")))
    rows = rows.join(F.broadcast(within.where(F.col("upto") <= TOTAL).select("id", "label").distinct()), ["id", "label"]).select("id", "label", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = zip(*(learnt_from(tokens(t)) for t in texts(batch)), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), *(pa.array(x, pa.binary()) for x in parts)], ["id", "label", "features", "gone", "come"])

    kind = rows.schema["id"].dataType.simpleString()
    packed = Scratch(df.sparkSession).save(map_batches(rows, run, f"id {kind}, label double, features binary, gone binary, come binary"), "packed")
    # Part by part: the driver's JVM never holds the sample.
    found = [(str(r["id"]), r["label"], *(bytes(r[x]) for x in ("features", "gone", "come"))) for r in packed.repartition(PARTS).toLocalIterator()]
    found.sort(key=lambda r: r[:2])
    features, gone, come = ([r[k] for r in found] for k in (2, 3, 4))
    return features, np.array([r[1] >= 0.5 for r in found], float), gone, come


class Scorer:
    """A fitted model that tasks score texts with."""

    def __init__(self, df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, fold: int = 0, sample: int = SAMPLE, strength: float = 1.0, longest: int = LONGEST):
        weights, self.bias = fit(*labelled_sample(df, labels, id_column, text, label, folds, fold, sample, longest), strength)
        self.model = df.sparkSession.sparkContext.broadcast(weights)  # at most as many weights as features
        self.key = uuid.uuid4().hex

    def __call__(self, many: list[str]) -> np.ndarray:
        of = worker_state("toxicity", self.key, lambda: TokenScores(self.model.value)).__getitem__
        odds = np.array([self.bias + sum(map(of, sorted(tokens(t)))) for t in many])
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def score(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 0, **options) -> DataFrame:
    """Fits the model and returns one row per row: the id, ``held_out``, ``score``, ``predicted``."""
    scorer = Scorer(df, labels, id_column, text, folds=folds, fold=fold, **options)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer(texts(batch)), pa.float64())], ["id", "score"])

    rows = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    out = map_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_column), held_out("id", folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``df``, with all their columns, whose score is below ``threshold``."""
    scorer = Scorer(df, labels, id_column, text, **options)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(scorer(texts(batch, text)) < threshold))

    return map_batches(df, run, df.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: toxicity scores of every row of ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
