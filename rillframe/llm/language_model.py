"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Words of the training rows are counted exactly. The model predicts a word from the two before it:
the prediction is the sum of the context words' vectors, each weighted by a vector of its place,
and a word's score is its vector's product with the prediction plus its bias. Its vocabulary grows
with the corpus: every token that occurs ``LEAST`` times, up to ``VOCABULARY`` vectors (which bounds
a worker's and the driver's memory), and ``CLASSES`` classes by frequency, with vectors too, for all
others. Vectors are put into groups, smaller ones for frequent words, which have vectors of their
own: a word's probability is that of its group times its own within the group, and the groups are
those for which a score costs least. Both are trained in numpy with
noise-contrastive estimation against the unigram distribution: every task runs over its own
share of the training rows, reading every position of every text once a round, and Spark
averages the tasks' parameters element by element between rounds. What training and counting
gather thus grows with the corpus, while what the driver holds doesn't.

Scores are normalised, over the groups and within the group of each word; nothing is kept from one
batch to the next. A word of a frequency class gets the class's probability times its own unigram
share of the class; tokens beyond the broadcast table are the last class.
Counts of frequent tokens reach the scorers by a broadcast of ``FREQUENT`` entries at most; the
other tokens of each text, by their 64-bit hashes, are joined with the counts.

Tokens are the words between blanks and the controls 9 to 13 after lower-casing A-Z, and one end
per text. Null and empty texts consist of their end alone. A text of any length is scored whole.
Without training rows every count is zero and scores equal the base. Repeated rows are scored
(and learnt from) as often as they occur, null ids count as the empty text for the folds, and
columns other than id and text aren't looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Scratch, coded_words, held_out, map_batches, word_hashes, worker_state

#: Words and classes that have vectors, at most; a word occurs ``LEAST`` times at least.
VOCABULARY, CLASSES, LEAST = 65_536, 16, 10
DIMENSIONS = 24
CONTEXT = 2
ROUNDS = 2
FREQUENT = 100_000
NOISE, MINIBATCH, RATE, DAMPING = 64, 4096, 0.05, 1e-8
#: A word's vector, its bias, and a blank that makes the width even.
WIDTH = DIMENSIONS + 2
#: Parameters that are averaged as one value.
PART = 2048
#: Tokens of the training rows that a task gets at least where tables are small.
SHARE = 8_000_000
#: Positions that are shuffled into minibatches at a time.
PIECE = 1 << 17
#: Distinct tokens that a counting task holds before it hands them on.
HELD = 400_000
#: The token after a text's last word; no word holds a blank.
END = " end"


_END = word_hashes(pa.array([END]))[0]


class Vocabulary:
    """Frequent tokens, the most frequent first, and the base distribution over all tokens."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, distinct: int, size: int, classes: int = 1, least: int = 0):
        self.h, self.c = h, c
        self.by_hash = np.argsort(h)
        self.total, self.distinct = total, distinct
        self.denominator = total + 0.5 * (distinct + 1)
        self.words = min(max(size - classes, 0), int((c >= least).sum()))
        self.units = self.words + classes
        share = (c + 0.5) / self.denominator
        # Tokens without a vector of their own: classes of about the same share, the last for those not in ``h``.
        tail = share[self.words :]
        before = np.cumsum(tail) - tail
        number = np.arange(len(c))
        inner = max(classes - 1, 1)
        number[self.words :] = self.words + np.minimum((before / max(tail.sum(), 1e-300) * inner).astype(np.int64), inner - 1)
        self.unit = np.append(number, self.units - 1).astype(np.uint16)  # the last for tokens not in ``h``, at place -1
        base = np.bincount(number, share, self.units)
        base[-1] = max(0.0, 1 - (base[:-1].sum() if classes > 1 else share[: self.words].sum()))
        self.base = np.maximum(base, 1e-12)
        self.log_base = np.log(self.base)
        # Groups of neighbours. A score costs a product for each group and for each unit of the word's
        # group, which comes to least where a group's size is the inverse root of its units' share.
        roots = np.sqrt(self.base)
        self.group = np.unique((np.cumsum(roots) - roots).astype(np.int64), return_inverse=True)[1].astype(np.int32)
        self.groups = int(self.group[-1]) + 1
        self.first = np.searchsorted(self.group, np.arange(self.groups + 1))  # groups are runs of units
        self.group_base = np.bincount(self.group, self.base, self.groups)


    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Each token's place among the frequent ones, or -1."""
        if not len(self.h):
            return np.full(len(tokens), -1)
        at = self.by_hash[np.minimum(np.searchsorted(self.h, tokens, sorter=self.by_hash), len(self.h) - 1)]
        return np.where(self.h[at] == tokens, at, -1)


def token_counts(rows: DataFrame) -> DataFrame:
    """(h, c): the hash of each distinct token of ``text`` and how often it occurs."""

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by("token").aggregate([("c", "sum")]).rename_columns(["token", "c"])

    def handed(parts: list[pa.Table]) -> pa.RecordBatch:
        tokens, c = summed(parts).columns
        return pa.RecordBatch.from_arrays([pa.array(word_hashes(tokens.combine_chunks())), c.combine_chunks()], ["h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.Table] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.column("text").slice(at, 1024)
                _, codes, distinct = coded_words(some)
                ends = pa.table({"token": pa.array([END], distinct.type), "c": pa.array([len(some)], pa.int64())})
                seen += [pa.table({"token": distinct, "c": pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())}).filter(pc.field("c") > 0), ends]
                if sum(map(len, seen)) > 2 * HELD:
                    seen = [summed(seen)]
                    if len(seen[0]) > HELD:
                        yield handed(seen)
                        seen = []
        if seen:
            yield handed(seen)

    return rows.select("text").mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def frequent_tokens(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the most frequent tokens, ``most`` of them at most, the most frequent
    first. Where the line lies is found from the numbers of tokens by their count (in steps of a
    hundredth part above a thousand), so that the driver gets no more than it keeps."""
    step = F.when(F.col("c") < 1024, F.col("c")).otherwise(1024 + F.floor(F.log2(F.col("c") / 1024) * 64)).cast("int")
    sizes = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = 1 << 30, 0
    for line, n in sizes:
        if held + n > most:
            break
        least, held = line, held + n
    top = counts.where(step >= least).toArrow()
    h, c = top["h"].to_numpy(), top["c"].to_numpy()
    order = np.lexsort((h, -c))
    return h[order], c[order]


class LogBilinear:
    """Parameters: context vectors ``q``, the last for the place before a text; ``w``, vectors and
    biases of the units and behind them of the groups; and a weight vector ``p`` for each place of
    the context."""

    def __init__(self, v: Vocabulary):
        draw = np.random.default_rng(3)
        self.q = (draw.standard_normal((v.units + 1, DIMENSIONS)) * 0.1).astype(np.float32)
        self.w = np.zeros((v.units + v.groups, WIDTH), np.float32)
        self.w[:, :DIMENSIONS] = draw.standard_normal((v.units + v.groups, DIMENSIONS)) * 0.1
        self.w[:, DIMENSIONS] = np.log(np.append(v.base, v.group_base))
        self.p = np.ones((CONTEXT, DIMENSIONS), np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.q.ravel(), self.w.ravel(), self.p.ravel()])

    def load(self, flat: np.ndarray) -> LogBilinear:
        q, w, p = np.split(flat, np.cumsum([self.q.size, self.w.size]))
        self.q, self.w, self.p = q.reshape(self.q.shape), w.reshape(self.w.shape), p.reshape(self.p.shape)
        return self

    def predict(self, contexts: np.ndarray) -> np.ndarray:
        """The predicted vectors, with a one for the bias and a zero for the blank."""
        out = np.zeros((len(contexts), WIDTH), np.float32)
        out[:, DIMENSIONS] = 1
        for k in range(CONTEXT):
            out[:, :DIMENSIONS] += self.q.take(contexts[:, k], 0) * self.p[k]
        return out


def contexts_of(numbers: np.ndarray, starts: np.ndarray, before: int) -> np.ndarray:
    """The two numbers before each position; ``before`` ahead of a text's start."""
    out = np.empty((len(numbers), CONTEXT), np.int32)
    first = np.zeros(len(numbers), bool)
    first[starts] = True
    for k in range(CONTEXT):
        out[k + 1 :, k] = numbers[: -k - 1] if k + 1 <= len(numbers) - 1 else numbers[:0]
        out[: k + 1, k] = before
        reach = first.copy()
        for j in range(1, k + 1):
            reach[j:] |= first[:-j]
        out[reach, k] = before
    return out


class Adder:
    """Adds up rows that go to the same place, for places below ``size``."""

    def __init__(self, size: int):
        self.at = np.empty(size, np.int32)

    def __call__(self, index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct places and the sum of the values of each."""
        number = np.arange(len(index), dtype=np.int32)
        self.at[index] = number
        places = index[self.at[index] == number]  # the last of each place
        self.at[places] = number[: len(places)]
        pairs = values.shape[1] // 2  # two floats are added at a time, as one complex number
        out = np.zeros(len(places) * pairs, np.complex64)
        at = self.at[index].astype(np.intp) * pairs
        np.add.at(out, (at[:, None] + np.arange(pairs)).ravel(), values.view(np.complex64).ravel())
        return places, out.view(np.float32).reshape(len(places), -1)


def _put(rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
    """Sets whole rows, each as one item."""
    item = np.dtype((np.void, rows.shape[1] * rows.itemsize))
    rows.view(item)[places, 0] = values.view(item)[:, 0]


def _move(value: np.ndarray, square: np.ndarray, places: np.ndarray, gradient: np.ndarray) -> None:
    """A step along the gradient, shorter for numbers that have moved much."""
    sums = square.take(places, 0)
    sums += gradient * gradient
    _put(square, places, sums)
    sums += np.float32(DAMPING)
    gradient /= np.sqrt(sums, out=sums)
    gradient *= np.float32(RATE)
    gradient += value.take(places, 0)
    _put(value, places, gradient)


def nce_step(model: LogBilinear, squares: LogBilinear, contexts: np.ndarray, heads: list[np.ndarray], noise: np.ndarray, shift: np.ndarray, add_q: Adder, add_w: Adder) -> None:
    """One step. ``heads`` are the rows of ``w`` of the true words and of their groups, ``noise``
    those of noise words and noise groups, which the minibatch shares: each true word is told from
    the former, its group from the latter. ``shift`` is each row's log expected number among the
    noise. Only rows that occur are moved."""
    size = np.float32(1 / len(contexts))
    parts = [model.q.take(contexts[:, k], 0) for k in range(CONTEXT)]
    x = np.zeros((len(contexts), WIDTH), np.float32)
    x[:, DIMENSIONS] = 1
    for k, part in enumerate(parts):
        x[:, :DIMENSIONS] += part * model.p[k]
    others = model.w[noise]
    turned = -others
    turned[:, DIMENSIONS] += shift[noise]
    with np.errstate(over="ignore"):  # the quotient is then the zero that it should be
        false = np.exp(x @ turned.T)
        false += 1
        np.divide(-size, false, out=false)
        back = false @ others
        index, gradients = [noise], [false.T @ x]
        for true in heads:
            rows = model.w.take(true, 0)
            g = size / (1 + np.exp(np.einsum("ij,ij->i", x, rows) - shift[true]))[:, None]
            index.append(true)
            gradients.append(g * x)
            rows *= g
            back += rows
    _move(model.w, squares.w, *add_w(np.concatenate(index), np.concatenate(gradients)))
    back = np.ascontiguousarray(back[:, :DIMENSIONS])
    places = np.stack([np.einsum("ij,ij->j", back, part) for part in parts])
    _move(model.q, squares.q, *add_q(contexts.T.ravel(), np.concatenate([back * model.p[k] for k in range(CONTEXT)])))
    _move(model.p, squares.p, np.arange(CONTEXT), places)


def _numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The unit numbers of all texts of a batch, and where texts start."""
    packed = batch.column("numbers").to_pylist()
    lengths = np.array([len(x) for x in packed], np.int64) // 2
    return np.frombuffer(b"".join(packed), "<u2"), np.cumsum(lengths) - lengths


def train_share(batches: Iterable[pa.RecordBatch], v: Vocabulary, start: bytes, step: int) -> tuple[np.ndarray, int]:
    """The parameters that one pass over a task's share comes to, and its number of positions."""
    model = LogBilinear(v).load(np.frombuffer(start, np.float32).copy())
    squares = LogBilinear(v)
    squares.load(np.zeros_like(squares.flat()))
    add_q, add_w = Adder(len(model.q)), Adder(len(model.w))
    draw, shuffled = np.random.default_rng(step), np.random.default_rng(17 + step)
    shift = np.log(NOISE * np.append(v.base, v.group_base)).astype(np.float32)
    cumulative, of_groups = np.cumsum(v.base), np.cumsum(v.group_base)
    seen = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            numbers, starts = _numbers(batch.slice(at, 512))
            contexts = contexts_of(numbers, starts, v.units)
            seen += len(numbers)
            for k in range(0, len(numbers), PIECE):
                order = k + shuffled.permutation(min(PIECE, len(numbers) - k))
                words, before = numbers.take(order).astype(np.int32), contexts.take(order, 0)
                groups = v.units + v.group.take(words)
                for j in range(0, len(order), MINIBATCH):
                    here = slice(j, j + MINIBATCH)
                    noise = np.minimum(np.searchsorted(cumulative, draw.random(NOISE)), v.units - 1)
                    others = v.units + np.minimum(np.searchsorted(of_groups, draw.random(NOISE)), v.groups - 1)
                    nce_step(model, squares, before[here], [words[here], groups[here]], np.concatenate([noise, others]).astype(np.int32), shift, add_q, add_w)
    return model.flat(), seen


def train_round(coded: DataFrame, vocabulary, parameters, step: int) -> np.ndarray | None:
    """Every task trains on its share of the rows from the given parameters; the mean of what
    they come to. Each round reads every position once, however many rows a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = train_share(batches, vocabulary.value, parameters.value, step)
        if seen:
            parts = [out[k : k + PART].tobytes() for k in range(0, len(out), PART)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(parts, pa.binary()), pa.array(np.full(len(parts), float(seen)))], ["part", "packed", "weight"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, float] = {}
        for batch in batches:
            for part, packed, weight in zip(*(batch[x].to_pylist() for x in ("part", "packed", "weight")), strict=True):
                numbers = np.frombuffer(packed, np.float32).astype(np.float64) * weight
                sums[part] = sums[part] + numbers if part in sums else numbers
                weights[part] = weights.get(part, 0.0) + weight
        packed = [(x / weights[k]).astype(np.float32).tobytes() for k, x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(packed, pa.binary())], ["part", "packed"])

    trained = coded.where(~F.col("held_out")).select("numbers").coalesce(max(1, vocabulary.value.total // SHARE))
    trained = trained.mapInArrow(run, "part int, packed binary, weight double")
    mean = trained.repartition("part").mapInArrow(add, "part int, packed binary").toArrow().sort_by("part")
    if not mean.num_rows:
        return None
    return np.frombuffer(b"".join(mean["packed"].to_pylist()), np.float32)


def _log_sums(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials of the products of each of ``x`` with all rows."""
    scores = x @ rows.T
    if scores.max() < 80:
        sums = np.exp(scores, out=scores) @ np.ones(len(rows), np.float32)
        if sums.min() > 1e-30:
            return np.log(sums)
        scores = x @ rows.T
    top = scores.max(1)
    return top + np.log(np.exp(scores - top[:, None]).sum(1))


class Scorer:
    """Normalised log probabilities: of the word's group, and of the word within the group."""

    def __init__(self, vocabulary: Vocabulary, parameters: bytes | None):
        self.v = vocabulary
        self.model = LogBilinear(vocabulary)
        if parameters is not None:
            self.model.load(np.frombuffer(parameters, np.float32))
        else:
            self.model.q[:] = 0  # nothing learnt: the base

    def log_probabilities(self, numbers: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        out = np.empty(len(numbers))
        for k in range(0, len(numbers), PIECE):
            out[k : k + PIECE] = self._some(numbers[k : k + PIECE], contexts[k : k + PIECE])
        return out

    def _some(self, numbers: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        v, w = self.v, self.model.w
        group = v.group.take(numbers)
        predicted = self.model.predict(contexts)
        out = np.einsum("ij,ij->i", predicted, w.take(v.units + group, 0))
        for k in range(0, len(out), 2048):
            out[k : k + 2048] -= _log_sums(predicted[k : k + 2048], w[v.units :])
        order = np.argsort(group.astype(np.uint16), kind="stable")
        ends = np.searchsorted(group[order], np.arange(v.groups + 1))
        for g in np.flatnonzero((np.diff(ends) > 0) & (np.diff(v.first) > 1)):  # a word alone is certain
            inside = w[v.first[g] : v.first[g + 1]]
            step = max(1, (1 << 20) // len(inside))
            for k in range(ends[g], ends[g + 1], step):
                at = order[k : min(k + step, ends[g + 1])]
                x = predicted.take(at, 0)
                out[at] += np.einsum("ij,ij->i", x, w.take(numbers[at], 0)) - _log_sums(x, inside)
        return out


def coded_rows(rows: DataFrame, vocabulary) -> DataFrame:
    """Each row with its id, ``held_out``, ``n_tokens``, ``n_frequent`` (tokens that the broadcast
    counts), ``base`` (their log counts), ``fixed`` (log shares within classes), ``numbers`` (packed
    unit numbers) and its other tokens, ``rare`` and their ``times``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary.value
        sizes, codes, distinct = coded_words(batch.column("text"))
        h = np.append(word_hashes(distinct), _END)
        lengths = sizes + 1
        starts = np.cumsum(lengths) - lengths
        number = np.full(len(codes) + len(sizes), len(h) - 1)  # of the distinct token
        inside = np.ones(len(number), bool)
        inside[starts + sizes] = False
        number[inside] = codes
        place = v.places(h).take(number)
        counted = place >= 0
        numbers = v.unit[place]
        base = np.append(np.log(v.c + 0.5), 0.0)[place]  # -1 takes the 0 behind the last
        fixed = np.where(numbers >= v.words, base - np.log(v.denominator) - v.log_base[numbers], 0.0)
        sums = [np.add.reduceat(x, starts) for x in (counted.astype(np.int64), base, fixed)]
        owner, tokens = np.repeat(np.arange(len(lengths)), lengths)[~counted], h.take(number[~counted])
        order = np.lexsort((tokens, owner))
        owner, tokens = owner[order], tokens[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1]))[: len(owner)])
        times = np.diff(np.append(first, len(owner)))
        offsets = pa.array(np.searchsorted(owner[first], np.arange(len(lengths) + 1)), pa.int32())
        packed = [numbers[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        columns = [
            batch.column("id"), batch.column("held_out"), pa.array(lengths), *map(pa.array, sums), pa.array(packed, pa.binary()),
            pa.ListArray.from_arrays(offsets, pa.array(tokens[first])), pa.ListArray.from_arrays(offsets, pa.array(times)),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_frequent", "base", "fixed", "numbers", "rare", "times"])

    kind = rows.schema["id"].dataType.simpleString()
    coded = map_batches(rows, run, f"id {kind}, held_out boolean, n_tokens bigint, n_frequent bigint, base double, fixed double, numbers binary, rare array<bigint>, times array<bigint>", 1024)
    return coded.withColumn("row", F.monotonically_increasing_id())


def log_scores(df: DataFrame, id_column: str = "doc_id", text: str = "text", folds: int = 5, fold: int = 1, size: int = VOCABULARY, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """One row per row: the id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, in log10. ``size`` is at most 65,536."""
    if size > 1 << 16:
        raise ValueError("numbers of units have 16 bits")
    spark = df.sparkSession
    scratch = Scratch(spark)
    rows = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), held_out(id_column, folds, fold).alias("held_out"))

    counts = scratch.save(token_counts(rows.where(~F.col("held_out"))), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    vocabulary = Vocabulary(*frequent_tokens(counts, frequent), int(total["n"]), int(total["v"]), size, CLASSES, LEAST)
    shared, key = spark.sparkContext.broadcast(vocabulary), uuid.uuid4().hex
    coded = scratch.save(coded_rows(rows, shared), "coded")

    learnt: np.ndarray | None = None
    current = LogBilinear(vocabulary).flat()
    for step in range(rounds):
        new = train_round(coded, shared, spark.sparkContext.broadcast(current.tobytes()), step)
        if new is not None:
            learnt = current = new
    parameters = spark.sparkContext.broadcast(None if learnt is None else learnt.tobytes())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = worker_state("language model", key, lambda: Scorer(shared.value, parameters.value))
        numbers, starts = _numbers(batch)
        logs = scorer.log_probabilities(numbers, contexts_of(numbers, starts, shared.value.units))
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(np.add.reduceat(logs, starts))], [*kept, "logs"])

    kept = ["row", "id", "held_out", "n_tokens", "n_frequent", "base", "fixed"]
    kinds = ", ".join(f"{x} {coded.schema[x].dataType.simpleString()}" for x in kept)
    scored = map_batches(coded.select(*kept, "numbers"), run, f"{kinds}, logs double", 512)

    pairs = coded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    found = pairs.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_log"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
    )
    out = scored.join(found, "row", "left")
    rare, known, ten = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0)), float(np.log(10))
    return out.select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + known).alias("n_known"),
        F.lit(int(total["n"])).cast("bigint").alias("train_tokens"),
        ((F.col("base") + rare - F.col("n_tokens") * float(np.log(vocabulary.denominator))) / ten).alias("base_score"),
        ((F.col("logs") + F.col("fixed") + rare) / ten).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: log-bilinear scores of every row of ``documents``."""
    return log_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
