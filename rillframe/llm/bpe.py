"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a pre-token has one BPE encoding, and that encoding's last token fixes it: the
tokens before are the encoding of the shorter prefix. So for every prefix only its last token is
stored. A token that ends there is the right one if it is compatible with the last token of the
prefix that it leaves, that is, if BPE would never merge across their border. All tokens that
end at a position come from one automaton over the vocabulary; back-pointers then give the ids.
The work is linear in the pre-token's length, whatever its length.

Nulls count as empty texts; empty texts have no ids and decode to the empty text. Rows are
independent: repeated rows, null ids and empty tables need no special care, and columns other
than the id and the text aren't looked at.
"""

from __future__ import annotations

import struct
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from rillframe.llm import pretoken
from rillframe.llm.common import map_batches, texts, worker_state

VOCABULARY = "byte_bpe_50k.json"
#: Rows that a worker holds at a time between the columns it reads and those it returns.
SLICE = 256


class PrefixBPE:
    """Exact BPE for a byte-level vocabulary in the ``tokenizers`` format."""

    def __init__(self, name: str = VOCABULARY):
        data = pretoken.load_vocabulary(name)
        vocab: dict[str, int] = data["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.specials = pretoken.special_tokens(name)
        letters = pretoken.byte_letters()
        self._letters = str.maketrans({chr(b): x for b, x in enumerate(letters)})
        back = {x: b for b, x in enumerate(letters)}

        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.rank = [-1] * size  # of the merge that makes a token; -1 for single bytes
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.pair_rank: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(merges):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.pair_rank.setdefault((a, b), rank)
            if self.rank[c] < 0:
                self.rank[c], self.parts[c] = rank, (a, b)
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[x] for x in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()

        self.length = [len(x) for x in self.bytes_of]

        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            if self.rank[i] >= 0 and not self._compatible(*self.parts[i], self.rank[i]):
                continue  # BPE never gets to this token
            if self.rank[i] >= 0 or len(token) == 1:
                self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        self._known: dict[tuple[int, int], bool] = {}
        self.pretokens = pretoken.UnitCache(self.encode_pretoken, limit=100_000)
        self.first = pretoken.UnitCache(self._encode_unit, limit=20_000)
        self.spaced = pretoken.UnitCache(lambda unit: self._encode_unit(" " + unit), limit=150_000)

    def _compatible(self, left: int, right: int, limit: int) -> bool:
        """Whether BPE on both tokens' bytes arrives at just these two tokens.

        The merges on either side are undone from the last to the first. Wherever the symbols
        that meet at the border could have merged before the merge that was undone last, BPE
        would have done that. Of equal merges the leftmost comes first, so a merge across the
        border wins against an equal one on its right and loses against one on its left.
        """
        rank, parts, pair_rank = self.rank, self.parts, self.pair_rank
        while True:
            crossing = pair_rank.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                limit, left = a, parts[left][1]
            elif b >= 0:
                limit, right = b + 1, parts[right][0]
            else:
                return True

    def encode_pretoken(self, piece: str) -> tuple[int, ...]:
        """Fills ``last``, the last token of every prefix, and follows it back from the end."""
        word = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters)
        last, known, done = [0] * len(word), self._known, -1
        for end, (token, length) in self.automaton.iter(word):
            if end == done:
                continue  # no other token can end here
            begin = end - length
            if begin >= 0:
                pair = (last[begin], token)
                fits = known.get(pair)
                if fits is None:
                    if len(known) > 300_000:
                        known.clear()
                    fits = known[pair] = self._compatible(*pair, 1 << 60)
                if not fits:
                    continue
            last[end], done = token, end
        ids, at, size = [], len(word) - 1, self.length
        while at >= 0:
            ids.append(last[at])
            at -= size[last[at]]
        ids.reverse()
        return tuple(ids)

    def _encode_unit(self, unit: str) -> bytes:
        pieces = pretoken.PATTERN.findall(unit)
        if len(pieces) == 1:
            ids = self.encode_pretoken(pieces[0])
        else:
            ids = tuple(chain.from_iterable(map(self.pretokens.__getitem__, pieces)))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for part in pretoken.segments(text, self.specials):
            if isinstance(part, int):
                out.append(part.to_bytes(4, "little"))
            elif not part:
                continue
            elif pretoken.tangled(part):
                out += map(self._pretoken_bytes, pretoken.PATTERN.findall(part))
            else:
                head, *units = part.split(" ")
                out.append(self.first[head])
                out += map(self.spaced.__getitem__, units)
        return b"".join(out)

    def _pretoken_bytes(self, piece: str) -> bytes:
        if piece[0] == " " and len(piece) > 1 and not piece.isspace():
            return self.spaced[piece[1:]]
        return self.first[piece]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def worker_bpe(vocabulary: str) -> PrefixBPE:
    """One encoder a worker, kept between tasks."""
    return worker_state("bpe", vocabulary, lambda: PrefixBPE(vocabulary))


def encode(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row: the id, ``n_tokens`` and ``ids``, the token ids as packed little-endian
    unsigned 32-bit integers (:func:`unpack` makes an array of them)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = list(map(worker_bpe(vocabulary).encode, texts(batch)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    chosen = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    out = map_batches(chosen, run, f"id {chosen.schema['id'].dataType.simpleString()}, n_tokens bigint, ids binary", SLICE)
    return out.withColumnRenamed("id", id_column)


def decode(df: DataFrame, id_column: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row: the id and ``text``, what the packed ids stand for, special tokens too."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = worker_bpe(vocabulary)
        out = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])

    chosen = df.select(F.col(id_column).alias("id"), F.col(ids).alias("ids"))
    return map_batches(chosen, run, f"id {chosen.schema['id'].dataType.simpleString()}, text string", SLICE).withColumnRenamed("id", id_column)


def round_trip(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Encodes and decodes in one pass: the id, ``n_tokens``, ``ids`` and ``decoded``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = worker_bpe(vocabulary)
        ids = list(map(bpe.encode, texts(batch)))
        columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"])

    chosen = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    out = map_batches(chosen, run, f"id {chosen.schema['id'].dataType.simpleString()}, n_tokens bigint, ids binary, decoded string", SLICE)
    return out.withColumnRenamed("id", id_column)


@F.udf(ArrayType(LongType()), useArrow=True)
def unpack(ids: bytes) -> list[int]:
    """Packed ids as an array; null stays null."""
    return None if ids is None else np.frombuffer(ids, "<u4").tolist()


def query(spark, sf_dir: str) -> DataFrame:
    """op5: digests of the ids and of the decoded text, for every row of ``documents``."""
    out = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
