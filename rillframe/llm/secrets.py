"""Secret scans: pattern candidates, and decoded candidates that are confirmed by their structure.

Three base kinds come from patterns alone: ``assign`` (a secret's name, a sign and a value of 8
characters or more), ``access`` (access key ids of 16 characters or more) and ``hex`` (32 or more
lower-case hex digits). The other kinds are reported only after a base64 or hex candidate has
been decoded and what comes out has the structure of a key:

* ``jwt``: a signed token whose header is a JSON object that names an algorithm and whose payload
  is a JSON object;
* ``pem``: an armoured block whose body decodes to one of the encodings below;
* ``der``: nested tag-length-value records, lengths of which add up at every level, with a
  number, a bit or octet string or an object identifier inside;
* ``ssh``: length-prefixed fields that begin with the name of a key type or the magic of a
  private key file and end with the last byte.

A run of base64 characters that isn't a key as a whole may hold one between the characters ``/``,
``_`` and ``-``, as paths and names do: from the run's beginning and behind each of these, the
encoding's own lengths tell where a key would end, and it counts if that is at another of them or
at the run's end and its structure holds.

Offsets are code points, ends exclusive; spans are ordered by start, then by kind as listed.
Null and empty texts have no spans. Very long texts are scanned whole, in time linear in their
length. Rows are independent, so repeated rows, null ids and empty tables need no special care;
other columns aren't looked at.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import map_batches, texts

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "ssh")

_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # greedy, so the same as whole runs of 32 or more
_ANY_HEX = re.compile(r"(?:0[xX])?((?:[0-9A-Fa-f]{2})+)")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[^-]+|-(?!----))++)-----END \1-----")  # headers may have hyphens
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{22,}={0,2}")
_SHORTEST = 22  # characters, without padding, of the shortest key encoding and so of any candidate
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ssh-ed448", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com")
_SSH_MAGIC = b"openssh-key-v1\0"


def decode_base64(run: str) -> bytes | None:
    """Strict base64 in the standard or the URL alphabet, padding optional."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der(data: bytes, begin: int, end: int, depth: int) -> tuple[int, int] | None:
    """Numbers of records and of key-like records in ``data[begin:end]``, or None if lengths don't add up."""
    records = telling = 0
    at = begin
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if tag & 0x1F == 0x1F:
            return None
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        records += 1
        telling += tag in (0x02, 0x03, 0x04, 0x06) and size > 0
        if tag & 0x20:
            if depth > 12 or (inner := _der(data, at, at + size, depth + 1)) is None:
                return None
            records, telling = records + inner[0], telling + inner[1]
        at += size
    return records, telling


def is_der(data: bytes) -> bool:
    if len(data) < 16 or data[0] != 0x30:
        return False
    found = _der(data, 0, len(data), 0)
    return found is not None and found[0] >= 3 and found[1] >= 2


def _fields(data: bytes, at: int) -> list[bytes] | None:
    out = []
    while at < len(data):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return None
        out.append(data[at : at + size])
        at += size
    return out


def is_ssh(data: bytes) -> bool:
    if data.startswith(_SSH_MAGIC):
        at, sizes = len(_SSH_MAGIC), []
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data):
                return False
            sizes.append(int.from_bytes(data[at : at + 4], "big"))
            at += 4 + sizes[-1]
        rest = _fields(data, at + 4)  # after the number of keys
        return rest is not None and len(rest) >= 2
    fields = _fields(data, 0)
    return fields is not None and len(fields) >= 2 and fields[0] in _SSH_TYPES


def _json_object(part: str) -> dict | None:
    data = decode_base64(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_jwt(header: str, payload: str) -> bool:
    head = _json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and _json_object(payload) is not None


def _armoured(body: str) -> bool:
    body = re.sub(r"(?:\\r)?\\n|\\r", "\n", body)  # line ends as JSON and .env files write them
    lines = [x for x in body.split("\n") if ":" not in x]
    data = decode_base64(re.sub(r"\s+", "", "".join(lines)))
    return data is not None and (is_der(data) or is_ssh(data))


_BETWEEN = re.compile(r"[/_-]")
_HEX_PART = re.compile(r"(?<![^/_-])(?:0[xX])?((?:[0-9A-Fa-f]{2})+)(?![^/_-])")


def _peek(body: str, start: int, at: int, n: int) -> bytes:
    """Bytes ``at`` to ``at + n`` of what the characters from ``start`` on encode, or fewer at its end."""
    first = start + at // 3 * 4
    part = body[first : start + (at + n + 2) // 3 * 4]
    data = decode_base64(part[: len(part) - 1] if len(part) % 4 == 1 else part) or b""
    return data[at % 3 : at % 3 + n]


def _ends(body: str, start: int) -> Iterator[int]:
    """Where a key that begins at a place may end, in bytes from there."""
    head = _peek(body, start, 0, 16)
    if head[:1] == b"\x30" and len(head) >= 6:
        n = head[1] & 0x7F if head[1] & 0x80 else 0
        if n <= 4:
            yield 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1])
        return
    if head[:15] == _SSH_MAGIC:
        at, fields = len(_SSH_MAGIC), -1  # a number of keys stands among the fields
    elif head[:4] < b"\x00\x00\x00\x40" and any(_peek(body, start, 4, len(t)) == t for t in _SSH_TYPES):
        at, fields = 0, 0
    else:
        return
    while len(size := _peek(body, start, at, 4)) == 4:
        at, fields = at + 4 + (0 if fields == 2 and head[:15] == _SSH_MAGIC else int.from_bytes(size, "big")), fields + 1
        if at * 4 > (len(body) - start) * 3:
            return
        if fields >= 2:
            yield at


def keys_inside(run: str) -> Iterator[tuple[str, int, int]]:
    """Keys between the characters that part names and paths, none of which overlap."""
    body, taken = run.rstrip("="), 0
    for m in _HEX_PART.finditer(run):
        if len(m[1]) >= _SHORTEST:
            data = bytes.fromhex(m[1])
            for kind, fits in (("der", is_der), ("ssh", is_ssh)):
                if fits(data):
                    yield kind, *m.span()
    for start in (0, *(m.end() for m in _BETWEEN.finditer(body))):
        if start < taken or len(body) - start < _SHORTEST:
            continue
        for size in _ends(body, start):
            end = start + -(-size * 4 // 3)
            if end == len(body) or (end < len(body) and body[end] in "/_-"):
                data = decode_base64(body[start:end]) or b""
                kind = "der" if is_der(data) else "ssh" if is_ssh(data) else None
                if kind is not None:
                    taken = len(run) if end == len(body) else end
                    yield kind, start, taken
                    break


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text: kind, start, end."""
    found: list[tuple[str, int, int]] = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        found += (("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8)
    if "AKIA" in text:
        found += (("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16)
    if "-----BEGIN " in text:
        found += (("pem", *m.span()) for m in _PEM.finditer(text) if _armoured(m[2]))
    if "eyJ" in text:
        found += (("jwt", *m.span()) for m in _JWT.finditer(text) if is_jwt(m[1], m[2]))
    # No pattern below matches across white space or less than this, so texts of short words alone need no search.
    if max(map(len, text.split()), default=0) >= _SHORTEST:
        found += (("hex", *m.span()) for m in _HEX.finditer(text))
        for m in _RUN.finditer(text):
            data = decode_base64(m[0])
            digits = _ANY_HEX.fullmatch(m[0])
            if digits and not (data and (is_der(data) or is_ssh(data))):
                data = bytes.fromhex(digits[1])
            whole = [(kind, *m.span()) for kind, fits in (("der", is_der), ("ssh", is_ssh)) if data and fits(data)]
            found += whole or ((kind, m.start() + a, m.start() + b) for kind, a, b in keys_inside(m[0]))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: the id and ``spans``, an array of (kind, start, end)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in scan(t)] for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], ["id", "spans"])

    chosen = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    out = map_batches(chosen, run, f"id {chosen.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_column)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: counts and digests of the secrets in every row of ``documents``."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
