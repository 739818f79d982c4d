"""Secret scans with structural confirmation.

The base reports assignments, access keys and hex runs by pattern. Beyond it, runs of base64 or hex
characters are candidates that are reported only if what they decode to has the structure of a key:

* jwt: three base64url segments whose first is a JSON object with an "alg" and whose second is JSON,
* der: an ASN.1 SEQUENCE whose nested lengths fill their parents exactly, down to every leaf, and that begins like a
  key (an INTEGER or an algorithm SEQUENCE with an object identifier) and holds key material,
* ssh: the "openssh-key-v1" container, or length-prefixed fields of which the first names a known algorithm.

A decoded run that is itself base64 or hex text is decoded again, DEPTH times in all; keys encoded more
often, or nested deeper than MAX_NESTING, aren't confirmed. A candidate is a whole run: what is glued to
further characters of its alphabet isn't one. Offsets are code points, ends exclusive. Time and memory grow
in proportion to a text's length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents

KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
BASE = KINDS[:3]
# fixed values: the patterns of the base
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# runs are matched from their first character on and given back nowhere, so a run of any length is read once
JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{60,80}\r?\n)+[A-Za-z0-9+/]{2,}={0,2}")
HEX_RUN = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
SSH_NAMES = (b"ssh-rsa", b"ssh-ed25519", b"ssh-dss", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
MIN_KEY_BYTES, DEPTH, MAX_NESTING = 24, 2, 16


def _b64(run: str) -> bytes | None:
    body = run.rstrip("=").translate({45: 43, 95: 47, 10: None, 13: None})
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_leaves(data: bytes, lo: int = 0, hi: int | None = None, depth: int = 0) -> list[tuple[int, int]] | None:
    """(tag, content bytes) of the elements in data[lo:hi] and below, or None unless their lengths fill it exactly."""
    hi, out = len(data) if hi is None else hi, []
    while lo < hi:
        if hi - lo < 2 or depth > MAX_NESTING:
            return None
        tag, n, at = data[lo], data[lo + 1], lo + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > hi or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + size], "big")
            at += size
            if n < 0x80:
                return None
        if at + n > hi:
            return None
        out.append((tag, n))
        if tag & 0x20:
            below = der_leaves(data, at, at + n, depth + 1)
            if below is None:
                return None
            out += below
        lo = at + n
    return out


def is_der_key(data: bytes) -> bool:
    if len(data) < MIN_KEY_BYTES or data[0] != 0x30:
        return False
    found = der_leaves(data)
    if not found or found[0][1] < MIN_KEY_BYTES - 4 or len(found) < 3:
        return False
    first = found[1][0]
    material = any(tag in (0x02, 0x03, 0x04) and n >= 16 for tag, n in found)
    return material and (first == 0x02 or first == 0x30 and found[2][0] == 0x06)


def is_ssh_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        return True
    at, fields = 0, []
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return at == len(data) and len(fields) >= 2 and fields[0] in SSH_NAMES


def is_jwt(token: str) -> bool:
    parts = token.split(".")
    try:
        head, body = (json.loads(_b64(p) or b"") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def confirmed(data: bytes | None, depth: int = 1) -> str | None:
    """The kind of key that data encodes."""
    if data is None or len(data) < MIN_KEY_BYTES:
        return None
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    if depth < DEPTH:
        try:
            inner = data.decode("ascii").strip()
        except UnicodeDecodeError:
            return None
        if HEX_RUN.fullmatch(inner):
            return confirmed(bytes.fromhex(inner), depth + 1)
        if BASE64.fullmatch(inner):
            return confirmed(_b64(inner), depth + 1)
        if JWT.fullmatch(inner) and is_jwt(inner):
            return "jwt"
    return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) by pattern, in order."""
    out = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def structural_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of candidates whose structure is confirmed."""
    out = set()
    m = JWT.search(text) if "." in text and ("ey" in text or "ew" in text) else None  # {" or { and white space
    while m:
        if found := is_jwt(m[0]):
            out.add((m.start(), 3, m.end()))
        m = JWT.search(text, m.end() if found else text.index(".", m.start()) + 1)  # a token may begin at the next segment
    taken = []
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        # the last line may be the text that follows
        for end in (m.end(), m.start() + len(m[0][: m[0].rindex("\n")].rstrip("\r"))):
            if kind := confirmed(_b64(text[m.start() : end])):
                out.add((m.start(), KINDS.index(kind), end))
                taken.append((m.start(), end))
                break
    for pattern, decode in ((HEX_RUN, bytes.fromhex), (BASE64, _b64)):
        new, at, reach = [], 0, 0  # reach: the furthest end of what was taken up to here
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][0] <= m.start():
                reach = max(reach, taken[at][1])
                at += 1
            if m.end() > reach and (kind := confirmed(decode(m[0]))):
                out.add((m.start(), KINDS.index(kind), m.end()))
                new.append((m.start(), m.end()))
        taken = sorted(taken + new)
    return sorted(out)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for lo in range(0, big.num_rows, 512):
            batch, rows = big.slice(lo, 512), []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted({*base, *structural_spans(text or "")}))))
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(zip(*rows), types))], [f.split()[0] for f in OUT.split(", ")])


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): counts of the base kinds, its digest, and all spans.

    A null text counts as empty and has none. Repeated rows come back repeated. Spans with one start are ordered
    as KINDS. Other columns are ignored, whatever their names; an empty table gives an empty one.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, OUT)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_spans(documents(spark, sf_dir).select("doc_id", "text"))
