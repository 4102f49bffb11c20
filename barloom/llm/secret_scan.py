"""Secret scan with structural confirmation.

Three textual kinds are reported as they match. A base64 or hex run is reported
only if what it decodes to has the structure of a key: nested DER lengths that
add up, an OpenSSH private key, or a signed token whose header names an
algorithm.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.common import arrow_map, batch_of, narrowed, text_slices

# The textual patterns and their least lengths.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_ASSIGN_VALUE = 6

JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]*?)-----END \1-----")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
KEY_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{60,}")
KINDS = ("assign", "access", "hex", "jwt", "pem", "key")

SEQUENCE, INTEGER, BIT_STRING, OCTETS, OBJECT_ID = 0x30, 0x02, 0x03, 0x04, 0x06
OPENSSH = b"openssh-key-v1\x00"


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed.

    Null text is empty; without spans both strings are empty (base_sha256 is
    then the digest of an empty string). Repeated rows each get their row;
    other columns are not read. Offsets are code points, the end exclusive.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return arrow_map(narrowed(docs, "doc_id", "text"), _scan, schema)


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64())]
    + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64())]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches):
        rows = []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            base, extra = base_spans(text), confirmed_spans(text)
            counts = [sum(kind == k for k, _, _ in base) for kind in range(3)]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + extra), len(extra)))
        yield batch_of(FOUND, batch.column("doc_id").cast(pa.int64()), *zip(*rows))


def joined(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted((a, k, b) for k, a, b in spans))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGN_VALUE]
    found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans whose decoded bytes have the structure of a token or key."""
    found = [(3, m.start(), m.end()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    found += [(4, m.start(), m.end()) for m in PEM.finditer(text) if is_key(_base64("".join(m[2].split())))]
    # whether one of these spans covers a run: of those that begin before it, the furthest end
    spans = sorted((a, b) for _, a, b in found)
    starts, ends = [a for a, _ in spans], list(itertools.accumulate((b for _, b in spans), max))
    for pattern, decode in ((BASE64, _base64), (KEY_HEX, _hex)):
        for m in pattern.finditer(text):
            before = bisect.bisect_right(starts, m.start())
            if not (before and ends[before - 1] >= m.end()) and is_key(decode(m[0])):
                found.append((5, m.start(), m.end()))
    return found


def _base64(text: str) -> bytes:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _hex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) & ~1])


def is_signed_token(text: str) -> bool:
    """header.payload.signature: both JSON objects, an algorithm, and a signature unless the algorithm is none."""
    header, payload, signature = text.split(".")
    try:
        head, body = json.loads(_base64(header)), json.loads(_base64(payload))
    except (ValueError, RecursionError):
        return False
    if not (isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)):
        return False
    return head["alg"].lower() == "none" or len(_base64(signature)) >= 16


def is_key(data: bytes) -> bool:
    if data.startswith(OPENSSH):
        return _openssh_fields(data) >= 4
    return _private_shape(data)


def _openssh_fields(data: bytes) -> int:
    """Length-prefixed fields after the magic that fit: cipher, kdf, its options, then the number of keys."""
    at, fields = len(OPENSSH), 0
    for _ in range(3):
        if at + 4 > len(data):
            return fields
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return fields
        fields += 1
    return fields + (at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16)


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element if they fill ``data`` exactly, with lengths in their shortest form."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            length, at = int.from_bytes(data[at : at + width], "big"), at + width
            if length < 0x80 or length >> (8 * (width - 1)) == 0:
                return None
        if at + length > len(data):
            return None
        items.append((tag, data[at : at + length]))
        at += length
    return items


def _private_shape(data: bytes) -> bool:
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE:
        return False
    parts = der_items(outer[0][1])
    if not parts or len(parts) < 2:
        return False
    tags = [tag for tag, _ in parts]
    if tags[0] == INTEGER and len(parts[0][1]) == 1:
        if len(parts) >= 9 and set(tags[:9]) == {INTEGER}:  # RSA: version and eight numbers
            return len(parts[1][1]) >= 32
        if tags[:3] == [INTEGER, SEQUENCE, OCTETS]:  # PKCS 8: version, algorithm, wrapped key
            named = der_items(parts[1][1])
            return bool(named) and named[0][0] == OBJECT_ID and len(parts[2][1]) >= 16
        if tags[:2] == [INTEGER, OCTETS]:  # elliptic curve: version, secret, then tagged curve and point
            return len(parts[1][1]) in (20, 24, 28, 32, 48, 66) and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [SEQUENCE, OCTETS]:  # encrypted PKCS 8
        named = der_items(parts[0][1])
        return bool(named) and named[0][0] == OBJECT_ID and len(parts[1][1]) >= 16
    return False
