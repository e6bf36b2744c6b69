"""Secret scan with structural confirmation (operator 10).

Base kinds are patterns. The method looks for encoded material and reports a
candidate only if its bytes parse as what it claims to be:

* ``jwt``: three dot-separated base64url parts; the first decodes to a JSON
  object with a string ``alg`` (or ``enc``), the second to a JSON object
  (signed) or to bytes (encrypted, five parts).
* ``der``: base64 (PEM bodies included, line breaks skipped) or hex that decodes
  to an ASN.1 sequence whose outer and nested lengths fill the bytes exactly and
  which holds a key: an integer version 0..3 followed by an integer, octet string or
  algorithm sequence, or an algorithm sequence followed by a bit string.
* ``ssh``: base64 that decodes to length-prefixed fields of which the first
  names a key type (``ssh-...``, ``ecdsa-...``, ``sk-...``), or to the private-key envelope
  ``openssh-key-v1``.

Spans are (kind, start, end) in code points, end exclusive. Found spans of the
base kinds always stay; a confirmed candidate is reported under its own kind.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.llm.base import query, read

KINDS = ("assign", "access", "hex", "der", "jwt", "ssh")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: Assignments, keys of 20 or more and runs of 24 or more of the leftmost patterns: a shorter run never blocks a later match.
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])ey[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*){2,4}")
#: Lines of a wrapped body, of which the last may be short, and lines that only follow it; :func:`encoded_spans` finds where a body starts and ends.
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?:\r?\n(?!-----)[A-Za-z0-9+/_-]{16,})*(?:\r?\n(?!-----)[A-Za-z0-9+/_-]{1,15})?={0,2}")
ENCODED_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
HEX_BYTES = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){24,}(?![0-9A-Za-z])")
KEY_NAMES = (b"ssh-", b"ecdsa-", b"sk-")
OPENSSH = b"openssh-key-v1\x00"


def decoded(text: str) -> bytes | None:
    """Standard or url-safe base64, padding optional."""
    raw = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Top-level (tag, content) pairs that fill ``data`` exactly; None if the lengths don't."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at:at + n], "big"), at + n
        if at + size > len(data):
            return None
        out.append((tag, data[at:at + size]))
        at += size
    return out


def is_key(data: bytes | None) -> bool:
    """An ASN.1 sequence shaped like a private or public key, nested lengths included."""
    top = elements(data) if data and data[0] == 0x30 else None
    if not top or len(top) != 1:
        return False
    parts = elements(top[0][1])
    if not parts or len(parts) < 2:
        return False
    (first, a), (second, b) = parts[:2]
    if first == 0x30 and second == 0x03:  # algorithm, bit string
        inner = elements(a)
        return bool(inner) and inner[0][0] == 0x06 and b[:1] == b"\x00"
    if first != 0x02 or len(a) < 1:
        return False
    if len(a) == 1 and a[0] <= 3:
        if second == 0x30:  # version, algorithm, octet string
            inner = elements(b)
            return bool(inner) and inner[0][0] == 0x06 and len(parts) > 2 and parts[2][0] == 0x04
        if second == 0x04:  # version, octet string
            return len(b) >= 16
        return second == 0x02 and len(parts) >= 6 and all(t == 0x02 for t, _ in parts[:6])
    return second == 0x02 and len(parts) == 2 and len(a) >= 32  # modulus, exponent


def is_ssh(data: bytes | None) -> bool:
    if not data:
        return False
    if data.startswith(OPENSSH):
        return True
    at, fields = 0, []
    while at + 4 <= len(data):
        size = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4:at + 4 + size])
        at += 4 + size
    return at == len(data) and len(fields) >= 2 and fields[0].startswith(KEY_NAMES)


def is_jwt(text: str) -> bool:
    parts = text.split(".")
    if len(parts) not in (3, 5):
        return False
    try:
        header = json.loads(decoded(parts[0]) or b"")
        body = json.loads(decoded(parts[1]) or b"") if len(parts) == 3 else {}
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(body, dict) and isinstance(header.get("alg"), str) and (len(parts) == 3 or isinstance(header.get("enc"), str))


def fields_end(data: bytes, at: int, count: int) -> int | None:
    """Where ``count`` length-prefixed fields end; None if the data end before."""
    for _ in range(count):
        at += 4 + int.from_bytes(data[at:at + 4], "big")
        if at > len(data):
            return None
    return at


def possible_ends(data: bytes) -> list[int]:
    """Numbers of bytes after which a structure that starts ``data`` may end."""
    if data[:1] == b"\x30" and len(data) > 6:
        n = data[1] & 0x7F if data[1] & 0x80 else 0
        return [2 + n + (int.from_bytes(data[2:2 + n], "big") if n else data[1])] if n <= 4 else []
    if data.startswith(OPENSSH):  # cipher, derivation and its options, number of keys, public keys, private part
        at = fields_end(data, len(OPENSSH), 3)
        end = at and fields_end(data, at + 4, min(int.from_bytes(data[at:at + 4], "big"), len(data)) + 1)
        return [end] if end else [len(data)]
    if not data[4:].startswith(KEY_NAMES):
        return []
    ends, at = [], 0
    while at + 4 <= len(data) and (at := fields_end(data, at, 1)):
        ends.append(at)
    return ends[1:]


def encoded_spans(m: re.Match) -> list[tuple[str, int, int]]:
    """The confirmed keys of a run of base64 lines: each from the start of a line to the end of the same or a later one."""
    lines = [(m.start() + x.start(), x[0]) for x in ENCODED_LINE.finditer(m[0])]
    out, i = [], 0
    while i < len(lines):
        start, first = lines[i]
        after, i = i + 1, i + 1
        if len(first) < 32 or not (head := decoded(first[:32])) or not (head[0] == 0x30 or head.startswith(OPENSSH) or head[4:].startswith(KEY_NAMES)):
            continue
        body = "".join(x for _, x in lines[after - 1:])
        data = decoded(body[:-1] if len(body) % 4 == 1 else body)
        ends, chars = set(possible_ends(data)), 0
        found = None
        for j, (at, line) in enumerate(lines[after - 1:], after - 1):
            chars += len(line)
            size = chars * 6 // 8
            if chars % 4 != 1 and size in ends and (kind := "der" if is_key(data[:size]) else "ssh" if is_ssh(data[:size]) else None):
                found, i = (kind, start, m.end() if j == len(lines) - 1 else at + len(line)), j + 1
        if found:
            out.append(found)
    return out


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans, by start, then kind in the order of ``KINDS``."""
    text = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "ey" in text:
        out += [("jwt", *m.span()) for m in JWT.finditer(text) if is_jwt(m[0])]
    for m in ENCODED.finditer(text):
        out += encoded_spans(m)
    out += [("der", *m.span()) for m in HEX_BYTES.finditer(text) if m[0][:2] == "30" and is_key(bytes.fromhex(m[0]))]
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "array<struct<kind:string,start:int,end:int>>"
DIGESTS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def span_lists(texts: pd.Series) -> pd.Series:
    """Spans of a text column; null and empty texts have none."""
    return texts.map(lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)], na_action=None)


def _digests(texts: pd.Series) -> pd.DataFrame:
    def one(text):
        spans = find_spans(text)
        base = [s for s in spans if s[0] in BASE]
        return (*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))
    return pd.DataFrame([one(t) for t in texts], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with column ``secret_spans``, one narrow pass without a shuffle.

    Defined cases: null and empty texts have no spans; repeated rows are scanned
    alike; other columns pass through; an empty table stays empty.
    """
    return docs.withColumn("secret_spans", F.pandas_udf(span_lists, SPANS)(F.col(text)))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.pandas_udf(_digests, DIGESTS)("text").alias("x")).select("doc_id", "x.*")
