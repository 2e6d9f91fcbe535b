"""Secret scan with structural confirmation.

Three base patterns are reported as they match. Candidates for whole keys and
tokens (long base64 or hex runs, base64 wrapped over lines, key blocks between BEGIN and END lines, three-part
signed tokens; line breaks may be written as backslash and n, as in JSON) are only reported if their content decodes and parses: nested DER lengths
that fill their frame exactly, the fields of an SSH key blob, a signed-token header
that is a JSON object with an algorithm.

Kinds, in the order of `spans`: assign, access, hex (base), der, ssh, jwt (confirmed).
Positions are code points, ends exclusive.

Defined cases: null or empty text has no spans; repeated rows are scanned each; a very
long text is scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]{24,}", re.A)  # a run of fewer has no match inside it either
#: A JSON object starts with an opening brace, hence `e` and one of its successors.
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(e[w-z0-9_-][A-Za-z0-9_-]{10,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]+)", re.A)
BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:[A-Za-z0-9+/=\s]|\\[nr])+)-----END \1-----", re.A)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}", re.A)
#: Lines of base64, all but the last of 40 characters or more.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{40,}+(?:\r?\n[\x20\t]*|(?:\\r)?\\n))+[A-Za-z0-9+/_-]+={0,2}", re.A)
LINE = re.compile(r"(?:^|(?<=\\n)|(?<=[\n\x20\t]))[A-Za-z0-9+/_-]+={0,2}", re.A)
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){20,}(?![0-9A-Fa-f])", re.A)


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """DER length at `at`: (value, position behind it); None unless in its shortest form."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    value = int.from_bytes(data[at + 1: at + 1 + n], "big")
    return (value, at + 1 + n) if value >= 0x80 and value >> (8 * (n - 1)) else None


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE whose nested elements fill their frames exactly and which holds a key:
    a version or algorithm first and at least one integer, bit string or octet string of 16 bytes or more."""
    if len(data) < 20 or data[0] != 0x30:
        return False
    frames, at, large, elements = [], 0, False, 0
    while True:
        while frames and at == frames[-1]:
            frames.pop()
        if at == len(data) and not frames:
            break
        if elements and not frames:
            return False
        if at >= len(data):
            return False
        tag, found = data[at], _length(data, at + 1)
        if found is None or (tag & 0x1F) == 0x1F or tag == 0:
            return False
        size, body = found
        end = body + size
        if end > (frames[-1] if frames else len(data)) or elements > 4096:
            return False
        elements += 1
        if elements == 2 and tag not in (0x02, 0x30):
            return False
        if tag & 0x20:
            frames.append(end)
            at = body
        else:
            large |= tag in (0x02, 0x03, 0x04) and size >= 16
            at = end
    return large and elements >= 3


def is_ssh_key(data: bytes) -> bool:
    """An openssh-key-v1 container or a public key blob whose length fields chain to its end."""
    private = data.startswith(b"openssh-key-v1\0")
    at, fields = (15, []) if private else (0, [])
    while at + 4 <= len(data) and len(fields) < 64:
        size = int.from_bytes(data[at: at + 4], "big")
        if private and len(fields) == 3:  # the number of keys
            return 1 <= size <= 16
        if at + 4 + size > len(data):
            return False
        fields.append(data[at + 4: at + 4 + size])
        at += 4 + size
    return not private and at == len(data) and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-sha2-", b"sk-ssh-"))


def is_signed_header(part: str) -> bool:
    """Base64url of a JSON object that names its algorithm."""
    data = decoded(part)
    if not data or not data.lstrip().startswith(b"{"):
        return False
    try:
        head = json.loads(data)
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def decoded(text: str) -> bytes | None:
    """Base64 in either alphabet, white space and escaped line breaks ignored, padding optional."""
    body = "".join(text.replace("\\n", " ").replace("\\r", " ").split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def wrapped_lines(text: str) -> Iterator[tuple[int, int]]:
    """Ranges of two or more lines of base64 that can be one value: lines of one width, with and without the
    next line if that is shorter."""
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + a, m.start() + b) for a, b in (x.span() for x in LINE.finditer(m[0]))]
        first = 0
        for k in range(1, len(lines) + 1):
            width = lines[first][1] - lines[first][0]
            if k < len(lines) and lines[k][1] - lines[k][0] == width:
                continue
            if k < len(lines) and lines[k][1] - lines[k][0] < width:
                yield lines[first][0], lines[k][1]
            if k - first > 1:
                yield lines[first][0], lines[k - 1][1]
            first = k


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded structure is that of a key or signed token."""
    found, seen = [], set()

    def report(start: int, end: int, data: bytes | None) -> None:
        if data and (start, end) not in seen:
            kind = 3 if is_der_key(data) else 4 if is_ssh_key(data) else None
            if kind:
                seen.add((start, end))
                found.append((start, kind, end))

    if "-----BEGIN" in text:
        for m in BLOCK.finditer(text):
            report(m.start(), m.end(), decoded(m[2]))
    blocks = sorted(seen)
    for start, end in wrapped_lines(text):
        at = bisect_right(blocks, (start, len(text))) - 1
        if at < 0 or end > blocks[at][1]:  # the lines of a reported block are that block
            report(start, end, decoded(text[start:end]))
    for m in SIGNED.finditer(text):
        if is_signed_header(m[1]):
            found.append((m.start(), 5, m.end()))
    for m in BASE64.finditer(text):
        report(m.start(), m.end(), decoded(m[0]))
        for h in HEX_BYTES.finditer(text, m.start(), m.end()):  # hex digits are base64 digits too
            report(h.start(), h.end(), bytes.fromhex(h[0]))
    return sorted(found)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end) ordered by start, then kind."""
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py() or ""
                out.append([{"kind": KINDS[k], "start": s, "end": e}
                            for s, k, e in sorted(base_spans(text) + confirmed_spans(text))] if text else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPANS)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(spans, "doc_id long, spans array<struct<kind: string, start: int, end: int>>")


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
