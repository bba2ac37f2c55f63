"""Secret scans with structural confirmation.

Patterns find base candidates. Longer runs are then decoded from base64 or hex and reported only
where their structure holds: key encodings whose nested lengths add up, and signed tokens whose
header and payload parse."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import by_bytes, col, text_of

#: Base kinds first, then the confirmed kinds, in their sorting order.
KINDS = ("assign", "access", "hex", "pem", "key", "token")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
#: An assignment's words, lower-cased; a text without any holds no assignment.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{40,}")
#: Armour lines of a private key, opening and closing; a line of it, whose break may be written as \\n.
MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
BREAK = re.compile(r"\\r\\n|\\n|\r\n|\n|\r")
PART = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
ANY_HEX = re.compile(r"(?:[0-9a-fA-F]{2}){20,}")
#: Lines of base64 that follow one another without armour: full ones of one length (of so many
#: characters at least), then a rest.
LINE = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{4,}={0,2}")
GAP = re.compile(r" ?\r? ?\n|\r")
FULL_LINE = 16
LINE_ENDS = re.compile(r"[A-Za-z0-9+/]{16} ?(?:[\r\n]|\\[rn])")


def unbase64(part: str) -> bytes | None:
    """Decodes either base64 alphabet, padded or not."""
    body = part.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The tag-length-value elements that fill data exactly, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def is_private_key(data: bytes | None) -> bool:
    """Whether data is a private key in DER (RSA, EC, plain or encrypted container) or in the
    length-prefixed form of a secure shell key."""
    if not data:
        return False
    if data.startswith(b"openssh-key-v1\x00"):
        at = 15
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data):
            return False
        keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        if not 1 <= keys <= 16:
            return False
        for _ in range(keys + 1):  # the public keys and the private part
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at == len(data)
    if data[0] != 0x30:
        return False
    top = elements(data)
    inner = elements(top[0][1]) if top and len(top) == 1 else None
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[:9] == [0x02] * 9:
        return inner[0][1] in (b"\x00", b"\x01")  # version, modulus, exponents, primes
    if tags[:3] == [0x02, 0x30, 0x04]:
        algorithm = elements(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags == [0x02] * 6:
        return inner[0][1] == b"\x00"  # version, primes, generator, public and private value
    if tags[:2] == [0x02, 0x04] and inner[0][1] == b"\x01":
        return len(inner[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [0x30, 0x04]:
        algorithm = elements(inner[0][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and len(inner[1][1]) % 8 == 0
    return False


def _object(part: str) -> dict | None:
    """The JSON object that the part encodes, or None."""
    try:
        found = json.loads(unbase64(part) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def tokens(run: str) -> list[tuple[int, int]]:
    """(start, end) of the signed (three parts) and encrypted (five parts) tokens of a run, not
    overlapping. A token begins with a dot-separated part of the run, so each part is decoded twice
    at most: as a header and as a payload."""
    parts = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9_-]+", run)]
    joined = [a[2] + 1 == b[1] and run[a[2]] == "." for a, b in zip(parts, parts[1:], strict=False)]
    out, at = [], 0
    while at + 1 < len(parts):
        size = _token_parts(run, parts, joined, at) if joined[at] and parts[at][0].startswith("eyJ") else 0
        if size:
            end = at + size - 1
            out.append((parts[at][1], parts[end][2] if end < len(parts) and all(joined[at:end]) else parts[at + 1][2] + 1))
        at += max(1, size)
    return out


def _token_parts(run: str, parts: list[tuple[str, int, int]], joined: list[bool], at: int) -> int:
    """How many parts the token at this part has, 0 if none is there. An unsigned one ends in a dot."""
    header = _object(parts[at][0])
    if header is None or not isinstance(header.get("alg"), str):
        return 0
    if isinstance(header.get("enc"), str):
        return 5 if at + 5 <= len(parts) and all(joined[at : at + 4]) else 0
    if _object(parts[at + 1][0]) is None:
        return 0
    if at + 2 < len(parts) and joined[at + 1]:
        return 3
    end = parts[at + 1][2]
    return 3 if header["alg"].lower() == "none" and run[end : end + 1] == "." else 0


def is_signed_token(run: str) -> bool:
    """Whether the whole run is one token."""
    return tokens(run) == [(0, len(run))]


def blocks(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, body) of the armoured private keys: an opening line and the next armour line, if it
    closes the same label."""
    opened = None
    for m in MARK.finditer(text):
        if m.group(1) == "BEGIN":
            opened = m
        else:
            if opened and opened.group(2) == m.group(2):
                yield opened.start(), m.end(), text[opened.end() : m.start()]
            opened = None


def wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, joined) of base64 that is wrapped over several lines without armour."""
    text = text.replace("\\n", " \n").replace("\\r", " \r")  # breaks written out, in as many characters
    group: list[re.Match] = []
    for m in LINE.finditer(text):
        size = len(m.group())
        if group:
            full, gap = len(group[0].group()), text[group[-1].end() : m.start()]
            if len(group[-1].group()) == full and size <= full and len(gap) <= 4 and GAP.fullmatch(gap):
                group.append(m)
                continue
            if len(group) > 1:
                yield group[0].start(), group[-1].end(), "".join(x.group() for x in group)
            group = []
        if size >= FULL_LINE and "=" not in m.group():
            group = [m]
    if len(group) > 1:
        yield group[0].start(), group[-1].end(), "".join(x.group() for x in group)


def pem_body(body: str) -> bytes | None:
    lines = [x.strip() for x in BREAK.sub("\n", body).split("\n")]
    return unbase64("".join(x for x in lines if ":" not in x))


def holds_secret(data: bytes | None) -> bool:
    """Whether decoded bytes are a key, or text that in turn holds a key block or a token."""
    if is_private_key(data):
        return True
    if not data or not data.isascii():
        return False
    text = data.decode("ascii")
    return any(is_private_key(pem_body(body)) for _, _, body in blocks(text)) or any(tokens(m.group()) for m in RUN.finditer(text))


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of one text as (kind, start, end) in code points, sorted. Each step is linear in the
    text's length: no pattern can start over at every place of a long run."""
    spans = []
    low = text.lower()
    if any(w in low for w in WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        spans += [("pem", start, end) for start, end, body in blocks(text) if is_private_key(pem_body(body))]
    runs = list(RUN.finditer(text))
    for run in runs:
        start, body = run.start(), run.group()
        if "eyJ" in body:
            spans += [("token", start + a, start + b) for a, b in tokens(body)]
        for m in ANY_HEX.finditer(body):
            if holds_secret(bytes.fromhex(m.group())):
                spans.append(("key", start + m.start(), start + m.end()))
        for m in PART.finditer(body):
            if holds_secret(unbase64(m.group())):
                spans.append(("key", start + m.start(), start + m.end()))
    if len(runs) > 1 or runs and BREAK.match(text, runs[0].end()) or LINE_ENDS.search(text):
        spans += [("key", start, end) for start, end, body in wrapped(text) if holds_secret(unbase64(body))]
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
)


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the identifier and ``spans`` (kind, start, end in code points).

    Base kinds are ``assign``, ``access`` and ``hex``; confirmed kinds are ``pem`` (an armoured
    private key), ``key`` (a base64 or hex run that decodes to a private key or to text holding
    one, be it wrapped over several lines) and ``token`` (a signed or encrypted token). Null text counts as empty and has no spans; a null
    identifier passes through; repeated rows are scanned each; an empty table gives an empty
    result; other columns are not read. Whole texts are scanned in one pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in scan(text)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, _ARROW)], names=[id_col, "spans"]
            )

    kind = docs.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("spans", SPANS)])
    return by_bytes(docs.select(col(id_col), text_of(text_col).alias("text"))).mapInArrow(run, out)
