"""Secret scan that reports a candidate only once its structure has been confirmed.

Candidates are PEM blocks, runs of base64 or hex (wrapped over lines or not) and dotted tokens. They
are decoded and parsed: DER keys by their nested lengths down to the integers, OpenSSH keys by their
length-prefixed fields, JSON web tokens by header, payload and length of signature, access tokens by
their check sum, access key ids by the account number in them. What a run decodes to is searched at
every place a key can begin, and text in it is scanned like any other, at any depth. A bare hex number
could be any digest; it is reported only where it is the whole value of an assignment to a name that
says it is secret and decodes to as many bytes as keys have.

Every search is one pass: candidates of one kind don't overlap, a key's lengths say where it ends, and
no key nests or holds more elements than ``der`` follows, so hostile texts take no longer than others.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----")
_END = re.compile(r"-----END ([A-Z0-9 ]{1,40})-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s:,\-\\]*")
#: The second and third part of a signed token; the first is what stands before.
_TOKEN = re.compile(r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{16,}")
_HUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_ACCESS_ID = re.compile(r"AKIA([A-Z2-7]{16})(?![A-Za-z0-9])")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40,}[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/]+={0,2}")
_QUICK = re.compile(r"-----BEGIN |[A-Za-z0-9+/_.-]{20}")
#: Where a DER private key can begin: a sequence that starts with a version, or with another sequence.
_KEY = re.compile(rb"(?=(\x30(?:[\x16-\x7f]|\x81[\x80-\xff]|\x82..|\x83...)(?:\x02\x01[\x00\x01]|\x30)))", re.S)
_TEXT = re.compile(rb"[\t\n\r\x20-\x7e]{20,}")
_SECRET_NAME = re.compile(r"(?i)secret|token|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credential|(?<![A-Za-z0-9_])key")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGITS = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
_HEX_BYTES = {16, 20, 24, 28, 32, 48, 64}
_BASE64_BYTES = {24, 32, 40, 48, 64}
_SIGNATURE = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: No key's encoding nests deeper or has more elements side by side.
DEEPEST, MOST = 16, 64

Element = tuple[int, bytes, list | None]
Span = tuple[int, int, str]


def der(data: bytes) -> list[Element] | None:
    """The elements of ``data``: tag, content, elements inside. None unless all lengths fit exactly.

    None also for what nests deeper than DEEPEST or has over MOST elements side by side.
    """
    out: list[Element] = []
    open_: list[tuple[list[Element], int]] = [(out, len(data))]
    at = 0
    while open_:
        own, stop = open_[-1]
        if at == stop:
            open_.pop()
            continue
        if at + 2 > stop or len(own) == MOST:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > stop:
                return None
            size = int.from_bytes(data[at : at + k])
            if size < 0x80:
                return None
            at += k
        if at + size > stop:
            return None
        if tag & 0x20:
            if len(open_) == DEEPEST:
                return None
            inside: list[Element] = []
            own.append((tag, data[at : at + size], inside))
            open_.append((inside, at + size))
        else:
            own.append((tag, data[at : at + size], None))
            at += size
    return out


def der_key(data: bytes) -> str | None:
    """The kind of private key that ``data`` is the DER encoding of."""
    if len(data) < 24 or data[0] != 0x30:
        return None
    top = der(data)
    if not top or len(top) != 1 or not top[0][2]:
        return None
    parts = top[0][2]
    tags = [p[0] for p in parts]
    if len(parts) >= 9 and tags[:9] == [2] * 9 and parts[0][1] in (b"\0", b"\1"):
        n, e, d, p, q = (int.from_bytes(x[1]) for x in parts[1:6])
        return "rsa-key" if p * q == n and e & 1 and d else None
    if len(parts) == 6 and tags == [2] * 6 and parts[0][1] == b"\0":
        return "dsa-key"
    if tags[:2] == [2, 4] and parts[0][1] == b"\1" and len(parts[1][1]) in range(20, 67):
        return "ec-key"
    if tags[:3] == [2, 0x30, 4] and parts[0][1] in (b"\0", b"\1") and parts[1][2] and parts[1][2][0][0] == 6:
        inner = parts[2][1]
        return "pkcs8-key" if der_key(inner) or (d2 := der(inner)) and len(d2) == 1 and d2[0][0] in (2, 4) else None
    if tags == [0x30, 4] and parts[0][2] and parts[0][2][0][0] == 6:
        return "encrypted-pkcs8-key"
    return None


def _der_end(data: bytes, at: int) -> int:
    """Where the element that begins at ``at`` says it ends."""
    size = data[at + 1]
    if size & 0x80:
        k = size & 0x7F
        return at + 2 + k + int.from_bytes(data[at + 2 : at + 2 + k])
    return at + 2 + size


_OPENSSH = b"openssh-key-v1\0"


def openssh_end(data: bytes, begin: int = 0) -> int | None:
    """Where the OpenSSH private key that begins at ``begin`` ends; None where there is none."""
    if not data.startswith(_OPENSSH, begin):
        return None
    at, fields = begin + 15, []

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):
        fields.append(field())
        if fields[-1] is None:
            return None
    count = int.from_bytes(data[at : at + 4])
    if not 1 <= count <= 16 or not fields[0].isascii():
        return None
    at += 4
    for _ in range(count + 1):
        last = field()
        if not last:
            return None
    return at if fields[0] != b"none" or last[:4] == last[4:8] else None


def openssh_key(data: bytes) -> str | None:
    return "openssh-key" if openssh_end(data) is not None else None


def _unbase64(s: str) -> bytes | None:
    s = "".join(s.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def _pem(text: str) -> Iterator[Span]:
    """Each end with the nearest beginning before it."""
    last = 0
    begins = list(_BEGIN.finditer(text))
    places = [b.start() for b in begins]
    for e in _END.finditer(text) if begins else ():
        k = bisect.bisect_left(places, e.start()) - 1
        if k < 0 or begins[k].start() < last or begins[k].end() > e.start() or begins[k][1] != e[1] or "PRIVATE KEY" not in e[1]:
            continue
        b, last = begins[k], e.end()
        if not _BODY.fullmatch(text, b.end(), e.start()):
            continue
        body = re.sub(r"\\+[nr]", "\n", text[b.end() : e.start()]).replace("\\/", "/")  # line ends and slashes as in JSON
        data = _unbase64("\n".join(x for x in body.splitlines() if ":" not in x))
        if data is None:
            continue
        if "DEK-Info:" in body:
            kind = "encrypted-pem-key" if len(data) % 8 == 0 and len(data) >= 48 else None
        else:
            kind = openssh_key(data) or der_key(data)
        if kind:
            yield b.start(), e.end(), kind


def _object(data: bytes, at: int = 0) -> dict | None:
    """The JSON object that ``data[at:]`` is."""
    try:
        out, end = json.JSONDecoder().raw_decode(data[at:].decode())
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) and at + end <= len(data) and not data[at:].decode()[end:].strip() else None


def _tokens(text: str) -> Iterator[Span]:
    for m in _TOKEN.finditer(text):
        payload, signature = m[0][1:].split(".")
        sign, body = _unbase64(signature), _unbase64(payload)
        if sign is None or body is None or _object(body) is None:
            continue
        begin = m.start()
        while begin and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "_-"):
            begin -= 1
        # a header begins with eyJ, four characters of it are three bytes, and its object ends at the dot
        for a in range(begin, min(begin + 4, m.start())):
            data = _unbase64(text[a : m.start()])
            if data is None:
                continue
            at = data.find(b'{"')
            while at >= 0:
                if at % 3 == 0 and (head := _object(data, at)) is not None:
                    alg, fits = head.get("alg"), None
                    if isinstance(alg, str):
                        fits = len(sign) in _SIGNATURE[alg] if alg in _SIGNATURE else alg[:2] in ("RS", "PS") and len(sign) >= 128
                    if fits:
                        yield a + at // 3 * 4, m.end(), "signed-token"
                    break
                at = data.find(b'{"', at + 1)


def _access(text: str) -> Iterator[Span]:
    for m in _HUB.finditer(text):
        n, code = zlib.crc32(m[1].encode()), ""
        while n:
            n, r = divmod(n, 62)
            code = _BASE62[r] + code
        if code.rjust(6, "0") == m[2]:
            yield m.start(), m.end(), "access-token"
    for m in _ACCESS_ID.finditer(text):
        account = (int.from_bytes(base64.b32decode(m[1])[:6]) & 0x7FFFFFFFFF80) >> 7
        if account < 10**12 and entropy(m[1]) > 2.5:
            yield m.start(), m.end(), "access-key-id"


def _assigned(text: str, begin: int) -> bool:
    """Whether what begins at ``begin`` is assigned to a name that says it is secret."""
    at = begin

    def skip(chars: str, most: int | None = None) -> None:
        nonlocal at
        low = -1 if most is None else at - most - 1
        while at and at - 1 > low and text[at - 1] in chars:
            at -= 1

    skip("\"'", 1)
    skip(" \t\r\n")
    sign = at
    skip("=:>", 2)
    if text[at:sign] not in ("=", ":", "=>", ":="):
        return False
    skip(" \t\r\n")
    skip("\"'", 1)
    end = at
    while at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        at -= 1
    return _SECRET_NAME.search(text, at, end) is not None


def _named(text: str, m: re.Match) -> str | None:
    """The kind of a run that is as a whole the value of an assignment to a secret's name."""
    run = m[0]
    if _HEX.match(run):
        if len(run) % 2 == 0 and len(bytes.fromhex(run)) in _HEX_BYTES and entropy(run.lower()) > 3 and not run.isdigit() and _assigned(text, m.start()):
            return "named-hex-secret"
        return None
    data = _unbase64(run)
    if data and len(data) in _BASE64_BYTES and len(set(run)) >= 16 and any(map(str.isdigit, run)) and entropy(run) > 4 and _assigned(text, m.start()):
        return "named-base64-secret"
    return None


def _in_bytes(data: bytes, unit: int) -> Iterator[Span]:
    """Secrets in decoded bytes that begin at a multiple of ``unit``, in bytes; text in them is scanned."""
    for m in _KEY.finditer(data):
        at = m.start()
        if at % unit == 0 and (end := _der_end(data, at)) <= len(data) and (kind := der_key(data[at:end])):
            yield at, end, kind
    at = data.find(_OPENSSH)
    while at >= 0:
        if at % unit == 0 and (end := openssh_end(data, at)) is not None:
            yield at, end, "openssh-key"
        at = data.find(_OPENSSH, at + 1)
    for m in _TEXT.finditer(data):
        for s, e, kind in scan(m[0].decode()):
            yield m.start() + s, m.start() + e, f"nested {kind.removeprefix('nested ')}"


def _decoded(run: str, place: Callable[[int], int]) -> Iterator[Span]:
    """Secrets in a run of base64 or hex; ``place`` tells where its characters stand in the text."""
    run = run.rstrip("=")
    for m in _DIGITS.finditer(run):
        for a in (m.start(), m.start() + 1):
            for s, e, kind in _in_bytes(bytes.fromhex(run[a : m.end() - (m.end() - a) % 2]), 1):
                yield place(a + 2 * s), place(a + 2 * e - 1) + 1, kind
    run = run.replace("-", "+").replace("_", "/")
    for a in range(4):
        own = run[a:]
        own = own[: len(own) - 1] if len(own) % 4 == 1 else own
        data = base64.b64decode(own + "=" * (-len(own) % 4))
        for s, e, kind in _in_bytes(data, 3):
            yield place(a + s // 3 * 4), place(a + -(-e * 4 // 3) - 1) + 1, kind


def _runs(text: str) -> Iterator[Span]:
    for m in _RUN.finditer(text):
        if kind := _named(text, m):
            yield m.start(), m.end(), kind
        else:
            for s, e, kind in _decoded(m[0], lambda i, a=m.start(): a + i):
                yield s, e + len(text[e : e + 2]) - len(text[e : e + 2].lstrip("=")), kind
    for m in _WRAPPED.finditer(text):
        at = [i for i in range(m.start(), m.end()) if text[i] not in " \t\r\n="]
        yield from _decoded("".join([text[i] for i in at]), at.__getitem__)


def scan(text: str) -> list[Span]:
    """Start, end and kind of each confirmed secret of a text, in order; of those that overlap the first, of equal starts the longest."""
    if not _QUICK.search(text):
        return []
    found = sorted([*_pem(text), *_tokens(text), *_access(text), *_runs(text)], key=lambda x: (x[0], -x[1], x[2]))
    out, end = [], 0
    for s, e, kind in found:
        if s >= end:
            out.append((s, e, kind))
            end = e
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kind, start_char, end_char, digest``: a row for each confirmed secret.

    Offsets count characters from 0; ``digest`` is the start of the secret's SHA-256, so that equal
    ones can be matched without showing them. Null and empty texts have none; null ids are passed
    on; repeated rows are each reported. Very long and hostile texts are scanned whole, in time in
    proportion. Of secrets that overlap, the one that begins first is reported, of equal beginnings the
    longest. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1)):
                if t := t.as_py():
                    rows += [(i, s, e, k, hashlib.sha256(t[s:e].encode()).hexdigest()[:16]) for s, e, k in scan(t)]
            if rows:
                i, s, e, k, h = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), pa.array(k), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(h)], ["doc_id", "kind", "start_char", "end_char", "digest"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return own.mapInArrow(run, "doc_id long, kind string, start_char int, end_char int, digest string")


def redact_text(text: str | None) -> str | None:
    if not text:
        return text
    for s, e, kind in reversed(scan(text)):
        text = f"{text[:s]}[secret: {kind}]{text[e:]}"
    return text


def redacted(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s):  # noqa: ANN001, ANN202
        return s.map(redact_text, na_action="ignore")

    return run(text)


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each confirmed secret replaced by ``[secret: kind]``; all rows and columns stay.

    ``length_col``, where the table has it, is set to the new length of the texts that changed. Null
    and empty texts stay as they are.
    """
    from .common import fresh

    (new,) = fresh(docs, "_new")
    out = docs.withColumn(new, redacted(F.col(text_col)))
    cols = []
    for c, kind in docs.dtypes:
        if c == text_col:
            cols.append(F.col(new).alias(c))
        elif c == length_col:
            cols.append(F.when(F.col(new) != F.col(text_col), F.length(new).cast(kind)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)
