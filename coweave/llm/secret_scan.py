"""Secret scans with structural confirmation.

Three plain patterns (assignments of passwords and tokens, access key ids, long
hex runs) report what they match.  Beyond them, candidates are runs of base64,
base64url or hex that could hold a key or a signed token; nothing of them is
reported on looks alone.  A candidate is decoded and its structure read to the
last byte:

* private keys in DER: tag and length of every element, nested elements filling
  their parent exactly, then the shape of a PKCS#1, SEC 1, DSA, PKCS#8 or
  encrypted PKCS#8 key;
* OpenSSH keys: the magic string, then length-prefixed strings that must add
  up, the public key inside repeating the algorithm's name;
* PEM blocks: the body between matching lines, as one of the above (or, where
  its headers say it is encrypted, whole cipher blocks);
* signed and encrypted tokens: three or five base64url parts whose header is a
  JSON object that names its algorithm, with the payload or key parts that the
  algorithm asks for.

Every text is scanned whole, on its own, wherever its row is: no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, per_batch

# The three base patterns.
ASSIGN = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
                    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
                    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
# a run of digits is matched from its first to its last, so its least length
# can be asked for in the pattern; the other two must match first
LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")

#: kinds in the order in which spans of one start are listed
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jws", "jwe")
BASE_KINDS = KINDS[:3]

PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY)-----"
                 r"((?:\r?\n[A-Z][A-Za-z-]*: [^\n]*){0,4}[^-]*)-----END \1-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*){2,4}")
# the least key that has a structure to read: 24 bytes
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{48,}")
SSH_MAGIC = b"openssh-key-v1\0"

SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
MOST_DEPTH = 16                    # no key nests deeper


def der_elements(body: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill ``body[at:end]`` exactly,
    or None.  Lengths must be definite and in their shortest form; what is
    inside sequences and sets must fill them in the same way."""
    end = len(body) if end is None else end
    out = []
    while at < end:
        if end - at < 2 or depth > MOST_DEPTH:
            return None
        tag, length, at = body[at], body[at + 1], at + 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or end - at < size:
                return None
            length = int.from_bytes(body[at:at + size], "big")
            if length < 0x80 or length >> 8 * (size - 1) == 0:
                return None
            at += size
        if length > end - at:
            return None
        if tag & 0x20 and der_elements(body, at, at + length, depth + 1) is None:
            return None
        if tag == INTEGER and not length:
            return None
        out.append((tag, at, at + length))
        at += length
    return out


def private_key_in_der(body: bytes) -> str | None:
    """The form of the private key that ``body`` is in DER, whole, else None."""
    if len(body) < 24 or body[0] != SEQUENCE:
        return None
    top = der_elements(body)
    if not top or len(top) != 1:
        return None
    parts = der_elements(body, top[0][1], top[0][2])
    tags = [t for t, _, _ in parts]
    text = lambda i: body[parts[i][1]:parts[i][2]]
    if tags[:2] == [SEQUENCE, OCTETS] and len(tags) == 2:
        algorithm = der_elements(text(0))
        return "encrypted-pkcs8" if algorithm and algorithm[0][0] == OID else None
    if not tags or tags[0] != INTEGER or text(0) not in (b"\0", b"\1"):
        return None
    if tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = der_elements(text(1))
        return "pkcs8" if algorithm and algorithm[0][0] == OID else None
    if text(0) == b"\1" and tags[1:2] == [OCTETS] and parts[1][2] - parts[1][1] >= 16:
        return "sec1" if all(t in (0xA0, 0xA1) for t in tags[2:]) else None
    if tags == [INTEGER] * 9 and parts[1][2] - parts[1][1] >= 32:
        return "pkcs1"
    if tags == [INTEGER] * 6 and parts[1][2] - parts[1][1] >= 32:
        return "dsa"
    return None


def ssh_strings(body: bytes, at: int, count: int) -> tuple[list[bytes], int] | None:
    """``count`` length-prefixed strings from ``at`` on, and where they end."""
    out = []
    for _ in range(count):
        if len(body) - at < 4:
            return None
        size = int.from_bytes(body[at:at + 4], "big")
        if size > len(body) - at - 4:
            return None
        out.append(body[at + 4:at + 4 + size])
        at += 4 + size
    return out, at


def private_key_in_ssh(body: bytes) -> str | None:
    """The algorithm of the OpenSSH private key that ``body`` is, else None."""
    if not body.startswith(SSH_MAGIC):
        return None
    head = ssh_strings(body, len(SSH_MAGIC), 3)
    if head is None or len(body) - head[1] < 4:
        return None
    (cipher, kdf, _), at = head
    if not cipher or not kdf or int.from_bytes(body[at:at + 4], "big") != 1:
        return None
    keys = ssh_strings(body, at + 4, 2)
    if keys is None or keys[1] != len(body):
        return None
    public, private = keys[0]
    named = ssh_strings(public, 0, 1)
    if named is None or not named[0][0]:
        return None
    algorithm = named[0][0]
    if cipher == b"none":               # two equal check numbers, then the key itself
        inside = ssh_strings(private, 8, 1)
        if inside is None or private[:4] != private[4:8] or inside[0][0] != algorithm:
            return None
    elif len(private) % 8:
        return None
    return algorithm.decode("ascii", "replace")


def decode_base64(run: str) -> bytes | None:
    """The bytes of a base64 or base64url run with or without padding."""
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def key_in(body: bytes | None) -> tuple[str, str] | None:
    """(kind, form) of the private key that ``body`` holds, whole."""
    if not body:
        return None
    if body[0] == SEQUENCE:
        form = private_key_in_der(body)
        return ("der", form) if form else None
    form = private_key_in_ssh(body)
    return ("ssh", form) if form else None


def json_object(part: str) -> dict | None:
    body = decode_base64(part)
    try:
        value = json.loads(body) if body else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def signed_token(run: str) -> tuple[str, str, int] | None:
    """(kind, algorithm, length) of the compact token that ``run`` starts with:
    ``jws`` has a header with ``alg``, a payload and a signature (empty only
    for ``none``); ``jwe`` a header with ``alg`` and ``enc``, a key (may be
    empty), and a vector, text and tag.  What follows the last part, such as
    the full stop of a sentence, is not part of it."""
    parts = run.split(".")
    header = json_object(parts[0])
    if not header or not isinstance(header.get("alg"), str):
        return None
    rest = [decode_base64(p) for p in parts[1:]]
    size = lambda n: sum(map(len, parts[:n])) + n - 1
    if isinstance(header.get("enc"), str):
        whole = len(parts) == 5 and rest[0] is not None and all(rest[1:])
        return ("jwe", header["alg"], size(5)) if whole else None
    signed = header["alg"].lower() != "none"
    whole = rest[0] and (rest[1] if signed else rest[1] == b"")
    return ("jws", header["alg"], size(3)) if whole else None


def key_in_pem(label: str, body: str) -> str | None:
    """The form of the key in a PEM block, None where its body holds none."""
    head, blank, rest = body.replace("\r\n", "\n").partition("\n\n")
    encrypted = bool(blank) and "ENCRYPTED" in head and "DEK-Info:" in head
    packed = "".join((rest if blank and ":" in head else body).split())
    raw = decode_base64(packed) if packed else None
    if encrypted:                       # whole cipher blocks; nothing more can be read
        return "encrypted" if raw and len(raw) % 8 == 0 else None
    found = key_in(raw)
    return found[1] if found else None


def confirmed(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, form) of the keys and tokens in a text whose
    structure holds; each kind leftmost first, no two overlapping."""
    taken: list[tuple[int, int]] = []   # PEM blocks: their body is no key of its own
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            form = key_in_pem(m.group(1), m.group(2))
            if form:
                taken.append(m.span())
                yield "pem", *m.span(), form
    if "." in text and ("ey" in text or "ew" in text):
        for m in TOKEN.finditer(text):
            token = signed_token(m.group())
            if token:
                yield token[0], m.start(), m.start() + token[2], token[1]
    for pattern, decode in ((BASE64_RUN, decode_base64), (HEX_RUN, _from_hex)):
        for m in pattern.finditer(text):
            if any(a <= m.start() and m.end() <= b for a, b in taken):
                continue
            found = key_in(decode(m.group()))
            if found:
                yield found[0], *m.span(), found[1]


def _from_hex(run: str) -> bytes | None:
    return bytes.fromhex(run) if len(run) % 2 == 0 else None


def scan_text(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind as its place in ``KINDS``, end, form) of every secret of a
    text, in order; code points, end exclusive.  The base patterns are
    leftmost and do not overlap within a kind; what is too short is dropped
    after matching."""
    out = [(m.start(), 0, m.end(), "") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), "") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end(), "") for m in LONG_HEX.finditer(text)]
    out += [(start, KINDS.index(kind), end, form) for kind, start, end, form in confirmed(text)]
    return sorted(set(out))


SPANS = "array<struct<kind: string, start: bigint, `end`: bigint, form: string>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text): the secrets
    of the whole text with kind, start, end (code points, end exclusive) and
    the form that its structure was read as (empty for the base kinds), by
    start, then kind in the order of ``KINDS``, then end.

    A null text counts as empty and has none; null, repeated and tied doc_ids
    are carried as they are, other columns are ignored; an empty table gives
    an empty result.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("form", pa.string())])

    @per_batch
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": KINDS[k], "start": a, "end": b, "form": f} for a, k, b, f in
                  scan_text(t.decode("utf-8", "replace"))] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))],
                                          names=["doc_id", "spans"])
    return ids_and_texts(docs).mapInArrow(run, f"doc_id bigint, spans {SPANS}")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the number of spans of each base kind,
    base_sha256 (of the base spans, listed) and all spans, listed."""
    found = find_secrets(docs)
    of_kind = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return found.select(
        "doc_id", *[F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(listed(of_kind(*BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))
