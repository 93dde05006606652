"""Secret scans: patterns, and candidates confirmed by their structure.

Base kinds are plain patterns: assignments of passwords and the like, access key ids, long hex runs.  Beyond these, a
candidate is reported only if it proves to be what it looks like:

* ``jwt``: three dot-separated base64url parts whose first decodes to a JSON object that names an algorithm;
* ``pem``: a block between key markers whose base64 decodes to a DER key or an OpenSSH private key, or, where its header
  names a cipher, to whole blocks of that cipher;
* ``der``: a base64 or hex run that decodes to a DER key: a sequence whose nested lengths add up, and which holds a
  version number and then the integers or the algorithm and octets of a private key, or an encryption scheme and octets;
* ``ssh``: a base64 or hex run that decodes to an OpenSSH private key, its length-prefixed fields adding up;
* ``wrapped``: a base64 or hex run that decodes to printable text in which any of these kinds, the base ones included, is
  found (encodings inside encodings up to ``DEPTH``).

A run may go over several lines of equal length (but for the first and the last); a line break may be written as \\n.

Spans are in code points, ends exclusive; within a kind they don't overlap.

Defined cases: a null or empty text has no span; a very long text is scanned whole, by patterns that do not go back over
what they have read; equal rows are scanned row by row; an empty table gives an empty result; ``redact`` keeps all other
columns, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import fresh, slices, table

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The shortest header, {"alg":""}, has 15 letters.
JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{15,}+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")
#: A dash inside a block is one of a header (DEK-Info: AES-128-CBC), never five in a row.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]++|-(?!----))*+)-----END \1-----")
CIPHER = re.compile(r"DEK-Info:\s*(DES|AES|CAMELLIA|SEED|IDEA|RC2)\b")
#: A run starts where no letter of base64 is before it, or after an escaped line break or tab.
START = r"(?:(?<![A-Za-z0-9+/_-])(?<!\\(?=[nrt]))|(?<=\\[nrt]))"
BREAK = r"[ \t]*(?:(?:\\+r)?\\+n|\\?\r?\n)[ \t]*"
#: The shortest text that the base patterns find, token=abcdef, has 16 letters in base64 and 24 in hex.
BASE64 = re.compile(START + r"[A-Za-z0-9+/_-]{16,}+={0,2}")
LINES = re.compile(START + rf"[A-Za-z0-9+/_-]{{16,}}+(?:{BREAK}[A-Za-z0-9+/_-]++)++={{0,2}}")
LINE = re.compile(rf"({BREAK})")
ESCAPED = re.compile(r"(?:\\+r)?\\+n")
HEX_ANY = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9a-f]{24,}|[0-9A-F]{24,})(?![0-9A-Fa-f])")
HEX_RUN = re.compile(r"(?:[0-9a-f]{2}){12,}|(?:[0-9A-F]{2}){12,}")
#: Kinds in the order in which spans of equal start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh", "wrapped")
BASE = KINDS[:3]
#: Lower-case words without one of which no assignment can match.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
OPENSSH = b"openssh-key-v1\0"
#: How deep encodings are looked for inside decoded text.
DEPTH = 3
#: The schemes of encrypted keys, PKCS#5 and PKCS#12, as they begin.
ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _decode(run: str) -> bytes | None:
    """Bytes of a base64 run in either alphabet, padded or not."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """The (tag, value) items that make up ``data`` exactly, or None if nested lengths don't add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            return None
        value = data[at : at + n]
        if tag & 0x20 and depth < 8 and _items(value, depth + 1) is None:
            return None
        out.append((tag, value))
        at += n
    return out


def is_der_key(data: bytes) -> bool:
    """A private key: sequence(version, 8+ integers) or sequence(version, octets, ...) or sequence(version, algorithm, octets);
    or an encrypted one: sequence(scheme, octets)."""
    outer = _items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    parts = _items(outer[0][1])
    if parts and [t for t, _ in parts] == [0x30, 0x04]:
        scheme = _items(parts[0][1])
        return bool(scheme) and scheme[0][0] == 0x06 and scheme[0][1].startswith(ENCRYPTED) and len(parts[1][1]) >= 16
    if not parts or len(parts) < 3 and not (len(parts) == 2 and parts[1][0] == 0x04) or parts[0][0] != 0x02 or len(parts[0][1]) != 1:
        return False
    tags = [t for t, _ in parts]
    if all(t == 0x02 for t in tags):
        return len(tags) in (6, 9)  # DSA, RSA
    if tags[1] == 0x04:
        return len(parts[1][1]) >= 16  # elliptic curve
    return tags[1] == 0x30 and tags[2] == 0x04 and bool(inner := _items(parts[1][1])) and inner[0][0] == 0x06


def is_openssh_key(data: bytes) -> bool:
    """The magic, then three strings (cipher, kdf, options), a count, and as many public keys and a private part."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def string() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not all(string() for _ in range(3)) or at + 4 > len(data):
        return False
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= n <= 16 and all(string() for _ in range(n + 1)) and at == len(data)


def _is_jwt(header: str, payload: str) -> bool:
    raw, body = _decode(header), _decode(payload)
    if not raw or raw[:1] != b"{" or body is None:
        return False
    try:
        fields = json.loads(raw)
    except (ValueError, RecursionError):
        return False
    return isinstance(fields, dict) and isinstance(fields.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _proved(data: bytes | None, depth: int) -> str | None:
    """The kind that the structure of decoded bytes confirms."""
    if not data:
        return None
    if is_der_key(data):
        return "der"
    if is_openssh_key(data):
        return "ssh"
    if not all(32 <= b < 127 or b in (9, 10, 13) for b in data):
        return None
    text = data.decode()
    return "wrapped" if base_spans(text) or depth < DEPTH and CANDIDATE.search(text) and confirmed_spans(text, depth + 1) else None


def _kind(run: str, depth: int) -> str | None:
    return _proved(_decode(run), depth) or (_proved(bytes.fromhex(run), depth) if HEX_RUN.fullmatch(run) else None)


def _wrapped_lines(text: str, depth: int) -> list[tuple[int, int, str]]:
    """Spans of runs over several lines: a first line, lines of equal length, and perhaps a last shorter one."""
    out = []
    for m in LINES.finditer(text):
        parts = LINE.split(m[0])
        lines, at, places = parts[::2], m.start(), []
        for k, part in enumerate(parts):
            if k % 2 == 0:
                places.append((at, at + len(part)))
            at += len(part)
        size = [len(x.rstrip("=")) for x in lines]
        i = 0
        while i + 1 < len(lines):
            j = i + 1  # the last line of the same length as the one after the first
            while j + 1 < len(lines) and size[j + 1] == size[i + 1]:
                j += 1
            # a line shorter than the first is the last; else the next shorter one may belong to the run, or be a word after it
            ends = [i + 1] * (size[i + 1] < size[i]) + [j + 1] * (j + 1 < len(lines) and size[j + 1] < size[j]) + [j]
            found = next(((k, kind) for k in ends if (kind := _kind("".join(lines[i : k + 1]), depth))), None)
            if found:
                out.append((places[i][0], places[found[0]][1], found[1]))
            # else from the next line that differs in length
            i = found[0] + 1 if found else i + 1 if size[i] != size[i + 1] else j
    return out


def _is_pem(body: str) -> bool:
    lines = ESCAPED.sub("\n", body).splitlines()
    data = _decode("".join(line for line in lines if ":" not in line).replace(" ", ""))
    if not data:
        return False
    # what a header says is encrypted has no structure but its length
    return is_der_key(data) or is_openssh_key(data) or bool(CIPHER.search(body)) and len(data) >= 64 and len(data) % 8 == 0


def confirmed_spans(text: str, depth: int = 0) -> list[tuple[int, int, str]]:
    """Spans that the structure of decoded candidates confirms."""
    out = []
    if "-----BEGIN" in text:
        out += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if _is_pem(m[2])]
    out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if _is_jwt(m[1], m[2])]
    runs = _wrapped_lines(text, depth)
    for pattern in (BASE64, HEX_ANY):
        for m in pattern.finditer(text):
            kind = _kind(m[0], depth)
            if kind and not any(a < m.end() and m.start() < b and k == kind for a, b, k in runs):
                runs.append((m.start(), m.end(), kind))
    return out + runs


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All (start, end, kind), by start, then kind as listed."""
    if not text:
        return []
    # what can be a candidate is a long run; most texts have none
    found = base_spans(text)
    if CANDIDATE.search(text):
        found += confirmed_spans(text)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


#: A run, a key block, or three parts of which the first can be a token's header.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{15}|-----BEGIN")


def scan(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc_id, spans): an array of (kind, start, end, value) for every row."""
    kind = docs.schema[id].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches):
        for batch in slices(batches):
            spans = [[{"kind": k, "start": a, "end": b, "value": t[a:b]} for a, b, k in find(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span)], names=["doc_id", "spans"])

    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>")


def masked(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every stretch that spans cover replaced by the mask."""
    out, upto = [], 0
    for a, b, _ in find(text):
        if a >= upto:
            out += [text[upto:a], mask]
        upto = max(upto, b)
    return "".join(out) + text[upto:] if out else text


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in its texts masked; other columns unchanged."""

    def run(batches):
        for batch in slices(batches):
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, batch.schema.field(at), pa.array([masked(t, mask) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    # a name of its own while in Python, where names that differ in case only, or not at all, would be confused
    column, names = fresh(docs, "redacted"), docs.columns
    return docs.withColumnRenamed(text, column).mapInArrow(run, docs.withColumnRenamed(text, column).schema).withColumnRenamed(column, text).select(*names)


def _listed(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """Nulls, empty and very long texts, repeated rows and an empty table: as the module states."""
    found = scan(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_listed(of(*BASE)), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
