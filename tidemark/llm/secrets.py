"""Secret scans: keyword automaton, anchored expressions near its hits, checksums.

One pass over the text in map tasks, no shuffle. An Aho-Corasick automaton over
the lower-cased bytes reports keyword positions. Only there are regular
expressions tried, anchored at the hit. Token families with a checksum inside
(CRC-32 in base 62) are reported only if it holds; base64 web tokens only if
their header (of at most HEADER_MOST characters) decodes to a JSON object; one
nested beyond what the parser takes does not count. Hexadecimal runs have no keyword: a run of 16
holds two neighbouring positions of a stride of 8, so those are probed.

Null and empty texts have no spans. Repeated rows are scanned each on its own;
extra columns do not take part. Spans count code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, tidy

# Patterns and lengths of the base kinds.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ASSIGN_LEAST = 12
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(rb"[0-9a-f]+")
HEX_LEAST = 16
# Token families known by prefix.
CHECKED = re.compile(rb"(?:gh[pousr]_|npm_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
# A web token: a header (letters of URL-safe base64), then this.
HEADER = re.compile(rb"[A-Za-z0-9_-]+")
AFTER_HEADER = re.compile(rb"\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
HEADER_LEAST = 11
PRIVATE_KEY = re.compile(rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: A web token's header is decoded only up to this length; real ones have some dozens of characters.
HEADER_MOST = 8192
#: Kinds in the order that breaks ties of a start.
KINDS = ("assign", "access", "hex", "checked", "webtoken", "privatekey")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked",
    "eyj": "webtoken", "-----begin ": "privatekey",
}

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        _automaton = a
    return _automaton


def checksum_holds(body: bytes, check: bytes) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62."""
    value, digits = binascii.crc32(body), bytearray()
    for _ in range(6):
        value, r = divmod(value, 62)
        digits.append(BASE62[r])
    return bytes(reversed(digits)) == check


def header_is_json(part: bytes) -> bool:
    try:
        head = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # not JSON, or nested beyond what the parser takes
        return False
    return isinstance(head, dict) and "alg" in head


def hex_runs(raw: bytes) -> Iterator[tuple[int, int]]:
    view = np.frombuffer(raw, dtype=np.uint8)[::8]
    hit = ((view >= 48) & (view <= 57)) | ((view >= 97) & (view <= 102))
    end = 0
    for i in np.flatnonzero(hit[:-1] & hit[1:]) * 8:
        if i < end:
            continue
        a = int(i)
        while a and raw[a - 1] in b"0123456789abcdef":
            a -= 1
        end = HEX.match(raw, a).end()
        if end - a >= HEX_LEAST:
            yield a, end


def scan(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes, sorted. Each kind: leftmost, non-overlapping."""
    found: list[tuple[int, int, int]] = [(a, 2, b) for a, b in hex_runs(raw)] if len(raw) >= HEX_LEAST else []
    free: dict[str, int] = {}
    run_end = token_end = 0
    # Bytes over 127 become single characters that no keyword holds, so offsets stay.
    for last, (length, kind) in sorted((end - info[0] + 1, info) for end, info in automaton().iter(raw.lower().decode("latin-1"))):
        at = last
        if at < free.get(kind, 0):
            continue
        if kind == "assign":
            if m := ASSIGN.match(raw, at):
                free[kind] = m.end()
                if m.end() - m.start(2) >= ASSIGN_LEAST:
                    found.append((at, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(raw, at):
                free[kind] = m.end()
                if m.end() - at >= ACCESS_LEAST:
                    found.append((at, 1, m.end()))
        elif kind == "checked":
            if (m := CHECKED.match(raw, at)) and checksum_holds(m[1], m[2]):
                free[kind] = m.end()
                found.append((at, 3, m.end()))
        elif kind == "webtoken":
            if at >= run_end and raw[at : at + 3] == b"eyJ":
                # Hits inside one run of letters share its end and what follows, so each run is read once.
                run_end = HEADER.match(raw, at).end()
                m = AFTER_HEADER.match(raw, run_end)
                token_end = m.end() if m else 0
            if token_end and HEADER_LEAST <= run_end - at <= HEADER_MOST and raw[at : at + 3] == b"eyJ" and header_is_json(raw[at:run_end]):
                free[kind] = token_end
                found.append((at, 4, token_end))
        elif m := PRIVATE_KEY.match(raw, at):
            free[kind] = m.end()
            found.append((at, 5, m.end()))
    return sorted(found)


def to_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points: one count of lead bytes up to each offset."""
    if raw.isascii() or not spans:
        return spans
    lead = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
    at = lambda b: int(lead[b - 1]) if b else 0
    return [(at(a), k, at(b)) for a, k, b in spans]


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(raw: bytes, spans: list[tuple[int, int, int]]) -> bytes:
    """Overlapping spans become one marker of the kind that starts first."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [raw[at:a], b"[" + KINDS[k].upper().encode() + b"]"]
        at = max(at, b)
    return b"".join([*out, raw[at:]])


def _scanner(keep: list[str], clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "__text"):
                rows = {"n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "clean_text": []}
                for text in batch.column("__text").cast(pa.binary()):
                    raw = text.as_py() or b""
                    spans = scan(raw)
                    points = to_points(raw, spans)
                    kinds = [k for _, k, _ in spans]
                    for name, k in (("n_assign", 0), ("n_access", 1), ("n_hex", 2)):
                        rows[name].append(kinds.count(k))
                    rows["base_sha256"].append(hashlib.sha256(shown([x for x in points if x[1] < 3]).encode()).hexdigest())
                    rows["spans"].append(shown(points))
                    rows["clean_text"].append(None if not clean or text.as_py() is None else redacted(raw, spans))
                n = pa.int64()
                arrays = [pa.array(rows[x], n) for x in ("n_assign", "n_access", "n_hex")] + [pa.array(rows["base_sha256"], pa.string()), pa.array(rows["spans"], pa.string())]
                names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
                if clean:
                    arrays.append(pa.array(rows["clean_text"], pa.binary()).cast(pa.string()))
                    names.append("clean_text")
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + arrays, names=keep + names)

    return run


def secret_spans(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), clean: bool = False) -> DataFrame:
    """One row per row of `docs`: the columns in `keep`, counts of base kinds, their digest, all spans as text.

    clean: also `clean_text`, the text with each span replaced by its kind in brackets (null stays null).
    """
    given = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]] + ["n_assign long, n_access long, n_hex long, base_sha256 string, spans string"] + ["clean_text string"] * clean)
    return given.mapInArrow(tidy(_scanner(list(keep), clean)), schema)


def without_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with secrets replaced in `text`, and n_chars following where it is a column."""
    names = docs.columns
    # Under other names on the way, since any column may be called as one of the results.
    kept = {c: f"__kept{i}" for i, c in enumerate(names) if c != "text"}
    out = secret_spans(docs.select("text", *[F.col(f"`{c}`").alias(k) for c, k in kept.items()]), keep=tuple(kept.values()), clean=True)
    columns = {c: F.col(k) for c, k in kept.items()} | {"text": F.col("clean_text")}
    if "n_chars" in kept:
        size = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("spans") == "", F.col(kept["n_chars"])).otherwise(size)
    return out.select(*[columns[c].alias(c) for c in names])
