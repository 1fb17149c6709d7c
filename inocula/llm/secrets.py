"""Secret scans: keyword automaton, anchored expressions, embedded checksums.

One Aho-Corasick automaton over the lower-cased text finds the keywords; the
expression of a kind is tried only at its keyword's position, so its cost
follows the hits.  Kinds:

assign, access, hex   the base kinds (fixed patterns below).  Matches of a
        kind are leftmost and do not overlap; one that is too short is
        dropped but still ends where it ends.  ``hex`` has no keyword: its
        anchor is a run of 32 characters of the class-mapped text.
github, npm           added kinds: prefix, 30 random characters and a 6
        character base-62 CRC-32 of them, reported only if the checksum holds.

Offsets are code points, end exclusive.  Null text counts as empty (no
spans); an existing column named ``out`` is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, values

KINDS = ("assign", "access", "hex", "github", "npm")

# Fixed patterns of the base kinds, with the least length of what is kept.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")

KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github",
    "ghs_": "github", "ghr_": "github", "npm_": "npm",
}

_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))
_HEX_RUN = b"\x01" * MIN_HEX

RESULT = "array<struct<kind:string,start:long,end:long>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def checksum62(random: bytes) -> bytes:
    """CRC-32 of the random part in base 62, six digits."""
    n, out = zlib.crc32(random), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d : d + 1] + out
    return out


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, kind in KEYWORDS.items():
        a.add_word(k, (len(k), kind))
    a.make_automaton()
    return a


def _hex_runs(text: bytes) -> list[tuple[int, int]]:
    flat = text.translate(_HEX)
    out, at = [], flat.find(_HEX_RUN)
    while at >= 0:
        end = flat.find(b"\0", at)
        end = len(flat) if end < 0 else end
        out.append((at, end))
        at = flat.find(_HEX_RUN, end)
    return out


def find_secrets(text: bytes, automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then kind as listed."""
    out: list[tuple[int, int, str]] = [(a, b, "hex") for a, b in _hex_runs(text)]
    hits: dict[str, list[int]] = {}
    for end, (size, kind) in automaton.iter(text.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end - size + 1)
    for kind, pattern, group, least in (("assign", ASSIGN, 2, MIN_ASSIGN), ("access", ACCESS, 0, MIN_ACCESS)):
        free = 0  # where the last match of the kind ended
        for at in sorted(hits.get(kind, ())):
            if at >= free and (m := pattern.match(text, at)):
                free = m.end()
                if m.end(group) - m.start(group) >= least:
                    out.append((at, m.end(), kind))
    for kind in ("github", "npm"):
        for at in hits.get(kind, ()):
            if (m := CHECKED.match(text, at)) and checksum62(m[1]) == m[2] and not text[max(0, at - 1) : at].isalnum():
                out.append((at, m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[dict]:
    if text.isascii():
        return [{"kind": k, "start": a, "end": b} for a, b, k in spans]
    ats = sorted({x for a, b, _ in spans for x in (a, b)})
    where, before, last = {}, 0, 0
    for x in ats:
        before += sum((c & 0xC0) != 0x80 for c in text[last:x])
        where[x], last = before, x
    return [{"kind": k, "start": where[a], "end": where[b]} for a, b, k in spans]


def scan_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with an array column ``out`` of the spans found in the whole text."""

    @F.arrow_udf(RESULT)
    def scan(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = _automaton()
        for a in it:
            rows = []
            for t in values(a):
                found = find_secrets(t, automaton)
                rows.append(_code_points(t, found) if found else [])
            yield pa.array(rows, _TYPE)

    return docs.withColumn(out, scan.asNondeterministic()(utf8(text_col)))
