"""Secret scanning: keyword automaton, anchored expressions at its hits, embedded checksums.

One Aho-Corasick pass over the case-folded bytes finds every place where a secret can begin. Only there
the expression of that kind is tried, anchored. Kinds whose format embeds a checksum are kept only when
the checksum holds; the three base kinds have none and are kept on length alone.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, sha256_hex, text_or_empty

#: Kinds in their order of listing, and the shape of each.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm")
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
GITHUB = rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"
NPM = rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_KEYWORDS = ("akia",)
GITHUB_KEYWORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_KEYWORDS = ("npm_",)
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_BYTES = frozenset(b"0123456789abcdef")
_RANK = {kind: k for k, kind in enumerate(BASE_KINDS + CHECKED_KINDS)}


@dataclass(frozen=True)
class Span:
    """A secret: its kind and its half-open range of code points."""

    start: int
    rank: int
    end: int
    kind: str

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def base62_crc32(payload: bytes) -> bytes:
    """The six base-62 digits that vendors append to a token's random part."""
    n, digits = zlib.crc32(payload), []
    for _ in range(6):
        n, d = divmod(n, 62)
        digits.append(BASE62[d])
    return "".join(reversed(digits)).encode()


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """Keywords of all kinds. A run of 32 hexadecimal digits has no keyword, so every four-digit word is one."""
    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_KEYWORDS), ("access", ACCESS_KEYWORDS), ("github", GITHUB_KEYWORDS), ("npm", NPM_KEYWORDS)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    for digits in product("0123456789abcdef", repeat=4):
        found.add_word("".join(digits), ("hex", 4))
    found.make_automaton()
    return found


def _passes(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return match.end(2) - match.start(2) >= MIN_VALUE
    if kind in BASE_KINDS:
        return match.end() - match.start() >= (MIN_ACCESS if kind == "access" else MIN_HEX)
    return base62_crc32(match[1]) == match[2]


_EXPRESSIONS = {
    "assign": re.compile(ASSIGN, re.IGNORECASE), "access": re.compile(ACCESS), "hex": re.compile(HEX),
    "github": re.compile(GITHUB), "npm": re.compile(NPM),
}


def scan(text: str | None) -> list[Span]:
    """All secrets of a whole text, by start, then kind as listed. Null and empty texts have none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    done = dict.fromkeys(_RANK, 0)
    found: list[tuple[int, int, int, str]] = []
    for last, (kind, width) in _automaton().iter(raw.lower().decode("latin-1")):
        start = last - width + 1
        if start < done[kind]:
            continue
        if kind == "hex" and (raw[start] not in _HEX_BYTES or start and raw[start - 1] in _HEX_BYTES):
            continue  # not the beginning of a run
        match = _EXPRESSIONS[kind].match(raw, start)
        if match is None:
            continue
        if kind in BASE_KINDS or _passes(kind, match):
            done[kind] = match.end()  # a base match that fails below still uses up its text
        if _passes(kind, match):
            found.append((start, _RANK[kind], match.end(), kind))
    found.sort()
    if not found or len(raw) == len(text):
        return [Span(*x) for x in found]
    points = _code_points(raw, sorted({x[0] for x in found} | {x[2] for x in found}))
    return [Span(points[s], r, points[e], k) for s, r, e, k in found]


def _code_points(raw: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each of the ascending byte offsets."""
    out, at, n = {}, 0, 0
    for offset in offsets:
        n += len(raw[at:offset].decode("utf-8", "surrogatepass"))
        at, out[offset] = offset, n
    return out


def scan_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of the secrets in every document: one row per input row, no shuffle.

    Null and empty texts give zero counts and empty spans; repeated rows are scanned each; other columns
    of the input are ignored, whatever their names.
    """

    def run(rows: dict) -> list:
        spans = [scan(t) for t in rows["text"]]
        base = [[s for s in x if s.rank < len(BASE_KINDS)] for x in spans]
        counts = [[sum(s.kind == kind for s in x) for x in base] for kind in BASE_KINDS]
        return [
            rows["doc_id"], *counts,
            [sha256_hex(",".join(map(str, x)).encode()) for x in base],
            [",".join(map(str, x)) for x in spans],
        ]

    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(source, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", run)
