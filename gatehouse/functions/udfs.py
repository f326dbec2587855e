"""Arrow-batched functions for the few checks that no built-in expression answers exactly."""

from __future__ import annotations

import ipaddress
import json
import os
import socket
import struct
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _strict_json(text: str | None) -> bool:
    if text is None:
        return False

    def reject(word: str):
        raise ValueError(word)

    try:
        json.loads(text, parse_constant=reject)
    except (ValueError, RecursionError):
        return False
    return True


def is_json(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(_strict_json).astype(bool), "boolean")(c)


def _v6(text: str | None, options: tuple[str, ...]) -> bool:
    try:
        address = ipaddress.IPv6Address(text or "")
    except ValueError:
        return False
    private = address.is_private and not address.is_loopback and address in ipaddress.ip_network("fc00::/7")
    reserved = address.is_loopback or address.is_reserved or address.is_unspecified or address.is_link_local or address in ipaddress.ip_network("2001:db8::/32")
    return not ("private" in options and not private or {"public", "no_priv", "global"} & set(options) and private or {"public", "no_res", "global"} & set(options) and reserved)


def is_ipv6(c: Column, options: tuple[str, ...] = ()) -> Column:
    """Only texts with a colon reach the worker; there each distinct one is parsed once."""
    check = F.pandas_udf(lambda s: s.map({x: _v6(x, options) for x in s.dropna().unique()}).fillna(False).astype(bool), "boolean")
    return check(F.when(c.contains(":"), c))


def strip_tags(text: str, allowed: frozenset[str] = frozenset()) -> str:
    """Markup out: tags with quoted attributes and comments end where they should; allowed tags stay."""
    out, k, n = [], 0, len(text)
    while k < n:
        start = text.find("<", k)
        if start != k:  # all up to the next bracket at once
            out.append(text[k : start if start >= 0 else n])
            k = start if start >= 0 else n
            continue
        if k + 1 >= n or text[k + 1].isspace():
            out.append("<")
            k += 1
            continue
        if text.startswith("<!--", k):
            end = text.find("-->", k + 4)
            k = n if end < 0 else end + 3
            continue
        end, quote = k + 1, ""
        while end < n and (quote or text[end] != ">"):
            if quote:
                quote = "" if text[end] == quote else quote
            elif text[end] in "\"'":
                quote = text[end]
            end += 1
        tag = text[k : end + 1]
        name = tag[1:].lstrip("/").split(">")[0].split("/")[0].split()
        if name and name[0].lower() in allowed:
            out.append(tag)
        k = end + 1
    return "".join(out)


def strip_tags_column(c: Column, allowed: frozenset[str] = frozenset()) -> Column:
    """Only texts with a bracket reach the worker; the others stay as they are."""
    stripped = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else strip_tags(x, allowed)), "string")
    return F.coalesce(stripped(F.when(c.contains("<"), c)), c)


def ascii_letters(c: Column) -> Column:
    """Transliteration by compatibility decomposition; what has no ASCII form goes."""

    def fold(x: str | None) -> str | None:
        return None if x is None else unicodedata.normalize("NFKD", x.replace("ß", "ss").replace("æ", "ae").replace("ø", "o")).encode("ascii", "ignore").decode()

    folded = F.pandas_udf(lambda s: s.map(fold), "string")
    return F.coalesce(folded(F.when(F.octet_length(c) != F.length(c), c)), c)  # ASCII texts stay as they are


def is_file(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda p: bool(p) and os.path.isfile(p)).astype(bool), "boolean")(c)


@lru_cache(maxsize=1 << 16)
def dns_resolves(host: str) -> bool:
    """Whether a name resolves; each worker asks for a host once."""
    try:
        return bool(socket.getaddrinfo(host, None))
    except OSError:
        return False


def resolves(c: Column, resolver=dns_resolves) -> Column:
    """Whether a host has an address; each batch asks for its distinct hosts once."""

    def run(hosts: pd.Series) -> pd.Series:
        known = {h: bool(h) and resolver(h) for h in hosts.dropna().unique()}
        return hosts.map(lambda h: known.get(h, False)).astype(bool)

    return F.pandas_udf(run, "boolean")(c)


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from an image's header: PNG, GIF, BMP, WebP or JPEG."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return abs(w), abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if data[12:16] == b"VP8L":
            b = int.from_bytes(data[21:25], "little")
            return (b & 0x3FFF) + 1, ((b >> 14) & 0x3FFF) + 1
    if data[:2] == b"\xff\xd8":
        k = 2
        while k + 9 < len(data):
            if data[k] != 0xFF:
                return None
            mark = data[k + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[k + 5 : k + 9])
                return w, h
            k += 2 + struct.unpack(">H", data[k + 2 : k + 4])[0]
    return None


def _head(path: str | None, size: int = 1 << 16) -> bytes | None:
    try:
        with open(path or "", "rb") as file:
            return file.read(size)
    except OSError:
        return None


def image_dimensions(file: Column, read: bool) -> Column:
    """``struct<w:int,h:int>`` of an image, null if it is none, from its content, or from the file at a path if it must be read."""

    def run(files: pd.Series) -> pd.DataFrame:
        sizes = [image_size(_head(x) if read else x) or (None, None) for x in files]
        return pd.DataFrame(sizes, columns=["w", "h"], index=files.index).astype("Int32")

    return F.pandas_udf(run, "struct<w:int,h:int>")(file if read else F.substring(file, 1, 1 << 16))


#: Leading bytes and the content type they mean.
MAGIC = (
    (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"BM", "image/bmp"),
    (b"%PDF-", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\x1f\x8b", "application/gzip"), (b"BZh", "application/x-bzip2"),
    (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"), (b"Rar!", "application/x-rar-compressed"), (b"OggS", "audio/ogg"), (b"fLaC", "audio/flac"),
    (b"ID3", "audio/mpeg"), (b"SQLite format 3", "application/x-sqlite3"), (b"<?php", "text/x-php"), (b"<?xml", "text/xml"),
)


def sniff(data: bytes | None) -> str | None:
    if data is None:
        return None
    if data[:4] == b"RIFF":
        return {b"WEBP": "image/webp", b"WAVE": "audio/x-wav", b"AVI ": "video/x-msvideo"}.get(data[8:12])
    found = next((kind for head, kind in MAGIC if data.startswith(head)), None)
    if found or not data:
        return found
    return "text/plain" if b"\0" not in data[:1024] else "application/octet-stream"


def content_type(file: Column, read: bool) -> Column:
    """The type that a file's content shows; null if there is no such file."""
    kind = F.pandas_udf(lambda s: s.map(lambda x: sniff(_head(x, 4096) if read else x)), "string")
    return kind(file if read else F.substring(file, 1, 4096))
