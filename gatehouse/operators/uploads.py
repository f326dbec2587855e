"""Rules on uploads: structs of name, type, size, tmp_name and error, or paths as text.

What Spark has read of a file (``content``, as ``sources.tables.read_files`` gives it) stands for the file. Without it a path is opened where
the row is, so it must lie in a folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udfs
from ..functions.typesys import Value, numeric, number, text, trimmed, true
from ..plans.mime import mime_types
from .registry import rule

#: Fixed values.
UNSAFE = r'[<>:"|?*/\\\x00-\x1F\x7F]'
ABSOLUTE = r"^([A-Za-z]:[/\\]|/|\\\\)"
UPLOAD_ERRORS = (0, 1, 2, 3, 4, 6, 7, 8)


def _none():
    return F.lit(None).cast("string")


def _file_path(v: Value):
    if v.kind == "STRUCT":
        f = v.field("tmp_name")
        return f.col if f else _none()
    return v.col if v.kind == "STR" else _none()


def _file(v: Value) -> tuple:
    """The file's content, or its path, and whether it must be read."""
    content = v.field("content") if v.kind == "STRUCT" else None
    return (_file_path(v), True) if content is None else (content.col, False)


def _client(v: Value, name: str):
    f = v.field(name)
    return f.col if f else _none()


def _safe(name):
    t = trimmed(name)
    return true((t != "") & ~name.rlike(UNSAFE) & ~t.isin(".", ".."))


@rule("file", 55, "The {field} must be a valid uploaded file.")
def file(c):
    error = c.value.field("error")
    good = true(error.col == 0) if error else F.lit(c.value.kind == "STR")
    at, read = _file(c.value)
    return good & (true(udfs.is_file(at)) if read else at.isNotNull())


@rule("path", 5, "The {field} must be a valid path.")
def path(c, mode=None):
    if c.value.kind != "STR":
        return F.lit(False)
    t = trimmed(c.value.col)
    good = true((t != "") & ~c.value.col.contains("\0"))
    return good & {"absolute": true(t.rlike(ABSOLUTE)), "relative": ~true(t.rlike(ABSOLUTE))}.get(mode, F.lit(True))


@rule("image", 60, "The {field} must be an image.")
def image(c):
    return udfs.image_dimensions(*_file(c.value))["w"].isNotNull()


def _content(v: Value):
    """The type that the content shows, else the one that the client named."""
    return F.coalesce(udfs.content_type(*_file(v)), _client(v, "type"))


@rule("mimes", 25, "The {field} must be one of these types: {all}", text_params=True)
def mimes(c, *types):
    return true(_content(c.value).isin(sorted({m for t in types for m in mime_types(t.lower())} | set(types))))


@rule("mimetypes", 70, "The {field} must have one of these MIME types: {all}", text_params=True)
def mimetypes(c, *types):
    return true(_content(c.value).isin(list(types)))


@rule("extensions", 10, "The {field} must have one of these extensions: {all}")
def extensions(c, *names):
    name = _client(c.value, "name") if c.value.kind == "STRUCT" else text(c.value)
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))
    return true((ext != "") & ext.isin([str(n).lower() for n in names]))


@rule("dimensions", 65, "The {field} must meet dimension requirements.")
def dimensions(c, min_width=0, min_height=0, max_width=0, max_height=0):
    size = udfs.image_dimensions(*_file(c.value))
    out = size["w"].isNotNull() & true(size["w"] >= int(min_width or 0)) & true(size["h"] >= int(min_height or 0))
    out &= true(size["w"] <= int(max_width)) if max_width else F.lit(True)
    return out & (true(size["h"] <= int(max_height)) if max_height else F.lit(True))


@rule("safe_filename", 8, "The {field} must be a safe file name.")
def safe_filename(c):
    return _safe(c.value.col) if c.value.kind == "STR" else F.lit(False)


@rule("upload_meta", 12, "The {field} must contain valid upload metadata.")
def upload_meta(c, mode=None, max_length=255):
    v = c.value
    error, size, name, kind = (v.field(n) for n in ("error", "size", "name", "type"))
    if v.kind != "STRUCT" or not error or error.kind != "INT" or not size or not name or name.kind != "STR":
        return F.lit(False)
    good = true(error.col.isin(*UPLOAD_ERRORS)) & numeric(size) & true(number(size) >= 0) & true(F.octet_length(name.col) <= int(max_length or 255)) & _safe(name.col)
    if kind is not None and kind.kind != "STR":
        return F.lit(False)
    if mode in ("success", "strict"):
        good &= true(error.col == 0) & true(trimmed(_client(v, "tmp_name")) != "")
    return good


@rule("secure_file", 65, "The {field} must be a secure uploaded file.")
def secure_file(c, mode="success", max_length=255):
    return file(c) & upload_meta(c, mode, max_length)


@rule("upload_id", 5, "The {field} must be a valid upload id.")
def upload_id(c, max_length=128):
    if c.value.kind != "STR":
        return F.lit(False)
    t = trimmed(c.value.col)
    return true(t.rlike(r"(?d)^[A-Za-z0-9_-]+$")) & true(F.octet_length(t).between(1, int(max_length or 128)))
