"""Content types by file extension."""

from __future__ import annotations

FALLBACK = "application/octet-stream"

#: Extensions of each category and their content types, the first of them primary.
CATEGORIES: dict[str, dict[str, tuple[str, ...]]] = {
    "3d": {
        "obj": ("text/plain",), "stl": ("application/sla",), "fbx": ("application/octet-stream",), "dae": ("model/vnd.collada+xml",), "gltf": ("model/gltf+json",),
        "glb": ("model/gltf-binary",), "3ds": ("image/x-3ds",),
    },
    "adobe": {"ai": ("application/postscript",), "eps": ("application/postscript",), "ps": ("application/postscript",), "psd": ("image/vnd.adobe.photoshop",)},
    "apple": {"pages": ("application/vnd.apple.pages",), "numbers": ("application/vnd.apple.numbers",), "key": ("application/vnd.apple.keynote",)},
    "archive": {
        "zip": ("application/zip",), "rar": ("application/x-rar-compressed",), "tar": ("application/x-tar",), "gz": ("application/gzip",), "bz2": ("application/x-bzip2",),
        "7z": ("application/x-7z-compressed",), "xz": ("application/x-xz",),
    },
    "audio": {
        "mp3": ("audio/mpeg",), "wav": ("audio/wav", "audio/x-wav"), "ogg": ("audio/ogg",), "oga": ("audio/ogg",), "flac": ("audio/flac",), "aac": ("audio/aac",),
        "m4a": ("audio/mp4",), "wma": ("audio/x-ms-wma",), "aiff": ("audio/x-aiff",), "aif": ("audio/x-aiff",), "opus": ("audio/opus",), "mid": ("audio/midi",),
        "midi": ("audio/midi",), "amr": ("audio/amr",),
    },
    "certificate": {
        "pem": ("application/x-pem-file",), "crt": ("application/x-x509-ca-cert",), "cer": ("application/x-x509-ca-cert",), "der": ("application/x-x509-ca-cert",),
        "p12": ("application/x-pkcs12",), "pfx": ("application/x-pkcs12",),
    },
    "code": {
        "php": ("text/x-php", "application/x-httpd-php"), "js": ("text/javascript", "application/javascript"), "json": ("application/json",),
        "xml": ("application/xml", "text/xml"), "html": ("text/html",), "css": ("text/css",), "py": ("text/x-python",), "java": ("text/x-java-source",), "c": ("text/x-c",),
        "cpp": ("text/x-c++",), "h": ("text/x-c",), "cs": ("text/x-csharp",), "rb": ("text/x-ruby",), "go": ("text/x-go",), "rs": ("text/x-rust",),
        "swift": ("text/x-swift",), "kt": ("text/x-kotlin",), "sql": ("application/sql",), "sh": ("application/x-sh",), "yaml": ("text/yaml",), "yml": ("text/yaml",),
    },
    "database": {
        "db": ("application/x-sqlite3",), "sqlite": ("application/x-sqlite3",), "sqlite3": ("application/x-sqlite3",), "mdb": ("application/vnd.ms-access",),
    },
    "document": {
        "pdf": ("application/pdf",), "doc": ("application/msword",), "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",),
        "xls": ("application/vnd.ms-excel",), "xlsx": ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",), "ppt": ("application/vnd.ms-powerpoint",),
        "pptx": ("application/vnd.openxmlformats-officedocument.presentationml.presentation",), "odt": ("application/vnd.oasis.opendocument.text",),
        "ods": ("application/vnd.oasis.opendocument.spreadsheet",), "odp": ("application/vnd.oasis.opendocument.presentation",), "rtf": ("application/rtf",),
        "pages": ("application/vnd.apple.pages",), "numbers": ("application/vnd.apple.numbers",), "key": ("application/vnd.apple.keynote",),
    },
    "ebook": {
        "epub": ("application/epub+zip",), "mobi": ("application/x-mobipocket-ebook",), "azw": ("application/vnd.amazon.ebook",), "azw3": ("application/vnd.amazon.ebook",),
    },
    "executable": {
        "exe": ("application/x-msdownload",), "dll": ("application/x-msdownload",), "msi": ("application/x-msdownload",), "dmg": ("application/x-apple-diskimage",),
        "apk": ("application/vnd.android.package-archive",), "deb": ("application/x-debian-package",),
    },
    "font": {"ttf": ("font/ttf",), "otf": ("font/otf",), "woff": ("font/woff",), "woff2": ("font/woff2",), "eot": ("application/vnd.ms-fontobject",)},
    "image": {
        "jpg": ("image/jpeg",), "jpeg": ("image/jpeg",), "jpe": ("image/jpeg",), "jfif": ("image/jpeg",), "png": ("image/png",), "gif": ("image/gif",),
        "bmp": ("image/bmp", "image/x-ms-bmp"), "webp": ("image/webp",), "svg": ("image/svg+xml",), "svgz": ("image/svg+xml",),
        "ico": ("image/x-icon", "image/vnd.microsoft.icon"), "tiff": ("image/tiff",), "tif": ("image/tiff",), "heic": ("image/heic",), "heif": ("image/heif",),
        "avif": ("image/avif",), "raw": ("image/x-dcraw",), "cr2": ("image/x-canon-cr2",), "nef": ("image/x-nikon-nef",), "dng": ("image/x-adobe-dng",),
        "arw": ("image/x-sony-arw",), "psd": ("image/vnd.adobe.photoshop",), "psb": ("image/vnd.adobe.photoshop",),
    },
    "text": {
        "txt": ("text/plain",), "text": ("text/plain",), "log": ("text/plain",), "csv": ("text/csv",), "tsv": ("text/tab-separated-values",), "md": ("text/markdown",),
        "markdown": ("text/markdown",),
    },
    "video": {
        "mp4": ("video/mp4",), "avi": ("video/x-msvideo",), "mov": ("video/quicktime",), "wmv": ("video/x-ms-wmv",), "flv": ("video/x-flv",), "webm": ("video/webm",),
        "mkv": ("video/x-matroska",), "mpeg": ("video/mpeg",), "mpg": ("video/mpeg",), "ogv": ("video/ogg",), "3gp": ("video/3gpp",), "3g2": ("video/3gpp2",),
        "m4v": ("video/x-m4v",),
    },
    "web": {
        "html": ("text/html",), "htm": ("text/html",), "xhtml": ("application/xhtml+xml",), "css": ("text/css",), "js": ("text/javascript",), "json": ("application/json",),
        "xml": ("application/xml",), "wasm": ("application/wasm",), "svg": ("image/svg+xml",),
    },
}

#: The categories that the compatible lookup searches, in order, by the extension's first character.
ROUTES = {
    "a": "audio archive adobe apple", "b": "image archive", "c": "code document archive certificate", "d": "document database 3d image",
    "e": "document ebook audio executable", "f": "font video audio 3d", "g": "image archive code", "h": "web code image", "i": "image text archive",
    "j": "image code web video", "k": "code document video", "l": "text code archive", "m": "audio video document database text 3d", "n": "image text",
    "o": "document audio video font", "p": "document image code certificate video adobe", "q": "video", "r": "image audio text video code document",
    "s": "image audio video code text archive", "t": "image video text font code archive", "u": "text video", "v": "video text certificate",
    "w": "audio video web font document image", "x": "document web archive audio image 3d", "y": "text code", "z": "archive", "3": "video 3d", "7": "archive",
}


def mime_types(extension: str, compat: bool = False) -> tuple[str, ...]:
    """Content types of an extension. The compatible lookup sees only the categories of its first character."""
    extension = extension.lower().lstrip(".")
    names = ROUTES.get(extension[:1], "").split() if compat else CATEGORIES
    return next((CATEGORIES[n][extension] for n in names if extension in CATEGORIES[n]), (FALLBACK,))


def primary_mime_type(extension: str, compat: bool = False) -> str:
    return mime_types(extension, compat)[0]


def has_extension(extension: str, compat: bool = False) -> bool:
    return mime_types(extension, compat) != (FALLBACK,)
