"""Byte-pair encoding by forced boundaries, and decoding.

Two bytes that stand side by side in no token of the vocabulary can never be merged, so the text may be
cut between them: the pieces encode independently and their ids are concatenated. A cut must also leave
the pre-tokeniser's own pieces as they are. Its only look-ahead is over white space and its only piece that
starts with an apostrophe is a contraction, so no cut is made after white space or before an apostrophe.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_rows, sha256_hex, text_or_empty, vocabulary

BYTE_BPE = vocabulary("byte_bpe_50k.json")
#: Fragments remembered per worker; a full memory is emptied, which costs time and never results.
CACHE_FRAGMENTS = 600_000
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one worker per core already
_EXOTIC_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """Encoder and decoder over a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        alphabet = byte_alphabet()
        self.token_bytes: dict[int, bytes] = {i: bytes(alphabet[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes |= {i: content.encode() for content, i in self.specials.items()}
        self._special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)")
        joined = np.zeros((256, 256), dtype=bool)
        for i, token in self.token_bytes.items():
            if i not in self.specials.values() and len(token) > 1:
                code = np.frombuffer(token, dtype=np.uint8)
                joined[code[:-1], code[1:]] = True
        forced = ~joined
        forced[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32], :] = False  # after white space
        forced[:, 0x27] = False  # before an apostrophe
        forced[:, 0x80:0xC0] = False  # inside a code point
        self.forced = forced.ravel()
        wary = forced.copy()
        wary[0x80:, :] = False  # after what may be white space beyond ASCII
        self.wary = wary.ravel()
        self._forget()
        size = max(self.token_bytes) + 1
        decimals = [f"{i},".encode() for i in range(size)]
        self._decimals = np.array(decimals, dtype="S8").view(np.uint8).reshape(size, 8)
        self._decimal_slots = np.arange(8) < np.array([len(d) for d in decimals])[:, None]
        self._token_flat = np.frombuffer(b"".join(self.token_bytes.get(i, b"") for i in range(size)), dtype=np.uint8)
        self._token_count = np.array([len(self.token_bytes.get(i, b"")) for i in range(size)])
        self._token_start = np.cumsum(self._token_count) - self._token_count

    def _forget(self) -> None:
        self._index: dict[bytes, int] = {}
        self._flat, self._used = np.zeros(1 << 16, dtype=np.int32), 0
        self._start, self._count = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    def cuts(self, raw: bytes, exotic: bool) -> list[int]:
        """Ascending byte offsets at which the text may be cut."""
        code = np.frombuffer(raw, dtype=np.uint8)
        pairs = code[:-1].astype(np.uint16)
        pairs <<= 8
        pairs |= code[1:]
        return (np.flatnonzero((self.wary if exotic else self.forced)[pairs]) + 1).tolist()

    def fragments(self, text: str) -> list[bytes]:
        raw = text.encode()
        if len(raw) < 2:
            return [raw] if raw else []
        at = self.cuts(raw, bool(_EXOTIC_SPACE.search(text)))
        return [raw[i:j] for i, j in zip([0, *at], [*at, len(raw)])]

    def _learn(self, new: list[bytes]) -> None:
        """Encode fragments with the library and add them to the table of fragments."""
        done = self.tokenizer.encode_batch_fast([x.decode() for x in new], add_special_tokens=False)
        got = [e.ids for e in done]
        counts = [len(ids) for ids in got]
        at, n, total = self._used, len(self._index), sum(counts)
        while len(self._flat) < at + total:
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while len(self._start) < n + len(new):
            self._start, self._count = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._count))
        self._flat[at : at + total] = np.fromiter(chain.from_iterable(got), dtype=np.int32, count=total)
        self._count[n : n + len(new)] = counts
        self._start[n : n + len(new)] = at + np.cumsum(counts) - counts
        self._used = at + total
        self._index.update(zip(new, range(n, n + len(new))))

    def _pieces(self, text: str) -> list[bytes]:
        """Fragments in order; special tokens, which the library finds before anything else, stand whole."""
        out: list[bytes] = []
        at = 0
        for hit in self._special.finditer(text):
            out += self.fragments(text[at : hit.start()])
            out.append(hit[0].encode())
            at = hit.end()
        return out + self.fragments(text[at:] if at else text)

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text. Fragments are looked up, new ones encoded, and their ids concatenated."""
        pieces = [self._pieces(t) for t in texts]
        parts = list(chain.from_iterable(pieces))
        codes = list(map(self._index.get, parts))
        if None in codes:
            new = list(dict.fromkeys(x for x, c in zip(parts, codes) if c is None))
            if len(self._index) + len(new) > CACHE_FRAGMENTS:
                self._forget()
                codes = [None] * len(parts)
                new = list(dict.fromkeys(parts))
            self._learn(new)
            codes = [self._index[x] if c is None else c for x, c in zip(parts, codes)]
        code = np.array(codes, dtype=np.int64)
        ids = gather(self._flat, self._start[code], counts := self._count[code])
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(x) for x in pieces])] if len(texts) else []
        return np.split(ids, ends[:-1])

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([text or ""])[0].tolist()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as comma-joined decimals."""
        return self._decimals[ids][self._decimal_slots[ids]].tobytes()[:-1]

    def decode(self, ids) -> str:
        ids = np.asarray(ids, dtype=np.int64)
        return gather(self._token_flat, self._token_start[ids], self._token_count[ids]).tobytes().decode("utf-8", "replace")


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``flat[start : start + count]``."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - ends + counts).astype(kind), counts)
    at += np.arange(total, dtype=kind)
    return flat[at]


@lru_cache(maxsize=4)
def load_bpe(path: str = BYTE_BPE) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode_documents(documents: DataFrame, path: str = BYTE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` of every whole text. Null texts count as empty and give no ids."""

    def run(rows: dict) -> list:
        return [rows["doc_id"], load_bpe(path).encode_many(rows["text"])]

    return map_rows(documents.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), "doc_id long, ids array<int>", run)


def decode_documents(encoded: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``. Null ids count as none."""

    def run(rows: dict) -> list:
        return [rows["doc_id"], [load_bpe(path).decode(ids or []) for ids in rows["ids"]]]

    return map_rows(encoded.select("doc_id", "ids"), "doc_id long, text string", run)


def encoding_digests(documents: DataFrame, path: str = BYTE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them, in one pass and without a shuffle.

    Null and empty texts have no tokens and the digests of nothing; repeated rows give repeated results.
    """

    def run(rows: dict) -> list:
        bpe = load_bpe(path)
        encoded = bpe.encode_many(rows["text"])
        return [
            rows["doc_id"], [len(ids) for ids in encoded], [sha256_hex(bpe.decimals(ids)) for ids in encoded],
            [sha256_hex(bpe.decode(ids).encode()) for ids in encoded],
        ]

    source = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(source, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
