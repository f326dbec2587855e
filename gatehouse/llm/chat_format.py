"""Chat formatting with a loss mask aligned by offsets.

A conversation is rendered as one string, encoded once with offsets, and the sorted spans of the assistant's
turns are intersected with the token spans by binary search. Control strings are tokens of their own, so
no token crosses a turn's edge, and a conversation of any size is rendered and encoded in pieces of whole
turns with the same result as at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from .common import shuffle_partitions, vocabulary

CHAT_BPE = vocabulary("byte_bpe_50k.json")
#: The marks of each role; any other role is named between the marks of ``OTHER``.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TEXT]")
LOSS_ROLES = frozenset({"assistant"})
#: Characters after which a long conversation is handed on, at the next end of a turn.
PIECE_CHARS = 1 << 20

CONTROLS = tuple(m for pair in MARKS.values() for m in pair) + OTHER
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_LOOKALIKE = re.compile("|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\+{re.escape(c[1:])}" for c in CONTROLS))
_OPENING = {start: (role, end) for role, (start, end) in MARKS.items()}


def escape(text: str) -> str:
    """One more backslash after the first character of whatever reads as a control string, escaped or not."""
    return _LOOKALIKE.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns, and the ascending spans of the texts that count in the loss."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        if role in MARKS:
            head, tail = MARKS[role]
        else:
            head, tail = f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2]
        body = escape(text)
        if role in LOSS_ROLES:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation: the inverse of :func:`render`."""
    turns, at = [], 0
    while at < len(rendered):
        mark = _CONTROL.match(rendered, at)
        if mark is None:
            raise ValueError(f"no turn begins at {at}")
        at = mark.end()
        if mark[0] == OTHER[0]:
            close = rendered.index(OTHER[1], at)
            role, end, at = unescape(rendered[at:close]), OTHER[2], close + len(OTHER[1])
        else:
            role, end = _OPENING[mark[0]]
        close = _CONTROL.search(rendered, at)
        if close is None or close[0] != end:
            raise ValueError(f"the turn at {at} does not end")
        turns.append((role, unescape(rendered[at : close.start()])))
        at = close.end()
    return turns


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
    return out


def loss_mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span, by binary search of each span's edges among the sorted token edges."""
    mask = np.zeros(len(starts) + 1, dtype=np.int64)
    if spans:
        edges = np.array(spans)
        first, last = np.searchsorted(ends, edges[:, 0], side="right"), np.searchsorted(starts, edges[:, 1], side="left")
        keep = first < last
        np.add.at(mask, first[keep], 1)
        np.add.at(mask, last[keep], -1)
    return np.cumsum(mask)[:-1] > 0


FORMATTED = "conv_id long, piece int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def format_conversations(conversations: DataFrame, path: str = CHAT_BPE) -> DataFrame:
    """Rendered conversations with token ids, offsets and loss mask: a row for each conversation.

    A conversation longer than ``PIECE_CHARS`` gives several rows, numbered by ``piece`` and adjacent in the partition, so
    that no worker ever holds more than that of one conversation. A conversation's turns are needed in order, so it is one task,
    however long, and so are all rows with a null id. Turns are ordered by ``turn`` (null first), then
    role, then text. Null texts and roles count as empty; rows with a null id form one conversation; identical
    rows are turns each. An empty table gives no rows; other columns are ignored.
    """
    n = shuffle_partitions(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([
        ("conv_id", pa.int64()), ("piece", pa.int32()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())),
        ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())),
    ])

    def encoded(held: list[tuple[int | None, int, list[tuple[str, str]]]]) -> pa.RecordBatch:
        texts, spans = zip(*(render(turns) for _, _, turns in held))
        out: list[list] = [[c for c, _, _ in held], [p for _, p, _ in held], list(texts), [], [], [], []]
        for e, wanted in zip(_tokenizer(path).encode_batch(list(texts), add_special_tokens=False), spans):
            offsets = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            for column, value in zip(out[3:], (e.ids, offsets[:, 0], offsets[:, 1], loss_mask(wanted, offsets[:, 0], offsets[:, 1]))):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, list[tuple[str, str]]]] = []
        size = since = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if not held or held[-1][0] != conv or since > PIECE_CHARS:
                    piece = held[-1][1] + 1 if held and held[-1][0] == conv else 0
                    if size > PIECE_CHARS:
                        yield encoded(held)
                        held, size = [], 0
                    held.append((conv, piece, []))
                    since = 0
                held[-1][2].append((role, text))
                size += len(text)
                since += len(text)
        if held:
            yield encoded(held)

    return rows.mapInArrow(run, FORMATTED)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The unescaped text of each run of masked tokens, by their offsets."""
    edges = np.diff(np.concatenate([[0], loss.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    return [unescape(formatted[starts[a] : ends[b]]) for a, b in zip(first, last)]


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what a formatted table says, read back from it alone. Pieces must be adjacent."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list | None = None  # id, turns, digest of turns, loss characters, digest of loss, characters

        def closed(rows: list[list]) -> pa.RecordBatch:
            cells = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [f.split()[0] for f in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*cells), kinds)], names=names)

        for batch in batches:
            done: list[list] = []
            cells = {c: batch.column(c) for c in ("conv_id", "piece", "formatted", "starts", "ends", "loss")}
            for k in range(batch.num_rows):
                conv, piece, text = (cells[c][k].as_py() for c in ("conv_id", "piece", "formatted"))
                starts, ends, loss = (cells[c][k].values.to_numpy(zero_copy_only=False) for c in ("starts", "ends", "loss"))
                if open_ is None or piece == 0:
                    if open_ is not None:
                        done.append(open_)
                    open_ = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = parse(text)
                open_[1] += len(turns)
                open_[2].update("".join(f"{role}\n{body}\n" for role, body in turns).encode())
                masked = "".join(masked_text(text, starts, ends, loss))
                open_[3] += len(masked)
                open_[4].update(masked.encode())
                open_[5] += len(text)
            if done:
                yield closed(done)
        if open_ is not None:
            yield closed([open_])

    return formatted.mapInArrow(run, schema)
