"""Packing tokenised documents into fixed-length training sequences.

A bin is described by the lengths it holds, and equal bins by one pattern and a multiplicity, so the
planner's state depends on the capacity and never on the size of the corpus: the histogram of piece lengths
has at most ``capacity`` rows. Best fit gives the first packing; local search then exchanges one or two pieces
for one or two, or moves them, between underfull bins, in as many equal bins at once as there are. Every exchange
increases the sum of squared fills, so it ends, and it empties bins. The plan is a small table of rank ranges by length; each piece finds its
place from its rank among the pieces of its length, which is computed by salted, distributed counts.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_alphabet, gather
from .common import Scratch, give_back_memory, shuffle_partitions, text_or_empty, vocabulary

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
WORD_BPE = vocabulary("word_bpe_49k.json")
CAPACITY = 2048
SEPARATOR = 0
#: Words of a generation, of which a worker remembers two (what is forgotten costs time and never results), and bytes of text encoded at once.
CACHE_WORDS, SLICE_BYTES, WORDS_AT_ONCE = 400_000, 4 << 20, 16_384

_SPACED = np.where(np.isin(np.arange(256), [9, 10, 13]), 32, np.arange(256)).astype(np.uint8)
#: Letters whose lower case and normal form depend on nothing around them, and pieces as the file's pre-tokeniser cuts them.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ž"
_PLAIN = re.compile(f"[{_LETTERS}!-&(-~]+")  # no apostrophe, which begins contractions
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_BYTE_NAMES = {b: c for c, b in byte_alphabet().items()}


class WordEncoder:
    """Ids of the library, word by word. The pre-tokeniser drops white space, so words encode independently.

    The words of a whole slice become numbers first (Arrow's dictionary), each distinct one is looked up once, and ids are gathered
    by number. New words of Latin letters and printable ASCII are normalised and split here, by the file's own rules, and given to
    its model alone; all other words take the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._bare = Tokenizer(self.tokenizer.model) if _is_usual(spec) else None
        self._specials = tuple(t["content"] for t in spec["added_tokens"])
        self._forget()

    def _forget(self) -> None:
        """The young generation becomes the old one. Words that come again move back."""
        self._old = getattr(self, "_index", {}), getattr(self, "_flat", None), getattr(self, "_start", None), getattr(self, "_count", None)
        self._index: dict[str, int] = {}
        self._flat, self._used = np.zeros(1 << 16, dtype="<u4"), 0
        self._start, self._count = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 16, dtype=np.int32)

    def _recall(self, words: list[str]) -> list[str]:
        """Take words of the old generation into the young one; those that are in neither."""
        index, flat, start, count = self._old
        codes = list(map(index.get, words))
        found = np.array([c for c in codes if c is not None], dtype=np.int64)
        if len(found):
            self._add([w for w, c in zip(words, codes) if c is not None], gather(flat, start[found], count[found]), count[found])
        return [w for w, c in zip(words, codes) if c is None]

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        at, n = self._used, len(self._index)
        while len(self._flat) < at + len(ids):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while len(self._start) < n + len(words):
            self._start, self._count = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._count))
        self._flat[at : at + len(ids)] = ids
        self._count[n : n + len(words)] = counts
        self._start[n : n + len(words)] = at + np.cumsum(counts) - counts
        self._used = at + len(ids)
        self._index.update(zip(words, range(n, n + len(words))))

    def _learn(self, new: list[str]) -> None:
        """Encode words and add them to the table."""
        other, pieces, owner = [], [], []
        plain = _PLAIN.fullmatch if self._bare is not None else lambda _: False
        for k, word in enumerate(new):
            if not plain(word) or "<" in word and any(x in word for x in self._specials):
                other.append(k)
                continue
            if not word.isascii():
                word = word.lower()
                parts = (word,) if word.isalpha() else _PIECES.findall(word)
                pieces += [x.encode().decode("latin-1").translate(_BYTE_NAMES) for x in parts]
            elif word.isalpha():
                pieces.append(word.lower())
                owner.append(k)
                continue
            else:
                parts = _PIECES.findall(word.lower())
                pieces += parts
            owner += [k] * len(parts)
        ids, whose = [np.zeros(0, "<u4")], [np.zeros(0, np.int32)]
        for tokenizer, words, of in ((self._bare, pieces, owner), (self.tokenizer, [new[k] for k in other], other)):
            for at in range(0, len(words), WORDS_AT_ONCE):  # the library holds much for each word that it encodes
                done = tokenizer.encode(words[at : at + WORDS_AT_ONCE], is_pretokenized=True, add_special_tokens=False)
                ids.append(np.array(done.ids, dtype="<u4"))
                whose.append(np.array(of[at : at + WORDS_AT_ONCE], dtype=np.int32)[np.array(done.word_ids, dtype=np.int32)])
        whose = np.concatenate(whose)
        self._add(new, np.concatenate(ids)[np.argsort(whose, kind="stable")], np.bincount(whose, minlength=len(new)))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's end. No text may be null."""
        words = pc.split_pattern(_with_spaces(texts), " ")
        numbered = words.flatten().dictionary_encode()
        held = numbered.dictionary.to_pylist()
        codes = list(map(self._index.get, held))
        if None in codes:
            new = [w for w, c in zip(held, codes) if c is None]
            if len(self._index) + len(new) > CACHE_WORDS:
                self._forget()
                codes, new = [None] * len(held), held
            self._learn(self._recall(new))
            codes = [self._index[w] if c is None else c for w, c in zip(held, codes)]
        code = np.array(codes, dtype=np.int32)[numbered.indices.to_numpy(zero_copy_only=False)]
        counts = self._count[code]
        offsets = words.offsets.to_numpy(zero_copy_only=False)
        return gather(self._flat, self._start[code], counts), np.concatenate([[0], np.cumsum(counts)])[offsets[1:] - offsets[0]]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        ids, ends = self.encode(pa.array(texts, pa.string()))
        return np.split(ids, ends[:-1]) if texts else []


def _is_usual(spec: dict) -> bool:
    """Whether words may be normalised and split here: the file's rules are those that ``_PLAIN`` and ``_PIECES`` follow."""
    normalizer, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    rules = [(n.get("type"), (n.get("pattern") or {}).get("Regex"), n.get("content")) for n in normalizer.get("normalizers", [])]
    parts = splitter.get("pretokenizers", [])
    return (
        rules == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)] and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"} and not parts[1]["add_prefix_space"] and not parts[1]["use_regex"]
    )


def _with_spaces(texts: pa.StringArray) -> pa.StringArray:
    """Tabs and line ends as spaces, in a copy of the bytes."""
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    changed = _SPACED[np.frombuffer(data, dtype=np.uint8)]
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(changed), offset=texts.offset)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_pieces(documents: DataFrame, path: str = WORD_BPE, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids and separator, cut at the capacity.

    Null and empty texts give the separator alone. Repeated rows give repeated pieces. Texts are encoded a few megabytes at a
    time, or one at a time where a single one is longer.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(doc_ids: pa.Array, texts: pa.StringArray) -> pa.RecordBatch:
        ids, ends = _encoder(path).encode(texts)
        ids = np.insert(ids, ends, SEPARATOR)
        lengths = np.diff(ends, prepend=0) + 1
        pieces = -(-lengths // capacity)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(lengths[owner] - start, capacity)
        first = (np.cumsum(lengths) - lengths)[owner] + start
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
        cells = [doc_ids.take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(cells, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right")))
                yield cut(batch.column(0).slice(at, to - at), batch.column(1).slice(at, to - at))
                at = to
                give_back_memory()

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Bins:
    """``count`` equal bins: how often each length stands in one of them."""

    items: Counter
    count: int

    @property
    def fill(self) -> int:
        return sum(length * n for length, n in self.items.items())


def best_fit(histogram: dict[int, int], capacity: int) -> list[Bins]:
    """Best fit in decreasing order, on whole classes of equal lengths and equal bins."""
    by_room: dict[int, list[Bins]] = defaultdict(list)
    rooms: list[int] = []

    def put(bins: Bins, room: int) -> None:
        if bins.count:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(bins)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):  # open new bins
                per = min(capacity // length, left)
                put(Bins(Counter({length: per}), n := left // per), capacity - per * length)
                left -= n * per
                continue
            room = rooms[k]
            bins = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            per = min(room // length, left)
            n = min(bins.count, left // per)
            put(Bins(bins.items.copy(), bins.count - n), room)
            put(Bins(bins.items + Counter({length: per}), n), room - per * length)
            left -= n * per
    return [b for room in sorted(by_room) for b in by_room[room]]


Pattern = tuple[tuple[int, int], ...]


def _picks(pattern: Pattern) -> dict[int, tuple[int, ...]]:
    """One or two pieces of a bin, by the sum of their lengths."""
    out = {a + b: (a, b) for k, (a, n) in enumerate(pattern) for b, _ in pattern[k:] if a != b or n > 1}
    return out | {a: (a,) for a, _ in pattern}


class Shelf:
    """Underfull patterns and their multiplicities, found by room."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count: dict[Pattern, int] = {}
        self.picks: dict[Pattern, dict[int, tuple[int, ...]]] = {}
        self.by_room: dict[int, dict[Pattern, None]] = defaultdict(dict)
        self.rooms: list[int] = []
        self.sums: dict[Pattern, list[int]] = {}  # ascending: what may come back
        self.born: dict[int, int] = {}  # by room: when a pattern last came there
        self.clock = 0

    def room(self, pattern: Pattern) -> int:
        return self.capacity - sum(length * n for length, n in pattern)

    def add(self, pattern: Pattern, n: int) -> None:
        """A second bin of a pattern counts as new, for bins of one pattern may exchange among themselves."""
        room, before = self.room(pattern), self.count.get(pattern, 0)
        self.count[pattern] = before + n
        if not before:
            if not self.by_room[room]:
                insort(self.rooms, room)
            self.by_room[room][pattern] = None
            self.picks[pattern] = _picks(pattern)
            self.sums[pattern] = [0, *sorted(self.picks[pattern])]
        if before < 2:
            self.clock += 1
            self.born[room] = self.clock

    def take(self, pattern: Pattern, n: int) -> None:
        self.count[pattern] -= n
        if not self.count[pattern]:
            room = self.room(pattern)
            del self.count[pattern], self.picks[pattern], self.sums[pattern], self.by_room[room][pattern]
            if not self.by_room[room]:
                self.rooms.pop(bisect_left(self.rooms, room))

    def exchange(self, donor: Pattern, since: int) -> tuple[Pattern, tuple[int, ...], tuple[int, ...], int] | None:
        """The exchange that carries most, over all its bins, from the donor into bins as full or fuller, in a room where a
        pattern came later than ``since``: the receiver, what goes, what comes back, and in how many bins."""
        most, found = 0, None
        held = self.count[donor]
        goes = sorted(self.picks[donor], reverse=True)
        for k in range(bisect_right(self.rooms, self.room(donor)) - 1, -1, -1):
            room = self.rooms[k]
            if room * held <= most:  # no gain exceeds the room
                break
            if self.born[room] <= since:
                continue
            for target in self.by_room[room]:
                n = held // 2 if target == donor else min(held, self.count[target])
                if room * n <= most:
                    continue
                sums = self.sums[target]
                for length in goes:
                    if length * n <= most:
                        break
                    at = bisect_left(sums, length - room)
                    if at < len(sums) and (length - sums[at]) * n > most:
                        most, found = (length - sums[at]) * n, (target, length, sums[at], n)
        if found is None:
            return None
        target, length, back, n = found
        return target, self.picks[donor][length], self.picks[target][back] if back else (), n


def _changed(pattern: Pattern, off: tuple[int, ...], on: tuple[int, ...]) -> Pattern:
    items = Counter(dict(pattern))
    items.subtract(off)
    items.update(on)
    return tuple(sorted((length, n) for length, n in items.items() if n))


def local_search(bins: list[Bins], capacity: int) -> list[Bins]:
    """Empty the least filled bins again and again, until no pattern has an exchange or no bin can be saved.

    An exchange is done in as many bins at once as both patterns have. A pattern that finds none is tried again only
    with the rooms where others came since.
    """
    least = -(-sum(b.fill * b.count for b in bins) // capacity)
    total = sum(b.count for b in bins)
    shelf, full = Shelf(capacity), Counter()
    waiting: list[tuple[int, Pattern]] = []  # a heap, most room first
    tried: dict[Pattern, int] = {}

    def put(pattern: Pattern, n: int) -> None:
        if pattern and shelf.room(pattern):
            if pattern not in shelf.count:
                tried[pattern] = 0
                heappush(waiting, (-shelf.room(pattern), pattern))
            shelf.add(pattern, n)
        elif pattern:
            full[pattern] += n

    for b in bins:
        if b.count:
            put(_changed((), (), tuple(b.items.elements())), b.count)
    while total > least:
        if not waiting:
            last = sorted((r, shelf.born[r]) for r in shelf.rooms)
            newest = dict(zip((r for r, _ in last), accumulate((t for _, t in last), max)))  # of all rooms up to this one
            waiting = [(-r, p) for r in shelf.rooms for p in shelf.by_room[r] if newest[r] > tried[p]]
            heapify(waiting)
            if not waiting:
                break
        _, donor = heappop(waiting)
        while total > least and donor in shelf.count:
            done = shelf.exchange(donor, tried[donor])
            if done is None:
                tried[donor] = shelf.clock
                break
            target, goes, back, n = done
            shelf.take(donor, n)
            shelf.take(target, n)
            left = _changed(donor, goes, back)
            put(_changed(target, back, goes), n)
            put(left, n)
            total -= 0 if left else n
    return [Bins(Counter(dict(p)), n) for x in (full, shelf.count) for p, n in x.items()]


@dataclass(frozen=True)
class Runs:
    """Rank ranges by length: arrays of first rank, first sequence, offset in it and pieces per sequence."""

    table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, sequence, offset, per = self.table[length]
        k = np.searchsorted(first, rank, side="right") - 1
        nth = rank - first[k]
        return sequence[k] + nth // per[k], offset[k] + length * (nth % per[k])


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Runs:
    """Where the pieces of each length go, by their rank among the pieces of that length."""
    runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for bins in local_search(best_fit(histogram, capacity), capacity):
        at = 0
        for length in sorted(bins.items, reverse=True):
            per = bins.items[length]
            runs[length].append((used[length], sequence, at, per))
            used[length] += per * bins.count
            at += length * per
        sequence += bins.count
    return Runs({length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for length, rows in runs.items()})


def pack_documents(documents: DataFrame, path: str = WORD_BPE, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there.

    Only metadata of the pieces is shuffled, never text or ids. A third of all rows may share one length: ranks are taken
    by length and salt. An empty table gives an empty result; null texts count as empty; identical rows are
    packed each; other columns are ignored.
    """
    spark = documents.sparkSession
    pieces = Scratch(spark, "packing").keep(token_pieces(documents, path, capacity))
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shuffle_partitions(spark))).cast("int").alias("salt")
    salted = pieces.withColumn("salt", salt)
    counts = salted.groupBy("length", "salt").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    runs = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    own = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        salted.withColumn("nth", F.row_number().over(own) - 1).join(offsets, ["length", "salt"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("ahead")).cast("long").alias("rank"))
    )

    def assign(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                sequence[rows], offset[rows] = runs.value.place(int(length[rows[0]]), rank[rows])
            columns = [batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
