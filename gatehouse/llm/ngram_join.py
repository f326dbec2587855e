"""Exact n-gram Jaccard join and its connected components, filtered under several global token orders.

If two sets reach the threshold, the beginnings (prefixes) of both share a token under every order of all tokens.
The first order puts rare tokens first, by counts over the whole corpus. Two documents are near when they share a prefix
token under it and neither their sizes nor their marks (how many of their tokens fall into each of a few
buckets) rule a link out; documents that nearness connects, however indirectly, form a family, and every link lies inside
one. Families are metadata, so a set moves only once, to its family's cell. There a pair must share a prefix token
under the other orders too, and only what passes all of them is verified.

Equal sets are one node. A family that is too large for a cell is dealt into blocks of bounded size: each block links its own
members, what is linked becomes one component, and then only blocks that hold different components meet. Pairs
inside a component are never compared, pairs are never rows, and no link between different components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh128_digest

from .common import HOT_SHARE, Scratch, give_back_memory, join_spread, shuffle_partitions

#: Multipliers that break ties in each global order; the first order generates, the others filter.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Bits of a frequency class that each order looks at: finely, coarsely, not at all.
CLASS_SHIFT = (0, 3, 6)
#: Counters of the frequency sketch, as powers of two: about one for each document within these bounds.
SKETCH_BITS = (14, 24)
SKETCH_BLOCK = 4096
#: Sets, and tokens in them, that one side of a cell holds: beyond either, a family is dealt into blocks.
CELL_SETS, CELL_TOKENS = 512, 1 << 19
#: Buckets of a document's marks: tokens counted by hash, 255 at most in each.
MARKS = 128
#: Links that one task joins at most, tokens that it remembers at once, and matrix cells in a tile.
TASK_LINKS, TASK_TOKENS, TILE_CELLS = 250_000, 500_000, 1 << 22
#: Bits of the bitmaps and of their parts, as powers of two; tokens that a task holds for them; ids that are broadcast at most (8 MB).
MAP_BITS, PART_BITS, PART_TOKENS, BROADCAST_IDS = (20, 28), (4, 18), 1_000_000, 1_000_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)  # one fixed table everywhere
_BASE, KEPT_POWERS = 0x9E3779B97F4A7C15, 1 << 20
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words in order: differences of one prefix sum of a polynomial modulo 2^64."""
    code = np.frombuffer(raw, dtype=np.uint8)
    n = len(code)
    while len(_POWERS["up"]) < n:
        m = len(_POWERS["up"])
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _POWERS[name] = np.concatenate([_POWERS[name], _POWERS[name] * np.uint64(pow(base, m, 1 << 64))])
    edges = np.flatnonzero(np.diff(~_IS_SPACE[code], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[code] * _POWERS["up"][:n], out=sums[1:])
    out = (sums[ends] - sums[starts]) * _POWERS["down"][starts]
    out ^= out >> np.uint64(32)
    if len(_POWERS["up"]) > KEPT_POWERS:  # one very long text must not fill the worker for good
        _POWERS.update({name: x[:KEPT_POWERS].copy() for name, x in _POWERS.items()})
    return out * np.uint64(ORDERS[2])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Ascending hashes of the distinct word n-grams of a whole text, A-Z lower-cased.

    A text with fewer words has one shingle, the whole sequence; without words or text the set is empty.
    """
    code = _word_hashes((text or "").encode().translate(_LOWER))
    if not len(code):
        return np.zeros(0, np.uint64)
    span = min(width, len(code))
    out = np.full(len(code) - span + 1, span, np.uint64)
    for k in range(span):
        out = (out ^ code[k : len(code) - span + 1 + k]) * np.uint64(ORDERS[0])
        out ^= out >> np.uint64(31)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


@dataclass(frozen=True)
class Rule:
    """Link when 100 * intersection >= percent * union, on sets of ``width``-word shingles."""

    width: int = 5
    percent: int = 80

    def prefix(self, size: int) -> int:
        return size - -(-self.percent * size // 100) + 1

    def links(self, common, a, b):
        return (100 + self.percent) * common >= self.percent * (a + b)


def _spread(tokens: np.ndarray) -> np.ndarray:
    """Tokens mixed anew: the high bits choose the part and the place of a token in a bitmap."""
    mixed = tokens * np.uint64(0xA0761D6478BD642F)
    return (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Bitmap:
    """Which tokens several documents hold, by a bit each: it may say so wrongly, never the opposite."""

    bits: int
    parts: int
    data: np.ndarray

    def holds(self, tokens: np.ndarray) -> np.ndarray:
        at = _spread(tokens) >> np.uint64(64 - self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


@dataclass(frozen=True)
class TokenOrders:
    """Global orders of all tokens: those that no other document is known to hold first, then by class of frequency as finely as
    the order looks at it, then by a hash of the order's own. Any fixed function of the token gives an order; these keep families small."""

    bits: int
    classes: np.ndarray
    repeated: Bitmap

    def keys(self, tokens: np.ndarray, which: int) -> np.ndarray:
        classes = (self.classes[tokens >> np.uint64(64 - self.bits)] >> CLASS_SHIFT[which]).astype(np.uint64) << np.uint64(57)
        return (self.repeated.holds(tokens).astype(np.uint64) << np.uint64(63)) | classes | (_order_hash(tokens, which) >> np.uint64(7))

    def prefix(self, tokens: np.ndarray, which: int, n: int) -> np.ndarray:
        """The first n tokens in the order."""
        keys = self.keys(tokens, which)
        first = np.argpartition(keys, n - 1)[:n] if n < len(tokens) else np.arange(len(tokens))
        return tokens[first[np.argsort(keys[first])]]


def _order_hash(tokens: np.ndarray, which: int) -> np.ndarray:
    mixed = tokens * np.uint64(ORDERS[which])
    mixed ^= mixed >> np.uint64(32)
    return mixed * np.uint64(ORDERS[which])


def _least(tokens: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    return tokens[np.argpartition(keys, n - 1)[:n]] if n < len(tokens) else tokens


class _Parts:
    """Tokens of a task by part, 32 bits each, to find those that several documents hold."""

    def __init__(self, part_bits: int) -> None:
        self.part_bits, self.held, self.size = part_bits, [], 0

    def add(self, tokens: np.ndarray) -> None:
        self.held.append(_spread(tokens) >> np.uint64(32 - self.part_bits))
        self.size += len(tokens)

    def packed(self) -> tuple[list[int], list[bytes]]:
        """Of a token that is here more than twice two copies say as much."""
        rows = np.sort(np.concatenate(self.held)) if self.size else np.zeros(0, np.uint64)
        self.held, self.size = [], 0
        if len(rows) > 2:
            rows = rows[np.concatenate([[True, True], rows[2:] != rows[:-2]])]
        part = (rows >> np.uint64(32)).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(rows)]]) if len(rows) else np.zeros(1, np.int64)
        low = rows.astype(np.uint32)
        return [int(part[i]) for i in edges[:-1]], [low[i:j].astype("<u4").tobytes() for i, j in zip(edges[:-1], edges[1:])]


def _bitmap(parts: DataFrame, bits: int, part_bits: int) -> Bitmap:
    """The bitmap of the tokens that occur twice in ``part, packed``: each part yields its slice, 32 MB in all at most."""

    def repeated(table: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([np.frombuffer(x.as_py(), dtype="<u4") for x in table.column("packed")]))
        again = values[1:][values[1:] == values[:-1]] >> np.uint32(32 - (bits - part_bits))
        flags = np.zeros(1 << (bits - part_bits), np.uint8)
        flags[again] = 1
        return pa.table({"part": table.column("part")[:1], "flags": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    data = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (bits - part_bits - 3)
    for row in parts.groupBy("part").applyInArrow(repeated, "part int, flags binary").collect():
        data[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["flags"], dtype=np.uint8)
    return Bitmap(bits, part_bits, data)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.frombuffer(b"".join(xxh128_digest(s.tobytes()) for s in sets), dtype="<i8").reshape(-1, 2)


def _summaries(documents: DataFrame, rule: Rule, bits: int, part_bits: int) -> DataFrame:
    """A row for each document (its set's size and digest); for each task, its counts of tokens by sketch block and, by
    part, the tokens that come first in each document by hash, twice as many as a prefix holds."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("block", pa.int32()), ("part", pa.int32()), ("packed", pa.binary()),
    ])

    def extra(column: str, numbers: list[int], data: list[bytes]) -> pa.RecordBatch:
        n = len(numbers)
        cells = {"block": pa.nulls(n, pa.int32()), "part": pa.nulls(n, pa.int32())} | {column: pa.array(numbers, pa.int32())}
        return pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 4, cells["block"], cells["part"], pa.array(data, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parts = np.zeros(1 << bits, np.int64), _Parts(part_bits)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t, rule.width) for t in texts.slice(at, 512).to_pylist()]
                np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), 1)
                for s in sets:
                    if len(s):
                        parts.add(_least(s, _order_hash(s, 0), 2 * rule.prefix(len(s))))
                if parts.size > PART_TOKENS:
                    yield extra("part", *parts.packed())
                digests = _digests(sets)
                n = len(sets)
                columns = [ids.slice(at, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1])]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(n, pa.int32())] * 2, pa.nulls(n, pa.binary())], schema=schema)
        blocks = counts.astype("<i8").reshape(-1, SKETCH_BLOCK)
        used = [k for k in range(len(blocks)) if blocks[k].any()]
        if used:
            yield extra("block", used, [blocks[k].tobytes() for k in used])
        if parts.size:
            yield extra("part", *parts.packed())
        give_back_memory()

    source = documents.select("rep", F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, block int, part int, packed binary")


def _orders(summaries: DataFrame, bits: int, map_bits: int, part_bits: int) -> TokenOrders:
    """Frequency classes from the counts of all documents, a byte for each counter, and the bitmap of repeated tokens."""

    def total(table: pa.Table) -> pa.Table:
        summed = sum(np.frombuffer(x.as_py(), dtype="<i8") for x in table.column("packed"))
        return pa.table({"block": table.column("block")[:1], "packed": pa.array([summed.tobytes()], pa.binary())})

    blocks = summaries.where("block IS NOT NULL").select("block", "packed").groupBy("block").applyInArrow(total, "block int, packed binary")
    counts = np.zeros(1 << bits, np.int64)
    for row in blocks.collect():  # one row of 32 KB for each of the sketch's blocks
        counts[row["block"] * SKETCH_BLOCK : (row["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(row["packed"], dtype="<i8")
    ratio = counts / max(1.0, counts.mean())
    classes = np.clip(np.floor(2 * np.log2(np.maximum(ratio, 1.0))), 0, 63).astype(np.uint8)
    return TokenOrders(bits, classes, _bitmap(summaries.where("part IS NOT NULL").select("part", "packed"), map_bits, part_bits))


def _prefixes(documents: DataFrame, rule: Rule, shared) -> DataFrame:
    """``rep, size, marks, prefix, d1, d2``: each document's marks, prefix tokens under the generating order, and its set's digest."""
    schema = pa.schema([("rep", pa.int64()), ("size", pa.int32()), ("marks", pa.binary()), ("prefix", pa.list_(pa.int64())), ("d1", pa.int64()), ("d2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t, rule.width) for t in batch.column(1).slice(at, 512).to_pylist()]
                prefixes = [shared.value.prefix(s, 0, rule.prefix(len(s))).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
                digests = _digests(sets)
                marks = [np.minimum(np.bincount((s >> np.uint64(5)).astype(np.int64) % MARKS, minlength=MARKS), 255).astype(np.uint8).tobytes() for s in sets]
                columns = [batch.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int32()), pa.array(marks, pa.binary()), pa.array(prefixes, type=schema.field(3).type)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests[:, 0]), pa.array(digests[:, 1])], schema=schema)
            give_back_memory()

    return documents.select("rep", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "rep long, size int, marks binary, prefix array<long>, d1 long, d2 long")


def _in_several(prefixes: DataFrame, map_bits: int, part_bits: int) -> DataFrame:
    """``rep, size, marks, tokens``: the prefix tokens that more than one document may share, of documents that have any; the
    others go before any shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(part_bits)

        def out() -> pa.RecordBatch:
            numbers, data = parts.packed()
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(data, pa.binary())], names=["part", "packed"])

        for batch in batches:
            parts.add(batch.column("prefix").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            if parts.size > PART_TOKENS:
                yield out()
        if parts.size:
            yield out()

    repeated = prefixes.sparkSession.sparkContext.broadcast(_bitmap(prefixes.select("prefix").mapInArrow(pack, "part int, packed binary"), map_bits, part_bits))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix")
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            offsets = lists.offsets.to_numpy(zero_copy_only=False)
            held = repeated.value.holds(tokens.view(np.uint64))
            ends = np.concatenate([[0], np.cumsum(held)])[offsets - offsets[0]]
            rows = np.flatnonzero(np.diff(ends))
            chosen = pa.ListArray.from_arrays(pa.array(np.concatenate([ends[rows], ends[-1:]]).astype(np.int32)), pa.array(tokens[held]))
            columns = [batch.column(c).take(pa.array(rows)) for c in ("rep", "size", "marks")]
            yield pa.RecordBatch.from_arrays([*columns, chosen], names=["rep", "size", "marks", "tokens"])

    return prefixes.select("rep", "size", "marks", "prefix").mapInArrow(keep, "rep long, size int, marks binary, tokens array<long>")


class _Forest:
    """Unions of anything hashable; the smallest is the root."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        top = x
        while self.parent.setdefault(top, top) != top:
            top = self.parent[top]
        while self.parent[x] != top:
            self.parent[x], x = top, self.parent[x]
        return top

    def join(self, a, b) -> bool:
        """Whether this joined what was apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def stars(self, roots: bool = False) -> list[tuple]:
        return [(x, r) for x in self.parent if (r := self.find(x)) != x or roots]


def _local_stars(edges: DataFrame, roots: bool = False) -> DataFrame:
    """Each task joins the edges it holds: ``node, root`` with the smallest node of each local component, itself included with ``roots``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        rows = forest.stars(roots)
        for at in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 50_000])], names=["node", "root"])

    return edges.mapInArrow(run, "node long, root long")


def connected_components(edges: DataFrame, scratch: Scratch, roots: bool = False) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` that is not its component's smallest; with ``roots``, for that too.

    Each task joins about ``TASK_LINKS`` edges; links that fit one task are done at once. Else rounds of minimum roots
    and pointer jumping follow, until every node has one root that is nobody's node. Nothing is collected; every
    round is written and the one before it deleted.
    """

    def dealt(links: DataFrame) -> tuple[DataFrame, int]:
        tasks = -(-links.count() // TASK_LINKS)
        return (links.coalesce(tasks) if tasks else links), tasks

    links, tasks = dealt(edges.select("a", "b"))
    stars = scratch.keep(_local_stars(links, roots and tasks <= 1))
    while tasks > 1:
        stars = stars.distinct()
        least = stars.groupBy("node").agg(F.min("root").alias("least"), F.count("*").alias("n"))
        up = least.select(F.col("node").alias("least"), F.col("least").alias("above"))
        marked = scratch.keep(stars.join(least, "node").join(up, "least", "left"))
        if marked.where("n > 1 OR above IS NOT NULL").isEmpty():
            done = marked.select("node", "root")
            return scratch.keep(done.unionByName(done.select(F.col("root").alias("node"), "root").distinct()) if roots else done)
        best = F.coalesce("above", "least")
        nodes = marked.select(F.col("node").alias("a"), best.alias("b"))
        others = marked.where(F.col("root") != best).select(F.col("root").alias("a"), best.alias("b"))
        middle = marked.where(F.col("above").isNotNull() & (F.col("least") != F.col("above"))).select(F.col("least").alias("a"), F.col("above").alias("b"))
        again = scratch.keep(nodes.unionByName(others).unionByName(middle).distinct())
        links, tasks = dealt(again)
        stars = scratch.keep(_local_stars(links, roots and tasks <= 1))
        scratch.drop(marked, again)
    return stars


def _family_edges(held: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``a, b`` that connect the ``rep`` that share one of their ``tokens``, however indirectly.

    Each task first joins what it holds, so a token that very many share is one row of each task from there on.
    """
    schema = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def out(token: list, a: list, b: list) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 50_000):
            cells = (token[at : at + 50_000], a[at : at + 50_000], b[at : at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], schema=schema)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, seen = _Forest(), {}

        def flush() -> Iterator[pa.RecordBatch]:
            yield from out(list(seen), [forest.find(r) for r in seen.values()], [None] * len(seen))
            stars = forest.stars()
            yield from out([None] * len(stars), [x for x, _ in stars], [r for _, r in stars])

        for batch in batches:
            for rep, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for token in tokens:
                    first = seen.setdefault(token, rep)
                    if first != rep:
                        forest.join(first, rep)
            if len(seen) > TASK_TOKENS:
                yield from flush()
                forest, seen = _Forest(), {}
        yield from flush()

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, last, first = _Forest(), None, None
        for batch in batches:
            for token, rep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if token != last:
                    last, first = token, rep
                elif rep != first:
                    forest.join(first, rep)
        stars = forest.stars()
        yield from out([None] * len(stars), [x for x, _ in stars], [r for _, r in stars])

    local = scratch.keep(held.select("rep", "tokens").mapInArrow(near, "token long, a long, b long"))
    met = local.where("token IS NOT NULL").select("token", "a").repartition(shuffle_partitions(held.sparkSession), "token").sortWithinPartitions("token")
    edges = scratch.keep(met.mapInArrow(far, "token long, a long, b long").unionByName(local.where("token IS NULL")).select("a", "b"))
    scratch.drop(local)
    return edges


def _members(held: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``held`` whose ``rep`` the edges connect with others, with their ``family``."""
    stars = connected_components(edges, scratch, roots=True)
    out = scratch.keep(held.join(stars.select(F.col("node").alias("rep"), F.col("root").alias("family")), "rep"))
    scratch.drop(stars)
    return out


def _near_edges(postings: DataFrame, rule: Rule) -> DataFrame:
    """Edges ``a, b`` that connect documents that share a token where sizes and marks allow a link, from ``token, rep, size, marks``.

    A task holds ``CELL_SETS`` rows of a token at most; what more documents share connects all of them, which makes families larger and loses none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        ahead: tuple[np.ndarray, ...] = ()
        common = None  # a token that very many share, and its first document

        def connect(token: np.ndarray, rep: np.ndarray, size: np.ndarray, marks: np.ndarray) -> None:
            for step in range(1, len(token)):
                at = np.flatnonzero(token[step:] == token[:-step])
                if not len(at):
                    break
                x, y = size[at], size[at + step]
                at = at[100 * np.minimum(x, y) >= rule.percent * np.maximum(x, y)]
                apart = np.abs(marks[at] - marks[at + step]).sum(axis=1, dtype=np.int64)
                at = at[(100 + rule.percent) * apart <= (100 - rule.percent) * (size[at] + size[at + step])]
                for a, b in zip(rep[at].tolist(), rep[at + step].tolist()):
                    forest.join(a, b)

        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, MARKS).astype(np.int16)
            rows = (*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), marks)
            if common is not None:
                n = int(np.searchsorted(rows[0], common[0], side="right"))
                for b in rows[1][:n].tolist():
                    forest.join(common[1], b)
                rows = tuple(r[n:] for r in rows)
                common = common if not len(rows[0]) else None
            if ahead:
                rows = tuple(np.concatenate(x) for x in zip(ahead, rows))
                ahead = ()
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [len(rows[0])]])
            short = np.ones(len(rows[0]), bool)
            for i, j in zip(starts[:-1], starts[1:]):
                if j - i > CELL_SETS:
                    short[i:j] = False
                    for b in rows[1][i + 1 : j].tolist():
                        forest.join(int(rows[1][i]), b)
                    if i == last:
                        common = (rows[0][i], int(rows[1][i]))
            if common is None:
                ahead = tuple(r[last:] for r in rows)
                short[last:] = False
            connect(*(r[short] for r in rows))
        if ahead:
            connect(*ahead)
        stars = forest.stars()
        for at in range(0, len(stars), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*stars[at : at + 50_000])], names=["a", "b"])

    dealt = postings.select("token", "rep", "size", "marks").repartition(shuffle_partitions(postings.sparkSession), "token").sortWithinPartitions("token")
    return dealt.mapInArrow(run, "a long, b long")


def _families(held: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """``rep, size, family`` of the documents that are near others, directly or not.

    Sharing any token comes first: it needs no sizes and no marks, and leaves out most documents. A token that more than a
    ``HOT_SHARE``th of the postings hold connects all that hold it.
    """
    edges = _family_edges(held, scratch)
    sharing = _members(held, edges, scratch)
    postings = sharing.select(F.explode("tokens").alias("token"), "rep", "size", "marks")
    total = postings.count()
    hot = scratch.keep(postings.groupBy("token").count().where(F.col("count") * HOT_SHARE > max(total, HOT_SHARE * CELL_SETS)).select("token"))  # fewer than HOT_SHARE
    rest = postings.join(F.broadcast(hot), "token", "left_anti")
    common = _family_edges(postings.join(F.broadcast(hot), "token").select("rep", F.array("token").alias("tokens")), scratch)
    near = scratch.keep(_near_edges(rest, rule).unionByName(common))
    out = _members(sharing.select("rep", F.col("size").cast("long").alias("size")), near, scratch)
    scratch.drop(edges, sharing, hot, common, near)
    return out


def _extents(members: DataFrame, *keys: str) -> DataFrame:
    """Rows and tokens of each key, and the blocks that they need."""
    blocks = F.ceil(F.greatest(F.col("n") / CELL_SETS, F.col("w") / CELL_TOKENS)).cast("long")
    return members.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("w")).withColumn("blocks", blocks)


def _only(rows: DataFrame, ids: DataFrame, key: str | list[str], how: str) -> DataFrame:
    """A join with few columns of distinct ids: a broadcast while these are few, by their count, else Spark's own choice."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def _sets(documents: DataFrame, rule: Rule, names: tuple[str, ...] = ()) -> DataFrame:
    """``rep``, the columns of whole numbers that are named, and ``tokens``: whole sets, ascending."""
    fields = ["rep", *names, "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                packed = [shingle_set(t, rule.width).astype("<u8").tobytes() for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(packed, pa.binary())], names=fields)

    source = documents.select("rep", *names, F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, ", ".join([*(f"{n} long" for n in fields[:-1]), "tokens binary"]))


def _overlaps(rows: list[np.ndarray], columns: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections, as products of 0/1 matrices over the tokens that can meet, a tile at a time. Without columns: of the rows among themselves."""
    sides = [*rows, *(columns or ())]
    n, total = len(rows), sum(map(len, rows))
    tokens, where = np.unique(np.concatenate(sides), return_inverse=True)
    here = np.bincount(where[:total], minlength=len(tokens))
    meets = here > 1 if columns is None else (here > 0) & (np.bincount(where[total:], minlength=len(tokens)) > 0)
    keep = meets[where]
    place = (np.cumsum(meets) - 1)[where[keep]]
    owner = np.repeat(np.arange(len(sides)), [len(x) for x in sides])[keep]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((n, n if columns is None else len(columns)))
    kinds = int(meets.sum())
    width = min(max(64, TILE_CELLS // len(sides)), max(1, kinds))
    for start in range(0, kinds, width):
        i, j = np.searchsorted(place, [start, start + width])
        tile = np.zeros((len(sides), width), np.float32)
        tile[owner[i:j], place[i:j] - start] = 1
        out += tile[:n] @ tile[n if columns is not None else 0 :].T
    return out


def cell_links(rows: list[tuple[int, int, int, np.ndarray]], rule: Rule, orders: TokenOrders) -> list[tuple[int, int]]:
    """Links that join different components among ``rep, component, side, tokens`` of a cell: all pairs of one side, or all pairs across two.

    A pair's sizes must fit and its prefixes share a token under every order before the sets themselves are intersected.
    """
    left, right = ([r for r in rows if r[2] == side] for side in (0, 1))
    one = not right
    sides = [left] if one else [left, right]
    right = right or left
    if not left or one and len(left) < 2:
        return []
    a, b = (np.array([len(r[3]) for r in side]) for side in (left, right))
    wanted = np.array([r[1] for r in left])[:, None] != np.array([r[1] for r in right])
    wanted &= 100 * np.minimum(a[:, None], b) >= rule.percent * np.maximum(a[:, None], b)
    if one:
        wanted = np.triu(wanted, 1)
    for k in range(len(ORDERS)):
        if not wanted.any():
            return []
        wanted &= _overlaps(*([orders.prefix(r[3], k, rule.prefix(len(r[3]))) for r in side] for side in sides)) > 0
    i, j = np.nonzero(wanted)
    if 2 * len(i) > len(left) + len(right):
        common = _overlaps(*([r[3] for r in side] for side in sides))[i, j]
    else:
        common = np.array([len(np.intersect1d(left[p][3], right[q][3], assume_unique=True)) for p, q in zip(i, j)], dtype=np.int64)
    linked = rule.links(common, a[i], b[j])
    forest = _Forest()
    return [(left[p][0], right[q][0]) for p, q in zip(i[linked].tolist(), j[linked].tolist()) if forest.join(left[p][1], right[q][1])]


def _compare(rows: DataFrame, rule: Rule, shared) -> DataFrame:
    """Links ``a, b`` of ``cell, side, rep, component, tokens``: each cell is dealt to one task and holds a bounded number of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, found = None, [], []

        def done() -> None:
            found.extend(cell_links(held, rule, shared.value))
            held.clear()

        for batch in batches:
            for key, side, rep, component, tokens in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                if key != cell:
                    done()
                    cell = key
                held.append((rep, component, side, np.frombuffer(tokens.as_buffer(), dtype="<u8")))
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
                found.clear()
        done()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])
        give_back_memory()

    dealt = rows.select("cell", "side", "rep", "component", "tokens").repartition(shuffle_partitions(rows.sparkSession), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "a long, b long")


def _large_links(documents: DataFrame, members: DataFrame, rule: Rule, shared, scratch: Scratch) -> DataFrame:
    """Links inside the families that need several blocks, ``members`` with ``rep, size, family``."""
    reps = members.select("rep").distinct()
    sets = scratch.keep(_sets(_only(documents, reps, "rep", "left_semi"), rule))

    total = members.count()
    extents = scratch.keep(_extents(members, "family").where("n > 1"))
    placed = scratch.keep(join_spread(members, extents, ["family"], "n", total).select(
        "rep", "size", "family", "blocks", F.xxhash64("family", F.pmod(F.xxhash64("rep"), "blocks")).alias("cell")
    ))
    first = placed.select("rep", "cell").distinct().join(sets, "rep").withColumn("side", F.lit(0)).withColumn("component", F.col("rep"))
    found = scratch.keep(_compare(first, rule, shared))
    several = placed.where("blocks > 1")
    stars = connected_components(found, scratch)
    named = scratch.keep(
        several.select("rep", "size", "family").join(stars.select(F.col("node").alias("rep"), "root").distinct(), "rep", "left")
        .select("rep", "size", "family", F.coalesce("root", "rep").alias("component"))
    )
    # components of half a block and more have blocks of their own, the others share some
    owns = scratch.keep(_extents(named, "family", "component").where(F.col("blocks") + F.col("n") / CELL_SETS >= 1.5))
    own = join_spread(named, owns.select("family", "component", "n", "blocks"), ["family", "component"], "n", total)
    shares = named.join(owns.select("family", "component"), ["family", "component"], "left_anti")
    pools = scratch.keep(_extents(shares, "family"))
    pooled = join_spread(shares, pools.select("family", "n", "blocks"), ["family"], "n", total)
    at = F.pmod(F.xxhash64("rep"), "blocks")
    blocked = scratch.keep(
        own.select("rep", "family", "component", F.col("component").alias("sole"), F.xxhash64("family", "component", at).alias("block"))
        .unionByName(pooled.select("rep", "family", "component", F.lit(None).cast("long").alias("sole"), F.xxhash64("family", at).alias("block")))
    )
    blocks = scratch.keep(blocked.select("family", "block", "sole").distinct())
    x, y = blocks.alias("x"), blocks.alias("y")
    apart = F.col("x.sole").isNull() | F.col("y.sole").isNull() | (F.col("x.sole") != F.col("y.sole"))
    meeting = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.block") <= F.col("y.block")) & apart)
    pair = F.xxhash64("x.block", "y.block").alias("cell")
    sides = F.when(F.col("x.block") == F.col("y.block"), F.array(F.struct(F.col("x.block").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("x.block").alias("block"), F.lit(0).alias("side")), F.struct(F.col("y.block").alias("block"), F.lit(1).alias("side")))
    )
    cells = scratch.keep(meeting.select(pair, F.explode(sides).alias("s")).select("cell", "s.block", "s.side"))
    second = blocked.select("rep", "component", "block").distinct().join(sets, "rep").join(cells, "block")
    more = scratch.keep(_compare(second, rule, shared))
    scratch.drop(sets, placed, named, owns, pools, blocked, blocks, cells)
    return found.unionByName(more)


def jaccard_components(documents: DataFrame, rule: Rule = Rule(), scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id``: a row for each input row, linked documents under their smallest id.

    Empty sets link with nothing. Rows that share an id are one node. A row with a null id links with nothing and has a null
    component. Null texts count as empty. An empty table gives no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    documents = documents.select(F.col("doc_id").cast("long").alias("rep"), "text")
    total = documents.count()
    scale = math.ceil(math.log2(total + 1))
    bits = max(SKETCH_BITS[0], min(SKETCH_BITS[1], scale))
    map_bits = max(MAP_BITS[0], min(MAP_BITS[1], scale + 6))
    part_bits = max(PART_BITS[0], min(PART_BITS[1], scale - 14))  # about 2^14 documents' prefixes in a part, whatever the corpus
    summaries = scratch.keep(_summaries(documents, rule, bits, part_bits))
    shared = spark.sparkContext.broadcast(_orders(summaries, bits, map_bits, part_bits))
    rows = scratch.keep(summaries.where("block IS NULL AND part IS NULL").select("doc_id", "n_shingles", "d1", "d2"))
    scratch.drop(summaries)
    linkable = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.keep(linkable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"))
    copies = scratch.keep(join_spread(linkable, classes, ["d1", "d2"], "copies", total).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), "d1", "d2"))

    others = copies.select(F.col("a").alias("rep"), "d1", "d2")  # by row: an id may have other texts besides
    prefixes = scratch.keep(_only(_prefixes(documents, rule, shared).where("rep IS NOT NULL AND size > 0"), others, ["rep", "d1", "d2"], "left_anti").drop("d1", "d2"))
    held = scratch.keep(_in_several(prefixes, map_bits, part_bits))
    members = _families(held, rule, scratch)
    scratch.drop(classes, prefixes, held)
    extents = scratch.keep(_extents(members, "family").where("n > 1"))
    small = scratch.keep(join_spread(members, extents.where("blocks = 1").select("family", "n"), ["family"], "n", total).select("rep", F.col("family").alias("cell")).distinct())
    sets = _sets(_only(documents, small, "rep", "inner"), rule, ("cell",))
    links = scratch.keep(_compare(sets.withColumn("side", F.lit(0)).withColumn("component", F.col("rep")), rule, shared))
    large = join_spread(members, extents.where("blocks > 1").select("family", "n"), ["family"], "n", total).select("rep", "size", "family")
    if not extents.where("blocks > 1").isEmpty():
        links = links.unionByName(_large_links(documents, scratch.keep(large), rule, shared, scratch))
    final = connected_components(links.unionByName(copies.select("a", "b")), scratch)
    scratch.drop_all_but(rows, final)
    shared.unpersist()
    joined = rows.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents that are the smallest id of their component, with all their columns, whatever these are called.

    Of identical rows with that id all stay; documents with empty texts or null ids stay. An empty table gives none.
    """
    scratch = Scratch(documents.sparkSession, "near-copies")
    dropped = scratch.keep(jaccard_components(documents, rule, scratch).where("component_id <> doc_id").select(F.col("doc_id").alias("dropped_id")).distinct())
    scratch.drop_all_but(dropped)
    few = F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped
    return documents.join(few, documents["doc_id"].cast("long") == few["dropped_id"], "left_anti")
