"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial hash of each of its prefixes, modulo a prime. The hash of
any span is then two look-ups, two spans are equal when their hashes are, and the longest common extension of
two positions is found by binary search. A fingerprint keeps samples of that array: hashes of prefixes
and of suffixes at lengths that grow geometrically, and the smallest hashes of all spans of a fixed width. While
both arrays are at hand, the likeness of two texts uses the exact lengths that they share; of two stored fingerprints,
the longest sampled ones.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sha256_hex, shuffle_partitions

#: Two primes below 2^31, so that products fit 64 bits, and a base for each.
PRIMES, BASES = (2_147_483_647, 2_147_483_629), (1_000_003, 998_244_353)
SPAN, SKETCH, KEPT_POWERS = 24, 64, 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of a base and of its inverse, grown on demand."""

    def __init__(self, prime: int, base: int) -> None:
        self.prime = np.uint64(prime)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self._base, self._inverse = base, pow(base, -1, prime)

    def grow(self, n: int) -> None:
        while len(self.up) <= n:
            m = len(self.up)
            for name, base in (("up", self._base), ("down", self._inverse)):
                have = getattr(self, name)
                setattr(self, name, np.concatenate([have, have * np.uint64(pow(base, m, int(self.prime))) % self.prime]))

    def shrink(self) -> None:
        """One very long text must not fill the worker for good."""
        if len(self.up) > KEPT_POWERS:
            self.up, self.down = self.up[:KEPT_POWERS].copy(), self.down[:KEPT_POWERS].copy()


_POWERS = [_Powers(p, b) for p, b in zip(PRIMES, BASES)]


def ladder(n: int) -> list[int]:
    """Lengths at which prefixes and suffixes are sampled: 1, 2, 3, 4, 6, 8, 12, ... up to n. They don't depend on n."""
    out, a = [], 1
    while a <= n:
        out.append(a)
        if a > 1 and a + a // 2 <= n:
            out.append(a + a // 2)
        a *= 2
    return out


class PrefixHashes:
    """Modular prefix arrays of a sequence of code points."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.arrays = arrays

    @classmethod
    def of(cls, text: str) -> PrefixHashes:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        arrays = []
        for p in _POWERS:
            p.grow(len(code))
            out = np.zeros(len(code) + 1, np.uint64)
            np.cumsum(code * p.up[: len(code)] % p.prime, out=out[1:])
            arrays.append(out % p.prime)
        return cls(arrays)

    def __len__(self) -> int:
        return len(self.arrays[0]) - 1

    def joined(self, keep: int, other: PrefixHashes, take: int) -> PrefixHashes:
        """Arrays of our first ``keep`` code points followed by the other's first ``take``, without rehashing them."""
        out = []
        for p, a, b in zip(_POWERS, self.arrays, other.arrays):
            p.grow(keep + take)
            out.append(np.concatenate([a[: keep + 1], (a[keep] + b[1 : take + 1] * p.up[keep]) % p.prime]))
        return PrefixHashes(out)

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """Hash of the span: equal spans have equal hashes, wherever they begin."""
        out = []
        for p, a in zip(_POWERS, self.arrays):
            prime = int(p.prime)
            out.append((int(a[end]) - int(a[start])) * int(p.down[start]) % prime)
        return tuple(out)

    def spans(self, starts: np.ndarray, width: int | np.ndarray, which: int = 0) -> np.ndarray:
        p, a = _POWERS[which], self.arrays[which]
        return (a[starts + width] + p.prime - a[starts]) % p.prime * p.down[starts] % p.prime

    def equal(self, i: int, other: PrefixHashes, j: int, width: int) -> bool:
        return self.span(i, i + width) == other.span(j, j + width)

    def extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension of our position i and the other's j."""
        low, high = 0, min(len(self) - i, len(other) - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(i, other, j, middle) else (low, middle - 1)
        return low

    def ending(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common extension backwards from our position i and the other's j."""
        low, high = 0, min(i, j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(i - middle, other, j - middle, middle) else (low, middle - 1)
        return low

    def shared(self, other: PrefixHashes) -> tuple[int, int]:
        """Exact lengths of the common prefix and the common suffix. They may overlap."""
        return self.extension(0, other, 0), self.ending(len(self), other, len(other))


@dataclass(frozen=True)
class Fingerprint:
    n: int
    whole: tuple[int, ...]
    prefixes: tuple[int, ...]
    suffixes: tuple[int, ...]
    sketch: tuple[int, ...]

    @classmethod
    def of(cls, hashes: PrefixHashes) -> Fingerprint:
        n = len(hashes)
        steps = np.array(ladder(n), dtype=np.int64)
        prefixes = hashes.spans(np.zeros_like(steps), steps) if n else steps
        suffixes = hashes.spans(n - steps, steps) if n else steps
        return cls(n, hashes.span(0, n), tuple(prefixes.tolist()), tuple(suffixes.tolist()), tuple(_smallest(hashes)))

    def __str__(self) -> str:
        fields = (self.whole, self.prefixes, self.suffixes, self.sketch)
        return ".".join([f"{self.n:x}", *("".join(f"{x:08x}" for x in f) for f in fields)])

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, *fields = text.split(".")
        return cls(int(n, 16), *(tuple(int(f[k : k + 8], 16) for k in range(0, len(f), 8)) for f in fields))


def _smallest(hashes: PrefixHashes) -> list[int]:
    """The smallest distinct mixed hashes of all spans of SPAN code points; of the whole text, if it is shorter."""
    n = len(hashes)
    if not n:
        return []
    width = min(SPAN, n)
    mixed = (hashes.spans(np.arange(n - width + 1), width) * _MIX) >> np.uint64(32)
    want = SKETCH * 4
    if len(mixed) > want:  # the smallest few, unless repeats leave too few of them
        few = np.unique(np.partition(mixed, want)[:want])
        if len(few) >= SKETCH:
            return few[:SKETCH].tolist()
    return np.unique(mixed)[:SKETCH].tolist()


def likeness(a: Fingerprint, b: Fingerprint, ends: tuple[int, int] | None = None) -> float:
    """Likeness of two texts, 0 to 1: the share of the longer text that is common prefix and suffix, or the resemblance
    of their spans, whichever is larger. Equal fingerprints give 1. ``ends`` are the exact lengths of the common prefix and
    suffix where the arrays are at hand; else the longest sampled ones count, by binary search too."""
    if a == b:
        return 1.0
    if not a.n or not b.n:
        return 0.0
    if ends is None:
        steps = ladder(min(a.n, b.n))

        def common(x: tuple[int, ...], y: tuple[int, ...]) -> int:
            k = bisect_right(range(len(steps)), False, key=lambda i: x[i] != y[i])  # equal up to some step, then not
            return steps[k - 1] if k else 0

        ends = common(a.prefixes, b.prefixes), common(a.suffixes, b.suffixes)
    shared = min(sum(ends), a.n, b.n) / max(a.n, b.n)
    mine, theirs = set(a.sketch), set(b.sketch)
    union = sorted(mine | theirs)[:SKETCH]
    return min(1.0, max(shared, sum(x in mine and x in theirs for x in union) / len(union)))


def with_successors(documents: DataFrame) -> DataFrame:
    """Documents dealt into ascending ranges of ``doc_id``, each sorted, as ``key, named, text, extra``; without ``named`` the id is null.

    After the rows of a range come, marked ``extra``, rows that begin the next range (after the last range, the
    first), so the successor of every row stands behind it. Only range bounds go to the driver: fewer than
    shuffle partitions. Rows are ordered by id, null ids first, and then by text; rows of one id stay in one range.
    """
    spark = documents.sparkSession
    n = shuffle_partitions(spark)
    doc_id = F.col("doc_id").cast("long")
    rows = documents.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("key"), doc_id.isNotNull().alias("named"), F.coalesce("text", F.lit("")).alias("text"))
    quantiles = [k / n for k in range(1, n)] or [0.5]
    bounds = np.unique(np.array(rows.approxQuantile("key", quantiles, 0.1 / n), dtype=np.float64)).astype(np.int64)

    def ranges(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, keys.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    range_of = F.arrow_udf(ranges, "int")
    ranged = rows.withColumn("range", range_of("key"))
    firsts = ranged.select("range", "key").groupBy("range").agg(F.min("key").alias("first")).orderBy("range").collect()  # one row a range
    if not firsts:
        return rows.select("key", "named", "text", F.lit(False).alias("extra"))
    begins = spark.createDataFrame([(x["first"], firsts[k - 1]["range"]) for k, x in enumerate(firsts)], "key long, before int")  # one row a range
    own = F.struct(F.col("range").alias("to"), F.lit(False).alias("extra"))
    targets = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("to"), F.lit(True).alias("extra"))))
    dealt = ranged.join(F.broadcast(begins), "key", "left").select("key", "named", "text", F.explode(targets).alias("target")).select("key", "named", "text", "target.to", "target.extra")
    return dealt.repartitionById(n, F.col("to")).sortWithinPartitions("extra", "key", "named", "text").select("key", "named", "text", "extra")


def edited_text(text: str, successor: str) -> str:
    """The last half of the code points replaced by as many of the successor's first."""
    half = len(text) // 2
    return text[: len(text) - half] + successor[:half]


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edit, and how like they are to it and to the next document.

    The exact lengths of the common prefix and suffix, from the whole arrays, are in the likenesses and columns of their own.

    Null texts count as empty; an empty text's fingerprint says so and is like another empty one only. Equal ids
    are ordered by text; a null id counts as the lowest and is returned as null. A single document is its
    own successor. Other columns are ignored.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
        ("prefix_edited", pa.int64()), ("suffix_edited", pa.int64()), ("prefix_next", pa.int64()), ("suffix_next", pa.int64()),
    ])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # id, text, hashes, fingerprint
        ended = False
        for batch in batches:
            out = []
            for key, named, text, extra in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if ended or extra and last is None:
                    break
                hashes = PrefixHashes.of(text)
                mark = Fingerprint.of(hashes)
                if last is not None:
                    half = len(last[1]) // 2
                    joined = last[2].joined(len(last[1]) - half, hashes, min(half, len(text)))
                    edit, at_edit, at_next = Fingerprint.of(joined), last[2].shared(joined), last[2].shared(hashes)
                    out.append((
                        last[0], len(last[1]), sha256_hex(edited_text(last[1], text).encode()), str(last[3]), str(edit),
                        likeness(last[3], edit, at_edit), likeness(last[3], mark, at_next), *at_edit, *at_next,
                    ))
                last, ended = (key if named else None, text, hashes, mark), extra
            for powers in _POWERS:
                powers.shrink()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ddl += ", prefix_edited long, suffix_edited long, prefix_next long, suffix_next long"
    return with_successors(documents).mapInArrow(run, ddl)
