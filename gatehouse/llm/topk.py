"""Exact top-k search by tiled matrix products.

Candidates are hashed into shards and queries into blocks, and every shard meets every block in a cell of a grid, tile by tile:
one matrix product for each pair of tiles, a partial selection in it, and the query's best of the cell goes on. A
cell holds one shard, whose bytes are bounded, and streams its queries. The grid's sides are those that
copy the fewest vectors for as many cells as there are shuffle partitions. The lists of a query are merged in a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

SCALE = 64
#: Bytes of candidate vectors that one task holds, rows of either tile, and lists merged at a time.
SHARD_BYTES, TILE, FAN_IN = 64 << 20, 1024, 16
_EXACT = float(1 << 53)


def quantized(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: each component x as floor(64 x), x as double. Null ids, null vectors and vectors that
    hold null, NaN or infinity take no part."""
    v, x = F.col(vector_col), F.col("x")
    wide = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda e: e.cast("double")).alias("x"))
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return wide.where(F.col("vec_id").isNotNull() & x.isNotNull() & usable).select(
        "vec_id", F.transform(x, lambda e: F.floor(F.lit(float(SCALE)) * e).cast("double")).alias("v")
    )


def _products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles where these are exact, else in Python's integers, held within 64 bits."""
    bound = np.abs(queries).max(initial=0) * np.abs(candidates).max(initial=0) * max(1, queries.shape[1])
    if bound < _EXACT:
        return (queries @ candidates.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in queries], dtype=object) @ np.array([[int(x) for x in row] for row in candidates], dtype=object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of one row, ties to the smaller id. Ids ascend."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        rows = np.sort(np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]]))
    else:
        rows = np.arange(len(scores))
    rows = rows[np.argsort(-scores[rows], kind="stable")]
    return scores[rows], ids[rows]


def _shard_top(k: int):
    kind = pa.list_(pa.struct([("neg", pa.int64()), ("vec_id", pa.int64())]))
    schema = pa.schema([("query_id", pa.int64()), ("shard", pa.int32()), ("top", kind)])

    def answer(queries: list[tuple[int, np.ndarray]], shard: int, held: dict[int, tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
        out = []
        for width in {len(v) for _, v in queries}:
            if width not in held:
                continue
            ids, matrix = held[width]
            mine = [(q, v) for q, v in queries if len(v) == width]
            rows = np.array([v for _, v in mine]).reshape(len(mine), width)
            found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in mine]
            for at in range(0, len(ids), TILE * 8):
                tile = ids[at : at + TILE * 8]
                scores = _products(rows, matrix[at : at + TILE * 8])
                for n, (query, _) in enumerate(mine):
                    row, own = scores[n], np.searchsorted(tile, [query, query + 1])
                    if own[0] < own[1]:  # rows with the query's id are its own
                        found[n].append(_best(np.delete(row, slice(*own)), np.delete(tile, slice(*own)), k))
                    else:
                        found[n].append(_best(row, tile, k))
            for (query, _), lists in zip(mine, found):
                scores, ids_ = (np.concatenate(x) for x in zip(*lists))
                order = np.lexsort((ids_, -scores))[:k]
                if len(order):
                    out.append((query, shard, [{"neg": -int(s), "vec_id": int(i)} for s, i in zip(scores[order], ids_[order])]))
        return out

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, collected, held, waiting = None, {}, {}, []
        for batch in batches:
            for s, is_query, i, v in zip(*(batch.column(n) for n in range(4))):
                s, is_query, i, v = s.as_py(), is_query.as_py(), i.as_py(), v.values.to_numpy(zero_copy_only=False)
                if s != shard:
                    yield from emit(answer(waiting, shard, held))
                    shard, collected, held, waiting = s, {}, {}, []
                if not is_query:
                    collected.setdefault(len(v), []).append((i, v))
                    continue
                if collected:  # the shard's candidates stand before its queries
                    held = {w: (np.array([i for i, _ in x]), np.array([v for _, v in x]).reshape(len(x), w)) for w, x in collected.items()}
                    collected = {}
                waiting.append((i, v))
                if len(waiting) >= TILE:
                    yield from emit(answer(waiting, shard, held))
                    waiting = []
        yield from emit(answer(waiting, shard, held))

    return run


def grid(candidates: int, queries: int, size: int, cells: int) -> tuple[int, int]:
    """Blocks of queries and shards of candidates, of ``size`` bytes in all: as few copies as so many cells need, and no shard beyond its bound."""
    ratio = candidates / max(1, queries)
    shards = max(1, -(-size // SHARD_BYTES), min(cells, round(math.sqrt(cells * ratio))))
    return max(1, min(max(1, queries), -(-cells // shards))), shards


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest inner products of each query with every other row.

    Queries are the rows whose id is divisible by ``every``; a query's own row is no candidate, nor are rows that repeat its
    id. Repeated candidates count each, repeated queries are answered once, and vectors of another
    dimension never meet. With no candidate a query has no row; an empty table gives none.
    """
    rows = quantized(vectors)
    n_rows, n_queries, n_values = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks, shards = grid(n_rows, n_queries, 8 * n_values, shuffle_partitions(vectors.sparkSession))
    # equal ids may fall into several shards: the salt is the vector, and a very common vector is spread by id

    def in_cells(table: DataFrame, is_query: bool, own, cells) -> DataFrame:
        return table.select("vec_id", "v", F.pmod(own, F.lit(blocks if is_query else shards)).cast("int").alias("own")).select(
            F.explode(cells).alias("shard"), F.lit(is_query).alias("is_query"), "vec_id", "v"
        )

    own = F.col("own")
    candidates = in_cells(rows, False, F.xxhash64("vec_id", "v"), F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * shards + own))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    queries = in_cells(asked, True, F.xxhash64("v", "vec_id"), F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda c: own * shards + c))
    cells = blocks * shards
    dealt = candidates.unionByName(queries).repartitionById(cells, F.col("shard")).sortWithinPartitions("shard", "is_query", "vec_id")
    lists = dealt.mapInArrow(_shard_top(k), "query_id long, shard int, top array<struct<neg:long,vec_id:long>>")
    width = cells
    while width > 1:
        width = -(-width // FAN_IN)
        keys = ["query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")] if width > 1 else ["query_id", F.lit(0).alias("shard")]
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top")
        lists = lists.groupBy(*keys).agg(merged)
    best = lists.select("query_id", F.posexplode("top").alias("at", "hit"))
    return best.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.neg")).alias("score")
    )


#: The query in SQL, over the table ``embeddings``.
TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
