"""Nearest neighbours by a block matrix join with int8 products.

Queries and candidates are dealt to blocks of bounded size, and every pair of blocks is one group of the join. A block pair
multiplies int8 codes tile by tile. Each product is known to be wrong by at most ``|e_q| |c| + |q'| |e_c|`` (``e``: what rounding
left out, ``q'``: the rounded query), so a pair whose upper bound is below the k-th largest lower bound of its query is out. The
survivors are computed again in double precision and kept in a heap per query; the heaps' contents of all block pairs are merged.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .vectors import matrix, usable

#: Rows of a block of queries and of candidates, and of a tile.
QUERIES, CANDIDATES, TILE = 4096, 16384, 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their unit, the norm of what rounding left out, the norm of the rounded vector and of the vector."""
    unit = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / np.where(unit > 0, unit, 1)[:, None]).clip(-127, 127).astype(np.int8)
    rounded = codes * unit[:, None]
    norm = lambda v: np.sqrt((v * v).sum(axis=1))
    return codes, unit, norm(x - rounded), norm(rounded), norm(x)


def block_top(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """The ``k`` best candidates of each query in a pair of blocks: query's place, score and candidate's id."""
    out: list[tuple[int, float, int]] = []
    qc, qu, qe, qr, qn = quantised(q)
    cc, cu, ce, cr, cn = quantised(c)
    # Sums of at most 127 * 127 * d are whole numbers that this type holds exactly.
    kind = np.float32 if 127 * 127 * q.shape[1] < 1 << 24 else np.float64
    for a in range(0, len(q), TILE):
        rows = slice(a, a + TILE)
        own, found = qc[rows].astype(kind), []
        floor = np.full((len(own), k), -np.inf)
        for b in range(0, len(c), TILE):
            cols = slice(b, b + TILE)
            near = (own @ cc[cols].astype(kind).T) * qu[rows, None] * cu[cols]
            slack = (qe[rows, None] * cn[cols] + qr[rows, None] * ce[cols]) * (1 + 1e-9) + 1e-12 * qn[rows, None] * cn[cols]
            near[q_id[rows, None] == c_id[cols]] = -np.inf
            low = near - slack
            top = np.partition(low, low.shape[1] - k, axis=1)[:, -k:] if low.shape[1] > k else low
            floor = np.partition(np.concatenate([floor, top], axis=1), -k, axis=1)[:, -k:]
            high = near + slack
            i, j = np.nonzero((high >= floor.min(axis=1)[:, None]) & (near > -np.inf))
            found.append((i, j + b, high[i, j]))
        i, j, high = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        keep = high >= floor.min(axis=1)[i]
        i, j = i[keep], j[keep]
        heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(own))]
        for s in range(0, len(i), 1 << 16):
            at, to = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
            exact = (q[a + at] * c[to]).sum(axis=1)
            for n, score, name in zip(at.tolist(), exact.tolist(), c_id[to].tolist()):
                item = (score, -name)
                if len(heaps[n]) < k:
                    heapq.heappush(heaps[n], item)
                elif item > heaps[n][0]:
                    heapq.heapreplace(heaps[n], item)
        out += [(a + n, score, -name) for n, heap in enumerate(heaps) for score, name in heap]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates of largest inner product for every query, ties to the smaller id.

    All rows but those of the query's own id are candidates. Vectors null, zero or with null or non-finite components take no part,
    and vectors of different lengths are not compared. Rows with one id are separate candidates; a repeated query is answered once for each of its rows.
    """
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.withColumn("d", F.size("v"))
    total, asked = rows.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    q_blocks, c_blocks = max(1, -(-asked // QUERIES)), max(1, -(-total // CANDIDATES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = rows.where("asks").withColumn("row", F.monotonically_increasing_id())
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int")).withColumn("cb", every(c_blocks))
    candidates = rows.withColumn("cb", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(c_blocks)).cast("int")).withColumn("qb", every(q_blocks))

    def join(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []})
        ids, numbers = q["id"].to_numpy(np.int64), q["row"].to_numpy(np.int64)
        best = block_top(matrix(q["v"]), ids, matrix(c["v"]), c["id"].to_numpy(np.int64), k)
        at = np.array([b[0] for b in best], np.int64)
        return pd.DataFrame({"row": numbers[at], "query_id": ids[at], "vec_id": [b[2] for b in best], "score": [b[1] for b in best]})

    on = ["d", "qb", "cb"]
    best = queries.groupBy(*on).cogroup(candidates.groupBy(*on)).applyInPandas(join, "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
