"""Nearest neighbours by collision-counting hashing.

Every hash function is one random projection, and its table is the sorted array
of the projections of a block of vectors. Nothing is cut into fixed buckets: a
query's window lies around its own projection. Virtual rehashing widens the
windows of all functions by one factor per round, without hashing again. A vector
collides where it lies in the window; one that collides in at least
``THRESHOLD`` of the functions is a candidate and is verified: its cosine with
the query is computed in double precision from the original vectors.

A vector at distance d of the query lies in a window of half width w with the
probability that a standard normal number is within w / d, so the number of its
collisions is binomial. A query is done with a block when one as near as the k-th
that it has verified would have collided ``THRESHOLD`` times with probability
``CAUGHT``, or when it has verified all; windows widen until then. What is looked at
follows from the distances, not from the size of a block.

Vectors are scaled to length one before they are projected, so that Euclidean
nearness is that of the cosine.

Vectors are dealt to blocks of about ``BLOCK`` rows by a hash of their id, queries
likewise; a task reads one block and one group of queries. A query's best k of
every block meet by query, k rows a block, in a ranking that first takes the best
k within each task. Every query meets every block, as is asked for, but no
pair of rows leaves a task unless it is among the best k of its block.

Vectors that are null, empty, zero, or hold a null, infinite or undefined
component take no part, as query or as candidate; nor does a row without an id.
Vectors of another dimension than the query's are not its candidates. Equal
cosines go by the smaller id. Rows that repeat an id are candidates each.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 8_192
QUERIES = 2_048
FUNCTIONS = 64
THRESHOLD = 0.6
CAUGHT = 0.92
FIRST_HALF = 0.8
WIDEN = 1.12
SEED = 5

FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=None)
def _width() -> float:
    """The half width, in distances, at which a vector collides often enough with probability ``CAUGHT``."""
    wanted = ceil(THRESHOLD * FUNCTIONS)

    def caught(width: float) -> float:
        p = erf(width / sqrt(2))
        return sum(comb(FUNCTIONS, i) * p ** i * (1 - p) ** (FUNCTIONS - i) for i in range(wanted, FUNCTIONS + 1))

    low, high = 0.0, 8.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if caught(middle) >= CAUGHT else (middle, high)
    return high


class Block:
    """The vectors of one block, their projections in order, and the search of it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], _scaled(np.ascontiguousarray(vectors[order]))
        self.norms = _norms(self.vectors)
        rng = np.random.default_rng(SEED)
        self.directions = rng.standard_normal((vectors.shape[1], FUNCTIONS))
        projected = self._project(self.vectors, self.norms)
        #: A sorted array per function, and the position of each entry in the block.
        projected = np.ascontiguousarray(projected.T)
        self.order = np.argsort(projected, axis=1, kind="stable")
        self.sorted = np.take_along_axis(projected, self.order, axis=1)

    def _project(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        scale = np.abs(vectors).max(axis=1, keepdims=True)
        unit = vectors / scale
        return (unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))) @ self.directions

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k found in the block: positions and cosines."""
        query = _scaled(query[None])[0]
        norm = _norms(query[None])
        centre = self._project(query[None], norm)[0]
        n = len(self.ids)
        wanted = int(np.ceil(THRESHOLD * FUNCTIONS))
        verified = np.zeros(n, bool)
        verified[self.ids == query_id] = True
        own = int(verified.sum())
        scores = np.full(n, -np.inf)
        others, reach = n - own, _width()
        # Windows as [low, high) in every sorted array; they start empty, at the query's own place.
        low = np.array([np.searchsorted(line, c) for line, c in zip(self.sorted, centre)])
        high = low.copy()
        hits = np.zeros(n, np.int64)
        half, done = FIRST_HALF, 0
        while done < others:
            if done >= k:
                nearest = np.partition(scores, n - k)[n - k]
                # The windows read last were this wide.
                if half / WIDEN >= reach * sqrt(max(0.0, 2 - 2 * nearest)):
                    break
            gained = []
            for j, line in enumerate(self.sorted):
                a, b = np.searchsorted(line, (centre[j] - half, centre[j] + half))
                gained += [self.order[j, a:low[j]], self.order[j, high[j]:b]]
                low[j], high[j] = min(a, low[j]), max(b, high[j])
            hits += np.bincount(np.concatenate(gained), minlength=n)
            new = np.flatnonzero((hits >= wanted) & ~verified)
            verified[new] = True
            scores[new] = _cosines(self.vectors[new], self.norms[new], query, norm[0])
            done += len(new)
            half *= WIDEN
        take = min(k, done)
        # All that are as good as the k-th, so that equals are chosen by id (positions are in order of id).
        if not take:
            return np.zeros(0, np.int64), np.zeros(0)
        limit = np.partition(scores, n - take)[n - take]
        best = np.flatnonzero(scores >= limit)
        best = best[np.lexsort((best, -scores[best]))][:take]
        return best, scores[best]


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, so that squares neither vanish nor overflow; a cosine stays what it is, to the bit."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def _cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    """Summed row by row in one order, so that equal vectors have equal cosines wherever they stand."""
    return (vectors * query).sum(axis=1) / (norms * norm)


def _group(id_column: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), F.col(id_column)), F.lit(groups))


def nearest(
    vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score of the rows for which the condition ``queries`` holds, among all rows."""
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & usable(F.col("vector")))
    total, asking = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1))).first()
    blocks, teams = max(1, -(-total // BLOCK)), max(1, -(-asking // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select("id", "vector", _group("id", blocks).cast("int").alias("block"), every(teams).alias("team"))
    asked = rows.where("asks").select("id", "vector", _group("id", teams).cast("int").alias("team"),
                                      every(blocks).alias("block"))

    def search(key: tuple, held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = []
        held_size, wanted_size = held["vector"].map(len), wanted["vector"].map(len)
        for size in wanted_size.unique():
            part = held[held_size == size]
            if not len(part):
                continue
            block = Block(part["id"].to_numpy(np.int64), np.stack(part["vector"].to_list()).astype(float))
            asks = wanted[wanted_size == size]
            for query_id, vector in zip(asks["id"].tolist(), asks["vector"]):
                places, scores = block.search(query_id, np.asarray(vector, float), k)
                found.append(pd.DataFrame({"query_id": query_id, "vec_id": block.ids[places], "score": scores}))
        if not found:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="float64")})
        return pd.concat(found, ignore_index=True)

    found = data.groupBy("block", "team").cogroup(asked.groupBy("block", "team")).applyInPandas(search, FOUND)
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
