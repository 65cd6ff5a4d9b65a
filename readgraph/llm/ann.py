"""Nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by its own codebook, so K centroids a half make K * K cells. A query
ranks the centroids of both halves and takes pairs of them from a heap, in order of summed distance, until
the cells hold enough vectors; these are ranked again by exact distance in double precision. How many are
enough is measured: on the sample, by brute force, the share of all vectors by which ``RECALL`` of the true
neighbours have been reached. (A sample is thinner than the whole, so the share errs on the safe side.)

The codebooks are fitted on a bounded sample; every vector is indexed. Work is dealt in tiles. A tile has
vectors with one first centroid and queries that visit it, with the second centroids that each visits. Both
are split in parts of bounded size, so a centroid that holds a third of all vectors, or that all queries
visit, is many tasks' work. Repeated rows are indexed once, with their number. Of equal vectors only the
k + 1 with the smallest ids are indexed, since no other can be among the k nearest (ties go to smaller ids).
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .sampling import below

#: The codebooks are fitted on about so many vectors, those below a threshold of a hash of their id.
SAMPLE, ROUNDS = 20_000, 12
#: Recall to aim at, measured with so many of the sample as queries.
RECALL, PROBES = 0.96, 200
LEAST_VISITED = 1_000
BLOCK_ROWS, GROUP_QUERIES = 4_096, 1_024


def centroids_for(n: int) -> int:
    """About the root of n over 2 centroids a half, 8 to 256."""
    return int(min(256, max(8, 2 ** np.ceil(np.log2(max(n, 1) ** 0.5 / 2)))))


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        size = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, d], k) for d in range(x.shape[1])], 1)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(x[i : i + 4096], c).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class MultiIndex:
    def __init__(self, sample: np.ndarray, k: int):
        half = sample.shape[1] // 2
        self.half = half
        self.books = [kmeans(part, k) if part.shape[1] else np.zeros((1, 0)) for part in (sample[:, :half], sample[:, half:])]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (nearest(part, book) for part, book in zip((x[:, : self.half], x[:, self.half :]), self.books, strict=True))
        return a * len(self.books[1]) + b

    def distances(self, query: np.ndarray) -> list[np.ndarray]:
        return [squared(q[None], book)[0] for q, book in zip((query[: self.half], query[self.half :]), self.books, strict=True)]

    def visits(self, query: np.ndarray, sizes: dict[int, int], enough: int) -> dict[int, list[int]]:
        """Cells in order of summed distance until they hold ``enough`` vectors: second centroids by first ones.

        Empty cells are passed over.
        """
        d = self.distances(query)
        order = [np.argsort(x, kind="stable").tolist() for x in d]
        first, second = (np.sort(x, kind="stable").tolist() for x in d)
        width, held, out = len(second), 0, {}
        heap = [(first[0] + second[0], 0, 0)]
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            if n := sizes.get(order[0][i] * width + order[1][j], 0):
                out.setdefault(order[0][i], []).append(order[1][j])
                held += n
            # (i, j) is pushed by (i, j - 1), or by (i - 1, 0) when it begins a row: once each
            if j + 1 < width:
                heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(first):
                heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))
        return out

    def share_needed(self, sample: np.ndarray, k: int, recall: float = RECALL, probes: int = PROBES) -> float:
        """The share of the sample that a query has to visit, by brute force over the sample."""
        cell = self.cells(sample)
        sizes = np.bincount(cell, minlength=len(self.books[0]) * len(self.books[1]))
        reached = []
        for q in range(min(probes, len(sample))):
            d = ((sample - sample[q]) ** 2).sum(1)
            d[q] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            a, b = self.distances(sample[q])
            order = np.argsort((a[:, None] + b).ravel(), kind="stable")
            upto = np.empty(len(order))
            upto[order] = np.cumsum(sizes[order])
            reached += (upto[cell[near]] / len(sample)).tolist()
        return float(np.quantile(reached, recall)) if reached else 1.0


def usable(vector) -> F.Column:
    """Not null, not zero, no null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row for which ``is_query`` holds.

    Nearness is Euclidean distance; a row is no candidate of its own query, but another row with its id, or a
    repeated one, is; all candidates are returned if there are fewer than k. Each row is a query of its own,
    so repeated query rows have repeated results. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows with a null id, or with another number of dimensions than most of
    the sample, to which there is no distance. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    read = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    sound = read.filter(F.col("id").isNotNull() & usable(F.col("v")))
    n_rows = sound.count()
    if not n_rows:
        return spark.createDataFrame([], schema)
    sample = sound.filter(below(F.concat_ws(",", "id", F.xxhash64("v")), SAMPLE / n_rows)).orderBy("id", F.xxhash64("v")).toPandas()["v"].tolist()
    dims = int(np.bincount([len(v) for v in sample]).argmax())
    sound = sound.filter(F.size("v") == dims)
    x = np.array([v for v in sample if len(v) == dims])
    rows = sound.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))
    first = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    distinct = rows.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= k + 1).drop("__r")
    distinct = materialize(distinct, "ann-vectors")
    n = distinct.count()
    index = MultiIndex(x, centroids_for(n))
    enough = max(LEAST_VISITED, int(np.ceil(index.share_needed(x, k) * n)))
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("long")
    def cell_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.cells(np.array(v.tolist(), float).reshape(len(v), dims)), dtype="int64")

    width = len(index.books[1])
    cells = distinct.withColumn("cell", cell_of("v"))
    indexed = materialize(cells.select("id", "v", "copies", F.floor(F.col("cell") / width).alias("first"), (F.col("cell") % width).cast("int").alias("second")), "ann-index")
    counted = indexed.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a cell, 65,536 at most
    shared_sizes = spark.sparkContext.broadcast({r["first"] * width + r["second"]: r["n"] for r in counted})

    def traverse(frames):
        for frame in frames:
            rows = []
            for i, v, own, copies in zip(frame["id"], frame["v"], frame["own"], frame["copies"], strict=True):
                rows += [(i, v, own, copies, first, seconds) for first, seconds in shared.value.visits(np.array(v, float), shared_sizes.value, enough).items()]
            yield pd.DataFrame(rows, columns=["id", "v", "own", "copies", "first", "seconds"])

    # ``own`` tells queries with one id apart
    queries = rows.filter(is_query(F.col("id"))).select("id", "v", F.xxhash64("v").alias("own"), "copies")
    visits = materialize(queries.mapInPandas(traverse, "id long, v array<double>, own long, copies long, first long, seconds array<int>"), "ann-visits")
    # one row a centroid, 256 at most, so these are broadcast
    asked = visits.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("int").alias("groups"))
    blocks = indexed.groupBy("first").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    tiles = F.broadcast(materialize(asked.join(blocks, "first"), "ann-tiles"))

    def dealt(df: DataFrame, part: str, other: str, *more: str) -> DataFrame:
        """Each row goes to one part of its own kind and meets all parts of the other."""
        mine = F.pmod(F.xxhash64("id", "v"), F.col(part)).cast("int").alias(part)
        return df.join(tiles, "first").select("id", "v", "copies", *more, "first", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    keys = ["first", "groups", "blocks"]

    def ranked(asking: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held):
            ids, x, second, copies = held["id"].to_numpy(), np.array(held["v"].tolist(), float), held["second"].to_numpy(), held["copies"].to_numpy()
            for qid, q, own, times, seconds in zip(asking["id"], asking["v"], asking["own"], asking["copies"], asking["seconds"], strict=True):
                visited = np.zeros(width, bool)
                visited[seconds] = True
                mine = np.flatnonzero(visited[second])
                q = np.asarray(q, float)
                d, i, c = np.sqrt(((x[mine] - q) ** 2).sum(1)), ids[mine], copies[mine]
                c = c - ((i == qid) & (x[mine] == q).all(1))  # the query's own row
                if (c == 0).any():
                    d, i, c = d[c > 0], i[c > 0], c[c > 0]
                if len(d) > k:
                    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                    d, i, c = d[near], i[near], c[near]
                best = np.lexsort((i, d))[:k]
                best = np.repeat(best, np.minimum(c[best], k))[:k]
                out.append(pd.DataFrame({"query_id": qid, "own": own, "times": times, "vec_id": i[best], "score": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("query_id", "own", "times", "vec_id", "score")})

    asked_tiles, held_tiles = dealt(visits, "groups", "blocks", "own", "seconds"), dealt(indexed, "blocks", "groups", "second")
    near = asked_tiles.groupBy(*keys).cogroup(held_tiles.groupBy(*keys)).applyInPandas(ranked, "query_id long, own long, times long, vec_id long, score double")
    order = Window.partitionBy("query_id", "own").orderBy("score", "vec_id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("col")
