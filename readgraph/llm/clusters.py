"""Clusters of vectors around centroids, in exact integers, with bounds that spare most distances.

Each vector keeps an upper bound of the distance to its own centroid and a lower bound of that to any other one. When
centroids move, the upper bound grows by its own centroid's drift. The lower bound needs to shrink by less than
another centroid's drift: all vectors of a cluster lie in a sphere around its old centroid, and from there the way
from the old to the new place of the other one is seen at an angle. In the plane through the three points, with the
origin in the middle of the way, a point at distance p and angle w from its direction has
d(old) - d(new) = 2 * drift * p * cos(w) / (d(old) + d(new)), and d(old) + d(new) >= 2 * p. So no point of the sphere
comes nearer by more than drift * cos(w), with w the least angle in it: that of the tangent from the origin. Vectors
whose bounds leave it open which centroid is nearest are compared with all of them exactly.

Vectors are written once, packed by the hundreds, in buckets. Each round writes their clusters and bounds in equal buckets,
so a round joins both without a shuffle, and hands sums for each pack to Spark. A round's table goes when the next one is
there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import bucketed, mark, materialize, trim

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components beyond it could take a squared distance out of 64 bits.
MOST = 2**27
PACK, BUCKET_BYTES = 512, 64_000_000
#: By so much bounds are loosened for the sake of rounding.
SLACK = 1e-9


class Moves(NamedTuple):
    """What a round needs to know of its centroids."""

    centroids: np.ndarray  # int64
    drift: np.ndarray  # of each centroid since the last round
    loosen: np.ndarray  # by cluster: the most by which another centroid can have come nearer to one of its vectors
    apart: np.ndarray  # half the distance to the nearest other centroid


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = vectors - centroid
    return np.einsum("ij,ij->i", d, d)


def tight_drift(center: np.ndarray, radius: float, old: np.ndarray, new: np.ndarray) -> float:
    """How much less than before a point of the sphere can be from a centroid that moved, at most."""
    way = (new - old).astype(np.float64)
    drift = float(np.linalg.norm(way))
    if drift == 0:
        return 0.0
    from_middle = center - (old + new) / 2
    along = float(from_middle @ way) / drift
    aside = float(np.linalg.norm(from_middle - along / drift * way))
    far = math.hypot(along, aside)
    if radius >= far:  # the sphere holds the origin
        return drift
    angle = max(0.0, math.atan2(aside, along) - math.asin(radius / far))
    return min(drift, drift * max(0.0, math.cos(angle)) + SLACK * drift)


def moves(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> Moves:
    k = len(new)
    drift = np.array([math.sqrt(s) for s in squared(new, old).tolist()]) * (1 + SLACK)
    loosen = np.array([max((tight_drift(old[i], radii[i], old[j], new[j]) for j in range(k) if j != i), default=0.0) for i in range(k)])
    return Moves(new, drift, loosen, _apart(new))


def _apart(centroids: np.ndarray) -> np.ndarray:
    k = len(centroids)
    return np.array([min((math.sqrt(s) for j, s in enumerate(squared(centroids, centroids[i]).tolist()) if j != i), default=math.inf) / 2 for i in range(k)]) * (1 - SLACK)


def assign(vectors: np.ndarray, now: Moves, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper and lower bound of each vector, and how many vectors were compared with all centroids."""
    if state is None:
        cluster, upper, lower = np.zeros(len(vectors), np.int32), np.full(len(vectors), np.inf), np.full(len(vectors), -np.inf)
        open_ = np.arange(len(vectors))
    else:
        cluster, upper, lower = state[0].copy(), (state[1] + now.drift[state[0]]) * (1 + SLACK), state[2] - now.loosen[state[0]] - SLACK
        least = np.maximum(lower, now.apart[cluster])
        open_ = np.flatnonzero(upper >= least)
        own = now.centroids[cluster[open_]] - vectors[open_]
        upper[open_] = _root(np.einsum("ij,ij->i", own, own)) * (1 + SLACK)
        open_ = open_[upper[open_] >= least[open_]]
    if len(open_):
        all_ = np.stack([squared(vectors[open_], c) for c in now.centroids], axis=1)
        cluster[open_] = best = all_.argmin(axis=1)  # the first of equals
        upper[open_] = _root(all_[np.arange(len(open_)), best]) * (1 + SLACK)
        all_[np.arange(len(open_)), best] = np.iinfo(np.int64).max
        lower[open_] = _root(all_.min(axis=1)) * (1 - SLACK) if all_.shape[1] > 1 else np.inf
    return cluster, upper, lower, len(open_)


def summary(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, k: int) -> tuple[list, list, list]:
    """Sums of components, counts and radii by cluster."""
    counts = np.bincount(cluster, minlength=k)
    sums, radii = np.zeros((k, vectors.shape[1]), np.int64), np.zeros(k)
    np.add.at(sums, cluster, vectors)
    np.maximum.at(radii, cluster, upper)
    return sums.ravel().tolist(), counts.tolist(), radii.tolist()


def quantised(df: DataFrame, key: str, vector: str, dimensions: int, scale: int) -> DataFrame:
    """``id, q``: the vectors that take part, as integers."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") * F.lit(float(scale)))
    rows = df.select(F.col(f"`{key}`").alias("id"), v.alias("v")).filter(F.size("v") == dimensions)
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= MOST))
    return rows.filter(sound).select("id", F.transform("v", lambda x: F.floor(x)).alias("q"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.withColumn("h", digest).orderBy("h", "id", "q").limit(k).collect()
    return np.array([r["q"] for r in rows], np.int64)


def packs(kept: DataFrame, dimensions: int) -> DataFrame:
    """``pack, ids, vectors``: the vectors of a task by the ``PACK``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                q = part["q"].flatten().to_numpy().astype("<i4")
                yield pa.RecordBatch.from_arrays([pa.array([pack], pa.int64()), pa.ListArray.from_arrays([0, part.num_rows], part["id"]), pa.array([q.tobytes()], pa.binary())], names=["pack", "ids", "vectors"])
                pack += 1

    return kept.mapInArrow(run, f"pack bigint, ids array<{kept.schema['id'].dataType.simpleString()}>, vectors binary")


STATE = "pack bigint, cluster binary, upper binary, lower binary, sums array<bigint>, counts array<bigint>, radii array<double>, compared bigint"


def _matrix(data: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").reshape(-1, dimensions).astype(np.int64)


def _states(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    return (np.frombuffer(row["cluster"], "<i4"), np.frombuffer(row["upper"], "<f8"), np.frombuffer(row["lower"], "<f8")) if "cluster" in row else None


def assigned(rows: DataFrame, now: Moves, dimensions: int) -> DataFrame:
    """The next state of packs joined with their state, if they have one."""
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.int64()]
    names = [c.split()[0] for c in STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vectors = _matrix(row["vectors"], dimensions)
                cluster, upper, lower, compared = assign(vectors, now, _states(row))
                found = [row["pack"], cluster.astype("<i4").tobytes(), upper.tobytes(), lower.tobytes(), *summary(vectors, cluster, upper, len(now.centroids)), compared]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(found, types, strict=True)], names=names)

    return rows.mapInArrow(run, STATE)


def distances(rows: DataFrame, now: Moves, dimensions: int, kind: str) -> DataFrame:
    """``id, cluster, distance`` of each vector, after a last assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = one.select([c for c in batch.schema.names if c != "ids"]).to_pylist()[0]
                vectors = _matrix(row["vectors"], dimensions)
                cluster = assign(vectors, now, _states(row))[0]
                own = vectors - now.centroids[cluster]
                yield pa.RecordBatch.from_arrays([one["ids"].flatten(), pa.array(cluster, pa.int32()), pa.array(np.einsum("ij,ij->i", own, own), pa.int64())], names=["id", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def _totals(state: DataFrame, k: int, dimensions: int) -> tuple[list[list[int]], list[int], np.ndarray]:
    """The sums, counts and radii of all packs: one row for each number, k * (dimensions + 2) of them."""
    number = lambda c, agg: state.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(agg("x").alias("x")).select(F.lit(c).alias("c"), "i", F.col("x").cast("string").alias("x"))
    rows = number("sums", F.sum).union(number("counts", F.sum)).union(number("radii", F.max)).collect()
    found = {(c, i): x for c, i, x in rows}
    sums = [[int(found["sums", i * dimensions + j]) for j in range(dimensions)] for i in range(k)]
    return sums, [int(found["counts", i]) for i in range(k)], np.array([float(found["radii", i]) for i in range(k)])


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
    dimensions: int = DIMENSIONS, scale: int = SCALE, report: list | None = None,
) -> DataFrame:
    """One row a vector: the key, ``cluster, distance`` (squared), ``cluster_inertia, inertia, centroid_sha256``.

    Vectors of ``dimensions`` sound components take part, each component x as floor(scale * x); others (null, of another
    length, with a null or non-finite component, or one beyond 2^27 after scaling, whose distances would not fit into 64
    bits) have no row. The first centroids are the vectors of the smallest digests of seed and key, all vectors if
    there are fewer; a null key counts as empty, and ties go by key and components. Equal distances go to the smaller
    number. Repeated rows each count and have a row, equal ones get equal results. An empty table gives an empty one;
    other columns are not read. ``report`` gets how many vectors each round compared with all centroids.
    """
    spark = df.sparkSession
    kept = quantised(df, key, vector, dimensions, scale)
    kind = kept.schema["id"].dataType.simpleString()
    centroids = first_centroids(kept, clusters, seed)
    if not len(centroids):
        return spark.sql(f"SELECT CAST(NULL AS {kind}) AS `{key}`, 0 AS cluster, 0L AS distance, 0L AS cluster_inertia, 0L AS inertia, '' AS centroid_sha256 WHERE false")
    k = len(centroids)
    buckets = max(spark.sparkContext.defaultParallelism, -(-kept.count() * dimensions * 4 // BUCKET_BYTES))
    packed = bucketed(packs(kept, dimensions), "vector-packs", buckets, "pack")
    now, rows, start = Moves(centroids, np.zeros(k), np.zeros(k), _apart(centroids)), packed, mark(spark)
    for _ in range(rounds):
        state = bucketed(assigned(rows, now, dimensions), "cluster-state", buckets, "pack")
        trim(spark, start, 1)
        sums, counts, radii = _totals(state, k, dimensions)
        if report is not None:
            report.append(state.agg(F.sum("compared")).head()[0])
        new = np.array([[s // n for s in of] if n else old.tolist() for of, n, old in zip(sums, counts, now.centroids, strict=True)], np.int64)
        now = moves(now.centroids, new, radii)
        rows = packed.join(state.select("pack", "cluster", "upper", "lower"), "pack")
    found = materialize(distances(rows, now, dimensions, kind), "cluster-distances")
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect()}
    of = F.create_map(*[F.lit(x) for c, s in inertia.items() for x in (c, s)])
    names = F.array(*[F.sha2(F.lit(",".join(map(str, c))), 256) for c in now.centroids.tolist()])
    return found.select(F.col("id").alias(key), "cluster", "distance", of[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), names[F.col("cluster")].alias("centroid_sha256"))


def _oracle() -> str:
    at = """a{t} AS MATERIALIZED (SELECT id, cluster, d FROM (SELECT p.id, c.cluster, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM parts p JOIN c{t} c USING (i) GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1)"""
    to = """c{u} AS MATERIALIZED (SELECT c.cluster, c.i, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, c.x) AS x FROM c{t} c
    LEFT JOIN (SELECT a.cluster, p.i, sum(p.x) AS s, count(*) AS n FROM a{t} a JOIN parts p USING (id) GROUP BY 1, 2) m USING (cluster, i))"""
    loop = ",\n".join(x.format(t=t, u=t + 1) for t in range(ROUNDS) for x in (at, to))
    return f"""
WITH numbered AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMENSIONS}),
single AS (SELECT id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM numbered),
sound AS (SELECT id FROM single GROUP BY id HAVING count(x) = {DIMENSIONS} AND bool_and(isfinite(CAST(x AS DOUBLE)))),
parts AS MATERIALIZED (SELECT id, i, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM single SEMI JOIN sound USING (id)),
c0 AS MATERIALIZED (SELECT s.cluster, p.i, p.x FROM (SELECT id, row_number() OVER (ORDER BY sha256(concat('{SEED}:', vec_id)), vec_id) - 1 AS cluster FROM numbered SEMI JOIN sound USING (id)
    QUALIFY cluster < {CLUSTERS}) s JOIN parts p USING (id)),
{loop},
{at.format(t=ROUNDS)},
named AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY 1)
SELECT n.vec_id, CAST(a.cluster AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, c.centroid_sha256
FROM a{ROUNDS} a JOIN numbered n USING (id) JOIN named c ON c.cluster = a.cluster
"""


ORACLE = _oracle()
