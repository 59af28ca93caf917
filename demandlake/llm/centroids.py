"""Centroid clustering of integer vectors by scalar lookup tables.

``blocks`` turns vectors into integers floor(1024 * x) and writes them, a few thousand rows to a
block, to the shared checkpoint folder: per dimension the integer values that occur in the block and
each row's place among them. A round tabulates, per block, the squared difference of every occurring
value to every centroid, one table per dimension; a row's distances are then table gathers and sums,
all in 64-bit integers, so results do not depend on how rows are dealt. A table has as many rows as a
block at most, so memory is bounded for any range of values. Tasks return sums and counts per
cluster; the driver holds the centroids alone.

Defined results: vectors that are null, have another number of components than ``dims``, or hold a
null or non-finite entry are dropped; floor(1024 * x) counts as at most 2**27 in size, so a distance
fits a long; repeated rows and ids are vectors of their own; starting vectors of equal hash are
ordered by their entries, null ids come last; with fewer vectors than clusters every vector starts
one; inertias that exceed a long are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, save, table

DIMS, SCALE, BOUND = 64, 1024, 2.0**27
CLUSTERS, ROUNDS, SEED = 8, 10, 3
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Clusters:
    centroids: np.ndarray  # (k, dims) integers
    rounds: int  # rounds that moved a centroid; later ones would move none


def usable(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where((F.size(column) == dims) & whole)


def integers(entries: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * entries.astype(np.float64)), -BOUND, BOUND).astype(np.int64)


def blocks(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", dims: int = DIMS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(ids, codes, vocab, sizes): ids of a block's rows, each row's place among the values that occur in a dimension, those values, and how many they are."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, block_rows):
                b = batch.slice(a, block_rows)
                x = integers(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                occurring = [np.unique(x[:, j], return_inverse=True) for j in range(dims)]
                codes = np.stack([inverse for _, inverse in occurring]).astype("<u2")
                cells = [codes.tobytes(), np.concatenate([v for v, _ in occurring]).astype("<i4").tobytes(), np.array([len(v) for v, _ in occurring], "<i4").tobytes()]
                ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array([c], pa.binary()) for c in cells]], names=["ids", "codes", "vocab", "sizes"])

    key_type = vectors.schema[key].dataType.simpleString()
    return arrow_map(usable(vectors, column, dims).select(key, column), run, f"ids array<{key_type}>, codes binary, vocab binary, sizes binary")


def _unpack(b: pa.RecordBatch, i: int, dims: int) -> tuple[np.ndarray, list[np.ndarray]]:
    codes, vocab, sizes = (b.column(b.schema.get_field_index(c))[i].as_py() for c in ("codes", "vocab", "sizes"))
    cuts = np.cumsum(np.frombuffer(sizes, "<i4"))[:-1]
    return np.frombuffer(codes, "<u2").reshape(dims, -1), np.split(np.frombuffer(vocab, "<i4").astype(np.int64), cuts)


def nearest(codes: np.ndarray, values: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row of a block."""
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    for own, occurring, centre in zip(codes, values, centroids.T):
        squares = (occurring[:, None] - centre[None, :]) ** 2
        total += squares[own]
    cluster = total.argmin(1)
    return cluster, total[np.arange(len(cluster)), cluster]


def _round(held: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: exact floors of the means, empty clusters as they are."""
    k, dims = centroids.shape

    def run(batches):
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                codes, values = _unpack(b, i, dims)
                cluster, _ = nearest(codes, values, centroids)
                counts += np.bincount(cluster, minlength=k)
                for j in range(dims):
                    seen = np.bincount(cluster * len(values[j]) + codes[j], minlength=k * len(values[j])).reshape(k, -1)
                    sums[:, j] += seen @ values[j]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = arrow_map(held, run, "cluster int, n long, sums array<long>").where("n > 0")
    rows = parts.select("cluster", "n", F.posexplode("sums").alias("j", "s")).groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = centroids.copy()
    for r in rows:  # clusters x dims cells
        out[r.cluster, r.j] = r.s // r.n
    return out


def start(vectors: DataFrame, key: str, column: str, dims: int, clusters: int, seed: int) -> np.ndarray:
    """The integer vectors of smallest sha256 of ``seed:key``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = usable(vectors, column, dims).select(h.alias("h"), F.col(column).cast("array<double>").alias("v")).orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    return integers(np.array([r.v for r in rows], float).reshape(-1, dims))


def fit(held: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> Clusters:
    """``rounds`` rounds over the blocks; a round that moves no centroid ends them, as all later ones would be equal."""
    done = 0
    while done < rounds and len(centroids):
        moved = _round(held, centroids)
        if np.array_equal(moved, centroids):
            break
        centroids, done = moved, done + 1
    return Clusters(centroids, done)


def assign(held: DataFrame, model: Clusters, key: str = "vec_id") -> DataFrame:
    """(key, cluster, distance) of every vector of the blocks."""
    centroids, dims = model.centroids, model.centroids.shape[1]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                cluster, distance = nearest(*_unpack(b, i, dims), centroids)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).flatten(), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=[key, "cluster", "distance"])

    key_type = held.schema["ids"].dataType.elementType.simpleString()
    return arrow_map(held, run, f"`{key}` {key_type}, cluster int, distance long")


def op12_centroid_clustering(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    held = save(blocks(vectors), "centroid-blocks")
    model = fit(held, start(vectors, "vec_id", "embedding", DIMS, CLUSTERS, SEED))
    assigned = save(assign(held, model), "centroid-assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))  # one row per cluster
    of = sums.select(F.col("cluster").alias("of"), F.col("own").try_cast("long").alias("cluster_inertia")).crossJoin(sums.agg(F.sum("own").try_cast("long").alias("inertia")))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in model.centroids]
    digest = F.element_at(F.array(*map(F.lit, digests or [""])), F.col("cluster") + 1)
    return assigned.join(F.broadcast(of), F.col("cluster") == F.col("of")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))
