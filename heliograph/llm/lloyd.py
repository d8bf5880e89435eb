"""Centroid clustering: plain Lloyd rounds in integer arithmetic.

Vectors are quantised to integers, so sums, means and distances are exact and
the result does not depend on how the rows are partitioned.  In each round the
centroids are broadcast (``k`` times ``dims`` integers, nothing that grows with
the rows), ``mapInPandas`` assigns the rows of a batch and adds them up, and a
task gives at most one row a centroid, component and limb, which ``groupBy``
merges.  No row is shuffled.  A round reads the vectors' column alone from the
given table, so pass a table rather than a long plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components below this magnitude have distances that fit 64 bits for up to 64 components; others are computed with Python's integers.
NARROW = 1 << 27
#: Sums travel in limbs of so many bits, which add up in 64 bits for any number of rows.
LIMB_BITS = 32
LONG_MAX = (1 << 63) - 1

Centroids = list[list[int]]


def whole(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly ``dims`` components, none null, infinite or not a number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))


def _integer(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2**53 else int(np.floor(x * scale))


def quantise(vectors: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) of each component as int64, or as Python integers if one of them is too wide for exact 64-bit distances."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    if np.abs(x).max(initial=0.0) * scale < NARROW:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[_integer(v, scale) for v in row] for row in x.tolist()], dtype=object)


def nearest(q: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest centroid (the lowest of equally near ones) and the squared distance."""
    exact = q.dtype == object or any(abs(c) >= NARROW for row in centroids for c in row)
    q = q.astype(object) if exact else q
    distances = []
    for row in centroids:
        d = q - np.array(row, dtype=q.dtype)
        distances.append((d * d).sum(axis=1))
    distances = np.stack(distances, axis=1)
    at = np.argmin(distances, axis=1)
    return at, distances[np.arange(len(q)), at]


def _limbs(value: int) -> list[int]:
    """Base 2**32 digits of an integer, the last one signed."""
    out = []
    while not -(1 << LIMB_BITS) <= value < (1 << LIMB_BITS):
        out.append(value & ((1 << LIMB_BITS) - 1))
        value >>= LIMB_BITS
    return [*out, value]


def initial_centroids(kept: DataFrame, vector_col: str, id_col: str, k: int, seed: str, scale: int) -> Centroids:
    """The ``k`` vectors whose ids have the smallest hashes: at most ``k`` rows reach the driver."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    first = kept.where(F.col(id_col).isNotNull()).select(key.alias("key"), F.col(vector_col).alias("vector")).orderBy("key", "vector").limit(k).collect()
    return [[int(v) for v in quantise(pd.Series([np.array(row["vector"], dtype=np.float64)]), scale)[0]] for row in first]


def _round(kept: DataFrame, vector_col: str, centroids: Centroids, scale: int) -> Centroids:
    """Centroids after one assignment; an empty one stays."""
    shared = kept.sparkSession.sparkContext.broadcast(centroids)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = shared.value
        count, total = [0] * len(now), [[0] * len(row) for row in now]
        for batch in batches:
            if not len(batch):
                continue
            q = quantise(batch["vector"], scale)
            at, _ = nearest(q, now)
            for c in np.unique(at).tolist():
                mine = q[at == c]
                count[c] += len(mine)
                total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(axis=0), strict=True)]
        rows = [(c, dim, limb, part) for c, n in enumerate(count) if n for dim, value in enumerate([*total[c], n]) for limb, part in enumerate(_limbs(value))]
        yield pd.DataFrame(rows, columns=["cluster", "dim", "limb", "total"])

    parts = kept.select(F.col(vector_col).alias("vector")).mapInPandas(add_up, "cluster int, dim int, limb int, total long")
    merged = parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    shared.unpersist()
    sums: dict[tuple[int, int], int] = {}
    for row in merged:
        sums[row["cluster"], row["dim"]] = sums.get((row["cluster"], row["dim"]), 0) + (int(row["total"]) << (LIMB_BITS * row["limb"]))
    dims = len(centroids[0])
    return [[sums[c, d] // sums[c, dims] for d in range(dims)] if (c, dims) in sums else row for c, row in enumerate(centroids)]


def fit(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", dims: int = 64, k: int = 8, rounds: int = 10, seed: str = "3", scale: int = 1024) -> Centroids:
    """Centroids after ``rounds`` rounds; it stops early once a round changes nothing.

    With fewer than ``k`` usable vectors that have an id there are as many
    centroids; with none the list is empty.
    """
    kept = df.where(whole(F.col(vector_col), dims))
    centroids = initial_centroids(kept, vector_col, id_col, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        after = _round(kept, vector_col, centroids, scale)
        if after == centroids:
            break
        centroids = after
    return centroids


def centroid_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def assign(df: DataFrame, centroids: Centroids, vector_col: str = "embedding", dims: int = 64, scale: int = 1024) -> DataFrame:
    """The usable rows of ``df`` with ``cluster`` and ``distance`` (squared).

    Rows whose vector is null, of another length, or has a null or non-finite
    component are left out; repeated rows and null ids stay.  A distance beyond
    a long is null.  Columns of ``df`` with the added names are replaced; all
    others stay in the JVM, as only the vectors go to Python.  Without
    centroids, as of an empty table, the result is empty.
    """
    kept = df.where(whole(F.col(vector_col), dims)).drop("cluster", "distance")
    if not centroids:
        return kept.limit(0).withColumn("cluster", F.lit(None).cast("int")).withColumn("distance", F.lit(None).cast("long"))
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("cluster int, distance long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, distance = nearest(quantise(batch, scale), shared.value) if len(batch) else (np.zeros(0), np.zeros(0))
            yield pd.DataFrame({"cluster": at.astype(np.int32), "distance": pd.array([int(d) if d <= LONG_MAX else None for d in distance.tolist()], dtype="Int64")})

    return kept.withColumn("__placed", place(F.col(vector_col))).select(*kept.columns, "__placed.cluster", "__placed.distance")


def with_inertia(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """Adds ``cluster_inertia``, ``inertia`` and ``centroid_sha256``; sums with a null in them or beyond a long are null.

    ``assigned`` is read twice, so pass a written table.  The sums of at most
    ``k`` clusters come to the driver and go back as literals.
    """
    by_cluster: dict[int, int | None] = {}
    for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("wide")).collect():
        by_cluster[row["cluster"]] = None if row["wide"] else int(row["s"])
    total = None if None in by_cluster.values() else sum(by_cluster.values())
    fits = lambda v: F.lit(v if v is not None and v <= LONG_MAX else None).cast("long")
    pick = lambda values: F.get(F.array(*values), F.col("cluster")) if values else F.lit(None)
    return (
        assigned.withColumn("cluster_inertia", pick([fits(by_cluster.get(c)) for c in range(len(centroids))]).cast("long"))
        .withColumn("inertia", fits(total))
        .withColumn("centroid_sha256", pick([F.lit(centroid_sha256(c)) for c in centroids]).cast("string"))
    )
