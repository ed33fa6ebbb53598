"""Centroid clustering with an incrementally kept distance matrix.

A vector's components become integers, so that all arithmetic is exact. Every
vector keeps its row of the distance matrix: the exact dot products with all
centroids. A round changes the row only by the nonzero component changes of each
centroid (dot' = dot + x . change), then takes the nearest centroid anew from
|x|^2 - 2 dot + |c|^2. The rows are written to the shared folder each round, so a
lost executor costs part of a round; the centroids (k x dims numbers) are the
only thing the driver holds, and the only thing sent to tasks.

Defined cases: a vector that is null, has another number of components, or a
component that is null or not finite, is left out. Rows that repeat a vec_id are
vectors of their own. Starts are ordered by hash, then by components, so ties
are between equal vectors; a null vec_id has no hash and comes after all others.
Fewer vectors than ``k`` give as many centroids; an empty table gives an empty
result. Components of 2^27 or more after scaling would not leave room for a
squared distance in a long and are refused with a ValueError. A cluster's or the
whole inertia beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.store import save, ship, table

#: Components below this keep every squared distance of up to 64 of them under 2^63.
LARGEST = 1 << 27
STATE = "vec_id long, x array<int>, dots array<long>, cluster int, distance long"


def kept_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x) of the vectors that take part, x as integers."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # a component too large for an int shows as LARGEST, which run() refuses
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(v.isNotNull() & (F.size(v) == dims) & F.coalesce(finite, F.lit(False)))
            .select("vec_id", whole.alias("x")))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have ``width`` members, as a matrix."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(col), width)


def _advance(before: np.ndarray | None, after: np.ndarray):
    """The next state of vectors when their centroids move from ``before`` (None: no state yet) to ``after``."""
    k, dims = after.shape
    change = after - (0 if before is None else before)
    squares = (after * after).sum(axis=1)

    def run(batches):
        for b in batches:
            n = b.num_rows
            x = _matrix(b.column(1), dims)
            dots = np.zeros((n, k), np.int64) if before is None else _matrix(b.column(2), k).copy()
            for c in range(k):
                moved = np.flatnonzero(change[c])
                if len(moved):
                    dots[:, c] += x[:, moved] @ change[c, moved]
            distance = squares - 2 * dots           # without |x|^2, which moves no minimum
            nearest = distance.argmin(axis=1) if n else np.zeros(0, np.int64)
            least = (x * x).sum(axis=1) + distance[np.arange(n), nearest]
            rows = pa.array(np.arange(n + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(rows, pa.array(dots.ravel())),
                 pa.array(nearest.astype(np.int32)), pa.array(least)],
                names=["vec_id", "x", "dots", "cluster", "distance"])
    return run


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids moved to the floored mean of their vectors; those without any stay."""
    dims = centroids.shape[1]
    sums = (state.groupBy("cluster")            # at most k rows, summed before the shuffle
            .agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.col("x")[i].cast("long")) for i in range(dims)]).alias("total"))
            .collect())
    out = centroids.copy()
    for r in sums:
        out[r.cluster] = [t // r.n for t in r.total]
    return out


def cluster_vectors(df: DataFrame, *, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256,
                    salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of every kept vector.

    Centroids start as the ``k`` vectors with the smallest sha256 of ``salt`` and their id; after ``rounds``
    rounds of assigning and moving, vectors are assigned once more."""
    if dims > 64:
        raise ValueError("more than 64 components leave no room for exact distances")
    spark = df.sparkSession
    ship(spark)
    vectors = kept_vectors(df, id_col, vector_col, dims, scale)
    hashed = vectors.withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
    starts = hashed.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()          # k rows
    after = np.array([r.x for r in starts], np.int64).reshape(len(starts), dims)
    largest = vectors.agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x")))).first()[0]
    if largest is not None and largest >= LARGEST:
        raise ValueError(f"components must stay below {LARGEST // scale}")
    if not len(starts):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string, centroid array<long>")
    before, state = None, vectors
    for r in range(rounds + 1):
        state = save(state.mapInArrow(_advance(before, after), STATE), f"centroid-state-{r}")
        if r < rounds:
            before, after = after, _moved(state, after)

    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = state.groupBy("cluster").agg(whole.alias("s")).collect()                 # k rows
    total = sum(int(r.s) for r in sums)
    fits = lambda s: int(s) if s < 1 << 63 else None
    told = spark.createDataFrame(
        [(r.cluster, fits(r.s), fits(total), hashlib.sha256(",".join(map(str, after[r.cluster].tolist())).encode()).hexdigest(),
          after[r.cluster].tolist()) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    out = state.select("vec_id", "cluster", "distance").join(F.broadcast(told), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("centroid")


def _round_sql(r: int) -> str:
    return f"""
near{r} AS MATERIALIZED (
  SELECT id, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT x.id, m.c, sum((x.x - m.x) * (x.x - m.x))::BIGINT AS d
        FROM parts x JOIN middle{r} m USING (i) GROUP BY ALL)
  GROUP BY id)"""


def _move_sql(r: int) -> str:
    return f"""
middle{r + 1} AS MATERIALIZED (
  SELECT m.c, m.i, coalesce((s.s - ((s.s % s.n) + s.n) % s.n) // s.n, m.x)::BIGINT AS x
  FROM middle{r} m LEFT JOIN (
    SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM parts JOIN near{r} USING (id) GROUP BY ALL) s USING (c, i))"""


OP11_SQL = r"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, [floor(256 * c::DOUBLE)::BIGINT FOR c IN embedding] AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len([c FOR c IN embedding IF c IS NOT NULL AND isfinite(c)]) = 64),
parts AS MATERIALIZED (SELECT id, unnest(range(1, 65)) AS i, unnest(x) AS x FROM vectors),
middle0 AS MATERIALIZED (
  SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS x
  FROM (SELECT x, row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS c FROM vectors)
  WHERE c < 40),""" + ",".join(_round_sql(r) + "," + _move_sql(r) for r in range(5)) + "," + _round_sql(5) + r""",
digest AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS h FROM middle5 GROUP BY c)
SELECT v.vec_id, n.c::INTEGER AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia,
       (sum(n.d) OVER ())::BIGINT AS inertia, g.h AS centroid_sha256
FROM near5 n JOIN vectors v USING (id) JOIN digest g ON g.c = n.c
"""
