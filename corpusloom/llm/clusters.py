"""Centroid clustering on integers with adaptive distance bounds: exact assignments, most of them without a distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, batches

SCALE, LARGEST = 1024, 1 << 27
#: Bounds are sums of rounded roots; each is moved by this share of itself to the safe side.
SLACK = 1e-12
STATE = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("near", pa.list_(pa.int32())), ("lower", pa.list_(pa.float64())), ("distance", pa.int64()), ("needed", pa.int32())])
STATE_SQL = "vec_id long, v array<int>, cluster int, upper double, near array<int>, lower array<double>, distance long, needed int"


def whole_numbers(vectors: DataFrame, size: int) -> DataFrame:
    """(vec_id, v): vectors of ``size`` finite components as integers."""
    x = F.transform("embedding", lambda x: x.cast("double"))
    fine = (F.size("x") == size) & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("x", lambda x: F.floor(x * SCALE))
    too_large = F.raise_error(F.lit(f"a component exceeds {LARGEST // SCALE}: squared distances would not fit a long"))
    out = vectors.select("vec_id", x.alias("x")).where(fine).select("vec_id", v.alias("v"))
    return out.select("vec_id", F.when(F.exists("v", lambda x: F.abs(x) > LARGEST), too_large).otherwise(F.col("v")).cast("array<int>").alias("v"))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    return np.stack([((v - c) ** 2).sum(-1) for c in centroids], 1)


class Bounds:
    """Of each row: its centroid and an upper bound on the distance to it, lower bounds for the ``b`` next centroids in
    order, and a last one for all the rest.
    """

    def __init__(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray):
        self.v, self.cluster, self.upper, self.near, self.lower = v, cluster, upper, near, lower
        self.needed = np.zeros(len(v), np.int32)

    @classmethod
    def scanned(cls, v: np.ndarray, centroids: np.ndarray, b: int) -> Bounds:
        """All distances; ties go to the smaller number."""
        d = squared(v, centroids)
        order = np.argsort(d, 1, kind="stable")
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
        rest = root[:, b + 1 : b + 2] * (1 - SLACK) if len(centroids) > b + 1 else np.full((len(v), 1), np.inf)
        return cls(v, order[:, 0].astype(np.int32), root[:, 0] * (1 + SLACK), order[:, 1 : b + 1].astype(np.int32), np.hstack((root[:, 1 : b + 1] * (1 - SLACK), rest)))

    def moved(self, drift: np.ndarray, b: int) -> None:
        """After the centroids moved by ``drift``: looser bounds, the last b of them merged into the remainder's."""
        self.upper = (self.upper + drift[self.cluster]) * (1 + SLACK)
        self.lower[:, :-1] -= drift[self.near]
        self.lower[:, -1] -= drift.max()
        self.lower *= np.where(self.lower > 0, 1 - SLACK, 1 + SLACK)
        self.lower = np.minimum.accumulate(self.lower[:, ::-1], 1)[:, ::-1]
        self.near, self.lower = self.near[:, :b], self.lower[:, : b + 1].copy()

    def settle(self, centroids: np.ndarray) -> None:
        """Rows whose order is certain stay. Else only the centroids before the first bound above the upper one can win:
        their distances are computed; where there is no such bound, all are.
        """
        b = self.near.shape[1]
        certain = self.upper[:, None] < self.lower
        self.needed = np.where(certain.any(1), certain.argmax(1), b + 1).astype(np.int32)
        for q in range(1, b + 1):
            at = np.flatnonzero(self.needed == q)
            if len(at):
                own = np.sort(np.column_stack((self.cluster[at], self.near[at, :q])), 1)  # by number, so that ties go to the smaller
                d = ((self.v[at, None, :] - centroids[own]) ** 2).sum(-1)
                order = np.argsort(d, 1, kind="stable")
                root, own = np.sqrt(np.take_along_axis(d, order, 1).astype(float)), np.take_along_axis(own, order, 1)
                self.cluster[at], self.upper[at] = own[:, 0], root[:, 0] * (1 + SLACK)
                self.near[at, :q], self.lower[at, :q] = own[:, 1:], root[:, 1:] * (1 - SLACK)
        at = np.flatnonzero(self.needed == b + 1)
        if len(at):
            new = Bounds.scanned(self.v[at], centroids, b)
            self.cluster[at], self.upper[at], self.near[at], self.lower[at] = new.cluster, new.upper, new.near, new.lower


def _step(centroids: np.ndarray, drift: np.ndarray | None, b: int, last: bool):
    """A round over batches of the state; the first scans, the last adds exact distances."""

    def matrix(column: pa.Array, kind) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1).astype(kind)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not len(batch):
                continue
            v = matrix(batch.column("v"), np.int64)
            if drift is None:
                state = Bounds.scanned(v, centroids, b)
            else:
                state = Bounds(v, *(batch.column(n).to_numpy().copy() for n in ("cluster", "upper")), *(matrix(batch.column(n), t) for n, t in (("near", np.int32), ("lower", float))))
                state.moved(drift, b)
                state.settle(centroids)
            exact = ((v - centroids[state.cluster]) ** 2).sum(1) if last else np.zeros(len(v), np.int64)
            nested = {n: pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel())) for n, x in (("near", state.near.astype(np.int32)), ("lower", state.lower))}
            yield batches({"vec_id": batch.column("vec_id"), "v": batch.column("v").cast(STATE.field("v").type), "cluster": state.cluster, "upper": state.upper, "distance": exact, "needed": state.needed, **nested}, STATE)

    return run


def _sums(size: int):
    """Partial sums of a task: cluster, rows, components' sums, the most bounds that a row needed."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("needed", pa.int32()), ("scans", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in it:
            v = batch.column("v").flatten().to_numpy().astype(np.int64).reshape(len(batch), -1)
            cluster, needed = batch.column("cluster").to_numpy(), batch.column("needed").to_numpy()
            for k in np.unique(cluster).tolist():
                own = cluster == k
                n, s, most, scans = total.get(k, (0, np.zeros(size, np.int64), 0, 0))
                total[k] = (n + int(own.sum()), s + v[own].sum(0), max(most, int(needed[own].max())), scans + int((needed[own] > 0).sum()))
        yield batches({"cluster": list(total), "n": [t[0] for t in total.values()], "sums": [t[1].tolist() for t in total.values()], "needed": [t[2] for t in total.values()], "scans": [t[3] for t in total.values()]}, schema)

    return run, "cluster int, n long, sums array<long>, needed int, scans long"


def _digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(spark: SparkSession, vectors: DataFrame, k: int = 8, size: int = 64, rounds: int = 10, seed: int = 3, told: list[dict] | None = None) -> DataFrame:
    """One row for each kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components are floor(1024 * x); centroids start as the k vectors with the smallest sha256 of ``seed:vec_id`` and become
    the floored means of their vectors, ``rounds`` times. A vector keeps lower bounds for its next few centroids (half of
    them at first, then as many as any vector needed in the round before) and one for the remainder; centroids' moves
    loosen them, and distances are computed only where they leave the order open. Results are those of a full scan:
    bounds decide only strict order, with a margin for rounding, and distances are integers.

    Each round's state is a table in the shared folder, the one before it is dropped; k rows of sums come to the driver.
    Vectors of other sizes, or with a null or non-finite component, and null vectors are left out. Rows that repeat a vec_id count each;
    a null vec_id hashes as empty. Fewer vectors than k give as many centroids; none, or an empty table, no rows. Components beyond
    131,072 raise an error, since distances would not fit a long. ``told`` is given each round's counts of vectors scanned.
    """
    scratch = Scratch(spark)
    state = scratch.put(whole_numbers(vectors, size))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids, drift, b = np.array([r.v for r in first], np.int64), None, min(len(first) - 1, max(1, len(first) // 2))
    for r in range(rounds + 1):
        old, state = state, scratch.put(state.mapInArrow(_step(centroids, drift, b, r == rounds), STATE_SQL))
        scratch.drop_all_but(state)
        if r == rounds:
            break
        fn, kind = _sums(size)
        parts = state.select("v", "cluster", "needed").mapInArrow(fn, kind)
        sums = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("needed").alias("needed"), F.sum("scans").alias("scans"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(size)]).alias("sums")).collect()
        if told is not None:
            told.append({"round": r, "rows": sum(s.n for s in sums), "scanned": sum(s.scans for s in sums) if r else sum(s.n for s in sums), "bounds": b})
        new = centroids.copy()
        for s in sums:
            new[s.cluster] = [int(x) // s.n for x in s.sums]
        if r:
            b = min(b, max(1, max(s.needed for s in sums)))
        drift = np.sqrt(((new - centroids) ** 2).sum(1).astype(float)) * (1 + SLACK)
        centroids = new
    by = {s.cluster: int(s.d) for s in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}

    def of_cluster(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)

    out = state.select("vec_id", "cluster", "distance").withColumn("cluster_inertia", of_cluster([by.get(i, 0) for i in range(len(centroids))]).cast("long"))
    return out.withColumn("inertia", F.lit(sum(by.values())).cast("long")).withColumn("centroid_sha256", of_cluster([_digest(c) for c in centroids])).select(*columns)


def _sql(k: int = 8, rounds: int = 10) -> str:
    nearest = "SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM e JOIN {0} USING (j) GROUP BY 1, 2) GROUP BY 1"
    parts = [
        "v AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = 64)",
        "e AS MATERIALIZED (SELECT vec_id, unnest(range(64)) AS j, CAST(floor(1024 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT c, j, x AS y FROM e JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v) USING (vec_id) WHERE c < {k})",
    ]
    for r in range(1, rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(f'c{r - 1}')})")
        parts.append(f"m{r} AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM e JOIN a{r} USING (vec_id) GROUP BY 1, 2)")
        parts.append(f"c{r} AS MATERIALIZED (SELECT o.c, o.j, CASE WHEN n IS NULL THEN o.y ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS y FROM c{r - 1} o LEFT JOIN m{r} m ON o.c = m.c AND o.j = m.j)")
    parts.append(f"z AS MATERIALIZED ({nearest.format(f'c{rounds}')})")
    parts.append(f"h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY 1)")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM z JOIN h USING (c)"


SQL = _sql()
