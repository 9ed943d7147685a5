"""Embedding whitening: each partition's count, mean and centred scatter, merged pairwise in a tree.

Vectors become whole numbers, so that sums and distances from the mean are exact. A first
pass gives each partition's count, sums and scatter about its own mean; Chan's formula
merges two of them. The driver takes the eigenvectors of one covariance for each length of
vector. A second pass projects all vectors, a third merges the covariance of what came out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm.common import gathered, vectors_of
from corpuloom.session import cut, ship, table

#: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Partial results that one task of the tree merges, and that the driver receives at most at the end.
FAN = 16
#: A component of less variance than this share of the largest one is held to have none.
FLAT = 1e-12
#: Larger entries have no whole number of 64 bits.
LARGEST = 2.0**62 / SCALE


def merge(a: tuple, b: tuple) -> tuple:
    """Chan's formula: counts, exact sums and scatters about the mean of two sets of rows, as those of their union."""
    na, sa, ma = a
    nb, sb, mb = b
    # The difference of the means from whole numbers, so that large sums lose nothing.
    apart = np.array([int(y) * na - int(x) * nb for x, y in zip(sa, sb, strict=True)], np.float64) / (float(na) * nb)
    return na + nb, [x + y for x, y in zip(sa, sb, strict=True)], ma + mb + np.outer(apart, apart) * (na * (nb / (na + nb)))


def merge_by_length(a: dict, b: dict) -> dict:
    """The states of two partitions, each by length of vector."""
    out = dict(a)
    for dim, state in b.items():
        out[dim] = merge(out[dim], state) if dim in out else state
    return out


def state_of(x: np.ndarray) -> tuple:
    """Count, exact sums and centred scatter of a matrix of whole numbers."""
    n = len(x)
    sums = [int(v) for v in (x.astype(object).sum(axis=0) if np.abs(x).max() > (1 << 62) // n else x.sum(axis=0))]
    base = np.array([s // n for s in sums], np.int64)
    y = (x - base).astype(np.float64) - np.array([(s - int(b) * n) / n for s, b in zip(sums, base, strict=True)])
    return n, sums, y.T @ y


def merge_means(a: tuple | None, b: tuple | None) -> tuple | None:
    """The same formula for count, mean and scatter of doubles."""
    if a is None or b is None:
        return a or b
    (na, ua, ma), (nb, ub, mb) = a, b
    n, d = na + nb, ub - ua
    return n, ua + d * (nb / n), ma + mb + np.outer(d, d) * (na * (nb / n))


def depth_of(parts: int) -> int:
    """Levels of a tree in which no task merges more than about FAN states."""
    return max(2, int(np.ceil(np.log(max(parts, 2)) / np.log(FAN))))


def whole(matrix: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * matrix).astype(np.int64) + SHIFT


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As vectors_of, without vectors whose numbers are too large for x."""
    ok, sizes, starts = vectors_of(column)
    flat = column.values.to_numpy(zero_copy_only=False)
    if len(ok) and len(flat) and np.nanmax(np.abs(flat), initial=0) >= LARGEST:
        large = np.concatenate([[0], np.cumsum(np.abs(flat) >= LARGEST)])
        ok = ok & (large[starts + sizes] == large[starts])
    return ok, sizes, starts


def _partials(batches):
    """One state for each length of vector of a partition."""
    import pickle

    out: dict = {}
    for b in batches:
        column = b.column("embedding")
        ok, sizes, starts = usable(column)
        for dim in np.unique(sizes[ok]).tolist():
            out = merge_by_length(out, {dim: state_of(whole(gathered(column, starts[ok & (sizes == dim)], dim)))})
    if out:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["state"])


def fit(vectors: DataFrame) -> dict:
    """By length of vector: count, exact sums, and the covariance (divisor n) of the whole-number vectors, merged in a tree.

    The driver receives FAN states or so of the last level, whatever the number of partitions.
    """
    import pickle

    ship(vectors.sparkSession)
    states = vectors.select(F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_partials, "state binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    got = states.treeAggregate({}, merge_by_length, merge_by_length, depth_of(states.getNumPartitions()))
    return {dim: (n, sums, scatter / n) for dim, (n, sums, scatter) in got.items()}


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns; the sign makes the largest entry positive."""
    e, v = np.linalg.eigh((covariance + covariance.T) / 2)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return e, v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)


def whitened_vectors(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, dim, n, deviation, whitened (array), explained (array), identity_error: one row per usable vector.

    Vectors that are null, empty, or hold a null, non-finite or too large (2^52) entry are left
    out. Vectors of each length are a fit list of their own; lengths are few. `most` components are
    taken, or as many as the length. A component without variance (equal rows, one row) has a null
    whitened value, an explained share of 0, and no part in identity_error, which is 0 where none has
    variance. Rows are not told apart by vec_id: repeated and null ids each give their rows. deviation
    is exact; where it needs more than 64 bits the job ends with an error that says so. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    models = {}
    for dim, (n, sums, v) in fit(picked).items():
        e, axes = components_of(v, most)
        full = e > FLAT * max(float(e[0]), 0.0) if len(e) else np.zeros(0, bool)
        base = np.array([s // n for s in sums], np.int64)
        models[dim] = {
            "n": n, "base": base, "rest": [s - int(b) * n for s, b in zip(sums, base, strict=True)], "axes": axes, "full": full,
            "root": np.sqrt(np.where(full, e, 1.0)), "explained": np.where(full, e, 0.0) / (np.trace(v) or 1.0),
        }
    shared = spark.sparkContext.broadcast(models)

    def project(batches):
        for b in batches:
            column, ids = b.column("embedding"), b.column("vec_id")
            ok, sizes, starts = usable(column)
            for dim in np.unique(sizes[ok]).tolist():
                m = shared.value[dim]
                here = np.flatnonzero(ok & (sizes == dim))
                y = whole(gathered(column, starts[here], dim)) - m["base"]
                # n * x - S = n * (x - base) - rest, which is far smaller than either.
                far = m["n"] * (int(np.abs(y).max(initial=0)) + 1)
                if dim * far * far < 1 << 62:
                    apart = m["n"] * y - np.array(m["rest"], np.int64)
                    deviation = (apart * apart).sum(axis=1).tolist()
                else:
                    deviation = [sum((m["n"] * v - r) ** 2 for v, r in zip(row, m["rest"], strict=True)) for row in y.tolist()]
                    if max(deviation) >= 1 << 63:
                        raise OverflowError(f"deviation {max(deviation)} of {m['n']} vectors does not fit a long")
                w = (y - np.array([r / m["n"] for r in m["rest"]])) @ m["axes"] / m["root"]
                values = pa.array(w.ravel(), mask=~np.tile(m["full"], len(w)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), values)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(here)), pa.array(np.full(len(here), dim, np.int32)), pa.array(deviation, pa.int64()), lists], ["vec_id", "dim", "deviation", "whitened"])

    done = cut(picked.mapInArrow(project, "vec_id long, dim int, deviation long, whitened array<double>"), "whitened")
    facts = [(int(d), int(m["n"]), [float(x) for x in m["explained"]], identity_error(done.where(F.col("dim") == d), m["full"])) for d, m in sorted(models.items())]
    known = spark.createDataFrame(facts, "dim int, n long, explained array<double>, identity_error double")
    # One row for each length of vector.
    return done.join(F.broadcast(known), "dim").select("vec_id", "dim", "n", "deviation", "whitened", "explained", "identity_error")


def identity_error(done: DataFrame, full: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened values (of components with variance) less the identity, from all rows."""
    if not full.any():
        return 0.0
    keep = np.flatnonzero(full)

    def partial(batches):
        state = None
        for b in batches:
            if b.num_rows:
                column = b.column("whitened")
                w = column.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(full))[:, keep]
                mean = w.mean(axis=0)
                state = merge_means(state, (len(w), mean, (w - mean).T @ (w - mean)))
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int64()), pa.array([state[1].tolist()], pa.list_(pa.float64())), pa.array([state[2].ravel().tolist()], pa.list_(pa.float64()))], ["n", "mean", "scatter"])

    k = len(keep)
    rows = done.select("whitened").mapInArrow(partial, "n long, mean array<double>, scatter array<double>").rdd
    states = rows.map(lambda r: (r.n, np.array(r.mean), np.array(r.scatter).reshape(k, k)))
    n, _, scatter = states.treeAggregate(None, merge_means, merge_means, depth_of(states.getNumPartitions()))
    return float(np.abs(scatter / n - np.eye(k)).max())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per usable vector and component: its whitened value, the component's share of the variance, the vector's exact deviation from the mean and the error of the whole."""
    rows = whitened_vectors(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "v")
    return rows.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("v.whitened").alias("whitened"), F.col("v.explained").alias("explained"), "identity_error"
    )
