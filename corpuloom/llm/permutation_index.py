"""Approximate nearest neighbours: a permutation index.

Every vector is represented by its nearest pivots in order. Blocks of vectors are posted in
inverted files of the pivots; a query reads the lists of its own pivots, which add up to the
footrule distance to every vector of the block. The nearest by footrule are ranked again by
the inner product of the vectors themselves. What share of a block is ranked again is fitted
on sample queries, so that their true neighbours are among them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuloom.llm.common import binaries, gathered, vectors_of
from corpuloom.session import cut, ship, table

#: Pivots of each length of vector, and how many of them, in order, represent a vector.
PIVOTS, PREFIX = 512, 64
#: Vectors of a block, at most BLOCK_BYTES together; queries that visit a block in one task.
BLOCK, BLOCK_BYTES, GROUP = 16_384, 64 << 20, 8192
#: Queries that the share is fitted on, and the part of their true neighbours that must be found.
SAMPLE, TARGET = 128, 0.97


def _packed(batches):
    """vec_id, dim, raw: usable vectors as bytes of doubles, -0.0 as 0.0."""
    for b in batches:
        column, ids = b.column("embedding"), b.column("vec_id")
        ok, sizes, starts = vectors_of(column)
        for dim in np.unique(sizes[ok]).tolist():
            here = np.flatnonzero(ok & (sizes == dim))
            x = gathered(column, starts[here], dim) + 0.0
            some = x.any(axis=1)
            here, x = here[some], x[some]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(here)), pa.array(np.full(len(here), dim, np.int32)), binaries(x)], ["vec_id", "dim", "raw"])


def stacked(raw: list[bytes], kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def prefixes(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k pivots of largest inner product with each vector, in order; ties go to the lower number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :k].astype(np.int16)


class Postings:
    """Inverted files of a block: for each pivot the vectors that have it in their prefix, and the weight of its place there."""

    def __init__(self, prefix: np.ndarray, pivots: int):
        n, self.k = prefix.shape
        order = np.argsort(prefix.ravel(), kind="stable")
        self.rows = (order // self.k).astype(np.int32)
        self.weights = (self.k - order % self.k).astype(np.int16)
        self.starts = np.searchsorted(prefix.ravel()[order], np.arange(pivots + 1))
        self.n = n

    def nearness(self, prefix: np.ndarray) -> np.ndarray:
        """For one query: k (k + 1) / 2 less half of the footrule distance of its prefix to each vector's, pivots outside of a prefix taking place k."""
        out = np.zeros(self.n, np.int32)
        for place, pivot in enumerate(prefix.tolist()):
            lo, hi = self.starts[pivot], self.starts[pivot + 1]
            # A pivot in places a and b of both prefixes adds k - max(a, b).
            out[self.rows[lo:hi]] += np.minimum(self.weights[lo:hi], self.k - place)
        return out


def least_of(nearness: np.ndarray, many: int) -> int:
    """The nearness of the many-th nearest; all vectors of that nearness are candidates too."""
    counts = np.bincount(nearness)[::-1]
    return len(counts) - 1 - int(np.searchsorted(np.cumsum(counts), min(many, len(nearness))))


def first_of(scores: np.ndarray, reps: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by rep."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((reps[some], -scores[some]))][:k]


def _tile(pivots: int, k: int, shares: dict, fit: bool):
    """Queries of one group against one block. When fitting, all vectors are ranked, with the share of the block that is as near by footrule."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        is_query = pdf["query"].to_numpy()
        own, asked = pdf[~is_query], pdf[is_query]
        if own.empty or asked.empty:
            return pd.DataFrame({c: [] for c in ("qid", "qkey", "rep", "key", "score", "place", "dim")})
        dim = int(pdf["dim"].iloc[0])
        x, reps, keys = stacked(list(own["raw"])), own["rep"].to_numpy(), own["key"].to_numpy()
        index = Postings(stacked(list(own["prefix"]), np.int16), pivots)
        out: list = []
        for qid, qkey, raw, prefix in zip(asked["rep"], asked["key"], asked["raw"], asked["prefix"], strict=True):
            q, near = np.frombuffer(raw), index.nearness(np.frombuffer(prefix, np.int16))
            if fit:
                rows = np.arange(len(x))
            else:
                rows = np.flatnonzero(near >= least_of(near, max(k, int(np.ceil(shares[dim] * len(x))))))
            scores = x[rows] @ q
            best = first_of(scores, reps[rows], k)
            places = (len(x) - np.searchsorted(np.sort(near), near[rows[best]])) / len(x) if fit else np.zeros(len(best))
            out.append((np.full(len(best), qid), np.full(len(best), qkey), reps[rows[best]], keys[rows[best]], scores[best], places))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pd.DataFrame(dict(zip(["qid", "qkey", "rep", "key", "score", "place"], cols, strict=True))).assign(dim=dim)

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, block: int = BLOCK, group: int = GROUP, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that is_query holds for, its k nearest others by inner product in double precision.

    Null, empty and zero vectors, those with a null or non-finite component, and rows without vec_id
    take no part. Only vectors of one length are compared; lengths are few. Equal vectors are folded
    and searched once; ties go to the smaller vec_id. Repeated rows count once; if one vec_id has
    several vectors, it is found by its best one, never by itself. Other columns are ignored; an empty
    table gives an empty result.

    At most `pivots` vectors of each length, chosen by hash, are pivots, and at most about `sample`
    queries of each length fit the share of every block that is ranked again; all rows are indexed and
    all queries visit all blocks. Vectors of equal footrule are all ranked, so that groups of near
    copies, which have one permutation, aren't cut.
    """
    spark = vectors.sparkSession
    ship(spark)
    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("_asked"))
    asked_ids = picked.where("_asked and vec_id is not null").select("vec_id").distinct()
    packed = picked.select("vec_id", "embedding").where("vec_id is not null").mapInArrow(_packed, "vec_id long, dim int, raw binary")
    # Grouped by vector and id first, so that the rows of a very common vector are spread.
    rows = cut(packed.groupBy("dim", "raw", "vec_id").agg(F.lit(1).alias("_")).drop("_"), "vectors")
    by_id = Window.partitionBy("dim", "raw").orderBy("vec_id")
    few = rows.withColumn("_at", F.row_number().over(by_id)).where(F.col("_at") <= k + 1)
    classes = cut(few.groupBy("dim", "raw").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("key", F.xxhash64("raw")), "classes")
    asked_rows = cut(rows.join(asked_ids.hint("merge"), "vec_id", "left_semi"), "asked")
    searched = cut(asked_rows.groupBy("dim", "raw").agg(F.min("vec_id").alias("rep")).withColumn("key", F.xxhash64("raw")), "searched")

    count = lambda df: {r.dim: r.n for r in df.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes, queries_of = count(classes), count(searched)
    if not queries_of:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    number = lambda held: F.element_at(F.create_map(*[F.lit(x) for kv in held.items() for x in kv]), F.col("dim"))

    def some(df: DataFrame, of: dict, most: int, seed: int) -> DataFrame:
        """The `most` rows of each length that come first by hash; a bound on the hash keeps all but a few times as many from being sorted."""
        h = F.xxhash64("raw", F.lit(seed))
        bound = {d: min(1 << 30, int((1 << 30) * (4 * most + 100) / n)) for d, n in of.items()}
        first = Window.partitionBy("dim").orderBy(h, "raw")
        return df.where(F.pmod(h, F.lit(1 << 30)) < number(bound)).withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= most)

    chosen = some(classes.select("dim", "raw"), sizes, pivots, 2).collect()
    held = {d: stacked([bytes(r.raw) for r in sorted((r for r in chosen if r.dim == d), key=lambda r: r._at)]) for d in {r.dim for r in chosen}}
    # Pivots tell directions only.
    shared = spark.sparkContext.broadcast({d: x / np.abs(x).max(axis=1, keepdims=True) / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) for d, x in held.items()})

    def represent(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                p = shared.value[dim]
                marks = prefixes(stacked(part.column("raw").to_pylist()), p, min(prefix, len(p)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("dim", "raw", "rep", "key")), binaries(marks)], ["dim", "raw", "rep", "key", "prefix"])

    schema = "dim int, raw binary, rep long, key long, prefix binary"
    blocks = {d: -(-n // max(1, min(block, BLOCK_BYTES // (8 * d)))) for d, n in sizes.items()}
    groups = {d: -(-n // group) for d, n in queries_of.items()}
    spread = lambda df, n: F.pmod(F.xxhash64("raw", F.lit(1)), n).cast("int")
    index = cut(classes.select("dim", "raw", "rep", "key").mapInArrow(represent, schema), "index")
    marked = cut(searched.mapInArrow(represent, schema), "marked")

    def visits(queries: DataFrame, groups: dict) -> DataFrame:
        """Each block once for every group of queries, with the queries of that group."""
        own = index.withColumn("block", spread(index, number(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), number(groups) - 1))).withColumn("query", F.lit(False))
        asked = queries.withColumn("group", spread(queries, number(groups))).withColumn("block", F.explode(F.sequence(F.lit(0), number(blocks) - 1))).withColumn("query", F.lit(True))
        return own.where(number(groups).isNotNull()).unionByName(asked)

    def search(queries: DataFrame, groups: dict, shares: dict, fit: bool) -> DataFrame:
        return visits(queries, groups).groupBy("dim", "block", "group").applyInPandas(_tile(pivots, k + 1, shares, fit), "qid long, qkey long, rep long, key long, score double, place double, dim int")

    order = Window.partitionBy("qid", "qkey", "dim").orderBy(F.desc("score"), "rep")
    tried = some(marked, queries_of, sample, 3).drop("_at")
    true = search(tried, {d: 1 for d in groups}, {}, True).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k + 1)
    # The query's own vector, the nearest by footrule, tells nothing of its neighbours.
    shares = {r.dim: float(r.share) for r in true.where("rep <> qid or key <> qkey").groupBy("dim").agg(F.percentile("place", target).alias("share")).collect()}
    shares = {d: shares.get(d, 1.0) for d in groups}

    found = search(marked, groups, shares, False).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k + 1)
    hits = found.join(classes.select("dim", "rep", "key", "ids").hint("merge"), ["dim", "rep", "key"]).select("dim", "qid", "qkey", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("qid", "qkey", "dim").orderBy(F.desc("score"), "vec_id")
    hits = cut(hits.groupBy("dim", "qid", "qkey", "vec_id").agg(F.max("score").alias("score")).withColumn("_at", F.row_number().over(top)).where(F.col("_at") <= k + 1).drop("_at"), "hits")
    names = asked_rows.join(searched.select("dim", "raw", F.col("rep").alias("qid"), F.col("key").alias("qkey")).hint("merge"), ["dim", "raw"]).select(F.col("vec_id").alias("query_id"), "dim", "qid", "qkey")
    each = names.join(hits.hint("merge"), ["dim", "qid", "qkey"]).where(F.col("query_id") != F.col("vec_id")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id 20 divides, the 20 others of largest inner product that the index finds."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
