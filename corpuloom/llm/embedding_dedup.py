"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative per group.

Vectors of one label are assigned to the cell of their nearest centroid. A vector also
visits every other cell that could hold a vector within the threshold of it: by the
geometry of the cells' boundary no link is lost. Within a cell, products are computed
block by block, so a cell of any size is many bounded tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm.components import connected_components
from corpuloom.session import cut, ship, table

#: Distinct vectors that a cell is meant to hold.
CELL = 1024
#: Vectors that the centroids are fitted on, over all labels; the bound of what reaches the driver.
SAMPLE = 16_384
#: Rows of one side of a tile, and rows of a tile that are multiplied with it at once.
BLOCK, STRIPE = 8192, 512
ROUNDS = 8
#: Cells are of no use where a vector visits more than this share of them.
VISITED = 0.5


def _units(batches):
    """vec_id, label, and for valid vectors: dim, unit vector as float64 bytes, and its digest."""
    for b in batches:
        label = b.column("label")
        rows = []
        for lab, v in zip(label.to_pylist(), b.column("embedding").to_pylist(), strict=True):
            unit = None
            if lab is not None and v and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()
                    unit = x / np.sqrt(x @ x)
            if unit is None:
                rows.append((None, None, None, None))
            else:
                raw = (unit + 0.0).tobytes()
                d = hashlib.blake2b(raw, digest_size=16).digest()
                rows.append((len(unit), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), raw))
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays(
            [b.column("vec_id"), label, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())],
            ["vec_id", "label", "dim", "d1", "d2", "unit"],
        )


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """k unit centroids of unit vectors x; the first centroids are spread by farthest choice among random candidates."""
    rng = np.random.default_rng(seed)
    c = [x[rng.integers(len(x))]]
    best = x @ c[0]
    while len(c) < k:
        tried = rng.choice(len(x), min(16, len(x)), replace=False)
        c.append(x[tried[np.argmin(best[tried])]])
        best = np.maximum(best, x @ c[-1])
    c = np.array(c)
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        for i in range(k):
            s = x[home == i].sum(axis=0)
            n = np.sqrt(s @ s)
            if n > 1e-9:
                c[i] = s / n
    return c


def cells_of(u: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is the home, for every cell that each unit vector belongs to or visits.

    A vector v linked to u is v = t u + s w with cosine t >= threshold, s = sqrt(1 - t^2) and w
    orthogonal to u. v's home can be cell c instead of u's home h only if v (h - c) <= 0, while
    v (h - c) >= t g - s sqrt(|h - c|^2 - g^2) with g = u (h - c) >= 0. So u visits c unless
    threshold * g > sqrt(1 - threshold^2) sqrt(|h - c|^2 - g^2); a slack covers rounding.
    """
    near = u @ c.T
    home = np.argmax(near, axis=1)
    apart = np.maximum(0, 2 - 2 * (c @ c.T))[home]
    g = near[np.arange(len(u)), home][:, None] - near
    s = np.sqrt(1 - threshold**2)
    go = threshold * g <= s * np.sqrt(np.maximum(0, apart - g * g)) + 1e-7
    go[np.arange(len(u)), home] = True
    rows, cell = np.nonzero(go)
    return rows, cell, cell == home[rows]


def _merged(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index connected to each, given those so far and further pairs."""
    i, j = np.concatenate([i, np.arange(len(root))]), np.concatenate([j, root])
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    """One tile of a cell: links of home rows to others, and each row's smallest connected row of the tile."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep").reset_index(drop=True)
        x = np.stack([np.frombuffer(r, np.float64) for r in pdf["unit"]])
        own, n, side, reps = pdf["home"].to_numpy(), pdf["n"].to_numpy(), pdf["side"].to_numpy(), pdf["rep"].to_numpy()
        cross = pdf["cross"].iloc[0]
        root, links = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k in range(0, len(x), STRIPE):
            here = slice(k, k + STRIPE)
            link = (x[here] @ x.T) >= threshold
            link[np.arange(len(link)), np.arange(k, k + len(link))] = False
            link &= own[here, None] | own[None, :]
            if cross:
                link &= side[here, None] != side[None, :]
            links[here] = link @ n
            # Of rows that are connected already, only one link into each component is needed.
            i, j = np.nonzero(link & (root[here, None] != root[None, :]))
            if len(i):
                root = _merged(root, i + k, j)
        some = (links > 0) | (root != np.arange(len(x)))
        return pd.DataFrame({"a": reps, "b": reps[root], "links": np.where(own, links, 0)})[some]

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.93, cell: int = CELL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row.

    Vectors of one label (not null) and one length are linked at cosine >= threshold, in double
    precision. Null, empty and zero vectors, and those with a null or non-finite component, link
    with nothing. Equal vectors are folded before the comparison and counted as
    other vectors in n_links; a null vec_id stays alone with a null component_id and is
    kept. Extra columns are ignored; an empty table gives an empty result.

    Centroids are fitted on at most `sample` distinct vectors, chosen by hash; every vector is
    assigned and compared. Different vectors of one vec_id are in one component, through their id; ties
    at the threshold are links.
    """
    spark = vectors.sparkSession
    ship(spark)
    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    units = cut(picked.mapInArrow(_units, "vec_id long, label string, dim int, d1 long, d2 long, unit binary"), "units")
    key = ["label", "dim", "d1", "d2"]
    classes = cut(
        units.where("unit is not null and vec_id is not null").groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit")), "classes"
    )
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > cell)
    total = sizes.agg(F.sum("many")).first()[0] or 0
    centroids: dict = {}
    if total:
        # Of every large label, the same share by hash; the limit is the bound of what the driver receives.
        share = min(1.0, sample / total)
        few = classes.join(sizes, ["label", "dim"]).where(F.pmod("d1", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
        rows = few.select("label", "dim", "many", "unit").limit(2 * sample).collect()
        for lab, dim in sorted({(r.label, r.dim) for r in rows}):
            own = [r for r in rows if (r.label, r.dim) == (lab, dim)]
            x = np.sort(np.array([np.frombuffer(r.unit, np.float64) for r in own]).view(",".join(["f8"] * dim)), axis=0).view(np.float64).reshape(len(own), dim)
            k = min(-(-own[0].many // cell), max(1, len(x) // 8))
            c = spherical_kmeans(x, k) if k > 1 else None
            # Vectors without clusters would visit nearly all cells: then tiles of the label are less work.
            if c is not None and len(cells_of(x, c, threshold)[0]) <= VISITED * len(x) * k:
                centroids[lab, dim] = c
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        held = shared.value
        for b in batches:
            labels, dims, reps, ns, units_ = (b.column(c).to_pylist() for c in ("label", "dim", "rep", "n", "unit"))
            out: list = [[], [], [], [], [], []]
            by: dict = {}
            for i, at in enumerate(zip(labels, dims, strict=True)):
                by.setdefault(at, []).append(i)
            for at, own in by.items():
                c = held.get(at)
                if c is None:
                    spots = ((i, 0, True) for i in own)
                else:
                    spots = []
                    for j in range(0, len(own), 1024):
                        part = own[j : j + 1024]
                        r, cell_, home = cells_of(np.array([np.frombuffer(units_[i], np.float64) for i in part]), c, threshold)
                        spots += zip(np.array(part)[r].tolist(), cell_.tolist(), home.tolist(), strict=True)
                for i, cell_, home in spots:
                    for col, v in zip(out, (labels[i], cell_, home, reps[i], ns[i], units_[i]), strict=True):
                        col.append(v)
                    if len(out[0]) >= 8192:
                        yield pa.RecordBatch.from_arrays([pa.array(c_, t) for c_, t in zip(out, kinds, strict=True)] + [pa.array([at[1]] * len(out[0]), pa.int32())], names)
                        out = [[], [], [], [], [], []]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c_, t) for c_, t in zip(out, kinds, strict=True)] + [pa.array([at[1]] * len(out[0]), pa.int32())], names)
                    out = [[], [], [], [], [], []]

    names = ["label", "cell", "home", "rep", "n", "unit", "dim"]
    kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    placed = cut(classes.mapInArrow(assign, "label string, cell int, home boolean, rep long, n long, unit binary, dim int"), "cells")
    cells = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = placed.join(cells, ["label", "dim", "cell"]).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = rows.withColumn("other", other).select(
        "label", "dim", "cell", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", (F.col("side") != F.col("other")).alias("cross"), "home", "rep", "n", "unit"
    )
    # A row meets its own block in tile (side, side), and each other block in one more tile.
    found = cut(tiles.groupBy("label", "dim", "cell", "lo", "hi").applyInPandas(_compare(threshold), "a long, b long, links long"), "links")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    comp = connected_components(found.select("a", "b")).withColumnRenamed("id", "rep")
    final = classes.select(*key, "rep", "n").join(links, "rep", "left").join(comp, "rep", "left")
    final = final.select(*key, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = units.select("vec_id", *key).join(final, key, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: how many others of its label have a cosine of 0.93 or more, its component, and whether it is the smallest id of it."""
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
