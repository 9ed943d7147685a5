"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be taken the same fractional number of times. The whole
part is sure; the fractions are rounded in pairs: words move between the two documents of
a pair, in a random direction that keeps both expectations, until one fraction is 0 or
1. A source's words therefore stay put at every step. Buckets of documents are rounded in
parallel and leave one fraction each, and those are paired again up a reduction tree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuloom.session import cut, ship, table

#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Times a source, and so a document, may be repeated.
MOST = 3
#: Documents of a bucket, and residual fractions that a node of the tree combines.
BUCKET, FAN = 2048, 256
#: Equal rows that one task numbers.
BLOCK = 1 << 16


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, the number of words of each text (0 for null), and a hash of the whole row."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), _row_hash(docs).alias("row_hash"))


def _row_hash(docs: DataFrame):
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map" not in f.dataType.simpleString()])


def numbered(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows with n, how many are equal, and again, a number from 0 among equal ones.

    Equal rows are counted and spelled out again, in blocks that are dealt to all tasks, so no group meets in one.
    """
    counted = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "counted")
    few = counted.where(F.col("n") <= block).withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = counted.where(F.col("n") > block).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block))))
    first = F.col("block") * block
    many = many.repartition(F.col("row_hash"), F.col("block")).withColumn("again", F.explode(F.sequence(first, F.least(first + block, F.col("n")) - 1))).drop("block")
    return few.unionByName(many)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, n, source_size, target: shares of all words by weight, none above `most` times its source's words.

    Sources stop at their bound and the excess is shared by weight among the others, again until none
    is above; every turn is one aggregation over the sources. Sources are numbered by range partitions, whose
    sizes are added up.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ordered = cut(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("many")).select("part", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    place = F.col("offset") + F.col("inside")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = cut(ordered.withColumn("inside", inside).join(F.broadcast(parts), "part").select("source", "n", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")), "weights")
    every, level = per.agg(F.sum("source_size")).first()[0] or 0, -1.0
    while True:
        stopped = F.col("cap") <= level * F.col("weight")
        held, left = per.agg(F.sum(F.when(stopped, F.col("cap"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not left:
            break
        now = (every - (held or 0)) / left
        if now <= level:
            break
        level = now
    stopped = F.col("cap") <= level * F.col("weight")
    target = F.when(stopped, F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return per.select("source", "n", "source_size", target.alias("target"))


def _uniform(seed: int, *ids) -> float:
    return (xxhash.xxh64_intdigest(repr(ids), seed) >> 11) / (1 << 53)


def pivot(ids: list, sizes: list, fractions: list, seed: int, last: bool) -> tuple[list[float], int]:
    """Rounded fractions, and the place of the one that is left between 0 and 1 (-1 for none).

    With `last`, that one is rounded too.
    """
    f = list(fractions)
    held = -1
    for j in range(len(f)):
        if not 0 < f[j] < 1:
            continue
        if sizes[j] == 0:
            f[j] = float(_uniform(seed, ids[j]) < f[j])
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, sizes[held], sizes[j]
        up = min((1 - f[i]) * a, f[j] * b)
        down = min(f[i] * a, (1 - f[j]) * b)
        if _uniform(seed, ids[i], ids[j]) * (up + down) < down:
            full = (1 - f[i]) * a <= f[j] * b
            f[i], f[j] = (1.0, f[j] - up / b) if full else (f[i] + up / a, 0.0)
        else:
            empty = f[i] * a <= (1 - f[j]) * b
            f[i], f[j] = (0.0, f[j] + down / b) if empty else (f[i] - down / a, 1.0)
        for k in (i, j):
            if f[k] < 1e-12 or f[k] > 1 - 1e-12:
                f[k] = float(round(f[k]))
        held = j if 0 < f[j] < 1 else i if 0 < f[i] < 1 else -1
    if held >= 0 and last:
        f[held] = float(_uniform(seed, ids[held]) < f[held])
        held = -1
    return f, held


def _round(seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "doc_id", "size"], na_position="last").reset_index(drop=True)
        f, held = pivot(pdf["turn"].tolist(), pdf["size"].tolist(), pdf["fraction"].tolist(), seed, bool(pdf["last"].iloc[0]))
        pdf["fraction"] = f
        pdf["open"] = np.arange(len(pdf)) == held
        return pdf

    return run


_ROWS = "doc_id long, source string, size long, row_hash long, n long, source_size long, target double, whole long, fraction double, turn long, bucket long, buckets long, last boolean, open boolean"


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 20240607, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, row_hash, n: one row per input row.

    Sources by code point, null last, weigh `weights` in turn and share all words, up to
    `most` times their own. A document is taken floor or ceil of target / source_size times;
    a source's words differ from its target by less than its largest document. A null
    or empty text has size 0 and takes part with no words. Choices depend on the seed and the rows' content
    alone, so reruns agree; of n equal rows each is a row of its own, and so are rows of one doc_id or of none.
    An empty table gives an empty result; extra columns are ignored but for telling rows apart.
    """
    ship(docs.sparkSession)
    sizes = cut(sized(docs), "sizes")
    targets = cut(source_targets(sizes, weights, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = targets.withColumn("rate", rate).withColumn("buckets", F.ceil(F.col("n") / bucket).cast("long")).select(F.col("source").alias("s"), "source_size", "target", "rate", "buckets")
    rows = numbered(sizes).join(per, F.col("source").eqNullSafe(F.col("s")))
    turn = F.xxhash64("doc_id", "row_hash", "again", F.lit(seed))
    whole = F.floor("rate").cast("long")
    rows = rows.select(
        "doc_id", "source", "size", "row_hash", "n", "source_size", "target", whole.alias("whole"), (F.col("rate") - whole).alias("fraction"), turn.alias("turn"),
        F.pmod(F.xxhash64(turn, F.lit(1)), F.col("buckets")).alias("bucket"), "buckets", (F.col("buckets") == 1).alias("last"), F.lit(False).alias("open"),
    )
    most_buckets = targets.agg(F.max(F.ceil(F.col("n") / bucket))).first()[0] or 1
    done = None
    while True:
        level = cut(rows.groupBy("source", "bucket").applyInPandas(_round(seed), _ROWS), "rounded")
        closed = level.where("not open")
        done = closed if done is None else done.union(closed)
        if most_buckets <= 1:
            break
        most_buckets = -(-most_buckets // fan)
        fewer = F.ceil(F.col("buckets") / fan).cast("long")
        rows = level.where("open").withColumns({"bucket": F.floor(F.col("bucket") / fan).cast("long"), "buckets": fewer, "last": fewer == 1, "open": F.lit(False)})
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("fraction").cast("long")).alias("copies"), "row_hash", "n")


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents, each repeated as often as mix() takes it, with their own columns.

    A row finds its copies by doc_id and the hash of the whole row. Equal rows are first made one, which is repeated as
    often as all of them are taken.
    """
    plan = mix(docs, **params).groupBy("doc_id", "row_hash", "n").agg(F.sum("copies").alias("copies")).where("copies > 0")
    plan = cut(plan.select(F.col("doc_id").alias("mix_id"), F.col("row_hash").alias("mix_hash"), F.col("n").alias("mix_n"), F.col("copies").alias("mix_copies")), "plan")
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*own).alias("mix_row"), F.col("doc_id").cast("long").alias("mix_doc"), _row_hash(docs).alias("mix_own"))
    taken = (F.col("mix_doc").eqNullSafe(F.col("mix_id"))) & (F.col("mix_own") == F.col("mix_hash"))
    out = keyed.join(plan.where("mix_n = 1").hint("merge"), taken).select("mix_row", "mix_copies")
    if not plan.where("mix_n > 1").isEmpty():
        again = keyed.join(plan.where("mix_n > 1").hint("merge"), taken).groupBy("mix_id", "mix_hash", "mix_copies").agg(F.first("mix_row").alias("mix_row"))
        out = out.union(again.select("mix_row", "mix_copies"))
    return out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).select("mix_row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it, repeats counted."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
