"""Quotas and deterministic samples. Ranks are by stable hash within a stratum; quotas are window sums over the strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.session import cut


def hash_rank(df: DataFrame, seed: str, key: str, strata: list[str]) -> DataFrame:
    """rank of rows within their stratum, by SHA-256 of seed and key."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), key), 256)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key)))


def spread_rank(df: DataFrame, seed: str, key: str, strata: list[str], order: Column | None = None) -> DataFrame:
    """As hash_rank, for all ranks of strata of any size: rows are range partitioned, ranked within partitions, and what stands before a partition is added.

    `order` replaces the hash of seed and key. A stratum that holds most of the rows is spread over all tasks.
    """
    order = F.sha2(F.concat_ws(":", F.lit(seed), key), 256) if order is None else order
    dealt = cut(df.withColumn("order_", order).repartitionByRange(*strata, "order_", key).withColumn("part_", F.spark_partition_id()), "ranks")
    counts = dealt.groupBy(*strata, "part_").agg(F.count(F.lit(1)).alias("many_"))
    before = F.coalesce(F.sum("many_").over(Window.partitionBy(*strata).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(c).alias(f"{c}_of") for c in strata], F.col("part_").alias("part_of"), before.alias("offset_"))
    inside = F.row_number().over(Window.partitionBy(*strata, "part_").orderBy("order_", key))
    same = F.col("part_") == F.col("part_of")
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    out = dealt.withColumn("inside_", inside).join(offsets, same)
    return out.withColumn("rank", (F.col("inside_") + F.col("offset_")).cast("int")).select(*df.columns, "rank")


def stratified(df: DataFrame, seed: str, key: str, strata: list[str], each: int) -> DataFrame:
    return hash_rank(df, seed, key, strata).where(F.col("rank") <= each)


def largest_remainder(counts: DataFrame, total: int, key: list[str], n: str = "n") -> DataFrame:
    """counts with quota: shares of `total` in proportion to n, rounded down, the rest one each by larger fraction, then key.

    Fractions are compared as integer remainders, so no rounding error can break a tie wrongly.
    """
    every = Window.partitionBy(F.lit(0))
    whole = F.sum(n).over(every)
    df = counts.withColumn("sum_", whole).withColumn("floor_", F.expr(f"({total} * {n}) div sum_")).withColumn("rest_", F.expr(f"({total} * {n}) % sum_"))
    place = F.row_number().over(every.orderBy(F.desc("rest_"), *key))
    left = F.lit(total) - F.sum("floor_").over(every)
    df = df.withColumn("place_", place).withColumn("left_", left)
    return df.withColumn("quota", (F.col("floor_") + (F.col("place_") <= F.col("left_")).cast("long")).cast("long")).drop("sum_", "floor_", "rest_", "place_", "left_")


def proportional_sample(df: DataFrame, seed: str, key: str, strata: list[str], total: int) -> DataFrame:
    """`total` rows, by largest remainder over the strata and by hash within them."""
    quotas = largest_remainder(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n")), total, strata).select(*strata, "quota")
    return spread_rank(df, seed, key, strata).join(quotas, strata).where(F.col("rank") <= F.col("quota")).drop("quota")


def capped_equal_quota(counts: DataFrame, total: int | str, key: list, n: str = "n") -> DataFrame:
    """quota: equal shares of `total` (a number, or a column that is the same in all rows), none above n; what small groups leave goes to the others, single rows by key order.

    By size, a group is exhausted if its n is at most the equal share of what is left for it and
    the larger ones; running sums give the level at which the others are filled.
    """
    every = Window.partitionBy(F.lit(0))
    order = every.orderBy(n, *key)
    df = counts.withColumn("i_", F.row_number().over(order)).withColumn("k_", F.count(F.lit(1)).over(every))
    before = F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("before_", before).withColumn("full_", F.col(n) * (F.col("k_") - F.col("i_") + 1) <= F.expr(str(total)) - F.col("before_"))
    # Once a group is not exhausted, no larger one is.
    df = df.withColumn("open_", F.min(F.when(~F.col("full_"), F.col("i_"))).over(every))
    df = df.withColumn("base_", F.max(F.when(F.col("i_") == F.col("open_"), F.expr(f"({total} - before_) div (k_ - i_ + 1)"))).over(every))
    df = df.withColumn("odd_", F.max(F.when(F.col("i_") == F.col("open_"), F.expr(f"({total} - before_) % (k_ - i_ + 1)"))).over(every))
    rest = F.row_number().over(every.orderBy(F.coalesce(F.col("i_") < F.col("open_"), F.lit(True)), *key))
    quota = F.when(F.col("open_").isNull() | (F.col("i_") < F.col("open_")), F.col(n)).otherwise(F.col("base_") + (rest <= F.col("odd_")).cast("long"))
    return df.withColumn("quota", quota.cast("long")).drop("i_", "k_", "before_", "full_", "open_", "base_", "odd_")


def weighted_priority(seed: str, key: str, quality: Column, beta: float) -> Column:
    """-ln(u) / exp(beta q) with u in (0, 1] from a stable hash: the smallest priorities are a sample weighted by exp(beta q)."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), key), 256), 1, 13), 16, 10).cast("double")
    return -F.log((h + 1) / float(1 << 52)) / F.exp(beta * quality)


def round_robin(df: DataFrame, seed: str, key: str, strata: list[str]) -> DataFrame:
    """rank and position: the i-th row of every stratum comes before the (i + 1)-th of any."""
    ranked = spread_rank(df, seed, key, strata)
    # A row's position follows from the strata's sizes: all rows of smaller ranks, and the strata before its own that are as large.
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_"))
    sizes = sizes.withColumn("place_", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*strata)))
    every = sizes.agg(F.collect_list(F.struct("place_", "n_")).alias("sizes_"))  # strata are labels
    same = F.lit(True)
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    own = sizes.select(*[F.col(c).alias(f"{c}_of") for c in strata], "place_")
    out = ranked.join(F.broadcast(own), same).join(F.broadcast(every))
    count = lambda x: F.least(x["n_"], F.col("rank") - 1) + ((x["place_"] <= F.col("place_")) & (x["n_"] >= F.col("rank"))).cast("long")
    position = F.aggregate("sizes_", F.lit(0).cast("long"), lambda total, x: total + count(x))
    return out.withColumn("position", position).select(*df.columns, "rank", "position")


def split_by_share(df: DataFrame, seed: str, key: str, strata: list[str], shares: dict[str, float]) -> DataFrame:
    """split: rows of each stratum in hash order, cut at rounded cumulative shares."""
    ranked = spread_rank(df, seed, key, strata).join(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_")), strata)
    out, upto, names = None, 0.0, list(shares)
    for name in names[:-1]:
        upto += shares[name]
        hit = F.col("rank") <= F.floor(F.col("n_") * upto + 0.5)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return ranked.withColumn("split", out.otherwise(names[-1])).drop("n_")


def capacity_quota(counts: DataFrame, total: int, weight: Column, key: list[str], n: str = "n") -> DataFrame:
    """quota: shares of `total` (of all rows, if those are fewer) by weight, rounded down, none above n; what is left goes round, one each, by larger fraction, then key, to groups that still have rows.

    Groups with no weight at all share equally. Going round is an equal quota of the spare rows.
    """
    every = Window.partitionBy(F.lit(0))
    df = counts.withColumn("w_", F.greatest(weight, F.lit(0.0))).withColumn("w_", F.when(F.sum("w_").over(every) > 0, F.col("w_")).otherwise(1.0))
    df = df.withColumn("raw_", F.least(F.lit(total), F.sum(n).over(every)) * F.col("w_") / F.sum("w_").over(every))
    df = df.withColumn("floor_", F.least(F.col(n), F.floor("raw_"))).withColumn("spare_", F.col(n) - F.col("floor_"))
    df = df.withColumn("rest_", F.least(F.lit(total), F.sum(n).over(every)) - F.sum("floor_").over(every))
    df = df.withColumn("order_", F.floor("raw_") - F.col("raw_"))
    more = capped_equal_quota(df, "rest_", ["order_", *key], "spare_")
    return more.withColumn("quota", (F.col("floor_") + F.col("quota")).cast("long")).drop("w_", "raw_", "floor_", "spare_", "rest_", "order_")


def ordered_place(df: DataFrame, order: list[str]) -> DataFrame:
    """df with place, its number from 1 in the order of columns, by range partitions whose rows are added up."""
    dealt = cut(df.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()), "places")
    before = F.coalesce(F.sum("many_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("many_")).select("part_", before.alias("offset_"))  # one row for each partition
    inside = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return dealt.withColumn("inside_", inside).join(F.broadcast(offsets), "part_").withColumn("place", F.col("inside_") + F.col("offset_")).select("place", *df.columns)
