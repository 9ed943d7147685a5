"""Set operations on keyed tables: resolution of attempts, overlays, disjoint unions, complete cases, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_valid(attempts: DataFrame, key: str, valid: Column, order: str) -> DataFrame:
    """One row per key: the last valid attempt, or else the last one. One aggregation, no sort of the groups."""
    best = F.max_by(F.struct(*[c for c in attempts.columns if c != key]), F.struct(valid.cast("int").alias("v"), F.col(order).alias("o")))
    return attempts.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def reconcile(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every request or result key with its status: ok, missing or unexpected."""
    a = requests.select(key, F.lit(1).alias("asked")).distinct()
    b = results.select(key, F.lit(1).alias("got")).distinct()
    status = F.when(F.col("asked").isNull(), "unexpected").when(F.col("got").isNull(), "missing").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def pending(requests: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return requests.join(done.select(*on).distinct(), on, "left_anti")


def overlay(base: DataFrame, repaired: DataFrame, key: str) -> DataFrame:
    """Repaired rows replace the base's rows of their key; new keys are added."""
    return base.join(repaired.select(key), key, "left_anti").unionByName(repaired)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def disjoint_union(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of parts; raises if a key occurs twice."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    twice = duplicate_keys(out, [key]).limit(3).collect()
    if twice:
        raise ValueError(f"keys occur more than once: {[r[0] for r in twice]}")
    return out


def complete_cases(df: DataFrame, case: str, cell: list[str]) -> DataFrame:
    """Rows of the cases that every cell has."""
    cells = df.select(*cell).distinct().agg(F.count(F.lit(1)).alias("all_"))
    per = df.groupBy(case).agg(F.count_distinct(*cell).alias("has_")).join(F.broadcast(cells), F.col("has_") == F.col("all_"), "left_semi").select(case)
    return df.join(per, case, "left_semi")


def set_digest(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Per group the number of distinct keys and an order-free digest of them; equal sets give equal digests."""
    h = F.xxhash64(key)
    return df.select(*by, key).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("xor_"), F.sum(h.cast("decimal(38,0)")).alias("sum_"))


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """One row per key: the one of smallest order."""
    return df.withColumn("key_", key).groupBy("key_").agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("r")).select("r.*")


def richest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order, with the number of rows that it stands for."""
    w = Window.partitionBy(*key)
    return df.withColumn("copies", F.count(F.lit(1)).over(w)).withColumn("i_", F.row_number().over(w.orderBy(*order))).where("i_ = 1").drop("i_")


def _unique(df: DataFrame, key: str, what: str) -> DataFrame:
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").first()
    if twice:
        raise ValueError(f"{twice[key]!r} occurs {twice['n_']} times in {what}")
    return df


def bucket_merge(prior: DataFrame, retry: DataFrame, key: str) -> DataFrame:
    """Rows of earlier buckets whose key was not tried again, and all rows of the retry; `part` tells which. An id in two buckets of a run raises."""
    prior, retry = _unique(prior, key, "the earlier buckets"), _unique(retry, key, "the retry")
    left = prior.join(retry.select(key), key, "left_anti").withColumn("part", F.lit("prior"))
    return left.unionByName(retry.withColumn("part", F.lit("retry")))


def group_merge(baseline: DataFrame, groups: dict[str, DataFrame], key: str, same: list[str] | None = None) -> DataFrame:
    """The groups' rows with their channel, exactly one for each row of the baseline: an id in two groups, one that is missing and an extra one raise.

    Columns in `same` must be as in the baseline, nulls as nulls, or the id of a changed row is named.
    """
    every = None
    for channel, df in groups.items():
        own = df.withColumn("channel", F.lit(channel))
        every = own if every is None else every.unionByName(own)
    every = _unique(every, key, "the groups")
    ids = baseline.select(F.col(key).alias("base_"), *[F.col(c).alias(f"{c}_was_") for c in same or []])
    both = every.join(ids, F.col(key) == F.col("base_"), "full_outer")
    bad = both.where(F.col(key).isNull() | F.col("base_").isNull()).select(key, "base_").first()
    if bad:
        raise ValueError(f"{bad[key]!r} is extra" if bad["base_"] is None else f"{bad['base_']!r} is missing")
    changed = F.lit(False)
    for c in same or []:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"{c}_was_"))
    bad = both.where(changed).select(key).first() if same else None
    if bad:
        raise ValueError(f"{bad[key]!r} differs from the baseline")
    return both.select(*every.columns)


def replace_domain(base: DataFrame, new: DataFrame, key: str, domain: str, value: str) -> DataFrame:
    """base with the rows of one domain replaced, column by column, and `replaced`; the new rows' ids must be exactly the domain's."""
    new = _unique(new, key, "the new rows")
    of = F.coalesce(F.col(domain) == value, F.lit(False))
    fresh = new.select(F.col(key).alias("new_"), *[F.col(c).alias(f"{c}_new_") for c in base.columns if c != key])
    both = base.join(fresh, F.col(key) == F.col("new_"), "full_outer")
    wrong = both.where(F.col(key).isNull() | (of != F.col("new_").isNotNull())).select(key, "new_").first()
    if wrong:
        raise ValueError(f"the domain's ids and the new ones differ: {wrong['new_'] if wrong[key] is None else wrong[key]!r}")
    there = F.col("new_").isNotNull()
    return both.select(key, *[F.when(there, F.col(f"{c}_new_")).otherwise(F.col(c)).alias(c) for c in base.columns if c != key], there.alias("replaced"))


def candidate_merge(targets: DataFrame, valid: DataFrame, salvaged: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """key, channel, row of each target: a valid candidate, else the best salvaged one (fewest `penalty`, longest `length`, then `name`), else the baseline's.

    valid and baseline: key, row; salvaged: key, penalty, length, name, row. channel: validated, salvaged_<name>, baseline_fallback. A target that is nowhere raises.
    """
    order = F.struct("penalty", (-F.coalesce(F.col("length"), F.lit(0))).alias("l"), "name")
    best = salvaged.groupBy(key).agg(F.min_by(F.struct("name", "row"), order).alias("s_"))
    out = targets.select(key).join(_unique(valid, key, "the valid candidates").select(key, F.col("row").alias("v_"), F.lit(True).alias("is_v_")), key, "left").join(best, key, "left")
    out = out.join(_unique(baseline, key, "the baseline").select(key, F.col("row").alias("b_"), F.lit(True).alias("is_b_")), key, "left")
    none = out.where("is_v_ is null and s_ is null and is_b_ is null").first()
    if none:
        raise ValueError(f"{none[key]!r} is in no candidate source")
    channel = F.when(F.col("is_v_"), "validated").when(F.col("s_").isNotNull(), F.concat(F.lit("salvaged_"), "s_.name")).otherwise("baseline_fallback")
    return out.select(key, channel.alias("channel"), F.when(F.col("is_v_"), F.col("v_")).when(F.col("s_").isNotNull(), F.col("s_.row")).otherwise(F.col("b_")).alias("row"))
