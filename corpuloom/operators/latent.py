"""Iterative statistics. What reaches the driver is bounded by the number of models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuloom.session import cut


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial probability that wins and losses are this uneven."""
    n, k = wins + losses, min(wins, losses)
    if not n:
        return 1.0
    # Logarithms keep large samples from overflowing.
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


#: Fixed values of the published estimators: rounds and tolerance of the pairwise fit; rounds, tolerance, ridge and clips of the Rasch fit.
PAIR_ROUNDS, PAIR_TOLERANCE = 10_000, 1e-12
RASCH_ROUNDS, RASCH_TOLERANCE, RASCH_RIDGE, RASCH_CLIP, RASCH_ETA = 500, 1e-8, 1e-3, 8.0, 20.0


def bradley_terry(pairs: DataFrame, rounds: int = PAIR_ROUNDS, tol: float = PAIR_TOLERANCE) -> DataFrame:
    """model, ability (mean 0) and strength (its exponential) from left_model, right_model, wins, losses, ties (half a win each)."""
    rows = pairs.collect()  # models squared
    models = sorted({r.left_model for r in rows} | {r.right_model for r in rows})
    at = {m: i for i, m in enumerate(models)}
    win = np.zeros((len(models), len(models)))
    for r in rows:
        win[at[r.left_model], at[r.right_model]] += r.wins + r.ties / 2
        win[at[r.right_model], at[r.left_model]] += r.losses + r.ties / 2
    n, s = win + win.T, np.ones(len(models))
    for _ in range(rounds):
        weight = (n / (s[:, None] + s[None, :])).sum(axis=1)
        new = np.where(weight > 0, win.sum(axis=1) / np.where(weight > 0, weight, 1), 1.0)
        new = np.maximum(new, 1e-300)
        new /= math.exp(np.log(new).mean())
        done = np.abs(np.log(new) - np.log(s)).max(initial=0) < tol
        s = new
        if done:
            break
    a = np.log(s) - np.log(s).mean() if len(s) else s
    return pairs.sparkSession.createDataFrame([(m, float(x), math.exp(x)) for m, x in zip(models, a, strict=True)], "model string, ability double, strength double")


def rasch(outcomes: DataFrame, item: list[str], rounds: int = RASCH_ROUNDS, ridge: float = RASCH_RIDGE, clip: float = RASCH_CLIP, tol: float = RASCH_TOLERANCE) -> DataFrame:
    """model, theta (mean 0), standard_error, items of a one-parameter logistic model by alternating Newton steps on outcomes (model, the columns of an item, success 0/1).

    Only items that every model has answered count. Items with as many successes share their difficulty in every
    step, so the fit runs on counts by (model, successes of the item), whose number does not grow with the items.
    """
    models = sorted(r.model for r in outcomes.select("model").distinct().collect())
    per = outcomes.groupBy(*item).agg(F.count(F.lit(1)).alias("answers"), *[F.max(F.when(F.col("model") == m, F.col("success"))).alias(f"m{i}") for i, m in enumerate(models)])
    full = per.where(F.col("answers") == len(models)).dropna() if models else per
    score = sum((F.col(f"m{i}") for i in range(len(models))), F.lit(0))
    rows = full.groupBy(score.alias("score")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"m{i}").alias(f"k{i}") for i in range(len(models))]).collect()
    rows = sorted(rows, key=lambda r: r.score)
    n, score = np.array([r.n for r in rows], float), np.array([r.score for r in rows], float)
    k = np.array([sum(r[f"k{i}"] for r in rows) for i in range(len(models))], float)
    theta, b = np.zeros(len(models)), np.zeros(len(rows))
    chance = lambda: 1 / (1 + np.exp(-np.clip(theta[:, None] - b[None, :], -RASCH_ETA, RASCH_ETA)))
    for _ in range(rounds if rows else 0):
        was = theta.copy(), b.copy()
        p = chance()
        theta = theta + (k - p @ n - ridge * theta) / ((p * (1 - p)) @ n + ridge)
        p = chance()
        b = b + (p.sum(axis=0) - score - ridge * b) / ((p * (1 - p)).sum(axis=0) + ridge)
        shift = (b @ n) / n.sum()
        b, theta = np.clip(b - shift, -clip, clip), np.clip(theta - shift, -clip, clip)
        if max(np.abs(theta - was[0]).max(initial=0), np.abs(b - was[1]).max(initial=0)) < tol:
            break
    theta = theta - theta.mean() if len(models) else theta
    p = chance()
    error = 1 / np.sqrt((p * (1 - p)) @ n + ridge)
    out = [(m, float(t), float(e), int(n.sum())) for m, t, e in zip(models, theta, error, strict=True)]
    return outcomes.sparkSession.createDataFrame(out, "model string, theta double, standard_error double, items long")


def overlap_components(pairs: DataFrame) -> DataFrame:
    """id, component of records' overlapping items: links a, b within a record; label propagation with pointer jumping."""
    both = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "overlaps")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "overlaps")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        own = labels.join(near, "id").select("id", F.least("component", "c").alias("c"), F.col("component").alias("was"))
        up = labels.select(F.col("id").alias("c"), F.col("component").alias("up"))
        labels = cut(own.join(up, "c").select("id", F.least("c", "up").alias("component"), "was"), "overlaps")
        if labels.where("component <> was").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")

