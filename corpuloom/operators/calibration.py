"""Calibration analytics over judged atoms.

Inputs have columns model, condition, sample_id, gold, predicted, g, p, over, under
(see plans.views.levels). Everything is one aggregation per grain; statistics of samples are
second aggregations over sample rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["model", "condition"]


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def ratio(top: Column, bottom: Column) -> Column:
    """Null where the denominator is 0: a rate of an absent label is unknown, not 0."""
    return F.when(bottom > 0, top / bottom)


def harmonic(x: Column, y: Column) -> Column:
    return F.when(x + y > 0, 2 * x * y / (x + y)).otherwise(0.0)


def confusion(j: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """3 x 3 counts of gold by predicted labels, one row per cell that occurs."""
    return j.groupBy(*keys, "gold", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion_wide(j: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The nine cells of the confusion matrix as columns n_gp."""
    return j.groupBy(*keys).agg(*[count_if((F.col("g") == a) & (F.col("p") == b)).alias(f"n_{a}{b}") for a in range(3) for b in range(3)])


def directional(j: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Over- and under-use rates by label (macro over the labels present), pooled (micro), and harmonic resistance.

    Over-use is possible for A and B, under-use for B and C.
    """
    n = lambda g: count_if(F.col("g") == g)
    over = lambda g: ratio(count_if((F.col("g") == g) & (F.col("over") > 0)), n(g))
    under = lambda g: ratio(count_if((F.col("g") == g) & (F.col("under") > 0)), n(g))
    out = j.groupBy(*keys).agg(
        over(0).alias("over_a"), over(1).alias("over_b"), under(1).alias("under_b"), under(2).alias("under_c"),
        ratio(count_if(F.col("over") > 0), count_if(F.col("g") < 2)).alias("micro_opb"),
        ratio(count_if(F.col("under") > 0), count_if(F.col("g") > 0)).alias("micro_upb"),
    )
    macro = lambda a, b: (F.coalesce(F.col(a), F.lit(0.0)) + F.coalesce(F.col(b), F.lit(0.0))) / F.nullif(F.col(a).isNotNull().cast("int") + F.col(b).isNotNull().cast("int"), F.lit(0))
    out = out.withColumn("opb", macro("over_a", "over_b")).withColumn("upb", macro("under_b", "under_c"))
    out = out.withColumn("h", harmonic(1 - F.col("opb"), 1 - F.col("upb")))
    return out.withColumn("micro_h", harmonic(1 - F.col("micro_opb"), 1 - F.col("micro_upb")))


def condition_metrics(j: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Success by label, their macro mean, and the share of samples with all atoms right."""
    right = F.col("g") == F.col("p")
    per = j.groupBy(*keys, "sample_id").agg(F.min(right.cast("int")).alias("strict"), *[c.alias(n) for g in range(3) for c, n in ((count_if(F.col("g") == g), f"n{g}"), (count_if((F.col("g") == g) & right), f"k{g}"))])
    out = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("strict").cast("double")).alias("strict"), *[ratio(F.sum(f"k{g}"), F.sum(f"n{g}")).alias(f"success_{x}") for g, x in enumerate("abc")])
    return out.withColumn("macro", (F.col("success_a") + F.col("success_b") + F.col("success_c")) / 3)


def panel_rollup(j: DataFrame) -> DataFrame:
    """Accuracy by model, block and condition with subtotals over blocks; `all` marks a subtotal."""
    right = (F.col("g") == F.col("p")).cast("int")
    by = j.groupBy("model", "condition", F.col("block").cast("string").alias("panel")).agg(F.sum(right).alias("k"), F.count(F.lit(1)).alias("n"))
    # Subtotals are sums over the blocks' few rows: each goes to its own panel and to `all`.
    both = by.withColumn("panel", F.explode(F.array("panel", F.lit("all")))).groupBy("model", "condition", "panel").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    return both.withColumn("accuracy", F.col("k") / F.col("n"))


def paired_delta(j: DataFrame) -> DataFrame:
    """Mean success with memory less that without, by label, over the same atoms; contamination is the loss on A."""
    right = (F.col("g") == F.col("p")).cast("int")
    # Pairs share model, sample and atom, so one aggregation replaces the self join.
    pair = j.groupBy("model", "sample_id", "atom_id", "gold").agg(F.max(F.when(F.col("condition") == "full_memory", right)).alias("full"), F.max(F.when(F.col("condition") == "no_memory", right)).alias("none"))
    pair = pair.where("full is not null and none is not null")
    out = pair.groupBy("model", "gold").agg(F.count(F.lit(1)).alias("pairs"), F.avg((F.col("full") - F.col("none")).cast("double")).alias("delta"))
    return out.withColumn("contamination", F.when(F.col("gold") == "A", -F.col("delta")))


def mixed_blocks(j: DataFrame) -> DataFrame:
    """Of blocks whose atoms have different gold labels: how many have all atoms right."""
    right = (F.col("g") == F.col("p")).cast("int")
    block = j.groupBy("model", "condition", "sample_id", "block").agg(F.min(right).alias("strict"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi")
    return block.groupBy("model", "condition").agg(F.count(F.lit(1)).alias("mixed"), F.sum("strict").alias("right"), F.avg(F.col("strict").cast("double")).alias("accuracy"))


def sample_scores(j: DataFrame, rhos: tuple = (0.5, 0.8)) -> DataFrame:
    """Per sample: over, under and total budget, flags, and rho to the power of the budget."""
    out = j.groupBy("model", "condition", "sample_id").agg(F.count(F.lit(1)).alias("atoms"), F.sum("over").alias("over_budget"), F.sum("under").alias("under_budget"), F.max(F.greatest("over", "under")).alias("worst"))
    out = out.withColumn("budget", F.col("over_budget") + F.col("under_budget"))
    out = out.withColumn("any_over", (F.col("over_budget") > 0).cast("int")).withColumn("any_under", (F.col("under_budget") > 0).cast("int"))
    out = out.withColumn("exact", (F.col("budget") == 0).cast("int")).withColumn("severe", (F.col("worst") == 2).cast("int"))
    return out.withColumns({f"scs_{round(r * 100)}": F.pow(F.lit(r), F.col("budget").cast("double")) for r in rhos})


def headline(scores: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    out = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.avg("scs_50").alias("scs"), F.avg(F.col("any_over").cast("double")).alias("sopb"), F.avg(F.col("any_under").cast("double")).alias("supb"),
        F.avg(F.col("exact").cast("double")).alias("exact"), F.avg(F.col("severe").cast("double")).alias("severe"),
    )
    return out.withColumn("sh", harmonic(1 - F.col("sopb"), 1 - F.col("supb")))


def value_counts(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, value_, k_, before_, n_: how many rows have each value, how many have a smaller one, and all rows of the group.

    Order statistics follow from the counts, so no task sorts the rows of a group.
    """
    w = Window.partitionBy(*keys)
    counts = df.groupBy(*keys, F.col(column).alias("value_")).agg(F.count(F.lit(1)).alias("k_"))
    before = F.coalesce(F.sum("k_").over(w.orderBy("value_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("before_", before).withColumn("n_", F.sum("k_").over(w))


def nearest_rank(q: float) -> Column:
    """Of value_counts, the value if it is the nearest-rank quantile of its group: index round((n - 1) q), half to even."""
    at = F.bround((F.col("n_") - 1) * q).cast("long")
    return F.when((F.col("before_") <= at) & (at < F.col("before_") + F.col("k_")), F.col("value_"))


def score_summary(scores: DataFrame, column: str = "scs_50", keys: list[str] = KEYS, quantiles: tuple = (10, 50, 90)) -> DataFrame:
    """Mean, population deviation and nearest-rank quantiles of a score."""
    v = value_counts(scores, column, keys)
    mean = F.sum(F.col("value_") * F.col("k_")).over(Window.partitionBy(*keys)) / F.col("n_")
    v = v.withColumn("mean", mean)
    return v.groupBy(*keys).agg(
        F.first("n_").alias("n"), F.first("mean").alias("mean"), F.sqrt(F.sum(F.col("k_") * (F.col("value_") - F.col("mean")) ** 2) / F.first("n_")).alias("sd"),
        F.min("value_").alias("min"), F.max("value_").alias("max"), *[F.max(nearest_rank(q / 100)).alias(f"p{q}") for q in quantiles],
    )


def budget_distribution(scores: DataFrame) -> DataFrame:
    bucket = F.when(F.col("budget") >= 5, "5_plus").otherwise(F.col("budget").cast("string"))
    n = scores.groupBy("model", "condition", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("model", "condition")))


def tail_mean(df: DataFrame, column: str, alpha: float, keys: list[str]) -> DataFrame:
    """Mean of the worst ceil((1 - alpha) n) values, at least one. The product is taken in double on purpose: n = 20 at 0.95 gives 2."""
    v = value_counts(df, column, keys)
    take = F.greatest(F.lit(1), F.ceil((F.lit(1.0) - F.lit(alpha)) * F.col("n_")))
    # Of the rows with a value, those that are left after all larger values.
    own = F.greatest(F.lit(0), F.least(F.col("k_"), take - (F.col("n_") - F.col("before_") - F.col("k_"))))
    v = v.withColumn("own", own).where("own > 0")
    return v.groupBy(*keys).agg((F.sum(F.col("value_") * F.col("own")) / F.sum("own")).alias("cvar"), F.sum("own").alias("taken"))


def quantile_curve(df: DataFrame, column: str, keys: list[str], least: int = 70) -> DataFrame:
    """keys, pct, value: for each whole percentage of rank that occurs, from `least` on, the largest value at it."""
    v = value_counts(df, column, keys)
    pct = v.select(*keys, "n_").distinct().withColumn("pct", F.explode(F.sequence(F.lit(least), F.lit(100))))
    near = F.floor((F.col("pct") + 0.5) * F.col("n_") / 100)
    pct = pct.withColumn("rank", F.explode(F.array(near - 1, near, near + 1, F.col("n_")))).where((F.col("rank").between(1, F.col("n_"))) & (F.round(F.lit(100.0) * F.col("rank") / F.col("n_"), 0).cast("long") == F.col("pct")))
    last = pct.groupBy(*keys, "pct").agg(F.max("rank").alias("rank"))
    # A value holds a range of ranks; the groups' percentages are few.
    return v.join(F.broadcast(last), keys).where("rank > before_ and rank <= before_ + k_").select(*keys, F.col("pct").cast("long").alias("pct"), F.col("value_").alias(column))


def classification(wide: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Accuracy, balanced accuracy, macro precision and F1, MCC, kappas and ordinal errors from the nine cells."""
    c = lambda a, b: F.col(f"n_{a}{b}").cast("double")
    add = lambda xs: sum(xs[1:], xs[0])
    row = [add([c(a, b) for b in range(3)]) for a in range(3)]
    col = [add([c(a, b) for a in range(3)]) for b in range(3)]
    n = add(row)
    hit = add([c(a, a) for a in range(3)])
    recall = [F.when(row[a] > 0, c(a, a) / row[a]).otherwise(0.0) for a in range(3)]
    precision = [F.when(col[a] > 0, c(a, a) / col[a]).otherwise(0.0) for a in range(3)]
    f1 = [F.when(row[a] + col[a] > 0, 2 * c(a, a) / (row[a] + col[a])).otherwise(0.0) for a in range(3)]
    cross = add([row[a] * col[a] for a in range(3)])
    spread = F.sqrt(n * n - add([x * x for x in row])) * F.sqrt(n * n - add([x * x for x in col]))
    expected = cross / (n * n)

    def kappa(power: int) -> Column:
        seen = add([F.lit(float(abs(a - b) ** power)) * c(a, b) for a in range(3) for b in range(3) if a != b]) / n
        chance = add([F.lit(float(abs(a - b) ** power)) * row[a] * col[b] for a in range(3) for b in range(3) if a != b]) / (n * n)
        return F.when(chance > 0, 1 - seen / chance).otherwise(1.0)

    mae = add([F.lit(float(abs(a - b))) * c(a, b) for a in range(3) for b in range(3) if a != b]) / n
    mse = add([F.lit(float((a - b) ** 2)) * c(a, b) for a in range(3) for b in range(3) if a != b]) / n
    return wide.select(
        *keys, (hit / n).alias("accuracy"), (add(recall) / 3).alias("balanced"), (add(precision) / 3).alias("precision"), (add(f1) / 3).alias("macro_f1"),
        (add([f * r for f, r in zip(f1, row, strict=True)]) / n).alias("weighted_f1"), F.when(spread > 0, (hit * n - cross) / spread).otherwise(0.0).alias("mcc"),
        F.when(expected < 1, (hit / n - expected) / (1 - expected)).otherwise(1.0).alias("kappa"), kappa(1).alias("linear_kappa"), kappa(2).alias("quadratic_kappa"),
        mae.alias("mae"), F.sqrt(mse).alias("rmse"), ((c(0, 2) + c(2, 0)) / n).alias("severe"),
    )


def composites(d: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Ways to combine resistance to over-use x and under-use y into one number."""
    d = d.withColumn("x", 1 - F.col("opb")).withColumn("y", 1 - F.col("upb"))
    x, y = F.col("x"), F.col("y")
    power = lambda p: F.when((x > 0) & (y > 0), F.pow((F.pow(x, F.lit(float(p))) + F.pow(y, F.lit(float(p)))) / 2, F.lit(1.0 / p))).otherwise(0.0)
    return d.select(
        *keys, harmonic(x, y).alias("harmonic"), ((x + y) / 2).alias("arithmetic"), F.sqrt(x * y).alias("geometric"), (x * y).alias("product"), power(-2).alias("power_2"),
        power(-4).alias("power_4"), power(-8).alias("power_8"), F.least(x, y).alias("minimum"), (1 - F.sqrt((F.pow(1 - x, F.lit(2.0)) + F.pow(1 - y, F.lit(2.0))) / 2)).alias("ideal"),
    )


def utility(d: DataFrame, lam: float = 1.0) -> DataFrame:
    """Paired memory utility: under-use that memory takes away less lambda times the over-use that it brings."""
    at = lambda c, k: F.max(F.when(F.col("condition") == k, F.col(c)))
    out = d.groupBy("model").agg(at("opb", "full_memory").alias("of"), at("opb", "no_memory").alias("on_"), at("upb", "full_memory").alias("uf"), at("upb", "no_memory").alias("un"))
    return out.select("model", (F.col("un") - F.col("uf")).alias("reduced"), (F.col("of") - F.col("on_")).alias("induced"), (F.col("un") - F.col("uf") - lam * (F.col("of") - F.col("on_"))).alias("pmu"))


def spreads(d: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Min, max, range and population deviation of metrics across models, long form."""
    long = d.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])).alias("m")).select(*by, "m.*")
    return long.groupBy(*by, "metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), (F.max("value") - F.min("value")).alias("range"), F.stddev_pop("value").alias("sd"))


def ranks(d: DataFrame, columns: dict[str, bool], by: list[str]) -> DataFrame:
    """Rank of each model by metric (True: higher is better), ties by model."""
    long = d.select(*by, "model", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit(up).alias("up"), F.col(c).alias("value")) for c, up in columns.items()])).alias("m")).select(*by, "model", "m.*")
    order = Window.partitionBy(*by, "metric").orderBy(F.when(F.col("up"), -F.col("value")).otherwise(F.col("value")), "model")
    return long.withColumn("rank", F.row_number().over(order)).select(*by, "metric", "model", "value", "rank")


def pareto(d: DataFrame, cost: list[str], by: list[str]) -> DataFrame:
    """Models that no other one of the group dominates: at most as costly on all, less on one."""
    o = d.select(*[F.col(c).alias(f"o_{c}") for c in [*by, "model", *cost]])
    near = [F.col(b) == F.col(f"o_{b}") for b in by]
    no_worse = [F.col(f"o_{c}") <= F.col(c) for c in cost]
    better = F.lit(False)
    for c in cost:
        better = better | (F.col(f"o_{c}") < F.col(c))
    condition = better
    for x in [*near, *no_worse]:
        condition = condition & x
    return d.join(o, condition, "left_anti").select(*by, "model", *cost)


def agreement(a: DataFrame, b: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """Exact agreement, Cohen's kappa and linear kappa of two raters' ordinal levels p, by group."""
    return agreement_of(a.join(b.select(*on, F.col("p").alias("q")), on), by)


def agreement_of(both: DataFrame, by: list[str]) -> DataFrame:
    """As agreement(), of rows that hold both raters' levels p and q."""
    cells = both.groupBy(*by).agg(*[count_if((F.col("p") == x) & (F.col("q") == y)).alias(f"n_{x}{y}") for x in range(3) for y in range(3)], F.count(F.lit(1)).alias("n"))
    k = classification(cells, [*by, "n"])
    return k.select(*by, "n", F.col("accuracy").alias("agreement"), "kappa", "linear_kappa")


def wilson(df: DataFrame, k: str, n: str, z: float = 1.96) -> Column:
    """Lower bound of a rate."""
    p, m = F.col(k) / F.col(n), F.col(n).cast("double")
    return (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
