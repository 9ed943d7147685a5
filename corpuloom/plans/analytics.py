"""Evaluation queries over the judged atoms of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuloom.operators import calibration as C
from corpuloom.operators import resampling as R
from corpuloom.plans.views import J, V_SAMPLES, atoms, judgments, level_of, levels, query, samples, v_judgments

KEY = "model, condition"
RATE = lambda top, bottom: f"count(*) FILTER ({top}) / nullif(count(*) FILTER ({bottom}), 0)"
_j = lambda spark, d: levels(judgments(spark, d))
_dealt = lambda spark, d: levels(judgments(spark, d, cells=atoms(spark, d).repartition("sample_id")))


@query(f"{J} SELECT model, condition, gold, predicted, count(*) AS n FROM v_judgments GROUP BY ALL")
def confusion_matrix(spark, d):
    return C.confusion(_j(spark, d))


_D = f"""d0 AS (SELECT model, condition, {RATE("g=0 AND over>0", "g=0")} AS over_a, {RATE("g=1 AND over>0", "g=1")} AS over_b, {RATE("g=1 AND under>0", "g=1")} AS under_b, {RATE("g=2 AND under>0", "g=2")} AS under_c,
  {RATE("over>0", "g<2")} AS micro_opb, {RATE("under>0", "g>0")} AS micro_upb FROM v_judgments GROUP BY ALL),
d1 AS (SELECT *, (coalesce(over_a,0)+coalesce(over_b,0)) / nullif((over_a IS NOT NULL)::INT + (over_b IS NOT NULL)::INT, 0) AS opb, (coalesce(under_b,0)+coalesce(under_c,0)) / nullif((under_b IS NOT NULL)::INT + (under_c IS NOT NULL)::INT, 0) AS upb FROM d0),
dir AS (SELECT *, CASE WHEN (1-opb)+(1-upb) > 0 THEN 2*(1-opb)*(1-upb)/((1-opb)+(1-upb)) ELSE 0 END AS h, CASE WHEN (1-micro_opb)+(1-micro_upb) > 0 THEN 2*(1-micro_opb)*(1-micro_upb)/((1-micro_opb)+(1-micro_upb)) ELSE 0 END AS micro_h FROM d1)"""


@query(f"{J}, {_D} SELECT * FROM dir")
def directional_rates(spark, d):
    return C.directional(_j(spark, d))


@query(f"""{J}, per AS (SELECT model, condition, sample_id, min((g=p)::INT) AS strict, {", ".join(f"count(*) FILTER (g={g}) AS n{g}, count(*) FILTER (g={g} AND p={g}) AS k{g}" for g in range(3))} FROM v_judgments GROUP BY ALL)
SELECT *, (success_a + success_b + success_c) / 3 AS macro FROM (SELECT model, condition, count(*) AS samples, avg(strict) AS strict, {", ".join(f"sum(k{g}) / nullif(sum(n{g}), 0) AS success_{x}" for g, x in enumerate("abc"))} FROM per GROUP BY ALL)""")
def condition_metrics(spark, d):
    return C.condition_metrics(_dealt(spark, d))


@query(f"""{J}, x AS (SELECT model, condition, coalesce(block::VARCHAR, 'all') AS panel, sum((g=p)::INT)::BIGINT AS k, count(*) AS n FROM v_judgments GROUP BY GROUPING SETS ((model, condition), (model, condition, block)))
SELECT *, k / n AS accuracy FROM x""")
def panel_rollup(spark, d):
    return C.panel_rollup(_j(spark, d))


@query(f"""{J}, x AS (SELECT a.model, a.gold, (a.g=a.p)::INT - (b.g=b.p)::INT AS diff FROM v_judgments a JOIN v_judgments b USING (model, sample_id, atom_id) WHERE a.condition='full_memory' AND b.condition='no_memory')
SELECT model, gold, count(*) AS pairs, avg(diff) AS delta, CASE WHEN gold='A' THEN -avg(diff) END AS contamination FROM x GROUP BY model, gold""")
def paired_delta(spark, d):
    return C.paired_delta(_j(spark, d))


@query(f"""{J}, b AS (SELECT model, condition, sample_id, block, min((g=p)::INT) AS strict FROM v_judgments GROUP BY ALL HAVING count(DISTINCT gold) > 1)
SELECT model, condition, count(*) AS mixed, sum(strict)::BIGINT AS right, avg(strict) AS accuracy FROM b GROUP BY ALL""")
def mixed_block_accuracy(spark, d):
    return C.mixed_blocks(_dealt(spark, d)).withColumn("right", F.col("right").cast("long"))


_S = """s0 AS (SELECT model, condition, sample_id, count(*) AS atoms, sum(over)::BIGINT AS over_budget, sum(under)::BIGINT AS under_budget, max(greatest(over, under)) AS worst FROM v_judgments GROUP BY ALL),
score AS (SELECT *, (over_budget>0)::INT AS any_over, (under_budget>0)::INT AS any_under, (budget=0)::INT AS exact, (worst=2)::INT AS severe, pow(0.5::DOUBLE, budget) AS scs_50, pow(0.8::DOUBLE, budget) AS scs_80
  FROM (SELECT *, over_budget + under_budget AS budget FROM s0))"""


@query(f"{J}, {_S} SELECT * FROM score")
def sample_scores(spark, d):
    return C.sample_scores(_j(spark, d))


_H = """SELECT {0}, count(*) AS samples, avg(scs_50) AS scs, avg(any_over) AS sopb, avg(any_under) AS supb, avg(exact) AS exact, avg(severe) AS severe,
  2*(1-avg(any_over))*(1-avg(any_under))/nullif((1-avg(any_over))+(1-avg(any_under)), 0) AS sh FROM {1} GROUP BY ALL"""


@query(f"{J}, {_S} SELECT * REPLACE (coalesce(sh, 0) AS sh) FROM ({_H.format(KEY, 'score')})")
def headline_metrics(spark, d):
    return C.headline(C.sample_scores(_j(spark, d)))


@query(f"{J}, {_S}, {V_SAMPLES} SELECT * REPLACE (coalesce(sh, 0) AS sh) FROM ({_H.format('model, condition, domain, difficulty', 'score JOIN v_samples USING (sample_id)')})")
def headline_breakdown(spark, d):
    scores = C.sample_scores(_j(spark, d)).join(samples(spark, d).select("sample_id", "domain", "difficulty"), "sample_id")
    return C.headline(scores, ["model", "condition", "domain", "difficulty"])


@query(f"""{J}, {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY model, condition ORDER BY scs_50) - 1 AS i, count(*) OVER (PARTITION BY model, condition) AS n FROM score)
SELECT model, condition, count(*) AS n, avg(scs_50) AS mean, stddev_pop(scs_50) AS sd, min(scs_50) AS min, max(scs_50) AS max, {", ".join(f"max(scs_50) FILTER (i = round_even((n-1)*{q / 100}::DOUBLE, 0)) AS p{q}" for q in (10, 50, 90))} FROM r GROUP BY ALL""")
def score_summary(spark, d):
    return C.score_summary(C.sample_scores(_j(spark, d)))


@query(f"""{J}, {_S}, b AS (SELECT model, condition, CASE WHEN budget >= 5 THEN '5_plus' ELSE budget::VARCHAR END AS bucket, count(*) AS n FROM score GROUP BY ALL)
SELECT *, n / sum(n) OVER (PARTITION BY model, condition) AS share FROM b""")
def budget_distribution(spark, d):
    return C.budget_distribution(C.sample_scores(_j(spark, d)))


@query(f"""{J}, {_S}, r AS (SELECT model, condition, budget, row_number() OVER (PARTITION BY model, condition ORDER BY budget DESC) AS i, greatest(1, ceil((1.0::DOUBLE - 0.9::DOUBLE) * count(*) OVER (PARTITION BY model, condition))) AS take FROM score)
SELECT model, condition, avg(budget) AS cvar, count(*) AS taken FROM r WHERE i <= take GROUP BY ALL""")
def tail_risk(spark, d):
    return C.tail_mean(C.sample_scores(_j(spark, d)), "budget", 0.9, C.KEYS)


@query(f"""{J}, {_S}, r AS (SELECT model, condition, budget, round(100.0 * row_number() OVER w / count(*) OVER (PARTITION BY model, condition), 0)::BIGINT AS pct FROM score WINDOW w AS (PARTITION BY model, condition ORDER BY budget))
SELECT model, condition, pct, max(budget) AS budget FROM r WHERE pct >= 70 GROUP BY ALL""")
def quantile_curve(spark, d):
    return C.quantile_curve(C.sample_scores(_j(spark, d)), "budget", C.KEYS)


_W = f"w AS (SELECT model, condition, count(*)::DOUBLE AS n, {', '.join(f'(count(*) FILTER (g={a} AND p={b}))::DOUBLE AS c{a}{b}' for a in range(3) for b in range(3))} FROM v_judgments GROUP BY ALL)"


def _classification_sql(source: str, keys: str) -> str:
    row = [f"(c{a}0+c{a}1+c{a}2)" for a in range(3)]
    col = [f"(c0{b}+c1{b}+c2{b})" for b in range(3)]
    total = "+".join
    weight = lambda power, cell: total(f"{abs(a - b) ** power}.0*{cell(a, b)}" for a in range(3) for b in range(3) if a != b)
    seen = lambda power: f"(({weight(power, lambda a, b: f'c{a}{b}')})/n)"
    chance = lambda power: f"(({weight(power, lambda a, b: f'{row[a]}*{col[b]}')})/(n*n))"
    f1 = [f"coalesce(2*c{a}{a}/nullif({row[a]}+{col[a]}, 0), 0)" for a in range(3)]
    cross = total(f"{row[a]}*{col[a]}" for a in range(3))
    spread = f"(sqrt(n*n-({total(f'{x}*{x}' for x in row)}))*sqrt(n*n-({total(f'{x}*{x}' for x in col)})))"
    return f"""SELECT {keys}, (c00+c11+c22)/n AS accuracy, ({total(f"coalesce(c{a}{a}/nullif({row[a]},0),0)" for a in range(3))})/3 AS balanced, ({total(f"coalesce(c{a}{a}/nullif({col[a]},0),0)" for a in range(3))})/3 AS precision,
  ({total(f1)})/3 AS macro_f1, ({total(f"{f}*{r}" for f, r in zip(f1, row, strict=True))})/n AS weighted_f1, coalesce(((c00+c11+c22)*n-({cross}))/nullif({spread},0), 0) AS mcc,
  coalesce(((c00+c11+c22)/n-({cross})/(n*n))/nullif(1-({cross})/(n*n),0), 1) AS kappa, coalesce(1-{seen(1)}/nullif({chance(1)},0),1) AS linear_kappa, coalesce(1-{seen(2)}/nullif({chance(2)},0),1) AS quadratic_kappa,
  {seen(1)} AS mae, sqrt({seen(2)}) AS rmse, (c02+c20)/n AS severe FROM {source}"""


@query(f"{J}, {_W} {_classification_sql('w', KEY)}")
def classification_metrics(spark, d):
    return C.classification(C.confusion_wide(_j(spark, d)))


def _power(p: int) -> str:
    return f"CASE WHEN x>0 AND y>0 THEN pow((pow(x,{p})+pow(y,{p}))/2, {1.0 / p}::DOUBLE) ELSE 0 END AS power_{-p}"


@query(f"""{J}, {_D}, xy AS (SELECT model, condition, 1-opb AS x, 1-upb AS y FROM dir)
SELECT model, condition, CASE WHEN x+y>0 THEN 2*x*y/(x+y) ELSE 0 END AS harmonic, (x+y)/2 AS arithmetic, sqrt(x*y) AS geometric, x*y AS product, {_power(-2)}, {_power(-4)}, {_power(-8)}, least(x,y) AS minimum, 1-sqrt((pow(1-x,2)+pow(1-y,2))/2) AS ideal FROM xy""")
def composite_metrics(spark, d):
    return C.composites(C.directional(_j(spark, d)))


@query(f"""{J}, {_D}, f AS (SELECT * FROM dir WHERE condition='full_memory'), n AS (SELECT * FROM dir WHERE condition='no_memory')
SELECT model, n.upb-f.upb AS reduced, f.opb-n.opb AS induced, n.upb-f.upb-(f.opb-n.opb) AS pmu FROM f JOIN n USING (model)""")
def paired_utility(spark, d):
    return C.utility(C.directional(_j(spark, d)))


_LONG = "long AS (SELECT model, condition, unnest(['opb','upb','h']) AS metric, unnest([opb,upb,h]) AS value FROM dir)"


@query(f"{J}, {_D}, {_LONG} SELECT condition, metric, min(value) AS lo, max(value) AS hi, max(value)-min(value) AS range, stddev_pop(value) AS sd FROM long GROUP BY ALL")
def metric_spreads(spark, d):
    return C.spreads(C.directional(_j(spark, d)), ["opb", "upb", "h"], ["condition"])


@query(f"{J}, {_D}, {_LONG} SELECT condition, metric, model, value, row_number() OVER (PARTITION BY condition, metric ORDER BY CASE WHEN metric='h' THEN -value ELSE value END, model) AS rank FROM long")
def metric_ranks(spark, d):
    return C.ranks(C.directional(_j(spark, d)), {"opb": False, "upb": False, "h": True}, ["condition"]).withColumn("rank", F.col("rank").cast("long"))


@query(f"""{J}, {_D} SELECT condition, model, opb, upb FROM dir a WHERE NOT EXISTS (SELECT 1 FROM dir b WHERE b.condition=a.condition AND b.opb<=a.opb AND b.upb<=a.upb AND (b.opb<a.opb OR b.upb<a.upb))""")
def pareto_front(spark, d):
    return C.pareto(C.directional(_j(spark, d)), ["opb", "upb"], ["condition"])


_BOTH = f"""both_ AS (SELECT a.model, a.gold, a.p, b.p AS q FROM v_judgments a JOIN v_second b USING (model, condition, sample_id, atom_id)),
w AS (SELECT model, gold, count(*)::DOUBLE AS n, {", ".join(f"(count(*) FILTER (p={a} AND q={b}))::DOUBLE AS c{a}{b}" for a in range(3) for b in range(3))} FROM both_ GROUP BY ALL)"""


@query(f"{J}, {v_judgments('v_second', 'second')}, {_BOTH}, k AS ({_classification_sql('w', 'model, gold, n')}) SELECT model, gold, n::BIGINT AS n, accuracy AS agreement, kappa, linear_kappa FROM k")
def judge_agreement(spark, d):
    # Both raters' labels come from one pass over the atoms.
    both = levels(judgments(spark, d, also="second"))
    return C.agreement_of(both.withColumn("q", level_of("also")), ["model", "gold"])


_Z = "1.96::DOUBLE"


@query(f"""{J}, r AS (SELECT model, gold, sum((g=p)::INT)::BIGINT AS k, count(*) AS n FROM v_judgments GROUP BY ALL),
l AS (SELECT *, ((k/n) + {_Z}*{_Z}/(2*n) - {_Z}*sqrt((k/n)*(1-k/n)/n + {_Z}*{_Z}/(4.0*n*n)))/(1+{_Z}*{_Z}/n) AS lower FROM r) SELECT *, ceil(1000/lower)::BIGINT AS needed FROM l""")
def wilson_admission(spark, d):
    r = _j(spark, d).groupBy("model", "gold").agg(F.sum((F.col("g") == F.col("p")).cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    return r.withColumn("lower", C.wilson(r, "k", "n")).withColumn("needed", F.ceil(1000 / F.col("lower")).cast("long"))


@query(f"""{J}, {v_judgments('v_second', 'second')}, {_D}, {_D.replace('d0', 'e0').replace('d1', 'e1').replace('dir AS', 'dir2 AS').replace('v_judgments', 'v_second')},
u AS (SELECT model, condition, opb, upb, h FROM dir UNION ALL SELECT model, condition, opb, upb, h FROM dir2)
SELECT model, condition, count(*) AS repeats, {", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_sd, min({m}) AS {m}_min, max({m}) AS {m}_max" for m in ("opb", "upb", "h"))} FROM u GROUP BY ALL""")
def repeat_aggregate(spark, d):
    parts = [C.directional(levels(judgments(spark, d, s))).select(*C.KEYS, "opb", "upb", "h") for s in ("", "second")]
    both = parts[0].union(parts[1])
    stats = [f(m).alias(f"{m}_{n}") for m in ("opb", "upb", "h") for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"), (F.min, "min"), (F.max, "max"))]
    return both.groupBy(*C.KEYS).agg(F.count(F.lit(1)).alias("repeats"), *stats)


@query(f"""{J}, {_S}, p AS (SELECT a.model AS left_model, b.model AS right_model, sign(a.budget-b.budget) AS s FROM score a JOIN score b USING (condition, sample_id) WHERE a.model < b.model AND condition='full_memory')
SELECT left_model, right_model, count(*) FILTER (s<0) AS wins, count(*) FILTER (s>0) AS losses, count(*) FILTER (s=0) AS ties FROM p GROUP BY ALL""")
def model_pairwise(spark, d):
    # A sample's few models are gathered in one row, so that the theta join stays within a sample.
    s = C.sample_scores(_j(spark, d)).where("condition = 'full_memory'").select("sample_id", "model", "budget")
    sets = s.groupBy("sample_id").agg(F.collect_list(F.struct("model", "budget")).alias("m"))
    pairs = sets.select("m", F.explode("m").alias("a")).select("a", F.explode("m").alias("b")).where("a.model < b.model")
    sign = F.col("a.budget") - F.col("b.budget")
    return pairs.groupBy(F.col("a.model").alias("left_model"), F.col("b.model").alias("right_model")).agg(
        C.count_if(sign < 0).alias("wins"), C.count_if(sign > 0).alias("losses"), C.count_if(sign == 0).alias("ties")
    )


def bradley_terry(spark, d):
    """Strengths by minorise-maximise on the pairwise table (models squared rows, so the driver iterates)."""
    from corpuloom.operators.latent import bradley_terry as fit

    return fit(model_pairwise(spark, d))


def rasch_ability(spark, d):
    """Abilities against over-use (atoms of A and B) and against under-use (B and C), with memory."""
    from corpuloom.operators.latent import rasch

    j = _j(spark, d).where("condition = 'full_memory'")
    over = j.where("g < 2").select("model", "sample_id", "atom_id", (F.col("over") == 0).cast("int").alias("success"))
    under = j.where("g > 0").select("model", "sample_id", "atom_id", (F.col("under") == 0).cast("int").alias("success"))
    item = ["sample_id", "atom_id"]
    return rasch(over, item).withColumn("direction", F.lit("over")).union(rasch(under, item).withColumn("direction", F.lit("under")))


def cluster_bootstrap(spark, d):
    """Accuracy by model and condition with its interval over resampled samples."""
    rows = _dealt(spark, d).select("model", "condition", "sample_id", (F.col("g") == F.col("p")).cast("long").alias("num"), F.lit(1).alias("den"))
    return R.bootstrap_ratio(rows, ["model", "condition"], "sample_id", {"accuracy": ("num", "den")}, names=atoms(spark, d)).drop("metric")


def directional_bootstrap(spark, d):
    """Pooled over-use and under-use rates by model and condition with their intervals over resampled samples."""
    flags = {"over_num": F.col("over") > 0, "over_den": F.col("g") < 2, "under_num": F.col("under") > 0, "under_den": F.col("g") > 0}
    rows = _dealt(spark, d).select("model", "condition", "sample_id", *[c.cast("long").alias(k) for k, c in flags.items()])
    return R.bootstrap_ratio(rows, ["model", "condition"], "sample_id", {m: (f"{m}_num", f"{m}_den") for m in ("over", "under")}, names=atoms(spark, d))


def headline_bootstrap(spark, d):
    """Mean sample score, and the shares of samples with over-use, with under-use and exact ones, with intervals over resampled samples."""
    s = C.sample_scores(_dealt(spark, d)).withColumn("one", F.lit(1))
    return R.bootstrap_ratio(s, ["model", "condition"], "sample_id", {"scs": ("scs_50", "one"), "sopb": ("any_over", "one"), "supb": ("any_under", "one"), "exact": ("exact", "one")}, names=atoms(spark, d))


def paired_delta_bootstrap(spark, d):
    """Accuracy with memory less that without, by model, over the same atoms, with an interval over resampled samples."""
    right = (F.col("g") == F.col("p")).cast("long")
    gain = F.when(F.col("condition") == "full_memory", right).otherwise(-right)
    per = _dealt(spark, d).groupBy("model", "sample_id").agg(F.sum(gain).alias("num"), (F.count(F.lit(1)) / 2).alias("den"))
    return R.bootstrap_ratio(per, ["model"], "sample_id", {"gain": ("num", "den")}, names=atoms(spark, d)).drop("metric")


def candidate_bootstrap(spark, d):
    """Twelve metrics of each model with their intervals over resampled samples."""
    return R.candidate_bootstrap(_dealt(spark, d))


def sign_tests(spark, d):
    """Two-sided sign test of each pair of models' sample budgets."""
    from corpuloom.operators.latent import sign_test

    rows = model_pairwise(spark, d).collect()  # models squared
    return spark.createDataFrame([(*r, sign_test(r.wins, r.losses)) for r in rows], "left_model string, right_model string, wins long, losses long, ties long, p_value double")


NO_SQL = {f.__name__: f for f in (bradley_terry, rasch_ability, cluster_bootstrap, directional_bootstrap, headline_bootstrap, paired_delta_bootstrap, candidate_bootstrap, sign_tests)}
