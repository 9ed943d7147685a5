"""Pools, extensions, admission, judging and merging of records on the way to a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuloom.operators.calibration import wilson
from corpuloom.operators.sampling import spread_rank
from corpuloom.session import cut


def candidate_pool(rows: DataFrame, quotas: DataFrame, seed: str) -> DataFrame:
    """id, source, domain, part of each row chosen: `quota` rows of a source, as far as it has them, and for what its sources lack, other rows of the domain (`top_up`).

    rows: id (unique), source, domain (one for each source); quotas: source, quota. Rows come by hash. ValueError where a source
    with a quota has no rows, spans domains, or a domain can't make up for its sources.
    """
    kept = cut(rows.select("id", "source", "domain"), "pool")
    counts = kept.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("domains"), F.min("domain").alias("domain"))
    plan = cut(quotas.select("source", F.col("quota").cast("long").alias("quota")).join(counts, "source", "left"), "plan")
    bad = plan.where("n is null or domains <> 1").first()
    if bad:
        raise ValueError(f"source {bad['source']!r} " + ("has no rows" if bad["n"] is None else "has several domains"))
    ranked = spread_rank(kept, seed, "id", ["source"]).join(plan.select("source", "quota"), "source", "left")
    own = F.col("rank") <= F.coalesce("quota", F.lit(0))
    first = cut(ranked.withColumn("own", own).select("id", "source", "domain", "own"), "first")
    lack = plan.groupBy("domain").agg(F.sum(F.greatest(F.col("quota") - F.col("n"), F.lit(0))).alias("lack"))
    spare = spread_rank(first.where("not own"), f"{seed}+1", "id", ["domain"]).join(lack, "domain").where("rank <= lack")
    top_up = cut(spare.select("id", "source", "domain"), "top-up")
    short = lack.join(top_up.groupBy("domain").agg(F.count(F.lit(1)).alias("got")), "domain", "left").where("lack > coalesce(got, 0)").first()
    if short:
        raise ValueError(f"domain {short['domain']!r} is short by {short['lack'] - (short['got'] or 0)}")
    return first.where("own").select("id", "source", "domain", F.lit("quota").alias("part")).unionByName(top_up.withColumn("part", F.lit("top_up")))


def pool_extension(locked: DataFrame, candidates: DataFrame, each: int, seed: str) -> DataFrame:
    """id, source, key and rank of `each` new rows of every source, by hash, beside a locked pool: no id and no question (key) of it, and no question twice.

    locked: id, key; candidates: id, source, key, quality. Of candidates with one key the best stays, ties to the smaller id; null keys are a key.
    ValueError where a source has fewer rows left.
    """
    fresh = candidates.join(locked.select("id"), "id", "left_anti")
    taken = locked.select(F.col("key").alias("locked_key")).distinct()
    fresh = fresh.join(taken, fresh["key"].eqNullSafe(F.col("locked_key")), "left_anti")
    best = F.min_by(F.struct("id", "source"), F.struct((-F.coalesce(F.col("quality"), F.lit(0))).alias("q"), F.col("id").alias("i"))).alias("b")
    unique = cut(fresh.groupBy("key").agg(best).select("b.*", "key"), "fresh")
    short = candidates.select("source").distinct().join(unique.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "left").where(F.coalesce("n", F.lit(0)) < each).first()
    if short:
        raise ValueError(f"source {short['source']!r} has {short['n'] or 0} rows; {each} are asked for")
    return spread_rank(unique, seed, "id", ["source"]).where(F.col("rank") <= each).withColumn("rank", F.col("rank").cast("long"))


def admission_plan(states: DataFrame, final_target: int, successes: int, trials: int) -> DataFrame:
    """One row: target, status and counts of an adaptive admission: as many strict records as the final target needs at the lower bound of the success rate of a trial.

    states: state (strict_pass, review, reject). status: strict_sufficient, review_required, or candidate_topup_required.
    """
    counts = states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("strict_pass", "review", "reject")])
    one = counts.withColumns({"k_": F.lit(successes), "n_": F.lit(trials)})
    out = one.withColumn("lower", wilson(one, "k_", "n_")).withColumn("target", F.ceil(final_target / F.col("lower")).cast("long"))
    status = F.when(F.col("strict_pass") >= F.col("target"), "strict_sufficient").when(F.col("strict_pass") + F.col("review") >= F.col("target"), "review_required").otherwise("candidate_topup_required")
    return out.withColumn("status", status).drop("k_", "n_")


def admitted(records: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """id, decision and place of records under an admission plan: strict ones by hash up to the target, and, where they don't suffice, all under review in line for a second review."""
    ranked = spread_rank(records.where("state in ('strict_pass', 'review')").select("id", "state"), seed, "id", ["state"])
    limits = F.broadcast(plan.select("target", "status"))  # one row
    decision = F.when((F.col("state") == "strict_pass") & (F.col("rank") <= F.col("target")), "admitted_strict").when((F.col("state") == "review") & (F.col("status") != "strict_sufficient"), "pending_secondary_review")
    return ranked.join(limits).select("id", decision.alias("decision"), F.col("rank").cast("long").alias("place")).where("decision is not null")


def judge_requests(answers: DataFrame, samples: DataFrame, role: str, judge: str) -> DataFrame:
    """request_id, sample_id, model, condition, judge, payload (JSON) and expected (JSON of atom ids and labels) for each answer.

    answers: request_id, sample_id, model, condition, response; samples: sample_id, question, blocks (array of parent_memory_id, memory_text)
    and atoms (array of atom_id, parent_memory_id, text, u_star). Of atoms with one id the last label is expected. Answers without a sample are left out.
    """
    payload = F.to_json(F.struct(
        F.col("question").alias("current_query"), F.col("blocks").alias("model_facing_memory"), F.col("condition").alias("answer_condition"), F.col("response").alias("model_response"), F.col("atoms").alias("atomic_rubrics"),
    ), {"ignoreNullFields": "false"})
    last = lambda i: F.element_at(F.filter("atoms", lambda a: a["atom_id"] == i), -1)["u_star"]
    expected = F.to_json(F.map_from_entries(F.transform(F.array_distinct(F.transform("atoms", lambda a: a["atom_id"])), lambda i: F.struct(i, last(i)))))
    return answers.join(samples, "sample_id").select(
        F.concat_ws(":", F.lit("judge"), F.lit(role), "request_id").alias("request_id"), "sample_id", "model", "condition", F.lit(judge).alias("judge"), payload.alias("payload"), expected.alias("expected")
    )


def run_summary(judgments: DataFrame) -> DataFrame:
    """judge, n_rows, atoms, rows_with_warnings, rows_with_repairs, repairs, and warnings (kind and number, sorted) of each judge.

    judgments: answer_id, judge, atoms (a number), warnings (array of `kind:detail`), repairs (a number). ValueError where an answer is judged twice.
    """
    kept = cut(judgments, "run")
    twice = kept.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"answer {twice['answer_id']!r} is judged {twice['n']} times")
    judge = F.coalesce("judge", F.lit("unknown")).alias("judge")
    some = F.coalesce(F.size("warnings"), F.lit(0)) > 0
    repairs = F.coalesce(F.col("repairs"), F.lit(0))
    rows = kept.groupBy(judge).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("atoms").alias("atoms"), F.count_if(some).alias("rows_with_warnings"), F.count_if(repairs > 0).alias("rows_with_repairs"), F.sum(repairs).alias("repairs"))
    kinds = kept.select(judge, F.explode("warnings").alias("w")).groupBy("judge", F.substring_index("w", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    lists = kinds.groupBy("judge").agg(F.sort_array(F.collect_list(F.concat_ws("=", "kind", F.col("n").cast("string")))).alias("warnings"))  # kinds are few
    return rows.join(lists, "judge", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))


def adjudicated(records: DataFrame, one: DataFrame, two: DataFrame, approved: DataFrame) -> DataFrame:
    """id, fingerprint, mode of each record under two judges: consensus of both, a manual tie-break of one strict verdict where that is approved, or why it stands open.

    records: id, fingerprint, errors (number of deterministic errors); one, two: id, fingerprint, decision; approved: id. A judgment of another
    fingerprint than the record's doesn't count. Errors come first; then no_strict_verdict or unapproved_disagreement.
    """
    judged = lambda df, n: df.select(F.col("id").alias(f"id_{n}"), F.col("fingerprint").alias(f"print_{n}"), (F.col("decision") == "strict_pass").alias(f"strict_{n}"))
    out = records
    for n, df in (("a", one), ("b", two)):
        own = judged(df, n)
        out = out.join(own, (out["id"] == own[f"id_{n}"]) & (out["fingerprint"] == own[f"print_{n}"]), "left")
    out = out.join(approved.select(F.col("id").alias("id_ok")).distinct(), F.col("id") == F.col("id_ok"), "left")
    strict = sum((F.coalesce(F.col(f"strict_{n}"), F.lit(False)).cast("int") for n in "ab"), F.lit(0))
    mode = (
        F.when(F.col("errors") > 0, "deterministic_errors").when(strict == 2, "dual_judge_strict_consensus").when(strict == 0, "no_strict_verdict")
        .when(F.col("id_ok").isNotNull(), "manual_deterministic_tiebreak").otherwise("unapproved_disagreement")
    )
    return out.select("id", "fingerprint", mode.alias("mode"))


def merged_parents(blocks: Column, atoms: Column) -> Column:
    """Blocks of one parent as one, in the order of their first: texts joined, atoms appended, with labels, label_mode, u_star (the highest label) and merged, how many were joined on.

    blocks: array of parent_memory_id, memory_text, raw_evidence, atom_ids; atoms: array of atom_id, u_star. Null blocks are left out.
    """
    there = F.filter(blocks, lambda b: b.isNotNull())
    name = lambda b: F.coalesce(b["parent_memory_id"], F.lit(""))

    def one(parent):
        own = F.filter(there, lambda b: name(b) == parent)
        joined = lambda k: F.when(F.size(own) == 1, F.element_at(own, 1)[k]).otherwise(F.array_join(F.filter(F.transform(own, lambda b: F.trim(F.coalesce(b[k], F.lit("")))), lambda t: t != ""), " "))
        ids = F.flatten(F.transform(own, lambda b: F.coalesce(b["atom_ids"], F.array().cast("array<string>"))))
        labels = F.array_sort(F.array_distinct(F.transform(F.filter(atoms, lambda a: F.array_contains(ids, a["atom_id"])), lambda a: a["u_star"])))
        return F.struct(
            parent.alias("parent_memory_id"), joined("memory_text").alias("memory_text"), joined("raw_evidence").alias("raw_evidence"), ids.alias("atom_ids"), labels.alias("labels"),
            F.when(F.size(labels) > 1, "mixed").otherwise("homogeneous").alias("label_mode"), F.array_max(labels).alias("u_star"), (F.size(own) - 1).alias("merged"),
        )

    return F.transform(F.array_distinct(F.transform(there, name)), one)
