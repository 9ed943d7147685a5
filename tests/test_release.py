"""Pools, extensions, admission, judging and merging on small frames."""

import json

import pytest
from pyspark.sql import functions as F

from corpuloom.operators import release as L


def test_pool_tops_up_within_the_domain(spark):
    rows = spark.createDataFrame([(i, s, d) for s, d, ids in (("a", "x", range(3)), ("b", "x", range(10, 20)), ("c", "y", range(30, 40))) for i in ids], "id long, source string, domain string")
    quotas = lambda *q: spark.createDataFrame(list(q), "source string, quota long")
    got = L.candidate_pool(rows, quotas(("a", 5), ("b", 4), ("c", 2)), "s").collect()
    count = lambda **k: sum(all(r[c] == v for c, v in k.items()) for r in got)
    assert len({r.id for r in got}) == len(got) == 11
    assert (count(source="a"), count(source="b", part="quota"), count(source="b", part="top_up"), count(source="c")) == (3, 4, 2, 2)
    assert {r.id for r in L.candidate_pool(rows.repartition(7), quotas(("a", 5), ("b", 4), ("c", 2)), "s").collect()} == {r.id for r in got}
    with pytest.raises(ValueError, match="short by 8"):
        L.candidate_pool(rows, quotas(("a", 5), ("b", 16)), "s")
    with pytest.raises(ValueError, match="no rows"):
        L.candidate_pool(rows, quotas(("z", 1)), "s")
    with pytest.raises(ValueError, match="several domains"):
        L.candidate_pool(rows.withColumn("domain", F.col("id").cast("string")), quotas(("a", 1)), "s")


def test_extension_repeats_nothing_of_the_pool(spark):
    locked = spark.createDataFrame([(1, "k1"), (2, None)], "id long, key string")
    rows = [(1, "s", "new", 9), (3, "s", "k1", 9), (4, "s", "k4", 1), (5, "s", "k4", 2), (6, "s", None, 1), (7, "s", "k7", None), (8, "t", "k8", 1), (9, "t", "k9", 1)]
    candidates = spark.createDataFrame(rows, "id long, source string, key string, quality int")
    got = L.pool_extension(locked, candidates, 2, "e").collect()
    assert {r.id for r in got} == {5, 7, 8, 9} and sorted((r.source, r["rank"]) for r in got) == [("s", 1), ("s", 2), ("t", 1), ("t", 2)]
    with pytest.raises(ValueError, match="2 rows; 3"):
        L.pool_extension(locked, candidates, 3, "e")


@pytest.mark.parametrize(("strict", "review", "status"), [(30, 0, "strict_sufficient"), (10, 30, "review_required"), (10, 2, "candidate_topup_required")])
def test_admission_follows_the_trial(spark, strict, review, status):
    rows = spark.createDataFrame([(i, "strict_pass" if i < strict else "review" if i < strict + review else "reject") for i in range(50)], "id long, state string")
    plan = L.admission_plan(rows, 20, 95, 100)
    p = plan.first()
    assert p.status == status and p.target == 23 and (p.strict_pass, p.review, p.reject) == (strict, review, 50 - strict - review)
    got = L.admitted(rows, plan, "s").collect()
    assert sum(r.decision == "admitted_strict" for r in got) == min(23, strict) and sum(r.decision == "pending_secondary_review" for r in got) == (0 if status == "strict_sufficient" else review)


def test_judge_requests_hold_the_sample(spark):
    samples = spark.createDataFrame([(1, "q?", [("b", "text")], [("a1", "b", "x", "A"), ("a2", "b", "y", "C")])], "sample_id long, question string, blocks array<struct<parent_memory_id string, memory_text string>>, atoms array<struct<atom_id string, parent_memory_id string, text string, u_star string>>")
    answers = spark.createDataFrame([("r1", 1, "m", "full", "yes"), ("r2", 2, "m", "full", "yes"), ("r3", 1, "m", "none", None)], "request_id string, sample_id long, model string, condition string, response string")
    got = {r.request_id: r for r in L.judge_requests(answers, samples, "primary", "j").collect()}
    assert set(got) == {"judge:primary:r1", "judge:primary:r3"}
    payload = json.loads(got["judge:primary:r1"].payload)
    assert list(payload) == ["current_query", "model_facing_memory", "answer_condition", "model_response", "atomic_rubrics"] and payload["atomic_rubrics"][1]["u_star"] == "C"
    assert json.loads(got["judge:primary:r1"].expected) == {"a1": "A", "a2": "C"} and json.loads(got["judge:primary:r3"].payload)["model_response"] is None


def test_run_summary_counts_kinds(spark):
    rows = spark.createDataFrame([(1, "j", 3, ["late:x", "odd"], 0), (2, "j", 2, [], 2), (3, None, 1, None, None), (4, "j", 1, ["late:y"], 1)], "answer_id long, judge string, atoms long, warnings array<string>, repairs long")
    got = {r.judge: r for r in L.run_summary(rows).collect()}
    assert tuple(got["j"]) == ("j", 3, 6, 2, 2, 3, ["late=2", "odd=1"]) and tuple(got["unknown"]) == ("unknown", 1, 1, 0, 0, 0, [])
    with pytest.raises(ValueError, match="judged 2 times"):
        L.run_summary(rows.union(rows.limit(1)))


def test_adjudication_by_fingerprint(spark):
    records = spark.createDataFrame([(i, f"f{i}", int(i == 6)) for i in range(1, 7)], "id long, fingerprint string, errors int")
    judged = lambda *rows: spark.createDataFrame(list(rows), "id long, fingerprint string, decision string")
    one = judged((1, "f1", "strict_pass"), (2, "f2", "strict_pass"), (3, "f3", "strict_pass"), (4, "f4", "review"), (5, "old", "strict_pass"), (6, "f6", "strict_pass"))
    two = judged((1, "f1", "strict_pass"), (2, "f2", "reject"), (3, "f3", None), (5, "f5", "strict_pass"), (6, "f6", "strict_pass"))
    got = {r.id: r.mode for r in L.adjudicated(records, one, two, spark.createDataFrame([(2,), (2,), (4,)], "id long")).collect()}
    assert got == {1: "dual_judge_strict_consensus", 2: "manual_deterministic_tiebreak", 3: "unapproved_disagreement", 4: "no_strict_verdict", 5: "unapproved_disagreement", 6: "deterministic_errors"}


def test_parents_are_merged_in_order(spark):
    schema = "blocks array<struct<parent_memory_id string, memory_text string, raw_evidence string, atom_ids array<string>>>, atoms array<struct<atom_id string, u_star string>>"
    rows = [([("p", " one ", None, ["a"]), ("q", " alone ", "e", ["b"]), None, ("p", "two", "", ["c"]), ("p", None, "late", None)], [("a", "B"), ("b", "A"), ("c", "A")]), ([], []), (None, None)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(L.merged_parents(F.col("blocks"), F.col("atoms"))).collect()]
    p, q = got[0]
    assert tuple(p) == ("p", "one two", "late", ["a", "c"], ["A", "B"], "mixed", "B", 2) and tuple(q) == ("q", " alone ", "e", ["b"], ["A"], "homogeneous", "A", 0)
    assert got[1] == [] and got[2] is None


def test_merges_of_buckets_groups_domains_and_candidates(spark):
    from corpuloom.operators import merges as M

    rows = lambda *r: spark.createDataFrame(list(r), "id long, x string")
    got = M.bucket_merge(rows((1, "a"), (2, "b")), rows((2, "c"), (3, "d")), "id")
    assert sorted(map(tuple, got.collect())) == [(1, "a", "prior"), (2, "c", "retry"), (3, "d", "retry")]
    with pytest.raises(ValueError, match="2 times in the retry"):
        M.bucket_merge(rows((1, "a")), rows((2, "c"), (2, "d")), "id")
    base = rows((1, "a"), (2, None))
    assert sorted((r.id, r.channel) for r in M.group_merge(base, {"p": rows((1, "a")), "q": rows((2, None))}, "id", ["x"]).collect()) == [(1, "p"), (2, "q")]
    for groups, says in (({"p": rows((1, "a"))}, "2 is missing"), ({"p": rows((1, "a"), (2, None), (3, "z"))}, "3 is extra"), ({"p": rows((1, "a"), (2, "z"))}, "2 differs"), ({"p": rows((1, "a")), "q": rows((1, "a"), (2, None))}, "1 occurs 2 times")):
        with pytest.raises(ValueError, match=says):
            M.group_merge(base, groups, "id", ["x"])
    docs = spark.createDataFrame([(1, "k", "old"), (2, "o", "old"), (3, None, "old")], "id long, d string, t string")
    new = spark.createDataFrame([(1, "k", None)], "id long, d string, t string")
    assert sorted(map(tuple, M.replace_domain(docs, new, "id", "d", "k").collect())) == [(1, "k", None, True), (2, "o", "old", False), (3, None, "old", False)]
    for wrong in (new.withColumn("id", F.lit(9).cast("long")), new.limit(0), docs.where("id < 3")):
        with pytest.raises(ValueError):
            M.replace_domain(docs, wrong, "id", "d", "k")
    ids = spark.createDataFrame([(i,) for i in range(1, 5)], "id long")
    one = lambda *r: spark.createDataFrame(list(r), "id long, row string")
    salvaged = spark.createDataFrame([(1, 0, 9, "s", "no"), (2, 1, 9, "s", "no"), (2, 0, 3, "u", "no"), (2, 0, 5, "t", "yes"), (3, 0, None, "s", None)], "id long, penalty int, length int, name string, row string")
    got = {r.id: (r.channel, r.row) for r in M.candidate_merge(ids, one((1, "v")), salvaged, one((1, "b"), (4, "b")), "id").collect()}
    assert got == {1: ("validated", "v"), 2: ("salvaged_t", "yes"), 3: ("salvaged_s", None), 4: ("baseline_fallback", "b")}
    with pytest.raises(ValueError, match="4 is in no"):
        M.candidate_merge(ids, one((1, "v")), salvaged, one((1, "b")), "id").collect()
