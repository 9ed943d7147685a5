"""Clusters, ranks and iterative statistics against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuloom.operators import calibration, clustering, latent, sampling
from corpuloom.plans import construction

D = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[a-z]+(?:'[a-z]+)?|[0-9]+(?:\.[0-9]+)?", (t or "").lower())


def signature(t, n=5, keep=10):
    w = words(t)
    return sorted({zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(max(1, len(w) - n + 1))})[:keep]


def greedy(items, threshold=0.88):
    """id -> representative of (id, quality, text), one after another from the best."""
    kept, out = [], {}
    for i, q, t in sorted(items, key=lambda x: (-x[1], x[0])):
        w, sig = words(t), set(signature(t))
        near = []
        for j, qj, tj in kept:
            v = words(tj)
            if len(sig & set(signature(tj))) >= 2 and min(len(w), len(v)) >= threshold * max(len(w), len(v)):
                if len(set(w) & set(v)) / max(1, len(set(w) | set(v))) >= threshold:
                    near.append((-qj, j))
        out[i] = min(near)[1] if near else i
        if not near:
            kept.append((i, q, t))
    return out


def test_an_item_goes_to_its_best_kept_neighbour(spark):
    items = spark.createDataFrame([(1, 9), (2, 8), (3, 7), (4, 1)], "id long, quality int")
    links = spark.createDataFrame([(1, 3, 0.90), (2, 3, 0.95)], "a long, b long, similarity double")
    got = {r.id: (r.kept, r.representative) for r in clustering.greedy_clusters(items, links).collect()}
    assert got == {1: (True, 1), 2: (True, 2), 3: (False, 1), 4: (True, 4)}


def test_near_duplicate_clusters_equal_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[" ".join(words(t))].append((i, len(t or ""), t))
    firsts = [min(g, key=lambda x: (-x[1], x[0])) for g in groups.values()]
    to = greedy(firsts)
    want = {i: to[f[0]] for g, f in zip(groups.values(), firsts, strict=True) for i, _, _ in g}
    members = Counter(want.values())
    got = construction.near_duplicate_clusters(spark, D).collect()
    assert {r.id: r.representative for r in got} == want and len(got) == len(rows)
    for r in got:
        assert r.members == members[r.representative] and r.kept == (r.id == r.representative)
        assert r.status == ("unique" if r.members == 1 else "representative" if r.kept else "duplicate")
        assert (r.cluster_id is None) == (r.members == 1)
    assert len({r.cluster_id for r in got} - {None}) == sum(n > 1 for n in members.values())


def test_candidates_equal_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").where("text is not null").collect()]
    sigs = {i: tuple(signature(t)) for i, t in rows}
    first = {}
    for i in sorted(sigs):
        first.setdefault(sigs[i], i)
    want = {(first[s], i, "copy") for i, s in sigs.items() if first[s] != i}
    reps = sorted((i, set(s)) for s, i in first.items())
    want |= {(a, b, "pair") for a, x in reps for b, y in reps if a < b and len(x & y) >= 2}
    got = construction.near_duplicate_candidates(spark, D).join(spark.createDataFrame([(i,) for i in sigs], "b long"), "b").select("a", "b", "kind").collect()
    assert {tuple(r) for r in got if r.a in sigs} == want


def test_bradley_terry_equals_a_plain_version(spark):
    rows = [("a", "b", 30, 10, 4), ("a", "c", 25, 12, 0), ("b", "c", 9, 20, 6)]
    got = {r.model: (r.ability, r.strength) for r in latent.bradley_terry(spark.createDataFrame(rows, "left_model string, right_model string, wins long, losses long, ties long")).collect()}
    wins = defaultdict(float)
    for x, y, w, lo, t in rows:
        wins[x, y], wins[y, x] = w + t / 2, lo + t / 2
    s = dict.fromkeys("abc", 1.0)
    for _ in range(5000):
        new = {m: sum(wins[m, o] for o in s if o != m) / sum((wins[m, o] + wins[o, m]) / (s[m] + s[o]) for o in s if o != m) for m in s}
        mean = math.exp(sum(map(math.log, new.values())) / 3)
        s = {m: x / mean for m, x in new.items()}
    assert all(abs(got[m][0] - math.log(s[m])) < 1e-9 and abs(got[m][1] - s[m]) < 1e-9 for m in s)
    assert abs(sum(a for a, _ in got.values())) < 1e-9


def test_rasch_equals_a_plain_version(spark):
    """One difficulty for each item, updated one after another; items without all answers are left out."""
    rng = np.random.default_rng(2)
    x = (rng.random((4, 60)) < np.array([0.3, 0.5, 0.6, 0.8])[:, None]).astype(int)
    rows = [(f"m{m}", i, int(x[m, i])) for m in range(4) for i in range(60)] + [("m0", 99, 1), ("m1", 99, 0)]
    got = {r.model: (r.theta, r.standard_error, r.items) for r in latent.rasch(spark.createDataFrame(rows, "model string, item long, success int"), ["item"]).collect()}
    theta, b = np.zeros(4), np.zeros(60)
    p = lambda a, d: 1 / (1 + np.exp(-np.clip(a - d, -20, 20)))
    for _ in range(500):
        old = theta.copy(), b.copy()
        for m in range(4):
            q = p(theta[m], b)
            theta[m] += ((x[m] - q).sum() - 1e-3 * theta[m]) / ((q * (1 - q)).sum() + 1e-3)
        for i in range(60):
            q = p(theta, b[i])
            b[i] += ((q - x[:, i]).sum() - 1e-3 * b[i]) / ((q * (1 - q)).sum() + 1e-3)
        shift = b.mean()
        b, theta = np.clip(b - shift, -8, 8), np.clip(theta - shift, -8, 8)
        if max(np.abs(theta - old[0]).max(), np.abs(b - old[1]).max()) < 1e-8:
            break
    theta -= theta.mean()
    for m in range(4):
        q = p(theta[m], b)
        assert abs(got[f"m{m}"][0] - theta[m]) < 1e-6 and abs(got[f"m{m}"][1] - 1 / math.sqrt((q * (1 - q)).sum() + 1e-3)) < 1e-6 and got[f"m{m}"][2] == 60


def test_sign_test_and_overlap_components(spark):
    assert latent.sign_test(0, 0) == 1.0 and abs(latent.sign_test(8, 2) - 2 * (1 + 10 + 45) / 1024) < 1e-12 and latent.sign_test(5, 5) == 1.0
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (10, 9)], "a long, b long")
    assert {r.id: r.component for r in latent.overlap_components(links).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9, 10: 9}


def test_spread_rank_equals_hash_rank(spark):
    df = spark.range(700).select("id", F.when(F.col("id") % 10 > 0, "hot").when(F.col("id") % 20 > 0, "cold").alias("s"))
    a = {r.id: r["rank"] for r in sampling.hash_rank(df, "x", "id", ["s"]).collect()}
    assert {r.id: r["rank"] for r in sampling.spread_rank(df, "x", "id", ["s"]).collect()} == a
    robin = sampling.round_robin(df, "x", "id", ["s"]).orderBy("position").collect()
    assert [r.position for r in robin] == list(range(1, 701))
    assert [(r["rank"], r.s or "") for r in robin] == sorted((r["rank"], r.s or "") for r in robin)


@pytest.mark.parametrize("n", [1, 2, 7, 40, 250])
def test_quantiles_from_counts(spark, n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 9, n)
    df = spark.createDataFrame([("k", int(v)) for v in x], "k string, v long")
    s = np.sort(x)
    got = calibration.score_summary(df, "v", ["k"], (10, 50, 90)).first()
    assert [got.p10, got.p50, got.p90] == [s[round((n - 1) * q)] for q in (0.1, 0.5, 0.9)]
    assert abs(got.mean - x.mean()) < 1e-9 and abs(got.sd - x.std()) < 1e-9
    take = max(1, math.ceil((1.0 - 0.9) * n))
    assert abs(calibration.tail_mean(df, "v", 0.9, ["k"]).first().cvar - s[::-1][:take].mean()) < 1e-9
    curve = {}
    for i, v in enumerate(s):
        curve[math.floor(100.0 * (i + 1) / n + 0.5)] = int(v)
    assert {r.pct: r.v for r in calibration.quantile_curve(df, "v", ["k"], 0).collect()} == curve


def plain_quota(total, weights, capacities):
    keys = sorted(k for k, c in capacities.items() if c > 0)
    total = min(total, sum(capacities.values()))
    w = {k: max(0.0, weights[k]) for k in keys}
    if sum(w.values()) <= 0:
        w = dict.fromkeys(keys, 1.0)
    raw = {k: total * w[k] / sum(w.values()) for k in keys}
    out = {k: min(capacities[k], math.floor(raw[k])) for k in keys}
    order = sorted(keys, key=lambda k: (math.floor(raw[k]) - raw[k], k))
    while sum(out.values()) < total:
        for k in order:
            if out[k] < capacities[k] and sum(out.values()) < total:
                out[k] += 1
    return out


def test_capacity_quota_equals_a_plain_version(spark):
    rng = np.random.default_rng(4)
    for total in (1, 7, 30, 200):
        cap = {f"k{i}": int(c) for i, c in enumerate(rng.integers(1, 20, 9))}
        weight = {k: float(rng.choice([0, 1, 2.5, 7])) for k in cap}
        for w in (weight, dict.fromkeys(cap, 0.0)):
            df = spark.createDataFrame([(k, c, w[k]) for k, c in cap.items()], "k string, n long, w double")
            assert {r.k: r.quota for r in sampling.capacity_quota(df, total, F.col("w"), ["k"]).collect()} == plain_quota(total, w, cap)


def test_candidates_of_unlike_lengths_do_not_meet(spark):
    passage = " ".join(f"shared{chr(97 + i)}" for i in range(20))
    texts = [(1, passage), (2, f"{passage} end"), (3, f"{passage} {' '.join('xyz'[i % 3] + chr(97 + i % 26) for i in range(60))}"), (4, None), (5, "")]
    sig = clustering.signatures(spark.createDataFrame(texts, "i long, t string"), "i", "t")
    got = {r.id: r for r in sig.collect()}
    assert got[1].sig == clustering.signature(passage.encode()) == sorted(signature(passage)) and (got[1].size, got[1].distinct, got[4].size, got[5].size) == (20, 20, None, 0)
    every = {tuple(r) for r in clustering.candidate_pairs(sig).collect()}
    assert {tuple(r) for r in clustering.candidate_pairs(sig, 0.88).collect()} == {(1, 2)} <= every
    assert [tuple(r)[:2] for r in clustering.similar_pairs(sig, spark.createDataFrame(texts, "id long, text string")).collect()] == [(1, 2)]
