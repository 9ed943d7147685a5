"""Greedy selections against plain versions that look at every row for every pick."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuloom.operators import subsets as U

LABELS, TYPES = ["n_a", "n_b"], ["t0", "t1", "t2"]
SCHEMA = "id long, source string, topic string, complexity string, n_a long, n_b long, t0 long, t1 long, t2 long, mixed boolean, safety boolean, atoms long, large long, place_ int"


def hashed(seed, i):
    return hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [
        (i, rng.choice("xyz"), rng.choice(["p", "q", "r"]), rng.choice(["s", "m"]), rng.randint(0, 3), rng.randint(0, 3), rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 2), rng.random() < 0.3, rng.random() < 0.1, rng.randint(1, 9), rng.randint(0, 1), 0)
        for i in range(300)
    ]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain_cells(counts, margins):
    names, quota = list(margins), Counter()
    left = {c: dict(m) for c, m in margins.items()}
    for _ in range(sum(margins[names[0]].values())):
        best = max(
            (
                (sum(left[c][v] / margins[c][v] for c, v in zip(names, cell)) + min(n - quota[cell], 1000) / 1e6, cell[::-1], cell)
                for cell, n in counts.items()
                if quota[cell] < n and all(left[c].get(v, 0) > 0 for c, v in zip(names, cell))
            ),
            default=None,
        )
        if best is None:
            raise ValueError
        quota[best[2]] += 1
        for c, v in zip(names, best[2]):
            left[c][v] -= 1
    return quota


MARGINS = {"source": {"x": 10, "y": 6, "z": 4}, "topic": {"p": 7, "q": 7, "r": 6}, "complexity": {"s": 13, "m": 7}}


def test_cell_quotas_meet_every_margin(frame, rows):
    got = U.cell_quotas(frame, MARGINS).collect()
    want = plain_cells(Counter(r[1:4] for r in rows), MARGINS)
    assert {(r.source, r.topic, r.complexity): r.quota for r in got if r.quota} == dict(want)
    for c, m in MARGINS.items():
        for v, t in m.items():
            assert sum(r.quota for r in got if r[c] == v) == t


def test_margins_that_cannot_be_met(frame):
    with pytest.raises(ValueError, match="same sum"):
        U.cell_quotas(frame, {"source": {"x": 1}, "topic": {"p": 2}})
    with pytest.raises(ValueError, match="can't be met"):
        U.cell_quotas(frame, {"source": {"x": 400}, "topic": {"p": 400}})
    with pytest.raises(ValueError, match="can't be met"):
        U.cell_quotas(frame.limit(0), MARGINS)


def plain_representative(rows, quota, seed):
    at = {c: i for i, c in enumerate(x.split()[0] for x in SCHEMA.split(", "))}
    goal = [[sum(r[at[c]] for r in rows) / sum(r[at[x]] for r in rows for x in g) for c in g] for g in (LABELS, TYPES)]
    share = sum(r[at["mixed"]] for r in rows) / len(rows)
    out, have, flag = [], [[0] * len(LABELS), [0] * len(TYPES)], 0

    def loss(r):
        total = 0
        for g, h, t in zip((LABELS, TYPES), have, goal):
            whole = sum(h) + sum(r[at[c]] for c in g) or 1
            total += sum(abs((x + r[at[c]]) / whole - y) for c, x, y in zip(g, h, t))
        return total + abs((flag + r[at["mixed"]]) / (len(out) + 1) - share)

    for cell in sorted(quota):
        for _ in range(quota[cell]):
            best = min((r for r in rows if r[1:4] == cell and r[0] not in out), key=lambda r: (loss(r), hashed(seed, r[0])))
            out.append(best[0])
            for g, h in zip((LABELS, TYPES), have):
                for i, c in enumerate(g):
                    h[i] += best[at[c]]
            flag += best[at["mixed"]]
    return out


@pytest.mark.parametrize("held", [U.HELD, 0])
def test_representative_equals_a_plain_greedy(frame, rows, held):
    quota = dict(plain_cells(Counter(r[1:4] for r in rows), MARGINS))
    got = U.representative(frame.repartition(5), quota, ["source", "topic", "complexity"], [LABELS, TYPES], "mixed", 7, held=held).collect()
    want = plain_representative(rows, quota, 7)
    assert [r.id for r in sorted(got, key=lambda r: r.pick)] == want
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == sorted(want, key=lambda i: hashed(7, i))


def plain_diagnostic(rows, sources, minima, threshold, seed):
    out, count, topics, n = [], Counter(), Counter(), Counter()
    for _ in range(sum(sources.values())):

        def gain(r):
            _, source, topic, *_, mixed, safety, atoms, large, _ = r
            big = atoms >= threshold
            v = 8.0 * (topics[topic] < minima["topic"]) + 4.0 * (mixed and n["mixed"] < minima["mixed"]) + 3.0 * (large > 0 and n["large"] < minima["any_rare"])
            v = v + 7.0 * (large > 0 and n["large"] < minima["each_rare"]) + 5.0 * (safety and n["safety"] < minima["safety"]) + 3.0 * (big and n["big"] < minima["many_atoms"])
            return v + (0.25 * mixed + 0.1 * big) + (sources[source] - count[source]) / sources[source]

        r = max((r for r in rows if r[0] not in out and count[r[1]] < sources.get(r[1], 0)), key=lambda r: (gain(r), hashed(seed, r[0])))
        out.append(r[0])
        count[r[1]] += 1
        topics[r[2]] += 1
        n.update({"mixed": r[9], "safety": r[10], "big": r[11] >= threshold, "large": r[12] > 0})
    return out


@pytest.mark.parametrize("held", [U.HELD, 0])
def test_diagnostic_selection_meets_its_minima(frame, rows, held):
    sources, minima = {"x": 10, "y": 10, "z": 4}, {"topic": 5, "mixed": 9, "each_rare": 8, "any_rare": 8, "safety": 4, "many_atoms": 8}
    got = U.diagnostic(frame, sources, ["large"], minima, None, 5, held=held).collect()
    threshold = sorted(r[11] for r in rows)[-(-3 * len(rows) // 4) - 1]
    assert [r.id for r in sorted(got, key=lambda r: r.pick)] == plain_diagnostic(rows, sources, minima, threshold, 5)
    assert Counter(r.source for r in got) == sources and min(Counter(r.topic for r in got).values()) >= 5 and sum(r.safety for r in got) >= 4 and sum(r.mixed for r in got) >= 9
    with pytest.raises(ValueError, match="safety"):
        U.diagnostic(frame, sources, ["large"], minima | {"safety": 300}, None, 5, held=held)
    with pytest.raises(ValueError, match="fewer rows"):
        U.diagnostic(frame, {"x": 10_000}, ["large"], minima, None, 5, held=held)


@pytest.mark.parametrize("held", [U.HELD, 0])
def test_coverage_equals_a_plain_greedy(spark, held):
    rng = random.Random(8)
    data = [(i, [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 4))] or None, rng.randint(0, 2)) for i in range(80)] + [(90, ["a", None, "a"], None)]
    covered, out = set(), []
    for _ in range(12):
        i, f, _ = max((r for r in data if r[0] not in [x[0] for x in out]), key=lambda r: (len({x for x in r[1] or [] if x} - covered), r[2] or 0, -r[0]))
        out.append((i, len({x for x in f or [] if x} - covered)))
        covered |= {x for x in f or [] if x}
    got = U.coverage(spark.createDataFrame(data, "id long, fs array<string>, weight int"), "fs", ["weight"], 12, held=held).orderBy("pick").collect()
    assert [(r.id, r.gain) for r in got] == out
    assert U.coverage(spark.createDataFrame([], "id long, fs array<string>, weight int"), "fs", ["weight"], 12, held=held).collect() == []


@pytest.mark.parametrize("held", [U.HELD, 0])
def test_review_fill_balances(frame, rows, held):
    weights = {"topic": 4, "complexity": 3, "mixed": 2}
    value = lambda r: (r[2], r[3], r[9])
    counts = [Counter(), Counter(), Counter()]
    for r in rows:
        if r[10]:
            for c, v in zip(counts, value(r)):
                c[v] += 1
    want = []
    for _ in range(15):
        r = min((r for r in rows if not r[10] and r[0] not in want), key=lambda r: (sum(w * c[v] for w, c, v in zip((4, 3, 2), counts, value(r))), hashed(1, r[0])))
        want.append(r[0])
        for c, v in zip(counts, value(r)):
            c[v] += 1
    got = U.review_fill(frame, "safety", 15, 1, weights, held=held).collect()
    assert {r.id for r in got if r.pick is None} == {r[0] for r in rows if r[10]}
    assert [r.id for r in sorted((r for r in got if r.pick), key=lambda r: r.pick)] == want
    with pytest.raises(ValueError):
        U.review_fill(frame.limit(5), "safety", 15, 1, weights, held=held)


def test_equal_rows_are_folded_before_they_are_candidates(spark):
    rows = spark.range(5000).select("id", F.lit("a").alias("kind"), F.sha2(F.col("id").cast("string"), 256).alias("tie"))
    assert U.folded(rows, ["kind"], ["tie"], 7).count() == 7


def test_review_queue_sends_only_its_filled_places_to_the_records(spark, monkeypatch):
    from corpuloom.plans import subsets as P

    seen = []
    monkeypatch.setattr(P.S, "ordered_place", lambda df, order: seen.append(df) or df.withColumn("place", F.lit(1)))
    P.review_queue(spark, "/root/testdata/sf0.001")
    joins = [line for line in seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "rightHint=(strategy=broadcast)" in joins[0]
