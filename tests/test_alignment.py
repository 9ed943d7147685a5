"""Alignment of atoms and rubrics, first persons and literal tokens against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuloom.functions import text as X
from corpuloom.operators import alignment as A

TOKEN = re.compile(A.TOKEN[1:-1])


def words(t):
    return {w for w in (x.lower().strip("._-/") for x in TOKEN.findall(t or "")) if len(w) >= 2 and w not in A.STOPWORDS}


def marked(t):
    return {x.lower().strip(".,;:()[]{}") for x in TOKEN.findall(t or "") if x.startswith(".") or x.lstrip(".").isdigit() or re.fullmatch(A.MARKED[1:-1], x)}


def share(a, b):
    return len(words(a) & words(b)) / len(words(b)) if words(a) and words(b) else 0.0


def plain(question, atoms):
    out = []
    for n, (i, support, expected) in enumerate(atoms):
        own, others = share(support, expected), [(share(s, expected), o) for m, (o, s, _) in enumerate(atoms) if m != n]
        best = max(others, key=lambda x: x[0], default=(0.0, None))
        bad, aq, rq = sorted(marked(expected) - words(support)), share(question, support), share(question, expected)
        reasons = [k for k, c in {
            "probable_cross_atom_rubric_swap": best[0] >= 0.34 and best[0] >= own + 0.20, "rubric_introduces_unsupported_identifier": own < 0.15 and bad, "very_low_atom_rubric_overlap": own < 0.10 and len(words(expected)) >= 3,
            "probable_query_atom_value_leakage": aq >= 0.72 and len(words(support)) >= 3 and marked(support) <= words(question), "probable_query_rubric_value_leakage": rq >= 0.82 and len(words(expected)) >= 3 and marked(expected) <= words(question),
        }.items() if c]
        out.append((i, reasons, round(own, 6), best[1], round(best[0], 6), round(aq, 6), round(rq, 6), bad))
    return out


def test_alignment_equals_a_plain_version(spark):
    rng = random.Random(6)
    some = ["useCase", "HTTP2", "src/main.py", ".env", "42", "blue", "kettle", "the", "must", "Retry", "x", "node-", "v1.2", "queue", "limit"]
    text = lambda: rng.choice([None, " ".join(rng.choice(some) for _ in range(rng.randint(0, 7)))])
    rows = [(i, text(), [(f"a{j}", text(), text()) for j in range(rng.randint(0, 4))]) for i in range(150)] + [(900, "q", None)]
    df = spark.createDataFrame(rows, "id long, question string, atoms array<struct<atom_id string, support string, expected string>>")
    got = {}
    for r in A.alignment(df).collect():
        got.setdefault(r.id, {})[r.atom_id] = tuple(r)[1:]
    want = {i: {x[0]: tuple(x) for x in plain(q, atoms)} for i, q, atoms in rows if atoms}
    assert got == want and {k for v in want.values() for x in v.values() for k in x[1]} >= {"probable_cross_atom_rubric_swap", "rubric_introduces_unsupported_identifier", "very_low_atom_rubric_overlap"}


@pytest.mark.parametrize(("token", "text", "want"), [
    ("5", "take  5 now", True), ("5", "15 now", False), ("5", "five a day", True), ("5", "fives", False), ("3-5", "three to  five", True), ("3-5", "Three–five", True), ("3-5", "three five", False), ("3-5", "3-5 days", True), ("25", "twenty-five", False),
    ("mg", "5 MG", True), ("mg", "5mg", False), ("é", "née", False), ("né", "il est Né ici", True), ("+", "a+b", True), ("c++", "in C++ now", True), (".*", "ab", False), ("a.c", "abc", False), ("x", None, False),
])
def test_literal_tokens(spark, token, text, want):
    assert spark.createDataFrame([(token, text)], "t string, x string").select(X.literal_present(F.col("t"), F.col("x")).alias("p")).first().p is want


def test_first_person(spark):
    rows = [("My dog", True), ("  i’ve been", True), ("Mystery", False), ("I", True), ("米", False), ("我们去", True), ("We’re", True), ("", False), (None, False), ("Igor", False), ("our-own", True), ("mé", False)]
    got = spark.createDataFrame(rows, "t string, w boolean").select("t", "w", X.first_person(F.col("t")).alias("p")).collect()
    assert [(r.t, r.p) for r in got if r.p is not r.w] == []
