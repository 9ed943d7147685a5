"""Near-verbatim evidence, canonical documents and deterministic packages."""

import hashlib
import json
import os
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from corpuloom.functions import documents as D
from corpuloom.operators import grounding as G
from corpuloom.sources import packages as P


def plain_closest(source, target, least):
    """Every span compared, without bounds."""
    wanted, best = G.folded(target), None
    for span in G.spans_of(source):
        own = G.folded(span)
        if not own or not wanted:
            continue
        s = G.score(*G.shares(own, wanted), SequenceMatcher(None, own, wanted, autojunk=False).ratio())
        if best is None or (s, -len(span), span) > best:
            best = (s, -len(span), span)
    return (best[2], best[0]) if best and best[0] >= least else None


@pytest.mark.parametrize("seed", range(5))
def test_closest_span_equals_comparing_all(seed):
    rng = random.Random(seed)
    words = ["the", "dose", "was", "5mg", "daily", "Asthma", "since", "May", "because", "é", "pain", "knee"]
    for _ in range(120):
        source = "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "! ", "\n", "? ", ".5 "]) for _ in range(rng.randint(0, 40)))
        target = " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))
        least = rng.choice([0.0, 0.25, 0.7])
        assert G.closest_span(source, target, least) == plain_closest(source, target, least), (source, target)


def test_evidence_in_other_marks_and_parts():
    source = "The patient’s dose was “5 mg” each day; it rose to 10 mg in the spring of last year."
    for evidence, want in (
        ("patient's DOSE  was \"5 mg\"", True), ("patient\\u0027s dose", True), ("The patient’s dose was … in the spring of last", True), ("in the spring of last ... The patient's dose", False),
        ("dose ... in the spring of last", False), ("ｄｏｓｅ ｗａｓ", True), ("dose is", False), ("", False), (None, False),
    ):
        assert G.in_source(evidence, source) is want, evidence
    assert not G.in_source("x", None)


def test_repair_of_a_frame(spark):
    df = spark.createDataFrame([(1, "He fell twice. Pain began in May.", "pain BEGAN in May", 9), (2, "He fell twice. Pain began in May.", "the pain begins in May", 9), (3, None, "x", 9), (4, "text", None, 9), (5, "No such thing.", "zzz qqq", 9)], "id int, s string, e string, score int")
    got = {r.id: r for r in G.repaired(df, "e", "s").collect()}
    assert got[1].grounded and got[1].replacement is None and got[1].score is None
    assert not got[2].grounded and got[2].replacement == "Pain began in May." and got[2].score > 0.5
    assert [(got[i].grounded, got[i].replacement) for i in (3, 4, 5)] == [(False, None)] * 3
    assert G.repaired(df.limit(0), "e", "s").collect() == []


def test_canonical_documents(spark):
    rng = random.Random(1)

    def value(depth):
        kind = rng.randint(0, 6 if depth else 3)
        if kind < 4:
            return [rng.randint(-99, 99), rng.choice(["a", "é\n", "漢", '"\\']), None, True][kind]
        return [value(depth - 1) for _ in range(rng.randint(0, 3))] if kind == 4 else {rng.choice("zyxabc") + str(i): value(depth - 1) for i in range(rng.randint(0, 4))}

    def shuffled(v):
        if isinstance(v, dict):
            return dict(rng.sample([(k, shuffled(x)) for k, x in v.items()], len(v)))
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    docs = [value(4) for _ in range(200)]
    rows = [(i, json.dumps(shuffled(d), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for i, d in enumerate(docs) for _ in range(2)]
    got = spark.createDataFrame([*rows, (-1, "no json"), (-1, None)], "id int, t string").select("id", D.canonical_digest(F.col("t")).alias("d")).collect()
    for r in got:
        text = None if r.id < 0 else json.dumps(docs[r.id], ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        assert r.d == (text and hashlib.sha256(text.encode()).hexdigest())


def test_numeric_paths(spark):
    rows = [(1, '{"a": {"b": 1, "c": {"d": 2.5, "e": true, "skip": 3}}, "f": [4], "g": "5", "h": null, "i": 1e400}'), (2, "7"), (3, "oops"), (4, None), (5, "[]")]
    got = D.numeric_paths(spark.createDataFrame(rows, "id int, t string"), "id", "t", skip=("skip",)).collect()
    assert sorted((r.id, r.path, r.value) for r in got) == [(1, "a.b", 1.0), (1, "a.c.d", 2.5), (2, "", 7.0)]
    deep = spark.createDataFrame([(1, '{"a":' * 5 + "1" + "}" * 5)], "id int, t string")
    with pytest.raises(ValueError, match="deeper"):
        D.numeric_paths(deep, "id", "t", most=4)


def files(path):
    return {n: open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if not n.startswith(".")}


def test_packages_are_equal_byte_for_byte(spark, tmp_path):
    df = spark.range(1003).select("id", F.concat(F.lit("line é "), F.col("id").cast("string")).alias("line"))
    for i, parts in enumerate((1, 9)):
        P.write_gzip_shards(df.repartition(parts), ["id"], 4, f"file://{tmp_path}/{i}/pack", "data")
    one, two = files(tmp_path / "0/pack"), files(tmp_path / "1/pack")
    assert one == two and len(one) == 5
    assert [m["rows"] for m in json.loads(one["manifest.json"])["shards"]] == [251, 251, 251, 250]
    assert P.verify_package(f"file://{tmp_path}/0/pack") == []
    zips = [P.write_zip(f"file://{tmp_path}/{i}/pack", f"file://{tmp_path}/{i}.zip") for i in (0, 1)]
    assert zips[0] == zips[1] == hashlib.sha256((tmp_path / "0.zip").read_bytes()).hexdigest()
    import zipfile

    with zipfile.ZipFile(tmp_path / "0.zip") as z:
        assert z.testzip() is None and all(i.date_time[0] == 1980 for i in z.infolist()) and z.read("pack/manifest.json") == one["manifest.json"]
    assert P.gzip_copy(f"file://{tmp_path}/0/pack/manifest.json", f"file://{tmp_path}/m.gz") == P.gzip_copy(f"file://{tmp_path}/1/pack/manifest.json", f"file://{tmp_path}/n.gz")
    name = sorted(one)[0]
    (tmp_path / "1/pack" / name).write_bytes(b"x")
    (tmp_path / "1/pack/more").write_bytes(b"x")
    assert P.verify_package(f"file://{tmp_path}/1/pack") == [f"different {name}", "unexpected more"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("x").alias("line"))
    with pytest.raises(Exception, match="broken"):
        P.write_gzip_shards(df, ["id"], 3, f"file://{tmp_path}/pack", "data")
    assert not [n for n in (os.listdir(tmp_path / "pack") if (tmp_path / "pack").exists() else []) if not n.startswith(".")]


def test_packages_with_fewer_rows_than_shards(spark, tmp_path):
    P.write_gzip_shards(spark.range(2).select("id", F.lit("a").alias("line")), ["id"], 4, f"file://{tmp_path}/pack", "data")
    assert P.verify_package(f"file://{tmp_path}/pack") == [] and len(files(tmp_path / "pack")) == 5
    assert [r.rows for r in P.read_package(spark, f"file://{tmp_path}/pack").collect()] == [1, 1]
