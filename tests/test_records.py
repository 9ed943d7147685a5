"""Sources, sinks, gates, text functions and incremental runs on small literals."""

import json

import pytest
from pyspark.sql import functions as F

from corpuloom.functions import text as X
from corpuloom.operators import validation as V
from corpuloom.sources import records, sinks
from corpuloom.streaming import resume


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


def test_ancestors_stop_at_cycles_and_depth(spark):
    edges = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8), (5, 5)], "id long, parent_id long")
    got = {r.id: r.chain for r in records.ancestors(edges).collect()}
    assert got == {1: [], 2: ["1"], 3: ["1", "2"], 8: ["9"], 9: ["8"], 5: []}
    assert {r.id: r.chain for r in records.ancestors(edges, 1).collect()}[3] == ["2"]


def test_dialogue_tree_filters_and_joins(spark):
    rows = [("p", None, "prompter", "en", "ask", False, True), ("a", "p", "assistant", "en", "say", False, True), ("b", "p", "assistant", "en", "gone", True, True), ("c", "p", "assistant", "de", "nein", False, None), ("q", "a", "prompter", "en", "more", None, None), ("d", "q", "assistant", "en", "end", None, None)]
    m = spark.createDataFrame(rows, "message_id string, parent_id string, role string, lang string, text string, deleted boolean, review_result boolean")
    got = {r.id: (r.question, r.answer, r.chain) for r in records.dialogue_tree(m).collect()}
    assert got == {"a": ("ask", "say", []), "d": ("more", "end", ["p", "a"])}
    assert [r.id for r in records.dialogue_tree(m, exclude="end").collect()] == ["a"]


def test_best_answer_ties_by_smallest_id(spark):
    t = "qid long, question string, answers array<struct<answer_id:long,text:string,selected:boolean,pm_score:int,author:string,author_profile:string>>"
    rows = [(1, "<p>q</p>", [(3, "x", False, 5, "u", "v"), (2, "y", None, 5, "u", "v"), (1, " ", True, 9, "u", "v")]), (2, "q", []), (3, "q", None)]
    got = [(r.qid, r.answer_id, r.question) for r in records.preference_qa(spark.createDataFrame(rows, t)).collect()]
    assert got == [(1, 2, "q")]


def test_programming_tasks(spark):
    rows = [(1, "q", '["a", "b"]', '{"fn_name": "f"}', "", "easy"), (2, "q", "[]", "{}", "", "easy"), (3, "q", None, None, None, None)]
    df = spark.createDataFrame(rows, "problem_id long, question string, solutions string, input_output string, starter_code string, difficulty string")
    assert [(r.problem_id, r.answer, r.function_task) for r in records.programming_tasks(df).collect()] == [(1, "a", True)]


def test_partitions_and_stages(spark):
    df = lambda *ids: spark.createDataFrame([(i, i % 2 == 0) for i in ids], "id long, ok boolean")
    assert {r.id: r.decision for r in records.partitions({"strict": df(1), "reject": df(2)}, "id").collect()} == {1: "strict", 2: "reject"}
    with pytest.raises(ValueError):
        records.partitions({"strict": df(1), "reject": df(1)}, "id")


def test_json_lines_round_trip_and_paths(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "id long, text string")
    sinks.write_json_lines(df, f"{tmp_path}/m1-full", "gzip")
    assert sorted(records.json_lines(spark, f"{tmp_path}/m1-full", "id long, text string").collect()) == sorted(df.collect())
    got = records.by_path(spark, f"{tmp_path}/m*", "id long, text string", r"/(m\d)-(\w+)/", ["model", "condition"])
    assert {(r.model, r.condition) for r in got.collect()} == {("m1", "full")}
    (tmp_path / "ids.txt").write_text("a\n\n b \n")
    assert sorted(r.id for r in records.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]


def test_shards_are_contiguous(spark, tmp_path):
    for n, k in ((23, 5), (3, 5), (0, 2)):
        got = sinks.with_shard(spark.range(n).repartition(3), ["id"], k).collect()
        assert sorted((r.id, r.row) for r in got) == [(i, i) for i in range(n)]
        sizes = [sum(r.shard == i for r in got) for i in range(k)]
        assert sizes == sinks.row_targets(n, k)
    sinks.write_shards(spark.range(23), ["id"], 5, f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards/shard=0").orderBy("row").count() == 5


def test_release_verification(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.bin").write_bytes(name.encode())
    have = sinks.file_digests(spark, f"{tmp_path}/*.bin").select(F.element_at(F.split("path", "/"), -1).alias("path"), "sha256")
    want = have.where("path <> 'c.bin'").withColumn("sha256", F.when(F.col("path") == "b.bin", "0").otherwise(F.col("sha256"))).union(spark.createDataFrame([("d.bin", "1")], "path string, sha256 string"))
    assert {r.path: r.status for r in sinks.verify_files(spark, f"{tmp_path}/*.bin", want).collect()} == {"b.bin": "different", "c.bin": "unexpected", "d.bin": "missing"}


def test_reports(spark):
    df = spark.createDataFrame([("a", 0.5, [1])], "k string, x double, l array<int>")
    assert json.loads(sinks.report(df)) == [{"k": "a", "x": 0.5, "l": [1]}]
    assert sinks.markdown(df.drop("l")).splitlines()[-1] == "| a | 0.5000 |"
    assert sinks.nested_as_json(df).first().l == "[1]"
    assert [tuple(r) for r in sinks.scalars(df.drop("l"), ["k"]).collect()] == [("metrics/a/x", 0.5)]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, "One two. Three?  Four", X.sentences(t)) == (["One two.", "Three?", "Four"],)
    assert one(spark, "", F.size(X.sentences(t)), F.size(X.spans(X.sentences(t)))) == (0, 0)
    assert one(spark, "A b. C d.", X.spans(X.sentences(t))) == (["A b.", "A b. C d.", "C d."],)
    assert one(spark, "the cat sat. a dog ran.", X.best_span(F.lit("dog ran"), X.sentences(t)), X.best_span(F.lit("zebra"), X.sentences(t))) == ("a dog ran.", None)
    assert one(spark, "the red fox ran home", X.grounded_in_order(F.lit("The RED ... ran home"), t), X.grounded_in_order(F.lit("ran home ... the red"), t), X.grounded_in_order(F.lit(""), t)) == (True, False, False)
    assert one(spark, "x ```json\n{\"a\": 1}\n``` y", X.json_object(t)) == ('{"a": 1}',)
    assert one(spark, "no {object", X.json_object(t)) == (None,)
    assert one(spark, "where do I keep my blue bike now", X.lexical_leak(t, F.lit("keep my blue bike")), X.lexical_leak(t, F.lit("something else entirely here"))) == (True, False)
    assert one(spark, "日本", X.contains_cjk(t)) == (True,) and one(spark, None, X.contains_cjk(t)) == (False,)
    assert one(spark, "a <THINK> b", X.reasoning_trace(t)) == (True,)


def test_gates(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, v string, locked int")
    over = spark.createDataFrame([(2, "z")], "id long, value string")
    assert {r.id: (r.v, r.overridden) for r in V.manual_gate(df, over, "id", "v").collect()} == {1: ("a", False), 2: ("z", True)}
    with pytest.raises(ValueError):
        V.manual_gate(df, spark.createDataFrame([(9, "z")], "id long, value string"), "id", "v")
    p = spark.createDataFrame([(1, "n", 1), (2, "n", 7)], "id long, v string, locked int")
    assert {r.id: (r.v, r.patched, r.refused) for r in V.patch(df, p, "id", ["v"], ["locked"]).collect()} == {1: ("n", True, []), 2: ("b", False, ["locked"])}
    w = spark.createDataFrame([(["strict", "odd"],), ([],), (["review", "strict"],)], "c array<string>")
    assert [r[0] for r in w.select(V.worst_of(F.col("c"))).collect()] == ["invalid", "invalid", "review"]
    assert spark.range(1).select(V.char_budget_chunks(F.array(*[F.lit(x).cast("long") for x in (5, 5, 1, 99, 1)]), 10)).first()[0] == [0, 0, 1, 2, 3]
    with pytest.raises(ValueError):
        V.assert_counts(df, "v", {"a": 2})


def test_stream_takes_each_result_once(spark, tmp_path):
    schema = "request_id long, fingerprint string, attempt int, state string"
    src, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    reqs = spark.createDataFrame([(1, "f"), (2, "f"), (3, "f")], "request_id long, fingerprint string")
    for rows in ([(1, "f", 1, None), (2, "f", 1, "empty")], [(1, "f", 2, None), (2, "f", 2, None), (3, "other", 1, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
        resume.stream_results(spark, src, schema, sink, mark, reqs).awaitTermination()
    assert sorted((r.request_id, r.attempt) for r in spark.read.parquet(sink).collect()) == [(1, 1), (2, 2)]
    assert [r.request_id for r in resume.to_do(reqs, spark.read.parquet(sink).withColumn("state", F.lit(None).cast("string"))).collect()] == [3]


def test_result_state(spark):
    rows = [(None, "t", "stop"), ("e", "t", "stop"), (None, " ", "stop"), (None, "t", "length"), (None, "t", None)]
    df = spark.createDataFrame(rows, "e string, t string, f string")
    assert [r[0] for r in df.select(resume.result_state(df.e, df.t, df.f)).collect()] == [None, "error", "empty", "length", "finish"]
    assert df.select(resume.result_state(df.e, df.t, df.f, True)).collect()[3][0] is None
