"""Record-level queries over the driver's tables: sources, projections, filters, gates, incremental runs and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuloom.functions import text as X
from corpuloom.operators import validation as V
from corpuloom.plans.views import CONDITIONS, J, MODELS, V_ATOMS, V_ATTEMPTS, V_SAMPLES, V_SOURCES, attempts, atoms, judgments, query, requests, samples, sources, v_judgments
from corpuloom.session import table
from corpuloom.sources import records as R
from corpuloom.sources import sinks as K
from corpuloom.streaming import resume as I

_TOK = r"regexp_extract_all(lower({0}), '([a-z]+(?:''[a-z]+)?|[0-9]+(?:\.[0-9]+)?)')"


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS id, nullif(p_partkey // 3, p_partkey) AS at, 0 AS depth, NULL::BIGINT AS hit FROM part
  UNION ALL SELECT id, nullif(p.p_partkey // 3, p.p_partkey), depth + 1, p.p_partkey FROM up JOIN part p ON p.p_partkey = up.at WHERE depth < 12)
SELECT id, coalesce(string_agg(hit::VARCHAR, '>' ORDER BY depth DESC) FILTER (hit IS NOT NULL), '') AS chain FROM up GROUP BY id""")
def ancestor_chain(spark, d):
    """Chains over a ternary tree of part keys, root first."""
    edges = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("p_partkey div 3").alias("parent_id"))
    return R.ancestors(edges).select("id", F.array_join("chain", ">").alias("chain"))


@query("""WITH r AS (SELECT l_orderkey AS qid, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R')::INT DESC, l_quantity::BIGINT DESC, l_partkey * 10 + l_linenumber) AS i FROM lineitem WHERE l_linestatus = 'O')
SELECT qid, l_partkey * 10 + l_linenumber AS answer_id, l_quantity::BIGINT AS score FROM r WHERE i = 1""")
def best_answer_per_question(spark, d):
    text = F.when(F.col("l_linestatus") == "O", "kept").otherwise(" ")
    one = F.struct(text.alias("text"), (F.col("l_returnflag") == "R").alias("selected"), F.col("l_quantity").cast("long").alias("pm_score"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("answer_id"))
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_list(one).alias("answers"))
    return q.withColumn("best", R.best_answer(F.col("answers"))).where("best is not null").select("qid", F.col("best.answer_id").alias("answer_id"), F.col("best.pm_score").alias("score"))


@query("""SELECT event_id, event_type, json_valid(props) AS parsed, len(json_keys(props)) AS fields FROM events""")
def json_property_scan(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", F.try_parse_json("props").isNotNull().alias("parsed"), F.size(F.json_object_keys("props")).cast("long").alias("fields"))


@query(rf"""WITH {V_SOURCES} SELECT id, list_filter([CASE WHEN length(raw_question) < 100 THEN 'short' END, CASE WHEN length(raw_question) > 20000 THEN 'long' END, CASE WHEN length(regexp_replace(raw_question, '[^!-/:-@\[-`{{-~]', '', 'g')) > 0.05 * length(raw_question) THEN 'punctuation' END,
  CASE WHEN NOT contains(raw_question, '?') THEN 'no_question' END, CASE WHEN regexp_matches(raw_question, '[\x{{3400}}-\x{{9fff}}]') THEN 'cjk' END, CASE WHEN contains(raw_question, '```') THEN 'code_fence' END], lambda x: x IS NOT NULL) AS reasons FROM v_source""")
def text_gate(spark, d):
    q = F.col("raw_question")
    marks = F.length(F.regexp_replace(q, r"[^!-/:-@\[-`{-~]", ""))
    rules = {"short": F.length(q) < 100, "long": F.length(q) > 20000, "punctuation": marks > 0.05 * F.length(q), "no_question": ~q.contains("?"), "cjk": X.contains_cjk(q), "code_fence": q.contains("```")}
    return sources(spark, d).select("id", V.codes(rules).alias("reasons"))


_PAIR = "p AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q, text AS m FROM conversations), k AS (SELECT * FROM p WHERE q IS NOT NULL)"


@query(f"""WITH {_PAIR}, t AS (SELECT conv_id, turn, list_distinct({_TOK.format('q')}) AS a, list_distinct({_TOK.format('m')}) AS b FROM k)
SELECT conv_id, turn, len(list_intersect(a, b)) AS shared, CASE WHEN len(b) > 0 THEN len(list_intersect(a, b)) / len(b) ELSE 0 END AS coverage, CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END AS jaccard FROM t""")
def lexical_overlap(spark, d):
    """Shared tokens of a turn with the one before it."""
    from pyspark.sql import Window

    t = table(spark, d, "conversations").withColumn("q", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("q is not null")
    a, b = F.array_distinct(X.tokens(F.col("q"))), F.array_distinct(X.tokens(F.col("text")))
    return t.select("conv_id", "turn", F.size(F.array_intersect(a, b)).cast("long").alias("shared"), X.directed_overlap(a, b).alias("coverage"), X.jaccard(a, b).alias("jaccard"))


@query(r"""WITH t AS (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' use `foo bar` of HTTP/2 at 10:30, v1.2' WHEN 1 THEN ' GPU-A100 costs 3,000' ELSE '' END AS c FROM benchmark),
f AS (SELECT item_id, list_concat(list_concat(regexp_extract_all(c, '\b\d+(?:[.,:/-]\d+)*\b'), regexp_extract_all(c, '\b[A-Z]{2,}[A-Z0-9_+.#/-]*\b')), list_concat(list_filter(regexp_extract_all(c, '\b[A-Za-z0-9_+.#/-]{2,}\b'), lambda x: regexp_matches(x, '[0-9]') AND regexp_matches(x, '[^0-9]')), regexp_extract_all(c, '`([^`]+)`', 1))) AS x FROM t)
SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(x, lambda w: lower(trim(regexp_replace(w, '\s+', ' ', 'g')))), lambda w: w <> ''))), '|') AS tokens FROM f""")
def critical_tokens(spark, d):
    """Tokens of benchmark items that a rewrite must keep; the view adds some of each kind."""
    k = F.col("item_id") % 3
    c = F.concat("text", F.when(k == 0, " use `foo bar` of HTTP/2 at 10:30, v1.2").when(k == 1, " GPU-A100 costs 3,000").otherwise(""))
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.critical_tokens(c), "|").alias("tokens"))


@query(r"""WITH s AS (SELECT item_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM benchmark)
SELECT item_id, len(p) AS sentences, len(list_distinct(flatten(list_transform(range(1, len(p) + 1), lambda i: list_transform(range(1, least(3, len(p) - i + 1) + 1), lambda n: array_to_string(p[i:i + n - 1], ' ')))))) AS spans FROM s""")
def sentence_spans(spark, d):
    p = X.sentences(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.size(p).cast("long").alias("sentences"), F.size(X.spans(p)).cast("long").alias("spans"))


@query(f"""WITH {V_SAMPLES} SELECT sample_id, model, condition, concat_ws('/', model, condition, sample_id) AS request_id FROM v_samples CROSS JOIN (SELECT unnest({list(MODELS)}) AS model) CROSS JOIN (SELECT unnest({list(CONDITIONS)}) AS condition)""")
def request_grid(spark, d):
    """A request for each sample, model and condition."""
    grid = samples(spark, d).select("sample_id", F.explode(F.array(*map(F.lit, MODELS))).alias("model")).withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    return grid.withColumn("request_id", F.concat_ws("/", "model", "condition", "sample_id"))


_BLOCKS = f"WITH {V_ATOMS}, b AS (SELECT sample_id, block, string_agg(atom_id, ' ' ORDER BY atom_id) AS text FROM v_atoms {{0}} GROUP BY ALL)"


def _blocks(rows):
    return rows.groupBy("sample_id", "block").agg(F.array_join(F.array_sort(F.collect_list("atom_id")), " ").alias("text"))


@query(f"""{_BLOCKS.format('')}, n AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY block) AS i FROM b) SELECT sample_id, string_agg('[' || i || '] ' || text, chr(10) ORDER BY i) AS prompt, count(*) AS blocks FROM n GROUP BY ALL""")
def prompt_blocks(spark, d):
    """Each record's blocks as numbered lines."""
    b = _blocks(atoms(spark, d)).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("b"))
    lines = F.transform("b", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["text"]))
    return b.select("sample_id", F.array_join(lines, "\n").alias("prompt"), F.size("b").cast("long").alias("blocks"))


@query(f"""{_BLOCKS.format("WHERE gold <> 'A'")} SELECT * FROM b""")
def counterfactual_delete(spark, d):
    """Blocks without their A atoms; blocks that hold nothing else go."""
    return _blocks(atoms(spark, d).where("gold <> 'A'"))


@query(f"""WITH {V_ATOMS} SELECT sample_id, atom_id, gold, CASE gold WHEN 'A' THEN 'contamination' WHEN 'B' THEN 'bounded_use' ELSE 'removal' END AS probe, CASE gold WHEN 'C' THEN 1 WHEN 'A' THEN 2 ELSE 3 END AS priority FROM v_atoms""")
def counterfactual_rows(spark, d):
    probe = F.when(F.col("gold") == "A", "contamination").when(F.col("gold") == "B", "bounded_use").otherwise("removal")
    priority = F.when(F.col("gold") == "C", 1).when(F.col("gold") == "A", 2).otherwise(3)
    return atoms(spark, d).select("sample_id", "atom_id", "gold", probe.alias("probe"), priority.alias("priority"))


@query(f"""{J}, w AS (SELECT sample_id, count(DISTINCT atom_id) AS want FROM v_atoms GROUP BY ALL), v_planted AS (SELECT CASE WHEN sample_id % 101 = 0 THEN -sample_id ELSE sample_id END AS sample_id, model, condition, atom_id || CASE WHEN h % 83 = 0 THEN '_x' ELSE '' END AS atom_id,
  CASE WHEN h % 97 = 0 THEN 'X' ELSE predicted END AS predicted, CASE WHEN h % 89 = 0 THEN 7 ELSE h % 5 END AS task_quality FROM v_judgments CROSS JOIN (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR h % 79 = 0),
k AS (SELECT DISTINCT sample_id, atom_id, 1 AS known FROM v_atoms),
g AS (SELECT sample_id, model, condition, count(*) AS n, count(DISTINCT atom_id) AS atoms, count(DISTINCT CASE WHEN known = 1 THEN atom_id END) AS met, count(*) FILTER (known IS NULL) AS strange,
  count(*) FILTER (predicted NOT IN ('A', 'B', 'C')) AS bad, count(*) FILTER (task_quality NOT BETWEEN 0 AND 4) AS quality FROM v_planted LEFT JOIN k USING (sample_id, atom_id) GROUP BY ALL)
SELECT sample_id, model, condition, list_filter([CASE WHEN want IS NULL THEN 'unknown_sample' END, CASE WHEN met < want THEN 'missing_atoms' END, CASE WHEN strange > 0 THEN 'unknown_atom' END, CASE WHEN n > atoms THEN 'repeated_atom' END,
  CASE WHEN bad > 0 THEN 'bad_label' END, CASE WHEN quality > 0 THEN 'bad_quality' END], lambda x: x IS NOT NULL) AS errors FROM g LEFT JOIN w USING (sample_id)""")
def judgment_validation(spark, d):
    """Error codes of each answer's judgments, among which the view plants unknown samples and atoms, repeated atoms, bad labels and bad qualities; samples with a renamed atom miss it."""
    every = lambda n: F.pmod("h", F.lit(n)) == 0
    # Atoms are dealt by the sample that their answers name: no judgment is shuffled. An atom becomes ten judgments, which
    # their task sorts, so there are ten times as many parts.
    parts = len(MODELS) * len(CONDITIONS) * int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = F.when(F.col("sample_id") % 101 == 0, -F.col("sample_id")).otherwise(F.col("sample_id"))
    j = judgments(spark, d, cells=atoms(spark, d).withColumn("planted", named).repartition(parts, "planted"))
    j = j.withColumn("copy", F.explode(F.when(every(79), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    j = j.withColumns({
        "sample_id": F.col("planted"), "atom_id": F.concat("atom_id", F.when(every(83), "_x").otherwise("")),
        "predicted": F.when(every(97), "X").otherwise(F.col("predicted")), "task_quality": F.when(every(89), 7).otherwise(F.pmod("h", F.lit(5))),
    })
    return V.judgment_codes(j, atoms(spark, d), ["sample_id", "model", "condition"])


@query(f"""WITH {V_ATTEMPTS}, c AS (SELECT request_id, max(CASE WHEN state = 'invalid' THEN 2 WHEN tokens % 10 = 0 THEN 1 ELSE 0 END) AS s FROM v_attempts GROUP BY ALL) SELECT request_id, (['strict', 'review', 'reject'])[s + 1] AS verdict FROM c""")
def worst_verdict(spark, d):
    check = F.when(F.col("state") == "invalid", "reject").when(F.pmod("tokens", F.lit(10)) == 0, "review").otherwise("strict")
    return attempts(spark, d).groupBy("request_id").agg(F.collect_list(check).alias("checks")).select("request_id", V.worst_of(F.col("checks")).alias("verdict"))


@query(f"""WITH {V_ATTEMPTS}, r AS (SELECT request_id, attempt, state, tokens, row_number() OVER (PARTITION BY request_id ORDER BY (state = 'valid')::INT DESC, CASE WHEN state = 'valid' THEN attempt ELSE -attempt END) AS i FROM v_attempts) SELECT request_id, state, tokens, attempt - 1 AS stage FROM r WHERE i = 1""")
def staged_resolution(spark, d):
    """A later stage replaces only what is invalid so far."""
    a = attempts(spark, d)
    stages = [a.where(F.col("attempt") == n).select("request_id", "state", "tokens") for n in (1, 2, 3)]
    return R.staged(stages, "request_id", F.col("state") == "valid").select("request_id", "state", "tokens", F.col("stage").cast("long").alias("stage"))


def _results(spark, d):
    a = attempts(spark, d)
    return a.select("request_id", "fingerprint", "attempt", "tokens", F.when(F.col("state") == "invalid", "finish").alias("state"))


@query(f"""WITH {V_ATTEMPTS}, a AS (SELECT * FROM v_attempts WHERE attempt = 1 AND state = 'valid') SELECT r.request_id, CASE WHEN a.request_id IS NULL THEN 'inference_failure' ELSE 'ok' END AS state FROM v_requests r LEFT JOIN a USING (request_id)""")
def failure_rows(spark, d):
    """Results of a first attempt with failed rows for requests without one."""
    good = I.complete(_results(spark, d).where("attempt = 1"), requests(spark, d))
    return I.with_failures(requests(spark, d), good).select("request_id", F.coalesce("state", F.lit("ok")).alias("state"))


@query(f"""WITH {V_ATTEMPTS}, k AS (SELECT request_id, max(attempt) AS attempt FROM v_attempts WHERE state = 'valid' GROUP BY ALL)
SELECT a.request_id, a.attempt, CASE WHEN k.request_id IS NULL THEN 'moved' ELSE 'kept' END AS fate FROM v_attempts a LEFT JOIN k ON k.request_id = a.request_id AND k.attempt = a.attempt""")
def resume_repair(spark, d):
    kept, moved = I.repair(_results(spark, d), requests(spark, d))
    pick = lambda df, fate: df.select("request_id", "attempt", F.lit(fate).alias("fate"))
    return pick(kept, "kept").unionByName(pick(moved, "moved"))


@query(f"""{J} SELECT sample_id, atom_id, model, CASE WHEN sample_id % 11 = 0 THEN 'A' ELSE predicted END AS predicted, CASE WHEN sample_id % 11 = 0 THEN 0 ELSE h % 5 END AS task_quality FROM v_judgments WHERE condition = 'full_memory'""")
def failure_policy(spark, d):
    """Judgments of failed answers are forced to the lowest label and quality."""
    j = judgments(spark, d).where("condition = 'full_memory'").select("sample_id", "atom_id", "model", "predicted", F.pmod("h", F.lit(5)).alias("task_quality"))
    return I.failure_judgments(j, samples(spark, d).where("sample_id % 11 = 0"))


@query(f"""{J}, {v_judgments("v_second", "second")}, x AS (SELECT a.model, a.condition, abs(a.p - b.p) AS apart, abs(a.p - a.g) AS first_off, abs(b.p - b.g) AS second_off FROM v_judgments a JOIN v_second b USING (sample_id, atom_id, model, condition))
SELECT model, condition, count(*) AS atoms, sum(apart)::BIGINT AS distance, avg((apart > 0)::INT) AS disagreement, sum(first_off)::BIGINT AS first_error, sum(second_off)::BIGINT AS second_error FROM x GROUP BY ALL""")
def review_disagreement(spark, d):
    x = judgments(spark, d, also="second").withColumnRenamed("also", "second").withColumn("apart", V.rank_distance(F.col("predicted"), F.col("second")))
    return x.groupBy("model", "condition").agg(
        F.count(F.lit(1)).alias("atoms"), F.sum("apart").cast("long").alias("distance"), F.avg((F.col("apart") > 0).cast("int")).alias("disagreement"),
        F.sum(V.rank_distance(F.col("predicted"), F.col("gold"))).cast("long").alias("first_error"), F.sum(V.rank_distance(F.col("second"), F.col("gold"))).cast("long").alias("second_error"),
    )


@query(f"""{J}, s AS (SELECT model, condition, avg((g = p)::INT) AS accuracy, avg(over) AS over_use, avg(under) AS under_use FROM v_judgments GROUP BY ALL)
SELECT concat_ws('/', 'eval', model, condition, name) AS tag, value FROM (UNPIVOT s ON accuracy, over_use, under_use INTO NAME name VALUE value)""")
def metric_scalars(spark, d):
    from corpuloom.plans.views import levels

    j = levels(judgments(spark, d)).groupBy("model", "condition")
    return K.scalars(j.agg(F.avg((F.col("g") == F.col("p")).cast("int")).alias("accuracy"), F.avg("over").alias("over_use"), F.avg("under").alias("under_use")), ["model", "condition"], "eval")


@query(f"""{J}, s AS (SELECT model, condition, avg((g = p)::INT) AS x FROM v_judgments GROUP BY ALL) SELECT model, max(x) FILTER (condition = 'full_memory') AS full_memory, max(x) FILTER (condition = 'no_memory') AS no_memory, max(x) FILTER (condition = 'full_memory') - max(x) FILTER (condition = 'no_memory') AS gain FROM s GROUP BY ALL""")
def paired_table(spark, d):
    """Accuracy by model, conditions side by side."""
    p = judgments(spark, d).groupBy("model").pivot("condition", list(CONDITIONS)).agg(F.avg((F.col("gold") == F.col("predicted")).cast("int")))
    return p.withColumn("gain", F.col("full_memory") - F.col("no_memory"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, i AS "row", CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS shard FROM r""")
def ordered_shards(spark, d):
    """Seven contiguous shards of the orders by key."""
    return K.with_shard(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query(f"""WITH {V_SAMPLES}, o AS (SELECT sample_id, 'replaced' AS domain FROM v_samples WHERE sample_id % 50 = 0) SELECT s.sample_id, coalesce(o.domain, s.domain) AS domain, o.sample_id IS NOT NULL AS overridden FROM v_samples s LEFT JOIN o USING (sample_id)""")
def manual_overrides(spark, d):
    s = samples(spark, d).select("sample_id", "domain")
    return V.manual_gate(s, s.where("sample_id % 50 = 0").select("sample_id", F.lit("replaced").alias("value")), "sample_id", "domain")


@query("""WITH RECURSIVE t AS (SELECT conv_id, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn FROM conversations),
f AS (SELECT conv_id, turn, i, len AS used, 0 AS chunk FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN f.used + t.len <= 400 THEN f.used + t.len ELSE t.len END, CASE WHEN f.used + t.len <= 400 THEN f.chunk ELSE f.chunk + 1 END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1)
SELECT conv_id, turn, chunk FROM f""")
def translation_chunks(spark, d):
    """Turns of a conversation in chunks of at most 400 characters, in order."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("long").alias("len")))).alias("t"))
    c = c.withColumn("chunks", V.char_budget_chunks(F.transform("t", lambda x: x["len"]), 400))
    return c.select("conv_id", F.explode(F.arrays_zip("t", "chunks")).alias("z")).select("conv_id", F.col("z.t.turn").alias("turn"), F.col("z.chunks").alias("chunk"))
