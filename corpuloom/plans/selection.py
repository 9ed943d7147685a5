"""Queries on assessing, selecting, admitting, judging and merging records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuloom.functions import text as X
from corpuloom.operators import assessment as A
from corpuloom.operators import calibration as C
from corpuloom.operators import sampling as S
from corpuloom.plans.views import J, V_ATOMS, V_ATTEMPTS, V_SAMPLES, V_SOURCES, atoms, attempts, judgments, levels, query, requests, samples, sources, v_judgments
from corpuloom.session import table

# Phrases that the view adds to invented prose, so that every rule has cases.
_QUESTIONS = (
    " I was diagnosed with asthma two years ago. Since then I take 5 mg of a tablet, but it returned. Can I avoid it?",
    " My goal is to save. I tried to stay within budget because my partner cannot afford more. What should I do?",
    " This python repository must not use pandas. Please implement a function that returns an error!!!!!!",
    "",
    " 漢字漢字漢字漢字",
)
_ANSWERS = (" Hello and welcome. Thank you for your query. I would recommend a test. Take care. Regards.", "", " return values!!")
_DOMAINS = ("health_seed", "general", "coding")


def pairs(spark, d):
    """Answers with the question before them, as records of three domains."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("q", F.lag("text").over(w)).withColumn("asked", F.lag("role").over(w)).where("role = 'assistant' and asked = 'user'")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    by = F.col("conv_id")
    return t.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(by % 17 > 0, "chat").otherwise("").alias("source_dataset"), pick(_DOMAINS, F.pmod(by, F.lit(3))).alias("domain"),
        F.concat("q", pick(_QUESTIONS, F.pmod(by, F.lit(5)))).alias("raw_question"), F.when(by % 13 > 0, F.concat("text", pick(_ANSWERS, F.pmod(F.floor(by / 5), F.lit(3))))).alias("answer"),
    )


def plain(c: str) -> str:
    """SQL of a text whose word characters beyond ASCII are underscores, so that word boundaries of ASCII patterns are those of Unicode."""
    return f"array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN unicode(x) > 127 AND regexp_matches(x, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}]') THEN '_' ELSE x END), '')"


def _quoted(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


V_PAIRS = f"""v_turns AS (SELECT *, lag(text) OVER w AS q, lag(role) OVER w AS asked FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
v_pairs AS (SELECT concat_ws('-', conv_id, turn) AS id, CASE WHEN conv_id % 17 > 0 THEN 'chat' ELSE '' END AS source_dataset, ({_list(_DOMAINS)})[conv_id % 3 + 1] AS domain,
  q || ({_list(_QUESTIONS)})[conv_id % 5 + 1] AS raw_question, CASE WHEN conv_id % 13 > 0 THEN text || ({_list(_ANSWERS)})[conv_id // 5 % 3 + 1] END AS answer FROM v_turns WHERE role = 'assistant' AND asked = 'user')"""


def _assessment_sql() -> str:
    words = lambda c: f"len(regexp_extract_all(lower({c}), '[a-z]+(?:''[a-z]+)?|[0-9]+(?:\\.[0-9]+)?'))"
    solid = lambda c: f"regexp_replace({c}, '\\s+', '', 'g')"
    bare = "a"
    for p in A.BOILERPLATE:
        bare = f"regexp_replace({bare}, {_quoted('(?i)' + p)}, ' ', 'g')"
    letters = lambda c: f"length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g'))"
    english = lambda c: f"CASE WHEN {letters(c)} > 0 THEN length(regexp_replace({c}, '[^A-Za-z]', '', 'g')) / {letters(c)} ELSE 0 END"
    count = lambda c: f"greatest(1, len(list_filter(string_split_regex({c}, {_quoted(A.SENTENCE)}), lambda x: regexp_matches(x, '\\S'))))"
    named = lambda k: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(qp), {_quoted(p)}) THEN {_quoted(n)} END" for n, p in A.SIGNALS[k].items()) + "], lambda x: x IS NOT NULL)"
    noise = lambda c: (
        f"(len(list_filter(range(1, length({c}) - 4), lambda i: lower({c})[i] <> chr(10) AND lower({c})[i:i+5] = repeat(lower({c})[i], 6))) > 0 OR length({solid(c)}) = 0"
        f" OR length(regexp_replace({solid(c)}, '[\\p{{L}}\\p{{N}}]', '', 'g')) / nullif(length({solid(c)}), 0) > CASE domain WHEN 'coding' THEN {A.MOST_PUNCTUATION_CODE}::DOUBLE ELSE {A.MOST_PUNCTUATION}::DOUBLE END)"
    )
    runs = lambda c: f"list_distinct(list_transform(range(1, len({c}) - {A.WIDTH - 2}), lambda i: array_to_string({c}[i:i+{A.WIDTH - 1}], ' ')))"
    (q_lo, q_hi), (a_lo, a_hi) = A.LIMITS["question_chars"], A.LIMITS["answer_chars"]
    rules = {
        "missing_id": "coalesce(trim(id), '') = ''", "missing_source_dataset": "coalesce(trim(source_dataset), '') = ''", "missing_raw_question": "q = ''", "missing_source_answer": "a = ''",
        "question_too_short": f"length(q) < {q_lo}", "question_too_long": f"length(q) > {q_hi}", "answer_too_short": f"length(a) < {a_lo}", "answer_too_long": f"length(a) > {a_hi}",
        "question_too_few_tokens": f"qt < {A.LIMITS['question_tokens']}", "answer_too_few_tokens": f"at_ < {A.LIMITS['answer_tokens']}", "question_language_mismatch": f"q_english < {A.LIMITS['english']}::DOUBLE",
        "answer_language_mismatch": f"a_english < {A.LIMITS['english']}::DOUBLE", "answer_boilerplate_dominated": f"stock > {A.LIMITS['boilerplate']}::DOUBLE", "text_noise": "noise", "no_memory_signal": "len(families) = 0",
        "missing_question_intent": "NOT asks", "reference_answer_in_question": f"domain = 'coding' AND contained >= {A.LEAST_CONTAINED}::DOUBLE",
    }
    reasons = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in rules.items()) + "], lambda x: x IS NOT NULL)"
    steps = " ".join(f"WHEN content >= {n} THEN {p}" for n, p in A.LENGTH_POINTS)
    return f"""WITH {V_PAIRS}, f0 AS (SELECT id, source_dataset, domain, trim(coalesce(raw_question, '')) AS q, trim(coalesce(answer, '')) AS a FROM v_pairs),
fp AS (SELECT *, {plain("q")} AS qp, {plain("a")} AS ap FROM f0),
f1 AS (SELECT *, {words("q")} AS qt, {words("a")} AS at_, {words(bare)} AS content, {count("q")} AS qs, {count("a")} AS as_, len(regexp_extract_all(qp, {_quoted("(?i)" + A.RELATION)})) AS relations,
  CASE domain WHEN 'general' THEN {named("general")} WHEN 'coding' THEN {named("coding")} ELSE {named("health_seed")} END AS families, {english("q")} AS q_english, {english("a")} AS a_english,
  contains(q, '?') OR regexp_matches(qp, {_quoted("(?i)" + A.INTENT)}) OR (domain = 'coding' AND regexp_matches(qp, {_quoted("(?i)" + A.INSTRUCTION)})) AS asks, {noise("q")} OR {noise("a")} AS noise,
  regexp_extract_all(lower(q), {_quoted(A.CODE_TOKEN)}) AS qc, regexp_extract_all(lower(a), {_quoted(A.CODE_TOKEN)}) AS ac FROM fp),
f2 AS (SELECT *, CASE WHEN at_ > 0 THEN greatest(0, 1 - content / at_) ELSE 1 END AS stock, CASE WHEN len(ac) >= {A.WIDTH} THEN len(list_intersect({runs("ac")}, {runs("qc")})) / len({runs("ac")}) ELSE 0 END AS contained FROM f1),
f3 AS (SELECT *, {reasons} AS reasons, least(25, round_even(15 * least(qt, 80) / 80, 0)::INT + 5 * (qs >= 2)::INT + 5 * (relations >= 2)::INT) AS question_informativeness,
  least(25, (CASE {steps} ELSE 0 END) + 5 * regexp_matches(ap, {_quoted("(?i)" + A.SUBSTANCE)})::INT + 5 * (as_ >= 2)::INT) AS answer_substance, ({list(A.FAMILY_POINTS)})[least(len(families) + 1, {len(A.FAMILY_POINTS)})] AS memory_suitability,
  4 * (q_english >= 0.9::DOUBLE AND a_english >= 0.9::DOUBLE)::INT + 3 * (stock <= 0.25)::INT + 3 * (NOT noise)::INT AS cleanliness_coherence,
  least(len(families), 6) + (qt >= 50)::INT + (qt >= 100)::INT + (qs >= 3)::INT + (relations >= 2)::INT AS complexity_points FROM f2),
f4 AS (SELECT *, least(100, question_informativeness + answer_substance + memory_suitability + cleanliness_coherence) AS quality_score FROM f3),
v_assessed AS (SELECT id, domain, reasons, question_informativeness, answer_substance, memory_suitability, cleanliness_coherence, quality_score, families, complexity_points,
  CASE WHEN complexity_points <= 3 THEN 'simple' WHEN complexity_points <= 6 THEN 'medium' ELSE 'complex' END AS complexity,
  CASE WHEN len(reasons) > 0 THEN 'rejected_hard_filter' WHEN quality_score < {A.LIMITS["score"]} THEN 'rejected_quality_score' ELSE 'eligible' END AS status FROM f4)"""


_ASSESSED = _assessment_sql()
_INTS = ("question_informativeness", "answer_substance", "memory_suitability", "cleanliness_coherence", "quality_score", "complexity_points")


@query(f"{_ASSESSED} SELECT * REPLACE ({', '.join(f'{c}::BIGINT AS {c}' for c in _INTS)}) FROM v_assessed")
def source_quality(spark, d):
    """Each record's reasons against it, quality score with its parts, signals, complexity and status."""
    return A.assess(pairs(spark, d)).withColumns({c: F.col(c).cast("long") for c in _INTS})


@query(f"{_ASSESSED} SELECT domain, status, complexity, count(*) AS n, avg(quality_score) AS mean_score, count(*) FILTER (list_contains(reasons, 'text_noise')) AS noisy FROM v_assessed GROUP BY ALL")
def assessment_summary(spark, d):
    a = A.assess(pairs(spark, d))
    return a.groupBy("domain", "status", "complexity").agg(F.count(F.lit(1)).alias("n"), F.avg("quality_score").alias("mean_score"), F.count_if(F.array_contains("reasons", "text_noise")).alias("noisy"))


@query(f"""WITH {V_SAMPLES}, c AS (SELECT domain, difficulty, count(*) AS n FROM v_samples GROUP BY ALL), w AS (SELECT *, sqrt(n) / sum(sqrt(n)) OVER () AS share, least(700, sum(n) OVER ()) AS total FROM c),
f AS (SELECT *, least(n, floor(total * share))::BIGINT AS base, floor(total * share) - total * share AS rest FROM w), s AS (SELECT *, n - base AS spare, total - sum(base) OVER () AS open FROM f),
g AS (SELECT *, sum(least(spare, t)) OVER (PARTITION BY t) AS given FROM s CROSS JOIN (SELECT unnest(range(0, 701)) AS t)), h AS (SELECT max(t) AS t, arg_max(open - given, t) AS odd FROM g WHERE given <= open)
SELECT domain, difficulty, n, (base + least(spare, h.t) + (spare > h.t AND row_number() OVER (ORDER BY spare <= h.t, rest, domain, difficulty) <= h.odd)::INT)::BIGINT AS quota FROM s CROSS JOIN h""")
def capacity_quotas(spark, d):
    """700 places over the cells by the square root of their size, none above it."""
    c = samples(spark, d).groupBy("domain", "difficulty").agg(F.count(F.lit(1)).alias("n"))
    return S.capacity_quota(c, 700, F.sqrt("n"), ["domain", "difficulty"])


@query(f"{_ASSESSED} SELECT id, CASE WHEN status = 'eligible' AND quality_score >= 80 THEN 'strict' WHEN status = 'eligible' THEN 'review' ELSE 'reject' END AS state FROM v_assessed")
def admission_states(spark, d):
    a = A.assess(pairs(spark, d))
    return a.select("id", F.when((F.col("status") == "eligible") & (F.col("quality_score") >= 80), "strict").when(F.col("status") == "eligible", "review").otherwise("reject").alias("state"))


_HASHED = "sha256(concat_ws(':', '{0}', {1}))"


@query(f"""{_ASSESSED}, t AS (SELECT id, domain, (quality_score < 80)::INT AS tier FROM v_assessed WHERE status = 'eligible'), r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY tier, {_HASHED.format('release', 'id')}, id) AS place FROM t)
SELECT id, domain, CASE tier WHEN 0 THEN 'strict' ELSE 'review' END AS tier, place FROM r WHERE place <= 12""")
def release_selection(spark, d):
    """Strict records first, records under review fill what is open, twelve for each domain."""
    a = A.assess(pairs(spark, d)).where("status = 'eligible'").select("id", "domain", (F.col("quality_score") < 80).cast("int").alias("tier"))
    w = Window.partitionBy("domain").orderBy("tier", F.sha2(F.concat_ws(":", F.lit("release"), "id"), 256), "id")
    out = a.withColumn("place", F.row_number().over(w)).where("place <= 12")
    return out.select("id", "domain", F.when(F.col("tier") == 0, "strict").otherwise("review").alias("tier"), F.col("place").cast("long").alias("place"))


@query(f"""{J}, {v_judgments('v_second', 'second')}, s AS (SELECT sample_id, model, min((a.p = a.g)::INT) AS first_strict, min((b.p = b.g)::INT) AS second_strict FROM v_judgments a JOIN v_second b USING (sample_id, atom_id, model, condition) GROUP BY ALL)
SELECT sample_id, model, CASE WHEN first_strict = 1 AND second_strict = 1 THEN 'admitted' WHEN first_strict = 1 OR second_strict = 1 THEN 'disputed' ELSE 'rejected' END AS decision FROM s""")
def dual_judge_admission(spark, d):
    """An answer is admitted if both judges find every atom right."""
    j = levels(judgments(spark, d, also="second"))
    both = j.groupBy("sample_id", "model").agg(F.min((F.col("p") == F.col("g")).cast("int")).alias("a"), F.min((F.col("also") == F.col("gold")).cast("int")).alias("b"))
    decision = F.when(F.col("a") + F.col("b") == 2, "admitted").when(F.col("a") + F.col("b") == 1, "disputed").otherwise("rejected")
    return both.select("sample_id", "model", decision.alias("decision"))


@query(f"""{J}, {v_judgments('v_second', 'second')} SELECT sample_id, atom_id, model, condition, a.predicted AS was, b.predicted AS now FROM v_judgments a JOIN v_second b USING (sample_id, atom_id, model, condition) WHERE a.predicted <> b.predicted AND condition = 'no_memory'""")
def label_changes(spark, d):
    """Atoms whose label differs between two rounds, without memory."""
    j = judgments(spark, d, also="second").where("condition = 'no_memory' and predicted <> also")
    return j.select("sample_id", "atom_id", "model", "condition", F.col("predicted").alias("was"), F.col("also").alias("now"))


_ALIAS = {("C", "correct_bounded_use"): "correct_control", ("C", "correct_suppression"): "under_use", ("A", "correct_control"): "over_use", ("B", "partial_under_use"): "under_use"}
_RIGHT = {"A": "correct_suppression", "B": "correct_bounded_use", "C": "correct_control"}
_RAW = "(['correct_control', 'correct_bounded_use', 'correct_suppression', 'partial_under_use'])[h % 4 + 1]"


@query(f"""{J}, v AS (SELECT sample_id, atom_id, model, condition, gold, g, p, {_RAW} AS raw FROM v_judgments), n AS (SELECT *, CASE {" ".join(f"WHEN gold = '{g}' AND raw = '{v}' THEN '{t}'" for (g, v), t in _ALIAS.items())} ELSE raw END AS verdict,
  CASE WHEN p > g THEN 'over_use' WHEN p < g THEN 'under_use' ELSE (['correct_suppression', 'correct_bounded_use', 'correct_control'])[g + 1] END AS derived FROM v)
SELECT model, condition, gold, raw, verdict, derived, count(*) AS n, count(*) FILTER (verdict <> raw) AS aliased, count(*) FILTER (derived <> verdict) AS repaired FROM n GROUP BY ALL""")
def verdict_repairs(spark, d):
    """Verdicts after aliases, those that the predicted levels give, and how many each step repairs."""
    j = levels(judgments(spark, d))
    raw = F.element_at(F.array(*map(F.lit, ("correct_control", "correct_bounded_use", "correct_suppression", "partial_under_use"))), (F.pmod("h", F.lit(4)) + 1).cast("int"))
    j = j.withColumn("raw", raw)
    verdict = None
    for (gold, name), to in _ALIAS.items():
        hit = (F.col("gold") == gold) & (F.col("raw") == name)
        verdict = F.when(hit, to) if verdict is None else verdict.when(hit, to)
    right = F.create_map(*[F.lit(x) for kv in _RIGHT.items() for x in kv])[F.col("gold")]
    j = j.withColumn("verdict", verdict.otherwise(F.col("raw"))).withColumn("derived", F.when(F.col("p") > F.col("g"), "over_use").when(F.col("p") < F.col("g"), "under_use").otherwise(right))
    return j.groupBy("model", "condition", "gold", "raw", "verdict", "derived").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") != F.col("raw")).alias("aliased"), F.count_if(F.col("derived") != F.col("verdict")).alias("repaired")
    )


@query(f"""{J}, b AS (SELECT sample_id, block, count(*) AS n FROM v_atoms GROUP BY ALL), m AS (SELECT sample_id, max(n) AS most, count(*) FILTER (n > 2) AS large, sum(n) AS atoms FROM b WHERE block > 0 GROUP BY ALL)
SELECT sample_id, most <= 4 AND large <= 1 AS level_one, most::BIGINT AS most, atoms::BIGINT AS atoms FROM m""")
def level_one_records(spark, d):
    """Records whose blocks, but for the first, have four atoms at most, and at most one of them more than two."""
    b = atoms(spark, d).where("block > 0").groupBy("sample_id", "block").agg(F.count(F.lit(1)).alias("n"))
    m = b.groupBy("sample_id").agg(F.max("n").alias("most"), F.count_if(F.col("n") > 2).alias("large"), F.sum("n").alias("atoms"))
    return m.select("sample_id", ((F.col("most") <= 4) & (F.col("large") <= 1)).alias("level_one"), "most", "atoms")


@query(f"""WITH {V_ATOMS}, a AS (SELECT DISTINCT sample_id, block, atom_id, gold FROM v_atoms) SELECT x.sample_id, x.block, x.atom_id AS left_atom, y.atom_id AS right_atom, CASE WHEN x.gold = y.gold THEN 'same' ELSE 'different' END AS relation
FROM a x JOIN a y ON x.sample_id = y.sample_id AND x.block = y.block AND x.atom_id < y.atom_id""")
def atom_pair_matrix(spark, d):
    """All unordered pairs of a block's atoms, within one row per block: a block has a few atoms."""
    a = atoms(spark, d).select("sample_id", "block", F.struct("atom_id", "gold").alias("a")).distinct()
    blocks = a.groupBy("sample_id", "block").agg(F.collect_list("a").alias("m"))
    p = blocks.select("sample_id", "block", "m", F.explode("m").alias("x")).select("sample_id", "block", "x", F.explode("m").alias("y")).where("x.atom_id < y.atom_id")
    return p.select("sample_id", "block", F.col("x.atom_id").alias("left_atom"), F.col("y.atom_id").alias("right_atom"), F.when(F.col("x.gold") == F.col("y.gold"), "same").otherwise("different").alias("relation"))


@query(f"""WITH {V_ATTEMPTS}, g AS (SELECT request_id, count(*) AS rows_, count(*) FILTER (state = 'valid') AS valid, max(tokens) AS tokens FROM v_attempts GROUP BY ALL),
c AS (SELECT r.request_id, CASE WHEN g.request_id IS NULL THEN 'missing' WHEN valid = 0 THEN 'invalid' WHEN rows_ > 1 THEN 'repeated' ELSE 'ok' END AS state, coalesce(valid, 0) AS valid FROM v_requests r LEFT JOIN g USING (request_id))
SELECT state, count(*) AS requests, sum(valid)::BIGINT AS valid, count(*) / sum(count(*)) OVER () AS share FROM c GROUP BY state""")
def result_file_summary(spark, d):
    """Requests without a result, without a valid one, with several and with one."""
    per = attempts(spark, d).groupBy("request_id").agg(F.count(F.lit(1)).alias("rows_"), F.count_if(F.col("state") == "valid").alias("valid"))
    all_ = requests(spark, d).select("request_id").join(per, "request_id", "left")
    state = F.when(F.col("rows_").isNull(), "missing").when(F.col("valid") == 0, "invalid").when(F.col("rows_") > 1, "repeated").otherwise("ok")
    out = all_.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"))
    return out.withColumn("share", F.col("requests") / F.sum("requests").over(Window.partitionBy(F.lit(0))))


@query(f"""{J}, {v_judgments('v_second', 'second')}, b AS (SELECT a.model, a.condition, a.p, b.p AS q, (hash_ % 100 < 97) AS both_scorable FROM (SELECT *, ('0x' || substr(sha256(concat_ws(':', 'scored', sample_id, atom_id, model)), 1, 15))::BIGINT AS hash_ FROM v_judgments) a JOIN v_second b USING (sample_id, atom_id, model, condition)),
s AS (SELECT 'model' AS field, model AS slice, p, q, both_scorable FROM b UNION ALL SELECT 'condition', condition, p, q, both_scorable FROM b UNION ALL SELECT 'all', 'all', p, q, both_scorable FROM b),
w AS (SELECT field, slice, count(*)::DOUBLE AS n, avg(both_scorable::INT) AS scorable, avg((p = q)::INT) AS exact, sum(abs(p - q))::DOUBLE AS apart, {", ".join(f"(count(*) FILTER (p={x}))::DOUBLE AS r{x}, (count(*) FILTER (q={x}))::DOUBLE AS c{x}" for x in range(3))} FROM s GROUP BY ALL),
k AS (SELECT *, 1 - (apart / n) / nullif(({" + ".join(f"{abs(x - y)} * r{x} * c{y}" for x in range(3) for y in range(3) if x != y)}) / (n * n), 0) AS kappa FROM w)
SELECT field, slice, n::BIGINT AS n, exact, kappa, scorable, exact >= 0.8::DOUBLE AND kappa >= 0.7::DOUBLE AND scorable >= 0.95::DOUBLE AS passes, n >= 50 AND (exact < 0.8::DOUBLE OR kappa < 0.7::DOUBLE) AS flagged FROM k""")
def calibration_gate(spark, d):
    """Agreement of two judges, of all and by slice, against the gate's bounds."""
    from corpuloom.plans.views import hash_int, level_of

    j = levels(judgments(spark, d, also="second")).withColumn("q", level_of("also")).withColumn("ok", (F.pmod(hash_int(F.lit("scored"), "sample_id", "atom_id", "model"), F.lit(100)) < 97).cast("int"))
    cells = j.groupBy("model", "condition", "p", "q").agg(F.count(F.lit(1)).alias("k"), F.sum("ok").alias("ok"))
    # Slices are sums over a few cells.
    slices = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("slice")) for f, v in (("model", F.col("model")), ("condition", F.col("condition")), ("all", F.lit("all")))])
    s = cells.withColumn("s", F.explode(slices)).groupBy("s.field", "s.slice").agg(
        F.sum("k").alias("n"), (F.sum("ok") / F.sum("k")).alias("scorable"), (F.sum(F.when(F.col("p") == F.col("q"), F.col("k")).otherwise(0)) / F.sum("k")).alias("exact"), F.sum(F.abs(F.col("p") - F.col("q")) * F.col("k")).alias("apart"),
        *[F.sum(F.when(F.col(c) == x, F.col("k")).otherwise(0)).cast("double").alias(f"{c}{x}") for c in "pq" for x in range(3)],
    )
    chance = sum((abs(x - y) * F.col(f"p{x}") * F.col(f"q{y}") for x in range(3) for y in range(3) if x != y), F.lit(0.0))
    s = s.withColumn("kappa", 1 - F.try_divide(F.col("apart") / F.col("n"), chance / (F.col("n") * F.col("n"))))
    return s.select(
        "field", "slice", "n", "exact", "kappa", "scorable", ((F.col("exact") >= 0.8) & (F.col("kappa") >= 0.7) & (F.col("scorable") >= 0.95)).alias("passes"),
        ((F.col("n") >= 50) & ((F.col("exact") < 0.8) | (F.col("kappa") < 0.7))).alias("flagged"),
    )


@query(f"""WITH {V_ATOMS}, {V_SAMPLES}, a AS (SELECT sample_id, count(*) AS atoms, count(DISTINCT block) AS blocks, count(DISTINCT gold) > 1 AS mixed, {", ".join(f"count(*) FILTER (gold = '{g}') AS {g.lower()}" for g in "ABC")} FROM v_atoms GROUP BY ALL)
SELECT domain, count(*) AS samples, coalesce(sum(blocks), 0)::BIGINT AS blocks, coalesce(sum(atoms), 0)::BIGINT AS atoms, count(*) FILTER (mixed) AS mixed, coalesce(sum(a), 0)::BIGINT AS a, coalesce(sum(b), 0)::BIGINT AS b, coalesce(sum(c), 0)::BIGINT AS c FROM v_samples LEFT JOIN a USING (sample_id) GROUP BY domain""")
def release_counts(spark, d):
    """Samples, blocks, atoms, mixed samples and labels of each domain."""
    a = atoms(spark, d).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("atoms"), F.count_distinct("block").alias("blocks"), (F.min(F.ascii("gold")) != F.max(F.ascii("gold"))).alias("mixed"), *[F.count_if(F.col("gold") == g).alias(g.lower()) for g in "ABC"]
    )
    out = samples(spark, d).select("sample_id", "domain").join(a, "sample_id", "left").groupBy("domain")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return out.agg(F.count(F.lit(1)).alias("samples"), total("blocks"), total("atoms"), F.count_if("mixed").alias("mixed"), total("a"), total("b"), total("c"))


@query(f"""WITH {V_ATOMS}, {V_SAMPLES}, n AS (SELECT sample_id, count(*) AS atoms FROM v_atoms GROUP BY ALL), s AS (SELECT s.sample_id, domain, coalesce(atoms, 0) AS atoms, 1 + s.sample_id % 8 AS declared FROM v_samples s LEFT JOIN n USING (sample_id))
SELECT domain, count(*) AS samples, count(*) FILTER (atoms = declared) AS equal, count(*) FILTER (atoms < declared) AS short, count(*) FILTER (atoms > declared) AS long, sum(abs(atoms - declared))::BIGINT AS apart FROM s GROUP BY ALL""")
def count_reconciliation(spark, d):
    """Counted atoms against declared ones."""
    n = atoms(spark, d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("atoms"))
    s = samples(spark, d).select("sample_id", "domain", (F.col("sample_id") % 8 + 1).alias("declared")).join(n, "sample_id", "left").withColumn("atoms", F.coalesce("atoms", F.lit(0)))
    a, b = F.col("atoms"), F.col("declared")
    return s.groupBy("domain").agg(F.count(F.lit(1)).alias("samples"), F.count_if(a == b).alias("equal"), F.count_if(a < b).alias("short"), F.count_if(a > b).alias("long"), F.sum(F.abs(a - b)).alias("apart"))


@query(f"""WITH {V_SAMPLES}, o AS (SELECT sample_id, domain, row_number() OVER (PARTITION BY domain ORDER BY {_HASHED.format('second', 'sample_id')}, sample_id) AS rank, count(*) OVER (PARTITION BY domain) AS n FROM v_samples)
SELECT sample_id, domain, rank <= ceil(n * 0.1::DOUBLE) AS second_judge FROM o""")
def secondary_judge_sample(spark, d):
    """A tenth of each domain, rounded up, goes to a second judge."""
    s = samples(spark, d).select("sample_id", "domain")
    r = S.spread_rank(s, "second", "sample_id", ["domain"]).join(s.groupBy("domain").agg(F.count(F.lit(1)).alias("n")), "domain")
    return r.select("sample_id", "domain", (F.col("rank") <= F.ceil(F.col("n") * 0.1)).alias("second_judge"))


@query(f"""{J}, a AS (SELECT sample_id, model, count(DISTINCT condition) AS k FROM v_judgments GROUP BY ALL HAVING k = 2), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY {_HASHED.format('pairs', 'sample_id')}, sample_id) AS rank FROM a) SELECT sample_id, model, rank FROM r WHERE rank <= 25""")
def paired_calibration_sample(spark, d):
    """25 samples of each model that were answered under both conditions; the limit is the sample."""
    flag = lambda c: F.max((F.col("condition") == c).cast("int"))
    a = judgments(spark, d).groupBy("sample_id", "model").agg((flag("full_memory") + flag("no_memory")).alias("k")).where("k = 2").select("sample_id", "model")
    return S.stratified(a, "pairs", "sample_id", ["model"], 25).select("sample_id", "model", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {V_SAMPLES}, r AS (SELECT sample_id, domain, difficulty, row_number() OVER (PARTITION BY domain, difficulty ORDER BY {_HASHED.format('channel', 'sample_id')}, sample_id) AS i, {_HASHED.format('channel', 'sample_id')} AS h FROM v_samples),
p AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY i > 1, h, sample_id) AS place FROM r) SELECT sample_id, domain, difficulty, place FROM p WHERE place <= 8""")
def channel_diverse_sample(spark, d):
    """Of each domain eight samples: one of each difficulty first, the rest by hash."""
    h = F.sha2(F.concat_ws(":", F.lit("channel"), "sample_id"), 256)
    s = samples(spark, d).select("sample_id", "domain", "difficulty", h.alias("h"))
    # No more than eight of a difficulty can be among the eight of a domain.
    s = s.withColumn("i", F.row_number().over(Window.partitionBy("domain", "difficulty").orderBy("h", "sample_id"))).where("i <= 8")
    s = s.withColumn("place", F.row_number().over(Window.partitionBy("domain").orderBy(F.col("i") > 1, "h", "sample_id"))).where("place <= 8")
    return s.select("sample_id", "domain", "difficulty", F.col("place").cast("long").alias("place"))


@query(f"""WITH {V_SAMPLES} SELECT sample_id, row_number() OVER (ORDER BY {_HASHED.format('final', 'sample_id')}, sample_id) AS position FROM v_samples""")
def seeded_shuffle(spark, d):
    """All samples in the order of a seeded hash, numbered by range partitions."""
    s = S.spread_rank(samples(spark, d).select("sample_id", F.lit(0).alias("all")), "final", "sample_id", ["all"])
    return s.select("sample_id", F.col("rank").cast("long").alias("position"))


@query(f"""WITH {V_SAMPLES}, {V_ATOMS}, b AS (SELECT sample_id, block, string_agg(DISTINCT atom_id, '|' ORDER BY atom_id) AS atom_ids, string_agg(DISTINCT gold, '+' ORDER BY gold) AS profile FROM v_atoms GROUP BY ALL)
SELECT s.sample_id, block, atom_ids, 'memory ' || block || ': ' || len(string_split(atom_ids, '|')) || ' atoms' AS shown, profile AS hidden_profile, difficulty AS hidden_difficulty FROM v_samples s JOIN b USING (sample_id)""")
def answer_views(spark, d):
    """What a model is shown of each block, beside what only the evaluator sees."""
    ids = F.array_sort(F.collect_set("atom_id"))
    b = atoms(spark, d).groupBy("sample_id", "block").agg(ids.alias("ids"), X.label_profile(F.collect_set("gold")).alias("hidden_profile"))
    s = samples(spark, d).select("sample_id", F.col("difficulty").alias("hidden_difficulty")).join(b, "sample_id")
    shown = F.concat(F.lit("memory "), F.col("block").cast("string"), F.lit(": "), F.size("ids").cast("string"), F.lit(" atoms"))
    return s.select("sample_id", "block", F.array_join("ids", "|").alias("atom_ids"), shown.alias("shown"), "hidden_profile", "hidden_difficulty")


@query(f"""WITH {V_PAIRS} SELECT id, to_json([{{'role': 'user', 'content': raw_question, 'loss': false}}, {{'role': 'assistant', 'content': trim(answer), 'loss': true}}])::VARCHAR AS messages FROM v_pairs WHERE answer IS NOT NULL""")
def training_messages(spark, d):
    """Messages for training: only the assistant's count."""
    m = lambda role, c, loss: F.struct(F.lit(role).alias("role"), c.alias("content"), F.lit(loss).alias("loss"))
    p = pairs(spark, d).where("answer is not null")
    return p.select("id", F.to_json(F.array(m("user", F.col("raw_question"), False), m("assistant", F.trim("answer"), True))).alias("messages"))


@query(f"""WITH {V_SOURCES}, {V_SAMPLES}, m AS (SELECT id, source_dataset, CASE WHEN length(raw_question) >= 400 THEN 'complex' ELSE 'simple' END AS complexity FROM v_source)
SELECT sample_id, coalesce(complexity, 'unknown') AS complexity, coalesce(source_dataset, 'unknown') AS source_dataset FROM v_samples LEFT JOIN m ON m.id = sample_id""")
def metadata_backfill(spark, d):
    """Each sample with its source's metadata, unknown where it has none."""
    m = sources(spark, d).select(F.col("id").alias("sample_id"), "source_dataset", F.when(F.length("raw_question") >= 400, "complex").otherwise("simple").alias("complexity"))
    return samples(spark, d).select("sample_id").join(m, "sample_id", "left").select("sample_id", F.coalesce("complexity", F.lit("unknown")).alias("complexity"), F.coalesce("source_dataset", F.lit("unknown")).alias("source_dataset"))


@query(f"""WITH {V_SAMPLES}, a AS (SELECT sample_id, CASE sample_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'review' ELSE 'pass' END AS verdict FROM v_samples WHERE sample_id % 9 > 0), b AS (SELECT sample_id, CASE sample_id % 5 WHEN 0 THEN 'fail' ELSE 'pass' END AS verdict FROM v_samples WHERE sample_id % 7 > 0),
j AS (SELECT s.sample_id, coalesce(a.verdict, 'invalid') AS first, coalesce(b.verdict, 'invalid') AS second FROM v_samples s LEFT JOIN a USING (sample_id) LEFT JOIN b USING (sample_id))
SELECT *, CASE WHEN first = 'invalid' OR second = 'invalid' THEN 'invalid' WHEN first = second THEN first WHEN first = 'fail' OR second = 'fail' THEN 'fail' ELSE 'review' END AS consensus FROM j""")
def judge_consensus(spark, d):
    """Two partial sets of verdicts over all samples; a missing one is invalid, the worse one holds."""
    s = samples(spark, d).select("sample_id")
    v = F.col("sample_id")
    a = s.where(v % 9 > 0).select("sample_id", F.when(v % 4 == 0, "fail").when(v % 4 == 1, "review").otherwise("pass").alias("first"))
    b = s.where(v % 7 > 0).select("sample_id", F.when(v % 5 == 0, "fail").otherwise("pass").alias("second"))
    j = s.join(a, "sample_id", "left").join(b, "sample_id", "left").select("sample_id", F.coalesce("first", F.lit("invalid")).alias("first"), F.coalesce("second", F.lit("invalid")).alias("second"))
    x, y = F.col("first"), F.col("second")
    return j.withColumn("consensus", F.when((x == "invalid") | (y == "invalid"), "invalid").when(x == y, x).when((x == "fail") | (y == "fail"), "fail").otherwise("review"))


@query(f"""WITH {V_ATTEMPTS}, o AS (SELECT request_id, row_number() OVER (ORDER BY fingerprint) AS place FROM v_requests), a AS (SELECT request_id, 'first' AS part, tokens FROM v_attempts WHERE attempt = 1 AND state = 'valid'),
b AS (SELECT request_id, 'repair' AS part, tokens FROM v_attempts WHERE attempt = 2 AND state = 'valid' AND request_id NOT IN (SELECT request_id FROM a)), u AS (FROM a UNION ALL FROM b)
SELECT place, request_id, coalesce(part, 'missing') AS part, tokens FROM o LEFT JOIN u USING (request_id)""")
def ordered_cover(spark, d):
    """First results and their repairs, disjoint, in the order of the target list; what neither covers is missing."""
    t = attempts(spark, d).where("state = 'valid'")
    a = t.where("attempt = 1").select("request_id", F.lit("first").alias("part"), "tokens")
    b = t.where("attempt = 2").join(a.select("request_id"), "request_id", "left_anti").select("request_id", F.lit("repair").alias("part"), "tokens")
    place = S.ordered_place(requests(spark, d).select("request_id", "fingerprint"), ["fingerprint"])
    return place.join(a.unionByName(b), "request_id", "left").select("place", "request_id", F.coalesce("part", F.lit("missing")).alias("part"), "tokens")


@query(f"""WITH {V_PAIRS}, x AS (SELECT id, trim(regexp_replace(lower(regexp_replace(raw_question, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), '\\s+', ' ', 'g')) AS l, trim(regexp_replace(lower(regexp_replace(coalesce(answer, ''), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), '\\s+', ' ', 'g')) AS r FROM v_pairs),
u AS (SELECT *, {", ".join(f"list_distinct(CASE WHEN regexp_matches({c}, '[㐀-鿿]') THEN list_transform(range(1, greatest(2, length(replace({c}, ' ', '')))), lambda i: substr(replace({c}, ' ', ''), i, 2)) ELSE list_filter(string_split({c}, ' '), lambda w: length(w) > 2) END) AS {c}u" for c in "lr")} FROM x)
SELECT id, CASE WHEN l = '' OR r = '' THEN 0.0::DOUBLE WHEN contains(l, r) OR contains(r, l) THEN 1.0::DOUBLE ELSE coalesce(len(list_intersect(lu, ru)) / nullif(len(list_distinct(list_concat(lu, ru))), 0), 0) END AS similarity FROM u""")
def question_answer_overlap(spark, d):
    return pairs(spark, d).select("id", A.overlap_similarity(F.col("raw_question"), F.col("answer")).alias("similarity"))


@query(f"""{J}, c AS (SELECT model, condition, sum(over)::BIGINT AS over_budget, sum(under)::BIGINT AS under_budget, count(DISTINCT sample_id) AS samples, count(*) AS atoms, count(*) FILTER (g <> p) AS wrong FROM v_judgments GROUP BY ALL),
o AS (SELECT count(DISTINCT model) AS models, min(1 - wrong / atoms) AS lowest, max(1 - wrong / atoms) - min(1 - wrong / atoms) AS spread FROM c)
SELECT c.*, models >= 5 AS enough_models, spread < 0.02::DOUBLE AS narrow_spread FROM c CROSS JOIN o""")
def benchmark_validity(spark, d):
    """Budgets by model and condition, and whether the benchmark tells enough models apart."""
    j = levels(judgments(spark, d))
    per = j.groupBy("model", "condition", "sample_id").agg(F.sum("over").alias("o"), F.sum("under").alias("u"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("g") != F.col("p")).alias("w"))
    c = per.groupBy("model", "condition").agg(F.sum("o").alias("over_budget"), F.sum("u").alias("under_budget"), F.count(F.lit(1)).alias("samples"), F.sum("k").alias("atoms"), F.sum("w").alias("wrong"))
    right = 1 - F.col("wrong") / F.col("atoms")
    every = Window.partitionBy(F.lit(0))  # models times conditions
    c = c.withColumn("enough_models", F.size(F.collect_set("model").over(every)) >= 5).withColumn("narrow_spread", F.max(right).over(every) - F.min(right).over(every) < 0.02)
    return c
