"""Queries on grounding, leakage, source texts, sets of results and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuloom.functions import text as X
from corpuloom.operators import merges as M
from corpuloom.operators import validation as V
from corpuloom.operators.latent import overlap_components
from corpuloom.plans.selection import V_PAIRS, pairs, plain
from corpuloom.plans.views import J, V_ATOMS, V_ATTEMPTS, V_SAMPLES, V_SOURCES, atoms, attempts, judgments, query, requests, samples, sources
from corpuloom.session import table
from corpuloom.streaming import resume as I

_NORM = r"lower(trim(regexp_replace(coalesce({0}, ''), '[ \t\n\r\f\x0B]+', ' ', 'g')))"
_TOKENS = r"regexp_extract_all(lower({0}), '[a-z]+(?:''[a-z]+)?|[0-9]+(?:\.[0-9]+)?')"

# Evidence of three kinds: the start of an answer with wider spaces, two parts of it around an ellipsis, and words that it does not hold.
V_EVIDENCE = f"""{V_PAIRS}, v_evidence AS (SELECT id, answer, CASE length(id) % 3 WHEN 0 THEN replace(substr(answer, 1, 30), ' ', '  ') WHEN 1 THEN substr(answer, 1, 20) || ' ... ' || substr(answer, 40, 20) ELSE 'no such ' || substr(answer, 1, 12) END AS quote FROM v_pairs WHERE answer IS NOT NULL)"""


def evidence(spark, d):
    a = F.col("answer")
    kind = F.length("id") % 3
    quote = F.when(kind == 0, F.replace(F.substring(a, 1, 30), F.lit(" "), F.lit("  "))).when(kind == 1, F.concat(F.substring(a, 1, 20), F.lit(" ... "), F.substring(a, 40, 20))).otherwise(F.concat(F.lit("no such "), F.substring(a, 1, 12)))
    return pairs(spark, d).where("answer is not null").select("id", "answer", quote.alias("quote"))


@query(f"""WITH RECURSIVE {V_EVIDENCE}, n AS (SELECT id, {_NORM.format('answer')} AS text, {_NORM.format('quote')} AS q FROM v_evidence),
p AS (SELECT id, text, q, list_filter(list_transform(string_split_regex(q, '\\.\\.\\.|…'), lambda x: trim(x)), lambda x: length(x) >= 4) AS parts FROM n),
w AS (SELECT id, 0 AS i, 1 AS at_ FROM p UNION ALL SELECT w.id, i + 1, CASE WHEN instr(substr(text, at_), parts[i + 1]) > 0 THEN at_ + instr(substr(text, at_), parts[i + 1]) - 1 + length(parts[i + 1]) ELSE 0 END FROM w JOIN p USING (id) WHERE at_ > 0 AND i < len(parts))
SELECT p.id, q <> '' AND contains(text, q) AS whole, len(parts) > 0 AND (SELECT min(at_) FROM w WHERE w.id = p.id) > 0 AS in_order FROM p""")
def evidence_grounding(spark, d):
    """Whether a quote is in its answer, whole, or in parts between ellipses that follow each other."""
    e = evidence(spark, d)
    return e.select("id", X.grounded(F.col("quote"), F.col("answer")).alias("whole"), X.grounded_in_order(F.col("quote"), F.col("answer")).alias("in_order"))


_GRAMS5 = "list_transform(range(1, len({0}) - 3), lambda i: array_to_string({0}[i:i+4], ' '))"


@query(f"""WITH {V_PAIRS}, t AS (SELECT id, raw_question AS q, CASE length(id) % 2 WHEN 0 THEN substr(raw_question, 10, 60) ELSE coalesce(answer, '') END AS m FROM v_pairs),
w AS (SELECT *, {_TOKENS.format('q')} AS qt, {_TOKENS.format('m')} AS mt, {_NORM.format('m')} AS mn, {_NORM.format('q')} AS qn FROM t)
SELECT id, (mn <> '' AND contains(qn, mn)) OR len(list_intersect(CASE WHEN len(qt) >= 5 THEN {_GRAMS5.format('qt')} ELSE [] END, CASE WHEN len(mt) >= 5 THEN {_GRAMS5.format('mt')} ELSE [] END)) > 0
  OR (len(list_distinct(mt)) >= 4 AND len(list_intersect(list_distinct(qt), list_distinct(mt))) / len(list_distinct(mt)) >= 0.65::DOUBLE) AS leaks FROM w""")
def question_leakage(spark, d):
    """Whether a question gives a memory away, whole, by five words in a row, or by most of its words."""
    p = pairs(spark, d)
    memory = F.when(F.length("id") % 2 == 0, F.substring("raw_question", 10, 60)).otherwise(F.coalesce("answer", F.lit("")))
    p = p.select("id", "raw_question", memory.alias("m"))
    # Exploding one row of all columns keeps the tokens from being computed again for each run of words.
    row = F.struct("id", "raw_question", "m", X.tokens(F.col("raw_question")).alias("q_words"), X.tokens(F.col("m")).alias("m_words"))
    p = p.select(F.explode(F.array(row)).alias("r")).select("r.*")
    leak = X.word_leak(F.col("raw_question"), F.col("m"), F.col("q_words"), F.col("m_words"))
    return p.select("id", leak.alias("leaks"))


_TOPICS = (("care", ("tablet", "asthma", "test")), ("money", ("budget", "afford", "save")), ("code", ("python", "function", "return")))


@query(f"""WITH {V_PAIRS} SELECT id, CASE {" ".join(f"WHEN {' OR '.join(f'contains(lower(raw_question), {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in _TOPICS)} ELSE 'other' END AS by_word,
  CASE {" ".join(f"WHEN regexp_matches({plain('lower(raw_question)')}, '\\b({'|'.join(ws)})\\b') THEN '{n}'" for n, ws in _TOPICS)} ELSE 'other' END AS by_pattern FROM v_pairs""")
def topic_rules(spark, d):
    """Topics by the first rule with a keyword in the text, and by the first whose pattern matches."""
    p = pairs(spark, d)
    q = F.col("raw_question")
    return p.select("id", X.first_keyword(q, [(n, list(w)) for n, w in _TOPICS], "other").alias("by_word"), X.first_hit(q, [(n, rf"\b({'|'.join(w)})\b") for n, w in _TOPICS], "other").alias("by_pattern"))


_STOP = ("the", "and", "of", "to", "in")


@query(f"""WITH {V_SOURCES}, t AS (SELECT id, regexp_replace(regexp_replace(raw_question || chr(13) || chr(10) || '  ' || chr(10) || chr(10) || chr(10) || 'end', '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g') AS c FROM v_source),
n AS (SELECT id, regexp_replace(regexp_replace(c, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS c FROM t)
SELECT id, md5(c) AS clean_md5, length(c) AS chars, len(list_filter(list_distinct({_TOKENS.format('c')}), lambda x: x NOT IN {_STOP}))::BIGINT AS content_words FROM n""")
def source_texts(spark, d):
    """Cleaned source texts and how many different words, stop words aside, they hold."""
    s = sources(spark, d).select("id", F.concat("raw_question", F.lit("\r\n  \n\n\nend")).alias("c"))
    s = s.select("id", X.clean_source(F.col("c")).alias("c"))
    return s.select("id", F.md5(F.col("c").cast("binary")).alias("clean_md5"), F.length("c").cast("long").alias("chars"), F.size(X.content_tokens(F.col("c"), list(_STOP))).cast("long").alias("content_words"))


_REPLIES = ('```json\n{"a": 1}\n```', 'text {"a": {"b": 2}} more', "no object", '<think>x</think> {"a": 3}')


@query(f"""WITH {V_PAIRS}, r AS (SELECT id, ([{", ".join("'" + x + "'" for x in _REPLIES)}])[length(id) % 4 + 1] AS reply FROM v_pairs), o AS (SELECT *, regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) AS found FROM r)
SELECT id, CASE WHEN found <> '' THEN found END AS object, contains(lower(reply), '<think>') AS reasons FROM o""")
def reply_objects(spark, d):
    """The JSON object of a model's reply, and whether it shows its reasoning."""
    reply = F.element_at(F.array(*map(F.lit, _REPLIES)), (F.length("id") % 4 + 1).cast("int"))
    r = pairs(spark, d).select("id", reply.alias("reply"))
    return r.select("id", X.json_object(F.col("reply")).alias("object"), X.reasoning_trace(F.col("reply")).alias("reasons"))


@query("""WITH RECURSIVE l AS (SELECT DISTINCT c_custkey AS a, c_custkey - c_custkey % 7 AS b FROM customer), u AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
r AS (SELECT a AS id, a AS reached FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.reached) SELECT id, min(reached) AS component FROM r GROUP BY id""")
def overlap_groups(spark, d):
    """Components of customers that are linked to the next smaller multiple of seven."""
    k = F.col("c_custkey")
    return overlap_components(table(spark, d, "customer").select(k.alias("a"), (k - k % 7).alias("b")).where("a <> b"))


@query(f"""WITH {V_ATTEMPTS}, p AS (SELECT request_id, fingerprint, attempt, tokens FROM v_attempts WHERE attempt <= 2 AND state = 'valid'), m AS (SELECT request_id, CASE WHEN request_id % 10 = 0 THEN 'changed' ELSE fingerprint END AS fingerprint FROM v_requests)
SELECT request_id, attempt, tokens FROM p SEMI JOIN m USING (request_id, fingerprint)""")
def prefilled_results(spark, d):
    """Results of earlier attempts for requests whose content did not change."""
    prior = attempts(spark, d).where("attempt <= 2").select("request_id", "fingerprint", "attempt", "tokens", F.when(F.col("state") == "invalid", "finish").alias("state"))
    now = requests(spark, d).withColumn("fingerprint", F.when(F.col("request_id") % 10 == 0, "changed").otherwise(F.col("fingerprint")))
    return I.prefill(now, prior).select("request_id", "attempt", "tokens")


@query(f"""WITH {V_ATTEMPTS}, r AS (SELECT request_id, attempt, CASE WHEN tokens % 13 = 0 THEN 'boom' ELSE '' END AS error, CASE WHEN tokens % 11 = 0 THEN ' ' ELSE 'text' END AS text, CASE state WHEN 'valid' THEN 'stop' ELSE CASE WHEN tokens % 2 = 0 THEN 'length' END END AS finish FROM v_attempts)
SELECT request_id, attempt, CASE WHEN trim(error) <> '' THEN 'error' WHEN trim(text) = '' THEN 'empty' WHEN finish = 'length' THEN 'length' WHEN coalesce(finish, '') <> 'stop' THEN 'finish' END AS problem FROM r""")
def result_problems(spark, d):
    """Why a result is not sound: an error, no text, cut off, or not finished."""
    a = attempts(spark, d)
    t = F.col("tokens")
    finish = F.when(F.col("state") == "valid", "stop").when(t % 2 == 0, "length")
    return a.select("request_id", "attempt", I.result_state(F.when(t % 13 == 0, "boom").otherwise(""), F.when(t % 11 == 0, " ").otherwise("text"), finish).alias("problem"))


@query(f"""WITH {V_ATTEMPTS}, s AS (SELECT DISTINCT attempt, request_id FROM v_attempts WHERE state = 'valid'), c AS (SELECT a.attempt AS left_set, b.attempt AS right_set, (SELECT count(*) FROM s WHERE attempt = a.attempt) AS left_n, (SELECT count(*) FROM s WHERE attempt = b.attempt) AS right_n,
  (SELECT count(*) FROM s x JOIN s y USING (request_id) WHERE x.attempt = a.attempt AND y.attempt = b.attempt) AS common FROM (SELECT DISTINCT attempt FROM s) a JOIN (SELECT DISTINCT attempt FROM s) b ON a.attempt < b.attempt)
SELECT *, left_n = common AND right_n = common AS equal, common = 0 AS disjoint FROM c""")
def set_comparison(spark, d):
    """Sets of answered requests by attempt, two by two: sizes, what they share, whether they are equal or disjoint."""
    s = attempts(spark, d).where("state = 'valid'").groupBy("request_id").agg(F.collect_set("attempt").alias("sets"))
    # A request is in three sets at most, so pairs of sets come from its own row.
    sizes = s.select(F.explode("sets").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    both = s.select("sets", F.explode("sets").alias("left_set")).select("left_set", F.explode("sets").alias("right_set")).where("left_set < right_set").groupBy("left_set", "right_set").agg(F.count(F.lit(1)).alias("common"))
    a, b = sizes.select(F.col("k").alias("left_set"), F.col("n").alias("left_n")), sizes.select(F.col("k").alias("right_set"), F.col("n").alias("right_n"))
    c = a.join(b, F.col("left_set") < F.col("right_set")).join(both, ["left_set", "right_set"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    n = F.col("common")
    return c.select("left_set", "right_set", "left_n", "right_n", "common", ((F.col("left_n") == n) & (F.col("right_n") == n)).alias("equal"), (n == 0).alias("disjoint"))


@query(f"""{J}, b AS (SELECT sample_id, model, condition, list_filter([CASE WHEN bool_or(h % 50 = 0) THEN 'bad_atom' END, CASE WHEN bool_or(h % 40 = 1) THEN 'bad_surface' END], lambda x: x IS NOT NULL) AS rejects, bool_or(h % 9 = 2) AS doubt, bool_or(h % 61 = 3) AS broken FROM v_judgments GROUP BY ALL)
SELECT sample_id, model, condition, CASE WHEN broken THEN 'invalid' WHEN len(rejects) > 0 THEN 'reject' WHEN doubt THEN 'review' ELSE 'strict' END AS state, CASE WHEN len(rejects) = 0 THEN NULL WHEN NOT list_contains(rejects, 'bad_atom') THEN 'surface' ELSE 'atom' END AS reject_kind FROM b""")
def quality_classes(spark, d):
    """Each answer's class by its reasons and doubts, and whether its reasons are of the surface only."""
    hit = lambda n, r: F.bool_or(F.pmod("h", F.lit(n)) == r)
    b = judgments(spark, d).groupBy("sample_id", "model", "condition").agg(hit(50, 0).alias("atom"), hit(40, 1).alias("surface"), hit(9, 2).alias("doubt"), hit(61, 3).alias("broken"))
    b = b.withColumn("rejects", V.codes({"bad_atom": F.col("atom"), "bad_surface": F.col("surface")})).withColumn("doubts", V.codes({"doubt": F.col("doubt")}))
    return b.select("sample_id", "model", "condition", V.classify(~F.col("broken"), F.col("rejects"), F.col("doubts")).alias("state"), V.reject_class(F.col("rejects"), ["bad_surface"]).alias("reject_kind"))


@query(f"""WITH {V_SAMPLES}, s AS (SELECT sample_id, 'train' AS split FROM v_samples WHERE sample_id % 4 < 3 UNION ALL SELECT sample_id, 'test' FROM v_samples WHERE sample_id % 4 >= 3 OR sample_id % 97 = 0) SELECT sample_id, count(*) AS n FROM s GROUP BY sample_id HAVING count(*) > 1""")
def split_overlaps(spark, d):
    """Samples that are in more than one split."""
    s, k = samples(spark, d).select("sample_id"), F.col("sample_id")
    return M.duplicate_keys(s.where(k % 4 < 3).unionByName(s.where((k % 4 >= 3) | (k % 97 == 0))), ["sample_id"])


@query(f"""WITH {V_ATOMS}, f AS (SELECT sample_id, sha256(string_agg(x, '|' ORDER BY x)) AS content FROM (SELECT DISTINCT sample_id, concat_ws(':', atom_id, gold, block) AS x FROM v_atoms) GROUP BY sample_id)
SELECT content, count(*) AS records, min(sample_id) AS first_id FROM f GROUP BY content""")
def content_fingerprints(spark, d):
    """Records by a fingerprint of their atoms' locked fields, whatever their order."""
    x = F.concat_ws(":", "atom_id", "gold", "block")
    f = atoms(spark, d).groupBy("sample_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(x)), "|"), 256).alias("content"))
    return f.groupBy("content").agg(F.count(F.lit(1)).alias("records"), F.min("sample_id").alias("first_id"))
