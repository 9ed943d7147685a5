"""Queries on pools, extensions, admission, judge requests, run summaries, adjudication and parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuloom.functions import text as X
from corpuloom.operators import merges as M
from corpuloom.operators import release as L
from corpuloom.plans.subsets import V_RECORDS, records
from corpuloom.plans.views import V_ATTEMPTS, attempts, query, requests
from corpuloom.session import table

_HASH = "sha256(concat_ws(':', '{0}', {1}))"


@query(f"""WITH {V_RECORDS}, s AS (SELECT id, source, CASE WHEN source IN ('AUTOMOBILE', 'BUILDING') THEN 'general' ELSE 'coding' END AS domain FROM v_records WHERE atoms > 0),
n AS (SELECT source, domain, count(*) AS n FROM s GROUP BY ALL), q AS (SELECT *, CASE WHEN source IN ('AUTOMOBILE', 'FURNITURE') THEN n + 30 ELSE 80 END AS quota FROM n),
r AS (SELECT s.*, quota, row_number() OVER (PARTITION BY s.source ORDER BY {_HASH.format('pool', 'id')}, id) <= quota AS own FROM s JOIN q USING (source)),
k AS (SELECT domain, sum(greatest(quota - n, 0)) AS lack FROM q GROUP BY ALL), t AS (SELECT id, source, domain, row_number() OVER (PARTITION BY domain ORDER BY {_HASH.format('pool+1', 'id')}, id) AS i FROM r WHERE NOT own)
SELECT id, source, domain, 'quota' AS part FROM r WHERE own UNION ALL SELECT id, source, domain, 'top_up' FROM t JOIN k USING (domain) WHERE i <= lack""")
def candidate_pool(spark, d):
    """Rows of each source up to its quota; what the smaller sources lack comes from the others of their domain."""
    rows = records(spark, d).where("atoms > 0").select("id", "source", F.when(F.col("source").isin("AUTOMOBILE", "BUILDING"), "general").otherwise("coding").alias("domain"))
    quotas = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.when(F.col("source").isin("AUTOMOBILE", "FURNITURE"), F.col("n") + 30).otherwise(80).alias("quota"))
    return L.candidate_pool(rows, quotas, "pool")


_KEY = "lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')))"


@query(f"""WITH c AS (SELECT doc_id AS id, source, {_KEY} AS key, coalesce(length(text), 0) AS quality, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS locked FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY quality DESC, id) AS i FROM c WHERE NOT locked AND key NOT IN (SELECT key FROM c WHERE locked)),
r AS (SELECT id, source, md5(key) AS key_md5, row_number() OVER (PARTITION BY source ORDER BY {_HASH.format('extension', 'id')}, id) AS rank FROM f WHERE i = 1) SELECT * FROM r WHERE rank <= 2""")
def pool_extension(spark, d):
    """Two new documents of each source beside those of good quality, whose ids and texts they don't repeat."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", F.lower(X.normalise(F.col("text"))).alias("key"), F.coalesce(F.length("text"), F.lit(0)).alias("quality"))
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    return L.pool_extension(docs.join(good, "id", "left_semi").select("id", "key"), docs, 2, "extension").select("id", "source", F.md5("key").alias("key_md5"), "rank")


_STATE = "CASE WHEN quality = 1 AND toxic = 0 THEN 'strict_pass' WHEN quality = 1 OR toxic = 0 THEN 'review' ELSE 'reject' END"
_TARGETS = (40, 57, 60)
_Z = "1.96::DOUBLE"
_PLAN = f"""s AS (SELECT doc_id AS id, {_STATE} AS state FROM labels), n AS (SELECT count(*) FILTER (state = 'strict_pass') AS strict_pass, count(*) FILTER (state = 'review') AS review, count(*) FILTER (state = 'reject') AS reject FROM s),
w AS (SELECT *, ((p + {_Z} * {_Z} / (2 * m)) - {_Z} * sqrt(p * (1 - p) / m + {_Z} * {_Z} / (4 * m * m))) / (1 + {_Z} * {_Z} / m) AS lower FROM n CROSS JOIN (SELECT {_TARGETS[1]} / {_TARGETS[2]}::DOUBLE AS p, {_TARGETS[2]}::DOUBLE AS m)),
plan AS (SELECT strict_pass, review, reject, lower, ceil({_TARGETS[0]} / lower)::BIGINT AS target FROM w), q AS (SELECT *, CASE WHEN strict_pass >= target THEN 'strict_sufficient' WHEN strict_pass + review >= target THEN 'review_required' ELSE 'candidate_topup_required' END AS status FROM plan)"""


def _states(spark, d):
    good, harmless = F.col("quality") == 1, F.col("toxic") == 0
    state = F.when(good & harmless, "strict_pass").when(good | harmless, "review").otherwise("reject")
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), state.alias("state"))


@query(f"WITH {_PLAN} SELECT * FROM q")
def admission_plan(spark, d):
    """Target, status and counts of the admission of labelled documents."""
    return L.admission_plan(_states(spark, d), *_TARGETS)


@query(f"""WITH {_PLAN}, r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY {_HASH.format('admit', 'id')}, id) AS place FROM s WHERE state <> 'reject')
SELECT id, CASE state WHEN 'strict_pass' THEN 'admitted_strict' ELSE 'pending_secondary_review' END AS decision, place FROM r CROSS JOIN q WHERE (state = 'strict_pass' AND place <= target) OR (state = 'review' AND status <> 'strict_sufficient')""")
def adaptive_admission(spark, d):
    """Labelled documents that are admitted, and those in line for a second review."""
    rows = _states(spark, d)
    return L.admitted(rows, L.admission_plan(rows, *_TARGETS), "admit")


@query("""WITH l AS (SELECT l_orderkey AS id, list({'atom_id': 'a' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'parent_memory_id': 'b' || l_suppkey % 4, 'text': 'Part ' || l_partkey || ' of "line" ' || l_linenumber, 'u_star': CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END} ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS atoms,
  list(DISTINCT {'parent_memory_id': 'b' || l_suppkey % 4, 'memory_text': 'Supplier group ' || l_suppkey % 4} ORDER BY {'parent_memory_id': 'b' || l_suppkey % 4, 'memory_text': 'Supplier group ' || l_suppkey % 4}) AS blocks FROM lineitem GROUP BY ALL),
a AS (SELECT o_orderkey AS id, o_orderstatus, unnest(['full_memory', 'no_memory']) AS condition FROM orders)
SELECT 'judge:primary:r' || id || '-' || condition AS request_id, id AS sample_id, 'm0' AS model, condition, 'j' AS judge,
  sha256(to_json({'current_query': 'Where is order ' || id || '?', 'model_facing_memory': blocks, 'answer_condition': condition, 'model_response': 'Status ' || o_orderstatus, 'atomic_rubrics': atoms})) AS payload_sha256, len(list_distinct(list_transform(atoms, lambda x: x.atom_id)))::BIGINT AS atoms FROM a JOIN l USING (id)""")
def judge_requests(spark, d):
    """A judge's request for each answer: the digest of its payload, and its atoms."""
    key = F.concat(F.lit("b"), F.pmod("l_suppkey", F.lit(4)).cast("string"))
    u = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")
    atom = F.struct(
        F.concat_ws("-", F.concat(F.lit("a"), F.col("l_linenumber").cast("string")), "l_partkey", "l_suppkey").alias("atom_id"), key.alias("parent_memory_id"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(' of "line" '), F.col("l_linenumber").cast("string")).alias("text"), u.alias("u_star"),
    )
    block = F.struct(key.alias("parent_memory_id"), F.concat(F.lit("Supplier group "), F.pmod("l_suppkey", F.lit(4)).cast("string")).alias("memory_text"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", atom.alias("atom"))
    samples = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["atom"]).alias("atoms"), F.sort_array(F.collect_set(block)).alias("blocks"))
    samples = samples.withColumn("question", F.concat(F.lit("Where is order "), F.col("sample_id").cast("string"), F.lit("?")))
    answers = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("Status "), "o_orderstatus").alias("response"), F.explode(F.array(F.lit("full_memory"), F.lit("no_memory"))).alias("condition"))
    answers = answers.withColumns({"request_id": F.concat(F.lit("r"), F.col("sample_id").cast("string"), F.lit("-"), F.col("condition")), "model": F.lit("m0")})
    asked = L.judge_requests(answers, samples, "primary", "j")
    return asked.select("request_id", "sample_id", "model", "condition", "judge", F.sha2("payload", 256).alias("payload_sha256"), F.size(F.map_keys(F.from_json("expected", "map<string,string>"))).cast("long").alias("atoms"))


@query("""WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events), w AS (SELECT event_id, event_type, k, list_filter([CASE WHEN value > 10 THEN 'late:' || event_id END, CASE WHEN k > 60 THEN 'large' END, CASE WHEN k > 90 THEN 'late:again' END], lambda x: x IS NOT NULL) AS ws, CASE WHEN value < 2 THEN 2 ELSE 0 END AS repairs FROM e),
c AS (SELECT event_type, kind || '=' || count(*) AS x FROM (SELECT event_type, split_part(unnest(ws), ':', 1) AS kind FROM w) GROUP BY event_type, kind), l AS (SELECT event_type, string_agg(x, ' ' ORDER BY x) AS warnings FROM c GROUP BY ALL)
SELECT event_type AS judge, count(*) AS n_rows, sum(k)::BIGINT AS atoms, count(*) FILTER (len(ws) > 0) AS rows_with_warnings, count(*) FILTER (repairs > 0) AS rows_with_repairs, sum(repairs)::BIGINT AS repairs, any_value(coalesce(warnings, '')) AS warnings FROM w LEFT JOIN l USING (event_type) GROUP BY event_type""")
def run_summary(spark, d):
    """Rows, atoms, warnings and repairs by kind of event, as of a run's judges."""
    k, value = F.get_json_object("props", "$.k").cast("long"), F.col("value")
    warnings = F.array_compact(F.array(F.when(value > 10, F.concat(F.lit("late:"), F.col("event_id").cast("string"))), F.when(k > 60, "large"), F.when(k > 90, "late:again")))
    rows = table(spark, d, "events").select(F.col("event_id").alias("answer_id"), F.col("event_type").alias("judge"), k.alias("atoms"), warnings.alias("warnings"), F.when(value < 2, 2).otherwise(0).alias("repairs"))
    return L.run_summary(rows).withColumn("warnings", F.array_join("warnings", " "))


@query("""WITH r AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS fingerprint, (coalesce(length(text), 0) = 0)::INT AS errors, text, lang FROM documents),
a AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS fingerprint, quality = 1 AS strict FROM labels JOIN documents USING (doc_id)),
b AS (SELECT id, CASE WHEN lang = 'de' THEN sha256('') ELSE fingerprint END AS fingerprint, length(text) >= 400 AS strict FROM r)
SELECT r.id, r.fingerprint, CASE WHEN errors > 0 THEN 'deterministic_errors' WHEN coalesce(a.strict, false) AND coalesce(b.strict, false) THEN 'dual_judge_strict_consensus' WHEN NOT coalesce(a.strict, false) AND NOT coalesce(b.strict, false) THEN 'no_strict_verdict'
  WHEN r.id IN (SELECT doc_id FROM labels WHERE toxic = 0) THEN 'manual_deterministic_tiebreak' ELSE 'unapproved_disagreement' END AS mode FROM r LEFT JOIN a ON a.id = r.id AND a.fingerprint = r.fingerprint LEFT JOIN b ON b.id = r.id AND b.fingerprint = r.fingerprint""")
def judge_adjudication(spark, d):
    """Documents under two judges: their labels, and their lengths, where a judge of German texts has seen other ones."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(text, 256).alias("fingerprint"), (F.length(text) == 0).cast("int").alias("errors"), "text", "lang")
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    verdict = lambda c: F.when(c, "strict_pass").otherwise("review").alias("decision")
    one = rows.join(labels, "id").select("id", "fingerprint", verdict(F.col("quality") == 1))
    two = rows.select("id", F.when(F.col("lang") == "de", F.sha2(F.lit(""), 256)).otherwise(F.col("fingerprint")).alias("fingerprint"), verdict(F.length("text") >= 400))
    return L.adjudicated(rows.select("id", "fingerprint", "errors"), one, two, labels.where("toxic = 0").select("id"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i FROM lineitem),
m AS (SELECT l_orderkey AS id, 'p' || l_suppkey % 4 AS parent, min(i) AS first, count(*) AS k, CASE WHEN count(*) = 1 THEN min(' part ' || l_partkey || ' ') ELSE string_agg('part ' || l_partkey, ' ' ORDER BY i) END AS memory_text, string_agg('a' || i, ' ' ORDER BY i) AS atom_ids,
  string_agg(DISTINCT CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END, '' ORDER BY CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END) AS labels FROM l GROUP BY l_orderkey, 'p' || l_suppkey % 4)
SELECT id, parent AS parent_memory_id, row_number() OVER (PARTITION BY id ORDER BY first) AS place, memory_text, atom_ids, labels, CASE WHEN length(labels) > 1 THEN 'mixed' ELSE 'homogeneous' END AS label_mode, right(labels, 1) AS u_star, k - 1 AS merged FROM m""")
def merged_parents(spark, d):
    """Lines of an order that name one parent become one block of it."""
    label = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", label.alias("u"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    name = lambda i: F.concat(F.lit("a"), (i + 1).cast("string"))
    block = lambda x, i: F.struct(
        F.concat(F.lit("p"), F.pmod(x["l_suppkey"], F.lit(4)).cast("string")).alias("parent_memory_id"), F.concat(F.lit(" part "), x["l_partkey"].cast("string"), F.lit(" ")).alias("memory_text"), F.lit(None).cast("string").alias("raw_evidence"), F.array(name(i)).alias("atom_ids")
    )
    rows = lines.select("id", F.transform("lines", block).alias("blocks"), F.transform("lines", lambda x, i: F.struct(name(i).alias("atom_id"), x["u"].alias("u_star"))).alias("atoms"))
    # Arrays in columns first, so that they aren't built again for each parent.
    rows = rows.select(F.explode(F.array(F.struct("id", "blocks", "atoms"))).alias("r")).select("r.*")
    each = rows.select("id", F.posexplode(L.merged_parents(F.col("blocks"), F.col("atoms"))).alias("at", "b"))
    return each.select(
        "id", "b.parent_memory_id", (F.col("at") + 1).cast("long").alias("place"), "b.memory_text", F.array_join("b.atom_ids", " ").alias("atom_ids"), F.array_join("b.labels", "").alias("labels"), "b.label_mode", "b.u_star", F.col("b.merged").cast("long").alias("merged")
    )


@query(f"""WITH {V_ATTEMPTS}, p AS (SELECT request_id, state, tokens FROM v_attempts WHERE attempt = 1), r AS (SELECT request_id, state, tokens FROM v_attempts WHERE attempt = 2 AND request_id IN (SELECT request_id FROM p WHERE state = 'invalid'))
SELECT *, 'prior' AS part FROM p WHERE request_id NOT IN (SELECT request_id FROM r) UNION ALL SELECT *, 'retry' FROM r""")
def bucket_merge(spark, d):
    """First attempts, but for invalid ones that were tried again, whose second attempt counts."""
    a = attempts(spark, d)
    first = a.where("attempt = 1").select("request_id", "state", "tokens")
    again = a.where("attempt = 2").select("request_id", "state", "tokens").join(first.where("state = 'invalid'").select("request_id"), "request_id", "left_semi")
    return M.bucket_merge(first, again, "request_id")


@query("SELECT o_orderkey AS id, o_orderpriority AS topic, o_totalprice + (o_orderstatus = 'F')::INT AS price, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS channel FROM orders")
def group_merge(spark, d):
    """Orders put together from groups of one status each, one of which changed prices, checked against all orders."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"), F.col("o_totalprice").alias("price"), "o_orderstatus")
    own = lambda s: rows.where(F.col("o_orderstatus") == s).drop("o_orderstatus")
    return M.group_merge(rows.drop("o_orderstatus"), {"finished": own("F").withColumn("price", F.col("price") + 1), "open": own("O"), "pending": own("P")}, "id", same=["topic"])


@query("SELECT doc_id AS id, lang, md5(CASE WHEN lang = 'de' THEN reverse(text) ELSE text END) AS text_md5, coalesce(lang = 'de', false) AS replaced FROM documents")
def domain_replacement(spark, d):
    """Documents with those of one language replaced by a later version."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    out = M.replace_domain(docs, docs.where("lang = 'de'").withColumn("text", F.reverse("text")), "id", "lang", "de")
    return out.select("id", "lang", F.md5("text").alias("text_md5"), "replaced")


@query(f"""WITH {V_ATTEMPTS}, v AS (SELECT request_id, tokens FROM v_attempts WHERE attempt = 1 AND state = 'valid'),
s AS (SELECT request_id, attempt, tokens, row_number() OVER (PARTITION BY request_id ORDER BY (state = 'invalid')::INT, -tokens, 'a' || attempt) AS i FROM v_attempts WHERE attempt > 1)
SELECT request_id, CASE WHEN v.tokens IS NOT NULL THEN 'validated' WHEN s.attempt IS NOT NULL THEN 'salvaged_a' || s.attempt ELSE 'baseline_fallback' END AS channel, coalesce(v.tokens, s.tokens, -1)::BIGINT AS row FROM v_requests LEFT JOIN v USING (request_id) LEFT JOIN (SELECT * FROM s WHERE i = 1) s USING (request_id)""")
def candidate_merge(spark, d):
    """A result for every request: a valid first attempt, else the best later one, else the baseline's."""
    a, asked = attempts(spark, d), requests(spark, d).select("request_id")
    valid = a.where("attempt = 1 and state = 'valid'").select("request_id", F.col("tokens").alias("row"))
    later = a.where("attempt > 1").select("request_id", (F.col("state") == "invalid").cast("int").alias("penalty"), F.col("tokens").alias("length"), F.concat(F.lit("a"), F.col("attempt").cast("string")).alias("name"), F.col("tokens").alias("row"))
    return M.candidate_merge(asked, valid, later, asked.withColumn("row", F.lit(-1).cast("long")), "request_id")


@query("""WITH c AS (SELECT event_type AS outer_key, substr(json_extract_string(props, '$.k'), 1, 1) AS inner_key, count(*) AS n FROM events GROUP BY ALL) SELECT *, n / sum(n) OVER (PARTITION BY outer_key) AS share FROM c""")
def nested_counts(spark, d):
    """Counts of a key within another, with their share of the outer key's rows."""
    e = table(spark, d, "events").select(F.col("event_type").alias("outer_key"), F.substring(F.get_json_object("props", "$.k"), 1, 1).alias("inner_key"))
    counts = e.groupBy("outer_key", "inner_key").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("outer_key").agg(F.sum("n").alias("all_"))
    return counts.join(whole, "outer_key").select("outer_key", "inner_key", "n", (F.col("n") / F.col("all_")).alias("share"))
