"""Dataset construction queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuloom.functions import text as X
from corpuloom.operators import merges as M
from corpuloom.operators import sampling as S
from corpuloom.plans.views import V_ATTEMPTS, V_SAMPLES, V_SOURCES, attempts, query, requests, samples, sources
from corpuloom.session import cut, table

_TOK = r"regexp_extract_all(lower({0}), '[a-z]+(?:''[a-z]+)?|[0-9]+(?:\.[0-9]+)?')"
_WS = r"trim(regexp_replace({0}, '[ \t\n\r\f\x0B]+', ' ', 'g'))"


@query(f"""WITH {V_SOURCES}, c AS (SELECT domain, source_dataset, topic, count(*) AS n FROM v_source GROUP BY ALL)
SELECT *, n / sum(n) OVER () AS share, row_number() OVER (ORDER BY n DESC, domain, source_dataset, topic) AS rank FROM c""")
def source_profile(spark, d):
    c = sources(spark, d).groupBy("domain", "source_dataset", "topic").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.desc("n"), "domain", "source_dataset", "topic")).cast("long")
    return c.withColumn("share", F.col("n") / F.sum("n").over(every)).withColumn("rank", rank)


@query(f"""WITH {V_SOURCES}, t AS (SELECT t.*, s.* FROM (SELECT DISTINCT topic FROM v_source) t CROSS JOIN (SELECT DISTINCT source_dataset FROM v_source) s),
c AS (SELECT topic, source_dataset, count(*) AS k FROM v_source GROUP BY ALL)
SELECT topic, source_dataset, coalesce(k, 0) AS n, coalesce(k, 0) / sum(coalesce(k, 0)) OVER (PARTITION BY topic) AS share FROM t LEFT JOIN c USING (topic, source_dataset)""")
def cross_table_zero_fill(spark, d):
    s = sources(spark, d)
    c = s.groupBy("topic", "source_dataset").agg(F.count(F.lit(1)).alias("k"))
    grid = c.select("topic").distinct().crossJoin(c.select("source_dataset").distinct())  # of labels
    n = F.coalesce("k", F.lit(0))
    return grid.join(c, ["topic", "source_dataset"], "left").select("topic", "source_dataset", n.alias("n"), (n / F.sum(n).over(Window.partitionBy("topic"))).alias("share"))


@query(rf"""WITH {V_SOURCES}, m AS (SELECT id, length({_WS.format('raw_question')}) AS chars, len({_TOK.format('raw_question')}) AS n_tokens,
  length(regexp_replace(raw_question, '[^A-Za-z]', '', 'g')) AS ascii, length(regexp_replace(raw_question, '[^\p{{L}}]', '', 'g')) AS letters, raw_question FROM v_source)
SELECT id, chars, n_tokens, CASE WHEN letters > 0 THEN ascii / letters ELSE 0 END AS english, list_filter([CASE WHEN chars < 80 THEN 'too_short' END, CASE WHEN chars > 20000 THEN 'too_long' END,
  CASE WHEN letters = 0 OR ascii / letters < 0.9 THEN 'not_english' END, CASE WHEN contains(raw_question, '!!') THEN 'noise' END], lambda x: x IS NOT NULL) AS reasons FROM m""")
def eligibility_gate(spark, d):
    q = F.col("raw_question")
    m = sources(spark, d).select("id", F.length(X.normalise(q)).cast("long").alias("chars"), F.size(X.tokens(q)).cast("long").alias("n_tokens"), X.english_ratio(q).alias("english"), "raw_question")
    rules = {"too_short": F.col("chars") < 80, "too_long": F.col("chars") > 20000, "not_english": F.col("english") < 0.9, "noise": q.contains("!!")}
    return m.withColumn("reasons", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))).drop("raw_question")


@query(f"WITH {V_SOURCES} SELECT arg_min(id, id) AS id, count(*) AS copies, md5(lower({_WS.format('raw_question')})) AS key FROM v_source GROUP BY lower({_WS.format('raw_question')})")
def exact_question_dedup(spark, d):
    key = F.lower(X.normalise(F.col("raw_question")))
    return sources(spark, d).groupBy(F.md5(key.cast("binary")).alias("key")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))


@query(f"""WITH {V_SOURCES}, c AS (SELECT *, md5(lower({_WS.format('raw_question')})) AS key, lower(left({_WS.format('raw_question')}, 40)) AS head, length(raw_question) AS chars FROM v_source)
SELECT id, head, chars, copies FROM (SELECT *, count(*) OVER (PARTITION BY key) AS copies, row_number() OVER (PARTITION BY key ORDER BY chars DESC, id) AS i FROM c) WHERE i = 1""")
def richest_record_dedup(spark, d):
    """The longest record of each whole normalised text, with its first characters to look at."""
    c = sources(spark, d).select("id", F.lower(X.normalise(F.col("raw_question"))).alias("text"), F.length("raw_question").cast("long").alias("chars"))
    c = c.select("id", F.md5(F.col("text").cast("binary")).alias("key"), F.substring("text", 1, 40).alias("head"), "chars")
    best = F.min_by(F.struct("id", "head", "chars"), F.struct(F.coalesce(-F.col("chars"), F.lit(1)).alias("n"), "id")).alias("b")
    return c.groupBy("key").agg(best, F.count(F.lit(1)).alias("copies")).select("b.*", "copies")


@query(f"""WITH {V_SOURCES}, c AS (SELECT *, md5(lower({_WS.format('raw_question')})) AS key, length(raw_question) AS chars FROM v_source)
SELECT id, key, chars, copies FROM (SELECT *, count(*) OVER (PARTITION BY key) AS copies, row_number() OVER (PARTITION BY key ORDER BY chars DESC, id) AS i FROM c) WHERE i = 1""")
def richest_question_dedup(spark, d):
    """As richest_record_dedup, by the whole normalised text."""
    c = sources(spark, d).select("id", F.md5(F.lower(X.normalise(F.col("raw_question"))).cast("binary")).alias("key"), F.length("raw_question").cast("long").alias("chars"))
    # An aggregation with partial sums, so that no task holds a large group.
    best = F.min_by(F.struct("id", "chars"), F.struct(F.coalesce(-F.col("chars"), F.lit(1)).alias("n"), "id")).alias("b")
    return c.groupBy("key").agg(best, F.count(F.lit(1)).alias("copies")).select("b.id", "key", "b.chars", "copies")


@query(f"""WITH {V_SOURCES}, w AS (SELECT id, {_TOK.format('raw_question')} AS t FROM v_source),
g AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(t) - 8), lambda i: array_to_string(t[i:i+9], ' ')))) AS g FROM w WHERE len(t) >= 10),
b AS (SELECT item_id, {_TOK.format('text')} AS t FROM benchmark), h AS (SELECT DISTINCT unnest(list_transform(range(1, len(t) - 8), lambda i: array_to_string(t[i:i+9], ' '))) AS g FROM b WHERE len(t) >= 10)
SELECT s.id, count(g.g) AS n_grams, count(h.g) AS n_hits, coalesce(count(h.g) / nullif(count(g.g), 0), 0) AS containment FROM v_source s LEFT JOIN g ON s.id = g.id LEFT JOIN h ON g.g = h.g GROUP BY s.id""")
def ngram_containment(spark, d):
    """Share of a text's ten-word runs that occur in a benchmark item; 0 for texts without any."""
    # Exploding the one token array keeps it from being computed again for each run of words.
    own = sources(spark, d).select("id", F.explode(F.array(X.tokens(F.coalesce("raw_question", F.lit(""))))).alias("t")).select("id", F.explode_outer(X.grams(F.col("t"), 10)).alias("g"))
    known = table(spark, d, "benchmark").select(F.explode(F.array(X.tokens(F.col("text")))).alias("t")).select(F.explode(X.grams(F.col("t"), 10)).alias("g")).distinct().withColumn("hit", F.lit(1))
    return own.join(known, "g", "left").groupBy("id").agg(F.count("g").alias("n_grams"), F.count("hit").alias("n_hits"), F.coalesce(F.try_divide(F.count("hit"), F.count("g")), F.lit(0.0)).alias("containment"))


@query(f"""WITH {V_SOURCES}, c AS (SELECT domain, topic, count(*) AS n FROM v_source GROUP BY ALL), f AS (SELECT *, (100 * n) // sum(n) OVER () AS base, (100 * n) % sum(n) OVER () AS rest FROM c)
SELECT domain, topic, n, (base + (row_number() OVER (ORDER BY rest DESC, domain, topic) <= 100 - sum(base) OVER ())::INT)::BIGINT AS quota FROM f""")
def largest_remainder_quota(spark, d):
    return S.largest_remainder(sources(spark, d).groupBy("domain", "topic").agg(F.count(F.lit(1)).alias("n")), 100, ["domain", "topic"])


_HR = "sha256(concat_ws(':', '{0}', {1}))"


@query(f"""WITH {V_SOURCES}, r AS (SELECT id, domain, source_dataset, row_number() OVER (PARTITION BY domain, source_dataset ORDER BY {_HR.format('pool', 'id')}, id) AS rank FROM v_source) SELECT * FROM r WHERE rank <= 3""")
def hash_ranked_pool(spark, d):
    return S.stratified(sources(spark, d).select("id", "domain", "source_dataset"), "pool", "id", ["domain", "source_dataset"], 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {V_SAMPLES}, c AS (SELECT domain, difficulty, count(*) AS n FROM v_samples GROUP BY ALL), f AS (SELECT *, (500 * n) // sum(n) OVER () AS base, (500 * n) % sum(n) OVER () AS rest FROM c),
q AS (SELECT domain, difficulty, base + (row_number() OVER (ORDER BY rest DESC, domain, difficulty) <= 500 - sum(base) OVER ())::INT AS quota FROM f),
r AS (SELECT sample_id, domain, difficulty, row_number() OVER (PARTITION BY domain, difficulty ORDER BY {_HR.format('subset', 'sample_id')}, sample_id) AS rank FROM v_samples)
SELECT r.* FROM r JOIN q USING (domain, difficulty) WHERE rank <= quota""")
def proportional_subset(spark, d):
    s = samples(spark, d).select("sample_id", "domain", "difficulty")
    return S.proportional_sample(s, "subset", "sample_id", ["domain", "difficulty"], 500).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {V_SOURCES}, c AS (SELECT source_dataset, topic, count(*) AS n FROM v_source GROUP BY ALL)
, o AS (SELECT *, row_number() OVER w AS i, count(*) OVER () AS k, coalesce(sum(n) OVER (ORDER BY n, source_dataset, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WINDOW w AS (ORDER BY n, source_dataset, topic)),
p AS (SELECT *, min(i) FILTER (n * (k - i + 1) > 120 - before) OVER () AS open FROM o),
l AS (SELECT *, max((120 - before) // (k - i + 1)) FILTER (i = open) OVER () AS base, max((120 - before) % (k - i + 1)) FILTER (i = open) OVER () AS odd FROM p)
SELECT source_dataset, topic, n, (CASE WHEN open IS NULL OR i < open THEN n ELSE base + (row_number() OVER (ORDER BY i < open, source_dataset, topic) <= odd)::INT END)::BIGINT AS quota FROM l""")
def capped_equal_quota(spark, d):
    return S.capped_equal_quota(sources(spark, d).groupBy("source_dataset", "topic").agg(F.count(F.lit(1)).alias("n")), 120, ["source_dataset", "topic"])


@query(f"""WITH {V_SAMPLES}, p AS (SELECT sample_id, domain, -ln((('0x' || substr({_HR.format('quality', 'sample_id')}, 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496::DOUBLE) / exp(0.5::DOUBLE * price / 100000) AS priority FROM v_samples),
r AS (SELECT sample_id, domain, row_number() OVER (PARTITION BY domain ORDER BY priority, sample_id) AS place FROM p) SELECT * FROM r WHERE place <= 40""")
def quality_weighted_sample(spark, d):
    """Keeps a limit: the sample itself."""
    p = samples(spark, d).withColumn("priority", S.weighted_priority("quality", "sample_id", F.col("price") / 100000, 0.5))
    w = Window.partitionBy("domain").orderBy("priority", "sample_id")
    return p.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 40").select("sample_id", "domain", "place")


@query(f"""WITH {V_SOURCES}, r AS (SELECT id, topic, row_number() OVER (PARTITION BY topic ORDER BY {_HR.format('robin', 'id')}, id) AS rank FROM v_source) SELECT *, row_number() OVER (ORDER BY rank, topic) AS position FROM r""")
def round_robin_interleave(spark, d):
    r = S.round_robin(sources(spark, d).select("id", "topic"), "robin", "id", ["topic"])
    return r.withColumns({c: F.col(c).cast("long") for c in ("rank", "position")})


@query(f"""WITH {V_SAMPLES}, r AS (SELECT sample_id, domain, difficulty, row_number() OVER (PARTITION BY domain, difficulty ORDER BY {_HR.format('split', 'sample_id')}, sample_id) AS rank, count(*) OVER (PARTITION BY domain, difficulty) AS n FROM v_samples)
SELECT sample_id, domain, difficulty, rank, CASE WHEN rank <= floor(n * 0.8::DOUBLE + 0.5::DOUBLE) THEN 'train' WHEN rank <= floor(n * 0.9::DOUBLE + 0.5::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM r""")
def stratified_split(spark, d):
    s = S.split_by_share(samples(spark, d).select("sample_id", "domain", "difficulty"), "split", "sample_id", ["domain", "difficulty"], {"train": 0.8, "dev": 0.1, "test": 0.1})
    return s.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {V_ATTEMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY (state = 'valid')::INT DESC, attempt DESC) AS i FROM v_attempts) SELECT request_id, fingerprint, attempt, state, tokens FROM r WHERE i = 1""")
def latest_valid_result(spark, d):
    return M.latest_valid(attempts(spark, d), "request_id", F.col("state") == "valid", "attempt")


@query(f"""WITH {V_ATTEMPTS}, ok AS (SELECT DISTINCT request_id, fingerprint FROM v_attempts WHERE state = 'valid') SELECT r.* FROM v_requests r ANTI JOIN ok USING (request_id, fingerprint)""")
def pending_requests(spark, d):
    return M.pending(requests(spark, d), attempts(spark, d).where("state = 'valid'"), ["request_id", "fingerprint"])


@query(f"""WITH {V_ATTEMPTS}, g AS (SELECT DISTINCT request_id FROM v_attempts WHERE attempt = 1), a AS (SELECT request_id FROM v_requests)
SELECT coalesce(a.request_id, g.request_id) AS request_id, CASE WHEN a.request_id IS NULL THEN 'unexpected' WHEN g.request_id IS NULL THEN 'missing' ELSE 'ok' END AS status FROM a FULL JOIN g ON a.request_id = g.request_id""")
def request_result_status(spark, d):
    return M.reconcile(requests(spark, d), attempts(spark, d).where("attempt = 1"), "request_id")


@query(f"""WITH {V_ATTEMPTS}, g AS (SELECT DISTINCT request_id FROM v_attempts WHERE attempt = 1)
SELECT coalesce(a.request_id, g.request_id) AS request_id, CASE WHEN a.request_id IS NULL THEN 'unexpected' WHEN g.request_id IS NULL THEN 'missing' ELSE 'ok' END AS status FROM v_requests a FULL JOIN g ON a.request_id = g.request_id""")
def every_request_status(spark, d):
    """As request_result_status, of all requests."""
    return M.reconcile(requests(spark, d), attempts(spark, d).where("attempt = 1"), "request_id")


@query(f"""WITH {V_ATTEMPTS}, b AS (SELECT request_id, state, tokens FROM v_attempts WHERE attempt = 1), n AS (SELECT request_id, state, tokens FROM v_attempts WHERE attempt = 2 AND state = 'valid')
SELECT * FROM b WHERE request_id NOT IN (SELECT request_id FROM n) UNION ALL SELECT * FROM n""")
def overlay_merge(spark, d):
    a = attempts(spark, d).select("request_id", "state", "tokens", "attempt")
    return M.overlay(a.where("attempt = 1").drop("attempt"), a.where("attempt = 2 and state = 'valid'").drop("attempt"), "request_id")


@query(f"""WITH {V_ATTEMPTS}, f AS (SELECT request_id FROM v_attempts WHERE state = 'valid' GROUP BY ALL HAVING count(DISTINCT attempt) = (SELECT count(DISTINCT attempt) FROM v_attempts WHERE state = 'valid'))
SELECT request_id, attempt, tokens FROM v_attempts WHERE state = 'valid' AND request_id IN (FROM f)""")
def complete_case_rows(spark, d):
    return M.complete_cases(attempts(spark, d).where("state = 'valid'").select("request_id", "attempt", "tokens"), "request_id", ["attempt"])


@query(f"""WITH {V_ATTEMPTS} SELECT attempt, count(*) AS n, count(*) FILTER (state = 'valid') AS valid, count(*) FILTER (state = 'invalid') AS invalid, sum(tokens)::BIGINT AS tokens, min(tokens) AS lo, max(tokens) AS hi, avg(tokens) AS mean,
  count(*) / (SELECT count(*) FROM v_requests) AS answered FROM v_attempts GROUP BY ALL""")
def result_usage_summary(spark, d):
    total = requests(spark, d).agg(F.count(F.lit(1)).alias("total"))
    a = attempts(spark, d).groupBy("attempt").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "valid").alias("valid"), F.count_if(F.col("state") == "invalid").alias("invalid"), F.sum("tokens").alias("tokens"),
        F.min("tokens").alias("lo"), F.max("tokens").alias("hi"), F.avg("tokens").alias("mean"),
    )
    return a.crossJoin(F.broadcast(total)).withColumn("answered", F.col("n") / F.col("total")).drop("total")


@query(f"""WITH {V_SOURCES}, s AS (SELECT 1 AS step, 'all' AS stage, count(*) AS n FROM v_source UNION ALL SELECT 2, 'long', count(*) FROM v_source WHERE length(raw_question) >= 200
  UNION ALL SELECT 3, 'english', count(*) FROM v_source WHERE length(raw_question) >= 200 AND topic = 'en' UNION ALL SELECT 4, 'calm', count(*) FROM v_source WHERE length(raw_question) >= 200 AND topic = 'en' AND NOT contains(raw_question, '!!'))
SELECT step, stage, n, n / lag(n) OVER (ORDER BY step) AS retained, n / first_value(n) OVER (ORDER BY step) AS overall FROM s""")
def construction_funnel(spark, d):
    # All stages in one pass over the rows.
    q = F.col("raw_question")
    steps, seen = [("all", F.lit(True)), ("long", F.length(q) >= 200), ("english", F.col("topic") == "en"), ("calm", ~q.contains("!!"))], F.lit(True)
    cols = []
    for i, (name, cond) in enumerate(steps):
        seen = seen & cond
        cols.append(F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("stage"), F.count_if(seen).alias("n")))
    rows = sources(spark, d).agg(F.array(*cols).alias("s")).select(F.explode("s").alias("s")).select("s.*")
    w = Window.partitionBy(F.lit(0)).orderBy("step")
    return rows.withColumn("retained", F.col("n") / F.lag("n").over(w)).withColumn("overall", F.col("n") / F.first("n").over(w))


@query(f"""WITH {V_SOURCES}, r AS (SELECT domain, length(raw_question) AS x, row_number() OVER (PARTITION BY domain ORDER BY length(raw_question)) - 1 AS i, count(*) OVER (PARTITION BY domain) AS k FROM v_source)
SELECT domain, count(*) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS mean, {", ".join(f"max(x) FILTER (i = round_even((k-1)*{q / 100}::DOUBLE, 0)) AS p{q}" for q in (50, 90, 95, 99))} FROM r GROUP BY ALL""")
def length_summary(spark, d):
    from corpuloom.operators.calibration import score_summary

    r = sources(spark, d).select("domain", F.length("raw_question").cast("long").alias("x")).where("x is not null")
    s = score_summary(r, "x", ["domain"], (50, 90, 95, 99)).drop("sd").withColumnsRenamed({"min": "lo", "max": "hi"})
    # Null texts count as rows.
    every = sources(spark, d).groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))
    return every.join(s.drop("n"), "domain", "left").withColumnRenamed("rows", "n")


@query("""WITH t AS (SELECT *, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text, string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, prev_text AS question, text AS answer, right(coalesce(before, ''), 6000) AS context FROM t WHERE role = 'assistant' AND prev_role = 'user'""")
def chat_turn_pairs(spark, d):
    """Assistant turns after a user's, with the last 6000 characters of what came before."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    line = F.concat("role", F.lit(": "), "text")
    # A line and its end have three characters at least, so 6000 characters are in the last 2000 lines.
    before = F.array_join(F.collect_list(line).over(w.rowsBetween(-2001, -2)), "\n")
    t = table(spark, d, "conversations").withColumn("prev_role", F.lag("role").over(w)).withColumn("question", F.lag("text").over(w)).withColumn("before", before)
    return t.where("role = 'assistant' and prev_role = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"), F.expr("right(before, 6000)").alias("context"))


@query(rf"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace({"replace(" * 6}regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
 '(?i)<br\s*/?>|</(p|div|li|ul|ol|h[1-6]|tr|table|pre|blockquote|title|article|section)>', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
 '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages""")
def html_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.html_to_text(F.col("html")).cast("binary")).alias("text_md5"))


@query(f"""WITH {V_SOURCES} SELECT id, 'src-' || substr(sha256(concat_ws(':', source_dataset, id)), 1, 16) AS stable_id, 6 + ('0x' || substr(sha256(concat_ws(':', 'blocks', id)), 1, 15))::BIGINT % 15 AS blocks,
  sha256('{{"id":' || id || ',"topic":"' || topic || '"}}') AS fingerprint FROM v_source""")
def stable_identity(spark, d):
    s = sources(spark, d)
    canonical = F.sha2(F.to_json(F.struct("id", "topic")), 256)
    return s.select("id", X.stable_id("src-", "source_dataset", "id").alias("stable_id"), X.stable_int(6, 15, F.lit("blocks"), "id").alias("blocks"), canonical.alias("fingerprint"))


@query("""WITH b AS (SELECT l_orderkey AS sample_id, l_suppkey % 4 AS block, count(*) AS atoms, count(DISTINCT l_returnflag) AS labels, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS profile FROM lineitem GROUP BY ALL)
SELECT *, CASE WHEN atoms <= 1 THEN '1' WHEN atoms <= 3 THEN '2-3' WHEN atoms <= 5 THEN '4-5' WHEN atoms <= 7 THEN '6-7' ELSE '8+' END AS bucket, CASE WHEN labels > 1 THEN 'mixed' ELSE 'homogeneous' END AS mode FROM b""")
def block_profiles(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id"), F.pmod("l_suppkey", F.lit(4)).alias("block"))
    b = b.agg(F.count(F.lit(1)).alias("atoms"), F.count_distinct("l_returnflag").alias("labels"), X.label_profile(F.collect_set("l_returnflag")).alias("profile"))
    return b.withColumn("bucket", X.size_bucket(F.col("atoms"))).withColumn("mode", F.when(F.col("labels") > 1, "mixed").otherwise("homogeneous"))


@query("""WITH r AS (SELECT o_orderkey AS id, count(l_orderkey) AS atoms, count(DISTINCT l_suppkey % 4) AS blocks, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_quantity <= 0 OR l_discount < 0 OR l_discount > 1) AS bad,
  count(*) - count(DISTINCT concat_ws('_', l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT)) AS twice FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT id, list_filter([CASE WHEN atoms = 0 THEN 'no_atoms' END, CASE WHEN atoms > 0 AND a = 0 THEN 'no_hard_a' END, CASE WHEN bad > 0 THEN 'bad_value' END, CASE WHEN atoms > 0 AND twice > 0 THEN 'duplicate_atom' END, CASE WHEN blocks > 3 THEN 'too_many_blocks' END], lambda x: x IS NOT NULL) AS errors FROM r""")
def record_validation(spark, d):
    """Each record's error codes in rule order; empty for a valid one."""
    o, l = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), table(spark, d, "lineitem")
    atom = F.concat_ws("_", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))
    per = l.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).alias("atoms"), F.count_distinct(F.pmod("l_suppkey", F.lit(4))).alias("blocks"), F.count_if(F.col("l_returnflag") == "A").alias("a"),
        F.count_if((F.col("l_quantity") <= 0) | ~F.col("l_discount").between(0, 1)).alias("bad"), (F.count(F.lit(1)) - F.count_distinct(atom)).alias("twice"),
    )
    rules = {"no_atoms": F.col("atoms").isNull(), "no_hard_a": F.col("a") == 0, "bad_value": F.col("bad") > 0, "duplicate_atom": F.col("twice") > 0, "too_many_blocks": F.col("blocks") > 3}
    return o.join(per, "id", "left").select("id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])).alias("errors"))


def near_duplicate_clusters(spark, d):
    """One row per document: exact groups by their words first, then greedy clusters of the groups' best documents by length as quality.

    status: unique, representative or duplicate; match: exact or near, for duplicates; members: documents of the cluster;
    cluster_id: of clusters of several, from the members' ids in any order. A null text has no words.
    """
    from corpuloom.operators import clustering as K

    texts = sources(spark, d).withColumn("quality", F.coalesce(F.length("raw_question"), F.lit(0)))
    # One pass over the texts gives all that the groups and the candidates need.
    s = cut(K.signatures(texts, "id", "raw_question", "quality"), "signatures")
    best = F.min_by(F.struct("id", "quality", "sig", "size", "distinct"), F.struct(-F.col("quality"), F.col("id")))
    firsts = cut(s.groupBy("key").agg(best.alias("r")).select("key", "r.*"), "firsts")
    found = K.greedy_clusters(firsts.select("id", "quality"), K.similar_pairs(firsts, texts.select("id", F.col("raw_question").alias("text"))))
    # The copies take the verdict of their group's best document; one side has a row per key.
    groups = firsts.select("key", F.col("id").alias("first")).join(found.select(F.col("id").alias("first"), "representative"), "first")
    placed = s.select("id", "key").join(groups, "key").select("id", "first", "representative")
    clusters = K.cluster_ids(placed, "id", "representative")
    out = placed.join(clusters, "representative")
    kept = F.col("id") == F.col("representative")
    return out.select(
        "id", kept.alias("kept"), "representative", F.when(F.col("members") == 1, "unique").when(kept, "representative").otherwise("duplicate").alias("status"),
        F.when(~kept, F.when(F.col("first") == F.col("representative"), "exact").otherwise("near")).alias("match"), "members", F.when(F.col("members") > 1, F.col("cluster_id")).alias("cluster_id"),
    )


def near_duplicate_candidates(spark, d):
    """Documents of one signature with the smallest of them (kind copy), and pairs of such smallest ones that share two signature values (kind pair)."""
    from corpuloom.operators import clustering as K

    return K.candidates(K.signatures(sources(spark, d), "id", "raw_question"))


NO_SQL = {f.__name__: f for f in (near_duplicate_clusters, near_duplicate_candidates)}
