"""Queries on near-verbatim evidence, canonical JSON, numeric paths and packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuloom.functions import documents as D
from corpuloom.functions import text as X
from corpuloom.operators import alignment as A
from corpuloom.operators import grounding as G
from corpuloom.plans.selection import V_PAIRS, pairs, plain
from corpuloom.plans.views import query
from corpuloom.session import scratch_path, table
from corpuloom.sources import packages as P


def _evidence(spark, d):
    """Answers, and evidence that quotes them: with other marks, in parts, with a word changed, or reworded."""
    a = F.col("answer")
    words = F.split(F.substring(a, 1, 400), " ")
    kinds = F.array(
        F.upper(F.substring(a, 5, 80)), F.concat(F.substring(a, 1, 40), F.lit(" … "), F.substring(a, 60, 40)), F.concat(F.substring(a, 1, 40), F.lit(" changed "), F.substring(a, 50, 60)),
        F.concat_ws(" ", F.reverse(F.slice(words, 1, 12))), F.translate(F.substring(a, 1, 60), "abc'", "ａｂｃ’"),
    )
    rows = pairs(spark, d).where("answer is not null")
    return rows.select("id", "answer", F.element_at(kinds, (F.pmod(F.length("id") + F.length(a), F.lit(5)) + 1).cast("int")).alias("quote"))


def evidence_repair(spark, d):
    """Whether a quote is in its answer nearly word for word, and the closest span where it isn't."""
    return G.repaired(_evidence(spark, d), "quote", "answer").select("id", "grounded", "replacement", "score")


_JSON = """v_docs AS (SELECT event_id, value, json_extract(props, '$.k')::BIGINT AS k, event_type FROM events)"""


def _documents(spark, d):
    """Nested documents around the events' properties, with their keys in two orders."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    first = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "props": '), "props", F.lit(', "nested": {"b": [1, {"y": '), k, F.lit(', "x": null}], "a": {"deep": '), k, F.lit(', "flag": true}}}'))
    second = F.concat(F.lit('{ "nested":{"a":{"flag":true,"deep":'), k, F.lit('},"b":[1,{"x":null,"y":'), k, F.lit('}]},\n"props":'), "props", F.lit(',"type":"'), "event_type", F.lit('"}'))
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, first).otherwise(second).alias("doc"))


@query(f"""WITH {_JSON}, c AS (SELECT event_id, '{{"nested":{{"a":{{"deep":' || k || ',"flag":true}},"b":[1,{{"x":null,"y":' || k || '}}]}},"props":{{"k":' || k || '}},"type":"' || event_type || '"}}' AS c FROM v_docs) SELECT event_id, sha256(c) AS digest FROM c""")
def document_digests(spark, d):
    """SHA-256 of each nested document in canonical form."""
    return _documents(spark, d).select("event_id", D.canonical_digest(F.col("doc")).alias("digest"))


@query(f"""WITH {_JSON} SELECT event_id, 'nested.a.deep' AS path, k::DOUBLE AS value FROM v_docs WHERE k IS NOT NULL UNION ALL SELECT event_id, 'props.k', k::DOUBLE FROM v_docs WHERE k IS NOT NULL""")
def document_numbers(spark, d):
    """Every number within the objects of each document, by path."""
    return D.numeric_paths(_documents(spark, d), "event_id", "doc")


_SHARDS = 7


@query(f"""WITH r AS (SELECT '{{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}}' AS line, row_number() OVER (ORDER BY o_orderkey) - 1 AS row, count(*) OVER () AS n FROM orders),
s AS (SELECT *, CASE WHEN row < (n % {_SHARDS}) * (n // {_SHARDS} + 1) THEN row // (n // {_SHARDS} + 1) ELSE n % {_SHARDS} + (row - (n % {_SHARDS}) * (n // {_SHARDS} + 1)) // greatest(n // {_SHARDS}, 1) END AS shard FROM r)
SELECT shard::BIGINT AS shard, count(*) AS rows, arg_min(line, row) AS first_line, arg_max(line, row) AS last_line, sha256(string_agg(line || chr(10), '' ORDER BY row)) AS content_sha256 FROM s GROUP BY shard""")
def gzip_package(spark, d):
    """Orders as lines in shards of a package: what each file holds when it is read back."""
    line = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    path = scratch_path(spark, "package")
    P.write_gzip_shards(table(spark, d, "orders").select(line.alias("line"), "o_orderkey"), ["o_orderkey"], _SHARDS, path, "orders")
    return P.read_package(spark, path)


def _align_sql() -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in A.STOPWORDS) + "]"
    raw = lambda c: f"regexp_extract_all({c}, '\\.?[A-Za-z0-9][A-Za-z0-9_.+/#:-]*')"
    words = lambda c: f"list_distinct(list_filter(list_transform({raw(c)}, lambda t: regexp_replace(lower(t), '^[._/-]+|[._/-]+$', '', 'g')), lambda t: length(t) >= 2 AND NOT list_contains({stop}, t)))"
    marked = lambda c: f"list_distinct(list_transform(list_filter({raw(c)}, lambda t: starts_with(t, '.') OR regexp_matches(t, '^\\.*[0-9]+$') OR regexp_matches(t, '{A.MARKED}')), lambda t: regexp_replace(lower(t), '^[.,;:()\\[\\]{{}}]+|[.,;:()\\[\\]{{}}]+$', '', 'g')))"
    share = lambda l, r: f"CASE WHEN len({l}) > 0 AND len({r}) > 0 THEN len(list_intersect({l}, {r})) / len({r}) ELSE 0 END"
    less = lambda a, b: f"list_filter({a}, lambda t: NOT list_contains({b}, t))"
    return f"""WITH l AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS i, l_partkey, l_linenumber, p_name, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT *, coalesce(lead(p_name) OVER (PARTITION BY id ORDER BY i), p_name) AS next_name, coalesce(lead(l_partkey) OVER (PARTITION BY id ORDER BY i), l_partkey) AS next_key FROM l),
t AS (SELECT id, i, 'a' || i AS atom_id, 'The ' || p_name || ' has p_Key' || l_partkey || ' as its ' || lower(p_type) || ' mark' AS support,
  CASE l_partkey % 4 WHEN 0 THEN 'State the ' || p_name || ' with p_Key' || l_partkey WHEN 1 THEN 'Name the ' || next_name || ' by p_Key' || next_key WHEN 2 THEN 'Quote /src/tool' || l_partkey || ' and XML9 only' ELSE 'Compare ' || p_name || ' mark carefully' END AS expected FROM n),
q AS (SELECT id, 'Compare carefully: what does the ' || string_agg(p_name, ' or ' ORDER BY i) FILTER (i <= 2) || ' have as its ' || lower(min(p_type)) || ' mark, p_Key' || min(l_partkey) || '?' AS question FROM l GROUP BY id),
w AS MATERIALIZED (SELECT t.id, i, atom_id, {words('question')} AS qw, {words('support')} AS s, {words('expected')} AS e, {marked('support')} AS ms, {marked('expected')} AS me FROM t JOIN q USING (id)),
o AS (SELECT a.id, a.i, max({share('b.s', 'a.e')}) AS score, arg_max(b.atom_id, struct_pack(x := {share('b.s', 'a.e')}, y := -b.i)) AS other FROM w a JOIN w b ON a.id = b.id AND a.i <> b.i GROUP BY a.id, a.i),
x AS (SELECT w.*, {share('s', 'e')} AS a, coalesce(score, 0) AS b, other, {share('qw', 's')} AS aq, {share('qw', 'e')} AS rq, list_sort({less('me', 's')}) AS unsupported FROM w LEFT JOIN o ON w.id = o.id AND w.i = o.i)
SELECT id, atom_id, array_to_string(list_filter([CASE WHEN b >= 0.34::DOUBLE AND b >= a + 0.20::DOUBLE THEN 'probable_cross_atom_rubric_swap' END, CASE WHEN a < 0.15::DOUBLE AND len(unsupported) > 0 THEN 'rubric_introduces_unsupported_identifier' END, CASE WHEN a < 0.10::DOUBLE AND len(e) >= 3 THEN 'very_low_atom_rubric_overlap' END,
  CASE WHEN aq >= 0.72::DOUBLE AND len(s) >= 3 AND len({less('ms', 'qw')}) = 0 THEN 'probable_query_atom_value_leakage' END, CASE WHEN rq >= 0.82::DOUBLE AND len(e) >= 3 AND len({less('me', 'qw')}) = 0 THEN 'probable_query_rubric_value_leakage' END], lambda r: r IS NOT NULL), ' ') AS reasons,
  round(a, 6) AS own_overlap, other AS best_other, round(b, 6) AS other_overlap, array_to_string(unsupported, ' ') AS unsupported FROM x"""


@query(_align_sql())
def atom_alignment(spark, d):
    """Whether what is expected of each line's atom speaks of that line: other lines' names, unknown marks, low overlaps, leaks into the question."""
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "p_name", "p_type")
    orders = l.join(p, l.l_partkey == p.p_partkey).groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

    def atom(x, i):
        after = F.coalesce(F.get(F.col("lines"), i + 1), x)
        kinds = F.array(
            text("State the ", x["p_name"], " with p_Key", x["l_partkey"]), text("Name the ", after["p_name"], " by p_Key", after["l_partkey"]), text("Quote /src/tool", x["l_partkey"], " and XML9 only"), text("Compare ", x["p_name"], " mark carefully"),
        )
        return F.struct(text("a", i + 1).alias("atom_id"), text("The ", x["p_name"], " has p_Key", x["l_partkey"], " as its ", F.lower(x["p_type"]), " mark").alias("support"), F.get(kinds, F.pmod(x["l_partkey"], F.lit(4)).cast("int")).alias("expected"))

    names = F.array_join(F.transform(F.slice("lines", 1, 2), lambda x: x["p_name"]), " or ")
    least = lambda k: F.array_min(F.transform("lines", lambda x: x[k]))
    question = text("Compare carefully: what does the ", names, " have as its ", F.lower(least("p_type")), " mark, p_Key", least("l_partkey"), "?")
    out = A.alignment(orders.select("id", question.alias("question"), F.transform("lines", atom).alias("atoms")))
    return out.select("id", "atom_id", F.array_join("reasons", " ").alias("reasons"), F.col("atom_rubric_overlap").alias("own_overlap"), F.col("best_other_atom_id").alias("best_other"), F.col("best_other_atom_overlap").alias("other_overlap"), F.array_join("unsupported", " ").alias("unsupported"))


_TOKENS = ("5", "12", "3-5", "mg", "to", "+", "year", "0")
_WORDS = "['" + "','".join(X.NUMBER_WORDS) + "']"


@query(f"""WITH {V_PAIRS}, t AS (SELECT id, coalesce(raw_question, '') || CASE length(id) % 4 WHEN 0 THEN ' Three to  Five or twelve' WHEN 1 THEN ' (5) mg+' ELSE ' zeros 125mg' END AS text FROM v_pairs),
c AS (SELECT id, {plain("lower(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')))")} AS c, lower(text) AS whole, text FROM t), k AS (SELECT *, unnest({list(_TOKENS)}) AS token FROM c)
SELECT id, token, CASE WHEN token = '+' THEN contains(c, '+') ELSE regexp_matches(c, '(^|[^\\w])' || regexp_escape(token) || '($|[^\\w])') END
  OR (regexp_matches(token, '^[0-9]+$') AND regexp_matches(c, '(^|[^\\w])' || coalesce(({_WORDS})[try_cast(token AS INT) + 1], '@') || '($|[^\\w])'))
  OR (token = '3-5' AND regexp_matches(c, '(^|[^\\w])three(\\s+(to|or|through)\\s+|[-–—])five($|[^\\w])')) AS present FROM k""")
def literal_tokens(spark, d):
    """Whether numbers, ranges, units and signs are in the questions, as they are or in words."""
    p = pairs(spark, d)
    kind = F.length("id") % 4
    text = F.concat(F.coalesce("raw_question", F.lit("")), F.when(kind == 0, " Three to  Five or twelve").when(kind == 1, " (5) mg+").otherwise(" zeros 125mg"))
    return p.select("id", text.alias("text"), F.explode(F.array(*map(F.lit, _TOKENS))).alias("token")).select("id", "token", X.literal_present(F.col("token"), F.col("text")).alias("present"))


NO_SQL = {"evidence_repair": evidence_repair}
