"""Queries on cross-margin quotas, representative and diagnostic subsets, coverage and review fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuloom.operators import sampling as S
from corpuloom.operators import scenes as N
from corpuloom.operators import subsets as U
from corpuloom.plans.views import query
from corpuloom.session import cut, table

SIZE, DIAGNOSTIC, COVER, FILL, SEED = 120, 60, 20, 60, "20260720"
COLUMNS, LABELS, TYPES, FAMILIES = ["source", "topic", "complexity"], ["n_a", "n_b", "n_c"], ["t0", "t1", "t2", "t3"], ["n_large", "n_free"]
MINIMA = {"topic": 8, "mixed": 20, "each_rare": 6, "any_rare": 15, "safety": 6, "many_atoms": 20}

V_RECORDS = """v_mixed AS (SELECT l_orderkey, bool_or(k > 1) AS mixed FROM (SELECT l_orderkey, l_suppkey % 4 AS b, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY ALL) GROUP BY ALL),
v_counts AS (SELECT l_orderkey, count(*) AS atoms, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_b, count(*) FILTER (l_returnflag = 'R') AS n_c,
  count(*) FILTER (l_linestatus = 'O' AND l_discount <= 0.05) AS t0, count(*) FILTER (l_linestatus <> 'O' AND l_discount <= 0.05) AS t1, count(*) FILTER (l_linestatus = 'O' AND l_discount > 0.05) AS t2, count(*) FILTER (l_linestatus <> 'O' AND l_discount > 0.05) AS t3,
  count(*) FILTER (l_returnflag = 'A' AND l_quantity >= 49) AS n_large, count(*) FILTER (l_returnflag = 'A' AND l_tax = 0) AS n_free, bool_or(l_discount >= 0.1 AND l_quantity < 5) AS safety FROM lineitem GROUP BY ALL),
v_records AS (SELECT o_orderkey AS id, c_mktsegment AS source, o_orderpriority AS topic, CASE o_orderstatus WHEN 'F' THEN 'simple' WHEN 'O' THEN 'medium' ELSE 'complex' END AS complexity,
  coalesce(mixed, false) AS mixed, coalesce(safety, false) AS safety, coalesce(atoms, 0) AS atoms, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_c, 0) AS n_c, coalesce(t0, 0) AS t0, coalesce(t1, 0) AS t1, coalesce(t2, 0) AS t2, coalesce(t3, 0) AS t3,
  coalesce(n_large, 0) AS n_large, coalesce(n_free, 0) AS n_free FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN v_counts c ON c.l_orderkey = o_orderkey LEFT JOIN v_mixed m ON m.l_orderkey = o_orderkey)"""


def records(spark, d):
    """Orders as records: a source, a topic and a complexity, counts of their lines by label and type, rare families, and flags."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.pmod("l_suppkey", F.lit(4)).alias("b"), "l_returnflag", "l_linestatus", "l_discount", "l_quantity", "l_tax")
    count = lambda c: F.count_if(c)
    flag, open_, low = F.col("l_returnflag"), F.col("l_linestatus") == "O", F.col("l_discount") <= 0.05
    # Lines of a block first, so that one shuffle by order serves both grains.
    by_block = lines.groupBy("l_orderkey", "b").agg(
        F.count(F.lit(1)).alias("atoms"), count(flag == "A").alias("n_a"), count(flag == "N").alias("n_b"), count(flag == "R").alias("n_c"),
        count(open_ & low).alias("t0"), count(~open_ & low).alias("t1"), count(open_ & ~low).alias("t2"), count(~open_ & ~low).alias("t3"),
        count((flag == "A") & (F.col("l_quantity") >= 49)).alias("n_large"), count((flag == "A") & (F.col("l_tax") == 0)).alias("n_free"), F.max((F.col("l_discount") >= 0.1) & (F.col("l_quantity") < 5)).alias("safety"),
    )
    kinds = sum((F.col(c) > 0).cast("int") for c in LABELS)
    numbers = ["atoms", *LABELS, *TYPES, *FAMILIES]
    by_order = by_block.groupBy("l_orderkey").agg(F.max(kinds > 1).alias("mixed"), F.max("safety").alias("safety"), *[F.sum(c).alias(c) for c in numbers])
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    complexity = F.when(F.col("o_orderstatus") == "F", "simple").when(F.col("o_orderstatus") == "O", "medium").otherwise("complex")
    out = o.join(c, o.o_custkey == c.c_custkey).join(by_order, o.o_orderkey == F.col("l_orderkey"), "left")
    out = out.select(
        F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("topic"), complexity.alias("complexity"),
        *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in ("mixed", "safety")], *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in numbers],
    )
    # Selections read the records several times.
    return cut(out, "records")


_MARGINS = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS v, count(*) AS n FROM v_records GROUP BY ALL" for c in COLUMNS)
_QUOTAS = f"""m0 AS ({_MARGINS}), m1 AS (SELECT *, ({SIZE} * n) // sum(n) OVER w AS base, ({SIZE} * n) % sum(n) OVER w AS rest FROM m0 WINDOW w AS (PARTITION BY col)),
m AS (SELECT col, v, (base + (row_number() OVER (PARTITION BY col ORDER BY rest DESC, v) <= {SIZE} - sum(base) OVER (PARTITION BY col))::INT)::BIGINT AS t FROM m1),
cells AS (SELECT source, topic, complexity, count(*) AS n FROM v_records GROUP BY ALL),
steps AS (SELECT 0 AS step, c.*, 0 AS q, a.t AS ra, a.t AS ta, b.t AS rb, b.t AS tb, x.t AS rx, x.t AS tx FROM cells c JOIN m a ON a.col = 'source' AND a.v = source JOIN m b ON b.col = 'topic' AND b.v = topic JOIN m x ON x.col = 'complexity' AND x.v = complexity
  UNION ALL SELECT step + 1, source, topic, complexity, n, q + (i = 1)::INT, ra - (source = f1)::INT, ta, rb - (topic = f2)::INT, tb, rx - (complexity = f3)::INT, tx FROM (
    SELECT *, row_number() OVER w AS i, first_value(source) OVER w AS f1, first_value(topic) OVER w AS f2, first_value(complexity) OVER w AS f3 FROM (
      SELECT *, CASE WHEN q < n AND ra > 0 AND rb > 0 AND rx > 0 THEN ra / ta + rb / tb + rx / tx + least(n - q, 1000) / 1000000 END AS score FROM steps WHERE step < {SIZE})
    WINDOW w AS (ORDER BY score DESC NULLS LAST, complexity DESC, topic DESC, source DESC))),
quotas AS (SELECT source, topic, complexity, n, q::BIGINT AS quota FROM steps WHERE step = {SIZE})"""


def _quotas(rows):
    return U.cell_quotas(rows, {c: U.margin(rows, c, SIZE) for c in COLUMNS})


@query(f"WITH RECURSIVE {V_RECORDS}, {_QUOTAS} SELECT * FROM quotas")
def cross_margin_quotas(spark, d):
    """Places of each cell of source, topic and complexity under the three margins."""
    return _quotas(records(spark, d))


def _loss() -> str:
    part = lambda names, total, goal: " + ".join(f"abs((r.{n} + c.{n}) / greatest({total}, 1) - g.{goal}{n})" for n in names)
    whole = lambda names: " + ".join(f"r.{n} + c.{n}" for n in names)
    return f"({part(LABELS, whole(LABELS), 'g_')}) + ({part(TYPES, whole(TYPES), 'g_')}) + abs((r.mixed + c.mixed::INT) / (r.step + 1) - g.g_mixed)"


_GOALS = "goals AS (SELECT " + ", ".join(f"sum({n}) / greatest(sum({' + '.join(g)}), 1) AS g_{n}" for g in (LABELS, TYPES) for n in g) + ", sum(mixed::INT) / count(*) AS g_mixed FROM v_records)"
_HASH = f"sha256(concat_ws(':', '{SEED}', id))"
_PICKED = f"""{_GOALS}, plan AS (SELECT source, topic, complexity, row_number() OVER (ORDER BY source, topic, complexity) AS step FROM (SELECT *, unnest(range(quota)) FROM quotas)),
picked AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS ids, {', '.join(f'0::HUGEINT AS {n}' for n in LABELS + TYPES)}, 0 AS mixed UNION ALL
  SELECT step + 1, list_append(ids, id), {', '.join(f'{n} + d_{n}' for n in LABELS + TYPES)}, mixed + d_mixed FROM (
    SELECT r.*, c.id, {', '.join(f'c.{n} AS d_{n}' for n in LABELS + TYPES)}, c.mixed::INT AS d_mixed, row_number() OVER (ORDER BY {_loss()}, sha256(concat_ws(':', '{SEED}', c.id))) AS i
    FROM picked r JOIN plan p ON p.step = r.step + 1 JOIN v_records c ON c.source = p.source AND c.topic = p.topic AND c.complexity = p.complexity CROSS JOIN goals g WHERE NOT list_contains(r.ids, c.id)) WHERE i = 1),
chosen AS (SELECT unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pick FROM picked WHERE step = {SIZE})"""


def _representative(rows):
    quotas = {tuple(r[c] for c in COLUMNS): r.quota for r in _quotas(rows).where("quota > 0").collect()}
    return U.representative(rows, quotas, COLUMNS, [LABELS, TYPES], "mixed", SEED)


@query(f"WITH RECURSIVE {V_RECORDS}, {_QUOTAS}, {_PICKED} SELECT id, source, topic, complexity, pick, row_number() OVER (ORDER BY {_HASH}) AS place FROM chosen JOIN v_records USING (id)")
def representative_subset(spark, d):
    """Records that fill the cells' places and together come close to the labels, types and mixed parents of all."""
    return _representative(records(spark, d)).select("id", *COLUMNS, "pick", "place")


def _gain() -> str:
    rare = " ".join(f"+ CASE WHEN c.{f} > 0 AND r.{f} < {MINIMA['each_rare']} THEN {U.GAIN_RARE}::DOUBLE ELSE 0 END" for f in FAMILIES)
    any_ = " OR ".join(f"c.{f} > 0" for f in FAMILIES)
    return f"""CASE WHEN coalesce(element_at(r.topics, c.topic)[1], 0) < {MINIMA['topic']} THEN {U.GAIN_TOPIC}::DOUBLE ELSE 0 END + CASE WHEN c.mixed AND r.mixed < {MINIMA['mixed']} THEN {U.GAIN_MIXED}::DOUBLE ELSE 0 END
  + CASE WHEN ({any_}) AND r.any_ < {MINIMA['any_rare']} THEN {U.GAIN_ANY_RARE}::DOUBLE ELSE 0 END {rare} + CASE WHEN c.safety AND r.safety < {MINIMA['safety']} THEN {U.GAIN_SAFETY}::DOUBLE ELSE 0 END
  + CASE WHEN c.atoms >= p75 AND r.big < {MINIMA['many_atoms']} THEN {U.GAIN_ATOMS}::DOUBLE ELSE 0 END + ({U.LIKE_MIXED}::DOUBLE * c.mixed::INT + {U.LIKE_ATOMS}::DOUBLE * (c.atoms >= p75)::INT) + ({DIAGNOSTIC // 5} - r.sources[c.source]) / {DIAGNOSTIC // 5}"""


_ANY = " OR ".join(f"{f} > 0" for f in FAMILIES)


@query(f"""WITH RECURSIVE {V_RECORDS}, {_QUOTAS}, {_PICKED}, pool AS MATERIALIZED (SELECT * FROM v_records WHERE id NOT IN (SELECT id FROM chosen)),
high AS (SELECT atoms AS p75 FROM (SELECT atoms, row_number() OVER (ORDER BY atoms) AS i, count(*) OVER () AS n FROM pool) WHERE i = ceil(0.75::DOUBLE * n)),
walk AS (SELECT 0 AS step, []::BIGINT[] AS ids, (SELECT map_from_entries(list((source, 0))) FROM (SELECT DISTINCT source FROM v_records)) AS sources, MAP {{'': 0}} AS topics, 0 AS mixed, 0 AS any_, {', '.join(f'0 AS {f}' for f in FAMILIES)}, 0 AS safety, 0 AS big UNION ALL
  SELECT step + 1, list_append(ids, id), map_from_entries(list_transform(map_entries(sources), lambda e: (e.key, e.value + (e.key = source)::INT))), map_concat(topics, map([topic], [coalesce(topics[topic], 0) + 1])), mixed + d_mixed, any_ + d_any, {', '.join(f'{f} + d_{f}' for f in FAMILIES)}, safety + d_safety, big + d_big FROM (
    SELECT r.*, c.id, c.source, c.topic, c.mixed::INT AS d_mixed, ({' OR '.join(f'c.{f} > 0' for f in FAMILIES)})::INT AS d_any, {', '.join(f'(c.{f} > 0)::INT AS d_{f}' for f in FAMILIES)}, c.safety::INT AS d_safety, (c.atoms >= p75)::INT AS d_big,
      row_number() OVER (ORDER BY {_gain().replace('element_at(r.topics, c.topic)[1]', 'r.topics[c.topic]')} DESC, sha256(concat_ws(':', '{SEED}', c.id)) DESC) AS i
    FROM walk r JOIN pool c ON r.step < {DIAGNOSTIC} AND r.sources[c.source] < {DIAGNOSTIC // 5} CROSS JOIN high WHERE NOT list_contains(r.ids, c.id)) WHERE i = 1)
SELECT id, source, topic, pick, row_number() OVER (ORDER BY {_HASH}) AS place FROM (SELECT unnest(ids) AS id, unnest(range(1, len(ids) + 1)) AS pick FROM walk WHERE step = {DIAGNOSTIC}) JOIN v_records USING (id)""")
def diagnostic_subset(spark, d):
    """Records beside the representative ones that reach minima of mixed, rare, sensitive and large ones within equal quotas of the sources."""
    rows = records(spark, d)
    pool = rows.join(_representative(rows).select("id"), "id", "left_anti")
    sources = [r[0] for r in rows.select("source").distinct().collect()]
    return U.diagnostic(pool, dict.fromkeys(sources, DIAGNOSTIC // 5), FAMILIES, MINIMA, None, SEED).select("id", "source", "topic", "pick", "place")


_FEATURES = "list_filter([source, topic, CASE WHEN mixed THEN 'mixed' ELSE 'even' END, CASE WHEN n_a > 0 THEN 'A' END, CASE WHEN n_b > 0 THEN 'B' END, CASE WHEN n_c > 0 THEN 'C' END, CASE WHEN n_large > 0 THEN 'large' END, CASE WHEN n_free > 0 THEN 'free' END, 'atoms' || atoms], lambda x: x IS NOT NULL)"


@query(f"""WITH RECURSIVE {V_RECORDS}, f AS MATERIALIZED (SELECT id, mixed, n_a, {_FEATURES} AS fs FROM v_records),
walk AS (SELECT 0 AS pick, 0::BIGINT AS id, 0 AS gain, []::VARCHAR[] AS covered, []::BIGINT[] AS ids UNION ALL
  SELECT pick + 1, id, g, list_distinct(list_concat(covered, fs)), list_append(ids, id) FROM (SELECT r.pick, r.covered, r.ids, f.*, len(list_filter(fs, lambda x: NOT list_contains(r.covered, x))) AS g,
    row_number() OVER (ORDER BY g DESC, mixed DESC, n_a DESC, f.id) AS i FROM walk r JOIN f ON r.pick < {COVER} AND NOT list_contains(r.ids, f.id)) WHERE i = 1)
SELECT id, pick::BIGINT AS pick, gain::BIGINT AS gain FROM walk WHERE pick > 0""")
def feature_coverage(spark, d):
    """Twenty records for review, each with the most features that none before it has."""
    given = lambda c, name: F.when(F.col(c) > 0, name)
    features = F.array(
        "source", "topic", F.when(F.col("mixed"), "mixed").otherwise("even"), given("n_a", "A"), given("n_b", "B"), given("n_c", "C"), given("n_large", "large"), given("n_free", "free"), F.concat(F.lit("atoms"), F.col("atoms").cast("string"))
    )
    return U.coverage(records(spark, d).withColumn("features", features), "features", ["mixed", "n_a"], COVER)


_REVIEW = "v_review AS (SELECT id, topic, complexity, mixed AS structure, concat_ws('+', CASE WHEN n_a > 0 THEN 'A' END, CASE WHEN n_b > 0 THEN 'B' END, CASE WHEN n_c > 0 THEN 'C' END) AS signature, safety AS repaired, n_large >= 2 OR (n_large > 0 AND n_free > 1) AS must FROM v_records)"


@query(f"""WITH RECURSIVE {V_RECORDS}, {_REVIEW}, v AS MATERIALIZED (SELECT id, [{', '.join(f"'{c}:' || coalesce({c}::VARCHAR, '')" for c in U.BALANCE)}] AS fs, must FROM v_review),
k AS MATERIALIZED (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY fs ORDER BY sha256(concat_ws(':', '{SEED}', id))) AS i FROM v WHERE NOT must) WHERE i <= {FILL}),
walk AS (SELECT 0 AS pick, []::BIGINT[] AS ids, coalesce((SELECT list(f) FROM (SELECT unnest(fs) AS f FROM v WHERE must)), []) AS held UNION ALL
  SELECT pick + 1, list_append(ids, id), list_concat(held, fs) FROM (SELECT r.*, c.id, c.fs, row_number() OVER (ORDER BY cost, sha256(concat_ws(':', '{SEED}', c.id))) AS i FROM walk r
    JOIN LATERAL (SELECT v.id, v.fs, {' + '.join(f'{w} * coalesce(len(list_filter(r.held, lambda x: x = v.fs[{i + 1}])), 0)' for i, w in enumerate(U.BALANCE.values()))} AS cost FROM k JOIN v USING (id) WHERE NOT list_contains(r.ids, v.id)) c ON r.pick < {FILL}) WHERE i = 1),
q AS (SELECT id, NULL::BIGINT AS pick FROM v WHERE must UNION ALL SELECT unnest(ids), unnest(range(1, len(ids) + 1)) FROM walk WHERE pick = {FILL})
SELECT id, pick::BIGINT AS pick, row_number() OVER (ORDER BY pick IS NOT NULL, NOT structure, sha256(concat_ws(':', 'queue', id)), id) AS position FROM q JOIN v_review USING (id)""")
def review_queue(spark, d):
    """All records that must be reviewed, sixty others that balance what they show, in order of priority."""
    r = records(spark, d)
    given = lambda c, name: F.when(F.col(c) > 0, name)
    must = (F.col("n_large") >= 2) | ((F.col("n_large") > 0) & (F.col("n_free") > 1))
    rows = r.select("id", "topic", "complexity", F.col("mixed").alias("structure"), F.concat_ws("+", given("n_a", "A"), given("n_b", "B"), given("n_c", "C")).alias("signature"), F.col("safety").alias("repaired"), must.alias("must"))
    filled = U.review_fill(rows, "must", FILL, SEED).where("pick IS NOT NULL")
    # The structure comes along without a join of all records, whose files are small enough for Spark to send them to the driver.
    others = rows.join(F.broadcast(filled), "id").select("id", "pick", "structure")
    queue = rows.where("must").select("id", F.lit(None).cast("long").alias("pick"), "structure").unionByName(others)
    order = queue.withColumns({"late": F.col("pick").isNotNull(), "even": ~F.col("structure"), "hash": F.sha2(F.concat_ws(":", F.lit("queue"), "id"), 256)})
    return S.ordered_place(order, ["late", "even", "hash", "id"]).select("id", "pick", F.col("place").cast("long").alias("position"))


_OBJECTS, _MODIFIERS, _PLACES, _MONTHS = ["kettle", "ring", "widget", "lamp", "bolt", "gear box"], ["small", "amber", "large", "quiet"], ["by the pier", "at the depot", "in the attic"], ["March", "July"]
_PERIOD = len(_OBJECTS) * len(_MODIFIERS)


def _texts(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""WITH RECURSIVE phrases AS (SELECT r, ({_texts(_MODIFIERS)})[(r // {len(_OBJECTS)} + 1)::INT] || ' ' || ({_texts(_OBJECTS)})[(r % {len(_OBJECTS)} + 1)::INT] AS phrase FROM range({_PERIOD}) t(r)),
seq AS MATERIALIZED (SELECT p_partkey, row_number() OVER (ORDER BY sha256('scene-order:' || p_partkey)) AS i, (SELECT list(len(list_intersect(regexp_extract_all(lower(p_name), '[a-z]{{4,}}'), regexp_extract_all(lower(phrase), '[a-z]{{4,}}'))) = 0 ORDER BY r) FROM phrases) AS free FROM part),
walk AS (SELECT 0::BIGINT AS i, 0::BIGINT AS at_, NULL::BIGINT AS id UNION ALL
  SELECT s.i, at_ + list_position(list_concat(free[(at_ % {_PERIOD} + 1)::INT:], free), true), p_partkey FROM walk w JOIN seq s ON s.i = w.i + 1),
n AS (SELECT id, at_ - 1 AS scene_index, (at_ - 1) // {_PERIOD} AS beyond FROM walk WHERE i > 0)
SELECT id, scene_index, phrase AS object_phrase, ({_texts(_PLACES)})[(beyond % {len(_PLACES)} + 1)::INT] AS setting_phrase,
  ({_texts(_MONTHS)})[(beyond // {len(_PLACES)} % {len(_MONTHS)} + 1)::INT] || ' ' || (2008 + beyond // {len(_PLACES)} // {len(_MONTHS)})::VARCHAR AS time_phrase FROM n JOIN phrases ON r = scene_index % {_PERIOD}""")
def scene_assignment(spark, d):
    """A scene of its own for every part, without a word of the part's name in its object."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    order = F.sha2(F.concat(F.lit("scene-order:"), F.col("id").cast("string")), 256)
    return N.assign_scenes(rows, order, "p_name", _OBJECTS, _MODIFIERS, _PLACES, _MONTHS, 2008).drop("p_name")


def hierarchical_split(spark, d):
    """Train, dev and test of the records by domain, difficulty, profile and secondary cells; a hundredth of them are locked in test, and a pilot is drawn from train."""
    from corpuloom.operators.splits import named_split, select_partition

    given = lambda c, name: F.when(F.col(c) > 0, name)
    n = F.col("atoms")
    rows = records(spark, d).select(
        "id", F.col("source").alias("domain"), F.col("topic").alias("level"), F.concat_ws("", given("n_a", "A"), given("n_b", "B"), given("n_c", "C")).alias("labels"), F.when(F.col("safety"), "has_correct").otherwise("no_correct").alias("correct"),
        F.col("complexity").alias("dataset"), F.when(n <= 2, "00-02").when(n <= 5, "03-05").otherwise("06+").alias("atom_bucket"), (F.pmod(F.xxhash64("id"), F.lit(100)) == 0).alias("locked"),
    )
    rows = cut(rows, "records")
    tree = {"domain": "domain", "level": "level", "profile": ["labels", "correct"], "secondary": ["dataset", "atom_bucket"]}
    total = rows.count()
    split = cut(named_split(rows, {"test": total // 10, "dev": total // 10}, int(SEED), "train", "locked", **tree), "split")
    train = rows.join(split.where("split = 'train'").select("id"), "id", "left_semi")
    pilot = select_partition(train, total // 30, int(SEED) + 2, **tree).withColumn("pilot", F.lit(True))
    return split.join(pilot, "id", "left").select("id", "split", F.coalesce("pilot", F.lit(False)).alias("pilot"))


NO_SQL = {"hierarchical_split": hierarchical_split}


_BUCKETS = "CASE WHEN atoms <= 2 THEN '0-2' WHEN atoms <= 5 THEN '3-5' ELSE '6+' END"
_TWO = [f"SELECT '{c}' AS col, {c} AS v, count(*) AS n FROM v GROUP BY ALL" for c in ("source", "bucket")]


@query(f"""WITH RECURSIVE {V_RECORDS}, v AS (SELECT source, {_BUCKETS} AS bucket FROM v_records), m0 AS ({" UNION ALL ".join(_TWO)}), m1 AS (SELECT *, ({SIZE} * n) // sum(n) OVER w AS base, ({SIZE} * n) % sum(n) OVER w AS rest FROM m0 WINDOW w AS (PARTITION BY col)),
m AS (SELECT col, v, (base + (row_number() OVER (PARTITION BY col ORDER BY rest DESC, v) <= {SIZE} - sum(base) OVER (PARTITION BY col))::INT)::BIGINT AS t FROM m1),
cells AS (SELECT source, bucket, count(*) AS n, sum(count(*)) OVER () AS whole FROM v GROUP BY ALL),
steps AS (SELECT 0 AS step, c.*, 0 AS q, a.t AS ra, a.t AS ta, b.t AS rb, b.t AS tb FROM cells c JOIN m a ON a.col = 'source' AND a.v = source JOIN m b ON b.col = 'bucket' AND b.v = bucket
  UNION ALL SELECT step + 1, source, bucket, n, whole, q + (i = 1)::INT, ra - (source = f1)::INT, ta, rb - (bucket = f2)::INT, tb FROM (
    SELECT *, row_number() OVER w AS i, first_value(source) OVER w AS f1, first_value(bucket) OVER w AS f2 FROM (
      SELECT *, CASE WHEN q < n AND ra > 0 AND rb > 0 THEN ra / ta + rb / tb + (n - q) / whole END AS score FROM steps WHERE step < {SIZE}) WINDOW w AS (ORDER BY score DESC NULLS LAST, bucket DESC, source DESC)))
SELECT source, bucket, n, q::BIGINT AS quota FROM steps WHERE step = {SIZE}""")
def source_bucket_quotas(spark, d):
    """Places of each source and bucket of sizes under both margins."""
    n = F.col("atoms")
    rows = records(spark, d).withColumn("bucket", F.when(n <= 2, "0-2").when(n <= 5, "3-5").otherwise("6+"))
    return U.cell_quotas(rows, {c: U.margin(rows, c, SIZE) for c in ("source", "bucket")}, spare_share=True)
