"""Derived views over the driver's tables, as DataFrames and as SQL for the comparison engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.session import table

MODELS = ("m0", "m1", "m2", "m3", "m4")
CONDITIONS = ("full_memory", "no_memory")

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hash_int(*parts: Column | str) -> Column:
    """The first 15 hex digits of the SHA-256 of parts joined by colons, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long")


def sources(spark: SparkSession, d: str) -> DataFrame:
    domain = F.when(F.col("lang") == "en", "general").when(F.col("lang") == "de", "coding").otherwise("health")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("source_dataset"), F.col("lang").alias("topic"), F.col("text").alias("raw_question"), domain.alias("domain")
    )


def atoms(spark: SparkSession, d: str) -> DataFrame:
    gold = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "N", "B").otherwise("C")
    atom = F.concat_ws("_", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), atom.alias("atom_id"), gold.alias("gold"), F.pmod(F.col("l_suppkey"), F.lit(4)).alias("block")
    )


def judgments(spark: SparkSession, d: str, salt: str = "", also: str | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Every atom judged for each model and condition; predictions follow a stable hash. `also`: the salt of a second rater, whose labels become the column also.

    cells: the atoms, dealt by sample, so that what is grouped by sample needs no shuffle of ten times as many judgments.
    """
    cells = atoms(spark, d) if cells is None else cells
    cells = cells.withColumn("model", F.explode(F.array(*map(F.lit, MODELS)))).withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS))))
    def predicted(h):
        other = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.pmod(h, F.lit(3)) + 1).cast("int"))
        return F.when(F.pmod(h, F.lit(10)) < 6, F.col("gold")).otherwise(other)

    hashed = lambda s: hash_int(*([F.lit(s)] if s else []), "sample_id", "atom_id", "model", "condition")
    cells = cells.withColumn("h", hashed(salt)).withColumn("predicted", predicted(F.col("h")))
    return cells if also is None else cells.withColumn("h_also", hashed(also)).withColumn("also", predicted(F.col("h_also"))).drop("h_also")


def level_of(label: str) -> Column:
    return F.when(F.col(label) == "A", 0).when(F.col(label) == "B", 1).otherwise(2)


def levels(df: DataFrame) -> DataFrame:
    """Ordinal levels of labels: A 0, B 1, C 2, and over- and under-use."""
    df = df.withColumn("g", level_of("gold")).withColumn("p", level_of("predicted"))
    return df.withColumn("over", F.greatest(F.col("p") - F.col("g"), F.lit(0))).withColumn("under", F.greatest(F.col("g") - F.col("p"), F.lit(0)))


def samples(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("sample_id"), F.col("c_mktsegment").alias("domain"), F.col("o_orderpriority").alias("difficulty"), F.col("o_totalprice").alias("price")
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.sha2(F.concat_ws(":", F.lit("req"), "o_orderkey"), 256).alias("fingerprint"))


def attempts(spark: SparkSession, d: str) -> DataFrame:
    """Attempts 1 to 3 of each request: missing, invalid or valid by hash."""
    rows = requests(spark, d).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    rows = rows.withColumn("h", hash_int(F.lit("attempt"), "request_id", "attempt"))
    state = F.when(F.pmod("h", F.lit(10)) < 2, "missing").when(F.pmod("h", F.lit(10)) < 5, "invalid").otherwise("valid")
    return rows.withColumn("state", state).where("state <> 'missing'").select("request_id", "fingerprint", "attempt", "state", F.pmod("h", F.lit(1000)).alias("tokens"))


def _h(*parts: str) -> str:
    return f"('0x' || substr(sha256(concat_ws(':', {', '.join(parts)})), 1, 15))::BIGINT"


V_SOURCES = "v_source AS (SELECT doc_id AS id, source AS source_dataset, lang AS topic, text AS raw_question, CASE lang WHEN 'en' THEN 'general' WHEN 'de' THEN 'coding' ELSE 'health' END AS domain FROM documents)"
V_ATOMS = "v_atoms AS (SELECT l_orderkey AS sample_id, concat_ws('_', l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS atom_id, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'B' ELSE 'C' END AS gold, l_suppkey % 4 AS block FROM lineitem)"


def v_judgments(name: str = "v_judgments", salt: str = "") -> str:
    h = _h(*([f"'{salt}'"] if salt else []), "sample_id", "atom_id", "model", "condition")
    return f"""{name}_h AS (SELECT *, {h} AS h FROM v_atoms CROSS JOIN (SELECT unnest({list(MODELS)}) AS model) CROSS JOIN (SELECT unnest({list(CONDITIONS)}) AS condition)),
{name}_p AS (SELECT *, CASE WHEN h % 10 < 6 THEN gold ELSE (['A','B','C'])[(h % 3) + 1] END AS predicted FROM {name}_h),
{name} AS (SELECT *, greatest(p - g, 0) AS over, greatest(g - p, 0) AS under FROM (SELECT *, CASE gold WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS g, CASE predicted WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END AS p FROM {name}_p))"""


J = f"WITH {V_ATOMS}, {v_judgments()}"
V_SAMPLES = "v_samples AS (SELECT o_orderkey AS sample_id, c_mktsegment AS domain, o_orderpriority AS difficulty, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey)"
V_ATTEMPTS = f"""v_requests AS (SELECT o_orderkey AS request_id, sha256(concat_ws(':', 'req', o_orderkey)) AS fingerprint FROM orders),
v_attempts AS (SELECT request_id, fingerprint, attempt, CASE WHEN h % 10 < 5 THEN 'invalid' ELSE 'valid' END AS state, h % 1000 AS tokens FROM (
  SELECT *, {_h("'attempt'", "request_id", "attempt")} AS h FROM v_requests CROSS JOIN (SELECT unnest([1, 2, 3]) AS attempt)) WHERE h % 10 >= 2)"""
