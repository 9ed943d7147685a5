"""A corpus pipeline of five of the operators, each on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuloom.llm.bpe import bpe_digest
from corpuloom.llm.kneser_ney import quality
from corpuloom.llm.minhash_dedup import minhash_dedup
from corpuloom.llm.mixing import mixed_documents
from corpuloom.llm.toxicity import keep_harmless
from corpuloom.session import clear_scratch, cut, scratch_path, scratch_paths, table


def _rows(docs: DataFrame) -> DataFrame:
    """row (all columns, whatever their names), and id and hash (of the text), which tell documents apart."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("id"), F.xxhash64(docs["text"]).alias("hash"))


def _without(rows: DataFrame, gone: DataFrame, same: list[str]) -> DataFrame:
    """The rows that agree with none of `gone` in the columns `same`; nulls agree with nulls."""
    gone = gone.select(*same).distinct().alias("gone")
    on = F.lit(True)
    for c in same:
        on = on & rows[c].eqNullSafe(F.col(f"gone.{c}"))
    return rows.join(gone.hint("merge"), on, "left_anti")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, T.MapType | T.VariantType)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model does not reject; null and empty texts, repeated rows and null ids stay as keep_harmless() says."""
    return keep_harmless(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose perplexity is within their language's bounds; null and empty texts have none and go.

    Each row is judged by its own id, text and language, a null id like any other, so that a
    rejected text takes no other row of its id along. Repeated rows stay or go together.
    """
    verdict = quality(docs, table(spark, sf_dir, "labels"))
    gone = verdict.where("not kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "lang")
    rows = _rows(docs).withColumn("lang", F.col("row.lang").cast("string"))
    return _without(rows, gone, ["id", "hash", "lang"]).select("row.*")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by five-word shingles; of repeated rows one.

    Rows are told apart by doc_id and text, so one id with different texts loses only the rows that are copies.
    Of rows that agree in both, the one whose other columns come first by hash stays; columns of any type do.
    Rows without an id all stay, as do texts without a word, which are near to nothing.
    """
    found = cut(minhash_dedup(docs, k=5, num=80, den=100), "verdicts").withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    left = _without(_rows(docs), found.where("not kept"), ["id", "hash"])
    if found.where("id is not null").groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return left.select("row.*")
    plain = [f.name for f in docs.schema.fields if _orderable(f.dataType)]
    others = [f.name for f in docs.schema.fields if f.name not in plain]
    key = [F.xxhash64(*[F.col("row").getField(c) for c in plain]), *[F.to_json(F.struct(F.col("row").getField(c).alias("c"))) for c in others]]
    one = left.where("id is not null").groupBy("id", "hash").agg(F.min_by("row", F.struct(*key)).alias("row"))
    return one.select("row.*").unionByName(left.where("id is null").select("row.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of its source takes it; empty and null texts as mixed_documents() says."""
    return mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; a null text is empty."""
    return bpe_digest(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("minhash", minhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Models and seeded choices can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; each result is written as Parquet and read again.

    Ids may be null or repeated, with equal texts or not; columns beyond those of documents are carried
    along; an empty table gives an empty result.
    """
    docs, since = table(spark, sf_dir, "documents"), len(scratch_paths(spark))
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # What the stage and its predecessor wrote is no longer read.
        clear_scratch(spark, since, keep=(path,))
    return docs
