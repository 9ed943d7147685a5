"""Sources: files of records as DataFrames with one canonical set of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuloom.functions import text as X
from corpuloom.operators.merges import duplicate_keys

#: Columns of a canonical source record.
CANONICAL = ("id", "domain", "source_dataset", "source_split", "source_license", "raw_question", "source_context", "source_answer", "topic", "source_metadata")


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, plain or compressed; a malformed line fails the read. The schema is given, so nothing is inferred by a pass over the data."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A JSON array or object that spans lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def canonical(df: DataFrame, **columns: Column) -> DataFrame:
    """The canonical columns from expressions; those not given are null. Text columns are cleaned."""
    out = []
    for name in CANONICAL:
        c = columns.get(name, F.lit(None).cast("string"))
        out.append((X.clean_source(c) if name in ("raw_question", "source_answer", "source_context") else c.cast("string")).alias(name))
    return df.select(*out)


def length_gate(df: DataFrame, question: tuple[int, int], answer: int) -> DataFrame:
    return df.where(F.length("raw_question").between(*question) & (F.length("source_answer") >= answer))


def ancestors(edges: DataFrame, depth: int = 12) -> DataFrame:
    """id, chain: each node's ancestors, root first, at most `depth` of them; a cycle ends the chain.

    edges: id (unique), parent_id. One join a level, on the nodes that still climb.
    """
    links = edges.select(F.col("id").alias("up_"), F.col("parent_id").alias("next_"))
    out = edges.select("id", F.col("parent_id").alias("at"), F.array().cast("array<string>").alias("chain"))
    for _ in range(depth):
        found = out.join(links, out["at"] == links["up_"], "left")
        fresh = F.col("up_").isNotNull() & ~F.array_contains("chain", F.col("up_").cast("string")) & (F.col("up_") != F.col("id"))
        chain = F.when(fresh, F.concat(F.array(F.col("up_").cast("string")), "chain")).otherwise(F.col("chain"))
        out = found.select("id", F.when(fresh, F.col("next_")).alias("at"), chain.alias("chain"))
    return out.select("id", "chain")


def dialogue_tree(messages: DataFrame, lang: str = "en", exclude: str | None = None) -> DataFrame:
    """Answers joined to the prompt above them: id, question, answer, and the chain of ancestors of the prompt.

    messages: message_id, parent_id, role, lang, text, deleted, review_result.
    """
    good = messages.where((F.col("lang") == lang) & ~F.coalesce("deleted", F.lit(False)) & F.coalesce("review_result", F.lit(True)))
    a = good.where("role = 'assistant'").select(F.col("message_id").alias("id"), F.col("parent_id").alias("prompt"), F.col("text").alias("answer"))
    q = good.where("role = 'prompter'").select(F.col("message_id").alias("prompt"), F.col("text").alias("question"))
    pairs = a.join(q, "prompt")
    if exclude:
        pairs = pairs.where(~F.concat_ws("\n", "question", "answer").rlike(exclude))
    chains = ancestors(messages.select(F.col("message_id").alias("id"), "parent_id"))
    return pairs.join(chains.withColumnRenamed("id", "prompt"), "prompt", "left").select("id", "question", "answer", "chain")


def chat_turns(conversations: DataFrame, key: str, turn: str, role: str, text: str, most: int = 6000) -> DataFrame:
    """Assistant turns after a user's, with the last `most` characters of what came before."""
    w = Window.partitionBy(key).orderBy(turn)
    before = F.array_join(F.collect_list(F.concat(F.initcap(role), F.lit(": "), text)).over(w.rowsBetween(Window.unboundedPreceding, -2)), "\n")
    t = conversations.withColumn("prev_", F.lag(role).over(w)).withColumn("question", F.lag(text).over(w)).withColumn("before_", before)
    return t.where((F.col(role) == "assistant") & (F.col("prev_") == "user")).select(key, turn, "question", F.col(text).alias("answer"), F.ltrim(F.right("before_", F.lit(most))).alias("context"))


def chat_messages(prompts: DataFrame, key: str = "prompt_id", messages: str = "messages") -> DataFrame:
    """Nested message arrays as rows of key, turn, role, text."""
    return prompts.select(key, F.posexplode(messages).alias("turn", "m")).select(key, "turn", F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def programming_tasks(rows: DataFrame) -> DataFrame:
    """First solution of each task, its starter code and whether tests name a function; tasks without a solution go.

    rows: problem_id, question, solutions (JSON array as text), input_output (JSON), starter_code, difficulty.
    """
    first = F.get(F.from_json("solutions", "array<string>"), F.lit(0))
    named = F.get_json_object("input_output", "$.fn_name").isNotNull()
    return rows.select("problem_id", "question", first.alias("answer"), "starter_code", "difficulty", named.alias("function_task")).where("trim(answer) <> ''")


def best_answer(answers: Column) -> Column:
    """The answer with text that is selected, then of the highest score (none counts as -1), then of the smallest id."""
    usable = F.filter(answers, lambda a: F.trim(a["text"]) != "")
    ranked = F.transform(
        usable,
        lambda a: F.struct(F.coalesce(a["selected"], F.lit(False)).alias("s"), F.coalesce(a["pm_score"], F.lit(-1)).alias("p"), (-a["answer_id"].cast("long")).alias("i"), a.alias("a")),
    )
    return F.array_max(ranked)["a"]


def preference_qa(rows: DataFrame) -> DataFrame:
    """Each question's best answer as text, with the fields that attribution needs. rows: qid, question (HTML), answers."""
    df = rows.withColumn("best_", best_answer(F.col("answers"))).where("best_ is not null")
    return df.select(
        "qid", X.html_to_text(F.col("question")).alias("question"), X.html_to_text(F.col("best_.text")).alias("answer"),
        F.col("best_.answer_id").alias("answer_id"), F.col("best_.author").alias("author"), F.col("best_.author_profile").alias("author_profile"),
    )


def attribution_errors(fields: dict[str, Column]) -> Column:
    """Names of the fields that are null or blank."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(n)) for n, c in fields.items()]))


def partitions(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of partitions with their name as `decision`; raises if a key is in two or twice in one."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("decision", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    twice = duplicate_keys(out, [key]).limit(3).collect()
    if twice:
        raise ValueError(f"keys in more than one partition: {[r[0] for r in twice]}")
    return out


def staged(stages: list[DataFrame], key: str, final: Column) -> DataFrame:
    """One row per key over stages in order: the earliest row that is final, or else the latest. Later rows never replace a final one."""
    rows = None
    for i, df in enumerate(stages):
        df = df.withColumn("stage", F.lit(i))
        rows = df if rows is None else rows.unionByName(df)
    order = F.struct(final.cast("int").alias("f"), F.when(final, -F.col("stage")).otherwise(F.col("stage")).alias("s"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")


def by_path(spark: SparkSession, glob: str, schema: StructType | str, pattern: str, names: list[str]) -> DataFrame:
    """JSON lines of many files, with columns taken from groups of each file's path."""
    df = spark.read.schema(schema).json(glob).withColumn("path_", F.col("_metadata.file_path"))
    for i, n in enumerate(names, 1):
        df = df.withColumn(n, F.regexp_extract("path_", pattern, i))
    return df.drop("path_")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-empty lines as ids; raises if one occurs twice."""
    ids = spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")
    twice = duplicate_keys(ids, ["id"]).limit(3).collect()
    if twice:
        raise ValueError(f"ids occur more than once: {[r[0] for r in twice]}")
    return ids
