"""Incremental runs over a table of requests: what is left to do, repair, reuse, failures, and a stream of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from corpuloom.operators.merges import latest_valid, pending


def result_state(error: Column, text: Column, finish: Column, allow_length: bool = False) -> Column:
    """Null for a sound result, else why it is not: error, empty, length or finish."""
    length = F.when(finish == "length", F.lit(None) if allow_length else F.lit("length"))
    return F.when(F.coalesce(F.trim(error), F.lit("")) != "", "error").when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(finish == "length", length).when(
        F.coalesce(finish, F.lit("")) != "stop", "finish"
    )


def complete(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results whose fingerprint is their request's and whose state is sound."""
    return results.where("state is null").join(requests.select("request_id", "fingerprint"), ["request_id", "fingerprint"], "left_semi")


def to_do(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests without a complete result."""
    return pending(requests, complete(results, requests), ["request_id", "fingerprint"])


def repair(results: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, moved): results that a resumed run keeps, one per request, and those it moves to an audit table."""
    good = complete(results, requests)
    kept = latest_valid(good, "request_id", F.lit(True), "attempt")
    return kept, results.join(kept.select("request_id", "attempt"), ["request_id", "attempt"], "left_anti")


def prefill(requests: DataFrame, prior: DataFrame) -> DataFrame:
    """Results of an earlier run for requests of the same id and fingerprint."""
    return complete(prior, requests).join(requests.select("request_id", "fingerprint"), ["request_id", "fingerprint"], "left_semi")


def with_failures(requests: DataFrame, results: DataFrame, reason: str = "inference_failure") -> DataFrame:
    """Results with a failed row for each request that has none."""
    missing = requests.join(results.select("request_id"), "request_id", "left_anti").select("request_id", "fingerprint", F.lit(reason).alias("state"))
    return results.unionByName(missing, allowMissingColumns=True)


def failure_judgments(judgments: DataFrame, failed: DataFrame, key: str = "sample_id") -> DataFrame:
    """Judgments of failed answers get the lowest label and quality 0."""
    hit = judgments.join(failed.select(key).distinct().withColumn("failed_", F.lit(True)), key, "left")
    bad = F.coalesce("failed_", F.lit(False))
    return hit.withColumn("predicted", F.when(bad, "A").otherwise(F.col("predicted"))).withColumn("task_quality", F.when(bad, 0).otherwise(F.col("task_quality"))).drop("failed_")


def stream_results(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, requests: DataFrame) -> StreamingQuery:
    """Appends new complete results to `sink`; each file of `source` is taken once, also after a restart.

    A batch keeps one result per request and none that the sink already has, and replaces its own
    partition if it runs again, so that a lost executor or a restart gives no row twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        fresh = latest_valid(complete(df, requests), "request_id", F.lit(True), "attempt")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            before = spark.read.parquet(sink).where(F.col("batch") != number)
            fresh = fresh.join(before.select("request_id"), "request_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Rows done and rows a minute of a query."""

    def __init__(self):
        self.rows, self.per_minute = 0, 0.0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.per_minute = 60 * event.progress.processedRowsPerSecond

    def onQueryTerminated(self, event):
        pass
