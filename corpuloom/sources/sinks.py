"""Sinks: records, reports, ordered shards and their verification."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def write_json_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.option("compression", compression).option("ignoreNullFields", False).json(path)


def nested_as_json(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for readers that take flat tables only."""
    nested = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    nested_as_json(df).write.option("header", True).csv(path)


def write_ids(df: DataFrame, key: str, path: str) -> None:
    df.select(F.col(key).cast("string")).write.text(path)


def report(df: DataFrame, most: int = 100_000) -> str:
    """A bounded result (metrics, counts) as a JSON document; more rows than `most` raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], indent=2, ensure_ascii=False, sort_keys=True, default=str)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A bounded result as a Markdown table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table holds at most {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(map(cell, line)) + " |" for line in lines)


def row_targets(total: int, shards: int) -> list[int]:
    """Rows of each shard: an equal part, the remainder one each to the first."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def with_shard(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """row (from 0, in order) and shard: contiguous parts of the order with the sizes of row_targets.

    Positions come from a range partitioning and a sum over the partitions' counts, never from one window over all rows.
    """
    from corpuloom.session import cut

    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id()), "ranged")
    counts = parts.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    # A row per partition, so a single window over them is bounded by their number.
    w = Window.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part_", F.coalesce(F.sum("n_").over(w), F.lit(0)).alias("start_"), F.sum("n_").over(Window.partitionBy(F.lit(0))).alias("all_"))
    place = F.row_number().over(Window.partitionBy("part_").orderBy(*order)) - 1
    out = parts.withColumn("place_", place).join(F.broadcast(starts), "part_").withColumn("row", (F.col("start_") + F.col("place_")).cast("long"))
    long = F.expr(f"all_ % {shards}") * F.expr(f"all_ div {shards} + 1")
    shard = F.when(F.col("row") < long, F.expr(f"row div (all_ div {shards} + 1)")).otherwise(F.expr(f"all_ % {shards} + (row - (all_ % {shards}) * (all_ div {shards} + 1)) div greatest(all_ div {shards}, 1)"))
    return out.withColumn("shard", shard.cast("long")).drop("part_", "place_", "start_", "all_")


def write_shards(df: DataFrame, order: list[str], shards: int, path: str) -> None:
    """Parquet by shard, rows of a shard in order."""
    with_shard(df, order, shards).repartition(shards, "shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").parquet(path)


def file_digests(spark: SparkSession, glob: str) -> DataFrame:
    """path, bytes, sha256 of files of up to 2 GB each."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_files(spark: SparkSession, glob: str, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or different from expected (path, sha256); no rows for a sound release."""
    got = file_digests(spark, glob).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("sha256").alias("got"))
    both = expected.select("path", "sha256").join(got, "path", "full_outer")
    status = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("got") != F.col("sha256"), "different")
    return both.select("path", status.alias("status")).where("status is not null")


def scalars(df: DataFrame, keys: list[str], prefix: str = "metrics") -> DataFrame:
    """tag, value: each numeric column of each row under a path of the row's keys and the column's name; nulls and NaN are left out."""
    numeric = [f.name for f in df.schema if f.name not in keys and f.dataType.typeName() in ("double", "float", "long", "integer", "decimal", "short")]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in numeric]))
    out = df.select(*keys, pairs.alias("p"))
    return out.select(F.concat_ws("/", F.lit(prefix), *keys, "p.name").alias("tag"), "p.value").where("value is not null and not isnan(value)")
