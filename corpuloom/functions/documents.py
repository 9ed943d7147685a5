"""JSON documents as columns: canonical text and digest, and the numbers at all paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuloom.session import cut


def canonical(json: Column) -> Column:
    """A JSON text with the keys of all its objects in order and no white space; null for a text that isn't JSON or has a key twice.

    VARIANT keeps the keys of objects sorted. Numbers of one value are written alike: 1.0 as 1, 1e3 as 1000.0.
    """
    return F.to_json(F.try_parse_json(json))


def canonical_digest(json: Column) -> Column:
    """SHA-256 of the canonical text: equal documents have equal digests, whatever the order of keys."""
    return F.sha2(canonical(json).cast("binary"), 256)


def numeric_paths(df: DataFrame, key: str, json: str, skip: tuple[str, ...] = (), most: int = 64) -> DataFrame:
    """key, path, value: all finite numbers within the objects of JSON texts, under their keys joined by full stops.

    Booleans, nulls, texts and whatever is in arrays are left out, as are keys in `skip`. A number that is the whole
    document has the empty path. A level of nesting is one pass, so passes are as many as the deepest document has levels; deeper
    than `most` raises. Texts that aren't JSON give no rows.
    """
    spark = df.sparkSession
    level = df.select(F.col(key).alias("key"), F.lit(None).cast("string").alias("path"), F.try_parse_json(json).alias("v"))
    found = None
    for _ in range(most):
        kind = F.schema_of_variant("v")
        level = cut(level.withColumn("kind", kind).where("v is not null and (kind like 'OBJECT<%' or kind in ('BIGINT', 'DOUBLE', 'FLOAT') or kind like 'DECIMAL(%')"), "paths")
        numbers = level.where("kind not like 'OBJECT<%'").select("key", F.coalesce("path", F.lit("")).alias("path"), F.expr("try_variant_get(v, '$', 'double')").alias("value"))
        numbers = numbers.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
        found = numbers if found is None else found.unionByName(numbers)
        objects = level.where("kind like 'OBJECT<%'")
        if objects.isEmpty():
            return found.select(F.col("key").alias(key), "path", "value")
        name = f"paths_{id(objects)}"
        objects.createOrReplaceTempView(name)
        inner = spark.sql(f"SELECT o.key, concat_ws('.', o.path, e.key) AS path, e.value AS v, e.key AS name FROM {name} o, LATERAL variant_explode(o.v) e")
        level = (inner.where(~F.col("name").isin(*skip)) if skip else inner).drop("name")
    raise ValueError(f"documents are nested deeper than {most} levels")
