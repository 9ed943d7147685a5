"""Unique assignment along one sequence: every row takes the next number that its text doesn't conflict with.

A number that a row skips is lost, so a row's number depends on all rows before it. But only the
remainder of the number decides a conflict: for each remainder that a run of rows could begin
at, one pass tells how far the run gets. Runs are composed on the driver, one row of remainders
each, and then numbered in parallel, with the result of going through them one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuloom.session import cut, ship

WORD = "[a-z]{4,}"


def _after(cursor: np.ndarray, words: list[str], conflicts: dict[str, np.ndarray], period: int, known: dict) -> np.ndarray:
    """The numbers that a row takes for each cursor: the first at or after it whose phrase shares no word."""
    if not words:
        return cursor
    key = tuple(sorted(words))
    if key not in known:
        bad = np.logical_or.reduce([conflicts[w] for w in key])
        if bad.all():
            raise ValueError("a text conflicts with every phrase")
        free = np.flatnonzero(~np.concatenate([bad, bad]))
        known[key] = free[np.searchsorted(free, np.arange(period))] - np.arange(period)
    return cursor + known[key][cursor % period]


def assign_scenes(blocks: DataFrame, order: Column, question: str, objects: list[str], modifiers: list[str], settings: list[str], months: list[str], first_year: int) -> DataFrame:
    """blocks with scene_index, object_phrase, setting_phrase and time_phrase: no two rows share a scene, and no question holds a word (four letters or more) of its object phrase.

    Rows go in the order of `order`, which should tell them apart. A scene is a number: its remainders give the
    object, its modifier, the setting and the month, what is left the year. Null questions conflict with nothing.
    ValueError where a question conflicts with every phrase. The result does not depend on partitions.
    """
    spark = blocks.sparkSession
    ship(spark)
    period = len(objects) * len(modifiers)
    phrases = [f"{modifiers[r // len(objects)]} {objects[r % len(objects)]}" for r in range(period)]
    conflicts: dict[str, np.ndarray] = {}
    for r, phrase in enumerate(phrases):
        for w in set(re.findall(WORD, phrase.lower())):
            conflicts.setdefault(w, np.zeros(period, bool))[r] = True
    shared = spark.sparkContext.broadcast(conflicts)
    words = F.array_intersect(F.regexp_extract_all(F.lower(F.coalesce(F.col(question), F.lit(""))), F.lit(f"({WORD})"), 1), F.array(*map(F.lit, sorted(conflicts))))
    row = F.struct(*[F.col(f"`{c}`") for c in blocks.columns])
    ranged = blocks.select(row.alias("row"), order.alias("order"), words.alias("words")).repartitionByRange("order").withColumn("part", F.spark_partition_id())
    dealt = cut(ranged, "scenes")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = dealt.repartition(n, "part").sortWithinPartitions("part", "order")

    def far(batches):
        cursor, last, known = np.arange(period), None, {}
        out = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([(cursor - np.arange(period)).tolist()], pa.list_(pa.int64()))], ["part", "far"])
        for b in batches:
            for part, w in zip(b.column("part").to_pylist(), b.column("words").to_pylist(), strict=True):
                if last is not None and part != last:
                    yield out()
                    cursor = np.arange(period)
                last = part
                cursor = _after(cursor, w, shared.value, period, known) + 1
        if last is not None:
            yield out()

    starts, cursor = {}, 0
    for r in sorted(runs.select("part", "words").mapInArrow(far, "part int, far array<long>").collect(), key=lambda r: r.part):  # a row for each partition
        starts[r.part] = cursor
        cursor += r.far[cursor % period]

    def number(batches):
        at, last, known = 0, None, {}
        for b in batches:
            out = []
            for part, w in zip(b.column("part").to_pylist(), b.column("words").to_pylist(), strict=True):
                if part != last:
                    at, last = starts[part], part
                at = int(_after(np.array([at]), w, shared.value, period, known)[0])
                out.append(at)
                at += 1
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.int64())], ["row", "scene_index"])

    kind = f"row {blocks.schema.simpleString()}"
    found = runs.select("row", "part", "words").mapInArrow(number, f"{kind}, scene_index long")
    i = F.col("scene_index")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (F.pmod(at, F.lit(len(values))) + 1).cast("int"))
    beyond = F.floor(i / period)
    time = F.floor(beyond / len(settings))
    return found.select(
        "row.*", "scene_index", F.concat_ws(" ", pick(modifiers, F.floor(i / len(objects))), pick(objects, i)).alias("object_phrase"), pick(settings, beyond).alias("setting_phrase"),
        F.concat_ws(" ", pick(months, time), (F.lit(first_year) + F.floor(time / len(months))).cast("string")).alias("time_phrase"),
    )
