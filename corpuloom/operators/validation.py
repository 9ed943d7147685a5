"""Validators and gates: error codes as arrays, verdicts by severity, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts from mild to severe.
SEVERITY = ("strict", "review", "reject", "invalid")


def codes(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order; a null condition doesn't hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))


def severity(verdict: Column) -> Column:
    """Rank of a verdict; unknown ones rank as invalid."""
    out = F.when(verdict == SEVERITY[0], 0)
    for i, name in enumerate(SEVERITY[1:-1], 1):
        out = out.when(verdict == name, i)
    return out.otherwise(len(SEVERITY) - 1)


def worst_of(checks: Column) -> Column:
    """The most severe verdict of an array; invalid without any."""
    top = F.array_max(F.transform(checks, severity))
    names = F.array(*map(F.lit, SEVERITY))
    return F.when(F.size(checks) > 0, F.get(names, top)).otherwise(SEVERITY[-1])


def classify(readable: Column, rejects: Column, doubts: Column) -> Column:
    """invalid unless readable, then reject, review or strict by arrays of reasons."""
    return F.when(~F.coalesce(readable, F.lit(False)), "invalid").when(F.size(rejects) > 0, "reject").when(F.size(doubts) > 0, "review").otherwise("strict")


def reject_class(reasons: Column, surface: list[str]) -> Column:
    """surface if every reason is of the surface kind, else atom; null without reasons."""
    return F.when(F.size(reasons) == 0, None).when(F.forall(reasons, lambda r: r.isin(surface)), "surface").otherwise("atom")


def judgment_codes(judgments: DataFrame, expected: DataFrame, answer: list[str]) -> DataFrame:
    """Per answer its error codes against the atoms that it must cover.

    judgments: answer columns, atom_id, predicted, task_quality; expected: sample_id, atom_id.
    """
    labels = F.col("predicted").isin("A", "B", "C")
    # An answer's atoms and a sample's are few: sets of them are compared, instead of joining every judgment.
    per = judgments.groupBy(*answer).agg(
        F.count(F.lit(1)).alias("rows_"), F.collect_set("atom_id").alias("atoms_"), F.count_if(~F.coalesce(labels, F.lit(False))).alias("bad_"), F.count_if(~F.coalesce(F.col("task_quality").between(0, 4), F.lit(False))).alias("quality_"),
        F.count_if(F.col("atom_id").isNull()).alias("none_"),
    )
    want = expected.groupBy("sample_id").agg(F.collect_set("atom_id").alias("want_"))
    per = per.join(want, "sample_id", "left")
    rules = {
        "unknown_sample": F.col("want_").isNull(),
        "missing_atoms": F.size(F.array_except("want_", "atoms_")) > 0,
        "unknown_atom": F.col("want_").isNull() | (F.size(F.array_except("atoms_", "want_")) > 0) | (F.col("none_") > 0),
        "repeated_atom": F.col("rows_") > F.size("atoms_"),
        "bad_label": F.col("bad_") > 0,
        "bad_quality": F.col("quality_") > 0,
    }
    return per.select(*answer, codes(rules).alias("errors"))


def manual_gate(df: DataFrame, overrides: DataFrame, key: str, field: str) -> DataFrame:
    """`field` replaced for keys of the override table (key, value), and whether it was. Raises if a key has two values or is unknown."""
    o = overrides.select(key, F.col("value").alias("value_"))
    if not o.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("an override occurs more than once")
    if not o.join(df.select(key), key, "left_anti").isEmpty():
        raise ValueError("an override names an unknown key")
    return df.join(o.withColumn("overridden", F.lit(True)), key, "left").withColumn(field, F.coalesce("value_", field)).withColumn("overridden", F.coalesce("overridden", F.lit(False))).drop("value_")


def assert_counts(df: DataFrame, by: str, expected: dict[str, int]) -> None:
    """Raises unless `by` has exactly the expected numbers of rows. The values are a bounded set of names."""
    got = {r[0]: r[1] for r in df.groupBy(by).count().limit(len(expected) + 10).collect()}
    if got != expected:
        raise ValueError(f"counts by {by} are {got}, expected {expected}")


def patch(df: DataFrame, patches: DataFrame, key: str, fields: list[str], locked: list[str]) -> DataFrame:
    """Fields replaced by a patch's non-null values; a patch that touches locked fields is refused.

    Returns df's columns with `patched` (true, false) and `refused` (locked fields that the patch changes).
    """
    p = patches.select(key, *[F.col(c).alias(f"{c}_p") for c in (*fields, *locked)])
    both = df.join(p, key, "left")
    refused = F.array_compact(F.array(*[F.when(F.col(f"{c}_p").isNotNull() & ~F.col(f"{c}_p").eqNullSafe(F.col(c)), F.lit(c)) for c in locked])) if locked else F.array().cast("array<string>")
    both = both.withColumn("refused", refused)
    good = F.size("refused") == 0
    changed = F.lit(False)
    for c in fields:
        changed = changed | (F.col(f"{c}_p").isNotNull() & ~F.col(f"{c}_p").eqNullSafe(F.col(c)))
    both = both.withColumn("patched", good & changed)
    new = {c: F.when(good, F.coalesce(f"{c}_p", c)).otherwise(F.col(c)) for c in fields}
    return both.withColumns(new).select(*df.columns, "patched", "refused")


def rank_distance(a: Column, b: Column) -> Column:
    """Distance of two labels on the scale A, B, C."""
    rank = lambda c: F.when(c == "A", 0).when(c == "B", 1).when(c == "C", 2)
    return F.abs(rank(a) - rank(b))


def char_budget_chunks(lengths: Column, budget: int) -> Column:
    """Chunk number of each item of an array of lengths: an item opens a new chunk if it doesn't fit the current one."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        fits = (acc["used"] + x <= budget) | (F.size(acc["out"]) == 0)
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        used = F.when(fits, acc["used"] + x).otherwise(x).cast("long")
        return F.struct(used.alias("used"), chunk.alias("chunk"), F.concat(acc["out"], F.array(chunk)).alias("out"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])
