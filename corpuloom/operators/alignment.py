"""Whether the rubric of an atom speaks of that atom: overlaps of words within a record, without leaving its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuloom.functions import text as X

# Fixed values of the published audit: tokens, marked tokens, words that don't count, and thresholds.
TOKEN = r"(\.?[A-Za-z0-9][A-Za-z0-9_.+/#:-]*)"
MARKED = r"^(?:[a-z]+[A-Z][A-Za-z0-9]*|[A-Z]{2,}[A-Za-z0-9]*|[A-Za-z]+[0-9][A-Za-z0-9.]*|[A-Za-z0-9_.-]+[/][A-Za-z0-9_./-]+)$"
STOPWORDS = tuple(
    "a all an and answer application applications as at be before behavior by can correct developer does for from has have how if in into is it its must not of on or output plan project provide required requires script should specific states system task that the their this to use used user using when where which with without".split()
)
SWAP_LEAST, SWAP_MARGIN, UNSUPPORTED_BELOW, VERY_LOW_BELOW, ATOM_LEAK, RUBRIC_LEAK, LEAST_WORDS = 0.34, 0.20, 0.15, 0.10, 0.72, 0.82, 3


def words(c: Column) -> Column:
    """Distinct tokens, lower-case, without marks at their ends, of two characters or more that count."""
    found = F.transform(F.regexp_extract_all(X.normalise(c), F.lit(TOKEN), 1), lambda t: F.regexp_replace(F.lower(t), r"^[._/-]+|[._/-]+$", ""))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS)))


def marked(c: Column) -> Column:
    """Distinct tokens that name something: with a leading full stop, numbers, and those with inner capitals, digits or slashes."""
    found = F.filter(F.regexp_extract_all(X.normalise(c), F.lit(TOKEN), 1), lambda t: t.startswith(".") | t.rlike(r"^\.*[0-9]+$") | t.rlike(MARKED))
    return F.array_distinct(F.transform(found, lambda t: F.regexp_replace(F.lower(t), r"^[.,;:()\[\]{}]+|[.,;:()\[\]{}]+$", "")))


def share(left: Column, right: Column) -> Column:
    """Share of the right words that are among the left ones; 0 without any on either side."""
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.size(F.array_intersect(left, right)) / F.size(right)).otherwise(0.0)


def _once(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row_")).select("row_.*")


def alignment(df: DataFrame) -> DataFrame:
    """id, atom_id, reasons, atom_rubric_overlap, best_other_atom_id, best_other_atom_overlap, atom_question_overlap, rubric_question_overlap, unsupported: one row per atom.

    df: id, question and atoms, an array of atom_id, support (all that is said of the atom) and expected (what its rubric asks for). Null texts
    have no words. Of equal overlaps with other atoms the first counts. Records without atoms give no rows.
    """
    each = lambda f, key: F.transform("atoms", lambda a: f(F.coalesce(a[key], F.lit(""))))
    f = _once(df.select("id", F.coalesce("question", F.lit("")).alias("question"), "atoms").where("atoms is not null"))
    f = _once(f.select("id", words(F.col("question")).alias("q"), F.transform("atoms", lambda a: a["atom_id"]).alias("ids"), each(words, "support").alias("s"), each(words, "expected").alias("e"), each(marked, "support").alias("ms"), each(marked, "expected").alias("me")))
    # Words of all atoms are columns of the record's row; an atom is compared with its neighbours there.
    f = f.select("*", F.posexplode("ids").alias("i", "atom_id"))
    at = lambda c: F.get(F.col(c), F.col("i"))
    f = _once(f.select("id", "i", "atom_id", "q", "ids", "s", at("s").alias("own"), at("e").alias("want"), at("ms").alias("own_marked"), at("me").alias("want_marked")))
    others = F.filter(F.transform("s", lambda x, j: F.struct(share(x, F.col("want")).alias("score"), (-j).alias("j"))), lambda x: x["j"] != -F.col("i"))
    f = _once(f.select(
        "id", "i", "atom_id", "q", "ids", "own", "want", "own_marked", "want_marked", share(F.col("own"), F.col("want")).alias("a"), F.array_max(others).alias("best"), F.array_sort(F.array_except("want_marked", "own")).alias("unsupported"),
        share(F.col("q"), F.col("own")).alias("aq"), share(F.col("q"), F.col("want")).alias("rq"),
    ))
    other = F.coalesce(F.col("best.score"), F.lit(0.0))
    inside = lambda c: F.size(F.array_except(c, "q")) == 0
    reasons = {
        "probable_cross_atom_rubric_swap": (other >= SWAP_LEAST) & (other >= F.col("a") + SWAP_MARGIN), "rubric_introduces_unsupported_identifier": (F.col("a") < UNSUPPORTED_BELOW) & (F.size("unsupported") > 0),
        "very_low_atom_rubric_overlap": (F.col("a") < VERY_LOW_BELOW) & (F.size("want") >= LEAST_WORDS), "probable_query_atom_value_leakage": (F.col("aq") >= ATOM_LEAK) & (F.size("own") >= LEAST_WORDS) & inside("own_marked"),
        "probable_query_rubric_value_leakage": (F.col("rq") >= RUBRIC_LEAK) & (F.size("want") >= LEAST_WORDS) & inside("want_marked"),
    }
    return f.select(
        "id", "atom_id", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()])).alias("reasons"), F.round("a", 6).alias("atom_rubric_overlap"), F.get(F.col("ids"), -F.col("best.j")).alias("best_other_atom_id"),
        F.round(other, 6).alias("best_other_atom_overlap"), F.round("aq", 6).alias("atom_question_overlap"), F.round("rq", 6).alias("rubric_question_overlap"), "unsupported",
    )
