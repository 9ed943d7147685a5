"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = sigmoid(w x - t_k) with ordered thresholds t_k and one weight vector for all
of them; the expected severity is the sum of these probabilities. x marks which of the
selected words a text holds. Grades come from the labels alone: the levels of the toxic label, and
between two levels the texts whose copies are labelled with both.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuloom.llm.common import slices, utf8
from corpuloom.session import cut, ship, table

#: Labelled rows that the model is fitted on at most, chosen by hash of doc_id.
FIT_ROWS = 12_000
#: Words that become features at most, texts that must hold one, and the least chi-square of one.
FEATURES, LEAST_TEXTS, LEAST_CHI2 = 4096, 4, 20.0
#: Ridge penalty of the weights, and steps of the fit.
RIDGE, STEPS = 0.3, 400
#: A document is rejected if P(grade > 0) reaches this.
REJECT = 0.5
#: Bytes of a word's stem feature.
STEM = 5
_EDGE = b".,;:!?\"'()[]{}<>%*#$&|-_/\\=+~`^@0123456789"


class Words(dict):
    """The features of a raw word (lower-cased bytes): its core without punctuation or digits at either end, and the core's first STEM bytes. Memoised up to a bound."""

    def __init__(self, known: dict[bytes, int] | None, bound: int = 300_000):
        super().__init__()
        self.known, self.bound = known, bound

    def __missing__(self, word: bytes):
        if len(self) >= self.bound:
            self.clear()
        core = word.strip(_EDGE)
        both = (core, b"^" + core[:STEM]) if len(core) > STEM else (core,) if core else ()
        out = self[word] = both if self.known is None else tuple(self.known[x] for x in both if x in self.known)
        return out

    def of(self, text: str | None) -> set:
        """Features of a whole text; unknown words have none."""
        return set(chain.from_iterable(map(self.__getitem__, set(utf8(text).lower().split())))) if text else set()


def fit_cumulative(x: list[np.ndarray], y: np.ndarray, n_features: int, grades: int, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the cumulative-link model, by full-batch Adam on the penalised likelihood.

    x: per row the indices of its features. Thresholds are a first one and positive gaps.
    """
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)
    share = np.array([(y > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    t0 = -np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(n_features), t0[:1], np.log(np.maximum(np.diff(t0), 0.05))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 0.5 * (1 + np.tanh(z / 2))
    n = len(y)
    for step in range(1, steps + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        t = np.concatenate([theta[n_features : n_features + 1], theta[n_features] + np.cumsum(gaps)])
        z = np.bincount(rows, w[cols], n)
        over = sig(z[:, None] - t[None, :])  # P(y > k)
        edge = np.concatenate([np.ones((n, 1)), over, np.zeros((n, 1))], axis=1)
        p = np.maximum(edge[np.arange(n), y] - edge[np.arange(n), y + 1], 1e-12)
        slope = np.concatenate([np.zeros((n, 1)), over * (1 - over), np.zeros((n, 1))], axis=1)
        lo, hi = slope[np.arange(n), y], slope[np.arange(n), y + 1]
        dz = -(lo - hi) / p
        dt = np.zeros((n, grades + 1))
        dt[np.arange(n), y] += lo / p
        dt[np.arange(n), y + 1] -= hi / p
        dt = dt[:, 1:-1].sum(axis=0)
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([np.bincount(cols, dz[rows], n_features) + 2 * ridge * w, tail[:1], tail[1:] * gaps])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        rate = 0.1 * (1 - step / (steps + 1)) + 0.002
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    gaps = np.exp(theta[n_features + 1 :])
    return theta[:n_features], np.concatenate([theta[n_features : n_features + 1], theta[n_features] + np.cumsum(gaps)])


class Model:
    """Weights by word, thresholds, and their predictions."""

    def __init__(self, words: list[bytes], weights: np.ndarray, thresholds: np.ndarray):
        self.words, self.weights, self.thresholds = words, weights, thresholds

    def over(self, features: set) -> np.ndarray:
        """P(grade > k) for each threshold."""
        z = float(sum(self.weights[i] for i in sorted(features)))
        return 1 / (1 + np.exp(np.clip(self.thresholds - z, -60, 60)))


def graded(level: str = "level"):
    """The level of labels of one text: twice the label where all agree, an odd number between where they don't."""
    mean = F.avg(level)
    return (F.floor(mean) + F.ceil(mean)).cast("int")


def chi_square(words: DataFrame, most: int = FEATURES) -> list[bytes]:
    """Features (column words of each text, level) whose presence depends on being toxic, strongest first; at most `most`."""
    n, pos = words.agg(F.count(F.lit(1)), F.sum((F.col("level") > 0).cast("long"))).first()
    every, bad = F.col("every"), F.col("bad")
    expected = every * pos / n
    spread = expected * (1 - every / n) * (1 - pos / n)
    counts = words.select(F.explode("words").alias("word"), (F.col("level") > 0).cast("long").alias("hit")).groupBy("word").agg(F.count(F.lit(1)).alias("every"), F.sum("hit").alias("bad"))
    strong = counts.where(every >= LEAST_TEXTS).withColumn("chi2", F.when(spread > 0, (bad - expected) ** 2 / spread).otherwise(0.0)).where(F.col("chi2") >= LEAST_CHI2)
    return [bytes(r.word) for r in strong.orderBy(F.desc("chi2"), "word").limit(most).collect()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = FIT_ROWS) -> Model:
    """The model of labelled documents: at most `most` of them, by hash; texts of equal words count once.

    Words are counted by Spark; the driver receives the chosen features and, of each fitted text, which of them it holds.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("level")).where("doc_id is not null and level is not null")
    total = known.count()
    share = min(1.0, 0.95 * most / max(1, total))
    few = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).groupBy("doc_id").agg(F.avg("level").alias("level")).limit(most)

    def run(batches):
        words = Words(None)
        for whole in batches:
            for b in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("level"), pa.array([sorted(words.of(t)) for t in b.column("text").to_pylist()], pa.list_(pa.binary()))], ["level", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("level", "text")
    held = cut(rows.mapInArrow(run, "level double, words array<binary>").groupBy("words").agg(graded().alias("level")), "labelled")
    levels = sorted(r.level for r in held.select("level").distinct().collect())
    if len(levels) < 2:
        return Model([], np.empty(0), np.array([60.0]))
    names = chi_square(held)
    if not names:
        return Model([], np.empty(0), np.array([60.0]))

    def chosen(batches):
        at = {w: i for i, w in enumerate(names)}
        for b in batches:
            own = [sorted(at[w] for w in x if w in at) for x in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("level"), pa.array(own, pa.list_(pa.int32()))], ["level", "features"])

    texts = sorted((r.level, r.features) for r in held.select("level", "words").mapInArrow(chosen, "level int, features array<int>").collect())
    grade = np.searchsorted(levels, [x[0] for x in texts])
    weights, thresholds = fit_cumulative([np.array(x[1], np.int64) for x in texts], grade, len(names), len(levels))
    return Model(names, weights, thresholds)


def score(docs: DataFrame, model: Model) -> tuple[DataFrame, list[str]]:
    """docs with the expected grade, the likeliest grade and the probability of any grade above 0, and the names of these columns.

    A null or empty text has no features and gets the base rate. Texts are read whole.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES words
    names = ["severity", "grade", "probability"]
    while {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        names = [f"_{n}" for n in names]
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType()), T.StructField(names[2], T.DoubleType())])

    def run(batches):
        m = shared.value
        words = Words({w: i for i, w in enumerate(m.words)})
        for whole in batches:
            for b in slices(whole, "text"):
                over = [m.over(words.of(t)) for t in b.column("text").to_pylist()]
                grade = [int(np.argmax(-np.diff(np.concatenate([[1.0], o, [0.0]])))) for o in over]
                extra = [pa.array([float(o.sum()) for o in over]), pa.array(grade, pa.int32()), pa.array([float(o[0]) for o in over])]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema), names


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity, grade, probability, rejected for each document.

    Rows with null doc_ids or labels are not used for fitting; with labels of one level or
    none, or no word that tells them apart, nothing is rejected. A document is rejected if P(grade > 0) reaches REJECT. Repeated rows
    are scored again; extra columns are ignored; an empty table gives an empty result.
    """
    out, _ = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return out.select("doc_id", "severity", "grade", "probability", (F.col("probability") >= REJECT).alias("rejected"))


def keep_harmless(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns, whatever their names."""
    out, names = score(docs, fit(docs, labels))
    return out.where(F.col(names[2]) < REJECT).drop(*names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: expected severity, likeliest grade, probability of a grade above 0, and whether it is rejected."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
