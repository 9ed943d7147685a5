"""Quality classifier: interpolated modified Kneser-Ney n-grams of trusted text, perplexity thresholds by language.

The n-grams are of characters, all of Unicode. Documents are in two folds, and each is scored by the
model of the other fold's trusted text, so that trusted documents, whose quantiles give the
thresholds, are scored as any other. The folds are even in every language. Counts are sharded by key: partial counts from every batch of
trusted text are summed, and continuation counts, discounts and interpolated
probabilities follow from joins of the sharded tables, order by order.

For scoring, texts are cut into chunks of bounded size, whose distinct n-grams are looked up. Up to a fixed
number of rows the whole model is broadcast and texts stay where they are. A larger model stays in the shared tables:
its most frequent n-grams alone are broadcast, and a chunk's other n-grams are joined with the tables, order by
order down for those that are unseen; their probabilities come back to the chunk, where the documents' sums are made.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuloom.llm.common import mix, slices
from corpuloom.session import cut, ship, table

ORDER = 5
#: An n-gram of up to five characters of 21 bits is two longs: the last three in lo, the others, right-aligned, in hi.
BITS = 21
CHAR = (1 << BITS) - 1
#: Stands for the characters before a text; code points are below it.
START = 0x110000
#: The bit of hi that tells the fold.
FOLD = 1 << (2 * BITS)
#: Bytes of text in a chunk whose n-grams are looked up together.
CHUNK = 6 << 20
#: Keys that a table looks up at a time.
BLOCK = 1 << 17
#: Rows of the model (24 bytes each) that are broadcast at most.
BROADCAST_ROWS = 2_500_000
#: Trusted document ids (8 bytes each) that are broadcast at most.
BROADCAST_IDS = 1_500_000
#: Trusted documents of a language up to which its folds are dealt out in turn; with more, hashes alone make them even.
DEALT = 1000
#: Perplexity of a kept document lies between these quantiles of trusted documents of its language, widened by the factor.
LOW, HIGH, MARGIN = 0.002, 0.99, 1.02
_ODD = np.uint64(0x9E3779B97F4A7C15)


def context(hi, lo):
    """All but the last character of n-grams (columns or arrays), with the fold."""
    if isinstance(hi, np.ndarray):
        chars = hi & (FOLD - 1)
        return (chars >> BITS) | (hi & FOLD), (lo >> BITS) | ((chars & CHAR) << (2 * BITS))
    chars = hi.bitwiseAND(FOLD - 1)
    return F.shiftright(chars, BITS).bitwiseOR(hi.bitwiseAND(FOLD)), F.shiftright(lo, BITS).bitwiseOR(F.shiftleft(chars.bitwiseAND(CHAR), 2 * BITS))


def tail(hi, lo, n: int):
    """The last n characters of n-grams (columns or arrays), with the fold."""
    if isinstance(hi, np.ndarray):
        return hi & (((1 << (BITS * max(0, n - 3))) - 1) | FOLD), lo & ((1 << (BITS * min(3, n))) - 1)
    return hi.bitwiseAND(((1 << (BITS * max(0, n - 3))) - 1) | FOLD), lo.bitwiseAND((1 << (BITS * min(3, n))) - 1)


def fold_of(doc_id: str = "doc_id"):
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(9)), F.lit(2)).cast("int")


def ngrams(texts: list[str], folds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of texts: hi, lo, how often each occurs, its number at each character (all texts in a row), and the texts' lengths.

    Within a list of texts an n-gram is a number of its characters' places among those that occur, which fits a
    long for up to 4,096 different ones; with more, ranks of its halves do. Equal lists give equal numbers.
    """
    start = np.full(order - 1, START, np.int32).tobytes()
    codes = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(c) // 4 for c in codes], np.int64)
    if not sizes.sum():
        none = np.empty(0, np.int64)
        return none, none, none, none, sizes
    # Each text comes after its starts, so the windows that end at a character are its n-grams.
    flat = np.frombuffer(b"".join(x for c in codes for x in (start, c)), np.int32)
    del codes
    present = np.zeros(START + 1, bool)
    present[flat] = True
    chars = np.flatnonzero(present)
    place = np.zeros(START + 1, np.uint16 if len(chars) <= 0x10000 else np.int32)
    place[chars] = np.arange(len(chars))
    local, ends, bits = place[flat], flat[order - 1 :] != START, max(1, (len(chars) - 1).bit_length())
    del flat
    fold = np.repeat(np.asarray(folds, np.int8), sizes + order - 1)[order - 1 :]

    def windows(out: np.ndarray, offsets: range) -> np.ndarray:
        for j in offsets:
            out <<= bits
            out |= local[j : j + len(ends)]
        return out[ends]

    if order * bits < 62:
        keys = windows(fold.astype(np.int64), range(order))
        del fold, local, ends
        found, counts = np.unique(keys, return_counts=True)
        of = [chars[(found >> (bits * (order - 1 - j))) & ((1 << bits) - 1)] for j in range(order)]
        own = found >> (bits * order)
    else:
        first = windows(fold.astype(np.int64), range(max(0, order - 3)))
        last = windows(np.zeros(len(ends), np.int64), range(max(0, order - 3), order))
        del fold, local, ends
        firsts, lasts = np.unique(first), np.unique(last)
        keys = np.searchsorted(firsts, first) * len(lasts) + np.searchsorted(lasts, last)
        del first, last
        found, counts = np.unique(keys, return_counts=True)
        one, two = firsts[found // len(lasts)], lasts[found % len(lasts)]
        of = [chars[((one >> (bits * (order - 4 - j))) if j < order - 3 else (two >> (bits * (order - 1 - j)))) & ((1 << bits) - 1)] for j in range(order)]
        own = one >> (bits * max(0, order - 3))
    hi, lo = own.astype(np.int64), np.zeros(len(found), np.int64)
    if order < 5:
        hi = hi << (BITS * (5 - max(3, order)))
    for j, c in enumerate(of):
        if order - j > 3:
            hi = (hi << BITS) | c
        else:
            lo = (lo << BITS) | c
    return hi, lo, counts.astype(np.int64), Lookup(found).find(keys), sizes


class Lookup:
    """An open-addressing table from distinct int64 keys to their places, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.given = keys
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        size = 1 << self.bits
        self.places = np.full(size, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = left[self.places[slot[left]] < 0]
            self.places[slot[free]] = free  # of several, one stays
            left = left[self.places[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that are not there; a block at a time, so that what it needs besides the places is bounded."""
        out = np.empty(len(keys), np.int32)
        for i in range(0, len(keys), BLOCK):
            part = keys[i : i + BLOCK]
            slot = self._slot(part)
            at = self.places[slot]
            left = np.flatnonzero((at >= 0) & (self.given[at] != part))
            while len(left):
                slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
                at[left] = self.places[slot[left]]
                left = left[(at[left] >= 0) & (self.given[at[left]] != part[left])]
            out[i : i + BLOCK] = at
        return out


class Table:
    """Values of n-grams (hi, lo), for whole arrays at once; n-grams are told apart by both longs."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, values: np.ndarray):
        self.hi, self.lo, self.values, seed = hi, lo, values, 1
        while True:
            self.seed = np.uint64(2 * seed + 1)
            mixed = self._mixed(hi, lo)
            if len(np.unique(mixed)) == len(mixed):
                break
            seed += 1
        self.places = Lookup(mixed)

    def _mixed(self, hi, lo):
        return mix(mix(hi.astype(np.uint64) * self.seed) ^ lo.astype(np.uint64)).view(np.int64)

    def get(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where there is none, and which n-grams were found."""
        if not len(self.hi):
            return np.zeros(len(hi)), np.zeros(len(hi), bool)
        at = self.places.find(self._mixed(hi, lo))
        found = (at >= 0) & (self.hi[at] == hi) & (self.lo[at] == lo)
        return np.where(found, self.values[at], 0.0), found


def count_ngrams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """hi, lo, c: how often each n-gram occurs in all texts of a fold (columns text, fold; nulls and empty texts have none)."""
    ship(texts.sparkSession)

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", CHUNK):
                hi, lo, c, _, _ = ngrams([t or "" for t in b.column("text").to_pylist()], b.column("fold").to_numpy(zero_copy_only=False), order)
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(c)], ["hi", "lo", "c"])

    return texts.select("text", "fold").mapInArrow(run, "hi long, lo long, c long").groupBy("hi", "lo").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[list[float]]:
    """Modified Kneser-Ney discounts of each fold for counts 1, 2 and more, from the numbers of n-grams that occur one to four times."""
    fold = (F.col("hi").bitwiseAND(FOLD) != 0).cast("int")
    n = {(r.fold, r.c): r.n for r in counts.where("c <= 4").groupBy(fold.alias("fold"), "c").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for f in (0, 1):
        n1, n2, n3, n4 = (n.get((f, i), 0) for i in (1, 2, 3, 4))
        if not (n1 and n2):
            out.append([0.5, 0.75, 0.9])
            continue
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
        out.append([min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)])
    return out


def train(texts: DataFrame, order: int = ORDER) -> dict:
    """The models of both folds' texts (columns text, fold): for each n the probabilities of n-grams (hi, lo, p) and the back-off weights of their contexts (hi, lo, gamma).

    Under 0 stands the number of symbols, which are equally probable before anything is counted: the
    characters of the texts, and one for all that are not among them.
    """
    hi, lo = F.col("hi"), F.col("lo")
    grams = {order: cut(count_ngrams(texts, order), "ngrams")}
    for n in range(order - 1, 0, -1):
        # Continuation counts: how many different characters precede.
        high, low = tail(hi, lo, n)
        grams[n] = cut(grams[n + 1].groupBy(high.alias("hi"), low.alias("lo")).agg(F.count(F.lit(1)).alias("c")), "ngrams")
    symbols = grams[1].select("lo").distinct().count() + 1
    model, lower = {0: symbols}, None
    for n in range(1, order + 1):
        d = discounts(grams[n])
        # A context has at most as many rows as there are characters.
        over = Window.partitionBy("ctx_hi", "ctx_lo")
        by_count = lambda x: F.when(F.col("c") == 1, x[0]).when(F.col("c") == 2, x[1]).otherwise(x[2])
        disc = F.when(hi.bitwiseAND(FOLD) == 0, by_count(d[0])).otherwise(by_count(d[1]))
        high, low = context(hi, lo)
        rows = grams[n].withColumns({"ctx_hi": high, "ctx_lo": low, "disc": disc})
        rows = rows.select("hi", "lo", "ctx_hi", "ctx_lo", "c", ((F.col("c") - F.col("disc")) / F.sum("c").over(over)).alias("own"), (F.sum("disc").over(over) / F.sum("c").over(over)).alias("gamma"))
        if n == 1:
            rows = rows.withColumn("p", F.col("own") + F.col("gamma") / symbols)
        else:
            high, low = tail(hi, lo, n - 1)
            suffix = lower.select(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), F.col("p").alias("low"))
            rows = rows.withColumns({"s_hi": high, "s_lo": low}).join(suffix, ["s_hi", "s_lo"]).withColumn("p", F.col("own") + F.col("gamma") * F.col("low"))
        lower = cut(rows.select("hi", "lo", "ctx_hi", "ctx_lo", "gamma", "p", "c"), "probabilities")
        weights = lower.groupBy("ctx_hi", "ctx_lo").agg(F.first("gamma").alias("gamma")).withColumnsRenamed({"ctx_hi": "hi", "ctx_lo": "lo"})
        model[n] = (lower.select("hi", "lo", "p", "c"), cut(weights, "weights"))
    return model


def probabilities(wanted: DataFrame, model: dict, n: int) -> DataFrame:
    """hi, lo, p of distinct n-grams (hi, lo): interpolated where seen, else the context's weight times the probability of the n-gram without its first character."""
    hi, lo = F.col("hi"), F.col("lo")
    looked = cut(wanted.join(model[n][0].drop("c").hint("merge"), ["hi", "lo"], "left"), "looked")
    seen, unseen = looked.where("p is not null"), looked.where("p is null").select("hi", "lo")
    if unseen.isEmpty():
        return seen
    high, low = context(hi, lo)
    ctx = model[n][1].select(F.col("hi").alias("ctx_hi"), F.col("lo").alias("ctx_lo"), "gamma")
    unseen = unseen.withColumns({"ctx_hi": high, "ctx_lo": low}).join(ctx.hint("merge"), ["ctx_hi", "ctx_lo"], "left").select("hi", "lo", F.coalesce("gamma", F.lit(1.0)).alias("gamma"))
    if n == 1:
        return seen.union(unseen.select("hi", "lo", F.col("gamma") / model[0]))
    high, low = tail(hi, lo, n - 1)
    unseen = unseen.withColumns({"s_hi": high, "s_lo": low})
    short = probabilities(unseen.select(F.col("s_hi").alias("hi"), F.col("s_lo").alias("lo")).distinct(), model, n - 1).select(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), "p")
    return seen.union(unseen.join(short.hint("merge"), ["s_hi", "s_lo"]).select("hi", "lo", F.col("gamma") * F.col("p")))


def local_probabilities(hi: np.ndarray, lo: np.ndarray, tables: dict, symbols: int, order: int) -> np.ndarray:
    """As probabilities(), from tables that hold the whole model."""
    p, found = tables[order, "p"].get(hi, lo)
    left, weight = np.flatnonzero(~found), np.ones(int((~found).sum()))
    h, o = hi[left], lo[left]
    for n in range(order, 0, -1):
        if not len(left):
            break
        gamma, seen = tables[n, "gamma"].get(*context(h, o))
        weight = weight * np.where(seen, gamma, 1.0)
        if n == 1:
            p[left] = weight / symbols
            break
        h, o = tail(h, o, n - 1)
        q, found = tables[n - 1, "p"].get(h, o)
        p[left[found]] = weight[found] * q[found]
        left, weight, h, o = left[~found], weight[~found], h[~found], o[~found]
    return p


def _collected(df: DataFrame, value: str) -> tuple:
    rows = df.select("hi", "lo", value).toArrow()
    return tuple(rows.column(i).to_numpy() for i in range(3))


#: The tables of the model that a worker has built last.
_TABLES: dict = {}


def _tables(shared, name: str) -> dict:
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = {k: Table(*v) for k, v in shared.value.items()}
    return _TABLES[name]


def _packed(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(b)
    return sink.getvalue().to_pybytes()


def _sums(b: pa.RecordBatch, log: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    run = log[at]
    np.cumsum(run, out=run)
    ends = np.cumsum(sizes)
    sums = np.diff(np.where(ends > 0, run[ends - 1], 0.0) if len(run) else np.zeros(len(ends)), prepend=0.0)
    return pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "lang", "text_hash")), pa.array(sizes), pa.array(sums)], ["doc_id", "lang", "text_hash", "n_chars", "total"])


_SUMS = "doc_id long, lang string, text_hash long, n_chars long, total double"


def perplexities(docs: DataFrame, model: dict, order: int = ORDER, chunk: int = CHUNK, broadcast_rows: int = BROADCAST_ROWS, fold: Column | None = None) -> DataFrame:
    """doc_id, lang, text_hash (xxhash64), n_chars, perplexity by character of each row (null for a null or empty text).

    fold: whose model scores a row, by default the one that the hash of its id is not in.
    """
    spark = docs.sparkSession
    ship(spark)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text").alias("text_hash"), (1 - fold_of() if fold is None else fold).alias("fold"))

    def distinct(b: pa.RecordBatch):
        return ngrams([t or "" for t in b.column("text").to_pylist()], b.column("fold").to_numpy(zero_copy_only=False), order)

    rows = sum(df.count() for n in range(1, order + 1) for df in model[n])
    name = uuid.uuid4().hex
    if rows <= broadcast_rows:
        held = {(n, kind): _collected(df, kind) for n in range(1, order + 1) for kind, df in zip(("p", "gamma"), model[n], strict=True)}
        shared, symbols = spark.sparkContext.broadcast(held), model[0]

        def whole_model(batches):
            tables = _tables(shared, name)
            for whole in batches:
                for b in slices(whole, "text", chunk):
                    hi, lo, _, at, sizes = distinct(b)
                    yield _sums(b, np.log(np.maximum(local_probabilities(hi, lo, tables, symbols, order), 1e-300)), at, sizes)

        found = picked.mapInArrow(whole_model, _SUMS)
    else:
        top = model[order][0].orderBy(F.desc("c"), "hi", "lo").limit(broadcast_rows)
        shared = spark.sparkContext.broadcast({"top": _collected(top, "p")})

        def pack(batches):
            top_ = _tables(shared, name)["top"]
            for whole in batches:
                for b in slices(whole, "text", chunk):
                    hi, lo, _, _, _ = distinct(b)
                    ask = np.flatnonzero(~top_.get(hi, lo)[1])
                    lists = [pa.array([x[ask]], pa.list_(pa.int64())) for x in (hi, lo)]
                    yield pa.RecordBatch.from_arrays([pa.array([_packed(b)], pa.binary()), *lists], ["texts", "hi", "lo"])

        # Numbers of chunks hold once they are written.
        chunks = cut(picked.mapInArrow(pack, "texts binary, hi array<long>, lo array<long>").withColumn("chunk", F.monotonically_increasing_id()), "chunks")
        asked = chunks.select("chunk", F.posexplode(F.arrays_zip("hi", "lo")).alias("at", "g")).select("chunk", "at", "g.hi", "g.lo")
        known = cut(probabilities(asked.select("hi", "lo").distinct(), model, order), "known").withColumn("p", F.log(F.greatest("p", F.lit(1e-300))).cast("float"))
        back = asked.join(known.hint("merge"), ["hi", "lo"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "p")).alias("logs"))
        joined = chunks.select("chunk", "texts").join(back.hint("merge"), "chunk", "left").select("texts", "logs")

        def score(batches):
            top_ = _tables(shared, name)["top"]
            for whole in batches:
                for texts, logs in zip(whole.column("texts"), whole.column("logs"), strict=True):
                    b = pa.ipc.open_stream(texts.as_py()).read_next_batch()
                    hi, lo, _, at, sizes = distinct(b)
                    p, common = top_.get(hi, lo)
                    log, rest = np.log(np.maximum(p, 1e-300)), np.flatnonzero(~common)
                    if logs.is_valid:
                        log[rest[logs.values.field(0).to_numpy()]] = logs.values.field(1).to_numpy()
                    yield _sums(b, log, at, sizes)

        found = joined.mapInArrow(score, _SUMS)
    return found.select("doc_id", "lang", "text_hash", "n_chars", F.when(F.col("n_chars") > 0, F.exp(-F.col("total") / F.col("n_chars"))).alias("perplexity"))


def thresholds(scored: DataFrame, low: float = LOW, high: float = HIGH, margin: float = MARGIN) -> DataFrame:
    """lang, lo, hi: bounds of perplexity from trusted documents of each language, exact to a thousandth of log perplexity; lang null holds those of all trusted documents.

    With n trusted documents a tail of share q is seen in full from n q = 1 on. Below that, a language's bound moves
    by 1 - n q toward a wide one: the outermost of its own, that of all, and its median with the spread that
    the languages have about theirs, widened for the error of a median of n. The bounds of few documents in
    all move outwards by their range; a single one tells of no spread and bounds nothing.
    """
    rounded = scored.where("trusted and perplexity is not null").groupBy("lang", F.round(F.log("perplexity"), 3).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    tails = (("lo", low, low, F.least, -1), ("hi", high, 1 - high, F.greatest, 1))
    quantiles = [F.percentile("x", q, F.col("n")).alias(k) for k, q, *_ in tails]
    whole = rounded.groupBy("x").agg(F.sum("n").alias("n")).agg(*quantiles, F.sum("n").alias("docs"), (F.max("x") - F.min("x")).alias("range"))
    own = rounded.where("lang is not null").groupBy("lang").agg(*quantiles, F.percentile("x", 0.5, F.col("n")).alias("mid"), F.sum("n").alias("docs"))
    # A document's distance from a median that it helped to make is short by this factor.
    away = rounded.join(own.where("docs > 1").select("lang", "mid", "docs"), "lang").select(((F.col("x") - F.col("mid")) * F.sqrt(F.col("docs") / (F.col("docs") - 1))).alias("x"), "n")
    spread = away.groupBy(F.round("x", 3).alias("x")).agg(F.sum("n").alias("n")).agg(*[F.percentile("x", q, F.col("n")).alias(f"off_{k}") for k, q, *_ in tails])
    missing = lambda tail: F.greatest(F.lit(0.0), 1 - F.col("docs") * tail)
    every = whole.select(*[(F.col(k) + s * missing(tail) * F.col("range")).alias(f"all_{k}") for k, _, tail, _, s in tails]).join(F.broadcast(spread))
    own = own.join(F.broadcast(every))

    def bounds(frame, wide):
        return [F.exp(F.col(k) + missing(tail) * (wide(k, outer, s) - F.col(k)) + s * np.log(margin)).alias(k) for k, _, tail, outer, s in tails]

    error = F.sqrt(1 + 1 / F.col("docs"))
    own = own.select("lang", *bounds(own, lambda k, outer, s: outer(F.col(k), F.col(f"all_{k}"), F.col("mid") + F.col(f"off_{k}") * error)), F.col("docs"))
    far = whole.select(F.lit(None).cast("string").alias("lang"), *bounds(whole, lambda k, outer, s: F.col(k) + s * F.col("range")), "docs")
    one = F.broadcast(whole.select((F.col("docs") < 2).alias("single")))
    both = own.union(far).join(one).withColumns({"lo": F.when(F.col("single"), 0.0).otherwise(F.col("lo")), "hi": F.when(F.col("single"), float("inf")).otherwise(F.col("hi"))})
    return both.select("lang", "lo", "hi")


def folds(docs: DataFrame, trust: DataFrame, most: int = DEALT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, own_fold) of the trusted documents of languages that have at most `most`, and (language, use) of those languages.

    Hashes may put all of a few documents in one fold, so these are dealt out in turn, and documents without
    trust use the fold that has more of their language's. A document whose rows have several languages counts
    for the smallest, null for one of its own; both tables are bounded by the number of languages.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("_"), F.col("lang").cast("string")), F.lit("")).alias("language"))
    known = cut(rows.join(trust.hint("broadcast" if trust.count() <= BROADCAST_IDS else "merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("language").alias("language")), "languages")
    few = known.groupBy("language").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("language")
    turn = F.row_number().over(Window.partitionBy("language").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id"))
    # Languages begin in either fold by hash, so that many with one document each are spread too.
    dealt = cut(known.join(few, "language").withColumn("own_fold", F.pmod(turn + F.xxhash64("language"), F.lit(2)).cast("int")), "folds")
    more = dealt.groupBy("language").agg(F.sum(2 * F.col("own_fold") - 1).alias("lead"), F.count(F.lit(1)).alias("n")).where("lead <> 0")
    return dealt.select("doc_id", "own_fold"), more.select("language", (F.col("lead") > 0).cast("int").alias("use"))


def quality(docs: DataFrame, labels: DataFrame, order: int = ORDER, **params) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, trusted, lo, hi, kept, text_hash for each document.

    Trusted documents have label quality 1. A document is kept if its perplexity is within its
    language's bounds; a language without trusted documents, or null, takes the bounds of all. A null or
    empty text has no perplexity and is not kept. Without trusted text everything with text is
    kept. Few trusted documents of a language are dealt out evenly between the folds; a single one
    is scored without its language, and the others of its language with it. Repeated rows are scored
    again; very long texts are scored whole; extra columns are ignored.
    """
    trust = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trust = cut(trust, "trusted")
    # Up to a fixed number of ids the texts stay where they are; beyond it both sides are shuffled.
    small = trust.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    dealt, leads = folds(rows, trust)
    near = lambda df: df.hint("broadcast" if df.count() <= BROADCAST_IDS else "merge")
    rows = rows.withColumn("language", F.coalesce(F.concat(F.lit("_"), F.col("lang")), F.lit(""))).join(near(dealt), "doc_id", "left").join(near(leads), "language", "left")
    own = F.coalesce("own_fold", fold_of())
    texts = rows.join(trust.hint("broadcast" if small else "merge"), "doc_id", "left_semi").select("text", own.alias("fold"))
    model = train(texts, order)
    used = F.coalesce(1 - F.col("own_fold"), "use", 1 - fold_of())
    scored = perplexities(rows, model, order, fold=used).join(trust.withColumn("trusted", F.lit(True)), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    scored = cut(scored, "perplexities")
    bounds = cut(thresholds(scored, **params), "bounds")
    own = bounds.where("lang is not null").select(F.col("lang").alias("l"), F.col("lo").alias("own_lo"), F.col("hi").alias("own_hi"))
    every = bounds.where("lang is null").select(F.col("lo").alias("all_lo"), F.col("hi").alias("all_hi"))
    out = scored.join(own, F.col("lang") == F.col("l"), "left").join(F.broadcast(every))
    out = out.withColumn("lo", F.coalesce("own_lo", "all_lo")).withColumn("hi", F.coalesce("own_hi", "all_hi"))
    kept = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity").between(F.col("lo"), F.col("hi")), F.lit(True))
    return out.select("doc_id", "lang", "n_chars", "perplexity", "trusted", "lo", "hi", kept.alias("kept"), "text_hash")


def op9_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: language, characters, perplexity by the other fold's trusted text, its language's bounds, and whether it is kept."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")
