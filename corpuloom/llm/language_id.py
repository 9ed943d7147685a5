"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of one fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm;
the piece probabilities are fitted by expectation maximisation with the same sums.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm.common import slices
from corpuloom.session import ship, table

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Documents of each language that the model is fitted on at most, chosen by hash, and passes of the fit.
FIT_DOCS, PASSES = 1200, 3
#: Languages whose sums are computed at once.
BLOCK = 64
#: Probability of a character that begins no piece, the same in every language.
UNKNOWN = 1e-7
#: Longer words go through a scaled forward pass of their own; the fit takes them in parts.
LONG = 24
#: Runs of letters, by Unicode category: numerals are none.
_RUNS = regex.compile(r"\p{L}+")


@lru_cache(maxsize=1)
def pieces(path: str) -> dict[str, int]:
    """Lower-cased pieces of the vocabulary that hold a letter, numbered; U+2581 marks a word's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return {p: i for i, p in enumerate(sorted(p for p in found if p == "▁" or p.lstrip("▁").isalpha()))}


class Trie:
    """Beginnings of pieces as states, 0 for none yet; those that go on have the lowest numbers. All places of many words step together."""

    #: Characters with a column of their own in the table of steps; rarer ones are searched.
    COMMON = 128

    def __init__(self, vocabulary: dict[str, int]):
        begun = {p[:k] for p in vocabulary for k in range(1, len(p) + 1)}
        inner = {b[:-1] for b in begun}
        state = {b: i for i, b in enumerate(["", *sorted(inner - {""}), *sorted(begun - inner)])}
        self.inner = max(1, len(inner))
        self.piece = np.array([vocabulary.get(b, -1) for b in state], np.int32)
        chars = {c: i for i, (c, _) in enumerate(Counter(b[-1] for b in begun).most_common())}
        self.char = np.full(0x110000, -1, np.int32)
        self.char[[ord(c) for c in chars]] = list(chars.values())
        steps = [(state[b[:-1]], chars[b[-1]], state[b]) for b in begun]
        self.table = np.full((self.inner, self.COMMON), -1, np.int32)
        for s, c, to in steps:
            if c < self.COMMON:
                self.table[s, c] = to
        rare = sorted((s << 32 | c, to) for s, c, to in steps if c >= self.COMMON)
        self.keys, self.to = (np.array([r[k] for r in rare], np.int64) for k in (0, 1))

    def step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states after one more character, -1 for none."""
        common = (chars >= 0) & (chars < self.COMMON)
        out = np.where(common, self.table[states, np.where(common, chars, 0)], np.int32(-1))
        if len(self.keys) and len(rare := np.flatnonzero(chars >= self.COMMON)):
            key = states[rare].astype(np.int64) << 32 | chars[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.to[at], -1)
        return out


@lru_cache(maxsize=1)
def trie(path: str) -> Trie:
    return Trie(pieces(path))


def lattice(words: list[str], vocabulary: dict[str, int], longest: int, known: Trie | None = None) -> np.ndarray:
    """For words of one length (with the start mark): the piece number of each [word, start, length - 1], -1 for none. known: the vocabulary's trie."""
    n, size = len(words), len(words[0])
    width = min(longest, size)
    known = known or Trie(vocabulary)
    chars = known.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
    out = np.full((n * size, width), -1, np.int32)
    at, states = np.arange(n * size), np.zeros(n * size, np.int32)
    for k in range(width):
        # Places whose run of k characters begins a longer piece, and whose word has another character.
        on = (states < known.inner) & (at % size + k < size)
        at, states = at[on], states[on]
        states = known.step(states, chars[at + k])
        found = states >= 0
        at, states = at[found], states[found]
        if not len(at):
            break
        out[at, k] = known.piece[states]
    return out.reshape(n, size, width)


def forward(lat: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[word, position, language]: summed probability of all segmentations of the first `position` characters."""
    n, size, width = lat.shape
    alpha = np.zeros((n, size + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for s in range(size):
        here = alpha[:, s]
        for k in range(min(width, size - s)):
            p = lat[:, s, k]
            ok = np.flatnonzero(p >= 0)
            if len(ok):
                alpha[ok, s + k + 1] += here[ok] * prob[p[ok]]
        # A single character that is no piece.
        none = np.flatnonzero(lat[:, s, 0] < 0)
        if len(none):
            alpha[none, s + 1] += here[none] * UNKNOWN
    return alpha


def backward(lat: np.ndarray, prob: np.ndarray) -> np.ndarray:
    n, size, width = lat.shape
    beta = np.zeros((n, size + 1, prob.shape[1]))
    beta[:, size] = 1
    for s in range(size - 1, -1, -1):
        for k in range(min(width, size - s)):
            p = lat[:, s, k]
            ok = np.flatnonzero(p >= 0)
            if len(ok):
                beta[ok, s] += beta[ok, s + k + 1] * prob[p[ok]]
        none = np.flatnonzero(lat[:, s, 0] < 0)
        if len(none):
            beta[none, s] += beta[none, s + 1] * UNKNOWN
    return beta


def long_word(word: str, vocabulary: dict[str, int], prob: np.ndarray, longest: int) -> np.ndarray:
    """Log probability of one word of any length, by language, with the forward sums rescaled as they go."""
    window = [np.ones(prob.shape[1])]  # sums at the last `longest` positions, over exp(scale)
    scale = 0.0
    for e in range(1, len(word) + 1):
        a = np.zeros(prob.shape[1])
        for k in range(1, min(longest, e) + 1):
            p = vocabulary.get(word[e - k : e])
            if p is not None:
                a = a + window[-k] * prob[p]
            elif k == 1:
                a = a + window[-1] * UNKNOWN
        window.append(a)
        del window[:-longest]
        top = a.max()
        if top < 1e-100:
            window = [x / top for x in window]
            scale += math.log(top)
    return np.log(np.maximum(window[-1], 1e-300)) + scale


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


class Model:
    """Languages, their log priors, and prob[piece, language]."""

    def __init__(self, languages: list[str], prob: np.ndarray, path: str = VOCABULARY):
        self.languages, self.prob, self.path = languages, prob, path

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log probability of each word (letters only, lower case) in each language."""
        vocabulary = pieces(self.path)
        longest = max(map(len, vocabulary))
        out = np.zeros((len(words), len(self.languages)))
        marked = ["▁" + w for w in words]
        blocks = range(0, len(self.languages), BLOCK)
        for size, at in by_length(marked).items():
            if size > LONG:
                for i in at:
                    for k in blocks:
                        out[i, k : k + BLOCK] = long_word(marked[i], vocabulary, self.prob[:, k : k + BLOCK], longest)
                continue
            for j in range(0, len(at), 20_000):
                part = at[j : j + 20_000]
                lat = lattice([marked[i] for i in part], vocabulary, longest, trie(self.path))
                for k in blocks:
                    out[part, k : k + BLOCK] = np.log(np.maximum(forward(lat, self.prob[:, k : k + BLOCK])[:, size], 1e-300))
        return out


def parts_of(word: str) -> list[str]:
    """A word with the start mark, in parts of at most LONG characters: so a run without spaces takes part in the fit in full, but for pieces across its cuts."""
    marked = "▁" + word
    return [marked[i : i + LONG] for i in range(0, len(marked), LONG)]


def fit_pieces(counts: list[Counter], path: str = VOCABULARY, passes: int = PASSES) -> np.ndarray:
    """prob[piece, language] from each language's word counts by expectation maximisation, smoothed; a block of languages at a time."""
    blocks = [_fit_block(counts[k : k + BLOCK], path, passes) for k in range(0, len(counts), BLOCK)]
    return np.concatenate(blocks, axis=1)


def _fit_block(words_of: list[Counter], path: str, passes: int) -> np.ndarray:
    vocabulary = pieces(path)
    counts = [Counter() for _ in words_of]
    for own, given in zip(counts, words_of, strict=True):
        for w, c in given.items():
            for part in parts_of(w):
                own[part] += c
    longest, n, langs = max(map(len, vocabulary)), len(vocabulary), len(counts)
    words = sorted({w for c in counts for w in c})
    weight = np.array([[c[w] for c in counts] for w in words], np.float64).reshape(len(words), langs)
    groups = []
    for size, at in sorted(by_length(words).items()):
        for j in range(0, len(at), 20_000):
            part = at[j : j + 20_000]
            groups.append((lattice([words[i] for i in part], vocabulary, longest, trie(path)), weight[part]))
    # Longer pieces start less likely, so that the first pass does not prefer single characters.
    prob = np.repeat(np.array([[0.1 ** min(4, len(p))] for p in vocabulary]), langs, axis=1)
    prob = prob / prob.sum(axis=0)
    for _ in range(passes):
        expected = np.full((n, langs), 0.01)
        for lat, w in groups:
            a, b = forward(lat, prob), backward(lat, prob)
            total = w / np.maximum(a[:, -1], 1e-300)
            for s in range(lat.shape[1]):
                for k in range(min(lat.shape[2], lat.shape[1] - s)):
                    p = lat[:, s, k]
                    ok = np.flatnonzero(p >= 0)
                    if len(ok):
                        np.add.at(expected, p[ok], a[ok, s] * prob[p[ok]] * b[ok, s + k + 1] * total[ok])
        prob = expected / expected.sum(axis=0)
    return prob


def held_out(doc_id=None):
    """Whether a document is kept from training: crc32 of its id as text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, most: int = FIT_DOCS, path: str = VOCABULARY) -> Model:
    """A model from text and lang of documents that are not held out: at most `most` of each language, by hash of the id."""
    ship(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # One row for each language, all of which are learned; the model has one column for each.
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sorted(r.lang for r in sizes.select("lang").collect())
    if not languages:
        return Model([], np.empty((0, 0)), path)
    shares = sizes.select("lang", F.least(F.lit(1.0), most / F.col("n")).alias("share"))
    few = known.join(shares.hint("broadcast"), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def run(batches):
        for whole in batches:
            held: dict[str, Counter] = {}
            for b in slices(whole, "text"):
                for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                    held.setdefault(lang, Counter()).update(_RUNS.findall(t.lower()))
            rows = [(k, w, n) for k, c in held.items() for w, n in c.items()]
            if rows:
                lang, w, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(w, pa.string()), pa.array(n, pa.int64())], ["lang", "w", "n"])

    counts = {k: Counter() for k in languages}
    for r in few.select("lang", "text").mapInArrow(run, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.lang][r.w] = r.n
    return Model(languages, fit_pieces([counts[k] for k in languages], path), path)


class Scorer:
    """Sums of log probabilities over a text's words; tokens are remembered up to a bound."""

    def __init__(self, model: Model, bound: int = 250_000):
        self.m, self.bound = model, bound
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)))
        self.letters = np.zeros(0, bool)

    def learn(self, tokens: list[str]) -> None:
        runs = [_RUNS.findall(t) for t in tokens]
        flat = [w for r in runs for w in r]
        known = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        logs = self.m.log_words(list(known)) if known else np.zeros((0, self.table.shape[1]))
        sums = np.zeros((len(tokens), self.table.shape[1]))
        if flat:
            np.add.at(sums, np.repeat(np.arange(len(tokens)), [len(r) for r in runs]), logs[[known[w] for w in flat]])
        for t in tokens:
            self.at[t] = len(self.at)
        self.table = np.vstack([self.table, sums])
        self.letters = np.concatenate([self.letters, [bool(r) for r in runs]])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [t.lower().split() if t else [] for t in texts]
        new = list({w for x in split for w in x if w not in self.at})
        if len(self.at) + len(new) > self.bound:
            self.at.clear()
            self.table, self.letters = self.table[:0], self.letters[:0]
            new = list({w for x in split for w in x})
        if new:
            self.learn(sorted(new))
        out = []
        for x in split:
            idx = np.fromiter(map(self.at.__getitem__, x), np.int64, len(x))
            if not len(self.m.languages) or not self.letters[idx].any():
                out.append(("und", 0.0))
                continue
            s = self.table[idx].sum(axis=0)
            k = int(np.argmax(s))
            out.append((self.m.languages[k], float(1 / np.exp(s - s[k]).sum())))
        return out


_SCORERS: dict = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the probability of that language among the learned ones, equal before seeing the text).

    A null text, or one without a letter (Unicode category L), gives `und` and 0. Texts are read whole; repeated
    rows are scored again; extra columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces times languages, whatever the number of documents

    def run(batches, name=uuid.uuid4().hex):
        # A worker keeps what it has learned from one task to the next.
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer = _SCORERS[name]
        for whole in batches:
            for b in slices(whole, "text", 2 << 20):
                found = scorer(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it is held out, its predicted language (`und` without a letter), and the probability of that language."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
