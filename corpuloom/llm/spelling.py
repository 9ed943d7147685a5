"""Spelling variant grouping: words meet trie shards as distance-one Levenshtein automata.

Words are counted over all texts. The vocabulary, in code-point order, becomes shards of a
compact trie, each of bounded size. Waves of shards are broadcast; every word's automaton is
intersected with every shard, and what it accepts is reduced to a count and the best form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.session import cut, ship, table

#: Code points of the words of one shard (a longer word is a shard of its own), and of the shards that are broadcast at once.
SHARD_CHARS, WAVE_CHARS = 1_000_000, 8_000_000
#: Words, and their code points, whose automata are advanced together.
BATCH, BATCH_CHARS = 4096, 1 << 20
#: Words that a worker counts before it passes them on.
COUNTED = 400_000
CODE_BITS = 21
#: Every byte but ASCII letters becomes a space, capitals become small.
ASCII_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))
RUNS = re.compile("[a-zÀ-ÿ]+")


def runs_of(text: str) -> list[str]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased."""
    if text.isascii():
        return text.encode().translate(ASCII_LETTERS).decode().split()
    return RUNS.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def misspelt(run: str, start: int, every: int) -> str:
    """The run, without one code point where the crc32 of the id and the run says so. start: the crc32 of `<doc_id>:`."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """word, n: results of at least so many code points that occur so often over all whole texts."""

    def count(batches):
        held: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                start = zlib.crc32(f"{i}:".encode())
                for run, n in Counter(runs_of(text)).items():
                    if len(run) >= least_length and len(word := misspelt(run, start, every)) >= least_length:
                        held[word] += n
                if len(held) >= COUNTED:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id")
    parts = docs.select(ids, F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """Sorted distinct words as a trie in arrays: node 0 is the root, node j + 1 is reached by keys[j] = parent << 21 | code point.

    Nodes are numbered level by level, so keys is sorted and a node's children are neighbours.
    """

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, np.asarray(n, np.int64)
        codes, starts, sizes = code_points(words)
        live, at, same = np.arange(len(words)), np.zeros(len(words), np.int64), np.ones(len(words), bool)
        same[:1] = False
        keys, final, total, depth = [], [np.full(1, 0 if words and not words[0] else -1, np.int32)], 0, 0
        while len(live := live[sizes[live] > depth]):
            c, before = codes[starts[live] + depth], live - 1
            goes_on = sizes[before] > depth
            s = same[live] & goes_on & (codes[np.where(goes_on, starts[before] + depth, 0)] == c)
            node = total + np.cumsum(~s)
            keys.append((at[live[~s]] << CODE_BITS) | c[~s])
            ends = np.full(len(keys[-1]), -1, np.int32)
            whole = sizes[live] == depth + 1
            ends[node[whole] - total - 1] = live[whole]
            final.append(ends)
            same[live], at[live] = s, node
            total += len(ends)
            depth += 1
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        #: The word that ends at a node, or -1.
        self.final = np.concatenate(final)
        #: Children of node v are nodes first[v] + 1 to first[v + 1].
        self.first = np.searchsorted(self.keys, np.arange(total + 2, dtype=np.int64) << CODE_BITS).astype(np.int64)

    def child(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node that each code point leads to, or -1."""
        key = (node << CODE_BITS) | code
        j = np.searchsorted(self.keys, key)
        j[j == len(self.keys)] = 0
        return np.where(self.keys[j] == key, j + 1, -1) if len(self.keys) else np.full(len(key), -1)

    def accepted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(i, w): word w of the trie is one insertion, deletion or replacement away from words[i]; each pair once.

        The automaton's error-free state of each word goes down its path. At every node it spawns
        the states after one error, which are followed to their ends before the path goes on. An
        inserted code point differs from the next one and a deleted one from the one before, so that
        no neighbour is accepted twice.
        """
        codes, starts, sizes = code_points(words)
        out: list = []

        def follow(i, node, at):
            while len(i):
                over = at == sizes[i]
                if over.any():
                    w = self.final[node[over]]
                    out.append((i[over][w >= 0], w[w >= 0]))
                    i, node, at = i[~over], node[~over], at[~over]
                node = self.child(node, codes[starts[i] + at])
                on = node >= 0
                i, node, at = i[on], node[on], at[on] + 1

        i, node, depth = np.arange(len(words)), np.zeros(len(words), np.int64), 0
        while len(i):
            left = depth < sizes[i]
            next_code = np.where(left, codes[np.where(left, starts[i] + depth, 0)], -1) if len(codes) else np.full(len(i), -1)
            many = self.first[node + 1] - self.first[node]
            row = np.repeat(np.arange(len(i)), many)
            edge = self.first[node][row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
            other = (self.keys[edge] & ((1 << CODE_BITS) - 1)) != next_code[row]
            row, edge = row[other], edge[other]
            follow(i[row], edge + 1, np.full(len(row), depth))
            replaced = left[row]
            follow(i[row[replaced]], edge[replaced] + 1, np.full(int(replaced.sum()), depth + 1))
            gone = left.copy()
            if depth:
                gone[left] = codes[starts[i[left]] + depth] != codes[starts[i[left]] + depth - 1]
            follow(i[gone], node[gone], np.full(int(gone.sum()), depth + 1))
            i, node = i[left], self.child(node[left], next_code[left])
            i, node, depth = i[node >= 0], node[node >= 0], depth + 1
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' code points in one array, where each word starts, and its length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.cumsum(sizes) - sizes, sizes


def best_neighbours(words: list[str], trie: Trie) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, number of neighbours, the neighbour of largest n, ties to the smallest) of the words that have any in the trie."""
    i, w = trie.accepted(words)
    order = np.lexsort((w, -trie.n[w], i))
    i, w = i[order], w[order]
    at = np.flatnonzero(np.diff(i, prepend=-1))
    return i[at], np.diff(np.append(at, len(i))), w[at]


def _shards(most: int):
    """Words of a partition, in order, in groups of bounded size; equal groups whatever the batches."""

    def run(batches):
        held, size = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([[w for w, _ in held]], pa.list_(pa.string())), pa.array([[n for _, n in held]], pa.list_(pa.int64()))], ["chars", "words", "counts"])
        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                if held and size + len(w) > most:
                    yield pack()
                    held, size = [], 0
                held.append((w, n))
                size += len(w)
        if held:
            yield pack()

    return run


def _intersect(shared):
    """For every word that a wave of shards holds neighbours of: their number and the best one."""
    names = ["word", "n_near", "form_n", "form"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        tries = [Trie(words, np.array(n)) for words, n in shared.value]
        for b in batches:
            words = sorted(b.column("word").to_pylist())
            at = 0
            while at < len(words):
                to, size = at, 0
                while to < len(words) and to - at < BATCH and (to == at or size + len(words[to]) <= BATCH_CHARS):
                    size += len(words[to])
                    to += 1
                part, at = words[at:to], to
                best: dict = {}
                for trie in tries:
                    for i, many, w in zip(*(x.tolist() for x in best_neighbours(part, trie)), strict=True):
                        known, mine = best.get(i, (0, (0, ""))), (-int(trie.n[w]), trie.words[w])
                        best[i] = (known[0] + many, min(known[1], mine))
                if best:
                    rows = [(part[i], many, -n, form) for i, (many, (n, form)) in sorted(best.items())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def neighbours(words: DataFrame, shard: int = SHARD_CHARS, wave: int = WAVE_CHARS) -> DataFrame:
    """word, n_near, form_n, form: of each word that has others at distance one, how many, and the one of largest n (ties: smallest).

    words: word, n, distinct; a table, since each wave reads it again. The driver holds the words of one wave of shards at a time, `wave` code points or one shard.
    """
    spark = words.sparkSession
    ship(spark)
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    ordered = words.repartitionByRange(max(1, -(-chars // shard)), "word").sortWithinPartitions("word")
    shards = cut(ordered.mapInArrow(_shards(shard), "chars long, words array<string>, counts array<long>"), "shards")
    # Which shards make up a wave is told from their sizes alone.
    sizes = shards.select(F.element_at("words", 1).alias("first"), "chars").orderBy("first").toLocalIterator()
    waves: list[list] = []
    room = 0
    for r in sizes:
        if room + r.chars > wave or not waves:
            waves.append([r.first, r.first])
            room = 0
        waves[-1][1] = r.first
        room += r.chars
    found = []
    for lo, hi in waves:
        few = shards.where(F.element_at("words", 1).between(lo, hi)).select("words", "counts").collect()
        shared = spark.sparkContext.broadcast([(list(r.words), list(r.counts)) for r in sorted(few, key=lambda r: r.words[0])])
        found.append(cut(words.select("word").mapInArrow(_intersect(shared), "word string, n_near long, form_n long, form string"), "near"))
        shared.destroy()
    if not found:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form")).limit(0)
    if len(found) == 1:
        return found[0]
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    best = both.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form"))).alias("b"))
    return best.select("word", "n_near", (-F.col("b.n")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form that following forms leads to. forms: word, form, both not null; no cycle, since n at least doubles."""
    up = cut(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(64):
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(up.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        up = further.select("word", "root")
    raise RuntimeError("forms lead in a circle")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, with
    a code point deleted where crc32(`<doc_id>:<run>`) is divisible by `every`. Null and empty texts
    have none; a null doc_id is written as nothing. Repeated rows count each time; a form needs `factor`
    times the word's n; ties go to the smallest word. A very long run is a word like any other.
    Other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    words = cut(word_counts(docs, least_length, least_count, every), "counts")
    near = neighbours(words)
    rows = words.join(near.hint("merge"), "word", "left")
    good = F.col("form_n") >= factor * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "forms")
    last = roots(rows.where("form is not null"))
    return rows.join(last.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word of the documents: its near words, its commoner form if one is twice as frequent, and the root that forms lead to."""
    return spelling_variants(table(spark, sf_dir, "documents"))


#: crc32 by its table (reflected polynomial 0xEDB88320); neighbours by patterns with one gap, and by deletions.
OP12_SQL = r"""
WITH RECURSIVE steps AS (SELECT i AS byte, i AS c, 0 AS k FROM range(256) t(i) UNION ALL
  SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crcs AS (SELECT list(c ORDER BY byte) AS t FROM steps WHERE k = 8),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents),
lowered AS (SELECT id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs GROUP BY ALL),
hashed AS (SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END))),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h FROM lowered, crcs WHERE length(run) >= 5),
changed AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM changed WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gaps AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS gap, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM spots),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON a.shorter = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN words b ON a.shorter = b.word),
ranked AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs),
forms AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.near_n >= 2 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 2 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1),
chains AS (SELECT word, word AS root, form AS up FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON c.up = f.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON f.word = c.word AND c.up IS NULL
"""
