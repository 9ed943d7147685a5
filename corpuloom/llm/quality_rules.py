"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths over a text's words, in numpy, give the
characters inside duplicated n-grams; the share of the commonest short n-gram and of
duplicated lines completes the rules. Hashes roll on from n to n + 1 words, and a window can only
repeat where both windows inside it do.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm.common import M1, WordHash, mix, slices, utf8
from corpuloom.session import ship, table

#: Fixed values of the published repetition rules: most characters inside duplicated n-grams, by n.
DUP_NGRAM_CHARS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Most characters inside the commonest n-gram, by n.
TOP_NGRAM_CHARS = {2: 0.20, 3: 0.18, 4: 0.16}
TOP_LEAST = 3
MOST_DUP_LINES, MOST_DUP_LINE_CHARS = 0.30, 0.20
#: Symbols per word, and characters of a mean word.
MOST_SYMBOLS, WORD_LENGTH = 0.10, (2.0, 14.0)
SYMBOLS = re.compile(r"[#*$%&|<>]")
_HASH = WordHash()


@dataclass
class Rules:
    dup_ngram_chars: dict = field(default_factory=lambda: dict(DUP_NGRAM_CHARS))
    top_ngram_chars: dict = field(default_factory=lambda: dict(TOP_NGRAM_CHARS))
    dup_lines: float = MOST_DUP_LINES
    dup_line_chars: float = MOST_DUP_LINE_CHARS
    symbols: float = MOST_SYMBOLS
    word_length: tuple = WORD_LENGTH
    #: Occurrences that the commonest n-gram has at least: in a short text one repeated pair is already a large share.
    top_least: int = TOP_LEAST


def code_points(words: list[bytes]) -> np.ndarray:
    """Characters of each UTF-8 word: its bytes that are not continuation bytes."""
    if not words:
        return np.empty(0, np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    heads = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    return np.diff(heads[np.concatenate([[0], ends])])


def repeats(h: np.ndarray, longest: int):
    """For n from 1 to `longest`: n, the places of the windows of n words that occur twice or more, and a number of each one's content.

    h: the words' hashes. A window's hash is that of the window one word shorter, mixed with its last word.
    """
    at, rolled = np.arange(len(h)), mix(h)
    for n in range(1, longest + 1):
        if n > 1:
            # Only where the windows inside it, from this word and from the next, repeat.
            inside = np.zeros(len(h) + 1, bool)
            inside[at] = True
            go = inside[at + 1]
            at, rolled = at[go], rolled[go]
            rolled = (rolled ^ h[at + n - 1]) * M1
            rolled = rolled ^ (rolled >> np.uint64(29))
        order = np.argsort(rolled, kind="stable")
        by = rolled[order]
        first = np.concatenate([np.ones(min(1, len(by)), bool), by[1:] != by[:-1]])
        content = np.empty(len(at), np.int64)
        content[order] = np.cumsum(first) - 1
        often = np.bincount(content, minlength=1)[content] > 1
        at, rolled, content = at[often], rolled[often], content[often]
        yield n, at, content


def covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside the windows of n words that begin at `at`."""
    marks = np.zeros(words + 1, np.int64)
    marks[at] += 1
    marks[at + n] -= 1
    return np.cumsum(marks[:-1]) > 0


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", "dup_chars", "top_chars"]


def measure(text: str | None, rules: Rules, hashes: WordHash) -> tuple:
    """The values of COLUMNS; dup_chars and top_chars are lists in the order of the rules' n."""
    dup_ns, top_ns = list(rules.dup_ngram_chars), list(rules.top_ngram_chars)
    if not text:
        return 0, 0, 0, 0, 0, 0, 0, [0] * len(dup_ns), [0] * len(top_ns)
    raw = utf8(text)
    words = raw.split()
    chars = code_points(words)
    total, n = int(chars.sum()), len(words)
    lines, seen, dup_lines, dup_line_chars = 0, set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            lines += 1
            if line in seen:
                dup_lines += 1
                dup_line_chars += int(code_points(line.split()).sum())
            else:
                seen.add(line)
    dup, top, repeat5 = dict.fromkeys(dup_ns, 0), dict.fromkeys(top_ns, 0), 0
    for k, at, content in repeats(hashes.array(words), max(5, *dup_ns, *top_ns)):
        if not len(at):
            break
        if k in dup or k == 5:
            inside = covered(at, k, n)
            if k in dup:
                dup[k] = int(chars[inside].sum())
            if k == 5:
                repeat5 = int(inside.sum())
        if k in top:
            _, first, counts = np.unique(content, return_index=True, return_counts=True)
            many = int(counts.max())
            if many >= rules.top_least:
                # Of the commonest n-grams, the one with the most characters.
                size = max(int(chars[i : i + k].sum()) for i in at[first[counts == many]].tolist())
                top[k] = min(total, size * many)
    dup, top = list(dup.values()), list(top.values())
    return n, total, len(SYMBOLS.findall(text)), dup_lines, repeat5, lines, dup_line_chars, dup, top


def repetition(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id and the measures of COLUMNS, for each row.

    A null or empty text has no words and measures of 0. Texts are read whole,
    whatever their length. Repeated rows are measured again; extra columns are ignored.
    """
    rules = rules or Rules()
    ship(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                rows = [measure(t, rules, _HASH) for t in b.column("text").to_pylist()]
                cols = list(zip(*rows, strict=True))
                arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[7:]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", *COLUMNS])

    kinds = ", ".join(f"{c} {'array<long>' if c in ('dup_chars', 'top_chars') else 'long'}" for c in COLUMNS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {kinds}")


def quality_rules(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The measures of repetition() with base_failed, kept and the rules that failed.

    base_failed: under 10 words, or over a fifth of the words inside 5-word windows
    found twice or more. A document is kept if neither the base nor a rule fails; an
    empty table gives an empty result.
    """
    rules = rules or Rules()
    m = repetition(docs, rules)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = {
        "symbols": F.col("n_symbols") > rules.symbols * F.col("n_words"),
        "short_words": F.col("word_chars") < rules.word_length[0] * F.col("n_words"),
        "long_words": F.col("word_chars") > rules.word_length[1] * F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") > rules.dup_lines * F.col("n_lines"),
        "dup_line_chars": F.col("dup_line_chars") > rules.dup_line_chars * F.col("word_chars"),
    }
    for i, (n, most) in enumerate(rules.dup_ngram_chars.items()):
        failed[f"dup_{n}"] = F.get("dup_chars", F.lit(i)) > most * F.col("word_chars")
    for i, (n, most) in enumerate(rules.top_ngram_chars.items()):
        failed[f"top_{n}"] = F.get("top_chars", F.lit(i)) > most * F.col("word_chars")
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in failed.items()]))
    return m.withColumn("base_failed", base).withColumn("failed", broken).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the measures of the base, whether it fails, and the verdict of all rules."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _dup_sql(n: int) -> str:
    return f"""SELECT doc_id, {n} AS n, sum(len) AS chars, count(*) AS words FROM (
      SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams WHERE n = {n}) WHERE c > 1)
      JOIN words USING (doc_id, i) GROUP BY doc_id"""


_GRAMS = [*TOP_NGRAM_CHARS, *DUP_NGRAM_CHARS]
OP4_SQL = (
    r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(list_transform(ws, lambda x: length(x))) AS len FROM base),
grams AS ("""
    + " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, unnest(range(1, len(ws) - {n - 2})) AS i, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda k: array_to_string(ws[k:k + {n - 1}], ' '))) AS gram FROM base WHERE len(ws) >= {n}"
        for n in _GRAMS
    )
    + "), dup AS ("
    + " UNION ALL ".join(_dup_sql(n) for n in DUP_NGRAM_CHARS)
    + r"""),
tops AS (SELECT doc_id, n, max(c * size) AS chars FROM (
    SELECT *, max(c) OVER (PARTITION BY doc_id, n) AS most FROM (
      SELECT g.doc_id, n, gram, count(*) AS c, any_value(length(replace(gram, ' ', ''))) AS size
      FROM grams g WHERE n <= 4 GROUP BY g.doc_id, n, gram)) WHERE c = most AND c >= 3 GROUP BY doc_id, n),
lines AS (SELECT doc_id, l, count(*) - 1 AS again FROM (SELECT doc_id, unnest(ls) AS l FROM base) GROUP BY ALL),
dl AS (SELECT doc_id, sum(again) AS n_dup_lines, sum(again * length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) AS dup_line_chars FROM lines GROUP BY doc_id),
m AS (
  SELECT b.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dl.n_dup_lines, 0) AS n_dup_lines, len(ls) AS n_lines,
    coalesce(dl.dup_line_chars, 0) AS dup_line_chars, coalesce(d5.words, 0) AS n_repeat_words
  FROM base b LEFT JOIN dl USING (doc_id) LEFT JOIN (SELECT * FROM dup WHERE n = 5) d5 USING (doc_id)),
bad AS (
  SELECT doc_id FROM m JOIN dup USING (doc_id) WHERE chars > (CASE n """
    + " ".join(f"WHEN {n} THEN {x}::DOUBLE" for n, x in DUP_NGRAM_CHARS.items())
    + " END) * word_chars UNION SELECT doc_id FROM m JOIN tops USING (doc_id) WHERE least(chars, word_chars) > (CASE n "
    + " ".join(f"WHEN {n} THEN {x}::DOUBLE" for n, x in TOP_NGRAM_CHARS.items())
    + f""" END) * word_chars UNION SELECT doc_id FROM m WHERE n_symbols > {MOST_SYMBOLS}::DOUBLE * n_words OR word_chars < {WORD_LENGTH[0]} * n_words
    OR word_chars > {WORD_LENGTH[1]} * n_words OR n_dup_lines > {MOST_DUP_LINES}::DOUBLE * n_lines OR dup_line_chars > {MOST_DUP_LINE_CHARS}::DOUBLE * word_chars),
v AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad)) AS kept FROM v
"""
)
