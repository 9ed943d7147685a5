"""License scans: units of a text compared to licence templates by Dice coefficient over word bigrams.

Units are the lines, the paragraphs of several lines, and the whole text if it has
several paragraphs; lines without a letter or digit part paragraphs, so that comment marks don't hide them. Normalised, a
unit is its runs of a-z and 0-9 after A-Z is lower-cased. Over the words of each text also slide windows as
long as the templates, which begin at a bigram of theirs: so a notice inside a longer line or paragraph is found.
With a and b bigrams, Dice >= t needs b between a t / (2 - t) and a (2 - t) / t, which prunes
the templates before any intersection; units with too few bigrams of any template are
left out first.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm.common import WordHash, slices, utf8, window_hashes
from corpuloom.llm.license_templates import TEMPLATES
from corpuloom.session import ship, table

#: Least Dice coefficient, in hundredths.
LEAST = 80
_TOKENS = re.compile(rb"[a-z0-9]+|\n")
_WORD = re.compile(rb"[a-z0-9]+")
_GAP = re.compile(rb"\n(?:[^a-z0-9\n]*\n)+")
_HASH = WordHash()


def bigrams(raw: bytes) -> np.ndarray:
    """Sorted distinct hashes of a lower-cased unit's word bigrams."""
    return np.unique(window_hashes(_HASH.array(_TOKENS.findall(raw.replace(b"\n", b" "))), 2))


class Matcher:
    def __init__(self, templates: dict[str, tuple[str, str]], least: int = LEAST):
        self.least = least
        found = {k: bigrams(utf8(t).lower()) for k, (_, t) in sorted(templates.items())}
        self.names = [k for k, v in found.items() if len(v)]
        self.sets = [found[k] for k in self.names]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.every = np.unique(np.concatenate([*self.sets, np.empty(0, np.uint64)]))
        #: The first 16 bits of the templates' bigrams, to leave most others out at once.
        self.some = np.zeros(1 << 16, bool)
        self.some[(self.every >> np.uint64(48)).astype(np.int64)] = True
        #: Bigrams that a match shares at least: 100 * 2 i >= least (a + b) and a >= i.
        self.needs = -(-least * self.sizes // (200 - least))
        self.fewest = int(self.needs.min()) if len(self.needs) else 1
        #: Bigrams of a template in a row, repeated ones too: the length of its windows.
        self.spans = np.array([max(1, len(_WORD.findall(utf8(templates[k][1]).lower())) - 1) for k in self.names], np.int64)
        # Templates of each bigram, in the order of `every`.
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        at = np.searchsorted(self.every, np.concatenate([*self.sets, np.empty(0, np.uint64)]))
        order = np.argsort(at, kind="stable")
        self.owners, self.first = owner[order], np.searchsorted(at[order], np.arange(len(self.every) + 1))

    def known(self, pairs: np.ndarray) -> np.ndarray:
        """Places of bigrams that any template has."""
        at = np.flatnonzero(self.some[(pairs >> np.uint64(48)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(self.every, pairs[at]), max(0, len(self.every) - 1))
        return at[self.every[spot] == pairs[at]] if len(self.every) else at[:0]

    def best(self, own: np.ndarray) -> tuple[str, float] | None:
        """The template of highest Dice (the first by name of several) of a unit's bigrams, if it reaches the bound."""
        a, t = len(own), self.least
        fit = np.flatnonzero((self.sizes * (200 - t) >= t * a) & (t * self.sizes <= (200 - t) * a))
        top = None
        for k in fit.tolist():
            inter = int(np.isin(own, self.sets[k], assume_unique=True).sum())
            total = a + int(self.sizes[k])
            if 200 * inter >= t * total and (top is None or 2 * inter / total > top[1]):
                top = (self.names[k], 2 * inter / total)
        return top

    def units(self, low: bytes, lines_of: np.ndarray, at: np.ndarray):
        """kind, start and end in bytes of each unit that shares enough bigrams with templates, and its bigrams.

        lines_of: the line of each word; at: places of templates' bigrams.
        """
        inside = at[lines_of[at] == lines_of[at + 1]] if len(at) else at
        per_line = np.bincount(lines_of[inside], minlength=1) if len(inside) else np.zeros(1, int)
        lines = low.split(b"\n")
        begins = np.cumsum([0, *(len(x) + 1 for x in lines)])
        for k in np.flatnonzero(per_line >= self.fewest).tolist():
            yield "line", int(begins[k]), int(begins[k + 1]) - 1, bigrams(lines[k])
        if len(at) < self.fewest:
            return
        start, cuts = 0, []
        for m in _GAP.finditer(low):
            cuts.append((start, m.start()))
            start = m.end()
        cuts.append((start, len(low)))
        spans = [("paragraph", a, b) for a, b in cuts if b"\n" in low[a:b].strip(b" \t\r\x0b\x0c\n")]
        if len([1 for a, b in cuts if low[a:b].strip(b" \t\r\x0b\x0c\n")]) > 1:
            spans.append(("text", 0, len(low)))
        for kind, a, b in spans:
            own = bigrams(low[a:b])
            if int(np.isin(own, self.every, assume_unique=True).sum()) >= self.fewest:
                yield kind, a, b, own

    def windows(self, pairs: np.ndarray, at: np.ndarray):
        """Template, Dice, and place and length in bigrams of each template's best window (the first of several) that reaches the bound."""
        spot = np.searchsorted(self.every, pairs[at])
        many = self.first[spot + 1] - self.first[spot]
        owners = self.owners[np.repeat(self.first[spot] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        places = np.repeat(at, many)
        counts = np.bincount(owners, minlength=len(self.sets))
        for k in np.flatnonzero(counts >= self.needs).tolist():
            own, n, b = places[owners == k], int(self.spans[k]), int(self.sizes[k])
            ends = np.searchsorted(own, own + n)
            top = None
            for j in np.flatnonzero(ends - np.arange(len(own)) >= self.needs[k]).tolist():
                window = pairs[own[j] : own[j] + n]
                inter, total = len(np.unique(pairs[own[j : ends[j]]])), len(np.unique(window)) + b
                if 200 * inter >= self.least * total and (top is None or 2 * inter / total > top[1]):
                    top = (self.names[k], 2 * inter / total, int(own[j]), len(window))
            if top:
                yield top

    def __call__(self, text: str | None) -> list[tuple]:
        """kind, start, end (in characters), template and Dice of each unit that matches, then of each template's best window."""
        if not text:
            return []
        raw = utf8(text)
        low = raw.lower()
        words = _TOKENS.findall(low)
        breaks = np.fromiter((w == b"\n" for w in words), bool, len(words))
        h, lines_of = _HASH.array(words)[~breaks], np.cumsum(breaks)[~breaks]
        pairs = window_hashes(h, 2)
        at = self.known(pairs)
        if len(at) < self.fewest:
            return []
        out = []
        char = lambda k: len(raw[:k].decode("utf-8", "surrogatepass"))
        for kind, a, b, own in self.units(low, lines_of, at):
            found = self.best(own)
            if found:
                out.append((kind, char(a), char(b), *found))
        spans = None
        for name, dice, start, n in self.windows(pairs, at):
            spans = spans or [m.span() for m in _WORD.finditer(low)]
            out.append(("window", char(spans[start][0]), char(spans[start + n][1]), name, dice))
        return out


def license_matches(docs: DataFrame, templates: dict | None = None, least: int = LEAST) -> DataFrame:
    """doc_id and matches: array of unit, start, end, template, license, dice, in the order lines, paragraphs, text, windows.

    A null or empty text, or a unit of under two words, matches nothing. Texts are read whole;
    repeated rows are scanned again; extra columns are ignored; an empty table gives an empty result.
    """
    templates = templates or TEMPLATES
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("unit", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("template", pa.string()), ("license", pa.string()), ("dice", pa.float64())]))

    def run(batches):
        match = Matcher(templates, least)
        for whole in batches:
            for b in slices(whole, "text"):
                rows = [
                    [{"unit": u, "start": s, "end": e, "template": t, "license": templates[t][0], "dice": d} for u, s, e, t, d in match(text)] for text in b.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "matches"])

    schema = "doc_id long, matches array<struct<unit string, start long, end long, template string, license string, dice double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def scan_result(m: DataFrame) -> DataFrame:
    """Of license_matches(): per row the best match (by Dice, then template), how many units match, and how many templates match a window."""
    better = lambda x, y: F.when(x["dice"] > y["dice"], -1).when(x["dice"] < y["dice"], 1).when(x["template"] < y["template"], -1).when(x["template"] > y["template"], 1).otherwise(0)
    best = F.get(F.array_sort("matches", better), F.lit(0))
    windows = F.size(F.filter("matches", lambda x: x["unit"] == "window"))
    return m.withColumn("best", best).select(
        "doc_id", F.col("best.template").alias("template"), F.col("best.license").alias("license"), F.col("best.dice").alias("dice"),
        (F.size("matches") - windows).cast("long").alias("n_matches"), windows.cast("long").alias("n_windows"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the best match (by Dice, then template), its Dice, how many units match, and how many templates match a window."""
    return scan_result(license_matches(table(spark, sf_dir, "documents")))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(name)}, {quote(text)})" for k, (name, text) in sorted(TEMPLATES.items()))
    words = "regexp_extract_all(lower(regexp_replace({0}, '[^\\x00-\\x7F]', '.', 'g')), '[a-z0-9]+')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    ws = r"[\x20\x09-\x0D]"
    return rf"""
WITH t AS (SELECT template, license, len(w) - 1 AS span, {pairs.format("w")} AS g FROM (SELECT *, {words.format("body")} AS w FROM (VALUES {values}) v(template, license, body))),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\n(?:[^A-Za-z0-9\n]*\n)+'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS parts FROM d),
u AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM d
  UNION ALL SELECT doc_id, x FROM (SELECT doc_id, unnest(parts) AS x FROM p) WHERE contains(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), chr(10))
  UNION ALL SELECT doc_id, text FROM p WHERE len(parts) > 1),
g AS (SELECT doc_id, row_number() OVER () AS unit, {pairs.format("w")} AS g FROM (SELECT doc_id, {words.format("body")} AS w FROM u) WHERE len(w) > 1),
x AS (SELECT doc_id, unit, len(g) AS a, unnest(g) AS pair FROM g WHERE len(g) <= (SELECT max(len(g)) FROM t) * 3 / 2),
m AS (SELECT doc_id, unit, template, license, 2 * count(*) / (any_value(a) + any_value(b)) AS dice FROM x
  JOIN (SELECT template, license, len(g) AS b, unnest(g) AS pair FROM t) USING (pair) GROUP BY doc_id, unit, template, license
  HAVING 200 * count(*) >= {LEAST} * (any_value(a) + any_value(b))),
p2 AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS every FROM (SELECT doc_id, {words.format("text")} AS w FROM d)),
h AS (SELECT doc_id, template, license, span, b, s, pair FROM (SELECT doc_id, unnest(range(1, len(every) + 1)) AS s, unnest(every) AS pair FROM p2) JOIN (SELECT template, license, span, len(g) AS b, unnest(g) AS pair FROM t) USING (pair)),
hw AS (SELECT x.doc_id, x.template, x.license, x.span, x.b, x.s, count(DISTINCT y.pair) AS inter FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.template = y.template AND y.s BETWEEN x.s AND x.s + x.span - 1 GROUP BY ALL HAVING count(DISTINCT y.pair) * (200 - {LEAST}) >= {LEAST} * x.b),
w AS (SELECT doc_id, template, license, max(2 * inter / (a + b)) AS dice FROM (SELECT hw.*, len(list_distinct(every[s:s + span - 1])) AS a FROM hw JOIN p2 USING (doc_id)) WHERE 200 * inter >= {LEAST} * (a + b) GROUP BY ALL),
best AS (SELECT doc_id, count(DISTINCT unit) AS n, count(DISTINCT CASE WHEN unit IS NULL THEN template END) AS windows, arg_min(struct_pack(template := template, license := license, dice := dice), struct_pack(d := -dice, t := template)) AS b
  FROM (SELECT doc_id, unit, template, license, dice FROM m UNION ALL SELECT doc_id, NULL, template, license, dice FROM w) GROUP BY doc_id)
SELECT d.doc_id, b.template AS template, b.license AS license, b.dice AS dice, coalesce(n, 0)::BIGINT AS n_matches, coalesce(windows, 0)::BIGINT AS n_windows FROM d LEFT JOIN best USING (doc_id)
"""


OP1_SQL = _sql()
