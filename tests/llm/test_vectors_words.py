"""Whitening, spelling variants and the permutation index against brute force, SQL and edge rows."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuloom.llm import permutation_index, spelling, whitening

D = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, n long, dim int, rep long, whitened string"


def vector_rows(spark, rows):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(i, v, 1, 2, 3, "w") for i, v in rows], VECTORS)


def brute_whitening(x):
    x = np.floor(1024 * np.asarray(x, float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    v = np.cov(x.T.astype(float), bias=True)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    return ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_brute_force(spark):
    e = spark.read.parquet(f"{D}/embeddings.parquet").toPandas().sort_values("vec_id")
    got = whitening.op11_whitening(spark, D).toPandas()
    deviation, w, explained = brute_whitening(np.stack(e.embedding))
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[e.vec_id].to_numpy()
    sign = np.sign((wide * w).sum(axis=0))
    assert np.abs(wide - w * sign).max() < 1e-9
    assert (got.drop_duplicates("vec_id").set_index("vec_id").deviation.loc[e.vec_id].to_numpy() == deviation).all()
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9 and (got.n == len(e)).all()


def test_chan_merge_equals_the_whole():
    rng = np.random.default_rng(3)
    x = rng.integers(99_000, 101_000, (500, 7))
    state = whitening.state_of(x[:1])
    for lo, hi in ((1, 9), (9, 300), (300, 301), (301, 500)):
        state = whitening.merge(state, whitening.state_of(x[lo:hi]))
    n, sums, scatter = state
    assert (n, sums) == (500, x.sum(axis=0).tolist())
    assert np.abs(scatter - np.cov(x.T, bias=True) * 500).max() < 1e-6 * np.abs(scatter).max()


def test_whitening_does_not_depend_on_partitions(spark):
    e = spark.read.parquet(f"{D}/embeddings.parquet")
    one, many = (whitening.whitened_vectors(e.repartition(n)).toPandas().sort_values("vec_id") for n in (1, 23))
    assert (one.deviation.to_numpy() == many.deviation.to_numpy()).all()
    assert np.abs(np.stack(one.whitened) - np.stack(many.whitened)).max() < 1e-9


def test_whitening_edges(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=3).tolist()) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (None, [1.0, 2.0, 3.0]), (1, [5.0, 5.0, 5.0])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [float("nan"), 1.0, 1.0]), (54, [float("inf"), 1.0, 1.0])]
    other = [(60, [1.0, 1.0]), (61, [2.0, 2.0])]
    got = whitening.whitened_vectors(vector_rows(spark, good + bad + other)).collect()
    three = [r for r in got if r.dim == 3]
    assert len(three) == 43 and {r.n for r in three} == {43} and sum(r.vec_id is None for r in three) == 1
    deviation, w, _ = brute_whitening([v for _, v in good])
    assert sorted(r.deviation for r in three) == sorted(deviation.tolist())
    assert all(len(r.whitened) == 3 and r.identity_error < 1e-9 for r in three)
    # Two rows on a line: one component, the other has no variance.
    two = [r for r in got if r.dim == 2]
    assert [r.whitened[1] for r in two] == [None, None] and [round(abs(r.whitened[0]), 9) for r in two] == [1.0, 1.0] and two[0].explained[1] == 0
    # Equal rows: nothing has variance.
    same = whitening.whitened_vectors(vector_rows(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.deviation, r.whitened, r.identity_error) for r in same] == [(0, [None, None], 0.0)] * 2
    assert whitening.whitened_vectors(vector_rows(spark, [])).collect() == []
    with pytest.raises(Exception, match="does not fit a long"):
        whitening.whitened_vectors(vector_rows(spark, [(1, [1e12]), (2, [0.0])])).collect()


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("seed", range(6))
def test_automata_accept_words_at_distance_one(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(150)} | {"x" * 300, "x" * 299 + "y", "x" * 301})
    trie = spelling.Trie(words, np.ones(len(words)))
    asked = words + ["".join(rng.choice("abéz") for _ in range(rng.randint(0, 6))) for _ in range(50)]
    got = sorted(zip(*(v.tolist() for v in trie.accepted(asked)), strict=True))
    assert got == [(i, w) for i, a in enumerate(asked) for w, b in enumerate(words) if near(a, b)]


def brute_spelling(rows, least=3):
    counts: dict = {}
    for i, text in rows:
        for run in spelling.re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    counts = {w: n for w, n in counts.items() if n >= least}
    out = {}
    for w, n in counts.items():
        near_words = [v for v in counts if near(v, w)]
        best = min(near_words, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        out[w] = (form, n, len(near_words), counts[form] if form else None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (v[0], root(w), *v[1:]) for w, v in out.items()}


def as_dict(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.fixture(scope="module")
def spelt(spark):
    rng = random.Random(5)
    stems = ["kitten", "mitten", "smitten", "Straße", "ÀÉÎõü", "colour", "color", "colours"]
    rows = [(i, " ".join(rng.choice(stems) + rng.choice(["", "", "s", "x"]) for _ in range(60))) for i in range(40)]
    rows += [(None, "kitten kitten"), (3, None), (4, ""), (5, "kittens " * 4000), (5, "kittens " * 4000), (6, "z" * 5000 + " " + "z" * 5000 + "-" + "z" * 5001), (7, ("z" * 5000 + "1") * 3 + ("z" * 5001 + "\n") * 7), (8, "×÷×÷× 漢字kitten漢字 don't")]
    return rows


def test_spelling_equals_brute_force(spark, spelt):
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in spelt], "doc_id long, text string, word string, n long")
    got = as_dict(spelling.spelling_variants(docs))
    assert got == brute_spelling(spelt) and any(v[0] for v in got.values()) and any(v[0] != v[1] and v[0] for v in got.values())
    assert spelling.spelling_variants(docs.limit(0)).collect() == []


def test_spelling_shards_and_waves_agree(spark, spelt):
    words = spelling.cut(spelling.word_counts(spark.createDataFrame(spelt, "doc_id long, text string")))
    whole, parts = (
        {r.word: (r.n_near, r.form_n, r.form) for r in spelling.neighbours(words, *bounds).collect()} for bounds in ((1_000_000, 8_000_000), (40, 100))
    )
    assert whole == parts and whole


def test_spelling_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    cur = con.execute(spelling.OP12_SQL)
    at = [c[0] for c in cur.description].index
    expected = {r[at("word")]: tuple(r[at(c)] for c in ("form", "root", "n", "n_near", "form_n")) for r in cur.fetchall()}
    assert as_dict(spelling.op12_spelling_variants(spark, D)) == expected


def brute_nearest(rows, k=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, v in ok:
        if i % 20 == 0:
            best = out.setdefault(i, {})
            for j, w in ok:
                if j != i and len(w) == len(v):
                    best[j] = max(best.get(j, -np.inf), float(v @ w))
    return {i: sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k] for i, best in out.items()}


def as_lists(df):
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def search(vectors, **more):
    return permutation_index.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0, **more)


@pytest.mark.parametrize("sizes", [{}, {"block": 100, "group": 3, "pivots": 32, "prefix": 8}])
def test_recall_of_the_permutation_index(spark, sizes):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = as_lists(search(e, **sizes))
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    true, vectors = brute_nearest(rows), dict(rows)
    assert got.keys() == true.keys() and all(len(v) == 20 for v in got.values())
    found = [len({i for i, _ in got[q]} & {i for i, _ in true[q]}) / 20 for q in true]
    assert np.mean(found) >= 0.9
    for q, own in got.items():
        assert all(abs(s - float(np.dot(np.float64(vectors[q]), np.float64(vectors[i])))) < 1e-12 for i, s in own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_index_ranks_a_share_of_the_rows(spark):
    """Clustered vectors need far fewer of them ranked than there are."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.repeat(centres, 50, axis=0) + 0.05 * rng.normal(size=(2000, 16))
    pivots = x[rng.permutation(2000)[:128]]
    index = permutation_index.Postings(permutation_index.prefixes(x, pivots, 16), 128)
    near_ = index.nearness(permutation_index.prefixes(x[:1], pivots, 16)[0])
    rows = np.flatnonzero(near_ >= permutation_index.least_of(near_, 60))
    assert len(rows) < 200 and set(np.argsort(-(x @ x[0]))[:20]) <= set(rows)


def test_nearness_is_the_footrule():
    rng = np.random.default_rng(1)
    a = np.array([rng.permutation(12)[:5] for _ in range(30)], np.int16)
    place = lambda p, v: p.tolist().index(v) if v in p else 5
    got = permutation_index.Postings(a, 12).nearness(a[7])
    for p, s in zip(a, got, strict=True):
        assert sum(abs(place(p, v) - place(a[7], v)) for v in range(12)) == 30 - 2 * s


def test_index_edges(spark):
    rng = np.random.default_rng(4)
    common = rng.normal(size=4).tolist()
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 60)] + [(i, common) for i in range(60, 140)] + [(20, common), (20, common), (7, common)]
    rows += [(200, None), (220, []), (240, [1.0, None, 1.0, 1.0]), (260, [float("nan")] * 4), (280, [float("inf"), 1.0, 1.0, 1.0]), (300, [0.0] * 4), (None, common), (-20, [-0.0, 0.0, 1.0, 0.0]), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (420, [1.0] * 7)]
    got, true = as_lists(search(vector_rows(spark, rows))), brute_nearest(rows)
    assert got.keys() == {q for q, v in true.items() if v}
    for q, own in got.items():
        assert [i for i, _ in own] == [i for i, _ in true[q]], q
        assert np.allclose([s for _, s in own], [s for _, s in true[q]])
    assert got[400] == [(401, 4.0)]
    assert search(vector_rows(spark, [])).collect() == [] and search(vector_rows(spark, [(1, [1.0])])).collect() == []
