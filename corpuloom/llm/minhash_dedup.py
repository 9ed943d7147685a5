"""MinHash near-dedup by a chosen-path set similarity join.

Every document is the set of hashes of its word shingles. Equal sets are folded
into one class first, so exact copies cost one row each. Classes then descend
a number of independent trees: a node's path picks one or two of the minwise
coordinates, and the value there picks the child. Nodes of one class are
dropped, small nodes are compared exhaustively by sketch, large nodes branch
again, and what is still large at the last level, or would make few tiles, is
compared in square tiles, so that nothing is capped. Groups of alike sketches are confirmed on the full
sets, and each leaves a spanning star of links, never all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuloom.llm.common import WordHash, mix, slices, utf8, window_hashes
from corpuloom.llm.components import connected_components
from corpuloom.session import cut, ship, table

#: Minwise coordinates of a sketch.
COORDS = 32
#: Trees. They draw from the same coordinates, so a pair's misses depend on how many of its coordinates agree; the tests measure what is found.
TREES = 10
#: Levels of branching.
DEPTH = 3
#: Classes in a node that is compared exhaustively, by sketches only; tiles have half as many on a side.
LEAF = 2048
#: Members in one side of a tile of a group whose full sets are compared at once.
SIDE = 2048
#: Shingles in one side of a tile of a group whose full sets are compared at once (8 bytes each).
TILE = 1 << 19
#: Pairs of sketches that are compared at once.
PAIRS = 400_000
_HASH = WordHash()


def shingle_set(text: str | None, k: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles, A-Z lower-cased; fewer than k words make one shingle."""
    words = utf8(text).lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.array(words)
    return np.unique(window_hashes(h, min(k, len(h))))


def _multipliers(coords: int) -> np.ndarray:
    return np.random.default_rng(20240501).integers(0, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(s: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """For each coordinate, the minimum of one hash function over the set."""
    best = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(s), 4096):
        part = (s[i : i + 4096, None] * mult[None, :]) >> np.uint64(32)
        best = np.minimum(best, part.min(axis=0).astype(np.uint32))
    return best


def digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        pair = np.array([np.add.reduce(mix(s ^ np.uint64(0x5851F42D4C957F2D))), np.bitwise_xor.reduce(mix(s + np.uint64(0x14057B7EF767814F)))], np.uint64)
    return tuple(pair.view(np.int64).tolist())


def _signatures(k: int, coords: int):
    def run(batches):
        mult = _multipliers(coords)
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [shingle_set(t, k, _HASH) for t in b.column("text").to_pylist()]
                d1, d2 = zip(*map(digests, sets), strict=True)
                with np.errstate(over="ignore"):
                    flat = np.concatenate([sketch(mix(s), mult) for s in sets]).view(np.int32)
                sk = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, coords, dtype=np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), sk],
                    ["doc_id", "text_hash", "n_shingles", "d1", "d2", "sk"],
                )

    return run


def signatures(docs: DataFrame, k: int = 4, coords: int = COORDS) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_shingles, two digests of the set, and its sketch."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        _signatures(k, coords), "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sk array<int>"
    )


def _child(node, coord):
    """The node below `node` for the value at a coordinate."""
    return F.xxhash64(node, coord, F.get("sk", coord))


def _branch(rows: DataFrame, coords: int) -> DataFrame:
    """rep, node: children of each row's node, one coordinate by the node's hash, in a quarter of nodes a second one."""
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(coords)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(2)), F.lit(coords - 1)).cast("int"), F.lit(coords)).cast("int")
    two = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(4)) == 0
    kids = F.array(_child(F.col("node"), first), F.when(two, _child(F.col("node"), second)))
    return rows.select("rep", F.explode(kids).alias("node")).where("node is not null")


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of n items by the pairs (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _alike(threshold: float, coords: int):
    """From nodes with their members, groups of members whose sketches may reach the threshold, and the members' sizes."""
    # Sketches are compared by one byte of each coordinate, eight at once; what is padded always agrees.
    pad = -coords % 8
    least = pad + max(1, int(np.floor(coords * threshold - 5 * np.sqrt(coords * threshold * (1 - threshold)))))

    def groups(reps, sizes, sk, ends):
        """Groups among members; members are sorted by size within a node, and each may reach the threshold with those up to its end only."""
        n = len(reps)
        later = ends - np.arange(n) - 1
        upto = np.cumsum(later)
        root, at = np.arange(n), 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            own = later[at:end]
            i = np.repeat(np.arange(at, end), own)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
            equal = (sk[i] == sk[j]).view(np.uint64)
            agree = equal[:, 0].copy()
            for c in range(1, equal.shape[1]):
                agree += equal[:, c]
            ok = (agree * np.uint64(0x0101010101010101)) >> np.uint64(56) >= least
            if ok.any():
                root = _labels(n, np.concatenate([i[ok], np.arange(n)]), np.concatenate([j[ok], root]))
            at = end
        order = np.lexsort((reps, root))
        bounds = np.flatnonzero(np.diff(root[order], prepend=-1))
        return [part for part in np.split(order, bounds[1:]) if len(part) > 1]

    def run(batches):
        for batch in batches:
            nodes = batch.column(0)
            offsets = nodes.offsets.to_numpy().astype(np.int64)
            flat = nodes.values
            if offsets[-1] == offsets[0]:
                continue
            own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            part = slice(int(offsets[0]), int(offsets[-1]))
            offsets = offsets - offsets[0]
            sizes = flat.field(1).to_numpy()[part]
            order = np.lexsort((sizes, own))
            reps, sizes = flat.field(0).to_numpy()[part][order], sizes[order]
            sk = flat.field(2).flatten().to_numpy().reshape(-1, coords)[part][order].astype(np.uint8)
            sk = np.pad(sk, ((0, 0), (0, pad)))
            # Places behind the last member of the same node that is not too large.
            most = ((sizes + 1e-6) / threshold).astype(np.int64)
            span = int(most.max()) + 1
            ends = np.searchsorted(own * span + sizes, own * span + most, "right")
            upto = np.concatenate([[0], np.cumsum(ends - np.arange(len(ends)) - 1)])[offsets]
            found, start = [], 0
            while start < len(offsets) - 1:
                end = max(start + 1, int(np.searchsorted(upto, upto[start] + PAIRS, "right")) - 1)
                lo, hi = offsets[start], offsets[end]
                found += [lo + x for x in groups(reps[lo:hi], sizes[lo:hi], sk[lo:hi], ends[lo:hi] - lo)]
                start = end
            if found:
                lens, at = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), np.concatenate(found)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(lens, pa.array(x[at].astype(np.int64))) for x in (reps, sizes)], ["members", "sizes"])

    return run


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one sorted set with others."""
    part = np.concatenate(others)
    at = np.searchsorted(own, part)
    at[at == len(own)] = len(own) - 1
    hit = np.concatenate([[0], np.cumsum(own[at] == part)])
    ends = np.cumsum([len(o) for o in others])
    return np.diff(hit[np.concatenate([[0], ends])])


def _pairs_within(counts: np.ndarray, starts: np.ndarray):
    """Places (i, j), i before j, of all pairs within runs of `counts` places from `starts`, a bounded number at a time."""
    at = 0
    upto = np.cumsum(counts * (counts - 1) // 2)
    while at < len(counts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 4 * PAIRS, "right")))
        c, s = counts[at:end], starts[at:end]
        left = np.repeat(s, c) + np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        later = np.repeat(s + c, c) - left - 1
        i = np.repeat(left, later)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        at = end


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of any two sets: hashes of many sets by matrix products, those of few by their pairs."""
    n = len(sets)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    counts = np.diff(np.append(starts, len(flat)))
    out = np.zeros((n, n), np.float32)
    few = (counts > 1) & (counts <= max(8, n // 8))
    for i, j in _pairs_within(counts[few], starts[few]):
        out += np.bincount(owner[i] * n + owner[j], minlength=n * n).reshape(n, n)
    out = out + out.T
    many = np.flatnonzero(counts > max(8, n // 8))
    for k in range(0, len(many), 2048):
        own = many[k : k + 2048]
        places = np.repeat(starts[own], counts[own]) + np.arange(int(counts[own].sum())) - np.repeat(np.cumsum(counts[own]) - counts[own], counts[own])
        marks = np.zeros((n, len(own)), np.float32)
        marks[owner[places], np.repeat(np.arange(len(own)), counts[own])] = 1
        out += marks @ marks.T
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out.astype(np.int64)


def _across(reps, comps, sets, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the components of a group which have a pair at num/den or more between them."""
    sizes = np.array([len(s) for s in sets])
    inter = intersections(sets)
    i, j = np.nonzero(np.triu(inter * den >= num * (sizes[:, None] + sizes[None, :] - inter), 1))
    _, first, inv = np.unique(comps, return_index=True, return_inverse=True)
    root = _labels(len(sets), np.concatenate([i, np.arange(len(sets))]), np.concatenate([j, first[inv]]))
    moved = first[root[first] != first]
    return reps[moved], reps[root[moved]]


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            nodes = batch.column(0)
            offsets, flat = nodes.offsets.to_numpy(), nodes.values
            if not len(flat):
                continue
            reps, comps, sets = flat.field(0).to_numpy(), flat.field(1).to_numpy(), flat.field(2)
            a, b = [], []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if hi - lo > 1:
                    x, y = _across(reps[lo:hi], comps[lo:hi], [np.frombuffer(x, np.uint64) for x in sets.slice(lo, hi - lo).to_pylist()], num, den)
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _to_pivot(num: int, den: int):
    """From classes beside their pivots, links of those that reach num/den; rows of one pivot that follow each other are compared at once."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "shingles"):
                ids, pivots = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if not len(ids):
                    continue
                own, to = batch.column(2), batch.column(3)
                bounds = np.flatnonzero(np.concatenate([[True], pivots[1:] != pivots[:-1], [True]]))
                linked = []
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    sets = [np.frombuffer(x, np.uint64) for x in own.slice(lo, hi - lo).to_pylist()]
                    pivot = np.frombuffer(to[lo].as_py(), np.uint64)
                    inter = _shared(pivot, sets)
                    linked.append(inter * den >= num * (np.array([len(x) for x in sets]) + len(pivot) - inter))
                linked = np.concatenate(linked)
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(pivots[linked])], ["a", "b"])

    return run


def _open(tile: int, side: int):
    """From groups with their members, those in several components, in tiles in which each member outside the largest one meets all others.

    `rows` blocks of such members times `columns` blocks of all. A group within the bounds is one tile, so that its
    rows are its members; only large groups and those of very long texts have more.
    """

    def blocks(size, n):
        return max(-(-int(size) // tile), -(-n // side))

    def run(batches):
        for batch in batches:
            gids, lists = batch.column(0).to_numpy(), batch.column(1)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            reps, comps, sizes = (flat.field(k).to_numpy() for k in range(3))
            out = []
            for gid, lo, hi in zip(gids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                rep, comp, size = reps[lo:hi], comps[lo:hi], sizes[lo:hi]
                found, n = np.unique(comp, return_counts=True)
                if len(found) < 2:
                    continue
                outside = comp != found[np.argmax(n)]
                rows, columns = blocks(size[outside].sum(), int(outside.sum())), blocks(size.sum(), hi - lo)
                at, tiles = np.arange(hi - lo), np.zeros(hi - lo, np.int64)
                if columns > 1:
                    h = mix(rep.astype(np.uint64))
                    i, j = (h % np.uint64(rows)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(columns)).astype(np.int64)
                    down, along = np.repeat(at, rows), np.repeat(at[outside], columns)
                    both = np.stack([np.concatenate([down, along]), np.concatenate([np.tile(np.arange(rows), hi - lo) * columns + j[down], i[along] * columns + np.tile(np.arange(columns), int(outside.sum()))])])
                    at, tiles = np.unique(both, axis=1)
                out.append((np.full(len(at), gid), rep[at], comp[at], tiles))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["gid", "rep", "comp", "tile"])

    return run


def _sets(k: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [shingle_set(t, k, _HASH).tobytes() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sets, pa.binary())], ["rep", "shingles"])

    return run


def _tiles(many: str, leaf: int, side: int, everywhere: Column) -> Column:
    """Explodes members of nodes over `leaf` into square tiles of their node, so that any two members share a tile of at most twice `side`.

    A member for which `everywhere` holds joins every tile.
    """
    of = F.when(F.col(many) <= leaf, 1).otherwise(F.ceil(F.col(many) / side).cast("int"))
    own = F.pmod(F.xxhash64("rep", F.lit(11)), of).cast("int")
    upto = F.sequence(F.lit(0), of - 1)
    tiles = F.transform(upto, lambda j: F.least(j, own) * of + F.greatest(j, own))
    every = F.flatten(F.transform(upto, lambda i: F.transform(F.sequence(i, of - 1), lambda j: i * of + j)))
    return F.explode(F.when(everywhere, every).otherwise(tiles)).alias("tile")


def similar_groups(classes: DataFrame, threshold: float, trees: int = TREES, coords: int = COORDS, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """gid, members (array of rep) and their sizes: groups of classes whose sketches may reach the threshold.

    classes: rep, n_shingles, sk. A group has up to `leaf` members, or somewhat more by chance of hashing.
    """
    kids = []
    rng = np.random.default_rng(7)
    for t in range(trees):
        for c in rng.permutation(coords)[: 1 + (t % 4 == 0)]:
            kids.append(F.xxhash64(F.lit(t), F.lit(int(c)), F.get("sk", F.lit(int(c)))))
    thin = classes.select("rep", F.explode(F.array(*kids)).alias("node"))
    compare, side = _alike(threshold, coords), leaf // 2
    found, budget = None, 0
    for level in range(1, depth + 1):
        # A table of its own, so that a node with many rows is an ordinary skewed join.
        counts = cut(thin.groupBy("node").agg(F.count(F.lit(1)).alias("many"), F.min("rep").alias("low")).where("many > 1"), "counts")
        large = F.col("many") > leaf
        n = counts.agg(F.sum("many").alias("rows"), F.sum(F.when(large, F.col("many") * F.ceil(F.col("many") / side))).alias("tiled")).first()
        # Tiles give up branching, so they may make as many rows as the first level has.
        budget = budget or n.rows or 0
        last = n.tiled is None or level == depth or n.tiled <= budget
        kept = thin.join(counts.hint("merge"), "node")
        if n.tiled is None or not last:
            kept = kept.select("node", "rep", "many", F.lit(0).alias("tile"))
        else:
            # The node's smallest class joins every tile, as the pivot that its groups share.
            kept = kept.select("node", "rep", "many", _tiles("many", leaf, side, F.col("rep") == F.col("low")))
        kept = cut(kept.join(classes.hint("merge"), "rep"), "nodes")
        small = kept if last else kept.where(~large)
        lists = small.groupBy("node", "tile").agg(F.collect_list(F.struct("rep", "n_shingles", "sk")).alias("m")).select("m")
        groups = lists.mapInArrow(compare, "members array<long>, sizes array<long>")
        found = groups if found is None else found.union(groups)
        if last:
            break
        # Written, since both the counts and the join read it.
        thin = cut(_branch(kept.where(large), coords), "branches")
    return found.groupBy(F.xxhash64("members").alias("gid")).agg(F.first("members").alias("members"), F.first("sizes").alias("sizes"))


def pivot_links(groups: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: confirmed links of groups' members to two pivots, the smallest and the smallest by hash, which groups that overlap share."""
    by_hash = lambda seed: F.array_min(F.transform("members", lambda x: F.struct(F.xxhash64(x, F.lit(seed)).alias("h"), x.alias("x"))))["x"]
    pivots = F.array_distinct(F.array(F.get("members", F.lit(0)), by_hash(21)))
    pairs = groups.select("members", F.explode(pivots).alias("pivot")).select("pivot", F.explode("members").alias("rep")).where("rep <> pivot").distinct()
    # The pivots' sets are unique, so a pivot of many is an ordinary skewed join.
    both = pairs.join(sets.hint("merge"), "rep").join(sets.select(F.col("rep").alias("pivot"), F.col("shingles").alias("to")).hint("merge"), "pivot")
    return both.select("rep", "pivot", "shingles", "to").mapInArrow(_to_pivot(num, den), "a long, b long")


def _near_components(links: DataFrame) -> DataFrame:
    """id, component: the smallest linked id, and from there the smallest once more; ids of one component are connected, though not all connected ids share one."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")), "labels")
    return labels.join(labels.select(F.col("id").alias("c"), F.col("c").alias("component")).hint("merge"), "c").select("id", "component")


def minhash_components(docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, tile: int = TILE, side: int = SIDE, **params) -> DataFrame:
    """id, component of the classes (rep, low, text_hash, d1, d2, n_shingles, sk) that have a link at num/den or more.

    Groups are linked to pivots first; only groups that these links leave in several components are then
    compared in full, and of those only pairs across components.
    """
    groups = cut(similar_groups(classes.select("rep", "n_shingles", "sk"), num / den, **params), "groups")
    members = groups.select("gid", F.explode(F.arrays_zip("members", "sizes")).alias("m")).select("gid", F.col("m.members").alias("rep"), F.col("m.sizes").alias("size"))
    # One row of documents (or equal ones) for each class.
    wanted = cut(members.select("rep").distinct().join(classes.select("rep", F.col("low").alias("doc_id"), "text_hash").hint("merge"), "rep"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").join(wanted.hint("merge"), ["doc_id", "text_hash"])
    sets = texts.select("rep", "text").mapInArrow(_sets(k), "rep long, shingles binary")
    sets = cut(sets.dropDuplicates(["rep"]), "sets")
    links = cut(pivot_links(groups, sets, num, den), "links")
    placed = members.join(_near_components(links).withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    placed = placed.groupBy("gid").agg(F.collect_list(F.struct("rep", F.coalesce("component", "rep").alias("comp"), "size")).alias("m"))
    # Of a group in several components, every pair to compare has a member outside the largest one.
    tiles = placed.mapInArrow(_open(tile, side), "gid long, rep long, comp long, tile long")
    lists = tiles.join(sets.hint("merge"), "rep").groupBy("gid", "tile").agg(F.collect_list(F.struct("rep", "comp", "shingles")).alias("m")).select("m")
    return connected_components(links.union(lists.mapInArrow(_confirm(num, den), "a long, b long")))


def minhash_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, **params) -> DataFrame:
    """Near-duplicate components of documents by Jaccard similarity of k-word shingle sets.

    Returns one row per input row: doc_id, n_shingles, component_id, kept
    and text_hash, which tells rows of one doc_id apart. Texts that are null, empty or without a word have
    an empty set and link with nothing; fewer than k words make one shingle. A repeated row (same
    doc_id and text) is returned again with the same component. Rows of one doc_id with different texts are
    documents of their own and are linked by their sets alone. A null doc_id stays alone, with a null component_id, and is
    kept. Extra columns are ignored; an empty table gives an empty result.
    """
    sig = cut(signatures(docs, k), "signatures")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("sk").alias("sk"))
    # Numbers that hold once they are written; the smallest doc_id may belong to several classes.
    classes = cut(classes.select("d1", "d2", "n_shingles", F.col("first.doc_id").alias("low"), F.col("first.text_hash").alias("text_hash"), "sk", F.monotonically_increasing_id().alias("rep")), "classes")
    comp = minhash_components(docs, classes, k, num, den, **params)
    lowest = cut(comp.join(classes.select(F.col("rep").alias("id"), "low").hint("merge"), "id").groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    named = comp.select("id", "component").join(lowest.hint("merge"), "component").select(F.col("id").alias("rep"), "component_id")
    final = classes.select("d1", "d2", "n_shingles", "rep", "low").join(named.hint("merge"), "rep", "left").select("d1", "d2", "n_shingles", F.coalesce("component_id", "low").alias("component_id"))
    out = sig.select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(final.hint("merge"), ["d1", "d2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its set's size, its component by four-word shingles at Jaccard 0.8, and whether it is the component's smallest id."""
    return minhash_dedup(table(spark, sf_dir, "documents"), k=4, num=80, den=100).drop("text_hash")
