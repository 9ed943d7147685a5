"""Selections that go row after row: each pick depends on all before it.

Spark folds the rows first: of rows with equal features only as many as could be picked are
candidates, the first in the order that breaks ties. What remains is bounded by the kinds of
features, not by the rows. Few candidates are scored in one place; more stay in their
partitions, each of which offers its best one every round, so the driver sees offers alone.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuloom.operators.sampling import largest_remainder
from corpuloom.session import cut, ship

#: Candidates that are scored in one place.
HELD = 200_000
#: Fixed values of the published gains: a topic, a mixed parent, any rare family, each rare family, a sensitive record, many atoms, and the standing preferences for mixed parents and many atoms.
GAIN_TOPIC, GAIN_MIXED, GAIN_ANY_RARE, GAIN_RARE, GAIN_SAFETY, GAIN_ATOMS, LIKE_MIXED, LIKE_ATOMS = 8.0, 4.0, 3.0, 7.0, 5.0, 3.0, 0.25, 0.1
#: Fixed weights of the review fill's balance: topic, complexity, structure, signature, repaired.
BALANCE = {"topic": 4, "complexity": 3, "structure": 2, "signature": 1, "repaired": 1}

Arrays = dict[str, np.ndarray]


def folded(rows: DataFrame, features: list[str], order: list[str | Column], most: int) -> DataFrame:
    """Of rows with equal features the first `most`; a very common kind is cut down before it is shuffled."""
    place = F.row_number().over(Window.partitionBy(*features).orderBy(*order))
    return rows.withColumn("place_", place).where(F.col("place_") <= most).drop("place_")


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(operator.and_, conditions)


def _best(arrays: Arrays, scores: np.ndarray, largest: bool) -> int | None:
    """The row of the highest score, ties by column tie; None where no row is allowed."""
    top = scores.max(initial=-np.inf)
    if top == -np.inf:
        return None
    rows = np.flatnonzero(scores == top)
    return int((max if largest else min)(rows, key=lambda i: arrays["tie"][i]))


def picks(candidates: DataFrame, many: int, score: Callable[[dict, Arrays], np.ndarray], update: Callable[[dict, dict], None], state: dict, largest: bool = False, held: int = HELD) -> Iterator[dict]:
    """Up to `many` candidates, one after another, each of the highest score in the state that those before it left.

    candidates: id, tie (which breaks ties: the smallest, or the largest) and features. score gives -inf to rows
    that are not allowed; update changes the state by the row picked. Results are the same for any partitions.
    """
    if candidates.count() <= held:
        pdf = candidates.toPandas()
        arrays = {c: pdf[c].to_numpy() for c in pdf}
        open_ = np.ones(len(pdf), bool)
        for _ in range(many):
            at = _best(arrays, np.where(open_, score(state, arrays), -np.inf), largest) if len(pdf) else None
            if at is None:
                return
            open_[at] = False
            row = {c: v[at] for c, v in arrays.items()}
            update(state, row)
            yield row
        return
    ship(candidates.sparkSession)
    parts, taken = cut(candidates, "candidates"), set()
    for _ in range(many):

        def offer(batches, state=state, taken=frozenset(taken)):
            best, score_of = None, -np.inf
            for pdf in batches:
                arrays = {c: pdf[c].to_numpy() for c in pdf}
                scores = np.where(pdf["id"].isin(taken), -np.inf, score(state, arrays)) if len(pdf) else np.empty(0)
                at = _best(arrays, scores, largest)
                if at is not None and (best is None or scores[at] > score_of or scores[at] == score_of and (pdf["tie"].iloc[at] > best["tie"].iloc[0]) == largest):
                    best, score_of = pdf.iloc[[at]], scores[at]
            if best is not None:
                yield best.assign(score_=score_of)

        offers = parts.mapInPandas(offer, f"{parts._jdf.schema().toDDL()}, score_ double").toPandas()
        arrays = {c: offers[c].to_numpy() for c in offers}
        at = _best(arrays, arrays["score_"], largest) if len(offers) else None
        if at is None:
            return
        row = {c: v[at] for c, v in arrays.items() if c != "score_"}
        taken.add(row["id"])
        update(state, row)
        yield row


def margin(rows: DataFrame, column: str, total: int) -> dict[str, int]:
    """`total` places over the values of a label column by largest remainder."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return {r[column]: r.quota for r in largest_remainder(counts, total, [column]).collect()}


def cell_quotas(rows: DataFrame, margins: dict[str, dict[str, int]], spare_share: bool = False) -> DataFrame:
    """The margins' columns, n and quota: how many rows each cell of a cross table gives, so that every margin is met exactly.

    Place after place goes to the cell whose values lack the largest shares of their targets, with a little for
    spare rows, ties to the last cell by its columns from the last. Cells are at most the margins' values
    multiplied. spare_share: spare rows count by their share of all rows of the cells, instead of up to a thousand of them in millionths. ValueError where the margins don't agree, or can't be met this way.
    """
    columns, total = list(margins), sum(next(iter(margins.values())).values())
    if any(sum(m.values()) != total for m in margins.values()):
        raise ValueError("margins must have the same sum")
    known = rows.where(_all(F.col(c).isin(*m) for c, m in margins.items()))
    whole = rows.count() if spare_share else 0
    cells = sorted(known.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: tuple(r[c] for c in reversed(columns)))
    n = np.array([r.n for r in cells], np.int64)
    at, left, want = [], [], []
    for c, m in margins.items():
        values = sorted(m)
        at.append(np.array([values.index(r[c]) for r in cells], np.int64))
        want.append(np.array([m[v] for v in values], np.int64))
        left.append(want[-1].copy())
    quota = np.zeros(len(cells), np.int64)
    for _ in range(total):
        lacking = [m[i] for m, i in zip(left, at, strict=True)]
        score = lacking[0] / np.maximum(want[0][at[0]], 1)
        for k in range(1, len(columns)):
            score = score + lacking[k] / np.maximum(want[k][at[k]], 1)
        score = score + ((n - quota) / max(whole, 1) if spare_share else np.minimum(n - quota, 1000) / 1_000_000)
        score[(quota >= n) | (np.min(lacking, axis=0) <= 0)] = -np.inf
        if not len(score) or score.max() == -np.inf:
            raise ValueError(f"margins can't be met: {int(quota.sum())} of {total} places are taken")
        best = int(np.flatnonzero(score == score.max())[-1])
        quota[best] += 1
        for m, i in zip(left, at, strict=True):
            m[i[best]] -= 1
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.sparkSession.createDataFrame([(*(r[c] for c in columns), r.n, int(q)) for r, q in zip(cells, quota, strict=True)], f"{kinds}, n long, quota long")


def _placed(rows: DataFrame, chosen: list, seed: int | str) -> DataFrame:
    """The rows chosen, with pick, their number in the order of picking, and place, that in hash order."""
    kind = rows.schema["id"].dataType.simpleString()
    own = rows.sparkSession.createDataFrame([(r["id"] if isinstance(r["id"], str) else int(r["id"]), i + 1) for i, r in enumerate(chosen)], f"id_ {kind}, pick long")
    # As many rows as were asked for.
    out = rows.join(F.broadcast(own), F.col("id") == F.col("id_")).drop("id_")
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), "id"), 256)
    return out.withColumn("place", F.row_number().over(Window.orderBy(hashed, "id")).cast("long"))


def representative(rows: DataFrame, cells: dict[tuple, int], columns: list[str], counts: list[list[str]], flag: str, seed: int | str, held: int = HELD) -> DataFrame:
    """Rows that together come close to the population: as many of each cell as its quota says, pick and place.

    rows: id (unique), the cells' columns, groups of count columns (labels, types) and a boolean. Cells are filled in
    their order; a pick makes the sum of distances between the shares of each group, and of the flag, and
    those of all rows smallest; ties go to the smallest hash of seed and id. Null counts are 0, a null flag is false.
    """
    flat = [c for group in counts for c in group]
    rows = rows.withColumns({**{c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in flat}, flag: F.coalesce(F.col(flag), F.lit(False))})
    total = rows.agg(*[F.sum(c).alias(c) for c in flat], F.sum(F.col(flag).cast("long")).alias("flag_"), F.count(F.lit(1)).alias("rows_")).first()
    target = [[(total[c] or 0) / (sum(total[x] or 0 for x in group) or 1) for c in group] for group in counts]
    share = (total["flag_"] or 0) / max(1, total["rows_"])
    plan = [cell for cell in sorted(cells) for _ in range(cells[cell])]
    used = rows.where(reduce(operator.or_, (_all(F.col(c) == v for c, v in zip(columns, cell, strict=True)) for cell in sorted(set(plan))))) if plan else rows.limit(0)
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), "id"), 256)
    candidates = folded(used.select("id", *columns, *flat, flag, hashed.alias("tie")), [*columns, *flat, flag], ["tie"], max(cells.values(), default=0))

    def score(state: dict, a: Arrays) -> np.ndarray:
        loss = None
        for group, have, goal in zip(counts, state["have"], target, strict=True):
            own = [a[c] for c in group]
            whole = np.maximum(sum(have) + sum(own), 1)
            part = sum(np.abs((h + o) / whole - g) for h, o, g in zip(have, own, goal, strict=True))
            loss = part if loss is None else loss + part
        loss = loss + np.abs((state["flag"] + a[flag].astype(np.int64)) / (state["n"] + 1) - share)
        here = np.ones(len(loss), bool)
        for c, v in zip(columns, plan[state["n"]], strict=True):
            here &= a[c] == v
        return np.where(here, -loss, -np.inf)

    def update(state: dict, row: dict) -> None:
        for group, have in zip(counts, state["have"], strict=True):
            for i, c in enumerate(group):
                have[i] += int(row[c])
        state["flag"] += int(row[flag])
        state["n"] += 1

    chosen = list(picks(candidates, len(plan), score, update, {"have": [[0] * len(g) for g in counts], "flag": 0, "n": 0}, held=held))
    if len(chosen) < len(plan):
        raise ValueError("a cell has fewer rows than its quota")
    return _placed(rows, chosen, seed)


def diagnostic(rows: DataFrame, sources: dict[str, int], families: list[str], minima: dict[str, int], threshold: int | None, seed: int | str, held: int = HELD) -> DataFrame:
    """Rows that reach minima of rare features within quotas of their sources, pick and place.

    rows: id, source, topic, mixed and safety (boolean), atoms, and for each family a column of counts. Many atoms are
    `threshold` or more, by default the nearest-rank third quartile. minima: topic, mixed, each_rare, any_rare,
    safety, many_atoms. A pick has the largest gain, ties go to the largest hash of seed and id.
    ValueError names the minima that are not reached, or says that a source has too few rows.
    """
    many, size = minima, sum(sources.values())
    if threshold is None:
        by_size = rows.groupBy("atoms").agg(F.count(F.lit(1)).alias("n"))
        upto = by_size.withColumn("upto", F.sum("n").over(Window.orderBy("atoms"))).withColumn("all_", F.sum("n").over(Window.partitionBy()))
        threshold = int(upto.where(F.col("upto") >= F.ceil(0.75 * F.col("all_"))).agg(F.min("atoms")).first()[0] or 0)
    flags = {"mixed_": F.col("mixed"), "safety_": F.col("safety"), "big_": F.col("atoms") >= threshold, **{f"f{i}_": F.col(c) > 0 for i, c in enumerate(families)}}
    flags = {k: F.coalesce(c, F.lit(False)) for k, c in flags.items()}
    marks = list(flags)
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), "id"), 256)
    used = rows.where(F.col("source").isin(*sources)).select("id", "source", "topic", *[c.alias(k) for k, c in flags.items()], hashed.alias("tie"))
    candidates = folded(used, ["source", "topic", *marks], [F.desc("tie")], size)
    state = {"source": dict.fromkeys(sources, 0), "topic": {}, "mixed_": 0, "safety_": 0, "big_": 0, "any": 0, "n": 0, **{f"f{i}_": 0 for i in range(len(families))}}

    def score(state: dict, a: Arrays) -> np.ndarray:
        own = {k: a[k].astype(bool) for k in marks}
        rare = [own[f"f{i}_"] for i in range(len(families))]
        any_ = np.logical_or.reduce(rare) if rare else np.zeros(len(a["id"]), bool)
        counts = pd.Series(a["topic"]).map(lambda t: state["topic"].get(t, 0)).to_numpy()
        value = np.where(counts < many["topic"], GAIN_TOPIC, 0.0)
        value = value + np.where(own["mixed_"] & (state["mixed_"] < many["mixed"]), GAIN_MIXED, 0.0)
        value = value + np.where(any_ & (state["any"] < many["any_rare"]), GAIN_ANY_RARE, 0.0)
        for i, r in enumerate(rare):
            value = value + np.where(r & (state[f"f{i}_"] < many["each_rare"]), GAIN_RARE, 0.0)
        value = value + np.where(own["safety_"] & (state["safety_"] < many["safety"]), GAIN_SAFETY, 0.0)
        value = value + np.where(own["big_"] & (state["big_"] < many["many_atoms"]), GAIN_ATOMS, 0.0)
        value = value + (LIKE_MIXED * own["mixed_"] + LIKE_ATOMS * own["big_"])
        lack = {s: q - state["source"][s] for s, q in sources.items()}
        value = value + pd.Series(a["source"]).map({s: lack[s] / max(q, 1) for s, q in sources.items()}).to_numpy()
        return np.where(pd.Series(a["source"]).map(lack).to_numpy() > 0, value, -np.inf)

    def update(state: dict, row: dict) -> None:
        state["n"] += 1
        state["source"][row["source"]] += 1
        state["topic"][row["topic"]] = state["topic"].get(row["topic"], 0) + 1
        for k in marks:
            state[k] += int(row[k])
        state["any"] += int(any(row[f"f{i}_"] for i in range(len(families))))

    chosen = list(picks(candidates, size, score, update, state, largest=True, held=held))
    if len(chosen) < size:
        raise ValueError("a source has fewer rows than its quota")
    reached = {"topic": min(state["topic"].values(), default=0), "mixed": state["mixed_"], "any_rare": state["any"], "safety": state["safety_"], "many_atoms": state["big_"]}
    unmet = [k for k, v in reached.items() if v < many[k]] + [f"each_rare:{f}" for i, f in enumerate(families) if state[f"f{i}_"] < many["each_rare"]]
    if unmet:
        raise ValueError(f"minima not reached: {', '.join(unmet)}")
    return _placed(rows, chosen, seed)


def coverage(rows: DataFrame, features: str, prefer: list[str], limit: int, held: int = HELD) -> DataFrame:
    """id, pick, gain: `limit` rows, each with the most features (an array of labels) that no row before it has; ties to larger `prefer` columns, then the smaller id.

    Once all is covered, picks go by `prefer` and id alone. Repeated features count once, null ones not at all.
    """
    known = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(F.col(features), F.array().cast("array<string>"))))).alias("features")
    tie = F.struct(*[-F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in prefer], F.col("id")).alias("order_")
    used = folded(rows.select("id", known, tie), ["features"], ["order_"], limit)
    names = [r[0] for r in used.select(F.explode("features")).distinct().orderBy("col").collect()]  # labels
    mark = F.array_join(F.transform(F.array(*map(F.lit, names)), lambda n: F.when(F.array_contains("features", n), "1").otherwise("0")), "") if names else F.lit("")
    # Order among equal gains as a number: the place of the preference among the candidates.
    placed = used.withColumn("tie", F.row_number().over(Window.orderBy("order_"))).select("id", mark.alias("bits"), "tie")

    def score(state: dict, a: Arrays) -> np.ndarray:
        bits = np.frombuffer("".join(a["bits"]).encode(), np.uint8).reshape(len(a["bits"]), -1) == ord("1") if names else np.zeros((len(a["id"]), 0), bool)
        return (bits & ~state["covered"]).sum(axis=1).astype(float)

    def update(state: dict, row: dict) -> None:
        own = np.array([b == "1" for b in row["bits"]], bool)
        state["gains"].append(int((own & ~state["covered"]).sum()))
        state["covered"] = state["covered"] | own

    state = {"covered": np.zeros(len(names), bool), "gains": []}
    chosen = list(picks(placed, limit, score, update, state, held=held))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(r["id"] if isinstance(r["id"], str) else int(r["id"]), i + 1, g) for i, (r, g) in enumerate(zip(chosen, state["gains"], strict=True))], f"id {kind}, pick long, gain long")


def review_fill(rows: DataFrame, mandatory: str, fill: int, seed: int | str, balance: dict[str, int] = BALANCE, held: int = HELD) -> DataFrame:
    """id, pick: all mandatory rows (pick null), and `fill` others that balance the feature columns.

    A pick has the smallest weighted number of rows so far, mandatory ones included, that share its values; ties go to
    the smallest hash of seed and id. ValueError where there are fewer other rows than are to be filled.
    """
    must = F.coalesce(F.col(mandatory), F.lit(False))
    shown = rows.select("id", must.alias("must_"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in balance])
    state: dict = {c: {} for c in balance}
    for r in shown.where("must_").groupBy(*balance).agg(F.count(F.lit(1)).alias("n_")).collect():  # kinds of features
        for c in balance:
            state[c][r[c]] = state[c].get(r[c], 0) + r["n_"]
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), "id"), 256)
    candidates = folded(shown.where("not must_").select("id", *balance, hashed.alias("tie")), list(balance), ["tie"], fill)

    def score(state: dict, a: Arrays) -> np.ndarray:
        return -sum(w * pd.Series(a[c]).map(lambda v, c=c: state[c].get(v, 0)).to_numpy().astype(float) for c, w in balance.items())

    def update(state: dict, row: dict) -> None:
        for c in balance:
            state[c][row[c]] = state[c].get(row[c], 0) + 1

    chosen = list(picks(candidates, fill, score, update, state, held=held))
    if len(chosen) < fill:
        raise ValueError("fewer rows than are to be filled")
    kind = rows.schema["id"].dataType.simpleString()
    filled = rows.sparkSession.createDataFrame([(r["id"] if isinstance(r["id"], str) else int(r["id"]), i + 1) for i, r in enumerate(chosen)], f"id {kind}, pick long")
    return shown.where("must_").select("id", F.lit(None).cast("long").alias("pick")).unionByName(filled)
