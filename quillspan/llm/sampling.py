"""A sample whose category shares follow given targets on several axes at once.

Inclusion probabilities come from raking the counts of the category combinations; rows are drawn by systematic
unequal-probability sampling: in random order within sorted combinations, the probabilities are summed up across
partitions and the rows at the integer crossings from one random start are taken.  Floors are repaired afterwards by
exchanging rows, so that the size of the sample stays.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.shared import written

#: Rows that one task orders at random; larger combinations are cut by ranges of the random number.
BLOCK_ROWS = 50_000

#: Blocks whose rows are summed up together, and those sums after them, so that no task orders all blocks of a combination.
GROUP_BLOCKS = 1024

#: Steps in which rows too many or too few are exchanged, each of the part that is left.
STEPS = 50

#: Combinations up to which what is known of each is broadcast (about 60 bytes each).
SENT_COMBINATIONS = 500_000


def label_key(label: Column) -> Column:
    """What labels share that differ only in letter case, outer blanks or the sign between words."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}_\-]+", " ")


@dataclass
class Draw:
    """``sample``: (id) of the drawn rows; ``report``: one row for each target category."""

    sample: DataFrame
    report: DataFrame


def _share_out(size: float, pct: np.ndarray, floor: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Rows wanted of each category: its share of ``size``, at least its floor, at most what there is.

    What short categories leave goes to the others in proportion; what floors take comes from the others.
    """
    low, high = 0.0, float(size) * 1e6
    for _ in range(200):  # the share of a percentage point at which the sum is right
        middle = (low + high) / 2
        if np.minimum(have, np.maximum(floor, pct * middle)).sum() > size:
            high = middle
        else:
            low = middle
    return np.minimum(have, np.maximum(floor, pct * low))


def _rake(counts: np.ndarray, codes: np.ndarray, size: int, pct: list[np.ndarray], floor: list[np.ndarray], have: list[np.ndarray], rounds: int = 60) -> np.ndarray:
    """A probability for each combination so that each axis comes as near to its wanted totals as it can.

    The chance of a combination is the product of one factor for each axis, at most 1; the factors of an axis are found by
    bisection, one axis after the other, until they stay.  Rows without a category have the factor 1.
    """
    start = np.log(size / counts.sum())
    factors = [np.zeros(len(p) + 1) for p in pct]
    chance = np.minimum(1.0, np.exp(np.full(len(counts), start)))
    for _ in range(rounds):
        before = chance
        for axis, shares in enumerate(pct):
            code, none = codes[:, axis], len(shares)
            rest = start + sum(f[codes[:, k]] for k, f in enumerate(factors) if k != axis)
            uncategorised = (counts * np.minimum(1.0, np.exp(rest)))[code == none].sum()
            want = _share_out(max(0.0, size - uncategorised), shares, floor[axis], have[axis])
            low, high = np.full(none + 1, -40.0), np.full(none + 1, 40.0)
            for _ in range(50):
                middle = (low + high) / 2
                got = np.bincount(code, counts * np.minimum(1.0, np.exp(np.minimum(rest + middle[code], 0.0))), none + 1)
                more = np.append(got[:-1] < want, False)
                low, high = np.where(more, middle, low), np.where(more, high, middle)
            factors[axis] = np.append(np.clip((low + high) / 2, -40, 40)[:-1], 0.0)
        chance = np.exp(np.minimum(start + sum(f[codes[:, k]] for k, f in enumerate(factors)), 0.0))
        if np.abs(chance - before).max() < 1e-7:
            break
    return chance


def _exchange(drawn: np.ndarray, counts: np.ndarray, codes: np.ndarray, size: int, floor: list[np.ndarray], want: list[np.ndarray]) -> np.ndarray:
    """How many rows of each combination to take so that every category keeps its floor and ``size`` rows are taken in all.

    What floors lack is added from the combinations whose other categories are furthest below what is wanted of them; as many
    rows are given back by combinations whose categories all are above their floors, first where most is over.  If the floors
    together need more than ``size`` rows the sample is larger.
    """
    out = drawn.copy()
    axes = range(len(floor))

    def over(limits: list[np.ndarray]) -> list[np.ndarray]:
        return [np.append(np.bincount(codes[:, k], out, len(limits[k]) + 1)[:-1] - limits[k], np.inf) for k in axes]

    def excess(limits: list[np.ndarray]) -> np.ndarray:
        """Of each combination, how much its categories are over their limits in all, against the limits."""
        return sum((np.append(x[:-1] / np.maximum(1.0, limits[k]), 0.0))[codes[:, k]] for k, x in enumerate(over(limits)))

    for k in axes:
        for c in np.flatnonzero(over(floor)[k][:-1] < 0).tolist():
            lacking = int(-over(floor)[k][c])
            cells = np.flatnonzero((codes[:, k] == c) & (out < counts))
            for i in cells[np.argsort(excess(want)[cells], kind="stable")].tolist():
                added = int(min(lacking, counts[i] - out[i]))
                out[i] += added
                lacking -= added
                if not lacking:
                    break
    while out.sum() > size:
        spare = np.minimum.reduce([out, *[x[codes[:, k]] for k, x in enumerate(over(floor))]]) if len(floor) else out
        cells = np.flatnonzero(spare >= 1)
        if not len(cells):
            break
        i = cells[np.argmax(excess(want)[cells])]
        out[i] -= int(min(spare[i], -(-(out.sum() - size) // STEPS)))
    while out.sum() < min(size, counts.sum()):
        cells = np.flatnonzero(out < counts)
        i = cells[np.argmin(excess(want)[cells])]
        out[i] += int(min(counts[i] - out[i], -(-(size - out.sum()) // STEPS)))
    return out


def draw_by_shares(rows: DataFrame, targets: DataFrame, axes: dict[str, Column], *, id: str = "rec_id", share: float = 0.25, seed: int = 7) -> Draw:
    """Draw ``share`` of ``rows`` (rounded down) so that the categories of each axis follow ``targets``.

    ``targets`` (axis, category, target_pct, min_rows) is small by nature; its percentages add up to 100 an axis.  ``axes``
    gives the label column of each axis.  Labels that differ only in letter case, outer blanks or the sign between
    words are one category; NULL and labels without a target belong to none and are drawn only as far as the targets of
    other axes need them.  The quota of a category is the larger of ``min_rows`` and its share of the sample rounded
    up; where the pool has fewer rows than that, all are wanted and the rest of the axis is shared out among
    the other categories.  Categories below ``min_rows`` after the draw get rows from the pool in exchange for rows of categories
    that are above theirs, so the sample has the stated size unless the floors alone need more.  A row with a repeated id counts
    as a row of its own for the counts; ties in the random order are broken by id.  Empty pools give an empty sample
    and a report whose categories have no row.  The driver holds the combinations of categories that occur, which the targets bound.

    The report holds axis, category, target_pct, quota, available, drawn, reachable (available >= quota) and met (drawn >= quota).
    """
    spark = rows.sparkSession
    names = [r[0] for r in targets.select("axis").distinct().orderBy("axis").collect() if r[0] in axes]
    goal = targets.where(F.col("axis").isin(names)).select("axis", "category", "target_pct", "min_rows", label_key(F.col("category")).alias("label"))
    listed = goal.orderBy("axis", "category").collect()
    code = {(r["axis"], r["label"]): i for i, r in enumerate(listed)}
    of_axis = {a: [i for i, r in enumerate(listed) if r["axis"] == a] for a in names}

    # one small map from label to category number, -1 for none
    def coded(axis: str) -> Column:
        known = {label: i for (a, label), i in code.items() if a == axis}
        literal = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        return F.coalesce(F.try_element_at(literal, label_key(axes[axis])), F.lit(-1))

    pool = written(rows.select(F.col(id).alias("id"), *[coded(a).alias(f"c{k}") for k, a in enumerate(names)]), "pool")
    columns = [f"c{k}" for k in range(len(names))]
    cells = pool.groupBy(*columns).agg(F.count("*").alias("n")).toPandas().sort_values(columns, ignore_index=True) if columns else pd.DataFrame({"n": [pool.count()]})
    counts = cells["n"].to_numpy(dtype=float)
    size = int(counts.sum() * share)
    available = np.zeros(len(listed), dtype=int)
    local = np.zeros((len(cells), len(names)), dtype=int)
    for k, a in enumerate(names):
        index = np.full(len(listed) + 1, len(of_axis[a]))
        index[of_axis[a]] = np.arange(len(of_axis[a]))
        local[:, k] = index[cells[f"c{k}"].to_numpy()]
        available[of_axis[a]] = np.bincount(local[:, k], counts, len(of_axis[a]) + 1)[:-1]
    quota = [max(int(r["min_rows"]), -(-int(r["target_pct"]) * size // 100)) for r in listed]
    pct = [np.array([float(listed[c]["target_pct"]) for c in of_axis[a]]) for a in names]
    have = [available[of_axis[a]].astype(float) for a in names]
    floor = [np.minimum(h, [float(listed[c]["min_rows"]) for c in of_axis[a]]) for a, h in zip(names, have, strict=True)]
    chance = _rake(counts, local, size, pct, floor, have) if size else np.zeros(len(cells))

    # blocks: combinations in order, each cut by ranges of the random number; chances are summed up over combinations by the
    # driver, and the rows of earlier blocks of a combination in two steps
    cells["chance"], cells["cuts"] = chance, np.maximum(1, -(-cells["n"].to_numpy() // BLOCK_ROWS)).astype(np.int64)
    cells["ahead"] = np.cumsum(counts * chance) - counts * chance
    cells["cell"] = np.arange(len(cells), dtype=np.int64)
    types = ", ".join([*(f"{x} int" for x in columns), "cell long, chance double, cuts long, ahead double"])
    plan = spark.createDataFrame(cells[[*columns, "cell", "chance", "cuts", "ahead"]], types) if len(cells) else spark.createDataFrame([], types)
    plan = F.broadcast(plan) if len(cells) <= SENT_COMBINATIONS else plan
    unit = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11) / F.lit(float(2**53))
    placed = (pool.join(plan, columns) if columns else pool.crossJoin(plan)).withColumn("unit", unit).withColumn("cut", F.least(F.floor(F.col("unit") * F.col("cuts")), F.col("cuts") - 1))
    sums = written(placed.groupBy("cell", "cut").agg(F.count("*").alias("rows")).withColumn("group", F.floor(F.col("cut") / GROUP_BLOCKS)), "blocks")
    earlier = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("cell", "group").agg(F.sum("rows").alias("rows")).select("cell", "group", F.coalesce(F.sum("rows").over(earlier(["cell"], "group")), F.lit(0)).alias("of_groups"))
    within = sums.select("cell", "group", "cut", F.coalesce(F.sum("rows").over(earlier(["cell", "group"], "cut")), F.lit(0)).alias("of_blocks"))
    before = within.join(groups, ["cell", "group"]).select("cell", "cut", (F.col("of_groups") + F.col("of_blocks")).alias("before"))
    start = random.Random(seed).random()
    rank = F.row_number().over(Window.partitionBy("cell", "cut").orderBy("unit", "id"))
    reach = F.col("ahead") + F.col("chance") * (F.col("before") + F.col("rank")) + F.lit(start)
    crossed = F.floor(reach + 1e-9) > F.floor(reach - F.col("chance") + 1e-9)
    drawn = written(placed.join(before, ["cell", "cut"]).withColumn("rank", rank).withColumn("taken", crossed).select("id", "unit", "cell", "rank", "taken"), "drawn")

    # floors: combinations that give and take rows, the nearest to the edge of the random order
    first = np.zeros(len(cells))
    for r in drawn.where("taken").groupBy("cell").agg(F.count("*").alias("n")).collect():
        first[r["cell"]] = r["n"]
    want = [_share_out(float(size), p, f, h) for p, f, h in zip(pct, floor, have, strict=True)]
    final = _exchange(first, counts, local, size, floor, want)
    taken = drawn.where("taken")
    if (final != first).any():
        changed = np.flatnonzero(final != first)
        moves = F.broadcast(spark.createDataFrame([(int(i), int(final[i] - first[i])) for i in changed], "cell long, move long"))  # a part of the plan
        moved = drawn.join(moves, "cell").where(F.col("taken") == (F.col("move") < 0))
        order = F.row_number().over(Window.partitionBy("cell").orderBy("unit", "id", "rank"))
        moved = written(moved.withColumn("nth", order).where(F.col("nth") <= int(np.abs(final - first).max())).where(F.col("nth") <= F.abs("move")).drop("nth"), "moved")
        gone = moved.where("taken").groupBy("cell").agg(F.max(F.struct("unit", "id", "rank")).alias("edge"))
        kept = taken.join(F.broadcast(gone), "cell", "left").where(F.col("edge").isNull() | (F.struct("unit", "id", "rank") > F.col("edge"))).select("id")
        taken = kept.unionByName(moved.where("not taken").select("id"))
    amount = np.zeros(len(listed), dtype=int)
    for k, a in enumerate(names):
        amount[of_axis[a]] = np.bincount(local[:, k], final, len(of_axis[a]) + 1)[:-1]
    report = [(r["axis"], r["category"], int(r["target_pct"]), quota[c], int(available[c]), int(amount[c]), bool(available[c] >= quota[c]), bool(amount[c] >= quota[c])) for c, r in enumerate(listed)]
    schema = "axis string, category string, target_pct int, quota long, available long, drawn long, reachable boolean, met boolean"
    return Draw(taken.select(F.col("id").alias(id)), spark.createDataFrame(report, schema))
