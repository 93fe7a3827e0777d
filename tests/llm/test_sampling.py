import numpy as np
from pyspark.sql import functions as F

from quillspan.llm.sampling import _exchange, draw_by_shares

TARGETS = [("k", "a b", 50, 2), ("k", "c", 40, 2), ("k", "rare", 10, 5), ("s", "x", 70, 1), ("s", "y", 30, 1)]
SCHEMA = "axis string, category string, target_pct int, min_rows int"


def axes(*names):
    return {x: F.col(x) for x in names}


def test_shares(spark):
    k = F.when(F.col("id") < 3, "RARE ").when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, "A_b").when(F.col("id") % 3 == 1, " a-B").otherwise("C")
    rows = spark.range(4000).select(F.col("id").alias("rec_id"), k.alias("k"), F.when(F.col("id") % 4 == 0, "X").otherwise("y").alias("s"))
    targets = spark.createDataFrame(TARGETS, SCHEMA)
    draw = draw_by_shares(rows, targets, axes("k", "s"))
    report = {(r.axis, r.category): r for r in draw.report.collect()}
    size = draw.sample.count()
    assert size == 1000 and draw.sample.distinct().count() == size
    assert not report["k", "rare"].reachable and report["k", "rare"].available == 3 and report["k", "rare"].drawn == 3
    assert report["k", "rare"].quota == 100 and report["k", "a b"].quota == 500
    assert abs(report["s", "x"].drawn - 700) <= 10 and abs(report["s", "y"].drawn - 300) <= 10
    assert abs(report["k", "a b"].drawn / report["k", "c"].drawn - 50 / 40) < 0.06
    assert {r.rec_id for r in draw.sample.collect()} == {r.rec_id for r in draw_by_shares(rows.repartition(7), targets, axes("k", "s")).sample.collect()}


def test_floor_and_empty(spark):
    targets = spark.createDataFrame([("k", "big", 99, 1), ("k", "small", 1, 4)], SCHEMA)
    rows = spark.range(80).select(F.col("id").alias("rec_id"), F.when(F.col("id") < 6, "small").otherwise("big").alias("k"), F.lit(1).alias("unit"))
    draw = draw_by_shares(rows, targets, {"k": F.col("k")})
    report = {r.category: r for r in draw.report.collect()}
    # the floor is kept in exchange for other rows
    assert report["small"].drawn == 4 and report["small"].met and report["big"].drawn == 16 and not report["big"].met and report["big"].reachable
    assert draw.sample.count() == draw.sample.distinct().count() == 20
    kinds = {r.rec_id: r.k for r in rows.collect()}
    assert sum(kinds[r.rec_id] == "small" for r in draw.sample.collect()) == 4
    repeated = draw_by_shares(rows.union(rows).union(rows), targets, {"k": F.col("k")})
    assert repeated.sample.count() == 60 and {r.category: r.drawn for r in repeated.report.collect()}["small"] >= 4
    empty = draw_by_shares(rows.limit(0), targets, {"k": F.col("k")})
    assert empty.sample.count() == 0 and [r.available for r in empty.report.collect()] == [0, 0]
    none = draw_by_shares(rows.withColumn("k", F.lit(None).cast("string")), targets, {"k": F.col("k")})
    assert {r.available for r in none.report.collect()} == {0}


def test_exchange_keeps_floors_and_size():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(3, 25))
        counts = rng.integers(1, 40, n).astype(float)
        codes = np.stack([rng.integers(0, 4, n), rng.integers(0, 3, n)], axis=1)
        have = [np.bincount(codes[:, k], counts, m + 1)[:-1] for k, m in enumerate((3, 2))]
        size = int(counts.sum() * 0.4)
        floor = [np.minimum(h, rng.integers(0, 5, len(h))) for h in have]
        first = np.minimum(counts, rng.multinomial(size, counts / counts.sum())).astype(float)
        final = _exchange(first, counts, codes, size, floor, [h * 0.4 for h in have])
        got = [np.bincount(codes[:, k], final, m + 1)[:-1] for k, m in enumerate((3, 2))]
        assert (final >= 0).all() and (final <= counts).all() and all((g >= f).all() for g, f in zip(got, floor, strict=True))
        assert final.sum() == size or final.sum() > size and sum(f.sum() for f in floor) > 0


def test_many_combinations_and_blocks(spark, monkeypatch):
    """More combinations than rows, and combinations cut into several groups of blocks."""
    import quillspan.llm.sampling as module

    monkeypatch.setattr(module, "BLOCK_ROWS", 50)
    monkeypatch.setattr(module, "GROUP_BLOCKS", 3)
    monkeypatch.setattr(module, "SENT_COMBINATIONS", 2)
    names = ("p", "q", "r")
    targets = spark.createDataFrame([(a, f"{a}{i}", 50 if i < 2 else 0, 0) for a in names for i in range(150)], SCHEMA)
    rows = spark.range(3000).select(F.col("id").alias("rec_id"), *[F.concat(F.lit(a), (F.hash("id", F.lit(a)) % 2 + 1 if a != "p" else F.lit(0)).cast("int")).alias(a) for a in names])
    draw = draw_by_shares(rows, targets, axes(*names))
    assert draw.sample.count() == draw.sample.distinct().count() == 750
