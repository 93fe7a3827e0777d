"""Joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.shared import written

#: A key with more rows than this is split over several tasks.
HOT_ROWS = 100_000

#: NULL keys match nothing; their rows are spread over so many hash values.
NULL_SALTS = 4096


#: Most keys that are salted: their hashes are broadcast (16 bytes each).
MOST_HOT = 100_000


def row_hash(df: DataFrame) -> Column:
    """A hash of the row's atomic columns: it spreads rows and is the same when a lost task runs again."""
    atomic = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType, T.VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in atomic]) if atomic else F.lit(0)


def salted_lookup(rows: DataFrame, dim: DataFrame, key: str, *, how: str = "inner", hot_rows: int = HOT_ROWS, n: str = "n") -> DataFrame:
    """Join ``rows`` with ``dim``, whose ``key`` is unique and whose column ``n`` counts the rows of the key.

    Where no key has more than ``hot_rows`` rows this is a plain join.  Otherwise keys above the limit are salted: the rows by a
    hash of themselves, the one row of ``dim`` repeated once per salt.  The limit is at least the sum of ``n`` / MOST_HOT, so
    fewer than MOST_HOT keys are above it, and only their hashes are broadcast; both sides look a key up by its hash, so a
    key that shares one is merely salted as well.  NULL keys match nothing and are spread.  Columns of ``dim`` other than
    ``key`` and ``n`` are added to ``rows``.
    """
    total, most = dim.agg(F.sum(n), F.max(n)).first()
    limit = max(hot_rows, -(-int(total or 0) // MOST_HOT))
    if (most or 0) <= limit:
        if how == "inner":
            return rows.join(dim.drop(n), key)
        salt = F.when(F.col(key).isNull(), F.pmod(row_hash(rows), F.lit(NULL_SALTS))).otherwise(0).cast("int")
        return rows.withColumn("_salt", salt).join(dim.drop(n).withColumn("_salt", F.lit(0)), [key, "_salt"], how).drop("_salt")
    hashed = F.xxhash64(key)
    hot = dim.where(F.col(n) > limit).groupBy(hashed.alias("_hash")).agg(F.ceil(F.max(n) / F.lit(limit)).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.when(F.col(key).isNull(), F.pmod("_spread", F.lit(NULL_SALTS))).otherwise(F.pmod("_spread", parts)).cast("int")
    salted = rows.withColumns({"_spread": row_hash(rows), "_hash": hashed}).join(F.broadcast(hot), "_hash", "left").withColumn("_salt", salt).drop("_parts", "_spread", "_hash")
    repeated = dim.withColumn("_hash", hashed).join(F.broadcast(hot), "_hash", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n, "_parts", "_hash")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def salted_pairs(left: DataFrame, right: DataFrame, key: str, *, hot_rows: int | None = None) -> DataFrame:
    """Join of ``left`` and ``right`` on ``key`` in which the rows of a hot key are split on both sides.

    A key's rows of each side are cut into parts of about ``hot_rows`` (default HOT_ROWS) by a hash of the row, and each part of one side meets each of the
    other in a task of its own.  Only hashes of keys with more rows than that, and than the sum of all / MOST_HOT, are
    broadcast.  NULL keys match nothing.
    """
    hot_rows = hot_rows or HOT_ROWS
    counted = [side.where(F.col(key).isNotNull()).groupBy(F.xxhash64(key).alias("_hash")).agg(F.count("*").alias("_n")) for side in (left, right)]
    sizes = [c.agg(F.sum("_n"), F.max("_n")).first() for c in counted]
    limit = max(hot_rows, *(-(-int(total or 0) // MOST_HOT) for total, _ in sizes))
    if max(most or 0 for _, most in sizes) <= limit:
        return left.join(right, key)
    parts = None
    for c, name in zip(counted, ("_left", "_right"), strict=True):
        hot = c.where(F.col("_n") > limit).select("_hash", F.ceil(F.col("_n") / F.lit(limit)).cast("int").alias(name))
        parts = hot if parts is None else parts.join(hot, "_hash", "full")
    salted = []
    for side, own, other in ((left, "_left", "_right"), (right, "_right", "_left")):
        mine = side.withColumns({"_spread": row_hash(side), "_hash": F.xxhash64(key)}).join(F.broadcast(parts), "_hash", "left")
        part = F.pmod("_spread", F.coalesce(own, F.lit(1))).cast("int")
        each = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        salted.append(mine.withColumn(f"_at{own}", part).withColumn(f"_at{other}", each).drop("_spread", "_hash", "_left", "_right"))
    return salted[0].join(salted[1], [key, "_at_left", "_at_right"]).drop("_at_left", "_at_right")


def ordered_positions(df: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``df`` with ``name``: 1, 2, … in each group of ``by`` in ``order``; NULL is a group, and comes first in order.

    Rows are cut into ranges of group and order and counted by range, so that no task orders a whole group; a group's counts,
    one for each range, are summed up.  The ranges are written, so that a task that runs again finds the same ones.  Rows that tie
    in ``order`` are numbered in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    keys = {c: f"_key_{c}" for c in by}
    sizes = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n")).withColumnsRenamed(keys)
    upto = Window.partitionBy(*keys.values()).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*keys.values(), F.col("_range").alias("_key_range"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    rule = F.col("_range") == F.col("_key_range")
    for c, k in keys.items():
        rule = rule & F.col(c).eqNullSafe(F.col(k))
    inside = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    return ranged.join(before, rule).withColumn(name, (F.col("_before") + inside).cast("long")).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)
