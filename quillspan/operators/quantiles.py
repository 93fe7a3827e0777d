"""Exact percentiles of large groups: values are counted, counts summed up by ranges, and only the ranges that matter are ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that the values of a group are cut into.
RANGES = 1024


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], n: str | None = None) -> DataFrame:
    """(by…, one column a quantile): interpolated between neighbours, as PERCENTILE_CONT does.

    ``n`` names a column of counts, if each row stands for several values.  NULL values don't count; groups without a value have no
    row, and NULL is a group like any other.  No task orders the values of a whole group: equal values are counted first, the
    counts of RANGES ranges between least and largest value are summed up, and ranks are only looked for in ranges that hold them.
    """
    keys = [F.col(c) for c in by]
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n") if n is None else F.sum(n).cast("long").alias("_n"))
    spans = counted.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_n").alias("_total"))
    width = (F.col("_high") - F.col("_low")) / F.lit(float(RANGES))
    cell = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(RANGES - 1))).otherwise(0)
    placed = _on(counted, spans, by).withColumn("_cell", cell.cast("int"))
    cells = placed.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_c"), F.first("_total").alias("_total"))
    group = Window.partitionBy(*[F.coalesce(c.cast("string"), F.lit("\x02")) for c in keys]) if by else Window.partitionBy(F.lit(0))
    ahead = F.coalesce(F.sum("_c").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = {f"{name}{end}": f(F.lit(q) * (F.col("_total") - 1)).cast("long") for name, q in quantiles.items() for end, f in (("_a", F.floor), ("_b", F.ceil))}
    holds = F.lit(False)
    for rank in ranks.values():
        holds = holds | ((rank >= F.col("_ahead")) & (rank < F.col("_ahead") + F.col("_c")))
    cells = cells.withColumn("_ahead", ahead).where(holds).select(*by, "_cell", "_ahead")
    chosen = _on(placed.select(*by, "_v", "_n", "_cell", "_total"), cells, [*by, "_cell"])
    inner = Window.partitionBy(*[F.coalesce(c.cast("string"), F.lit("\x02")) for c in keys], "_cell").orderBy("_v")
    upto = chosen.withColumn("_upto", F.col("_ahead") + F.sum("_n").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    found = upto.groupBy(*keys).agg(F.first("_total").alias("_total"), *[F.min(F.when(F.col("_upto") > rank, F.col("_v"))).alias(f"_{name}") for name, rank in ranks.items()])
    part = {name: F.lit(q) * (F.col("_total") - 1) - F.floor(F.lit(q) * (F.col("_total") - 1)) for name, q in quantiles.items()}
    return found.select(*by, *[(F.col(f"_{name}_a") + part[name] * (F.col(f"_{name}_b") - F.col(f"_{name}_a"))).alias(name) for name in quantiles])


def _on(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """A join on columns in which NULL equals NULL."""
    if not by:
        return left.crossJoin(right)  # one row
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    rule = F.lit(True)
    for c in by:
        rule = rule & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(other, rule).drop(*[f"_r_{c}" for c in by])
