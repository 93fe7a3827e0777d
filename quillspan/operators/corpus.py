"""Profiles of a corpus: lengths, histograms, keywords, shares, entropy, a verdict on its variety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import keywords, words
from quillspan.operators.quantiles import exact_quantiles


def length_stats(docs: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Mean, population deviation, quartiles and variation of words, and range of characters, for each group."""
    sized = docs.where(F.col(text).isNotNull()).select(*by, words(F.col(text)).alias("w"), F.length(text).alias("c"))
    out = sized.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"), F.min("w").alias("min"), F.max("w").alias("max"),
        F.avg("c").alias("chars_mean"), F.min("c").alias("chars_min"), F.max("c").alias("chars_max"),
    )
    quartiles = exact_quantiles(sized.groupBy(*by, "w").agg(F.count("*").alias("_n")), by, "w", {"p25": 0.25, "median": 0.5, "p75": 0.75}, n="_n")
    other = quartiles.withColumnsRenamed({c: f"_r_{c}" for c in by})
    rule = F.lit(True)
    for c in by:
        rule = rule & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    r = lambda c, p=4: F.round(c, p)
    return out.join(other, rule).select(
        *by, "n", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), "min", *[r(F.col(name)).alias(name) for name in ("p25", "median", "p75")], "max",
        r(F.try_divide("std", "mean")).alias("cv"), r(F.col("chars_mean")).alias("chars_mean"), "chars_min", "chars_max",
    )


def histogram(df: DataFrame, value: Column, bins: int = 12) -> DataFrame:
    """(bin, low, high, n) of equal bins over the range of ``value``, the last one closed; empty bins have n = 0.

    A single value is put in the middle of a range of width 1.  No values, no bins.
    """
    values = df.select(value.cast("double").alias("v")).where("v is not null")
    span = values.agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")
    flat = F.col("a") == F.col("b")
    span = span.select(F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    number = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins) + 1, F.lit(bins)).cast("int")
    counts = values.crossJoin(F.broadcast(span)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    width = (F.col("b") - F.col("a")) / bins
    dense = span.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "a", width.alias("w"))
    return dense.join(counts, "bin", "left").select("bin", F.round(F.col("a") + F.col("w") * (F.col("bin") - 1), 4).alias("low"), F.round(F.col("a") + F.col("w") * F.col("bin"), 4).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def keyword_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n) over all documents; counted before the shuffle."""
    return docs.select(F.explode(keywords(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def keyword_report(docs: DataFrame, top: int = 25, text: str = "text") -> DataFrame:
    """The ``top`` terms with their share in percent (ties in order of the term)."""
    counts = keyword_counts(docs, text)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.orderBy(F.desc("n"), "term").limit(top).crossJoin(F.broadcast(total)).select("term", "n", F.round(100 * F.col("n") / F.col("total"), 4).alias("share_pct"))


def keyword_totals(docs: DataFrame, top: int = 25, text: str = "text") -> DataFrame:
    """Distinct terms, all terms, type/token ratio, and the share of the ``top`` terms."""
    counts = keyword_counts(docs, text)
    first = counts.orderBy(F.desc("n"), "term").limit(top).agg(F.sum("n").alias("top_n"))
    return counts.agg(F.count("*").alias("distinct_terms"), F.sum("n").alias("total_terms")).crossJoin(F.broadcast(first)).select(
        "distinct_terms", "total_terms", F.round(F.col("distinct_terms") / F.col("total_terms"), 4).alias("type_token"), F.round(100 * F.col("top_n") / F.col("total_terms"), 4).alias("top_share_pct")
    )


def axis_shares(df: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """(axis, value, n, share_pct) of each axis; NULL is the value 'null'.  One pass over the rows for all axes."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(c.cast("string"), F.lit("null")).alias("value")) for a, c in axes.items()])).alias("x"))
    counts = long.select("x.axis", "x.value").groupBy("axis", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("axis")), 4))


def axis_entropy(df: DataFrame, axes: dict[str, Column]) -> DataFrame:
    """(axis, distinct_values, entropy, max_share_pct): entropy normalised to 0..1, 0 for a single value."""
    shares = axis_shares(df, axes)
    p = F.col("share")
    exact = shares.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("axis")))
    out = exact.groupBy("axis").agg(F.count("*").alias("distinct_values"), F.sum(-p * F.ln(p)).alias("h"), F.max(p).alias("top"))
    entropy = F.when(F.col("distinct_values") <= 1, F.lit(0.0)).otherwise(F.col("h") / F.ln(F.col("distinct_values")))
    return out.select("axis", "distinct_values", F.round(entropy, 4).alias("entropy"), F.round(100 * F.col("top"), 4).alias("max_share_pct"))


def entity_uniqueness(mentions: DataFrame, entity: str = "entity") -> DataFrame:
    """(mentions, distinct_entities, uniqueness) of a column of names; NULL and blank ones don't count."""
    counts = mentions.where(F.trim(entity) != "").groupBy(F.trim(entity).alias("e")).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), F.count("*").alias("distinct_entities")).withColumn("uniqueness", F.round(F.try_divide("distinct_entities", "mentions"), 3))


def top_entities(mentions: DataFrame, entity: str = "entity", top: int = 8) -> DataFrame:
    """(entity, n) of the ``top`` names mentioned more than once (ties in order of the name); NULL and blank ones don't count."""
    counts = mentions.where(F.trim(entity) != "").groupBy(F.trim(entity).alias("entity")).agg(F.count("*").alias("n"))
    return counts.where("n > 1").orderBy(F.desc("n"), "entity").limit(top)


def verdict(metrics: DataFrame, threshold: float = 0.72) -> DataFrame:
    """(check, passed) of one row of metrics, and an ``overall`` row: variety of a corpus against stated limits.

    Columns: near_pairs, mean_cosine, p95_cosine, cv, type_entropy, type_max_share, uniqueness, edge_cases; a NULL fails.
    """
    c = F.col
    # The limit of each check.
    checks = {
        "near_pairs": c("near_pairs") == 0, "mean_cosine": c("mean_cosine") < 0.50, "p95_cosine": c("p95_cosine") < threshold, "length_cv": c("cv") > 0.30,
        "type_entropy": c("type_entropy") > 0.95, "type_share": c("type_max_share") <= 15.0, "uniqueness": c("uniqueness") > 0.60, "edge_cases": c("edge_cases") >= 3,
    }
    each = F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])
    all_ = F.struct(F.lit("overall").alias("check"), F.forall(each, lambda x: x["passed"]).alias("passed"))
    return metrics.select(F.explode(F.concat(each, F.array(all_))).alias("x")).select("x.check", "x.passed")
