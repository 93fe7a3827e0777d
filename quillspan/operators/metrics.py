"""Scores of predictions against references and sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.sequences import common_length
from quillspan.functions.text import numbers, numbers_found, overlap_tokens

# Words of a company name that don't tell one from another.
COMMON_NAME_WORDS = ["limited", "holdings", "group", "company", "the"]


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two token arrays (Arrow batches, bit-parallel)."""

    @F.pandas_udf(T.IntegerType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([common_length(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="int32")

    return run(a, b)


def overlap_score(prediction: Column, reference: Column, beta: float = 1.2) -> Column:
    """struct(precision, recall, f) of the longest common subsequence of tokens, 4 places; 0 where a side has none."""
    p, r = overlap_tokens(prediction), overlap_tokens(reference)
    common = lcs_length(p, r).cast("double")
    precision, recall = F.coalesce(F.try_divide(common, F.size(p)), F.lit(0.0)), F.coalesce(F.try_divide(common, F.size(r)), F.lit(0.0))
    b2 = beta * beta
    f = F.coalesce(F.try_divide((1 + b2) * precision * recall, recall + b2 * precision), F.lit(0.0))
    return F.struct(F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f, 4).alias("f"))


def set_f1(predicted: Column, expected: Column) -> Column:
    """F1 of two string arrays as sets, apart from case and outer blanks: 1 if both are empty, 0 if one is."""
    clean = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    p, e = clean(predicted), clean(expected)
    both = F.size(F.array_intersect(p, e))
    score = F.try_divide(2 * both, F.size(p) + F.size(e))
    return F.when((F.size(p) == 0) & (F.size(e) == 0), 1.0).otherwise(F.round(F.coalesce(score, F.lit(0.0)), 4))


def set_relation(a: Column, b: Column) -> Column:
    """struct(common, only_a, only_b, disjoint, covered) of two string arrays as sets; ``covered`` if all of b are in a.  NULL is empty."""
    x, y = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in (a, b))
    return F.struct(
        F.array_sort(F.array_intersect(x, y)).alias("common"), F.array_sort(F.array_except(x, y)).alias("only_a"), F.array_sort(F.array_except(y, x)).alias("only_b"),
        (~F.arrays_overlap(x, y)).alias("disjoint"), (F.size(F.array_except(y, x)) == 0).alias("covered"),
    )


def ungrounded_parties(parties: Column, text: Column) -> Column:
    """Names of which neither the whole nor any telling word of four letters stands in the text."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    tokens = lambda p: F.array_except(F.regexp_extract_all(F.lower(p), F.lit("[a-z]{4,}"), F.lit(0)), F.array(*map(F.lit, COMMON_NAME_WORDS)))
    return F.filter(parties, lambda p: ~(F.contains(lower, F.lower(p)) | F.exists(tokens(p), lambda t: F.contains(lower, t))))


def ungrounded_terms(terms: Column, text: Column) -> Column:
    """Terms that don't stand in the text: neither as they are, nor by their numbers, nor, without numbers, by any word."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    any_word = lambda t: F.exists(F.regexp_extract_all(F.lower(t), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: F.contains(lower, w))
    stands = lambda t: F.contains(lower, F.trim(F.lower(t))) | F.when(F.size(numbers(t)) > 0, numbers_found(t, lower)).otherwise(any_word(t))
    return F.filter(terms, lambda t: ~stands(t))


def roll_up(scores: DataFrame, model: str, metrics: list[str]) -> DataFrame:
    """(model, n, metric means) with missing scores counted as 0, over all rows of a model."""
    return scores.groupBy(model).agg(F.count("*").alias("n"), *[F.round(F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))), 4).alias(m) for m in metrics])


def compare(base: DataFrame, other: DataFrame, metrics: list[str], lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """(metric, base, other, delta, mark) of two one-row roll-ups; metrics missing on a side are left out."""
    long = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("x")).select("x.*").where(F.col(name).isNotNull())
    joined = long(base, "base").join(long(other, "other"), "metric")
    gain = F.when(F.col("metric").isin(*lower_is_better), F.col("base") - F.col("other")).otherwise(F.col("other") - F.col("base")) if lower_is_better else F.col("other") - F.col("base")
    mark = F.when(F.abs(gain) < 1e-9, "same").when(gain > 0, "better").otherwise("worse")
    return joined.select("metric", "base", "other", F.round(F.col("other") - F.col("base"), 4).alias("delta"), mark.alias("mark"))
