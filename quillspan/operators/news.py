"""Headlines: sources taken by rank, answers matched back to questions, weighted polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.clean import match_key, title_key
from quillspan.skew import salted_lookup

# Titles that a symbol needs before further sources are left out, and the cut of the polarity label.
MINIMUM, LABEL_CUT = 10, 0.15


def union_by_rank(news: DataFrame, minimum: int = MINIMUM, per_source: int = 25, key: str = "symbol") -> DataFrame:
    """Headlines of each symbol from its sources in rank order, first title wins, whole sources until ``minimum`` is reached.

    ``news`` has symbol, source, source_rank, pos, headline and item_id.  Each source gives at most ``per_source`` rows by pos.
    A source is taken if those of lower rank have fewer than ``minimum`` different titles.  Titles that differ only
    in case, punctuation and entities are one; rows without such a title are left out.  NULL symbols are one group.
    """
    rank = F.row_number().over(Window.partitionBy(key, "source").orderBy("pos", "item_id"))
    limited = news.withColumn("_t", title_key(F.col("headline"))).where("_t <> ''").withColumn("_r", rank).where(F.col("_r") <= per_source).drop("_r")
    order = F.struct("source_rank", "pos", "item_id")
    rest = [c for c in news.columns if c != key]
    first = limited.groupBy(key, "_t").agg(F.min_by(F.struct(*rest), order).alias("_x")).select(key, *[F.col(f"_x.{c}").alias(c) for c in rest])
    per = first.groupBy(key, "source_rank").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = per.withColumn("_before", before).where(F.col("_before") < minimum).select(F.col(key).alias("_k"), F.col("source_rank").alias("_s"))
    return first.join(taken, F.col(key).eqNullSafe(F.col("_k")) & (F.col("source_rank") == F.col("_s"))).select(*news.columns)


def reconcile(asked: DataFrame, answers: DataFrame, id: str, text: str, default: dict[str, Column], order: str) -> DataFrame:
    """Every asked row with the answer of its match key, the last by ``order`` if there are several; defaults where none came.

    ``answers`` has the text column, ``order`` and the columns named in ``default``; the result adds ``answered``.
    """
    keyed = answers.withColumn("_k", match_key(F.col(text)))
    last = keyed.groupBy("_k").agg(F.max_by(F.struct(*default), F.col(order)).alias("_a"))
    rows = asked.withColumn("_k", match_key(F.col(text)))
    counts = rows.where("_k is not null").groupBy("_k").agg(F.count("*").alias("n"))
    joined = salted_lookup(rows, last.join(counts, "_k"), "_k", how="left")  # texts without letters all have one key
    filled = [F.coalesce(F.col(f"_a.{c}"), d).alias(c) for c, d in default.items()]
    return joined.select(*asked.columns, *filled, F.col("_a").isNotNull().alias("answered"))


def polarity(label: Column) -> Column:
    """1, -1 or 0 of a sentiment label."""
    return F.when(label == "positive", 1.0).when(label == "negative", -1.0).otherwise(0.0)


def weighted_sentiment(scored: DataFrame, by: list[str], label: str = "sentiment", confidence: str = "confidence") -> DataFrame:
    """Confidence-weighted polarity of each group with its label and counts; ``degenerate`` flags four or more rows all alike."""
    p, c = polarity(F.col(label)), F.col(confidence)
    out = scored.groupBy(*by).agg(
        F.try_divide(F.sum(p * c), F.sum(c)).alias("_s"), F.count("*").alias("headline_count"), F.count_if(F.col(label) == "positive").alias("positive_count"),
        F.count_if(F.col(label) == "negative").alias("negative_count"), F.count_if(F.col(label) == "neutral").alias("neutral_count"), F.round(F.avg(c), 4).alias("mean_confidence"),
        ((F.count("*") >= 4) & (F.min(label) == F.max(label)) & (F.min(F.round(c, 2)) == F.max(F.round(c, 2)))).alias("degenerate"),
    )
    score = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("_s", F.lit(0.0)))), 4)
    out = out.withColumn("score", score)
    name = F.when(F.col("score") >= LABEL_CUT, "positive").when(F.col("score") <= -LABEL_CUT, "negative").otherwise("neutral")
    return out.withColumn("label", name).select(*by, "score", "label", "headline_count", "positive_count", "negative_count", "neutral_count", "mean_confidence", "degenerate")


def wording_polarity(headline: Column) -> tuple[Column, Column]:
    """A deterministic stand-in for a model: (label, confidence) by a few verbs.  A real classifier is passed as a function."""
    # Verbs of rising and falling.
    up, down = "(?i)raises|lifts|widens|backs|doubles|unveils", "(?i)halves|trims|shelves|scraps|stalls|rejects"
    label = F.when(headline.rlike(up), "positive").when(headline.rlike(down), "negative").otherwise("neutral")
    return label, F.round(0.5 + F.pmod(F.length(headline), F.lit(50)) / 100.0, 2)


def classify(rows: DataFrame, text: str, model, batch: int = 8) -> DataFrame:
    """``rows`` with columns sentiment and confidence from ``model(list of texts) -> list of (label, confidence)``, ``batch`` texts a call."""
    from collections.abc import Iterator

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = [a for at in range(0, len(pdf), batch) for a in model(pdf[text].iloc[at : at + batch].tolist())]
            yield pdf.assign(sentiment=[a[0] for a in answers], confidence=[float(a[1]) for a in answers])

    from pyspark.sql import types as T

    schema = T.StructType([*rows.schema.fields, T.StructField("sentiment", T.StringType()), T.StructField("confidence", T.DoubleType())])
    return rows.mapInPandas(run, schema)
