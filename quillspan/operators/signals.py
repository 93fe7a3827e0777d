"""One row per series from enriched bars: momentum votes, summary, volatility snapshot, as-of baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.quantiles import exact_quantiles
from quillspan.shared import written

# Weight of each vote, rows of a year, and cuts of the score.
WEIGHTS = {"trend_regime": 0.35, "price_vs_sma50": 0.20, "macd_histogram": 0.20, "rsi": 0.15, "bollinger_position": 0.10}
YEAR_ROWS = 252
STRONG, WEAK = 0.5, 0.15


def _unit(x: Column) -> Column:
    """Clip to -1..1; NULL stays NULL (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def votes() -> dict[str, Column]:
    """The momentum votes of an enriched row; NULL in warm-up."""
    c = F.col
    return {
        "trend_regime": _unit(F.try_divide(c("sma_50") - c("sma_200"), c("sma_200")) / 0.05),
        "price_vs_sma50": _unit(F.try_divide(c("close") - c("sma_50"), c("sma_50")) / 0.05),
        "macd_histogram": F.when(c("close") > 0, _unit(c("macd_hist") / c("close") / 0.01)),
        "rsi": _unit((c("rsi_14") - 50.0) / 20.0),
        "bollinger_position": _unit((c("bb_pct_b") - 0.5) * 2.0),
    }


def momentum(row: DataFrame) -> DataFrame:
    """``row`` (enriched, usually the last of each series) with momentum_score (4 places), momentum_label, components and missing.

    Votes in warm-up leave the denominator; without any vote the score is 0 and the label neutral.
    """
    v = votes()
    weight = sum(F.when(x.isNotNull(), F.lit(WEIGHTS[k])).otherwise(0.0) for k, x in v.items())
    total = sum(F.coalesce(x * WEIGHTS[k], F.lit(0.0)) for k, x in v.items())
    score = F.coalesce(_unit(F.try_divide(total, weight)), F.lit(0.0))
    label = F.when(score >= STRONG, "strong_bullish").when(score >= WEAK, "bullish").when(score > -WEAK, "neutral").when(score > -STRONG, "bearish").otherwise("strong_bearish")
    components = F.map_filter(F.create_map(*[y for k, x in v.items() for y in (F.lit(k), x)]), lambda _, x: x.isNotNull())
    missing = F.array_sort(F.array_compact(F.array(*[F.when(x.isNull(), F.lit(k)) for k, x in v.items()])))
    return row.withColumns({"momentum_score": F.round(score, 4), "momentum_label": label, "components": components, "missing": missing})


def latest(df: DataFrame, key: str = "symbol", by: str = "pos") -> DataFrame:
    """The last row of each series (an aggregate, no sort)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(by)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def range_of_year(df: DataFrame, key: str = "symbol", rows: int = YEAR_ROWS) -> DataFrame:
    """(key, high, low, rows) over the last ``rows`` closes of each series, or over all if there are fewer."""
    end = df.groupBy(key).agg(F.max("pos").alias("_end"))
    return df.join(end, key).where(F.col("pos") > F.col("_end") - rows).groupBy(key).agg(F.max("close").alias("high"), F.min("close").alias("low"), F.count("*").alias("rows"))


def year_to_date(df: DataFrame, key: str = "symbol", ts: str = "ts", value: str = "close") -> DataFrame:
    """(key, as_of, baseline, last_value, ytd_pct): against the last value before the as-of row's year, else its first one.

    Two aggregates; no window over a whole series.
    """
    end = df.groupBy(key).agg(F.max(ts).alias("as_of"))
    year = F.date_trunc("year", F.col("as_of")).cast("timestamp_ntz")
    joined = df.join(end, key)
    before, at = F.col(ts).cast("timestamp_ntz") < year, F.struct(F.col(ts), F.col(value))
    both = joined.groupBy(key).agg(
        F.max("as_of").alias("as_of"), F.max(F.when(before, at)).alias("_before"), F.min(F.when(~before, at)).alias("_first"), F.max(at).alias("_last")
    )
    base = F.coalesce(F.col("_before")[value], F.col("_first")[value])
    return both.select(key, "as_of", base.alias("baseline"), F.col("_last")[value].alias("last_value"), F.round((F.try_divide(F.col("_last")[value], base) - 1) * 100, 2).alias("ytd_pct"))


def volatility_snapshot(df: DataFrame, key: str = "symbol", x: str = "volatility_30d") -> DataFrame:
    """(key, current, percentile, median, maximum, n, band): the last value among all of the series.

    The percentile is the share of values strictly below the current one; band is elevated above 70, subdued below 30.
    Values are counted once each before they are compared, so a flat series isn't moved twice.
    """
    good = written(df.where(F.col(x).isNotNull()).select(key, "pos", x), "volatility")
    current = good.groupBy(key).agg(F.max_by(x, "pos").alias("current"))
    sums = good.join(current, key).groupBy(key).agg(F.max("current").alias("current"), (100 * F.avg((F.col(x) < F.col("current")).cast("int"))).alias("percentile"), F.max(x).alias("maximum"), F.count("*").alias("n"))
    out = sums.join(exact_quantiles(good, [key], x, {"median": 0.5}), key).select(key, "current", "percentile", "median", "maximum", "n")
    band = F.when(F.col("percentile") > 70, "elevated").when(F.col("percentile") < 30, "subdued").otherwise("normal")
    return out.withColumn("band", band)


def summarise(enriched: DataFrame, dimension: DataFrame | None = None, key: str = "symbol", closes: DataFrame | None = None) -> DataFrame:
    """One summary row per series: last values, year range, year-to-date return, momentum; ``dimension`` is left-joined.

    ``closes`` are the same rows with positions but without indicators (``series.with_positions``), where the caller has them: the ranges
    are read from there, and the indicators only once.
    """
    if closes is None:
        closes = enriched = written(enriched, "enriched")
    last = momentum(latest(enriched, key))
    r = range_of_year(closes, key).select(key, F.col("high").alias("year_high"), F.col("low").alias("year_low"))
    ytd = year_to_date(closes, key).select(key, "ytd_pct")
    joined = last.join(r, key).join(ytd, key, "left")
    if dimension is not None:
        joined = joined.join(dimension, key, "left")
    extra = [c for c in (dimension.columns if dimension is not None else []) if c != key]
    rounded = ["sma_50", "sma_200", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_middle", "bb_lower", "bb_pct_b", "volatility_30d"]
    return joined.select(
        key, *extra, F.col("ts").alias("as_of"), F.col("pos").alias("rows_analysed"), F.round("close", 2).alias("current_price"), F.round("year_high", 2).alias("year_high"), F.round("year_low", 2).alias("year_low"),
        F.round((F.col("close") / F.col("year_high") - 1) * 100, 2).alias("pct_below_high"), F.round((F.col("close") / F.col("year_low") - 1) * 100, 2).alias("pct_above_low"), "ytd_pct",
        *[F.round(c, 8).alias(c) for c in rounded], "momentum_score", "momentum_label", F.array_join("missing", ",").alias("missing"),
    )


def blended_signal(df: DataFrame, momentum_score: str = "momentum_score", sentiment_score: str = "sentiment_score") -> DataFrame:
    """``df`` with blend = 0.7 · momentum + 0.3 · sentiment (NULL as 0), its direction at ±0.25, confidence and agreement of signs."""
    m, s = F.coalesce(momentum_score, F.lit(0.0)), F.coalesce(sentiment_score, F.lit(0.0))
    blend = 0.7 * m + 0.3 * s
    direction = F.when(blend >= 0.25, "Buy").when(blend <= -0.25, "Sell").otherwise("Hold")
    return df.withColumns({"blend": F.round(blend, 4), "direction": direction, "blend_confidence": F.round(F.least(F.lit(0.55), F.abs(blend) + 0.15), 2), "signs_agree": m * s >= 0})


def time_bars(ticks: DataFrame, key: str, ts: str, value: str, width: str = "1 hour") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) from single values; ties in time are decided by the value."""
    start = F.window(F.col(ts).cast("timestamp"), width)["start"].cast("timestamp_ntz")
    at = F.struct(F.col(ts), F.col(value))
    return ticks.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("symbol"), start.alias("ts")).agg(
        F.min(at)[value].alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max(at)[value].alias("close"), F.count("*").alias("volume")
    )


def ranked(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group by ``order`` (a group limit runs in front of the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def price_to_earnings(close: Column, trailing: Column, eps: Column) -> Column:
    """struct(value, source): the trailing figure, else close / eps where eps is above 0, else NULL; source tells which."""
    computed = F.when(eps > 0, close / eps)
    source = F.when(trailing.isNotNull(), "trailing").when(computed.isNotNull(), "computed").otherwise("unavailable")
    return F.struct(F.coalesce(trailing, computed).alias("value"), source.alias("source"))


def last_rows(df: DataFrame, n: int = YEAR_ROWS, key: str = "symbol") -> DataFrame:
    """The last ``n`` rows of each series by its positions, as a chart shows them."""
    end = df.groupBy(key).agg(F.max("pos").alias("_end"))
    return df.join(end, key).where(F.col("pos") > F.col("_end") - n).drop("_end")


def trend_regime(fast: Column, slow: Column) -> Column:
    """up, down or flat by the order of a fast and a slow average; NULL in warm-up."""
    return F.when(fast > slow, "up").when(fast < slow, "down").when(fast == slow, "flat")
