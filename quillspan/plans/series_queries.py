"""Queries over ordered series, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import series as s
from quillspan.operators import signals as g
from quillspan.shared import written
from quillspan.sources.tables import table
from quillspan.streaming import live


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return s.with_positions(s.clean_bars(table(spark, d, "bars")))


def _enriched(spark: SparkSession, d: str, *names: str) -> DataFrame:
    return s.with_indicators(table(spark, d, "bars"), names=list(names) or None)


def _six(df: DataFrame, *columns: str, places: int = 6) -> list:
    return [F.round(c, places).alias(c) for c in columns]


def q_keep_last(spark, d):
    """Clean bars: one for each symbol and time."""
    return s.clean_bars(table(spark, d, "bars")).select("symbol", "ts", "close", "volume")


def q_bars_hourly(spark, d):
    """Hourly bars of event values by type."""
    return g.time_bars(table(spark, d, "events"), "event_type", "ts", "value").select("symbol", "ts", *_six(None, "open", "high", "low", "close"), "volume")


def q_stream_bars(spark, d):
    """The same bars from the events read as a stream."""
    ticks = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    return live.run_available(live.bars_stream(ticks, "event_type", "ts", "value")).select("symbol", "ts", *_six(None, "open", "high", "low", "close"), "volume")


def q_brand_vwap_daily(spark, d):
    """Volume-weighted price and quantity of each brand and day."""
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    items = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    by = items.join(part, items["l_partkey"] == part["p_partkey"]).groupBy("p_brand", "l_shipdate")
    return by.agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 8).alias("vwap"), F.sum("l_quantity").cast("double").alias("quantity"))


def q_sma(spark, d):
    """Moving averages over 50 and 200 rows."""
    near = s.with_halo(_placed(spark, d), 200)
    framed = near.withColumns({"sma_50": s.sma(F.col("close"), 50), "sma_200": s.sma(F.col("close"), 200)}).where("not halo")
    return framed.select("symbol", "ts", *_six(None, "sma_50", "sma_200", places=9))


def q_bollinger(spark, d):
    """Bollinger bands over 20 rows."""
    near = s.with_halo(_placed(spark, d), 20)
    return near.withColumns(s.bollinger(F.col("close"))).where("not halo").select("symbol", "ts", *_six(None, "bb_middle", "bb_upper", "bb_lower", "bb_width", places=9))


def q_volatility(spark, d):
    """Annualised volatility over 30 rows."""
    return _enriched(spark, d, "volatility_30d").select("symbol", "ts", *_six(None, "volatility_30d"))


def q_ema(spark, d):
    """Exponential average of span 12."""
    return s.ema(_placed(spark, d), "close", 12, "ema_12").select("symbol", "ts", *_six(None, "ema_12"))


def q_macd(spark, d):
    """MACD line, signal and histogram."""
    return _enriched(spark, d, "macd", "macd_signal", "macd_hist").select("symbol", "ts", *_six(None, "macd", "macd_signal", "macd_hist"))


def q_rsi(spark, d):
    """RSI over 14 rows."""
    return _enriched(spark, d, "rsi_14").select("symbol", "ts", *_six(None, "rsi_14", places=5))


def q_indicators_all(spark, d):
    """All indicators of every bar."""
    return _enriched(spark, d).select("symbol", "ts", "pos", *_six(None, "sma_50", "sma_200", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_middle", "bb_upper", "bb_lower", "volatility_30d", places=9))


def q_momentum(spark, d):
    """Momentum score and label of the last bar of each symbol."""
    return g.momentum(g.latest(_enriched(spark, d))).select("symbol", "momentum_score", "momentum_label", F.array_join("missing", ",").alias("missing"))


def q_equity_summary(spark, d):
    """One summary row for each symbol, with its issuer."""
    return g.summarise(_enriched(spark, d), table(spark, d, "issuers").select("symbol", "company_name", "sector", "currency"), closes=written(_placed(spark, d), "placed"))


def q_vol_snapshot(spark, d):
    """Last volatility of each symbol among all of its values."""
    out = g.volatility_snapshot(_enriched(spark, d, "volatility_30d"))
    return out.select("symbol", *_six(None, "current", "percentile", "median", "maximum", places=5), "n", "band")


def q_ytd_asof(spark, d):
    """Last order value of each market segment against the last one before that year."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    days = orders.groupBy(F.col("c_mktsegment").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").cast("double").alias("close"))
    return g.year_to_date(days).select("symbol", F.col("as_of").cast("date").alias("as_of"), F.round("baseline", 2).alias("baseline"), F.round("last_value", 2).alias("last_value"), "ytd_pct")


def q_range_252(spark, d):
    """Highest and lowest close of the last 252 bars."""
    return g.range_of_year(_placed(spark, d))


def q_top_moves(spark, d):
    """The three largest moves between bars of each symbol."""
    near = s.with_halo(_placed(spark, d), 1)
    moved = near.withColumn("move", F.round(F.try_divide("close", s.previous(F.col("close"))) - 1, 6)).where("not halo and move is not null")
    return g.ranked(moved, ["symbol"], [F.desc(F.abs("move")), F.col("ts")], 3).select("symbol", "rank", "ts", "move")


def q_first_valid(spark, d):
    """The first bar at which each indicator has a value."""
    e = _enriched(spark, d)
    names = ["sma_50", "sma_200", "rsi_14", "macd", "macd_signal", "bb_middle", "volatility_30d"]
    return e.groupBy("symbol").agg(*[F.min(F.when(F.col(n).isNotNull(), F.col("pos"))).alias(n) for n in names])


def q_bars_window(spark, d):
    """Clean bars of a year and two days up to a day, by symbol."""
    bars = s.in_window(table(spark, d, "bars"), F.lit("2026-09-24 12:00:00").cast("timestamp"), years=1, buffer_days=2)
    return s.clean_bars(bars).groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def q_dropped_bars(spark, d):
    """What cleaning drops of each symbol's bars."""
    return s.dropped_bars(table(spark, d, "bars"))


def q_chart_window(spark, d):
    """The last 252 bars of each symbol with their bands."""
    rows = g.last_rows(_enriched(spark, d, "bb_upper", "bb_lower"))
    return rows.select("symbol", "ts", "close", *_six(None, "bb_upper", "bb_lower", places=8))


def q_trend_regime(spark, d):
    """The order of the averages at the last bar of each symbol."""
    last = g.latest(_enriched(spark, d, "sma_50", "sma_200"))
    return last.select("symbol", g.trend_regime(F.col("sma_50"), F.col("sma_200")).alias("regime"))


QUERIES = {f.__name__: f for f in (
    q_equity_summary, q_keep_last, q_bars_hourly, q_stream_bars, q_brand_vwap_daily, q_sma, q_bollinger, q_volatility, q_ema, q_macd, q_rsi, q_indicators_all,
    q_momentum, q_vol_snapshot, q_ytd_asof, q_range_252, q_top_moves, q_first_valid, q_bars_window, q_dropped_bars, q_chart_window, q_trend_regime,
)}

CLEAN = """
clean AS (
  SELECT symbol, ts, open, high, low, close, volume FROM bars
  WHERE close > 0 AND symbol IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY volume DESC NULLS LAST, open DESC NULLS LAST,
    high DESC NULLS LAST, low DESC NULLS LAST, close DESC NULLS LAST) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS pos FROM clean)"""

ENRICHED = CLEAN + """,
steps AS (
  SELECT *, close - lag(close) OVER w AS d, ln(close) - ln(lag(close) OVER w) AS r FROM placed WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
scan AS (
  SELECT symbol, pos, close AS fast, close AS slow, 0e0 AS g, 0e0 AS l FROM steps WHERE pos = 1
  UNION ALL
  SELECT t.symbol, t.pos, s.fast * (1 - 2e0 / 13) + 2e0 / 13 * t.close, s.slow * (1 - 2e0 / 27) + 2e0 / 27 * t.close,
    CASE WHEN t.pos < 15 THEN s.g + greatest(t.d, 0) WHEN t.pos = 15 THEN (s.g + greatest(t.d, 0)) / 14 ELSE (s.g * 13 + greatest(t.d, 0)) / 14 END,
    CASE WHEN t.pos < 15 THEN s.l + greatest(-t.d, 0) WHEN t.pos = 15 THEN (s.l + greatest(-t.d, 0)) / 14 ELSE (s.l * 13 + greatest(-t.d, 0)) / 14 END
  FROM scan s JOIN steps t ON t.symbol = s.symbol AND t.pos = s.pos + 1),
line AS (SELECT symbol, pos, fast - slow AS macd FROM scan WHERE pos >= 26),
sig AS (
  SELECT symbol, pos, macd AS v FROM line WHERE pos = 26
  UNION ALL
  SELECT t.symbol, t.pos, s.v * 0.8e0 + 0.2e0 * t.macd FROM sig s JOIN line t ON t.symbol = s.symbol AND t.pos = s.pos + 1),
framed AS (
  SELECT symbol, ts, pos, close,
    CASE WHEN pos >= 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END AS sma_50,
    CASE WHEN pos >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END AS sma_200,
    CASE WHEN pos >= 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS bb_middle,
    CASE WHEN pos >= 20 THEN stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS bb_std,
    CASE WHEN pos >= 31 THEN stddev_samp(r) OVER (w ROWS 29 PRECEDING) * sqrt(252) END AS volatility_30d
  FROM steps WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
enriched AS (
  SELECT f.*, bb_middle + 2 * bb_std AS bb_upper, bb_middle - 2 * bb_std AS bb_lower, 4 * bb_std / nullif(bb_middle, 0) AS bb_width,
    (close - (bb_middle - 2 * bb_std)) / nullif(4 * bb_std, 0) AS bb_pct_b,
    CASE WHEN f.pos < 15 THEN NULL WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 WHEN g = 0 THEN 0 ELSE 100 - 100 / (1 + g / l) END AS rsi_14,
    macd, CASE WHEN f.pos >= 34 THEN sig.v END AS macd_signal, macd - CASE WHEN f.pos >= 34 THEN sig.v END AS macd_hist
  FROM framed f JOIN scan USING (symbol, pos) LEFT JOIN line USING (symbol, pos) LEFT JOIN sig USING (symbol, pos))"""

MOMENTUM = """,
last_row AS (SELECT * FROM enriched QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1),
votes AS (
  SELECT *, CASE WHEN sma_200 IS NOT NULL THEN greatest(-1, least(1, (sma_50 - sma_200) / sma_200 / 0.05e0)) END AS v1,
    CASE WHEN sma_50 IS NOT NULL THEN greatest(-1, least(1, (close - sma_50) / sma_50 / 0.05e0)) END AS v2,
    CASE WHEN macd_hist IS NOT NULL THEN greatest(-1, least(1, macd_hist / close / 0.01e0)) END AS v3,
    CASE WHEN rsi_14 IS NOT NULL THEN greatest(-1, least(1, (rsi_14 - 50) / 20e0)) END AS v4,
    CASE WHEN bb_pct_b IS NOT NULL THEN greatest(-1, least(1, (bb_pct_b - 0.5e0) * 2)) END AS v5 FROM last_row),
scored AS (
  SELECT *, coalesce((coalesce(v1 * 0.35e0, 0) + coalesce(v2 * 0.2e0, 0) + coalesce(v3 * 0.2e0, 0) + coalesce(v4 * 0.15e0, 0) + coalesce(v5 * 0.1e0, 0))
    / nullif(CASE WHEN v1 IS NULL THEN 0 ELSE 0.35e0 END + CASE WHEN v2 IS NULL THEN 0 ELSE 0.2e0 END + CASE WHEN v3 IS NULL THEN 0 ELSE 0.2e0 END
      + CASE WHEN v4 IS NULL THEN 0 ELSE 0.15e0 END + CASE WHEN v5 IS NULL THEN 0 ELSE 0.1e0 END, 0), 0) AS score FROM votes),
labelled AS (
  SELECT *, round(score, 4) AS momentum_score, CASE WHEN score >= 0.5 THEN 'strong_bullish' WHEN score >= 0.15 THEN 'bullish' WHEN score > -0.15 THEN 'neutral'
    WHEN score > -0.5 THEN 'bearish' ELSE 'strong_bearish' END AS momentum_label,
    concat_ws(',', CASE WHEN v5 IS NULL THEN 'bollinger_position' END, CASE WHEN v3 IS NULL THEN 'macd_histogram' END, CASE WHEN v2 IS NULL THEN 'price_vs_sma50' END,
      CASE WHEN v4 IS NULL THEN 'rsi' END, CASE WHEN v1 IS NULL THEN 'trend_regime' END) AS missing FROM scored)"""

_HOURLY = """
SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, round(arg_min(value, (ts, value)), 6) AS open, round(max(value), 6) AS high,
  round(min(value), 6) AS low, round(arg_max(value, (ts, value)), 6) AS close, count(*) AS volume
FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL"""


def _columns(names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) AS {n}" for n in names.split())


SQL = {
    "q_keep_last": f"WITH {CLEAN} SELECT symbol, ts, close, volume FROM clean",
    "q_bars_hourly": _HOURLY,
    "q_stream_bars": _HOURLY,
    "q_brand_vwap_daily": """
        SELECT p_brand, l_shipdate, round(sum(l_extendedprice) / sum(l_quantity), 8) AS vwap, sum(l_quantity)::DOUBLE AS quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "q_sma": f"""WITH {CLEAN} SELECT symbol, ts, round(CASE WHEN pos >= 50 THEN avg(close) OVER (w ROWS 49 PRECEDING) END, 9) AS sma_50,
        round(CASE WHEN pos >= 200 THEN avg(close) OVER (w ROWS 199 PRECEDING) END, 9) AS sma_200 FROM placed WINDOW w AS (PARTITION BY symbol ORDER BY pos)""",
    "q_bollinger": f"WITH RECURSIVE {ENRICHED} SELECT symbol, ts, {_columns('bb_middle bb_upper bb_lower bb_width', 9)} FROM enriched",
    "q_volatility": f"WITH RECURSIVE {ENRICHED} SELECT symbol, ts, {_columns('volatility_30d')} FROM enriched",
    "q_ema": f"WITH RECURSIVE {ENRICHED} SELECT symbol, ts, round(CASE WHEN pos >= 12 THEN fast END, 6) AS ema_12 FROM placed JOIN scan USING (symbol, pos)",
    "q_macd": f"WITH RECURSIVE {ENRICHED} SELECT symbol, ts, {_columns('macd macd_signal macd_hist')} FROM enriched",
    "q_rsi": f"WITH RECURSIVE {ENRICHED} SELECT symbol, ts, {_columns('rsi_14', 5)} FROM enriched",
    "q_indicators_all": f"WITH RECURSIVE {ENRICHED} SELECT symbol, ts, pos, {_columns('sma_50 sma_200 rsi_14 macd macd_signal macd_hist bb_middle bb_upper bb_lower volatility_30d', 9)} FROM enriched",
    "q_momentum": f"WITH RECURSIVE {ENRICHED}{MOMENTUM} SELECT symbol, momentum_score, momentum_label, missing FROM labelled",
    "q_equity_summary": f"""
        WITH RECURSIVE {ENRICHED}{MOMENTUM},
        year AS (SELECT symbol, max(close) AS high, min(close) AS low FROM (SELECT *, max(pos) OVER (PARTITION BY symbol) AS e FROM placed) WHERE pos > e - 252 GROUP BY symbol),
        ends AS (SELECT symbol, max(ts) AS as_of FROM placed GROUP BY symbol),
        base AS (SELECT symbol, coalesce(max_by(close, ts) FILTER (WHERE ts < date_trunc('year', as_of)), min_by(close, ts) FILTER (WHERE ts >= date_trunc('year', as_of))) AS baseline,
          max_by(close, ts) AS last_value FROM placed JOIN ends USING (symbol) GROUP BY symbol)
        SELECT symbol, company_name, sector, currency, ts AS as_of, pos AS rows_analysed, round(close, 2) AS current_price, round(high, 2) AS year_high, round(low, 2) AS year_low,
          round((close / high - 1) * 100, 2) AS pct_below_high, round((close / low - 1) * 100, 2) AS pct_above_low, round((last_value / baseline - 1) * 100, 2) AS ytd_pct,
          {_columns('sma_50 sma_200 rsi_14 macd macd_signal macd_hist bb_upper bb_middle bb_lower bb_pct_b volatility_30d', 8)}, momentum_score, momentum_label, missing
        FROM labelled JOIN year USING (symbol) LEFT JOIN base USING (symbol) LEFT JOIN issuers USING (symbol)""",
    "q_vol_snapshot": f"""
        WITH RECURSIVE {ENRICHED}, good AS (SELECT symbol, pos, volatility_30d AS v FROM enriched WHERE volatility_30d IS NOT NULL),
        cur AS (SELECT symbol, max_by(v, pos) AS current FROM good GROUP BY symbol),
        agg AS (SELECT symbol, max(current) AS current, 100 * avg((v < current)::INT) AS percentile, quantile_cont(v, 0.5) AS median, max(v) AS maximum, count(*) AS n
          FROM good JOIN cur USING (symbol) GROUP BY symbol)
        SELECT symbol, {_columns('current percentile median maximum', 5)}, n, CASE WHEN percentile > 70 THEN 'elevated' WHEN percentile < 30 THEN 'subdued' ELSE 'normal' END AS band FROM agg""",
    "q_ytd_asof": """
        WITH days AS (SELECT c_mktsegment AS symbol, o_orderdate AS ts, sum(o_totalprice)::DOUBLE AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        ends AS (SELECT symbol, max(ts) AS as_of FROM days GROUP BY symbol),
        base AS (SELECT symbol, as_of, coalesce(max_by(close, ts) FILTER (WHERE ts < date_trunc('year', as_of)), min_by(close, ts) FILTER (WHERE ts >= date_trunc('year', as_of))) AS baseline,
          max_by(close, ts) AS last_value FROM days JOIN ends USING (symbol) GROUP BY ALL)
        SELECT symbol, as_of::DATE AS as_of, round(baseline, 2) AS baseline, round(last_value, 2) AS last_value, round((last_value / baseline - 1) * 100, 2) AS ytd_pct FROM base""",
    "q_range_252": f"""WITH {CLEAN} SELECT symbol, max(close) AS high, min(close) AS low, count(*) AS rows
        FROM (SELECT *, max(pos) OVER (PARTITION BY symbol) AS e FROM placed) WHERE pos > e - 252 GROUP BY symbol""",
    "q_top_moves": f"""WITH {CLEAN}, m AS (SELECT symbol, ts, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1, 6) AS move FROM placed)
        SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY abs(move) DESC, ts)::INT AS rank, ts, move FROM m WHERE move IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY abs(move) DESC, ts) <= 3""",
    "q_first_valid": f"WITH RECURSIVE {ENRICHED} SELECT symbol, " + ", ".join(f"min(pos) FILTER (WHERE {n} IS NOT NULL) AS {n}" for n in "sma_50 sma_200 rsi_14 macd macd_signal bb_middle volatility_30d".split()) + " FROM enriched GROUP BY symbol",
    "q_bars_window": f"""WITH {CLEAN} SELECT symbol, count(*) AS bars, min(ts) AS first, max(ts) AS last FROM clean
        WHERE ts >= TIMESTAMP '2025-09-22 00:00:00' AND ts < TIMESTAMP '2026-09-24 00:00:00' GROUP BY symbol""",
    "q_dropped_bars": """
        WITH k AS (SELECT symbol, ts, count(*) AS n, count(*) FILTER (WHERE close > 0 AND symbol IS NOT NULL AND ts IS NOT NULL) AS good FROM bars GROUP BY ALL)
        SELECT symbol, sum(n)::BIGINT AS rows, (sum(n) - sum(good))::BIGINT AS invalid, (sum(good) - count(*) FILTER (WHERE good > 0))::BIGINT AS repeated, count(*) FILTER (WHERE good > 0) AS kept FROM k GROUP BY symbol""",
    "q_chart_window": f"""WITH RECURSIVE {ENRICHED}, e AS (SELECT *, max(pos) OVER (PARTITION BY symbol) AS top FROM enriched)
        SELECT symbol, ts, close, {_columns('bb_upper bb_lower', 8)} FROM e WHERE pos > top - 252""",
    "q_trend_regime": f"""WITH RECURSIVE {ENRICHED} SELECT symbol, CASE WHEN sma_50 > sma_200 THEN 'up' WHEN sma_50 < sma_200 THEN 'down' WHEN sma_50 = sma_200 THEN 'flat' END AS regime
        FROM enriched QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1""",
}
