"""Ordered series, many at once: positions, frames and recurrences that never hold one whole series in a task.

A series of any length is cut into blocks of at most BLOCK positions.  Frames see the rows in front of their block as a
halo; linear recurrences are composed block by block and then carried over the blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.shared import written

#: Positions of a block.
BLOCK = 4096


def check_window(value: int, name: str = "window") -> int:
    """A window length: a positive integer, else ValueError."""
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive integer, got {value!r}")
    return value


def finite(value: Column, places: int | None = None) -> Column:
    """A double, NULL where it is no finite number; rounded if ``places`` is given."""
    x = value.try_cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)
    return x if places is None else F.round(x, places)


def present(df: DataFrame, names: list[str]) -> DataFrame:
    """Those columns of ``names`` that ``df`` has, in that order."""
    return df.select(*[F.col(f"`{c}`") for c in names if c in df.columns])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per ``keys``: the one that is last by ``order``.

    NULL keys form a group; rows that tie in ``order`` are decided by their other atomic columns, so the result is the same
    at every run.  A hash aggregate with map-side combine, no sort of whole groups.
    """
    rest = [c for c in df.columns if c not in keys]
    by = [*order, *[c for c, kind in df.dtypes if c in rest and c not in order and not kind.startswith(("map", "variant"))]]
    last = F.max_by(F.struct(*rest), F.struct(*by)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])


def clean_bars(bars: DataFrame) -> DataFrame:
    """Bars with a close above 0, one per (symbol, ts): of repeated ones the last by volume, then by its other values.

    NULL and non-finite closes, NULL symbols and NULL times are dropped; an empty table stays empty.
    """
    good = bars.where(finite(F.col("close")).isNotNull() & (F.col("close") > 0) & F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    return keep_last(good, ["symbol", "ts"], ["volume"] if "volume" in bars.columns else [])


def in_window(bars: DataFrame, now: Column, years: int = 2, buffer_days: int = 30, ts: str = "ts") -> DataFrame:
    """Bars from ``years`` years and ``buffer_days`` days before the day of ``now`` up to its beginning; the bounds reach the scan."""
    check_window(years, "years")
    end = F.date_trunc("day", now).cast("timestamp_ntz")
    start = end - F.make_interval(years=F.lit(years), days=F.lit(buffer_days))
    return bars.where((F.col(ts) >= start) & (F.col(ts) < end))


def required(df: DataFrame, what: str) -> DataFrame:
    """``df``, or a ValueError where it has no row."""
    if not df.limit(1).count():
        raise ValueError(f"no {what}")
    return df


def dropped_bars(bars: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """(key, rows, invalid, repeated, kept): what ``clean_bars`` drops of each series, in one pass; NULL keys are a group."""
    valid = F.coalesce(finite(F.col("close")) > 0, F.lit(False)) & F.col(ts).isNotNull() & F.col(key).isNotNull()
    by = bars.groupBy(key, ts).agg(F.count("*").alias("n"), F.count_if(valid).alias("good"))
    kept = F.count_if(F.col("good") > 0)
    return by.groupBy(key).agg(F.sum("n").alias("rows"), (F.sum("n") - F.sum("good")).alias("invalid"), (F.sum("good") - kept).alias("repeated"), kept.alias("kept"))


def with_positions(df: DataFrame, key: str = "symbol", ts: str = "ts", block: int = BLOCK) -> DataFrame:
    """``df`` with ``pos`` (1, 2, … in each series by time) and ``block``.

    Rows are counted by day and numbered within it, and the days' counts are summed up, so no task orders a whole series.
    ``(key, ts)`` must be unique.
    """
    day = F.to_date(ts)
    days = df.groupBy(key, day.alias("_day")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = days.select(key, "_day", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_day").orderBy(ts))
    numbered = df.withColumn("_day", day).withColumn("_in_day", within).join(offsets, [key, "_day"])
    pos = (F.col("_before") + F.col("_in_day")).cast("long")
    return numbered.withColumn("pos", pos).withColumn("block", F.floor((F.col("pos") - 1) / F.lit(block)).cast("long")).drop("_day", "_in_day", "_before")


def with_halo(df: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """Each row in its block, and the last ``halo`` rows in front of a block in it as well, marked by ``halo``."""
    if halo > block:
        raise ValueError("a frame may not be longer than a block")
    next_too = F.pmod(F.col("pos") - 1, F.lit(block)) >= block - halo
    blocks = F.when(next_too, F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array(F.col("block")))
    return df.withColumn("_own", F.col("block")).withColumn("block", F.explode(blocks)).withColumn("halo", F.col("block") != F.col("_own")).drop("_own")


def frame(n: int, key: str = "symbol"):
    """The last ``n`` rows up to the current one."""
    return Window.partitionBy(key, "block").orderBy("pos").rowsBetween(-(n - 1), 0)


def previous(x: Column, key: str = "symbol", back: int = 1) -> Column:
    """The value ``back`` rows before (needs a halo)."""
    return F.lag(x, back).over(Window.partitionBy(key, "block").orderBy("pos"))


def over_full(aggregate: Column, x: Column, n: int, key: str = "symbol") -> Column:
    """``aggregate`` over the last ``n`` rows, NULL unless all ``n`` are there and not NULL."""
    return F.when(F.count(x).over(frame(n, key)) == n, aggregate.over(frame(n, key)))


def sma(x: Column, n: int, key: str = "symbol") -> Column:
    """Simple moving average."""
    return over_full(F.avg(x), x, check_window(n), key)


def bollinger(x: Column, n: int = 20, width: float = 2.0, key: str = "symbol") -> dict[str, Column]:
    """Middle, upper and lower band, population deviation, relative width and place within the bands."""
    mid, std = sma(x, n, key), over_full(F.stddev_pop(x), x, n, key)
    upper, lower = mid + width * std, mid - width * std
    return {
        "bb_middle": mid, "bb_upper": upper, "bb_lower": lower, "bb_std": std,
        "bb_width": (upper - lower) / F.nullif(mid, F.lit(0.0)), "bb_pct_b": (x - lower) / F.nullif(upper - lower, F.lit(0.0)),
    }


def counted(df: DataFrame, x: str, key: str = "symbol") -> DataFrame:
    """``df`` with ``<x>_seen`` (values of ``x`` so far) and ``<x>_gap`` (rows since the value before), carried over blocks."""
    here = F.col(x).isNotNull()
    blocks = df.groupBy(key, "block").agg(F.count(x).alias("_n"), F.max(F.when(here, F.col("pos"))).alias("_last"))
    ahead = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(key, "block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n"), F.max("_last").over(ahead).alias("_last"))
    rows = Window.partitionBy(key, "block").orderBy("pos")
    last = F.coalesce(F.max(F.when(here, F.col("pos"))).over(rows.rowsBetween(Window.unboundedPreceding, -1)), F.col("_last"))
    seen = F.col("_n") + F.count(x).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    return df.join(carry, [key, "block"]).withColumns({f"{x}_gap": F.col("pos") - last, f"{x}_seen": seen}).drop("_n", "_last")


def ema_step(x: str, span: int) -> tuple[Column, Column]:
    """(a, b) of the exponential average of ``x`` with weight 2 / (span + 1), after ``counted``.

    The first value starts it; over a gap the old weight decays with each row, as rows without a value count as time.
    """
    alpha = 2.0 / (check_window(span, "span") + 1)
    old = F.pow(F.lit(1 - alpha), F.col(f"{x}_gap"))
    a = F.when(F.col(f"{x}_seen") == 1, 0.0).otherwise(old / (old + alpha))
    b = F.when(F.col(f"{x}_seen") == 1, F.col(x)).otherwise(F.lit(alpha) * F.col(x) / (old + alpha))
    return a, F.when(F.col(x).isNotNull(), b)


def wilder_step(x: str, period: int) -> tuple[Column, Column]:
    """(a, b) of Wilder's average of ``x``: the mean of the first ``period`` values, then (old · (period - 1) + x) / period.

    A missing value counts as 0 after the first mean and is passed over before.
    """
    p, seen = float(check_window(period, "period")), F.col(f"{x}_seen")
    a = F.when(seen == 1, 0.0).when(seen < p, 1.0).when((seen == p) & F.col(x).isNotNull(), 1 / p).otherwise((p - 1) / p)
    b = F.when(seen < p, F.col(x)).otherwise(F.coalesce(F.col(x), F.lit(0.0)) / p)
    return a, F.when(seen > 0, b)


def composed_steps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """out[t] = a[t] · out[t-1] + b[t] with nothing before, in as many whole-array steps as the logarithm of the length."""
    a, b, d = a.copy(), b.copy(), 1
    while d < len(a):
        b[d:] = b[d:] + a[d:] * b[:-d]
        a[d:] = a[d:] * a[:-d]
        d *= 2
    return b


def linear_scans(df: DataFrame, steps: dict[str, tuple[Column, Column]], key: str = "symbol") -> DataFrame:
    """``df`` (key, block, pos, …) with recurrences ``out[t] = a[t] · out[t-1] + b[t]`` along each series.

    ``steps`` gives (a, b) of each output.  Rows whose b is NULL are passed over and have no output; the first row of a series
    must have a = 0.  The steps of each block are composed to one linear function, the functions are carried along
    the series (one row a block), and each block is then run from the value that comes in.
    """
    names = list(steps)
    rows = df.withColumns({f"_{k}{i}": c for i, name in enumerate(names) for k, c in zip("ab", steps[name], strict=True)})

    def composed(i: int) -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col(f"_b{i}").isNotNull(), F.struct("pos", f"_a{i}", f"_b{i}"))))
        start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        return F.aggregate(ordered, start, lambda s, x: F.struct((s["a"] * x[f"_a{i}"]).alias("a"), (x[f"_a{i}"] * s["b"] + x[f"_b{i}"]).alias("b")))

    blocks = rows.groupBy(key, "block").agg(*[composed(i).alias(f"_f{i}") for i in range(len(names))])
    flat = blocks.select(key, "block", *[F.col(f"_f{i}.{k}").alias(f"_{k}{i}") for i in range(len(names)) for k in "ab"])
    carried = ", ".join(f"_in{i} double" for i in range(len(names)))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        for i in range(len(names)):
            ends = composed_steps(pdf[f"_a{i}"].to_numpy(dtype=float), pdf[f"_b{i}"].to_numpy(dtype=float))
            pdf[f"_in{i}"] = np.insert(ends[:-1], 0, 0.0)
        return pdf[[key, "block", *[f"_in{i}" for i in range(len(names))]]]

    kind = dict(df.dtypes)[key]
    incoming = flat.groupBy(key).applyInPandas(carry, f"`{key}` {kind}, block long, {carried}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        for i, name in enumerate(names):
            a, b = pdf[f"_a{i}"].to_numpy(dtype=float), pdf[f"_b{i}"].to_numpy(dtype=float)
            here = ~np.isnan(b)
            a, b = np.where(here, a, 1.0), np.where(here, b, 0.0)
            b[0] += a[0] * pdf[f"_in{i}"].iloc[0]
            pdf[name] = pd.Series(np.where(here, composed_steps(a, b), np.nan), index=pdf.index).astype("Float64").where(here)
        return pdf[[key, "pos", *names]]

    small = rows.select(key, "block", "pos", *[f"_{k}{i}" for i in range(len(names)) for k in "ab"])
    done = small.join(incoming, [key, "block"]).groupBy(key, "block").applyInPandas(run, f"`{key}` {kind}, pos long, " + ", ".join(f"`{n}` double" for n in names))
    return df.join(done, [key, "pos"])


def ema(df: DataFrame, x: str, span: int, out: str, key: str = "symbol") -> DataFrame:
    """Exponential moving average, hidden until ``span`` values were seen (``df`` has positions)."""
    scanned = linear_scans(counted(df, x, key), {out: ema_step(x, span)}, key)
    return scanned.withColumn(out, F.when(F.col(f"{x}_seen") >= span, F.col(out))).drop(f"{x}_seen", f"{x}_gap")


def with_indicators(bars: DataFrame, key: str = "symbol", names: list[str] | None = None, fast: int = 12, slow: int = 26, signal: int = 9, period: int = 14) -> DataFrame:
    """Clean ``bars`` (symbol, ts, close, …) with the indicators ``names``, or all thirteen.

    sma_50, sma_200, rsi_14, macd (12, 26), macd_signal (9), macd_hist, Bollinger bands (20, 2), volatility_30d.  Values in warm-up
    are NULL.  Only what is asked for is worked out: frames in one pass without an intermediate table, recurrences in one more, the
    signal line in another, all partitioned by series and block; no task holds a whole series.

    Raises KeyError where a column is missing, and ValueError for an unknown indicator, a window that is no positive integer or
    ``fast`` not below ``slow``.
    """
    names = list(INDICATORS) if names is None else list(names)
    if missing := [c for c in (key, "ts", "close") if c not in bars.columns]:
        raise KeyError(f"bars lack {missing}")
    if unknown := [n for n in names if n not in INDICATORS]:
        raise ValueError(f"no such indicator: {unknown}")
    if check_window(fast, "fast") >= check_window(slow, "slow"):
        raise ValueError("fast must be below slow")
    check_window(signal, "signal"), check_window(period, "period")
    wanted, close = set(names), F.col("close")
    macd, rsi, lines = bool(wanted & {"macd", "macd_signal", "macd_hist"}), "rsi_14" in wanted, bool(wanted & {"macd_signal", "macd_hist"})
    frames = {"sma_50": lambda: sma(close, 50, key), "sma_200": lambda: sma(close, 200, key), "volatility_30d": lambda: over_full(F.stddev_samp("_change"), F.col("_change"), 30, key) * math.sqrt(252)}
    reach = max([1, *[n for name, n in (("sma_50", 50), ("sma_200", 200), ("volatility_30d", 31)) if name in wanted], *[20 for n in wanted if n.startswith("bb_")]])
    near = with_halo(with_positions(clean_bars(bars), key), reach)
    step = close - previous(close, key)
    before = {"_change": F.ln(close) - F.ln(previous(close, key))} if "volatility_30d" in wanted else {}
    if rsi:
        before |= {"gain": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "loss": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))}
    after = {name: frame() for name, frame in frames.items() if name in wanted} | {name: band for name, band in bollinger(close, key=key).items() if name in wanted}
    out = (near.withColumns(before) if before else near)
    out = (out.withColumns(after) if after else out).where("not halo").drop("halo", "_change")
    columns = [*bars.columns, "pos", "block", *names]
    if not macd and not rsi:
        return out.select(*columns)
    # close has no gaps here, and gain and loss begin at the second row
    out = written(out.withColumns({"close_seen": F.col("pos"), "close_gap": F.lit(1), "gain_seen": F.col("pos") - 1, "loss_seen": F.col("pos") - 1}), "framed")  # a scan reads its input three times
    scans = ({"_fast": ema_step("close", fast), "_slow": ema_step("close", slow)} if macd else {}) | ({"_gain": wilder_step("gain", period), "_loss": wilder_step("loss", period)} if rsi else {})
    out = linear_scans(out, scans, key)
    if rsi:
        up, down = F.col("_gain"), F.col("_loss")
        value = F.when(F.col("gain_seen") >= period, F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).when(up == 0, 0.0).otherwise(100 - 100 / (1 + up / down)))
        out = out.withColumn("rsi_14", finite(value))
    if macd:
        out = out.withColumn("macd", F.when(F.col("pos") >= slow, F.col("_fast") - F.col("_slow")))
    if lines:
        out = written(out, "first-scan")
        out = linear_scans(out.withColumns({"macd_seen": F.greatest(F.col("pos") - (slow - 1), F.lit(0)), "macd_gap": F.lit(1)}), {"macd_signal": ema_step("macd", signal)}, key)
        out = out.withColumn("macd_signal", F.when(F.col("macd_seen") >= signal, F.col("macd_signal")))
        out = out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    return out.select(*columns)


#: Columns that with_indicators adds.
INDICATORS = ["sma_50", "sma_200", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_middle", "bb_upper", "bb_lower", "bb_std", "bb_width", "bb_pct_b", "volatility_30d"]
