import datetime as dt
import math
import random

import pytest
import ref
from pyspark.sql import functions as F

from quillspan.operators import series as s
from quillspan.operators import signals as g

START = dt.datetime(2024, 12, 30, 9, 0)


def bars(spark, closes, symbols=("A",), shuffle=True):
    rows = [(sym, START + dt.timedelta(minutes=5 * i), c, 10 + i) for sym in symbols for i, c in enumerate(closes)]
    if shuffle:
        random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volume long")


def closes(n, seed=2):
    rng, out, x = random.Random(seed), [], 100.0
    for _ in range(n):
        x *= 1 + rng.gauss(0, 0.01)
        out.append(round(x, 4))
    return out


def near(a, b, tol=1e-9):
    assert len(a) == len(b)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        assert (x is None) == (y is None), i
        assert x is None or abs(x - y) <= tol * max(1, abs(y)), (i, x, y)


def column(df, name, sym="A"):
    return [r[0] for r in df.where(F.col("symbol") == sym).orderBy("ts").select(name).collect()]


def test_indicators_against_loops(spark):
    x = closes(320)
    e = s.with_indicators(bars(spark, x, ("A", "B"))).cache()
    near(column(e, "sma_50"), ref.sma(x, 50))
    near(column(e, "sma_200", "B"), ref.sma(x, 200))
    near(column(e, "rsi_14"), ref.rsi(x), 1e-8)
    line = [a - b if b is not None else None for a, b in zip(ref.ema(x, 12), ref.ema(x, 26), strict=True)]
    near(column(e, "macd"), line, 1e-8)
    near(column(e, "macd_signal"), ref.ema(line, 9), 1e-8)
    near(column(e, "volatility_30d"), ref.volatility(x), 1e-8)
    first = {n: min(r["pos"] for r in e.where(f"symbol = 'A' and {n} is not null").select("pos").collect()) - 1 for n in ("sma_50", "sma_200", "rsi_14", "macd", "macd_signal", "bb_middle", "volatility_30d")}
    assert first == {"sma_50": 49, "sma_200": 199, "rsi_14": 14, "macd": 25, "macd_signal": 33, "bb_middle": 19, "volatility_30d": 30}


@pytest.mark.parametrize("block", [7, 64])
def test_recurrences_over_blocks_and_gaps(spark, block):
    x = closes(100)
    for i in (0, 17, 18, 40, 63, 64):
        x[i] = None
    placed = s.with_positions(bars(spark, x), block=block)
    near(column(s.ema(placed, "close", 5, "e"), "e"), ref.ema(x, 5))


def test_rsi_limits(spark):
    up, down, flat = ([100.0 + i for i in range(40)], [100.0 - i for i in range(40)], [100.0] * 40)
    for values, want in ((up, 100.0), (down, 0.0), (flat, 50.0)):
        assert column(s.with_indicators(bars(spark, values)), "rsi_14")[-1] == want


def test_cleaning(spark):
    ts = START
    rows = [("A", ts, 1.0, 5), ("A", ts, 2.0, 9), ("A", ts + dt.timedelta(1), None, 1), ("A", ts + dt.timedelta(2), -1.0, 1), ("A", ts + dt.timedelta(3), math.nan, 1), (None, ts, 3.0, 1), ("B", None, 3.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double, volume long")
    assert [(r.symbol, r.close) for r in s.clean_bars(df).collect()] == [("A", 2.0)]


def test_empty_and_short(spark):
    empty = bars(spark, [])
    assert s.with_indicators(empty).count() == 0
    one = g.momentum(g.latest(s.with_indicators(bars(spark, [5.0])))).collect()[0]
    assert one.momentum_score == 0.0 and one.momentum_label == "neutral" and len(one.missing) == 5
    assert g.summarise(s.with_indicators(bars(spark, closes(30)))).count() == 1


def test_year_to_date(spark):
    x = closes(1200)
    df = bars(spark, x)
    out = g.year_to_date(df).collect()[0]
    last_of_year = max(i for i in range(1200) if (START + dt.timedelta(minutes=5 * i)).year == 2024)
    assert out.baseline == x[last_of_year] and out.last_value == x[-1]
    same = g.year_to_date(df.where("ts >= '2025-01-01'")).collect()[0]
    assert same.baseline == x[last_of_year + 1]


def test_windows_are_checked():
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            s.check_window(bad)


def test_guards_and_windows(spark):
    from pyspark.sql import functions as F

    bars = spark.createDataFrame([("a", f"2024-01-0{i} 00:00:00", float(i)) for i in range(1, 8)] + [("a", "2024-01-07 00:00:00", 7.0), ("a", "2024-01-09 00:00:00", -1.0), (None, "2024-01-09 00:00:00", 1.0)], "symbol string, ts string, close double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for bad in ({"fast": 26, "slow": 12}, {"fast": 12, "slow": 12}, {"signal": 0}, {"period": 2.5}, {"names": ["sma_9"]}):
        with pytest.raises(ValueError):
            s.with_indicators(bars, **bad)
    with pytest.raises(KeyError):
        s.with_indicators(bars.drop("close"))
    assert {(r.symbol, r.rows, r.invalid, r.repeated, r.kept) for r in s.dropped_bars(bars).collect()} == {("a", 9, 1, 1, 7), (None, 1, 1, 0, 0)}
    now = F.lit("2024-01-05 10:00:00").cast("timestamp")
    assert s.in_window(bars, now, years=1, buffer_days=0).count() == 4
    with pytest.raises(ValueError):
        s.required(bars.where("false"), "bars")
    assert s.required(bars, "bars") is bars
    only = s.with_indicators(bars, names=["rsi_14"], period=3).orderBy("pos").collect()
    assert only[0].asDict().keys() == {"symbol", "ts", "close", "pos", "block", "rsi_14"} and [r.rsi_14 for r in only] == [None] * 3 + [100.0] * 4
