import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspan.operators.instants import extend_dictionary, normalise_instants, parse_instant
from quillspan.skew import ordered_positions, salted_lookup, salted_pairs


def us(*parts, **zone):
    return int((dt.datetime(*parts) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)


CASES = [
    ("2026-03-01T10:00:00Z", "Asia/Tokyo", "YMD", us(2026, 3, 1, 10)),
    ("2026-03-01 10:00:00,123456+09:00", "UTC", "YMD", us(2026, 3, 1, 1, 0, 0, 123456)),
    ("2026-03-01T10:00", "Asia/Tokyo", "YMD", us(2026, 3, 1, 1)),
    ("03/04/2026 05:06", "Europe/London", "DMY", us(2026, 4, 3, 4, 6)),
    ("03/04/2026 05:06", "America/New_York", "MDY", us(2026, 3, 4, 10, 6)),
    ("Tuesday, 31-Mar-26 18:31:06 GMT", "Europe/London", "DMY", us(2026, 3, 31, 18, 31, 6)),
    ("Sep. 11, 2025 9:10 PM ET", "UTC", "MDY", us(2025, 9, 12, 1, 10)),
    ("12:30 AM", "UTC", "YMD", None),
    ("Jan 2, 2026 12:30 AM", "UTC", "MDY", us(2026, 1, 2, 0, 30)),
    ("13. Mai 2026, 04:45 Uhr", "Europe/Berlin", "DMY", us(2026, 5, 13, 2, 45)),
    ("25 février 2026 à 17h33", "Europe/Paris", "DMY", us(2026, 2, 25, 16, 33)),
    ("2026年6月11日 14時48分", "Asia/Tokyo", "YMD", us(2026, 6, 11, 5, 48)),
    ("18.06.2026 12:22 MESZ", "UTC", "DMY", us(2026, 6, 18, 10, 22)),
    ("2026-05-23 21:29 UTC+8", "UTC", "YMD", us(2026, 5, 23, 13, 29)),
    ("2026-08-05T05:26:25+02:00[Europe/Paris]", "UTC", "YMD", us(2026, 8, 5, 3, 26, 25)),
    ("2025-11-01 23:48:00 America/New_York", "UTC", "MDY", us(2025, 11, 2, 3, 48)),
    ("1774376550", "UTC", "YMD", 1774376550_000000),
    ("1767433718874", "UTC", "YMD", 1767433718874_000),
    ("1781661718357140", "UTC", "YMD", 1781661718357140),
    ("1779739054.949", "UTC", "YMD", 1779739054949000),
    ("20260226033721", "Asia/Tokyo", "YMD", us(2026, 2, 25, 18, 37, 21)),
    ("20251224T004333Z", "Asia/Tokyo", "YMD", us(2025, 12, 24, 0, 43, 33)),
    ("946684800", "UTC", "YMD", 946684800_000000),
    ("Mon Mar 4 09:15:00 EST 2024", "UTC", "MDY", us(2024, 3, 4, 14, 15)),
    ("Mon Mar  4 09:15:00 2024", "Asia/Tokyo", "MDY", us(2024, 3, 4, 0, 15)),
    ("4th of March 2024 09:15", "UTC", "DMY", us(2024, 3, 4, 9, 15)),
    ("9:15 AM, March 4 2024", "UTC", "MDY", us(2024, 3, 4, 9, 15)),
    ("14:05 GMT, 4 March 2024", "Asia/Tokyo", "DMY", us(2024, 3, 4, 14, 5)),
    ("09:15 on Monday, 04/03/2024", "UTC", "DMY", us(2024, 3, 4, 9, 15)),
    ("2024-03-04 9 PM", "UTC", "YMD", us(2024, 3, 4, 21)),
    ("2024-W10-1T09:15", "UTC", "YMD", us(2024, 3, 4, 9, 15)),
    ("2024-064T09:15Z", "Asia/Tokyo", "YMD", us(2024, 3, 4, 9, 15)),
    ("2023-366T09:15Z", "UTC", "YMD", None),
    ("9:15 AM, soon", "UTC", "MDY", None),
    # twice: the earlier; skipped: the offset before the change
    ("2025-11-02 01:30", "America/New_York", "MDY", us(2025, 11, 2, 5, 30)),
    ("2026-03-08 02:30", "America/New_York", "MDY", us(2026, 3, 8, 7, 30)),
    ("2026-03-29 02:30", "Europe/Berlin", "DMY", us(2026, 3, 29, 1, 30)),
    ("2026-07-01 10:00:00 EST", "America/New_York", "MDY", us(2026, 7, 1, 15)),
    ("2026-07-01 10:00:00 IST", "Asia/Kolkata", "DMY", us(2026, 7, 1, 4, 30)),
    (" \t2026-07-01T10:00:00z\n", "UTC", "YMD", us(2026, 7, 1, 10)),
    *[(x, "UTC", "YMD", None) for x in (None, "", "  ", "yesterday", "n/a", "2026-06", "2026-03-11", "25:71", "2026-02-30 10:15:00", "2026-13-05T08:00:00Z", "0000-00-00 00:00:00", "Thu, 32 Jan 2026 10:00:00 GMT", "2026-01-01 24:00:00", "2026-01-01 10:60", "x" * 100_000)],
    ("31/04/2026 09:10", "Europe/London", "DMY", None),
    ("2026-01-01 10:00", None, "YMD", None),
    ("2026-01-01 10:00Z", None, None, us(2026, 1, 1, 10)),
]


@pytest.mark.parametrize("text,zone,order,want", CASES)
def test_parse(text, zone, order, want):
    assert parse_instant(text, zone, order) == want


def test_rows(spark, tmp_path):
    feeds = spark.createDataFrame([("a", "Asia/Tokyo", "YMD"), ("b", "UTC", "DMY"), ("b", "UTC", "DMY"), (None, "UTC", "YMD")], "source string, home_zone string, date_order string")
    rows = [(1, "a", "2026-01-01 09:00", "x"), (2, "b", "2026-01-01 09:00", None), (2, "b", "2026-01-01 09:00", None), (3, None, "2026-01-01 09:00", "y"), (4, "z", "2026-01-01T09:00Z", "y"), (5, "a", None, "y"), (6, "a", "soon", "y")]
    df = spark.createDataFrame(rows, "item_id long, source string, published string, instant_us string")
    path = f"file://{tmp_path}/known"
    got = sorted((r.item_id, r.instant_us) for r in normalise_instants(df, feeds, dictionary=path).collect() if r.instant_us is not None)
    assert got == [(1, us(2026, 1, 1)), (2, us(2026, 1, 1, 9)), (2, us(2026, 1, 1, 9)), (4, us(2026, 1, 1, 9))]
    out = normalise_instants(df, feeds, dictionary=path)
    assert out.count() == 7 and out.columns == ["item_id", "source", "published", "instant_us"]
    # the second run parsed nothing again
    assert spark.read.parquet(path).count() == 5
    assert normalise_instants(df.limit(0), feeds).count() == 0
    values = df.where("false").selectExpr("source as key", "source as zone", "source as date_order", "published as raw")
    assert extend_dictionary(values, path).count() == 5
    # an entry that two writers added counts once
    spark.read.parquet(path).write.mode("append").parquet(path)
    assert normalise_instants(df, feeds, dictionary=path).count() == 7


def test_second_run_parses_nothing(spark, tmp_path):
    from quillspan.operators import instants
    from quillspan.plans.problems import p1_found

    feeds = spark.createDataFrame([("a", "Asia/Tokyo", "YMD")], "source string, home_zone string, date_order string")
    heads = spark.createDataFrame([(i, "a", f"2026-01-01 0{i % 10}:00") for i in range(40)], "item_id long, source string, published string")
    feeds.write.parquet(f"{tmp_path}/feeds.parquet")
    heads.write.parquet(f"{tmp_path}/headlines.parquet")
    first = {tuple(r) for r in p1_found(spark, str(tmp_path)).collect()}
    path = instants.dictionary_path(spark)
    before = spark.read.parquet(path).count()
    assert {tuple(r) for r in p1_found(spark, str(tmp_path)).collect()} == first and len(first) == 40
    assert spark.read.parquet(path).count() == before


def test_shared_folder(spark):
    from quillspan.shared import new_path, release, shared_dir, written

    df = written(spark.range(3).toDF("x"), "t")
    assert df.count() == 3 and new_path(spark, "t").startswith(shared_dir(spark))
    release(spark)
    with pytest.raises(Exception, match="(?i)not.*exist|not_exist"):
        df.count()

    class Unnamed:
        """A session on a cluster that names no shared folder."""

        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": staticmethod(dict)})

    with pytest.raises(RuntimeError):
        shared_dir(Unnamed)


def test_salted_lookup(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").when(F.col("id") < 900, F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    dim = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    inner, left = salted_lookup(rows, dim, "key", hot_rows=50), salted_lookup(rows, dim, "key", how="left", hot_rows=50)
    assert inner.count() == 900 and left.count() == 1000 and left.where("top is null").count() == 100
    assert inner.where("key = 'hot'").agg(F.min("top"), F.max("top")).first() == (699, 699)
    # without a hot key the lookup is a plain join
    assert salted_lookup(rows, dim, "key").count() == 900 and salted_lookup(rows, dim, "key", how="left").count() == 1000
    assert salted_lookup(rows, dim.limit(0), "key").count() == 0 and salted_lookup(rows.limit(0), dim, "key", hot_rows=50).count() == 0


def test_salted_pairs(spark):
    left = spark.range(300).select(F.col("id").alias("a"), F.when(F.col("id") < 200, "hot").when(F.col("id") < 290, F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    right = spark.range(90).select(F.col("id").alias("b"), F.when(F.col("id") < 60, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("key"))
    want = {(r.key, r.a, r.b) for r in left.join(right, "key").collect()}
    for hot_rows in (None, 50, 100):
        got = [(r.key, r.a, r.b) for r in salted_pairs(left, right, "key", hot_rows=hot_rows).collect()]
        assert len(got) == len(want) and set(got) == want
    assert salted_pairs(left.limit(0), right, "key").count() == 0


def test_ordered_positions(spark):
    import random

    rows = [(random.Random(i).choice(["hot", "hot", "a", None]), (i * 37) % 500, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o long, position long")
    got = ordered_positions(df, ["k"], ["o"], "p").collect()
    want = {}
    for k, o, _ in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.setdefault(k, []).append(o)
    assert len(got) == 500 and all(want[r.k][r.p - 1] == r.o for r in got) and got[0].asDict().keys() == {"k", "o", "position", "p"}
    assert ordered_positions(df.limit(0), ["k"], ["o"], "p").count() == 0
