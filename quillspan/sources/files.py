"""Sources and sinks: feeds, logs, splits, keyed caches, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.operators.clean import unescape

CHAT = "rec_id bigint, messages array<struct<role:string,content:string>>, metadata struct<clause_type:string,industry:string,jurisdiction:string,complexity:string,edge_case:string,generation_attempts:int>"
TRACE = "run_id string, seq int, timestamp string, agent string, tool string, inputs map<string,string>, output string, output_truncated boolean, output_full_length int, duration_ms double, duration_s double, ok boolean, error string"


def read_rss(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Headlines of RSS 2.0 files: unescaped title, publication text and link of each item; items without a title are left out."""
    schema = "title string, pubDate string, link string"
    items = spark.read.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(schema).load(path)
    return items.where(F.trim("title") != "").select(F.lit(source).alias("source"), F.trim(unescape(F.col("title"))).alias("headline"), F.col("pubDate").alias("published"), F.col("link").alias("url"))


def read_news_json(spark: SparkSession, path: str) -> DataFrame:
    """News lines whose fields stand under ``content`` or at the top; epoch seconds become ISO text."""
    inner = "title string, pubDate string, provider struct<displayName:string>, canonicalUrl struct<url:string>, clickThroughUrl struct<url:string>"
    schema = f"content struct<{inner}>, title string, publisher string, link string, providerPublishTime bigint"
    raw = spark.read.schema(schema).json(path)
    iso = F.date_format(F.timestamp_seconds("providerPublishTime"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return raw.select(
        F.coalesce("content.provider.displayName", "publisher").alias("source"), F.coalesce("content.title", "title").alias("headline"), F.coalesce("content.pubDate", iso).alias("published"),
        F.coalesce("content.canonicalUrl.url", "content.clickThroughUrl.url", "link").alias("url"),
    ).where(F.trim("headline") != "")


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """News answers with a list ``articles``, one row an article."""
    schema = "articles array<struct<title:string,publishedAt:string,url:string,source:struct<name:string>>>"
    each = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("articles").alias("a"))
    return each.where(F.trim("a.title") != "").select(F.col("a.source.name").alias("source"), F.col("a.title").alias("headline"), F.col("a.publishedAt").alias("published"), F.col("a.url").alias("url"))


def read_strict(spark: SparkSession, path: str, schema: str = CHAT) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_log(spark: SparkSession, path: str, schema: str = TRACE) -> DataFrame:
    """JSON lines of a log; bad lines stay as rows with their text in ``corrupt``, bad timestamps are NULL."""
    typed = T._parse_datatype_string(schema).add("corrupt", T.StringType())
    raw = spark.read.schema(typed).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)
    return raw.withColumn("timestamp", F.try_to_timestamp("timestamp")) if "timestamp" in raw.columns else raw


def append_log(rows: DataFrame, path: str, cuts: dict[str, int] | None = None) -> None:
    """Append rows as JSON lines; columns in ``cuts`` are cut at so many characters."""
    for name, length in (cuts or {}).items():
        rows = rows.withColumn(name, F.left(F.col(name), F.lit(length)))
    rows.write.mode("append").json(path)


def upsert_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions of ``rows`` by key, leave all others.

    A failed job leaves all partitions as they were.  The commit itself removes and moves folders one after the other, so who reads
    meanwhile may find a partition missing, and should read again.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, changed) of the files of a folder of JSON or Parquet, unreadable ones as well."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def clear_key(spark: SparkSession, path: str, key: str, value: str | None = None) -> int:
    """Delete the partition ``key=value`` of a folder, or all of them; the number deleted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(path, f"{key}={value or '*'}")) or []
    return sum(bool(fs.delete(status.getPath(), True)) for status in found)


def write_splits(rows: DataFrame, path: str, split: str = "split", kind: str | None = None) -> DataFrame:
    """Write JSON lines by split and return the manifest, see ``manifest``."""
    rows.write.mode("overwrite").partitionBy(split).json(path)
    return manifest(rows, split, kind)


def manifest(rows: DataFrame, split: str = "split", kind: str | None = None) -> DataFrame:
    """(split, n, share) of each split, and where ``kind`` names a column, ``types``: a map from its values to their rows."""
    counts = rows.groupBy(split, *([F.coalesce(F.col(kind), F.lit("null")).alias("_k")] if kind else [])).agg(F.count("*").alias("c"))
    types = [F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "c")))).alias("types")] if kind else []  # one entry a value
    by = counts.groupBy(split).agg(F.sum("c").alias("n"), *types)
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select(split, "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), *(["types"] if kind else []))


def write_pages(rows: DataFrame, page: Column, path: str) -> None:
    """Write one text a row, such as ``evaluation.review_sheet``, as text files."""
    rows.select(page.alias("value")).write.mode("overwrite").text(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """Write rows as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def brief_text(title: Column, facts: dict[str, Column], html: bool = False) -> Column:
    """A short report of one row as Markdown, or as HTML; NULL facts read 'unavailable'."""
    shown = {k: F.coalesce(v.cast("string"), F.lit("unavailable")) for k, v in facts.items()}
    if html:
        safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        rows = [F.concat(F.lit(f"<tr><th>{k}</th><td>"), safe(v), F.lit("</td></tr>")) for k, v in shown.items()]
        return F.concat(F.lit("<h1>"), safe(title), F.lit("</h1>\n<table>\n"), F.concat_ws("\n", *rows), F.lit("\n</table>"))
    return F.concat_ws("\n", F.concat(F.lit("# "), title), F.lit(""), *[F.concat(F.lit(f"- {k}: "), v) for k, v in shown.items()])
