"""Structured Streaming twins: bars from ticks, tool summaries from a growing log, rows whose key is new, texts that are new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspan.operators import similarity
from quillspan.operators.similarity import NEAR
from quillspan.shared import new_path, written


def bars_stream(ticks: DataFrame, key: str, ts: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a stream of ticks (symbol, ts, open, high, low, close, volume); rows later than ``late`` are left out."""
    at = F.struct(F.col(ts), F.col(value))
    timed = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).where(F.col(value).isNotNull() & F.col(key).isNotNull())
    bars = timed.groupBy(F.col(key).alias("symbol"), F.window(ts, width)).agg(F.min(at)[value].alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max(at)[value].alias("close"), F.count("*").alias("volume"))
    return bars.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def summary_stream(log: DataFrame, by: list[str]) -> DataFrame:
    """Calls, failures and mean milliseconds of each group of a growing log."""
    return log.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


def first_seen_stream(rows: DataFrame, key: str, ts: str, ttl: str = "24 hours") -> DataFrame:
    """Rows whose key was not seen within ``ttl``."""
    return rows.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def last_known_stream(cache: DataFrame, key: str, ts: str, value: str, ttl: str = "24 hours") -> DataFrame:
    """(key, value, ts): the last value of each key within windows of ``ttl``; state that is older than that is given up."""
    at = F.struct(F.col(ts), F.col(value))
    return cache.withWatermark(ts, ttl).groupBy(F.col(key), F.window(ts, ttl)).agg(F.max(at).alias("_x")).select(key, F.col(f"_x.{value}").alias(value), F.col(f"_x.{ts}").alias(ts))


def guard_stream(docs: DataFrame, by: list[str], threshold: float = NEAR, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, StreamingQuery]:
    """(outcome, query): the duplicate guard over texts as they arrive; outcome has (by…, id, accepted) of all texts so far.

    Each batch is held against all texts accepted in batches before it, and what is left goes through the guard of the batch in order of
    id.  Accepted vectors are the state, a table in the shared folder; a batch that is run again overwrites what it
    wrote, so every text is decided once.  NULL texts are left out, texts without a gram accepted.
    """
    spark = docs.sparkSession
    out, kept, state = new_path(spark, "guard-out"), new_path(spark, "guard-kept"), new_path(spark, "guard-state")
    kinds = dict(docs.dtypes)
    vector = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"id {kinds[id]}, grams array<bigint>, weights array<double>"])

    def take(batch: DataFrame, number: int) -> None:
        batch = written(batch.select(*by, id, text).where(F.col(text).isNotNull()), "guard-batch")
        hit = batch.select(*by, F.col(id).alias("id")).limit(0)
        if number:
            before = [f"{kept}/batch={n}" for n in range(number)]
            hit = similarity.near_ids(spark.read.schema(vector).parquet(*before), similarity.vectors(batch, by, id, text), by, threshold)
        hit = written(hit.withColumnRenamed("id", id), "guard-hit")
        fresh = written(similarity.matched(batch, hit, by, [id], "left_anti"), "guard-fresh")
        decided = written(similarity.duplicate_guard(fresh, by, threshold, id, text), "guard-decided")
        new = similarity.matched(fresh, decided.where("accepted").select(*by, id), by, [id], "left_semi")
        similarity.vectors(new, by, id, text).write.mode("overwrite").parquet(f"{kept}/batch={number}")
        decided.unionByName(hit.withColumn("accepted", F.lit(False))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = docs.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"`{id}` {kinds[id]}, accepted boolean, batch int"])
    return spark.read.schema(schema).parquet(out).drop("batch"), query


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return its result, kept in the shared folder.

    ``complete`` keeps each batch's whole result (the last one is returned), ``append`` adds to it.
    """
    spark: SparkSession = stream.sparkSession
    out, state = new_path(spark, "stream-out"), new_path(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out) if mode == "complete" else batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
