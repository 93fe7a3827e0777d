"""Tool-call logs, caches and briefs: summaries, latest entries, lookups with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.skew import ordered_positions


def tool_summary(trace: DataFrame, by: list[str]) -> DataFrame:
    """Calls, failures, total, mean and longest milliseconds of each group; a NULL ``ok`` counts as no failure."""
    return trace.groupBy(*by).agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.sum("duration_ms"), 6).alias("total_ms"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.round(F.max("duration_ms"), 6).alias("max_ms")
    )


#: Numbers of a run's calls that are put in order together.
PATH_CALLS = 4096


def run_paths(trace: DataFrame) -> DataFrame:
    """(run_id, part, tool_path): the tools of each run in order of seq as text, PATH_CALLS numbers a part, so that no task holds a whole run."""
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "call_id", "tool"))), lambda x: x["tool"]), ">")
    return trace.groupBy("run_id", F.floor(F.coalesce("seq", F.lit(0)) / F.lit(PATH_CALLS)).alias("part")).agg(path.alias("tool_path"))


def runs(trace: DataFrame) -> DataFrame:
    """(run_id, calls, started, failures, tools, path): one row a run; ``path`` is a digest of the order of its tools, from ``run_paths``."""
    sums = trace.groupBy("run_id").agg(F.count("*").alias("calls"), F.min("timestamp").alias("started"), F.count_if(~F.col("ok")).alias("failures"), F.array_sort(F.collect_set("tool")).alias("tools"))
    parts = run_paths(trace).select("run_id", "part", F.md5("tool_path").alias("digest"))
    paths = parts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("part", "digest"))).alias("p")).select(F.col("run_id").alias("_r"), F.md5(F.array_join(F.transform("p", lambda x: x["digest"]), ",")).alias("path"))
    return sums.join(paths, F.col("run_id").eqNullSafe(F.col("_r"))).drop("_r")


def without_repeats(trace: DataFrame) -> DataFrame:
    """Log lines flushed twice under a new id, once: the line with the smallest call_id of those alike in all else."""
    rest = [c for c, kind in trace.dtypes if c != "call_id" and not kind.startswith("map")]
    maps = [c for c, kind in trace.dtypes if kind.startswith("map")]
    flat = trace.withColumns({f"_m_{c}": F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) for c in maps})
    kept = flat.groupBy(*rest, *[f"_m_{c}" for c in maps]).agg(F.min_by(F.struct("call_id", *maps), "call_id").alias("_x"))
    return kept.select(*[F.col(f"_x.{c}").alias(c) if c == "call_id" or c in maps else F.col(c) for c in trace.columns])


def overall(trace: DataFrame) -> DataFrame:
    """One row: calls, failures, seconds, slowest call, runs, agents."""
    return trace.agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failures"), F.round(F.sum("duration_ms") / 1000, 3).alias("seconds"), F.max("duration_ms").alias("slowest_ms"),
        F.count_distinct("run_id").alias("runs"), F.count_distinct("agent").alias("agents"),
    )


def matrix(trace: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """Counts of ``rows`` × ``columns``, 0 where none; ``values`` names the columns, so no pass is needed to find them."""
    return trace.groupBy(rows).pivot(columns, values).count().na.fill(0)


def tool_violations(trace: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """(agent, used, violations): sorted tools that an agent used, and those it may not; agents without a list may use none."""
    used = trace.groupBy("agent").agg(F.array_sort(F.collect_set("tool")).alias("used"))
    lists = F.create_map(*[x for a, tools in allowed.items() for x in (F.lit(a), F.array(*map(F.lit, tools)))])
    may = F.coalesce(F.try_element_at(lists, F.col("agent")), F.array().cast("array<string>"))
    return used.select("agent", F.array_join("used", ",").alias("used"), F.array_join(F.array_except("used", may), ",").alias("violations"))


def dense_counts(df: DataFrame, by: list[str], metric: dict[str, Column]) -> DataFrame:
    """Aggregates of each group under given names."""
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in metric.items()])


def cache_lookup(wanted: DataFrame, cache: DataFrame, now: Column, hours: int = 24, bypass: Column | None = None, json: bool = False) -> DataFrame:
    """(ticker, as_of, hit, reason) of each wanted (ticker, as_of): bypass, missing, corrupt, no report, bad stamp, stale or hit.

    ``cache`` has ticker, as_of, cached_at and report; of several entries the last cached counts.  With ``json`` a report that is
    no JSON is corrupt.
    """
    last = cache.groupBy(F.col("ticker").alias("_t"), F.col("as_of").alias("_d")).agg(F.max_by(F.struct("cached_at", "report"), F.coalesce("cached_at", F.lit("1900-01-01").cast("timestamp"))).alias("c"))
    joined = wanted.join(last, (F.upper(F.trim("ticker")) == F.col("_t")) & (F.col("as_of") == F.col("_d")), "left")
    age = F.timestamp_diff("SECOND", F.col("c.cached_at"), now) / 3600
    reason = (
        F.when(bypass if bypass is not None else F.lit(False), "bypass").when(F.col("c").isNull(), "missing").when(F.lit(json) & F.col("c.report").isNotNull() & F.try_parse_json("c.report").isNull(), "corrupt").when(F.col("c.report").isNull(), "no report")
        .when(F.col("c.cached_at").isNull(), "bad stamp").when(age > hours, "stale").otherwise("hit")
    )
    return joined.select("ticker", "as_of", reason.alias("reason")).withColumn("hit", F.col("reason") == "hit")


def cache_key(ticker: Column, at: Column) -> Column:
    """TICKER_yyyy-MM-dd."""
    return F.concat(F.upper(F.trim(ticker)), F.lit("_"), F.date_format(at, "yyyy-MM-dd"))


def assemble_brief(judgements: DataFrame, sides: dict[str, DataFrame], key: str = "symbol") -> DataFrame:
    """``judgements`` (key, gaps array) left-joined with each side; a side without a row for a key adds its name to the gaps.

    Each side has the key and one struct column of its own name.
    """
    out = judgements
    for name, side in sides.items():
        out = out.join(side, key, "left")
    missing = F.array_compact(F.array(*[F.when(F.col(name).isNull(), F.lit(f"no {name}")) for name in sides]))
    return out.withColumn("gaps", F.array_union(F.coalesce("gaps", F.array().cast("array<string>")), missing))


def carry_gaps(caveats: Column, gaps: Column) -> Column:
    """Caveats, and behind them the gaps they don't name."""
    return F.array_union(caveats, F.transform(F.array_except(gaps, caveats), lambda g: g))


def filter_calls(trace: DataFrame, run: str | None = None, agents: list[str] | None = None, failures_only: bool = False) -> DataFrame:
    """The calls of one run, of some agents, or failed ones; what isn't asked for doesn't filter, an empty list of agents has no calls."""
    if run is not None:
        trace = trace.where(F.col("run_id") == run)
    if agents is not None:
        trace = trace.where(F.col("agent").isin(*agents) if agents else F.lit(False))
    return trace.where(~F.col("ok")) if failures_only else trace


def with_sequence(trace: DataFrame) -> DataFrame:
    """``trace`` with ``seq`` numbered anew in each run, from 1 in order of time and call_id."""
    placed = ordered_positions(trace, ["run_id"], ["timestamp", "call_id"], "_position")
    return placed.withColumn("seq", F.col("_position").cast("int")).drop("_position")


def sequence_report(trace: DataFrame) -> DataFrame:
    """(run_id, calls, first, last, missing, repeated, rising): whether the numbers of each run's calls are whole, and rise with time.

    Calls are counted by number first and numbers looked at PATH_CALLS at a time, so a run of any length is spread; ``rising`` compares
    each number's earliest time with that of the number before.
    """
    numbers = trace.groupBy("run_id", "seq").agg(F.count("*").alias("n"), F.min("timestamp").alias("at")).withColumn("part", F.floor(F.col("seq") / F.lit(PATH_CALLS)))
    before = F.lag("at").over(Window.partitionBy("run_id", "part").orderBy("seq"))
    parts = numbers.withColumn("late", F.coalesce(F.col("at") < before, F.lit(False))).groupBy("run_id", "part").agg(
        F.sum("n").alias("calls"), F.count("*").alias("numbers"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.bool_or("late").alias("late"), F.min_by("at", "seq").alias("begins"), F.max_by("at", "seq").alias("ends")
    )
    edge = F.coalesce(F.col("begins") < F.lag("ends").over(Window.partitionBy("run_id").orderBy("part")), F.lit(False))
    return parts.withColumn("late", F.col("late") | edge).groupBy("run_id").agg(
        F.sum("calls").alias("calls"), F.min("first").alias("first"), F.max("last").alias("last"), (F.max("last") - F.min("first") + 1 - F.sum("numbers")).alias("missing"), (F.sum("calls") - F.sum("numbers")).alias("repeated"), (~F.bool_or("late")).alias("rising")
    )


def newest_runs(trace: DataFrame, n: int = 10) -> DataFrame:
    """(run_id, started, calls) of the ``n`` runs that started last (ties by run_id)."""
    return trace.groupBy("run_id").agg(F.min("timestamp").alias("started"), F.count("*").alias("calls")).orderBy(F.desc("started"), "run_id").limit(n)


def envelope(ok: Column, data: Column, error: Column, suggestion: Column) -> Column:
    """A result as struct(ok, data, error, suggestion): data only where it is ok, error and suggestion only where it isn't."""
    bad = ~F.coalesce(ok, F.lit(False))
    return F.struct((~bad).alias("ok"), F.when(~bad, data).alias("data"), F.when(bad, F.coalesce(error, F.lit("unknown error"))).alias("error"), F.when(bad, suggestion).alias("suggestion"))


def log_health(log: DataFrame, stamp: str = "timestamp", corrupt: str = "corrupt") -> DataFrame:
    """One row: lines, malformed ones, and lines whose time can't be read, of a log read by ``files.read_log``."""
    bad = F.col(corrupt).isNotNull()
    return log.agg(F.count("*").alias("lines"), F.count_if(bad).alias("malformed"), F.count_if(~bad & F.col(stamp).isNull()).alias("without_time"))
