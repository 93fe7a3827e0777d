"""Queries over tool-call logs, caches and briefs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as tx
from quillspan.operators import clean, metrics, news, trace as tr
from quillspan.operators import signals as g
from quillspan.plans import series_queries as sq
from quillspan.sources import files
from quillspan.sources.tables import table
from quillspan.streaming import live

TOOLS = ["calculate_volatility", "get_news", "get_price_data", "llm_sentiment", "web_search"]
# Tools each agent may use.
ALLOWED = {"quant": ["calculate_volatility", "get_price_data", "llm_sentiment"], "research": ["get_news", "web_search"]}


def q_trace_summary(spark, d):
    """Calls, failures and times of each tool in each run."""
    return tr.tool_summary(table(spark, d, "trace"), ["run_id", "tool"])


def q_tool_latency(spark, d):
    """Calls, failures and times of each tool."""
    return tr.tool_summary(table(spark, d, "trace"), ["tool"])


def q_stream_trace(spark, d):
    """Calls, failures and mean time of each tool, from the log read as a stream."""
    log = spark.readStream.schema(table(spark, d, "trace").schema).parquet(f"{d}/trace.parquet*")
    return live.run_available(live.summary_stream(log, ["tool"]))


def q_runs(spark, d):
    """Runs with their start, failures and path of tools."""
    return tr.runs(table(spark, d, "trace")).select("run_id", "calls", F.unix_micros("started").alias("started_us"), "failures", F.array_join("tools", ",").alias("tools"), "path")


def q_trace_repeats(spark, d):
    """Log lines without those flushed twice."""
    return tr.without_repeats(table(spark, d, "trace")).select("call_id", "run_id", "seq", "tool")


def q_overall(spark, d):
    """Figures of the whole log."""
    return tr.overall(table(spark, d, "trace"))


def q_agent_tool_matrix(spark, d):
    """Calls of each agent by tool."""
    return tr.matrix(table(spark, d, "trace"), "agent", "tool", TOOLS)


def q_tool_violations(spark, d):
    """Tools that agents used without being allowed to."""
    return tr.tool_violations(table(spark, d, "trace"), ALLOWED)


def q_redact_inputs(spark, d):
    """Inputs of calls, values of telling keys masked."""
    rows = table(spark, d, "trace").select("call_id", clean.redacted(F.map_concat("inputs", F.create_map(F.lit("api_token"), F.col("run_id")))).alias("m"))
    return rows.select("call_id", F.try_element_at("m", F.lit("api_token")).alias("token"), F.try_element_at("m", F.lit("ticker")).alias("ticker"), F.length(F.try_element_at("m", F.lit("query"))).alias("query_chars"))


def q_json_payload(spark, d):
    """Value and note of outputs that are whole JSON."""
    out = F.from_json("output", "ticker string, tool string, value double, note string")
    return table(spark, d, "trace").where(F.try_parse_json("output").isNotNull()).select("call_id", out.alias("o")).select("call_id", "o.ticker", F.round("o.value", 4).alias("value"), F.length("o.note").alias("note_chars"))


def q_cache_lookup(spark, d):
    """Whether a report of each listed symbol was fresh at a given moment, and why not."""
    rows = table(spark, d, "trace").where("tool = 'get_price_data'")
    cache = rows.select(F.try_element_at("inputs", F.lit("ticker")).alias("ticker"), F.to_date("timestamp").alias("as_of"), F.col("timestamp").alias("cached_at"), F.when(F.col("ok"), F.col("output")).alias("report"))
    now = F.lit("2026-06-15 00:00:00").cast("timestamp")
    wanted = table(spark, d, "issuers").select(F.col("symbol").alias("ticker"), F.explode(F.array(F.lit("2026-06-13").cast("date"), F.lit("2026-06-14").cast("date"))).alias("as_of"))
    return tr.cache_lookup(wanted, cache, now).select("ticker", "as_of", "hit", "reason")


def _sentiment(spark, d):
    label, confidence = news.wording_polarity(F.col("headline"))
    scored = table(spark, d, "headlines").where("headline <> '' and symbol is not null").select("symbol", label.alias("sentiment"), confidence.alias("confidence"))
    return news.weighted_sentiment(scored, ["symbol"])


def q_rules_signal(spark, d):
    """Momentum and polarity of each symbol, blended."""
    m = g.momentum(g.latest(sq._enriched(spark, d))).select("symbol", "momentum_score")
    s = _sentiment(spark, d).select("symbol", F.col("score").alias("sentiment_score"))
    return g.blended_signal(m.join(s, "symbol", "left"))


def q_brief_assembly(spark, d):
    """For each issuer, which of price and polarity are there, and the gaps."""
    who = table(spark, d, "issuers").select("symbol", F.array().cast("array<string>").alias("gaps"))
    price = g.range_of_year(sq._placed(spark, d)).select("symbol", F.struct("high", "low").alias("price"))
    mood = _sentiment(spark, d).select("symbol", F.struct("score", "label").alias("sentiment"))
    out = tr.assemble_brief(who, {"price": price, "sentiment": mood})
    return out.select("symbol", "price.high", "price.low", "sentiment.score", "sentiment.label", F.array_join("gaps", ",").alias("gaps"))


def q_fundamentals_left(spark, d):
    """Bars of each symbol with its issuer, if it has one."""
    bars = sq._placed(spark, d).groupBy("symbol").agg(F.count("*").alias("bars"))
    return bars.join(table(spark, d, "issuers"), "symbol", "left").select("symbol", "bars", "company_name", "sector")


def q_filter_calls(spark, d):
    """Failed calls of one agent."""
    return tr.filter_calls(table(spark, d, "trace"), agents=["research"], failures_only=True).select("call_id", "run_id", "tool")


def q_sequence(spark, d):
    """Whether the numbers of each run's calls are whole and rise with time."""
    return tr.sequence_report(table(spark, d, "trace"))


def q_renumbered(spark, d):
    """Calls numbered anew in each run, without lines flushed twice."""
    return tr.with_sequence(tr.without_repeats(table(spark, d, "trace"))).select("call_id", "run_id", "seq")


def q_newest_runs(spark, d):
    """The ten runs that started last."""
    return tr.newest_runs(table(spark, d, "trace")).select("run_id", F.unix_micros("started").alias("started_us"), "calls")


def q_error_kinds(spark, d):
    """Failed calls by what may be done about them; status and name of the error stand in the log's text in part."""
    rows = table(spark, d, "trace").where("not ok")
    status = F.regexp_extract(F.coalesce("error", F.lit("")), r"\b(\d{3})\b", 1).try_cast("int")
    name = F.regexp_extract(F.coalesce("error", F.lit("")), r"^(\w+)", 1)
    return rows.groupBy("tool", tx.retryable(status, name).alias("retryable"), tx.malformed_call(F.col("error")).alias("malformed")).agg(F.count("*").alias("n"))


def q_envelope(spark, d):
    """Results of calls with an error and a hint where they failed."""
    hint = F.concat(F.lit("try "), F.col("tool"), F.lit(" again"))
    rows = table(spark, d, "trace").select("call_id", tr.envelope(F.col("ok"), F.col("output"), F.col("error"), hint).alias("r"))
    return rows.select("call_id", "r.ok", F.length("r.data").alias("data_chars"), F.length("r.error").alias("error_chars"), "r.suggestion")


def q_content_text(spark, d):
    """Texts of message contents: plain ones, and lists of blocks made of the chat messages."""
    block = lambda m: F.when(m["role"] == "system", F.to_json(F.struct(F.lit("thinking").alias("type"), m["content"].alias("text")))).otherwise(F.to_json(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))))
    rows = table(spark, d, "chat").select("rec_id", F.when(F.col("rec_id") % 3 == 0, tx.first_turn(F.col("messages"), "user")).otherwise(F.concat(F.lit("["), F.array_join(F.transform("messages", block), ", "), F.lit("]"))).alias("raw"))
    return rows.select("rec_id", F.md5(tx.content_text(F.col("raw"))).alias("digest"))


def q_figures(spark, d):
    """Account balances as they are shown."""
    c = F.round("c_acctbal", 2)
    currency = F.when(F.col("c_custkey") % 3 == 0, "USD").when(F.col("c_custkey") % 3 == 1, "EUR").otherwise("CHF")
    rows = table(spark, d, "customer")
    return rows.select("c_custkey", tx.money(c, currency).alias("shown"), tx.sign_class(c).alias("class"), F.md5(tx.aligned_block({"Name": F.col("c_name"), "Segment": F.col("c_mktsegment"), "Note": F.lit(None)})).alias("block"))


def q_pruned_json(spark, d):
    """Answers with only two of their keys."""
    rows = table(spark, d, "chat").select("rec_id", tx.pruned_json(tx.first_turn(F.col("messages"), "assistant"), "clause_type string, risk_flag string").alias("pruned"))
    return rows.select("rec_id", F.get_json_object("pruned", "$.clause_type").alias("clause_type"), F.get_json_object("pruned", "$.risk_flag").alias("risk_flag"), F.array_join(F.json_object_keys("pruned"), ",").alias("keys"))


def q_tool_sets(spark, d):
    """Tools that each agent used against those it may use, as sets."""
    used = table(spark, d, "trace").groupBy("agent").agg(F.collect_set("tool").alias("used"))
    lists = F.create_map(*[x for a, tools in ALLOWED.items() for x in (F.lit(a), F.array(*map(F.lit, tools)))])
    rows = used.select("agent", metrics.set_relation(F.try_element_at(lists, F.col("agent")), F.col("used")).alias("r"))
    return rows.select("agent", F.array_join("r.common", ",").alias("common"), F.array_join("r.only_a", ",").alias("unused"), F.array_join("r.only_b", ",").alias("not_allowed"), "r.disjoint", "r.covered")


def q_manifest(spark, d):
    """Rows and share of each split of the chat records, and their clause types."""
    rows = table(spark, d, "chat").select("split", F.col("metadata.clause_type").alias("clause_type"))
    return files.manifest(rows, "split", "clause_type").select("split", "n", "share", F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("types"))


QUERIES = {f.__name__: f for f in (
    q_trace_summary, q_tool_latency, q_stream_trace, q_runs, q_trace_repeats, q_overall, q_agent_tool_matrix, q_tool_violations, q_redact_inputs, q_json_payload, q_cache_lookup, q_rules_signal,
    q_brief_assembly, q_fundamentals_left, q_filter_calls, q_sequence, q_renumbered, q_newest_runs, q_error_kinds, q_envelope, q_content_text, q_figures, q_pruned_json, q_tool_sets, q_manifest,
)}

_SUMMARY = "count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures, round(sum(duration_ms), 6) AS total_ms, round(avg(duration_ms), 6) AS mean_ms, round(max(duration_ms), 6) AS max_ms"
_MOOD = """s AS (SELECT symbol, CASE WHEN regexp_matches(headline, '(?i)raises|lifts|widens|backs|doubles|unveils') THEN 1 WHEN regexp_matches(headline, '(?i)halves|trims|shelves|scraps|stalls|rejects') THEN -1 ELSE 0 END AS pol,
  round(0.5e0 + (length(headline) % 50) / 100e0, 2) AS confidence FROM headlines WHERE headline <> '' AND symbol IS NOT NULL),
mood AS (SELECT symbol, round(greatest(-1, least(1, coalesce(sum(pol * confidence) / nullif(sum(confidence), 0), 0))), 4) + 0 AS score FROM s GROUP BY symbol)"""
_LABEL = "CASE WHEN score >= 0.15 THEN 'positive' WHEN score <= -0.15 THEN 'negative' WHEN score IS NOT NULL THEN 'neutral' END AS label"

SQL = {
    "q_trace_summary": f"SELECT run_id, tool, {_SUMMARY} FROM trace GROUP BY ALL",
    "q_tool_latency": f"SELECT tool, {_SUMMARY} FROM trace GROUP BY ALL",
    "q_stream_trace": "SELECT tool, count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures, round(avg(duration_ms), 6) AS mean_ms FROM trace GROUP BY ALL",
    "q_runs": """
        WITH p AS (SELECT run_id, coalesce(seq, 0) // 4096 AS part, md5(string_agg(tool, '>' ORDER BY seq, call_id)) AS digest FROM trace GROUP BY ALL),
        d AS (SELECT run_id, md5(string_agg(digest, ',' ORDER BY part)) AS path FROM p GROUP BY run_id)
        SELECT t.run_id, count(*) AS calls, epoch_us(min(timestamp)) AS started_us, count(*) FILTER (WHERE NOT ok) AS failures, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tools, any_value(path) AS path
        FROM trace t JOIN d ON t.run_id IS NOT DISTINCT FROM d.run_id GROUP BY t.run_id""",
    "q_trace_repeats": """SELECT min(call_id) AS call_id, run_id, seq, tool FROM trace
        GROUP BY run_id, seq, timestamp, agent, tool, inputs, output, output_truncated, output_full_length, duration_ms, duration_s, ok, error""",
    "q_overall": "SELECT count(*) AS calls, count(*) FILTER (WHERE NOT ok) AS failures, round(sum(duration_ms) / 1000, 3) AS seconds, max(duration_ms) AS slowest_ms, count(DISTINCT run_id) AS runs, count(DISTINCT agent) AS agents FROM trace",
    "q_agent_tool_matrix": "SELECT agent, " + ", ".join(f"count(*) FILTER (WHERE tool = '{t}') AS {t}" for t in TOOLS) + " FROM trace GROUP BY agent",
    "q_tool_violations": """
        WITH a(agent, tool) AS (VALUES """ + ", ".join(f"('{a}', '{t}')" for a, tools in ALLOWED.items() for t in tools) + """),
        u AS (SELECT DISTINCT agent, tool FROM trace)
        SELECT agent, string_agg(tool, ',' ORDER BY tool) AS used, coalesce(string_agg(tool, ',' ORDER BY tool) FILTER (WHERE (agent, tool) NOT IN (SELECT (agent, tool) FROM a)), '') AS violations FROM u GROUP BY agent""",
    "q_redact_inputs": "SELECT call_id, '<redacted>' AS token, left(inputs['ticker'], 500) AS ticker, length(left(inputs['query'], 500)) AS query_chars FROM trace",
    "q_json_payload": "SELECT call_id, output ->> '$.ticker' AS ticker, round((output -> '$.value')::DOUBLE, 4) AS value, length(output ->> '$.note') AS note_chars FROM (SELECT * FROM trace WHERE json_valid(output))",
    "q_cache_lookup": """
        WITH c AS (SELECT inputs['ticker'] AS t, timestamp::DATE AS d, arg_max(CASE WHEN ok THEN output ELSE '' END, timestamp) AS report, max(timestamp) AS seen FROM trace WHERE tool = 'get_price_data' GROUP BY ALL),
        w AS (SELECT symbol AS ticker, unnest([DATE '2026-06-13', DATE '2026-06-14']) AS as_of FROM issuers),
        r AS (SELECT ticker, as_of, CASE WHEN t IS NULL THEN 'missing' WHEN report = '' THEN 'no report' WHEN date_diff('second', seen, '2026-06-15 00:00:00+00'::TIMESTAMPTZ) / 3600e0 > 24 THEN 'stale' ELSE 'hit' END AS reason
          FROM w LEFT JOIN c ON ticker = t AND as_of = d)
        SELECT ticker, as_of, reason = 'hit' AS hit, reason FROM r""",
    "q_rules_signal": f"""
        WITH RECURSIVE {sq.ENRICHED}{sq.MOMENTUM}, {_MOOD},
        b AS (SELECT l.symbol, momentum_score, mood.score AS sentiment_score, 0.7e0 * momentum_score + 0.3e0 * coalesce(mood.score, 0) AS x FROM labelled l LEFT JOIN mood USING (symbol))
        SELECT symbol, momentum_score, sentiment_score, round(x, 4) AS blend, CASE WHEN x >= 0.25 THEN 'Buy' WHEN x <= -0.25 THEN 'Sell' ELSE 'Hold' END AS direction,
          round(least(0.55e0, abs(x) + 0.15e0), 2) AS blend_confidence, momentum_score * coalesce(sentiment_score, 0) >= 0 AS signs_agree FROM b""",
    "q_brief_assembly": f"""
        WITH {sq.CLEAN}, {_MOOD},
        y AS (SELECT symbol, max(close) AS high, min(close) AS low FROM (SELECT *, max(pos) OVER (PARTITION BY symbol) AS e FROM placed) WHERE pos > e - 252 GROUP BY symbol)
        SELECT symbol, high, low, score, {_LABEL}, concat_ws(',', CASE WHEN high IS NULL THEN 'no price' END, CASE WHEN score IS NULL THEN 'no sentiment' END) AS gaps
        FROM (SELECT DISTINCT symbol FROM issuers) LEFT JOIN y USING (symbol) LEFT JOIN mood USING (symbol)""",
    "q_fundamentals_left": f"WITH {sq.CLEAN}, b AS (SELECT symbol, count(*) AS bars FROM placed GROUP BY symbol) SELECT symbol, bars, company_name, sector FROM b LEFT JOIN issuers USING (symbol)",
    "q_filter_calls": "SELECT call_id, run_id, tool FROM trace WHERE agent = 'research' AND NOT ok",
    "q_sequence": """
        WITH n AS (SELECT run_id, seq, count(*) AS n, min(timestamp) AS t0 FROM trace GROUP BY ALL), l AS (SELECT *, coalesce(t0 < lag(t0) OVER (PARTITION BY run_id ORDER BY seq), false) AS late FROM n)
        SELECT run_id, sum(n)::BIGINT AS calls, min(seq) AS first, max(seq) AS last, max(seq) - min(seq) + 1 - count(*) AS missing, sum(n - 1)::BIGINT AS repeated, NOT bool_or(late) AS rising FROM l GROUP BY run_id""",
    "q_renumbered": """
        WITH r AS (SELECT min(call_id) AS call_id, run_id, timestamp FROM trace GROUP BY run_id, seq, timestamp, agent, tool, inputs, output, output_truncated, output_full_length, duration_ms, duration_s, ok, error)
        SELECT call_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY timestamp, call_id)::INT AS seq FROM r""",
    "q_newest_runs": "SELECT run_id, epoch_us(min(timestamp)) AS started_us, count(*) AS calls FROM trace GROUP BY run_id ORDER BY min(timestamp) DESC, run_id LIMIT 10",
    "q_error_kinds": """
        WITH e AS (SELECT tool, coalesce(error, '') AS e FROM trace WHERE NOT ok)
        SELECT tool, coalesce(try_cast(regexp_extract(e, '\\b(\\d{3})\\b', 1) AS INT) IN (408, 409, 413, 429, 500, 502, 503, 504), false) OR regexp_extract(e, '^(\\w+)', 1) IN ('RateLimitError', 'APITimeoutError', 'APIConnectionError', 'InternalServerError') AS retryable,
          regexp_matches(lower(e), 'tool_use_failed|failed to parse tool call|failed_generation|invalid tool call') AS malformed, count(*) AS n FROM e GROUP BY ALL""",
    "q_envelope": """SELECT call_id, coalesce(ok, false) AS ok, CASE WHEN ok THEN length(output) END AS data_chars, CASE WHEN NOT coalesce(ok, false) THEN length(coalesce(error, 'unknown error')) END AS error_chars,
        CASE WHEN NOT coalesce(ok, false) THEN 'try ' || tool || ' again' END AS suggestion FROM trace""",
    "q_content_text": """SELECT rec_id, md5(CASE WHEN rec_id % 3 = 0 THEN coalesce(list_filter(messages, lambda m: m.role = 'user')[1].content, '')
        ELSE array_to_string(list_transform(list_filter(messages, lambda m: m.role <> 'system'), lambda m: coalesce(m.content, '')), '') END) AS digest FROM chat""",
    "q_figures": """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '$' WHEN 1 THEN '€' ELSE '' END || format('{:,.2f}', round(c_acctbal, 2)) AS shown,
        CASE WHEN round(c_acctbal, 2) > 0 THEN 'pos' WHEN round(c_acctbal, 2) < 0 THEN 'neg' ELSE '' END AS class,
        md5('Name    : ' || c_name || chr(10) || 'Segment : ' || c_mktsegment || chr(10) || 'Note    : unavailable') AS block FROM customer""",
    "q_manifest": """
        WITH k AS (SELECT split, coalesce(metadata.clause_type, 'null') AS k, count(*) AS c FROM chat GROUP BY ALL)
        SELECT split, sum(c)::BIGINT AS n, round(sum(c) / sum(sum(c)) OVER (), 4) AS share, string_agg(k || '=' || c, ',' ORDER BY k) AS types FROM k GROUP BY split""",
    "q_pruned_json": """WITH a AS (SELECT rec_id, list_filter(messages, lambda m: m.role = 'assistant')[1].content AS a FROM chat)
        SELECT rec_id, a ->> '$.clause_type' AS clause_type, a ->> '$.risk_flag' AS risk_flag, array_to_string(list_filter(['clause_type', 'risk_flag'], lambda k: (a ->> ('$.' || k)) IS NOT NULL), ',') AS keys FROM a""",
    "q_tool_sets": """
        WITH a(agent, tool) AS (VALUES """ + ", ".join(f"('{a}', '{t}')" for a, tools in ALLOWED.items() for t in tools) + """),
        s AS (SELECT u.agent, list_sort(coalesce((SELECT list(tool) FROM a WHERE a.agent = u.agent), [])) AS may, list_sort(list(DISTINCT u.tool)) AS used FROM trace u GROUP BY u.agent)
        SELECT agent, array_to_string(list_filter(may, lambda x: list_contains(used, x)), ',') AS common, array_to_string(list_filter(may, lambda x: NOT list_contains(used, x)), ',') AS unused,
          array_to_string(list_filter(used, lambda x: NOT list_contains(may, x)), ',') AS not_allowed, NOT list_has_any(may, used) AS disjoint, list_has_all(may, used) AS covered FROM s""",
}
