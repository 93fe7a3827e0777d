"""Queries over headlines, documents, chat records and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as t
from quillspan.operators import chat as ch
from quillspan.operators import clean, corpus, metrics, news
from quillspan.operators import similarity as sim
from quillspan.sources.tables import table

PAYLOAD = "clause_type string, parties array<string>, obligation string, trigger_condition string, financial_terms array<string>, risk_flag string, risk_rationale string"


def _chat(spark, d):
    rows = table(spark, d, "chat")
    return rows.select("rec_id", "split", "source", "metadata", t.first_turn(F.col("messages"), "user").alias("clause"), t.first_turn(F.col("messages"), "assistant").alias("answer"))


def _extracted(spark, d):
    return _chat(spark, d).withColumn("x", F.from_json(t.salvaged_json(F.col("answer")), PAYLOAD))


def _scored(spark, d):
    label, confidence = news.wording_polarity(F.col("headline"))
    return table(spark, d, "headlines").where("headline <> ''").select("item_id", "symbol", "headline", label.alias("sentiment"), confidence.alias("confidence"))


def q_news_priority_union(spark, d):
    """Headlines of each symbol by source rank until ten titles are there."""
    return news.union_by_rank(table(spark, d, "headlines")).select("symbol", "source", "source_rank", "pos", "item_id")


def q_title_key(spark, d):
    """Title key and match key of each headline."""
    return table(spark, d, "headlines").select("item_id", clean.title_key(F.col("headline")).alias("title_key"), clean.match_key(F.col("headline")).alias("match_key"))


def q_clean_text(spark, d):
    """Headlines as they are shown."""
    return table(spark, d, "headlines").select("item_id", clean.shown(F.col("headline")).alias("shown"))


def q_sentiment_aggregate(spark, d):
    """Weighted polarity of the headlines of each symbol."""
    return news.weighted_sentiment(_scored(spark, d), ["symbol"])


def q_reconcile_missing(spark, d):
    """Each headline with the answer given for it, or the default; answers exist for the first-ranked sources."""
    asked = table(spark, d, "headlines").where("headline <> ''").select("item_id", "headline")
    given = table(spark, d, "headlines").where("headline <> '' and source_rank <= 1").select("item_id", "headline")
    label, confidence = news.wording_polarity(F.col("headline"))
    answers = given.select("headline", "item_id", label.alias("sentiment"), confidence.alias("confidence"))
    return news.reconcile(asked, answers, "item_id", "headline", {"sentiment": F.lit("neutral"), "confidence": F.lit(0.0)}, "item_id").select("item_id", "sentiment", "confidence", "answered")


def q_anti_unlisted(spark, d):
    """Symbols of headlines that no issuer has, with their rows."""
    rows = table(spark, d, "headlines").where("symbol is not null").groupBy("symbol").agg(F.count("*").alias("n"))
    return rows.join(table(spark, d, "issuers").select("symbol"), "symbol", "left_anti")


def q_length_stats(spark, d):
    """Length of documents by source."""
    return corpus.length_stats(table(spark, d, "documents"), ["source"])


def q_length_hist(spark, d):
    """Histogram of the words of documents."""
    docs = table(spark, d, "documents").where("text is not null")
    return corpus.histogram(docs, t.words(F.col("text")))


def q_keywords(spark, d):
    """The 25 keywords of the documents."""
    return corpus.keyword_report(table(spark, d, "documents"))


def q_keyword_totals(spark, d):
    """Variety of the keywords of the documents."""
    return corpus.keyword_totals(table(spark, d, "documents"))


def _axes():
    return {a: F.col(f"metadata.{a}") for a in ("clause_type", "industry", "jurisdiction", "complexity", "edge_case")}


def q_axis_shares(spark, d):
    """Share of each label on five axes of the chat records."""
    return corpus.axis_shares(table(spark, d, "chat"), _axes())


def q_axis_entropy(spark, d):
    """Evenness of the labels on each axis."""
    return corpus.axis_entropy(table(spark, d, "chat"), _axes())


def q_entity_uniqueness(spark, d):
    """How many of the party mentions are different."""
    return corpus.entity_uniqueness(_extracted(spark, d).select(F.explode("x.parties").alias("entity")))


def q_label_balance(spark, d):
    """Records by risk flag, with those lacking a trigger and terms."""
    x = _extracted(spark, d).where("x is not null")
    trigger = clean.blank_to_null(F.col("x.trigger_condition"))
    return x.groupBy(F.coalesce("x.risk_flag", F.lit("none")).alias("risk_flag")).agg(F.count("*").alias("n"), F.count_if(trigger.isNull()).alias("no_trigger"), F.count_if(F.coalesce(F.size("x.financial_terms"), F.lit(0)) <= 0).alias("no_terms"))


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "text")


def q_near_dups(spark, d):
    """Near-duplicate pairs of different texts within a source, and their cosine."""
    return sim.similar_pairs(_docs(spark, d), ["source"]).select("source", "a", "b", F.round("cosine", 6).alias("cosine"))


def q_doc_classes(spark, d):
    """The class of equal texts of each document within its source."""
    return sim.classes_of(_docs(spark, d), ["source"])


def q_similarity_report(spark, d):
    """Mean, median, 95th percentile and maximum of the cosines of each source, and near pairs."""
    return sim.similarity_report(_docs(spark, d), ["source"])


def q_similarity_hist(spark, d):
    """Pairs of each source by cosine, in twenty bins."""
    return sim.cosine_histogram(_docs(spark, d), ["source"])


def q_worst_pairs(spark, d):
    """The ten nearest pairs of different texts of each source."""
    return sim.first_offenders(_docs(spark, d), ["source"], worst=True).select("source", "rank", "a", "b", F.round("cosine", 6).alias("cosine"))


def q_first_offenders(spark, d):
    """The first ten near pairs of different texts of each source, by id."""
    return sim.first_offenders(_docs(spark, d), ["source"]).select("source", "rank", "a", "b", F.round("cosine", 6).alias("cosine"))


def q_guard_log(spark, d):
    """The outcome of the guard for each document, and the accepted one before it that is nearest."""
    return sim.guard_log(_docs(spark, d), ["source"])


def q_duplicate_guard(spark, d):
    """Which documents of a source are taken if near duplicates of taken ones are rejected."""
    return sim.duplicate_guard(_docs(spark, d), ["source"])


def q_diversity_verdict(spark, d):
    """Variety of the train clauses against stated limits."""
    rows = _chat(spark, d).where("split = 'train'").select("rec_id", F.lit(1).alias("all"), "clause", "metadata")
    similarity = sim.similarity_report(rows, ["all"], id="rec_id", text="clause").select("near_pairs", "mean_cosine", "p95_cosine")
    cv = corpus.length_stats(rows, ["all"], "clause").select("cv")
    types = corpus.axis_entropy(rows, {"clause_type": F.col("metadata.clause_type")}).select(F.col("entropy").alias("type_entropy"), F.col("max_share_pct").alias("type_max_share"))
    unique = q_entity_uniqueness(spark, d).select("uniqueness")
    edges = rows.agg(F.count_distinct("metadata.edge_case").alias("edge_cases"))
    one = similarity
    for other in (cv, types, unique, edges):  # each has one row
        one = one.crossJoin(F.broadcast(other))
    return corpus.verdict(one)


def q_rouge_l(spark, d):
    """Overlap of answers with their clauses in order."""
    rows = _chat(spark, d).where("clause is not null and answer is not null")
    score = metrics.overlap_score(F.col("answer"), F.col("clause"))
    return rows.select("rec_id", score.alias("s")).select("rec_id", "s.precision", "s.recall", "s.f")


def q_set_f1(spark, d):
    """Agreement of all parties of an extraction with all capitalised names of its clause, as sets."""
    x = _extracted(spark, d).where("x is not null and clause is not null")
    names = t.all_matches(F.col("clause"), "[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)+")
    return x.select("rec_id", metrics.set_f1(F.col("x.parties"), names).alias("f1"))


def q_top_entities(spark, d):
    """The eight parties mentioned most."""
    return corpus.top_entities(_extracted(spark, d).select(F.explode("x.parties").alias("entity")))


def q_grounding(spark, d):
    """Parties and terms of extractions that don't stand in their clause."""
    x = _extracted(spark, d).where("x is not null and clause is not null")
    parties, terms = F.coalesce("x.parties", F.array().cast("array<string>")), F.coalesce("x.financial_terms", F.array().cast("array<string>"))
    bad = x.select("rec_id", metrics.ungrounded_parties(parties, F.col("clause")).alias("p"), metrics.ungrounded_terms(terms, F.col("clause")).alias("t"))
    return bad.select("rec_id", F.size("p").alias("bad_parties"), F.size("t").alias("bad_terms"), ((F.size("p") == 0) & (F.size("t") == 0)).alias("grounded"))


def q_numbers_in(spark, d):
    """How many different numbers a clause has, and their sum."""
    rows = _chat(spark, d).where("clause is not null").select("rec_id", t.numbers(F.col("clause")).alias("n"))
    return rows.select("rec_id", F.size("n").alias("numbers"), F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def _model_scores(spark, d):
    x = _extracted(spark, d).where("clause is not null")
    parsed = F.col("x").isNotNull()
    return x.select("source", parsed.cast("double").alias("parsed"), (F.col("x.clause_type") == F.col("metadata.clause_type")).cast("double").alias("type_right"), F.when(parsed, F.size("x.parties")).cast("double").alias("parties"))


def q_model_rollup(spark, d):
    """Mean scores of each source of records."""
    return metrics.roll_up(_model_scores(spark, d), "source", ["parsed", "type_right", "parties"])


def q_compare(spark, d):
    """Scores of the small teacher against the large one."""
    r = q_model_rollup(spark, d)
    return metrics.compare(r.where("source = 'teacher_small'"), r.where("source = 'teacher_large'"), ["parsed", "type_right", "parties"])


def q_rule_violations(spark, d):
    """Rules that extractions break."""
    x = _extracted(spark, d).where("answer is not null")
    return x.select("rec_id", F.array_join(ch.violations(ch.extraction_rules("x")), "|").alias("violations"))


def q_sentence_count(spark, d):
    """Sentences of each document."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", t.sentences(F.col("text")).alias("sentences"))


def q_text_quality(spark, d):
    """Indicator families and relational wording of headlines."""
    rows = table(spark, d, "headlines").where("headline is not null")
    return rows.select("item_id", F.array_join(t.indicators_mentioned(F.col("headline")), ",").alias("families"), t.has_relation(F.col("headline")).alias("relates"))


def q_chat_render(spark, d):
    """Conversations as one text each."""
    return table(spark, d, "chat").select("rec_id", F.md5(ch.rendered(F.col("messages"))).alias("digest"))


def q_first_turn(spark, d):
    """Length of the first user and assistant turns, and shape of the answers."""
    rows = _chat(spark, d)
    return rows.select("rec_id", F.length("clause").alias("clause_chars"), F.length("answer").alias("answer_chars"), clean.has_fence(F.col("answer")).alias("fence"), clean.has_preamble(F.col("answer")).alias("preamble"))


def q_trim_budget(spark, d):
    """Turns that fit into 1,200 characters."""
    turns = table(spark, d, "chat").select(F.col("rec_id").alias("conv_id"), F.posexplode("messages").alias("turn", "m")).select("conv_id", "turn", "m.role", "m.content")
    return ch.trim_to_budget(turns, 1200).select("conv_id", "turn", "role")


def q_stratified_split(spark, d):
    """Rows of each clause type by split."""
    rows = table(spark, d, "chat").select("rec_id", F.col("metadata.clause_type").alias("clause_type"))
    return ch.stratified_split(rows, "clause_type").select("rec_id", "split")


def q_batches_of_8(spark, d):
    """Headlines of each symbol in batches of eight."""
    rows = table(spark, d, "headlines").where("symbol is not null").select("symbol", "item_id")
    return ch.batches(rows, ["symbol"], ["item_id"])


def q_grid_seeds(spark, d):
    """How many training records each combination of type, jurisdiction and complexity has."""
    targets = table(spark, d, "sample_targets")
    grid = None
    for axis in ("clause_type", "jurisdiction", "complexity"):
        values = targets.where(F.col("axis") == axis).select(F.col("category").alias(axis))
        grid = values if grid is None else grid.crossJoin(F.broadcast(values))
    have = table(spark, d, "chat").groupBy("metadata.clause_type", "metadata.jurisdiction", "metadata.complexity").agg(F.count("*").alias("n"))
    return grid.join(have, ["clause_type", "jurisdiction", "complexity"], "left").select("clause_type", "jurisdiction", "complexity", F.coalesce("n", F.lit(0)).alias("n"))


def _near(spark, d):
    rows = table(spark, d, "embeddings")
    return sim.nearest(rows, rows.where("vec_id % 100 = 0"))


def q_knn_cosine(spark, d):
    """The three vectors nearest to every hundredth."""
    return _near(spark, d).select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.round("distance", 5).alias("distance"))


def q_nn_label_vote(spark, d):
    """The label most of the nearest have, and whether it is right."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    voted = sim.neighbour_vote(_near(spark, d), labels)
    return voted.join(labels, voted["query_id"] == labels["vec_id"]).select("query_id", "voted", (F.col("voted") == F.col("label")).alias("right"))


def q_calibrate(spark, d):
    """Threshold and quartiles of the nearest distances."""
    c = sim.calibrate(_near(spark, d).where("rank = 1"), "distance")
    return c.select(*[F.round(x, 5).alias(x) for x in ("threshold", "mean", "median", "p25", "p90", "maximum")], "n")


def q_gate(spark, d):
    """Queries whose nearest distance is above the threshold."""
    near = _near(spark, d).where("rank = 1")
    return near.crossJoin(F.broadcast(sim.calibrate(near, "distance").select("threshold"))).select("query_id", (F.col("distance") > F.col("threshold")).alias("fires"))


QUERIES = {f.__name__: f for f in (
    q_news_priority_union, q_title_key, q_clean_text, q_sentiment_aggregate, q_reconcile_missing, q_anti_unlisted, q_length_stats, q_length_hist, q_keywords, q_keyword_totals, q_axis_shares,
    q_axis_entropy, q_entity_uniqueness, q_top_entities, q_label_balance, q_near_dups, q_doc_classes, q_similarity_report, q_similarity_hist, q_worst_pairs, q_first_offenders, q_guard_log, q_duplicate_guard, q_diversity_verdict, q_rouge_l, q_set_f1, q_grounding, q_numbers_in,
    q_model_rollup, q_compare, q_rule_violations, q_sentence_count, q_text_quality, q_chat_render, q_first_turn, q_trim_budget, q_stratified_split, q_batches_of_8, q_grid_seeds, q_knn_cosine,
    q_nn_label_vote, q_calibrate, q_gate,
)}


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_UNESCAPED = "headline"
for _entity, _char in clean.ENTITIES.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
_TITLE = f"trim(regexp_replace(lower({_UNESCAPED}), '[^a-z0-9 ]', '', 'g'), ' ')"
_MATCH = "left(regexp_replace(lower(headline), '[^a-z0-9]', '', 'g'), 80)"
_POLARITY = """CASE WHEN regexp_matches(headline, '(?i)raises|lifts|widens|backs|doubles|unveils') THEN 'positive'
  WHEN regexp_matches(headline, '(?i)halves|trims|shelves|scraps|stalls|rejects') THEN 'negative' ELSE 'neutral' END AS sentiment, round(0.5e0 + (length(headline) % 50) / 100e0, 2) AS confidence"""
_KEYWORDS = f"""kw AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z][a-z\\-'']{{3,}}')) AS term FROM documents),
counts AS (SELECT term, count(*) AS n FROM kw WHERE NOT list_contains({_quoted(t.LEGAL_STOP_WORDS)}, term) GROUP BY term)"""
_CHAT = """c AS (SELECT rec_id, split, source, metadata, list_filter(messages, lambda m: m.role = 'user')[1].content AS clause,
  list_filter(messages, lambda m: m.role = 'assistant')[1].content AS answer FROM chat)"""
_JSON = """j AS (SELECT *, CASE WHEN json_valid(answer) THEN answer WHEN json_valid(regexp_extract(answer, '(?s)\\{.*\\}')) THEN regexp_extract(answer, '(?s)\\{.*\\}') END AS js FROM c),
x AS (SELECT *, js ->> '$.clause_type' AS x_type, (js -> '$.parties')::VARCHAR[] AS parties, js ->> '$.obligation' AS obligation, js ->> '$.trigger_condition' AS trigger_condition,
  (js -> '$.financial_terms')::VARCHAR[] AS terms, js ->> '$.risk_flag' AS risk_flag, js ->> '$.risk_rationale' AS rationale FROM j)"""
_WORDS = "CASE WHEN trim(regexp_replace(text, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}\\x{0085}]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}\\x{0085}]+', ' ', 'g')), ' ')) END"
_AXES = "axes AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, coalesce(metadata.{a}::VARCHAR, 'null') AS value FROM chat" for a in ("clause_type", "industry", "jurisdiction", "complexity", "edge_case")) + "), counts AS (SELECT axis, value, count(*) AS n FROM axes GROUP BY ALL)"
_VECTORS = """t AS (SELECT source, doc_id AS id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT source, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM t WHERE len(w) > 0),
v AS (SELECT source, id, gram, count(*) AS n FROM g GROUP BY ALL),
u AS (SELECT source, id, gram, n / sqrt(sum(n * n) OVER (PARTITION BY source, id)) AS w FROM v),
cls AS (SELECT source, doc_id AS id, min(doc_id) OVER (PARTITION BY source, text) AS class_id FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT a.source, a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM u a JOIN u b ON a.source IS NOT DISTINCT FROM b.source AND a.gram = b.gram AND a.id < b.id GROUP BY ALL)"""
# cosines of all pairs of texts with a gram, those without a common one among them
_ALL_PAIRS = """have AS (SELECT DISTINCT source, id FROM u),
every AS (SELECT x.source, round(coalesce(p.cosine, 0), 6) AS cosine FROM have x JOIN have y ON x.source IS NOT DISTINCT FROM y.source AND x.id < y.id LEFT JOIN pairs p ON p.a = x.id AND p.b = y.id)"""
# the texts of each source one after the other
_GUARD = """e AS MATERIALIZED (SELECT source, a, b FROM pairs WHERE cosine >= 0.72 - 1e-9),
        o AS MATERIALIZED (SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS k FROM t),
        nb AS MATERIALIZED (SELECT o.source, o.id, o.k, coalesce(list(e.a) FILTER (WHERE e.a IS NOT NULL), []) AS before FROM o LEFT JOIN e ON e.b = o.id AND e.source = o.source GROUP BY ALL),
        run AS (
          SELECT source, k, [id] AS taken, id, true AS accepted FROM nb WHERE k = 1
          UNION ALL
          SELECT n.source, n.k, CASE WHEN list_has_any(r.taken, n.before) THEN r.taken ELSE list_append(r.taken, n.id) END, n.id, NOT list_has_any(r.taken, n.before)
          FROM run r JOIN nb n ON n.source = r.source AND n.k = r.k + 1)"""
_NEAR = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f, label FROM embeddings),
d AS (SELECT query_id, id, label, 1 - list_dot_product(e, f) / sqrt(list_dot_product(e, e) * list_dot_product(f, f)) AS distance FROM q JOIN r ON query_id <> id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) <= 3)"""

SQL = {
    "q_news_priority_union": f"""
        WITH k AS (SELECT *, {_TITLE} AS t FROM headlines),
        lim AS (SELECT * FROM k WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY symbol, source ORDER BY pos, item_id) <= 25),
        f AS (SELECT * FROM lim QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY source_rank, pos, item_id) = 1),
        per AS (SELECT symbol, source_rank, count(*) AS n FROM f GROUP BY ALL),
        b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY symbol ORDER BY source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per)
        SELECT f.symbol, source, f.source_rank, pos, item_id FROM f JOIN b ON f.symbol IS NOT DISTINCT FROM b.symbol AND f.source_rank = b.source_rank WHERE before < 10""",
    "q_title_key": f"SELECT item_id, {_TITLE} AS title_key, {_MATCH} AS match_key FROM headlines",
    "q_sentiment_aggregate": f"""
        WITH s AS (SELECT symbol, {_POLARITY} FROM headlines WHERE headline <> ''),
        p AS (SELECT *, CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END AS pol FROM s),
        a AS (SELECT symbol, round(greatest(-1, least(1, coalesce(sum(pol * confidence) / nullif(sum(confidence), 0), 0))), 4) + 0 AS score, count(*) AS headline_count,
          count(*) FILTER (WHERE sentiment = 'positive') AS positive_count, count(*) FILTER (WHERE sentiment = 'negative') AS negative_count, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count,
          round(avg(confidence), 4) AS mean_confidence, count(*) >= 4 AND min(sentiment) = max(sentiment) AND min(confidence) = max(confidence) AS degenerate FROM p GROUP BY symbol)
        SELECT *, CASE WHEN score >= 0.15 THEN 'positive' WHEN score <= -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM a""",
    "q_reconcile_missing": f"""
        WITH a AS (SELECT {_MATCH} AS k, arg_max(s, item_id) AS s FROM (SELECT headline, item_id, struct_pack(sentiment := sentiment, confidence := confidence) AS s
          FROM (SELECT headline, item_id, {_POLARITY} FROM headlines WHERE headline <> '' AND source_rank <= 1)) GROUP BY k)
        SELECT item_id, coalesce(s.sentiment, 'neutral') AS sentiment, coalesce(s.confidence, 0) AS confidence, s IS NOT NULL AS answered
        FROM headlines h LEFT JOIN a ON {_MATCH} = a.k WHERE headline <> ''""",
    "q_anti_unlisted": "SELECT symbol, count(*) AS n FROM headlines WHERE symbol IS NOT NULL AND symbol NOT IN (SELECT symbol FROM issuers WHERE symbol IS NOT NULL) GROUP BY symbol",
    "q_length_stats": f"""
        WITH s AS (SELECT source, {_WORDS} AS w, length(text) AS c FROM documents WHERE text IS NOT NULL)
        SELECT source, count(*) AS n, round(avg(w), 4) AS mean, round(stddev_pop(w), 4) AS std, min(w) AS min, round(quantile_cont(w, 0.25), 4) AS p25, round(quantile_cont(w, 0.5), 4) AS median,
          round(quantile_cont(w, 0.75), 4) AS p75, max(w) AS max, round(stddev_pop(w) / nullif(avg(w), 0), 4) AS cv, round(avg(c), 4) AS chars_mean, min(c) AS chars_min, max(c) AS chars_max FROM s GROUP BY source""",
    "q_length_hist": f"""
        WITH s AS (SELECT {_WORDS}::DOUBLE AS v FROM documents WHERE text IS NOT NULL),
        r AS (SELECT min(v) AS a, max(v) AS b FROM s), bins AS (SELECT unnest(range(1, 13))::INT AS bin),
        n AS (SELECT least(floor((v - a) / (b - a) * 12) + 1, 12)::INT AS bin, count(*) AS n FROM s, r GROUP BY ALL)
        SELECT bin, round(a + (b - a) / 12 * (bin - 1), 4) AS low, round(a + (b - a) / 12 * bin, 4) AS high, coalesce(n, 0) AS n FROM bins CROSS JOIN r LEFT JOIN n USING (bin)""",
    "q_keywords": f"WITH {_KEYWORDS} SELECT term, n, round(100e0 * n / (SELECT sum(n) FROM counts), 4) AS share_pct FROM counts ORDER BY n DESC, term LIMIT 25",
    "q_keyword_totals": f"""WITH {_KEYWORDS}, top AS (SELECT sum(n) AS top_n FROM (SELECT n FROM counts ORDER BY n DESC, term LIMIT 25))
        SELECT count(*) AS distinct_terms, sum(n)::BIGINT AS total_terms, round(count(*)::DOUBLE / sum(n), 4) AS type_token, round(100e0 * (SELECT top_n FROM top) / sum(n), 4) AS top_share_pct FROM counts""",
    "q_axis_shares": f"WITH {_AXES} SELECT axis, value, n, round(100e0 * n / sum(n) OVER (PARTITION BY axis), 4) AS share_pct FROM counts",
    "q_axis_entropy": f"""WITH {_AXES}, p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY axis) AS p FROM counts)
        SELECT axis, count(*) AS distinct_values, round(CASE WHEN count(*) <= 1 THEN 0 ELSE sum(-p * ln(p)) / ln(count(*)) END, 4) AS entropy, round(100 * max(p), 4) AS max_share_pct FROM p GROUP BY axis""",
    "q_entity_uniqueness": f"""WITH {_CHAT}, {_JSON}, e AS (SELECT trim(unnest(parties)) AS e FROM x)
        SELECT count(*) AS mentions, count(DISTINCT e) AS distinct_entities, round(count(DISTINCT e)::DOUBLE / nullif(count(*), 0), 3) AS uniqueness FROM e WHERE e <> ''""",
    "q_label_balance": f"""WITH {_CHAT}, {_JSON} SELECT coalesce(risk_flag, 'none') AS risk_flag, count(*) AS n,
        count(*) FILTER (WHERE trigger_condition IS NULL OR lower(trim(trigger_condition)) IN ('', 'none', 'n/a', 'null', 'not applicable')) AS no_trigger, count(*) FILTER (WHERE coalesce(len(terms), 0) = 0) AS no_terms
        FROM x WHERE js IS NOT NULL GROUP BY ALL""",
    "q_near_dups": f"WITH {_VECTORS}, f AS (SELECT DISTINCT source, class_id FROM cls) SELECT p.source, a, b, round(cosine, 6) AS cosine FROM pairs p JOIN f x ON x.class_id = a JOIN f y ON y.class_id = b WHERE cosine >= 0.72 - 1e-9",
    "q_doc_classes": "SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, text) AS class_id FROM documents WHERE text IS NOT NULL",
    "q_similarity_report": f"""WITH {_VECTORS}, {_ALL_PAIRS}
        SELECT source, (1 + sqrt(1 + 8 * count(*)))::BIGINT // 2 AS texts, count(*) AS pairs, round(avg(cosine), 4) AS mean_cosine, round(quantile_cont(cosine, 0.5), 4) AS median_cosine,
          round(quantile_cont(cosine, 0.95), 4) AS p95_cosine, round(max(cosine), 4) AS max_cosine, count(*) FILTER (WHERE cosine >= 0.72) AS near_pairs,
          round(100e0 * count(*) FILTER (WHERE cosine >= 0.72) / count(*), 4) AS near_pct FROM every GROUP BY source""",
    "q_similarity_hist": f"WITH {_VECTORS}, {_ALL_PAIRS} SELECT source, least(floor(cosine * 20), 19)::INT AS bin, count(*) AS n FROM every GROUP BY ALL",
    "q_worst_pairs": f"""WITH {_VECTORS}, f AS (SELECT DISTINCT source, class_id FROM cls),
        p AS (SELECT p.source, a, b, round(cosine, 6) AS cosine FROM pairs p JOIN f x ON x.class_id = a JOIN f y ON y.class_id = b WHERE cosine >= 0.72 - 1e-9)
        SELECT source, row_number() OVER w AS rank, a, b, cosine FROM p WINDOW w AS (PARTITION BY source ORDER BY cosine DESC, a, b) QUALIFY row_number() OVER w <= 10""",
    "q_first_offenders": f"""WITH {_VECTORS}, f AS (SELECT DISTINCT source, class_id FROM cls),
        p AS (SELECT p.source, a, b, round(cosine, 6) AS cosine FROM pairs p JOIN f x ON x.class_id = a JOIN f y ON y.class_id = b WHERE cosine >= 0.72 - 1e-9)
        SELECT source, row_number() OVER w AS rank, a, b, cosine FROM p WINDOW w AS (PARTITION BY source ORDER BY a, b) QUALIFY row_number() OVER w <= 10""",
    "q_guard_log": f"""WITH RECURSIVE {_VECTORS}, {_GUARD}, acc AS (SELECT source, id, accepted FROM run),
        best AS (SELECT p.source, p.b AS id, round(cosine, 6) AS similarity, a AS closest_to FROM pairs p JOIN acc x ON x.id = p.a AND x.accepted
          QUALIFY row_number() OVER (PARTITION BY p.b ORDER BY round(cosine, 6) DESC, a) = 1)
        SELECT acc.source, acc.id AS doc_id, accepted, coalesce(similarity, 0) AS similarity, closest_to FROM acc LEFT JOIN best ON best.id = acc.id""",
    "q_duplicate_guard": f"WITH RECURSIVE {_VECTORS}, {_GUARD} SELECT source, id AS doc_id, accepted FROM run",
    "q_set_f1": f"""WITH {_CHAT}, {_JSON},
        s AS (SELECT rec_id, list_distinct(list_filter(list_transform(coalesce(parties, []), lambda v: lower(trim(v))), lambda v: v <> '')) AS p,
          list_distinct(list_transform(regexp_extract_all(clause, '[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)+'), lambda v: lower(trim(v)))) AS e FROM x WHERE js IS NOT NULL AND clause IS NOT NULL)
        SELECT rec_id, CASE WHEN len(p) = 0 AND len(e) = 0 THEN 1 ELSE round(coalesce(2e0 * len(list_intersect(p, e)) / nullif(len(p) + len(e), 0), 0), 4) END AS f1 FROM s""",
    "q_top_entities": f"""WITH {_CHAT}, {_JSON}, e AS (SELECT trim(unnest(parties)) AS entity FROM x)
        SELECT entity, count(*) AS n FROM e WHERE entity <> '' GROUP BY entity HAVING count(*) > 1 ORDER BY n DESC, entity LIMIT 8""",
    "q_rouge_l": f"""WITH {_CHAT}, k AS (SELECT rec_id, regexp_extract_all(lower(answer), '[a-z0-9_.:%-]+') AS a, regexp_extract_all(lower(clause), '[a-z0-9_.:%-]+') AS b FROM c WHERE clause IS NOT NULL AND answer IS NOT NULL),
        l AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_last(list_reduce(a, lambda row, x: list_reduce(range(1, len(b) + 1), lambda new, j:
          list_append(new, CASE WHEN b[j] = x THEN row[j] + 1 ELSE greatest(row[j + 1], new[j]) END), [0]::BIGINT[]), list_resize([]::BIGINT[], len(b) + 1, 0))) END AS n FROM k),
        m AS (SELECT rec_id, coalesce(n / nullif(len(a), 0), 0) AS pr, coalesce(n / nullif(len(b), 0), 0) AS re FROM l)
        SELECT rec_id, round(pr, 4) AS "precision", round(re, 4) AS recall, round(coalesce(2.44e0 * pr * re / nullif(re + 1.44e0 * pr, 0), 0), 4) AS f FROM m""",
    "q_clean_text": r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(headline, '[\x{00A0}\x{200B}-\x{200D}\x{2007}\x{2009}\x{202F}\x{2060}\x{3000}\x{FEFF}]', ' ', 'g'), '[\x00-\x09\x0B-\x1F]', '', 'g'),
        '[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS shown FROM headlines""",
    "q_diversity_verdict": f"""WITH {_CHAT}, {_JSON}, tr AS (SELECT rec_id AS id, clause, metadata FROM c WHERE split = 'train'),
        w AS (SELECT id, regexp_extract_all(lower(clause), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM tr WHERE clause IS NOT NULL),
        g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM w WHERE len(w) > 0),
        v AS (SELECT id, gram, count(*) AS n FROM g GROUP BY ALL), u AS (SELECT id, gram, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM v),
        p AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS cosine FROM u a JOIN u b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL), h AS (SELECT DISTINCT id FROM u),
        every AS (SELECT round(coalesce(p.cosine, 0), 6) AS cosine FROM h x JOIN h y ON x.id < y.id LEFT JOIN p ON p.a = x.id AND p.b = y.id),
        sim AS (SELECT count(*) FILTER (WHERE cosine >= 0.72) AS near_pairs, round(avg(cosine), 4) AS mean_cosine, round(quantile_cont(cosine, 0.95), 4) AS p95 FROM every),
        len AS (SELECT round(stddev_pop(n) / avg(n), 4) AS cv FROM (SELECT {_WORDS} AS n FROM (SELECT clause AS text FROM tr WHERE clause IS NOT NULL))),
        ty AS (SELECT n::DOUBLE / sum(n) OVER () AS q FROM (SELECT coalesce(metadata.clause_type, 'null') AS k, count(*) AS n FROM tr GROUP BY ALL)),
        en AS (SELECT round(sum(-q * ln(q)) / ln(count(*)), 4) AS entropy, round(100 * max(q), 4) AS top FROM ty), e AS (SELECT trim(unnest(parties)) AS e FROM x),
        un AS (SELECT round(count(DISTINCT e)::DOUBLE / nullif(count(*), 0), 3) AS uniqueness FROM e WHERE e <> ''), ed AS (SELECT count(DISTINCT metadata.edge_case) AS edges FROM tr),
        one AS (SELECT near_pairs = 0 AS near_pairs, mean_cosine < 0.5 AS mean_cosine, p95 < 0.72 AS p95_cosine, cv > 0.3 AS length_cv, entropy > 0.95 AS type_entropy, top <= 15 AS type_share, uniqueness > 0.6 AS uniqueness, edges >= 3 AS edge_cases FROM sim, len, en, un, ed),
        long AS (UNPIVOT one ON near_pairs, mean_cosine, p95_cosine, length_cv, type_entropy, type_share, uniqueness, edge_cases INTO NAME "check" VALUE passed)
        SELECT "check", passed FROM long UNION ALL SELECT 'overall', bool_and(passed) FROM long""",
    "q_numbers_in": f"""WITH {_CHAT}, n AS (SELECT rec_id, list_distinct(list_transform(regexp_extract_all(clause, '\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'), lambda v: replace(v, ',', '')::DOUBLE)) AS n FROM c WHERE clause IS NOT NULL)
        SELECT rec_id, len(n)::INT AS numbers, round(coalesce(list_sum(n), 0), 4) AS total FROM n""",
    "q_model_rollup": f"""WITH {_CHAT}, {_JSON} SELECT source, count(*) AS n, round(avg((js IS NOT NULL)::INT), 4) AS parsed, round(avg(coalesce((x_type = metadata.clause_type)::INT, 0)), 4) AS type_right,
        round(avg(CASE WHEN js IS NOT NULL THEN coalesce(len(parties), 0) ELSE 0 END), 4) AS parties FROM x WHERE clause IS NOT NULL GROUP BY source""",
    "q_sentence_count": """SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '\\d+\\.\\d+', '0', 'g'), '\\b(?:e\\.g|i\\.e|vs|etc|approx|Inc|Corp|Ltd|Q[1-4])\\.', 'X', 'gi'),
        '[.!?]+(?:\\s|$)'), lambda s: trim(s, ' ') <> ''))::INT AS sentences FROM documents WHERE text IS NOT NULL""",
    "q_text_quality": "SELECT item_id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN len(list_filter({_quoted(w)}, lambda a: contains(lower(headline), a))) > 0 THEN '{k}' END" for k, w in t.INDICATOR_WORDINGS.items()) + f"], lambda k: k IS NOT NULL)), ',') AS families, len(list_filter({_quoted(t.RELATIONAL_STEMS)}, lambda a: contains(lower(headline), a))) > 0 AS relates FROM headlines WHERE headline IS NOT NULL",
    "q_chat_render": """WITH r AS (SELECT rec_id, list_filter(messages, lambda m: m.role = 'system')[1].content AS sys, list_filter(messages, lambda m: m.role <> 'system') AS rest FROM chat)
        SELECT rec_id, md5(array_to_string(list_transform(rest, lambda m, i: '<' || m.role || '>' || CASE WHEN i = 1 THEN coalesce(sys || chr(10) || chr(10), '') ELSE '' END || coalesce(m.content, '')), chr(10))) AS digest FROM r""",
    "q_first_turn": f"WITH {_CHAT} SELECT rec_id, length(clause) AS clause_chars, length(answer) AS answer_chars, contains(answer, '```') AS fence, NOT (starts_with(trim(answer), '{{') OR starts_with(trim(answer), '```')) AS preamble FROM c",
    "q_trim_budget": """
        WITH m AS (SELECT rec_id AS conv_id, unnest(messages, recursive := true), unnest(range(len(messages)))::INT AS turn FROM chat),
        s AS (SELECT *, turn = 0 AS f, sum(CASE WHEN turn = 0 THEN 0 ELSE coalesce(length(content), 0) END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS su,
          sum(CASE WHEN turn = 0 THEN coalesce(length(content), 0) END) OVER (PARTITION BY conv_id) AS h, turn = max(turn) OVER (PARTITION BY conv_id) AS l FROM m),
        k AS (SELECT *, (su + h <= 1200 OR l) AND NOT f AS tail FROM s),
        z AS (SELECT *, min(CASE WHEN tail AND role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS u FROM k)
        SELECT conv_id, turn, role FROM z WHERE f OR (tail AND turn >= u)""",
    "q_stratified_split": """
        WITH r AS (SELECT rec_id, metadata.clause_type AS t, md5(rec_id::VARCHAR || '|7') AS h FROM chat),
        n AS (SELECT rec_id, row_number() OVER (PARTITION BY t ORDER BY h, rec_id) AS r, count(*) OVER (PARTITION BY t) AS n FROM r),
        k AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.1e0, 0)::INT) ELSE 0 END AS take FROM n)
        SELECT rec_id, CASE WHEN r <= take THEN 'test' WHEN r <= 2 * take THEN 'validation' ELSE 'train' END AS split FROM k""",
    "q_batches_of_8": "SELECT symbol, item_id, ((row_number() OVER (PARTITION BY symbol ORDER BY item_id) - 1) // 8)::INT AS batch FROM headlines WHERE symbol IS NOT NULL",
    "q_grid_seeds": """
        WITH v AS (SELECT axis, category FROM sample_targets),
        g AS (SELECT a.category AS clause_type, b.category AS jurisdiction, c.category AS complexity FROM v a, v b, v c WHERE a.axis = 'clause_type' AND b.axis = 'jurisdiction' AND c.axis = 'complexity'),
        h AS (SELECT metadata.clause_type AS clause_type, metadata.jurisdiction AS jurisdiction, metadata.complexity AS complexity, count(*) AS n FROM chat GROUP BY ALL)
        SELECT clause_type, jurisdiction, complexity, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (clause_type, jurisdiction, complexity)""",
    "q_knn_cosine": f"WITH {_NEAR} SELECT query_id, id, rank::INT AS rank, round(distance, 5) AS distance FROM near",
    "q_nn_label_vote": f"""WITH {_NEAR}, c AS (SELECT query_id, label, count(*) AS n FROM near GROUP BY ALL),
        w AS (SELECT query_id, label AS voted FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1)
        SELECT query_id, voted, voted = label AS right FROM w JOIN embeddings ON query_id = vec_id""",
    "q_calibrate": f"""WITH {_NEAR} SELECT round(quantile_cont(distance, 0.75), 5) AS threshold, round(avg(distance), 5) AS mean, round(quantile_cont(distance, 0.5), 5) AS median, round(quantile_cont(distance, 0.25), 5) AS p25,
        round(quantile_cont(distance, 0.9), 5) AS p90, round(max(distance), 5) AS maximum, count(*) AS n FROM near WHERE rank = 1""",
    "q_gate": f"WITH {_NEAR}, t AS (SELECT quantile_cont(distance, 0.75) AS threshold FROM near WHERE rank = 1) SELECT query_id, distance > threshold AS fires FROM near, t WHERE rank = 1",
}
SQL["q_compare"] = f"""WITH r AS ({SQL["q_model_rollup"]}),
  l AS (SELECT source, unnest(['parsed', 'type_right', 'parties']) AS metric, unnest([parsed, type_right, parties]) AS v FROM r)
  SELECT b.metric, b.v AS base, o.v AS other, round(o.v - b.v, 4) AS delta, CASE WHEN abs(o.v - b.v) < 1e-9 THEN 'same' WHEN o.v > b.v THEN 'better' ELSE 'worse' END AS mark
  FROM l b JOIN l o USING (metric) WHERE b.source = 'teacher_small' AND o.source = 'teacher_large'"""
SQL["q_rule_violations"] = f"""WITH {_CHAT}, {_JSON} SELECT rec_id, concat_ws('|',
  CASE WHEN NOT coalesce(list_contains(string_split('financial_covenant negative_covenant event_of_default affirmative_covenant interest_provision repayment_prepayment representation_warranty security_collateral indemnity conditions_precedent change_of_control governing_law_jurisdiction', ' '), x_type), false) THEN 'clause_type' END,
  CASE WHEN NOT coalesce(len(parties) BETWEEN 1 AND 6 AND len(list_filter(parties, lambda p: length(trim(p)) <= 1)) = 0, false) THEN 'parties' END,
  CASE WHEN NOT coalesce(length(obligation) BETWEEN 15 AND 400, false) THEN 'obligation' END, CASE WHEN length(trigger_condition) > 300 THEN 'trigger_condition' END,
  CASE WHEN NOT coalesce(len(terms) <= 8, false) THEN 'financial_terms' END, CASE WHEN NOT coalesce(risk_flag IN ('low', 'medium', 'high'), false) THEN 'risk_flag' END,
  CASE WHEN NOT coalesce(length(rationale) BETWEEN 10 AND 300, false) THEN 'risk_rationale' END) AS violations FROM x WHERE answer IS NOT NULL"""
SQL["q_grounding"] = f"""WITH {_CHAT}, {_JSON},
  b AS (SELECT rec_id, lower(clause) AS k, coalesce(parties, []) AS ps, coalesce(terms, []) AS ts,
    list_transform(regexp_extract_all(lower(clause), '\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'), lambda v: replace(v, ',', '')::DOUBLE) AS nums FROM x WHERE js IS NOT NULL AND clause IS NOT NULL),
  pp AS (SELECT rec_id, k, unnest(ps) AS p FROM b),
  pb AS (SELECT rec_id, count(*) AS n FROM pp WHERE NOT contains(k, lower(p)) AND len(list_filter(regexp_extract_all(lower(p), '[a-z]{{4,}}'),
    lambda w: NOT list_contains(['limited', 'holdings', 'group', 'company', 'the'], w) AND contains(k, w))) = 0 GROUP BY rec_id),
  tt AS (SELECT rec_id, k, nums, t, list_transform(regexp_extract_all(t, '\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'), lambda v: replace(v, ',', '')::DOUBLE) AS own FROM (SELECT rec_id, k, nums, unnest(ts) AS t FROM b)),
  tb AS (SELECT rec_id, count(*) AS n FROM tt WHERE NOT contains(k, trim(lower(t))) AND NOT CASE WHEN len(own) > 0
    THEN len(list_filter(own, lambda v: len(list_filter(nums, lambda c: abs(v - c) <= greatest(1e-6, abs(v) * 1e-6))) = 0)) = 0
    ELSE len(list_filter(regexp_extract_all(lower(t), '[a-z]{{3,}}'), lambda w: contains(k, w))) > 0 END GROUP BY rec_id)
  SELECT rec_id, coalesce(pb.n, 0)::INT AS bad_parties, coalesce(tb.n, 0)::INT AS bad_terms, coalesce(pb.n, 0) = 0 AND coalesce(tb.n, 0) = 0 AS grounded FROM b LEFT JOIN pb USING (rec_id) LEFT JOIN tb USING (rec_id)"""
