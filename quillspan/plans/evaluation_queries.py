"""Queries over outputs of models and their references, with their SQL.

The outputs are the answers of the chat records, every sixth of them as it is and the others altered as models alter
them; the references are the answers themselves, joined by the id of the record.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions import text as t
from quillspan.operators import chat as ch
from quillspan.operators import evaluation as ev
from quillspan.operators import signals as g
from quillspan.sources.tables import table


def _answers(spark, d):
    rows = table(spark, d, "chat").select("rec_id", "split", "metadata", t.first_turn(F.col("messages"), "user").alias("clause"), t.first_turn(F.col("messages"), "assistant").alias("reference"))
    return rows.where("clause is not null and reference is not null")


def _outputs(spark, d):
    """(rec_id, model, clause, reference, raw)."""
    a, kind = F.col("reference"), F.col("rec_id") % 6
    raw = (
        F.when(kind == 1, F.concat(F.lit("```json\n"), a, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Here it is: "), a)).when(kind == 3, F.left(a, (F.length(a) / 2).cast("int")))
        .when(kind == 4, F.replace(F.replace(a, F.lit('"low"'), F.lit('"high"')), F.lit("Holdings"), F.lit("Group"))).when(kind == 5, F.replace(a, F.lit("null"), F.lit('"on notice"'))).otherwise(a)
    )
    given = _answers(spark, d).select("rec_id", F.when(F.col("rec_id") % 4 < 2, "base").otherwise("tuned").alias("model"), raw.alias("raw"))
    return given.join(_answers(spark, d).select("rec_id", "clause", "reference"), "rec_id")


def q_scored_outputs(spark, d):
    """Every score of every output."""
    scored = ev.score_outputs(_outputs(spark, d))
    return scored.select("rec_id", "fence", "preamble", "precision", "recall", "f", "parsed", "clause_type", "risk_flag", "parties_f1", "terms_f1", "trigger_null", "overall", "grounded")


def q_eval_rollup(spark, d):
    """Thirteen metrics and the failures of each model."""
    return ev.roll_up_scores(ev.score_outputs(_outputs(spark, d)))


def q_eval_compare(spark, d):
    """The two models side by side."""
    return ev.compare_models(q_eval_rollup(spark, d), "base", "tuned")


def q_canonical_json(spark, d):
    """Answers as JSON in a fixed order of fields."""
    return _answers(spark, d).select("rec_id", F.md5(ev.canonical_json(ev.extraction(F.col("reference")))).alias("digest"))


def q_judge_scores(spark, d):
    """Answers of a judge, forced into range; they are made up from the record's id."""
    n = F.col("rec_id")
    payload = F.format_string(
        '{"schema_compliance": %d, "type_accuracy": "%s", "extraction_fidelity": %d.5, "verdict": " %s", "specific_errors": [%s]}', n % 9 - 2, F.when(n % 3 == 0, "good").otherwise((n % 6).cast("string")), n % 5,
        F.when(n % 4 == 0, "Correct").when(n % 4 == 1, "hallucinated").otherwise("fine"), F.array_join(F.transform(F.sequence(F.lit(1), (n % 8 + 1).cast("int")), lambda i: F.format_string('"e%d"', i)), ","),
    )
    rows = table(spark, d, "chat").select("rec_id", F.when(n % 10 == 0, "no answer").otherwise(payload).alias("p")).select("rec_id", ev.judged(F.col("p")).alias("j"))
    return rows.select("rec_id", *[F.col(f"j.{c}").alias(c) for c in (*ev.JUDGED, "mean_score", "verdict")], F.coalesce(F.size("j.errors"), F.lit(0)).alias("errors"))


def q_label_rates(spark, d):
    """Labels of a review by split; they are made up from the record's id."""
    n = F.col("rec_id") % 7
    label = F.when(n < 3, "correct").when(n < 5, "partially_correct").when(n == 5, "hallucinated")
    return ev.label_rates(table(spark, d, "chat").select("split", label.alias("label")), ["split"])


def _second(spark, d):
    rows = _outputs(spark, d).where("model = 'base'")
    tried = rows.select("rec_id", F.col("raw").alias("first"), F.when(F.col("rec_id") % 5 != 0, F.col("reference")).alias("second"), (F.length("raw") % 10).cast("double").alias("surprise"))
    return ev.choose_second(tried, "surprise", F.lit(3.0))


def q_second_pass(spark, d):
    """Which output is taken where the first was surprising."""
    return _second(spark, d).select("rec_id", "fired", F.md5("final").alias("final"), "improved")


def q_second_pass_summary(spark, d):
    """How often a second output was tried and helped, and an example."""
    return ev.second_pass_summary(_second(spark, d), "rec_id")


def q_perplexity(spark, d):
    """Perplexity of lists of log probabilities, made of the embeddings."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("p"))
    return rows.select("vec_id", F.round(ev.perplexity(F.col("p")), 6).alias("perplexity"))


def q_retrieval_rows(spark, d):
    """Train records that may be retrieved: their clause stands in no evaluation split."""
    rows = table(spark, d, "chat").select("rec_id", "split", t.first_turn(F.col("messages"), "user").alias("clause"))
    return ev.retrieval_rows(rows, text="clause").select("rec_id")


def q_valid_examples(spark, d):
    """Records and how many of them break a rule, by split."""
    rows = _answers(spark, d).withColumn("x", ev.extraction(F.col("reference")))
    return ch.kept_and_rejected(rows, ch.extraction_rules("x"), ["split"])


def q_seed_cells(spark, d):
    """One draw of thirty different cells of the grid of types, jurisdictions and complexities, types in turn."""
    targets = table(spark, d, "sample_targets")
    axes = {axis: targets.where(F.col("axis") == axis).select(F.col("category").alias(axis)) for axis in ("clause_type", "jurisdiction", "complexity")}
    return ch.draw_cells(axes, "clause_type", 30)


def q_pe_source(spark, d):
    """Price to earnings of parts that stand for companies, and where it is from."""
    trailing = F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice") / 100)
    eps = F.when(F.col("p_size") % 5 != 0, F.col("p_size") - 10.0)
    pe = g.price_to_earnings(F.col("p_retailprice"), trailing, eps)
    return table(spark, d, "part").select("p_partkey", pe.alias("x")).select("p_partkey", F.round("x.value", 6).alias("pe"), "x.source")


QUERIES = {f.__name__: f for f in (
    q_scored_outputs, q_eval_rollup, q_eval_compare, q_canonical_json, q_judge_scores, q_label_rates, q_second_pass, q_second_pass_summary, q_perplexity, q_retrieval_rows, q_valid_examples, q_seed_cells,
    q_pe_source,
)}

_TURN = "list_filter(messages, lambda m: m.role = '{}')[1].content"
_ANSWERS = f"""ans AS (SELECT * FROM (SELECT rec_id, split, {_TURN.format('user')} AS clause, {_TURN.format('assistant')} AS reference FROM chat) WHERE clause IS NOT NULL AND reference IS NOT NULL)"""
_OUTPUTS = _ANSWERS + """,
outs AS (SELECT rec_id, CASE WHEN rec_id % 4 < 2 THEN 'base' ELSE 'tuned' END AS model, clause, reference, CASE rec_id % 6
  WHEN 1 THEN '```json' || chr(10) || reference || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || reference WHEN 3 THEN left(reference, length(reference) // 2)
  WHEN 4 THEN replace(replace(reference, '"low"', '"high"'), 'Holdings', 'Group') WHEN 5 THEN replace(reference, 'null', '"on notice"') ELSE reference END AS raw FROM ans)"""


def _read(p: str, column: str) -> str:
    """The parts of the extraction in a column, under names that begin with ``p``."""
    js = f"CASE WHEN json_valid({column}) THEN {column} WHEN json_valid(regexp_extract({column}, '(?s)\\{{.*\\}}')) THEN regexp_extract({column}, '(?s)\\{{.*\\}}') END"
    names = {"ty": "clause_type", "ob": "obligation", "tr": "trigger_condition", "ri": "risk_flag", "ra": "risk_rationale"}
    return f"{js} AS {p}js, " + ", ".join(f"({js}) ->> '$.{field}' AS {p}{name}" for name, field in names.items()) + f", (({js}) -> '$.parties')::VARCHAR[] AS {p}pa, (({js}) -> '$.financial_terms')::VARCHAR[] AS {p}te"


def _shape(p: str) -> str:
    types = "financial_covenant negative_covenant event_of_default affirmative_covenant interest_provision repayment_prepayment representation_warranty security_collateral indemnity conditions_precedent change_of_control governing_law_jurisdiction"
    return f"""({p}js IS NOT NULL AND coalesce(list_contains(string_split('{types}', ' '), {p}ty), false) AND coalesce(len({p}pa) BETWEEN 1 AND 6 AND len(list_filter({p}pa, lambda q: length(trim(q)) <= 1)) = 0, false)
      AND coalesce(length({p}ob) BETWEEN 15 AND 400, false) AND coalesce(length({p}tr) <= 300, true) AND coalesce(len({p}te) <= 8, false) AND coalesce({p}ri IN ('low', 'medium', 'high'), false) AND coalesce(length({p}ra) BETWEEN 10 AND 300, false))"""


def _set_f1(a: str, b: str) -> str:
    c = lambda x: f"list_distinct(list_filter(list_transform(coalesce({x}, []), lambda v: lower(trim(v))), lambda v: v <> ''))"
    return f"CASE WHEN len({c(a)}) = 0 AND len({c(b)}) = 0 THEN 1 ELSE round(coalesce(2e0 * len(list_intersect({c(a)}, {c(b)})) / nullif(len({c(a)}) + len({c(b)}), 0), 0), 4) END"


_NONE = "coalesce(lower(trim({0})) IN ('', 'none', 'n/a', 'null', 'not applicable'), true)"
_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_.:%-]+')"
#: Length of the longest common subsequence of the lists a and b.
LCS = """CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_last(list_reduce(a, lambda row, x: list_reduce(range(1, len(b) + 1), lambda new, j:
  list_append(new, CASE WHEN b[j] = x THEN row[j] + 1 ELSE greatest(row[j + 1], new[j]) END), [0]::BIGINT[]), list_resize([]::BIGINT[], len(b) + 1, 0))) END"""
_NUMBERS = "list_transform(regexp_extract_all({}, '\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?|\\d+(?:\\.\\d+)?'), lambda v: replace(v, ',', '')::DOUBLE)"
_BAD = f"""(len(list_filter(coalesce(xpa, []), lambda p: NOT contains(lower(clause), lower(p)) AND len(list_filter(regexp_extract_all(lower(p), '[a-z]{{4,}}'),
    lambda w: NOT list_contains(['limited', 'holdings', 'group', 'company', 'the'], w) AND contains(lower(clause), w))) = 0))
  + len(list_filter(coalesce(xte, []), lambda q: NOT contains(lower(clause), trim(lower(q))) AND NOT CASE WHEN len({_NUMBERS.format('q')}) > 0
    THEN len(list_filter({_NUMBERS.format('q')}, lambda v: len(list_filter({_NUMBERS.format('lower(clause)')}, lambda c: abs(v - c) <= greatest(1e-6, abs(v) * 1e-6))) = 0)) = 0
    ELSE len(list_filter(regexp_extract_all(lower(q), '[a-z]{{3,}}'), lambda w: contains(lower(clause), w))) > 0 END)))"""
_SCORED = f"""{_OUTPUTS},
r0 AS (SELECT *, {_read('x', 'raw')}, {_read('y', 'reference')}, {_TOKENS.format('raw')} AS a, {_TOKENS.format('reference')} AS b FROM outs),
r1 AS (SELECT *, {_shape('x')} AS parsed, {_shape('y')} AS known, {LCS} AS lcs, {_BAD} AS bad FROM r0),
r2 AS (SELECT *, coalesce(lcs / nullif(len(a), 0), 0) AS pr, coalesce(lcs / nullif(len(b), 0), 0) AS re FROM r1),
r3 AS (SELECT *, contains(raw, '```') AS fence, trim(raw) <> '' AND left(trim(raw), 1) <> '{{' AND left(trim(raw), 3) <> '```' AS preamble,
  round(pr, 4) AS "precision", round(re, 4) AS recall, round(coalesce(2.44e0 * pr * re / nullif(re + 1.44e0 * pr, 0), 0), 4) AS f,
  CASE WHEN NOT parsed THEN 0e0 WHEN known THEN (xty = yty)::INT::DOUBLE END AS clause_type, CASE WHEN NOT parsed THEN 0e0 WHEN known THEN (xri = yri)::INT::DOUBLE END AS risk_flag,
  CASE WHEN NOT parsed THEN 0e0 WHEN known THEN {_set_f1('xpa', 'ypa')} END::DOUBLE AS parties_f1, CASE WHEN NOT parsed THEN 0e0 WHEN known THEN {_set_f1('xte', 'yte')} END::DOUBLE AS terms_f1,
  CASE WHEN NOT parsed THEN 0e0 WHEN known THEN ({_NONE.format('xtr')} = {_NONE.format('ytr')})::INT::DOUBLE END AS trigger_null, parsed AND (NOT known OR bad = 0) AS grounded FROM r2),
sc AS (SELECT *, round((clause_type + risk_flag + parties_f1 + terms_f1 + trigger_null) / 5, 4) AS overall, NOT grounded AS ungrounded FROM r3)"""
_ROLL = "SELECT model, count(*) AS n, " + ", ".join(f'round(avg(coalesce("{c}"::DOUBLE, 0)), 4) AS {m}' for m, c in ev.MEANS.items()) + ", count(*) FILTER (WHERE parsed AND NOT grounded) AS grounding_failures, count(*) FILTER (WHERE NOT parsed) AS unparseable FROM sc GROUP BY model"
_SECOND = f"""{_OUTPUTS}, s0 AS (SELECT rec_id, raw AS first, CASE WHEN rec_id % 5 <> 0 THEN reference END AS second, length(raw) % 10 AS surprise FROM outs WHERE model = 'base'),
s1 AS (SELECT *, {_read('x', 'first')}, {_read('y', 'second')} FROM s0), s2 AS (SELECT *, {_shape('x')} AS ok, second IS NOT NULL AND {_shape('y')} AS better, surprise > 3 AS fired FROM s1),
ch AS (SELECT rec_id, second, fired, CASE WHEN fired AND second IS NOT NULL AND better THEN second ELSE first END AS final,
  CASE WHEN NOT fired OR second IS NULL THEN NULL WHEN better AND NOT ok THEN true WHEN NOT better THEN false END AS improved FROM s2)"""
_J = lambda name: f"least(5, greatest(0, coalesce(try_cast(p ->> '$.{name}' AS DOUBLE), 0)))"

SQL = {
    "q_scored_outputs": f"WITH {_SCORED} SELECT rec_id, fence, preamble, \"precision\", recall, f, parsed, clause_type, risk_flag, parties_f1, terms_f1, trigger_null, overall, grounded FROM sc",
    "q_eval_rollup": f"WITH {_SCORED} {_ROLL}",
    "q_eval_compare": f"WITH {_SCORED}, r AS ({_ROLL}), l AS (SELECT model, unnest({list(ev.MEANS)}) AS metric, unnest([{', '.join(ev.MEANS)}]) AS v FROM r)"
    + f""" SELECT b.metric, b.v AS base, o.v AS other, round(o.v - b.v, 4) AS delta, CASE WHEN abs(o.v - b.v) < 1e-9 THEN 'same'
          WHEN (o.v > b.v) <> list_contains({list(ev.LOWER_IS_BETTER)}, b.metric) THEN 'better' ELSE 'worse' END AS mark FROM l b JOIN l o USING (metric) WHERE b.model = 'base' AND o.model = 'tuned'""",
    "q_canonical_json": f"""WITH {_ANSWERS}, r0 AS (SELECT rec_id, {_read('x', 'reference')} FROM ans)
        SELECT rec_id, md5(to_json({{'clause_type': xty, 'parties': xpa, 'obligation': xob, 'trigger_condition': xtr, 'financial_terms': xte, 'risk_flag': xri, 'risk_rationale': xra}})::VARCHAR) AS digest FROM r0""",
    "q_judge_scores": f"""
        WITH j AS (SELECT rec_id, CASE WHEN rec_id % 10 = 0 THEN NULL ELSE json_object('schema_compliance', rec_id % 9 - 2, 'type_accuracy', CASE WHEN rec_id % 3 = 0 THEN 'good' ELSE (rec_id % 6)::VARCHAR END, 'extraction_fidelity', rec_id % 5 + 0.5) END AS p FROM chat),
        s AS (SELECT rec_id, p, {', '.join(f'CASE WHEN p IS NOT NULL THEN {_J(x)} END AS {x}' for x in ev.JUDGED)} FROM j)
        SELECT rec_id, {', '.join(ev.JUDGED)}, round(({' + '.join(ev.JUDGED)}) / 4, 3) AS mean_score, CASE WHEN p IS NULL THEN NULL WHEN rec_id % 4 = 0 THEN 'correct' WHEN rec_id % 4 = 1 THEN 'hallucinated' ELSE 'partially_correct' END AS verdict,
          CASE WHEN p IS NULL THEN 0 ELSE least(5, rec_id % 8 + 1) END::INT AS errors FROM s""",
    "q_label_rates": """
        WITH l AS (SELECT split, CASE WHEN rec_id % 7 < 3 THEN 'correct' WHEN rec_id % 7 < 5 THEN 'partially_correct' WHEN rec_id % 7 = 5 THEN 'hallucinated' END AS label FROM chat)
        SELECT split, count(*) AS reviewed, count(*) >= 10 AS enough, count(*) FILTER (WHERE label = 'correct') AS correct, count(*) FILTER (WHERE label = 'partially_correct') AS partially_correct,
          count(*) FILTER (WHERE label = 'hallucinated') AS hallucinated, round(100e0 * count(*) FILTER (WHERE label = 'correct') / count(*), 1) AS correct_pct,
          round(100e0 * count(*) FILTER (WHERE label = 'hallucinated') / count(*), 1) AS hallucinated_pct FROM l WHERE label IS NOT NULL GROUP BY split""",
    "q_second_pass": f"WITH {_SECOND} SELECT rec_id, fired, md5(final) AS final, improved FROM ch",
    "q_second_pass_summary": f"""WITH {_SECOND} SELECT count(*) AS outputs, count(*) FILTER (WHERE fired AND second IS NOT NULL) AS fired, count(*) FILTER (WHERE improved) AS improved, count(*) FILTER (WHERE NOT improved) AS unchanged,
        coalesce(min(rec_id) FILTER (WHERE improved), min(rec_id) FILTER (WHERE fired AND second IS NOT NULL)) AS example FROM ch""",
    "q_perplexity": "SELECT vec_id, round(exp(list_avg(list_transform(embedding, lambda x: abs(x::DOUBLE)))), 6) AS perplexity FROM embeddings",
    "q_retrieval_rows": f"""WITH c AS (SELECT rec_id, split, {_TURN.format('user')} AS clause FROM chat)
        SELECT rec_id FROM c WHERE split = 'train' AND clause IS NOT NULL AND clause NOT IN (SELECT clause FROM c WHERE split <> 'train' AND clause IS NOT NULL)""",
    "q_valid_examples": f"WITH {_ANSWERS}, r0 AS (SELECT split, {_read('x', 'reference')} FROM ans) SELECT split, count(*) AS n, count(*) FILTER (WHERE {_shape('x')}) AS kept, count(*) FILTER (WHERE NOT {_shape('x')}) AS rejected FROM r0 GROUP BY split",
    "q_seed_cells": """
        WITH a AS (SELECT category AS clause_type FROM sample_targets WHERE axis = 'clause_type'), b AS (SELECT category AS jurisdiction FROM sample_targets WHERE axis = 'jurisdiction'), c AS (SELECT category AS complexity FROM sample_targets WHERE axis = 'complexity'),
        k AS (SELECT *, row_number() OVER (PARTITION BY clause_type ORDER BY md5(concat_ws('|', clause_type, jurisdiction, complexity, '7')), jurisdiction, complexity) AS turn FROM a, b, c),
        n AS (SELECT *, row_number() OVER (ORDER BY turn, clause_type) - 1 AS seed FROM k)
        SELECT seed::INT AS seed, clause_type, jurisdiction, complexity, seed % 3 = 0 AS edge FROM n WHERE seed < 30""",
    "q_pe_source": """
        WITH p AS (SELECT p_partkey, p_retailprice AS c, CASE WHEN p_size % 3 = 0 THEN p_retailprice / 100 END AS t, CASE WHEN p_size % 5 <> 0 THEN p_size - 10e0 END AS e FROM part)
        SELECT p_partkey, round(coalesce(t, CASE WHEN e > 0 THEN c / e END), 6) AS pe, CASE WHEN t IS NOT NULL THEN 'trailing' WHEN e > 0 THEN 'computed' ELSE 'unavailable' END AS source FROM p""",
}
