"""Model outputs scored against references: single outputs, roll-ups, second passes, judges, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import salvaged_json
from quillspan.operators import clean
from quillspan.operators.chat import extraction_rules, violations
from quillspan.operators.metrics import compare, overlap_score, set_f1, ungrounded_parties, ungrounded_terms

# Fields of an extraction, in order, and their types.
EXTRACTION = "clause_type string, parties array<string>, obligation string, trigger_condition string, financial_terms array<string>, risk_flag string, risk_rationale string"
FIELDS = [part.split()[0] for part in EXTRACTION.split(", ")]
# The metrics of a roll-up that are means of the column of that name, those of which less is better, labels of a review
# and the number of reviewed outputs that it takes.
MEANS = {
    "rouge_l_f1": "f", "rouge_l_precision": "precision", "rouge_l_recall": "recall", "json_validity_rate": "parsed", "code_fence_rate": "fence", "preamble_rate": "preamble",
    "clause_type_accuracy": "clause_type", "risk_flag_accuracy": "risk_flag", "parties_f1": "parties_f1", "financial_terms_f1": "terms_f1", "trigger_null_accuracy": "trigger_null",
    "field_accuracy_overall": "overall", "automated_hallucination_rate": "ungrounded",
}
LOWER_IS_BETTER = ("code_fence_rate", "preamble_rate", "automated_hallucination_rate")
LABELS, LEAST_REVIEWED = ("correct", "partially_correct", "hallucinated"), 10
JUDGED, VERDICTS = ("schema_compliance", "type_accuracy", "extraction_fidelity", "reasoning_quality"), ("correct", "partially_correct", "hallucinated")


def extraction(raw: Column) -> Column:
    """The extraction struct of an output; NULL where it holds no object."""
    return F.from_json(salvaged_json(raw), EXTRACTION)


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def score_outputs(df: DataFrame, clause: str = "clause", reference: str = "reference", raw: str = "raw") -> DataFrame:
    """``df`` with the scores of each output ``raw`` against ``reference`` and the source ``clause``; all in one row, without a shuffle.

    fence and preamble; precision, recall and f of the words in order, on the raw output; parsed (an object that breaks no rule
    of shape); clause_type, risk_flag, parties_f1, terms_f1, trigger_null and overall (their mean, 4 places); grounded, ungrounded.  An
    output that doesn't parse has scores of 0 and isn't grounded.  Where the reference itself is invalid the field scores are NULL
    and the output counts as grounded.  A NULL output is an empty one.
    """
    text = F.trim(F.coalesce(raw, F.lit("")))
    rows = df.withColumns({"_x": extraction(text), "_y": extraction(F.col(reference)), "_s": overlap_score(F.coalesce(raw, F.lit("")), F.col(reference))})
    parsed = F.col("_x").isNotNull() & (F.size(violations(extraction_rules("_x"))) == 0)
    known = F.col("_y").isNotNull() & (F.size(violations(extraction_rules("_y"))) == 0)
    rows = rows.withColumns({"parsed": parsed, "_known": known, "fence": clean.has_fence(text), "preamble": (text != "") & clean.has_preamble(text)})

    def scored(value: Column) -> Column:
        return F.when(~F.col("parsed"), 0.0).when(F.col("_known"), value)

    trigger = [clean.blank_to_null(F.col(f"{c}.trigger_condition")).isNull() for c in ("_x", "_y")]
    rows = rows.withColumns({
        "clause_type": scored((F.col("_x.clause_type") == F.col("_y.clause_type")).cast("double")), "risk_flag": scored((F.col("_x.risk_flag") == F.col("_y.risk_flag")).cast("double")),
        "parties_f1": scored(set_f1(F.col("_x.parties"), F.col("_y.parties"))), "terms_f1": scored(set_f1(F.col("_x.financial_terms"), F.col("_y.financial_terms"))),
        "trigger_null": scored((trigger[0] == trigger[1]).cast("double")),
        "_bad": F.size(ungrounded_parties(_strings(F.col("_x.parties")), F.col(clause))) + F.size(ungrounded_terms(_strings(F.col("_x.financial_terms")), F.col(clause))),
    })
    overall = F.round((F.col("clause_type") + F.col("risk_flag") + F.col("parties_f1") + F.col("terms_f1") + F.col("trigger_null")) / 5, 4)
    grounded = F.col("parsed") & (~F.col("_known") | (F.col("_bad") == 0))
    rows = rows.withColumns({"overall": overall, "grounded": grounded, "precision": F.col("_s.precision"), "recall": F.col("_s.recall"), "f": F.col("_s.f")})
    return rows.withColumn("ungrounded", ~F.col("grounded")).drop("_x", "_y", "_s", "_known", "_bad")


def roll_up_scores(scored: DataFrame, model: str = "model") -> DataFrame:
    """One row a model: n, the thirteen metrics of MEANS over all its rows (missing scores count 0), grounding_failures and unparseable."""
    means = [F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 4).alias(name) for name, c in MEANS.items()]
    return scored.groupBy(model).agg(F.count("*").alias("n"), *means, F.count_if(F.col("parsed") & ~F.col("grounded")).alias("grounding_failures"), F.count_if(~F.col("parsed")).alias("unparseable"))


def compare_models(rolled: DataFrame, base: str, other: str, model: str = "model") -> DataFrame:
    """(metric, base, other, delta, mark) of two models' roll-ups."""
    return compare(rolled.where(F.col(model) == base), rolled.where(F.col(model) == other), list(MEANS), LOWER_IS_BETTER)


def canonical_json(x: Column, fields: list[str] = FIELDS) -> Column:
    """A struct as JSON with its fields in a fixed order, NULLs kept."""
    return F.to_json(F.struct(*[x[f].alias(f) for f in fields]), {"ignoreNullFields": "false"})


def judged(payload: Column) -> Column:
    """A judge's answer (JSON) as struct: each score forced into 0..5 (0 if it is no number), their mean, a known verdict, at most five errors.

    NULL where the answer is no object.
    """
    get = lambda name: F.get_json_object(payload, f"$.{name}")
    score = {name: F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan(get(name).try_cast("double")), get(name).try_cast("double")), F.lit(0.0)))) for name in JUDGED}
    verdict = F.lower(F.trim(get("verdict")))
    errors = F.slice(F.transform(F.coalesce(F.from_json(get("specific_errors"), "array<string>"), F.array().cast("array<string>")), lambda e: F.left(e, F.lit(200))), 1, 5)
    out = F.struct(
        *[v.alias(k) for k, v in score.items()], F.round(sum(score.values()) / len(score), 3).alias("mean_score"),
        F.when(verdict.isin(*VERDICTS), verdict).otherwise("partially_correct").alias("verdict"), errors.alias("errors"),
    )
    return F.when(F.json_object_keys(payload).isNotNull(), out)


def label_rates(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by…, reviewed, enough, one count a label, correct_pct, hallucinated_pct): reviews with a label, whatever it is, against those known."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*by).agg(F.count("*").alias("reviewed"), *[F.count_if(F.col(label) == x).alias(x) for x in LABELS])
    pct = lambda c: F.round(100 * F.col(c) / F.col("reviewed"), 1).alias(f"{c}_pct")
    return counts.select(*by, "reviewed", (F.col("reviewed") >= LEAST_REVIEWED).alias("enough"), *LABELS, pct("correct"), pct("hallucinated"))


def perplexity(log_probabilities: Column) -> Column:
    """exp of the mean negative log probability of a list of tokens; infinity for an empty one."""
    total = F.aggregate(log_probabilities, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(log_probabilities) == 0, F.lit(float("inf"))).otherwise(F.exp(-total / F.size(log_probabilities)))


def choose_second(df: DataFrame, surprise: str, threshold: Column, first: str = "first", second: str = "second") -> DataFrame:
    """``df`` with fired, final and improved: a second output counts where ``surprise`` is above ``threshold``.

    The second is taken if it is valid: improved is true if the first wasn't, NULL if both are; else the first stays and improved is
    false.  Where nothing fired, or there is no second output, the first stays and improved is NULL.
    """
    rows = df.withColumns({"_x": extraction(F.col(first)), "_y": extraction(F.col(second))})
    valid = {c: F.col(c).isNotNull() & (F.size(violations(extraction_rules(c))) == 0) for c in ("_x", "_y")}
    fired = F.coalesce(F.col(surprise) > threshold, F.lit(False))
    tried = fired & F.col(second).isNotNull()
    rows = rows.withColumns({"fired": fired, "_ok": valid["_x"], "_better": valid["_y"]})
    improved = F.when(tried & F.col("_better") & ~F.col("_ok"), True).when(tried & ~F.col("_better"), False)
    return rows.withColumns({"final": F.when(tried & F.col("_better"), F.col(second)).otherwise(F.col(first)), "improved": improved}).drop("_x", "_y", "_ok", "_better")


def second_pass_summary(chosen: DataFrame, id: str, second: str = "second") -> DataFrame:
    """One row: outputs, fired, improved, unchanged, and the id of the example to show: the first that improved, else the first that fired."""
    tried = F.col("fired") & F.col(second).isNotNull()
    example = F.min(F.when(tried, F.struct((~F.coalesce("improved", F.lit(False))).alias("rank"), F.col(id).alias("id"))))
    return chosen.agg(F.count("*").alias("outputs"), F.count_if(tried).alias("fired"), F.count_if("improved").alias("improved"), F.count_if(~F.col("improved")).alias("unchanged"), example.alias("_e")).select("outputs", "fired", "improved", "unchanged", F.col("_e.id").alias("example"))


def review_sheet(scored: DataFrame, id: str, clause: str = "clause", reference: str = "reference", raw: str = "raw") -> Column:
    """The page of a manual review of each row of ``score_outputs``: clause, reference and output, a suggestion, and an empty label."""
    hint = F.when(~F.col("parsed"), "unparseable").when(F.col("ungrounded"), "ungrounded values").otherwise("nothing ungrounded found")
    output = F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "<empty>").otherwise(F.col(raw))
    return F.concat_ws(
        "\n", F.concat(F.lit("## "), F.col(id).cast("string")), F.lit("Clause:"), F.col(clause), F.lit("Reference:"), F.col(reference), F.lit("Output:"), output,
        F.concat(F.lit("Suggestion: "), hint), F.format_string("Fields: %.2f, words: %.3f", F.coalesce("overall", F.lit(0.0)), "f"), F.lit("Label: "),
    )


def retrieval_rows(rows: DataFrame, split: str = "split", text: str = "text") -> DataFrame:
    """The rows that may be retrieved: those of split train whose text stands in no other split; NULL texts are left out."""
    held = rows.where((F.col(split) != "train") & F.col(text).isNotNull()).select(F.sha2(text, 256).alias("_h")).distinct()
    return rows.where((F.col(split) == "train") & F.col(text).isNotNull()).withColumn("_h", F.sha2(text, 256)).join(held, "_h", "left_anti").drop("_h")
