"""Chat records: budgets, rendering, splits, batches, rules for rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.skew import ordered_positions


def trim_to_budget(turns: DataFrame, budget: int, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "content") -> DataFrame:
    """The turns of each conversation that fit: the first one always, and the newest until ``budget`` characters are full.

    At least the newest is kept; of the kept newest ones those in front of the first user turn are dropped.  NULL texts
    count no characters.  A conversation is the unit here and is ordered in one task, one row at a time.
    """
    w = Window.partitionBy(key)
    newest = w.orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("_first", F.col(turn) == F.min(turn).over(w)).withColumn("_sum", F.sum(F.when(F.col("_first"), 0).otherwise(F.coalesce(F.length(text), F.lit(0)))).over(newest))
    rows = rows.withColumn("_head", F.sum(F.when(F.col("_first"), F.coalesce(F.length(text), F.lit(0)))).over(w)).withColumn("_last", F.col(turn) == F.max(turn).over(w))
    fits = (F.col("_sum") + F.col("_head") <= budget) | F.col("_last")
    tail = rows.withColumn("_tail", fits & ~F.col("_first"))
    user = F.min(F.when(F.col("_tail") & (F.col(role) == "user"), F.col(turn))).over(w)
    return tail.withColumn("_user", user).where(F.col("_first") | (F.col("_tail") & (F.col(turn) >= F.col("_user")))).select(*turns.columns)


def rendered(messages: Column) -> Column:
    """One text of a conversation: the system message joins the first user turn; each turn as <role>content."""
    system = F.try_element_at(F.filter(messages, lambda m: m["role"] == "system"), F.lit(1))["content"]
    rest = F.filter(messages, lambda m: m["role"] != "system")
    part = lambda m, i: F.concat(F.lit("<"), m["role"], F.lit(">"), F.when(i == 0, F.coalesce(F.concat(system, F.lit("\n\n")), F.lit(""))).otherwise(F.lit("")), F.coalesce(m["content"], F.lit("")))
    return F.array_join(F.transform(rest, part), "\n")


def stratified_split(df: DataFrame, stratum: str, id: str = "rec_id", seed: int = 7, share: float = 0.1, least: int = 3) -> DataFrame:
    """``df`` with ``split``: of each stratum of ``least`` rows or more, a share (at least one, half-even) goes to test, then as much to validation.

    Rows are in order of md5(id | seed).  A row's place is found from the counts of the order's first byte and its place
    among the rows with that byte, so a hot stratum is ordered by 256 tasks.
    """
    h = F.md5(F.concat_ws("|", F.col(id).cast("string"), F.lit(str(seed))))
    rows = df.withColumn("_h", h).withColumn("_b", F.left("_h", F.lit(2)))
    sizes = rows.groupBy(stratum, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(stratum).orderBy("_b")
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_c").over(Window.partitionBy(stratum))})
    sizes = sizes.select(F.col(stratum).alias("_s"), F.col("_b").alias("_b2"), "_before", "_n")
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", id))
    placed = rows.join(sizes, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_b2"))).withColumn("_r", rank)
    take = F.when(F.col("_n") >= least, F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("int"))).otherwise(0)
    name = F.when(F.col("_r") <= take, "test").when(F.col("_r") <= 2 * take, "validation").otherwise("train")
    return placed.withColumn("split", name).select(*[c for c in df.columns if c != "split"], "split")


def batches(df: DataFrame, by: list[str], order: list[str], size: int = 8) -> DataFrame:
    """``df`` with ``batch``, from 0: consecutive rows of each group in order, ``size`` together."""
    placed = ordered_positions(df, by, order, "_position")
    return placed.withColumn("batch", F.floor((F.col("_position") - 1) / F.lit(size)).cast("int")).drop("_position")


def seed_grid(axes: dict[str, list[str]], spark) -> DataFrame:
    """All combinations of the axes (a generated grid, as large as its lists say)."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out


def violations(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules a row breaks, in order; a rule that is NULL is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def extraction_rules(x: str) -> list[tuple[str, Column]]:
    """Rules of shape for an extraction struct column ``x``: known type, names, lengths, list sizes, level of risk."""
    c = lambda f: F.col(f"{x}.{f}")
    # Clause types and levels.
    types = "financial_covenant negative_covenant event_of_default affirmative_covenant interest_provision repayment_prepayment representation_warranty security_collateral indemnity conditions_precedent change_of_control governing_law_jurisdiction".split()
    return [
        ("clause_type", c("clause_type").isin(*types)), ("parties", F.size(c("parties")).between(1, 6) & F.forall(c("parties"), lambda p: F.length(F.trim(p)) > 1)),
        ("obligation", F.length(c("obligation")).between(15, 400)), ("trigger_condition", F.coalesce(F.length(c("trigger_condition")) <= 300, F.lit(True))),
        ("financial_terms", F.size(c("financial_terms")) <= 8), ("risk_flag", c("risk_flag").isin("low", "medium", "high")), ("risk_rationale", F.length(c("risk_rationale")).between(10, 300)),
    ]


def unknown_fields(raw: Column, allowed: list[str]) -> Column:
    """Top-level keys of a JSON text that a closed schema doesn't know; NULL where it is no object."""
    return F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, allowed)))


def kept_and_rejected(rows: DataFrame, rules: list[tuple[str, Column]], by: list[str]) -> DataFrame:
    """(by…, n, kept, rejected): rows that break no rule, and the others; a row is judged on its own, never with its batch."""
    ok = F.size(violations(rules)) == 0
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("rejected"))


def first_violation(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule a row breaks; NULL if none."""
    return F.try_element_at(violations(rules), F.lit(1))


def draw_cells(axes: dict[str, DataFrame], cycled: str, n: int, seed: int = 7, edge_every: int = 3) -> DataFrame:
    """(seed, one column an axis, edge): ``n`` different cells of the grid of all categories, the categories of ``cycled`` in turn.

    Each axis is a short list of categories that people write; a category's cells are in order of md5 of the cell and ``seed``, so a draw
    is the same at every run.  Every ``edge_every``-th seed is to be an edge case.
    """
    grid = None
    for values in axes.values():
        grid = values if grid is None else grid.crossJoin(F.broadcast(values))  # lists of categories
    names = list(axes)
    h = F.md5(F.concat_ws("|", *names, F.lit(str(seed))))
    turn = F.row_number().over(Window.partitionBy(cycled).orderBy(h, *[c for c in names if c != cycled]))
    first = grid.withColumn("_turn", turn).where(F.col("_turn") <= n).orderBy("_turn", cycled).limit(n)
    numbered = first.withColumn("seed", F.row_number().over(Window.orderBy("_turn", cycled)) - 1)  # of at most n rows
    return numbered.select(F.col("seed").cast("int").alias("seed"), *names, (F.col("seed") % edge_every == 0).alias("edge"))


def in_turn(df: DataFrame, keys: list[str], order: list[str], cycle: dict[str, int]) -> DataFrame:
    """``df`` with ``position`` from 0 in each group by ``order``, and the position modulo each length of ``cycle``."""
    out = ordered_positions(df, keys, order).withColumn("position", F.col("position") - 1)
    return out.withColumns({name: F.pmod("position", F.lit(length)).cast("int") for name, length in cycle.items()})
