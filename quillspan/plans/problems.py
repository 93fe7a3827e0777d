"""Queries of the general training-data problems (pN_...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.operators.instants import normalise_instants
from quillspan.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every headline whose ``published`` fixes an instant, with that instant."""
    rows = table(spark, sf_dir, "headlines").select("item_id", "source", "published")
    found = normalise_instants(rows, table(spark, sf_dir, "feeds"))
    return found.where("instant_us is not null").selectExpr("item_id", "instant_us as published_us")


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
