"""Batch figures: histograms with empty classes, rates, means, comparison with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge import lexicon as L


def percent(n: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(100.0 * n / whole, 1)).otherwise(0.0)


def histogram(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """(column, rows, share): a row for every class, empty ones too; values outside the classes count in the whole only."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    every = df.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string")
    # The whole comes from the grouped counts: one row, nothing is counted while the plan is built.
    whole = counted.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("_whole"))
    joined = every.join(counted, column, "left").join(F.broadcast(whole))
    return joined.select(column, F.coalesce("rows", F.lit(0)).alias("rows"), percent(F.coalesce("rows", F.lit(0)), F.col("_whole")).alias("share"))


def mean(column: Column) -> Column:
    return F.coalesce(F.round(F.avg(column), 2), F.lit(0.0))


def median(column: Column) -> Column:
    return F.coalesce(F.round(F.median(column), 2), F.lit(0.0))


def last_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key; what a dictionary filled in order would hold."""
    columns = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(order)).alias("r")).select(*key, "r.*")


def failures(results: DataFrame) -> DataFrame:
    """(category, results): results without a grade by their own category, else that of their status; the six known categories always, others after them.

    results: lead_grade, status, failure_category.
    """
    of_status = F.lit("insufficient evidence")
    for status, category in L.STATUS_CATEGORY.items():
        of_status = F.when(F.col("status") == status, F.lit(category)).otherwise(of_status)
    failed = results.filter(~F.coalesce(F.col("lead_grade").isin("A", "B", "C", "D", "E"), F.lit(False)))
    counted = failed.groupBy(F.coalesce(F.nullif(F.col("failure_category"), F.lit("")), of_status).alias("category")).agg(F.count(F.lit(1)).alias("results"))
    known = results.sparkSession.createDataFrame([(c, i) for i, c in enumerate(L.FAILURE_CATEGORIES)], "category string, place int")
    every = known.join(counted, "category", "full")
    return every.select("category", F.coalesce("results", F.lit(0)).alias("results"), F.coalesce("place", F.lit(len(L.FAILURE_CATEGORIES))).alias("place"))
