"""Keyed tables: insert unless present, upsert, reads with a time to live, running budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def cache_key(value: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("lf1:"), value), 256), 1, 32)


def insert_ignore(stored: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """stored, and of new the first row by order of each key that stored lacks. Null keys are equal to each other."""
    fresh = new.join(stored.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct(), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left_anti")
    columns = [c for c in stored.columns if c not in key]
    first = fresh.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(order, *[c for c in columns if c != order])).alias("r")).select(*key, "r.*")
    return stored.unionByName(first.select(*stored.columns))


def upsert(stored: DataFrame, new: DataFrame, key: list[str], version: str, created: str | None = None) -> DataFrame:
    """One row per key: the latest version wins (of equals the new one); created, if given, stays the earliest."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    columns = [c for c in stored.columns if c not in key]
    last = F.max_by(F.struct(*columns), F.struct(version, "_new", *[c for c in columns if c != version])).alias("r")
    born = [F.min(created).alias("_born")] if created else []
    merged = both.groupBy(*key).agg(last, *born)
    value = lambda c: F.col("_born").alias(c) if c == created else F.col(f"r.{c}").alias(c)
    return merged.select(*key, *[value(c) for c in columns]).select(*stored.columns)


def fresh_reads(probes: DataFrame, cache: DataFrame, key: str, fetched: str, as_of: str, ttl_hours: int) -> DataFrame:
    """probes with the cached row of their key, if it was fetched within ttl_hours before as_of; else nulls and hit = false."""
    alive = cache.filter(F.col(fetched) >= F.to_timestamp(F.lit(as_of)) - F.make_interval(hours=F.lit(ttl_hours)))
    return probes.join(alive.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def within_budget(spent: DataFrame, owner: str, order: list[str], cap: int) -> DataFrame:
    """The first cap rows of each owner in the given order (a budget is the feature); groups are cut to cap rows before the shuffle."""
    line = W.partitionBy(owner).orderBy(*order)
    return spent.withColumn("n", F.row_number().over(line)).filter(F.col("n") <= cap)
