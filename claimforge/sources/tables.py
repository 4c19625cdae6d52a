"""Readers and writers: the company list, result files, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimforge.functions import text as T

# Headings under which names and domains are given, in order.
NAME_KEYS = ["company_name", "company", "name", "company_nme", "organisation"]
DOMAIN_KEYS = ["domain", "company_domain", "website", "url", "site", "domain_name"]


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, company_name, domain, meta) of a CSV with a heading; all other columns go to meta.

    Headings are trimmed and lower-cased. Rows without name and domain, or without a domain at the end, are dropped; a missing
    name is the domain. row_index counts the rows of the file from 0, in its order.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    clean = raw.toDF(*[c.replace("﻿", "").strip().lower() or f"_{i}" for i, c in enumerate(raw.columns)])
    names = clean.columns
    # The order within a partition is that of the file, which the id follows; partitions are counted first, so that no task sees all rows.
    marked = clean.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each partition of the file.
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = marked.join(before, "_part").withColumn("row_index", F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id", "_part", "_before")
    cell = lambda c: F.trim(T.blank(F.col(f"`{c}`")))
    pick = lambda keys: F.coalesce(*[F.nullif(cell(k), F.lit("")) for k in keys if k in names], F.lit(""))
    name, domain = pick(NAME_KEYS), pick(DOMAIN_KEYS)
    bare = F.regexp_replace(F.split_part(F.regexp_replace(F.lower(domain), r"^https?://", ""), F.lit("/"), F.lit(1)), r"^www\.", "")
    rest = [c for c in names if c not in ("company_name", "domain")]
    meta = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[cell(c) for c in rest])) if rest else F.create_map().cast("map<string,string>")
    shown = F.coalesce(F.nullif(T.clean_name(name), F.lit("")), bare)
    return numbered.select(F.col("row_index").cast("int").alias("row_index"), shown.alias("company_name"), bare.alias("domain"), meta.alias("meta")).filter("company_name <> '' AND domain <> ''")


def limited(companies: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from offset on, limit of them at most."""
    kept = companies.filter(F.col("row_index") >= offset)
    return kept if limit is None else kept.filter(F.col("row_index") < offset + limit)


def write_people_csv(people: DataFrame, path: str) -> None:
    """One CSV folder with a heading; lists as text joined by " | ", of at most eight entries."""
    flat: list[Column] = []
    for field in people.schema:
        c = F.col(f"`{field.name}`")
        flat.append((F.array_join(F.slice(c, 1, 8), " | ") if field.dataType.typeName() == "array" else c).alias(field.name))
    people.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, field: str = "results") -> DataFrame:
    """The rows of a JSON document {generated_at, count, results: [...]}."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def write_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    """A Parquet table, partitioned by a column of few values where given."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
