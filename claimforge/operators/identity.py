"""Who a company is: its legal name from texts and the entities it is related to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimforge.functions import text as T


def legal_name_candidates(texts: DataFrame, companies: DataFrame, key: str = "doc_id") -> DataFrame:
    """(company_id, name, place): legal names in a company's texts that share a distinctive word with its name or domain."""
    found = texts.select("company_id", F.col(key).alias("id"), F.posexplode(T.legal_names(F.col("text"))).alias("seq", "name"))
    own = companies.select("company_id", F.array_distinct(F.concat(T.distinctive_tokens(F.col("company_name")), T.distinctive_tokens(F.col("domain")), F.filter(F.split(F.lower(T.blank(F.col("domain"))), r"[.\-]"), lambda t: F.length(t) >= 3))).alias("target"))
    shared = found.join(own, "company_id").filter(F.arrays_overlap(T.distinctive_tokens(F.col("name")), "target"))
    return shared.select("company_id", "name", F.struct("id", "seq").alias("place"))


def resolve(texts: DataFrame, companies: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per company: the longest such legal name (of equals the first seen), up to five others, brand or legal company, confidence."""
    names = legal_name_candidates(texts, companies, key).groupBy("company_id", "name").agg(F.min("place").alias("place"))
    best = names.groupBy("company_id").agg(F.max_by("name", F.struct(F.length("name"), -F.col("place.id"), -F.col("place.seq"))).alias("legal"), F.count(F.lit(1)).alias("spellings"))
    canonical = T.clean_name(F.col("company_name"))
    differs = F.coalesce(F.lower("legal") != F.lower(canonical), F.lit(False))
    return companies.join(best, "company_id", "left").select(
        "company_id",
        canonical.alias("canonical_name"),
        F.coalesce("legal", F.lit("")).alias("legal_name"),
        F.coalesce("spellings", F.lit(0)).alias("spellings"),
        F.when(differs, "brand").otherwise("unknown").alias("product_or_company"),
        F.when(differs, 0.55).otherwise(0.4).alias("confidence"),
    )


def related(companies: DataFrame, most_aliases: int | None = 4) -> DataFrame:
    """(company_id, relation, name): the legal entity behind a brand, its parent, and the first aliases."""
    canonical = F.lower(T.clean_name(F.col("company_name")))
    one = lambda test, relation, name: F.when(test, F.struct(F.lit(relation).alias("relation"), name.alias("name")))
    legal, parent = F.col("legal_name"), F.col("parent_company")
    aliases = F.transform(T.first(F.coalesce("aliases", F.array().cast("array<string>")), most_aliases), lambda a: one(T.blank(a) != "", "alias_of", a))
    rows = F.array_compact(F.concat(F.array(one((T.blank(legal) != "") & (F.lower(legal) != canonical), "legal_entity_of", legal), one(T.blank(parent) != "", "parent_of", parent)), aliases))
    return companies.select("company_id", F.explode(rows).alias("r")).select("company_id", "r.relation", "r.name").distinct()


def overlay(base: DataFrame, proposals: DataFrame, known: DataFrame, most_aliases: int | None = 8) -> DataFrame:
    """base with what proposals say: per company every field that is not empty, the aliases of both, and the proposal's confidence.

    base and proposals: company_id, canonical_name, legal_name, country, language, aliases, confidence; proposals also source_urls, one row a company. known: company_id, url.
    A proposal that cites no known URL counts 0.3 at most. Companies without a proposal stay as they are.
    """
    none = F.array().cast("array<string>")
    cited = proposals.select("company_id", F.explode("source_urls").alias("url")).join(known.select("company_id", "url").distinct(), ["company_id", "url"], "left_semi").select("company_id").distinct().withColumn("_cited", F.lit(True))
    fields = ("canonical_name", "legal_name", "country", "language")
    said = proposals.join(cited, "company_id", "left").select("company_id", *[F.col(f).alias(f"_{f}") for f in fields], F.coalesce("aliases", none).alias("_aliases"), T.clamped(F.col("confidence")).alias("_sure"), F.coalesce("_cited", F.lit(False)).alias("_cited"), F.lit(True).alias("_there"))
    merged = base.join(said, "company_id", "left")
    there = F.coalesce("_there", F.lit(False))
    sure = F.when(there, F.when(F.col("_cited"), F.col("_sure")).otherwise(F.least(F.col("_sure"), F.lit(0.3)))).otherwise(F.col("confidence"))
    both = T.first(F.array_distinct(F.filter(F.concat(F.coalesce("aliases", none), F.coalesce("_aliases", none)), lambda a: T.blank(a) != "")), most_aliases)
    return merged.select("company_id", *[F.coalesce(F.nullif(f"_{f}", F.lit("")), f).alias(f) for f in fields], F.when(there, both).otherwise(F.coalesce("aliases", none)).alias("aliases"), sure.alias("confidence"))
