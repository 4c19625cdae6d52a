"""What is supported, cited, and worth a visit: sources of claims against fetched pages, and pages to fetch next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimforge.functions import text as T

#: Characters at the end of a URL by which substrings are looked up.
TAIL = 8


def supported(evidence: DataFrame, known: DataFrame) -> DataFrame:
    """The evidence whose source_url equals a known URL of its company or is part of one. known: (company_id, url).

    Both sides are made distinct first. A URL's last TAIL characters are looked up among all pieces of that length of the known
    URLs, and what meets is checked in full; the few shorter ones are compared within their company. An empty source is part of any URL; null counts as empty.
    """
    claims = evidence.select("company_id", T.blank(F.col("source_url")).alias("e")).distinct()
    urls = known.select("company_id", T.blank(F.col("url")).alias("u")).distinct()
    pieces = urls.filter(F.length("u") >= TAIL).select("company_id", "u", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("u") - TAIL + 1), lambda i: F.col("u").substr(i, F.lit(TAIL))))).alias("piece"))
    long = claims.filter(F.length("e") >= TAIL).withColumn("piece", F.right("e", F.lit(TAIL)))
    met = long.join(pieces, ["company_id", "piece"]).filter(F.contains("u", F.col("e"))).select("company_id", "e")
    short = claims.filter(F.length("e") < TAIL).join(urls, "company_id").filter(F.contains("u", F.col("e"))).select("company_id", "e")
    held = met.unionByName(short).distinct()
    return evidence.withColumn("_e", T.blank(F.col("source_url"))).join(held.withColumnRenamed("e", "_e"), ["company_id", "_e"], "left_semi").select(*evidence.columns)


def supported_people(kept: DataFrame) -> DataFrame:
    """(company_id, person_id, source_url, items, first_id): the different sources of the people that supported evidence names, a row each; first_id gives their order.

    No list is gathered, as one person may have any number of sources.
    """
    named = kept.filter("person_id IS NOT NULL")
    return named.groupBy("company_id", "person_id", "source_url").agg(F.count(F.lit(1)).alias("items"), F.min("evidence_id").alias("first_id"))


def supported_or_all(people: DataFrame, kept: DataFrame) -> DataFrame:
    """The people that supported evidence names, with supported = true; of companies where it names nobody all people."""
    named = kept.filter("person_id IS NOT NULL").select("company_id", "person_id").distinct().withColumn("supported", F.lit(True))
    marked = people.join(named, ["company_id", "person_id"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))
    some = marked.groupBy("company_id").agg(F.bool_or("supported").alias("_some"))
    return marked.join(some, "company_id").filter("supported OR NOT _some").drop("_some")


def identity_evidence(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """(company_id, claim_type, claim_value, source_url, source_title, source_text, confidence): what backs a company's identity.

    Up to three claims (name, legal name, country) tied to the first cited URL that was fetched, of repeated fetches the last; a company without one has a claim of its
    domain tied to its first page; one without pages has none. Quotes have 600 characters at most.
    """
    url = F.coalesce("final_url", "url", F.lit(""))
    fetched = pages.select("company_id", "page_id", url.alias("url"), T.blank(F.col("title")).alias("title"), T.blank(F.col("text")).alias("text"))
    latest = fetched.groupBy("company_id", "url").agg(F.max("page_id").alias("page_id"))
    cited = companies.select("company_id", F.posexplode(F.coalesce("evidence_urls", F.array().cast("array<string>"))).alias("at", "url"))
    first = cited.join(latest, ["company_id", "url"]).groupBy("company_id").agg(F.min_by("page_id", "at").alias("page_id")).withColumn("cited", F.lit(True))
    home = fetched.groupBy("company_id").agg(F.min("page_id").alias("page_id")).join(first.select("company_id"), "company_id", "left_anti").withColumn("cited", F.lit(False))
    rows = companies.join(first.unionByName(home), "company_id").join(fetched.drop("company_id"), "page_id")
    place = F.call_function("locate", "legal_name", "text")
    quoted = F.array_contains(T.legal_names(F.col("text")), F.col("legal_name")) & (place > 0)
    around = F.when(quoted, F.substring(F.col("text"), F.greatest(F.lit(1), place - 120), place + 240 - F.greatest(F.lit(1), place - 120))).otherwise(F.substring("text", 1, 300))
    sure = T.clamped(F.col("confidence"))
    tongue = F.coalesce(F.nullif(F.col("language"), F.lit("")), F.lit("n/a"))

    def claim(kind: str, value: Column, quote: Column, confidence: Column, test: Column) -> Column:
        made = F.struct(F.lit(kind).alias("claim_type"), value.alias("claim_value"), F.substring(F.regexp_replace(quote, r"(?U)\s+", " "), 1, 600).alias("source_text"), F.round(confidence, 2).alias("confidence"))
        return F.when(test & (T.blank(value) != ""), made)

    claims = F.array(
        claim("company_name", F.col("canonical_name"), F.concat(F.lit("resolved canonical name for "), T.blank(F.col("domain"))), sure, F.col("cited")),
        claim("legal_name", F.col("legal_name"), around, sure, F.col("cited")),
        claim("country", F.col("country"), F.concat(F.lit("country per resolved identity ("), tongue, F.lit(")")), sure * 0.8, F.col("cited")),
        claim("domain", F.col("domain"), F.substring("text", 1, 200), F.lit(0.5), ~F.col("cited")),
    )
    found = rows.select("company_id", F.col("url").alias("source_url"), F.col("title").alias("source_title"), F.explode(F.array_compact(claims)).alias("c"))
    return found.select("company_id", "c.claim_type", "c.claim_value", "source_url", "source_title", "c.source_text", "c.confidence")


def _next(found: DataFrame, k: int | None) -> DataFrame:
    """(company_id, url, rank): of each company's different URLs the first k by place."""
    once = found.groupBy("company_id", "url").agg(F.min("place").alias("place"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("company_id").orderBy("place", "url")))
    return (ranked if k is None else ranked.filter(F.col("rank") <= k)).select("company_id", "url", "rank")


def off_site_pages(hits: DataFrame, companies: DataFrame, most: int | None = 4) -> DataFrame:
    """The first hits of each company outside its site that are worth a fetch. hits: company_id, url, place."""
    own = companies.select("company_id", "domain")
    return _next(hits.join(own, "company_id").filter(T.off_site(F.col("url"), F.col("domain")) & T.worth_fetching(F.col("url"))), most)


def people_pages(hits: DataFrame, companies: DataFrame, fetched: DataFrame, most: int | None = None) -> DataFrame:
    """Pages about people on the company's own site that hits name and nobody fetched, first seen first. fetched: company_id, url."""
    url = F.col("url")
    own = hits.join(companies.select("company_id", "domain"), "company_id").filter(T.people_page(url) & T.same_site(url, F.col("domain")) & T.people_source(url, F.lit("")) & T.worth_fetching(url))
    return _next(own.join(fetched.select("company_id", "url").distinct(), ["company_id", "url"], "left_anti"), most)


def unseen_results(hits: DataFrame, fetched: DataFrame, top: int | None = 6) -> DataFrame:
    """(company_id, query, url, rank): of the top results of every query those that nobody fetched. hits: company_id, query, url, place."""
    best = hits.filter(T.blank(F.col("url")) != "").withColumn("rank", F.row_number().over(W.partitionBy("company_id", "query").orderBy("place", "url")))
    kept = best if top is None else best.filter(F.col("rank") <= top)
    return kept.join(fetched.select("company_id", "url").distinct(), ["company_id", "url"], "left_anti").select("company_id", "query", "url", "rank")
