"""Search hits, internal links, and the queries that would be asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimforge import lexicon as L
from claimforge.functions import text as T


def rank_hits(hits: DataFrame, companies: DataFrame, k: int = 12) -> DataFrame:
    """The k best hits of each company by (-score, position). hits: hit_id, company_id, url, title, snippet, position."""
    from claimforge.operators.people import company_words

    terms = company_words(companies).select("company_id", "terms")
    kind = T.source_type(F.col("url"), F.col("title"))
    scored = hits.join(terms, "company_id").withColumn("source_type", kind).withColumn("score", T.hit_score(F.col("url"), F.col("title"), F.col("snippet"), F.col("source_type"), F.col("position"), F.col("terms")))
    order = W.partitionBy("company_id").orderBy(F.col("score").desc(), "position", "hit_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("company_id", "hit_id", "source_type", "score", "rank")


def rank_links(parsed: DataFrame, k: int = 8) -> DataFrame:
    """The k internal links of each page most likely to lead to people, contacts or the company; links without weight are dropped."""
    links = parsed.select("page_id", T.host(F.col("url")).alias("host"), F.col("url").alias("page_url"), F.posexplode("links").alias("seq", "l")).select("page_id", "host", "page_url", "seq", "l.url", "l.anchor")
    same = links.filter((T.host(F.col("url")) == F.col("host")) & ~F.lower("url").rlike(r"\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp4|mp3|css|js|ico|woff2?)(\?|$)") & (F.regexp_replace("url", "/+$", "") != F.regexp_extract("url", r"^https?://[^/]+", 0)))
    weight = T.link_weight(F.col("url"), F.col("anchor"))
    slashes = F.length("url") - F.length(F.replace("url", F.lit("/"))) - 2
    bonus = F.greatest(F.lit(0.0), F.lit(0.6) - F.lit(0.2) * F.greatest(slashes - 2, F.lit(0))) + F.when(F.length("anchor").between(1, 39), 0.4).otherwise(0.0)
    weighed = same.withColumn("weight", weight).filter("weight > 0").withColumn("weight", F.round(F.col("weight") + bonus, 2))
    best = weighed.groupBy("page_id", "url").agg(F.max("weight").alias("weight"), F.min("seq").alias("seq"))
    order = W.partitionBy("page_id").orderBy(F.col("weight").desc(), "seq")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("page_id", "url", "weight", "rank")


def _distinct(queries: Column) -> Column:
    """Without nulls and later repeats, whatever their case."""
    kept = F.array_compact(queries)
    low = F.transform(kept, lambda q: F.lower(q))
    return F.filter(kept, lambda q, i: F.array_position(low, F.lower(q)) == i + 1)


def initial_queries(companies: DataFrame) -> DataFrame:
    """(company_id, seq, query): the first round: by name and role, by domain, and within the site."""
    name, raw = T.squeeze(T.blank(F.col("company_name"))), F.col("company_name")
    domain = F.regexp_replace(F.lower(T.blank(F.col("domain"))), r"^www\.", "")
    usable, known = (name != "") & ~T.degraded_name(raw), domain != ""
    by_name = [F.when(usable, F.concat(F.lit('"'), name, F.lit('"'), F.lit(s))) for s in ["", *(f" {r}" for r in L.PRIORITY_ROLES), " team"]]
    by_site = [F.when(known, F.concat(F.lit('"'), domain, F.lit('"')))] + [F.when(known, F.concat(F.lit("site:"), domain, F.lit(f" {p}"))) for p in L.SITE_PATHS]
    by_role = [F.when(known & T.degraded_name(raw), F.concat(domain, F.lit(f" {r}"))) for r in L.PRIORITY_ROLES]
    return companies.select("company_id", F.posexplode(_distinct(F.array(*by_name, *by_site, *by_role))).alias("seq", "query"))


def people_queries(companies: DataFrame) -> DataFrame:
    """(company_id, seq, query): the people pass, within the site and in the company's language, without those already asked."""
    domain = F.regexp_replace(F.lower(T.blank(F.col("domain"))), r"^www\.", "")
    within = [F.when(domain != "", F.concat(F.lit("site:"), domain, F.lit(f" {t}"))) for t in L.PEOPLE_TERMS] + [F.when(domain != "", F.concat(F.lit("site:"), domain, F.lit(' "meet the team" OR "our team"')))]
    native = F.transform(T.native_words(T.language(F.col("country"), F.col("language"))), lambda w: F.when(domain != "", F.concat(F.lit("site:"), domain, F.lit(" "), w)))
    asked = companies.select("company_id", F.posexplode(_distinct(F.concat(F.array(*within), native))).alias("seq", "query"))
    return asked.join(initial_queries(companies).select("company_id", "query"), ["company_id", "query"], "left_anti").select("company_id", "seq", "query")
