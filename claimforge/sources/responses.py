"""Hits out of recorded answers of search services: two forms of JSON, redirect links, and the first service that answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimforge.functions import text as T

_HIT = "array<struct<url:string,title:string,description:string,content:string,engine:string,score:double>>"
WEB, META = "web", "meta"


def json_hits(answers: DataFrame, form: str, most: int | None = 24) -> DataFrame:
    """(key columns, position, url, title, snippet, engine, score, source_type): the first hits of every answer whose URL begins with http.

    answers: key columns and body. WEB answers hold them in web.results with a description; META answers in results, with content (or the title), an engine and a
    score. A body that is null or no such JSON has no hits. Positions count the entries of the answer from 1, left-out ones too.
    """
    keys = [c for c in answers.columns if c != "body"]
    if form == WEB:
        items = F.from_json("body", f"web struct<results:{_HIT}>")["web"]["results"]
    else:
        items = F.from_json("body", f"results {_HIT}")["results"]
    clean = lambda c: F.trim(T.blank(c))
    listed = F.filter(F.transform(items, lambda x, i: F.struct((i + 1).alias("position"), x.alias("x"))), lambda y: F.startswith(clean(y["x"]["url"]), F.lit("http")))
    rows = answers.select(*keys, F.explode(T.first(listed, most)).alias("h")).select(*keys, "h.position", "h.x.*")
    snippet = clean(F.col("description")) if form == WEB else F.coalesce(F.nullif(clean(F.col("content")), F.lit("")), clean(F.col("title")))
    engine = F.lit(WEB) if form == WEB else F.coalesce(F.nullif(clean(F.col("engine")), F.lit("")), F.lit(META))
    score = F.lit(0.0) if form == WEB else F.coalesce("score", F.lit(0.0))
    return rows.select(*keys, "position", clean(F.col("url")).alias("url"), clean(F.col("title")).alias("title"), snippet.alias("snippet"), engine.alias("engine"), score.alias("score"), T.source_type(clean(F.col("url")), clean(F.col("title"))).alias("source_type"))


def unwrapped(url: Column, parameter: str = "uddg") -> Column:
    """The address inside a redirect link, or the link itself."""
    inner = F.regexp_extract(T.blank(url), rf"[?&]{parameter}=([^&#]*)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(T.blank(url))


def first_answer(hits: DataFrame, key: list[str], service: str = "service", place: str = "place", most: int | None = 12) -> DataFrame:
    """The first hits of every query from the first service that has any; services are numbered in the order in which they are asked. Hits of a null key are left out."""
    asked = hits.groupBy(*key).agg(F.min(service).alias("_first"))
    kept = hits.join(asked, key).filter(F.col(service) == F.col("_first")).drop("_first")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(place)))
    return ranked if most is None else ranked.filter(F.col("rank") <= most)
