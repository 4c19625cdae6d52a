"""People: evidence without repeats, sightings merged, scores, ranks, and people read off pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimforge import lexicon as L
from claimforge.functions import text as T


def dedupe_evidence(evidence: DataFrame) -> DataFrame:
    """One row per (company, person, claim type, source): the longest quote, and its confidence.

    Of quotes of one length the first by evidence_id is kept. A longer quote lifts the confidence to the highest of those it
    replaced, so the confidence is the largest among the quotes that were the longest so far.
    """
    key = ["company_id", "person_id", "claim_type", "source_url"]
    # Exact repeats are dropped map-side before anything is ordered.
    rows = evidence.groupBy(*key, "source_text", "confidence").agg(F.min("evidence_id").alias("evidence_id"), F.min_by("claim_value", "evidence_id").alias("claim_value"))
    size = F.length(T.blank(F.col("source_text")))
    before = W.partitionBy(*key).orderBy("evidence_id").rowsBetween(W.unboundedPreceding, -1)
    marked = rows.withColumn("size", size).withColumn("longest", F.coalesce(F.max("size").over(before), F.lit(-1)) < F.col("size"))
    best = F.max_by(F.struct("evidence_id", "claim_value", "source_text"), F.struct("size", -F.col("evidence_id")))
    return marked.groupBy(*key).agg(best.alias("b"), F.max(F.when(F.col("longest"), F.col("confidence"))).alias("confidence"), F.count(F.lit(1)).alias("quotes")).select(*key, "b.evidence_id", "b.claim_value", "b.source_text", "confidence", "quotes")


def merge_people(people: DataFrame) -> DataFrame:
    """One row per company and name key, folding sightings in the order of person_id.

    The title is the most senior, then the well-formed, then the longest, then the first; company, profile and place are the first that are filled; a person
    is current if every sighting says so. Names without words are dropped.
    """
    seq = F.col("person_id")
    keyed = people.withColumn("name_key", T.person_key(F.col("name"))).filter("name_key <> ''")
    title = T.blank(F.col("title"))
    first = lambda c: F.min_by(F.when(T.blank(F.col(c)) != "", F.col(c)), F.when(T.blank(F.col(c)) != "", seq))
    return keyed.groupBy("company_id", "name_key").agg(
        F.min(seq).alias("person_id"),
        F.min_by("name", seq).alias("name"),
        F.max_by(title, F.struct(title != "", T.title_rank(title), T.looks_like_title(title), F.length(title), -seq)).alias("title"),
        first("current_company").alias("current_company"),
        first("linkedin").alias("linkedin"),
        first("location").alias("location"),
        F.bool_and(F.coalesce("is_current", F.lit(True))).alias("is_current"),
        F.count(F.lit(1)).alias("sightings"),
    )


def company_words(companies: DataFrame, most: int | None = 10) -> DataFrame:
    """(company_id, terms, domains): the first words a company is known by, and its domains."""
    terms = T.query_terms(F.col("canonical_name"), F.col("legal_name"), F.col("company_name"), F.col("domain"), most=most)
    alias = F.flatten(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: T.query_terms(a, most=most)))
    domain = F.regexp_replace(F.lower(T.blank(F.col("domain"))), r"^www\.", "")
    return companies.select("company_id", T.first(F.array_distinct(F.concat(terms, alias)), most).alias("terms"), F.filter(F.array(domain), lambda d: d != "").alias("domains"), T.size_hint(F.col("size_hint")).alias("size"), F.col("size_hint").alias("stated_size"))


def _lookup(key: Column, values: dict[str, float], default: float) -> Column:
    out = F
    for k, v in values.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def score_people(people: DataFrame, evidence: DataFrame, companies: DataFrame, as_of_year: int) -> DataFrame:
    """The five components and the total of every person, from the evidence that names them.

    company_match (mean tie of the evidence to the company, up to 30), decision_authority (0 to 25), role_relevance (0 to 20),
    evidence_quality (source trust and number of items, 0 to 15), evidence_recency (0 to 10).
    """
    own = company_words(companies).withColumn("size", F.when(F.col("stated_size").isin("small", "medium", "large"), F.col("stated_size")).otherwise("medium"))
    kind = T.source_type(F.col("source_url"), F.col("source_title"))
    url = F.lower(T.blank(F.col("source_url")))
    blob = F.lower(F.concat_ws(" ", T.blank(F.col("claim_value")), T.blank(F.col("source_text")), T.blank(F.col("source_url"))))
    tied_host = T.let(url, lambda u: F.exists("domains", lambda d: F.contains(u, d)))
    tied_term = T.let(blob, lambda b: F.exists("terms", lambda t: F.contains(b, t)))
    ties = tied_host.cast("int") + tied_term.cast("int")
    tie = T.let(ties, lambda n: F.when(n == 2, 30).when(n == 1, 18).otherwise(6))
    dated = F.coalesce(F.nullif(T.blank(F.col("source_text")), F.lit("")), T.blank(F.col("claim_value")))
    year = F.nullif(F.regexp_extract(dated, r"(?U)\b(20[12][0-9])\b", 1), F.lit("")).cast("int")
    items = (
        evidence.filter("person_id IS NOT NULL")
        .join(own.select("company_id", "terms", "domains"), "company_id")
        .groupBy("person_id")
        .agg(
            F.avg(tie).alias("match"),
            F.avg(T.let(kind, lambda k: _lookup(k, L.HOST_TRUST, 0.4))).alias("trust"),
            F.count(F.lit(1)).alias("n"),
            F.max(year).alias("newest"),
            F.max(F.when(T.has_any(F.lower(T.blank(F.col("claim_value"))), L.ENDED_HINTS), 1).otherwise(0)).alias("ended_claim"),
        )
    )
    words = F.lower(F.concat_ws(" ", *(T.blank(F.col(c)) for c in ("name", "title", "current_company", "location"))))
    joined = people.join(items, "person_id", "left").join(own.select("company_id", "terms", "size"), "company_id", "left").withColumn("role", T.role(F.col("title")))
    has = F.coalesce(F.col("n"), F.lit(0)) > 0
    here = F.exists("terms", lambda t: F.contains(F.lower(T.blank(F.col("current_company"))), t))
    base = F.coalesce(F.col("match"), F.lit(0.0))
    match = F.when((T.blank(F.col("current_company")) != "") & F.coalesce(here, F.lit(False)), F.least(F.lit(30.0), base + 6)).otherwise(base)
    ended = T.has_any(words, L.ENDED_HINTS) | (F.coalesce("ended_claim", F.lit(0)) == 1)
    current = F.coalesce("is_current", F.lit(True))
    authority = F.col("role.authority")
    cut = F.floor(authority * F.lit(0.3)).cast("int")
    power = F.when(ended, F.when(current, cut).otherwise(F.greatest(F.lit(0), cut - 5))).otherwise(authority)
    shift = F
    for size, table in L.SIZE_PREFERENCE.items():
        shift = shift.when(F.coalesce("size", F.lit("medium")) == size, _lookup(F.col("role.category"), table, 0))
    relevance = _lookup(F.col("role.category"), L.RELEVANCE, 4.0) * F.when(current, 1.0).otherwise(0.4)
    quality = F.when(has, F.round(F.col("trust") * 15 * (F.lit(0.55) + F.lit(0.45) * F.least(F.lit(1.0), F.col("n") / 3)), 1)).otherwise(0.0)
    fresh = F.when(has, T.recency(F.col("newest"), as_of_year)).otherwise(0.0)
    scored = joined.select(
        "company_id",
        "person_id",
        "name",
        F.col("role.category").alias("role_category"),
        F.round(F.least(F.lit(30.0), match), 1).alias("company_match"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(25.0), power + shift.otherwise(0))), 1).alias("decision_authority"),
        F.round(relevance, 1).alias("role_relevance"),
        quality.alias("evidence_quality"),
        fresh.alias("evidence_recency"),
    )
    parts = ("company_match", "decision_authority", "role_relevance", "evidence_quality", "evidence_recency")
    return scored.withColumn("total", F.round(sum(F.col(p) for p in parts), 1))


def top_people(scored: DataFrame, k: int = 8) -> DataFrame:
    """The k best people of each company by (-total, name); a top-k report. Groups are cut to k rows before the shuffle."""
    order = W.partitionBy("company_id").orderBy(F.col("total").desc(), F.col("name"), F.col("person_id"))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def page_people(parsed: DataFrame, inline_length: int | None = 140) -> DataFrame:
    """(page_id, name, title): people on pages: table rows, headings with what follows, and "Name, Title" blocks of at most inline_length characters; each pair once a page."""
    text = F.col("b")
    split = F.array(*[F.struct(F.regexp_extract(text, p, 1).alias("x"), F.regexp_extract(text, p, 2).alias("y")) for p in (r"^(.{3,60}?)\s*[,，|–—:]\s*(.+)$", r"^(.{3,60}?)\s+-\s+(.+)$")])
    pairs = F.flatten(
        F.array(
            F.flatten(F.transform("rows", lambda r: F.transform(F.filter(r, lambda c, i: i > 0), lambda c: F.struct(F.get(r, 0).alias("x"), c.alias("y"))))),
            F.flatten(F.transform("headings", lambda h: F.transform(F.filter(h, lambda c, i: i > 0), lambda c: F.struct(F.get(h, 0).alias("x"), c.alias("y"))))),
            F.transform(F.sequence(F.lit(1), F.greatest(F.size("blocks") - 1, F.lit(1))), lambda i: F.struct(F.get("blocks", i - 1).alias("x"), F.get("blocks", i).alias("y"))),
        )
    )
    whole = parsed.select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.x", "p.y")
    inline = parsed.select("page_id", F.explode("blocks").alias("b")).filter(F.lit(True) if inline_length is None else F.length("b") <= inline_length).select("page_id", F.explode(split).alias("p")).select("page_id", "p.x", "p.y")
    every = whole.unionByName(inline).filter("x <> '' AND y <> ''")
    turned = every.unionByName(every.select("page_id", F.col("y").alias("x"), F.col("x").alias("y")))
    found = turned.filter(T.looks_like_name(F.col("x")) & T.looks_like_title(F.col("y"))).select("page_id", F.trim("x").alias("name"), F.trim("y").alias("title"))
    return found.groupBy("page_id", F.lower("name").alias("n"), F.lower("title").alias("t")).agg(F.min("name").alias("name"), F.min("title").alias("title")).select("page_id", "name", "title")


def snippet_people(hits: DataFrame, companies: DataFrame) -> DataFrame:
    """(company_id, name_key, name, title, hit_id): people named in hits that mention the company; the first hit of each name wins.

    hits: hit_id, company_id, url, snippet. "Name, Title", "Name - Title" and "Name | Title" count where the name looks like a name and the title, or its tail from the
    first role word on, like a title, and where the title ties nobody to another company.
    """
    own = company_words(companies).select("company_id", "terms")
    url, snippet = T.blank(F.col("url")), T.blank(F.col("snippet"))
    plain = snippet
    for entity, sign in (("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    low = F.lower(F.concat_ws(" ", url, plain))
    near = hits.join(own, "company_id").withColumn("text", plain).filter(F.exists("terms", lambda t: F.contains(low, t)) & T.people_source(url, F.col("text")))
    name = r"[A-Z][\p{L}'’.-]+(?: [A-Z][\p{L}'’.-]+){1,3}"
    pattern = rf"({name})\s*[,|–—-]\s*([^,|.;\n]{{3,60}})"
    pairs = F.zip_with(F.regexp_extract_all("text", F.lit(pattern), 1), F.regexp_extract_all("text", F.lit(pattern), 2), lambda n, t: F.struct(F.trim(n).alias("name"), F.trim(t).alias("title")))
    found = near.select("company_id", "hit_id", "terms", "text", F.posexplode(pairs).alias("seq", "p")).select("company_id", "hit_id", "terms", "text", "seq", "p.*")
    tail = F.regexp_extract("title", rf"(?iu)((?:{T._OPENERS}).*)$", 1)
    chrome = F.length("title") - F.length(tail)
    titled = T.looks_like_title(F.col("title")) | ((tail != "") & chrome.between(2, 41) & T.looks_like_title(tail))
    kept = found.filter(T.looks_like_name(F.col("name")) & titled).filter(~T.other_company(F.concat_ws(" ", "title", "text"), F.col("terms"))).withColumn("name_key", T.person_key(F.col("name"))).filter("name_key <> ''")
    return kept.groupBy("company_id", "name_key").agg(F.min_by(F.struct("name", "title", "hit_id"), F.struct("hit_id", "seq")).alias("b")).select("company_id", "name_key", "b.*")


def person_confidence(evidence: DataFrame, companies: DataFrame) -> DataFrame:
    """(person_id, confidence): how sure the link to the company is: the best item, lifted on the company's own domain and for
    quoted titles, plus up to 0.15 for further items; 0.98 at most. Persons without evidence have no row."""
    own = companies.select("company_id", F.regexp_replace(F.lower(T.blank(F.col("domain"))), r"^www\.", "").alias("domain"))
    on_domain = (F.col("domain") != "") & F.contains(F.lower(T.blank(F.col("source_url"))), F.col("domain"))
    titled = F.coalesce(F.col("claim_type") == "person_title", F.lit(False)) & (T.blank(F.col("source_text")) != "")
    value = F.coalesce("confidence", F.lit(0.0)) + F.when(on_domain, 0.15).otherwise(0.0) + F.when(titled, 0.1).otherwise(0.0)
    items = evidence.filter("person_id IS NOT NULL").join(own, "company_id").groupBy("person_id").agg(F.max(value).alias("best"), F.count(F.lit(1)).alias("n"))
    return items.select("person_id", F.round(F.least(F.lit(0.98), F.greatest("best", F.lit(0.0)) + F.least(F.lit(0.15), F.lit(0.05) * (F.col("n") - 1))), 2).alias("confidence"))
