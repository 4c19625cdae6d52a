"""Contact channels found in texts, the address pattern of a company, and the pick per kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimforge import lexicon as L
from claimforge.functions import text as T

PRIORITY = {"direct_email": 0, "general_email": 2, "contact_form": 3, "phone": 4, "other": 5}


def _official(email, domain):
    at = F.substring_index(email, "@", -1)
    return (domain != "") & ((at == domain) | F.endswith(at, F.concat(F.lit("."), domain)))


def text_emails(texts: DataFrame, key: str = "doc_id", junk: list[str] = L.EMAIL_JUNK) -> DataFrame:
    """(key, company_id, seq, email): usable addresses of every text, first seen first."""
    return texts.select(key, "company_id", F.posexplode(T.emails(F.col("text"), junk)).alias("seq", "email"))


def candidates(texts: DataFrame, companies: DataFrame, names: DataFrame | None = None, key: str = "doc_id", junk: list[str] = L.EMAIL_JUNK, most_phones: int | None = None) -> DataFrame:
    """One row per company and channel (kind, value in lower case): its best-placed sighting.

    names: (company_id, names) with at most a few names each (the ranked people). Mailboxes for roles count only on the company's own
    domain; there every address gains 0.2, elsewhere a personal one has 0.5 at most.
    """
    own = companies.select("company_id", F.regexp_replace(F.lower(T.blank(F.col("domain"))), r"^www\.", "").alias("domain"))
    if names is not None:
        own = own.join(names, "company_id", "left")
    else:
        own = own.withColumn("names", F.array().cast("array<string>"))
    mail = text_emails(texts, key, junk).join(own, "company_id").withColumn("k", T.email_kind(F.col("email"), F.coalesce("names", F.array().cast("array<string>"))))
    official = _official(F.col("email"), F.col("domain"))
    c = F.col("k.confidence")
    confidence = F.when(F.col("k.kind") == "direct", F.when(official, F.least(F.lit(0.95), c + 0.2)).otherwise(F.least(c, F.lit(0.5)))).otherwise(F.least(F.lit(0.95), c + 0.2))
    mails = mail.filter((F.col("k.kind") != "") & (official | (F.col("k.kind") == "direct"))).select("company_id", F.concat("k.kind", F.lit("_email")).alias("kind"), F.col("email").alias("value"), key, "seq", F.round(confidence, 2).alias("confidence"))
    calls = texts.join(companies.select("company_id"), "company_id", "left_semi").select("company_id", F.lit("phone").alias("kind"), key, F.posexplode(T.phones(F.col("text"), most_phones)).alias("seq", "value")).withColumn("confidence", F.lit(0.5))
    chats = texts.join(companies.select("company_id"), "company_id", "left_semi").select("company_id", F.lit("other").alias("kind"), key, F.lit(0).alias("seq"), T.wechat(F.col("text")).alias("id")).filter("id <> ''").select("company_id", "kind", key, "seq", F.concat(F.lit("WeChat: "), "id").alias("value"), F.lit(0.6).alias("confidence"))
    every = mails.unionByName(calls.select(*mails.columns)).unionByName(chats.select(*mails.columns))
    first = F.min_by(F.struct("value", "confidence", key, "seq"), F.struct(key, "seq"))
    return every.groupBy("company_id", "kind", F.lower("value").alias("v")).agg(first.alias("f")).select("company_id", "kind", "f.value", "f.confidence", F.col(f"f.{key}").alias(key), "f.seq")


def choose(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per company and kind the first channel by (priority, -confidence, place): the one that is shown."""
    order = W.partitionBy("company_id", "kind").orderBy(F.col("confidence").desc(), key, "seq", "value")
    return found.withColumn("n", F.row_number().over(order)).filter("n = 1").select("company_id", "kind", "value", "confidence")


def email_pattern(official: DataFrame) -> DataFrame:
    """(company_id, pattern, confidence): the commonest shape of personal mailboxes; of equals the first seen.

    official: (company_id, email, place), one row per address.
    """
    tokens = F.filter(F.split(T.local_part(F.col("email")), "[._-]"), lambda t: t != "")
    personal = official.filter(~T.local_part(F.col("email")).isin(L.PATTERN_LOCALS)).withColumn("n", F.size(tokens)).filter("n > 0")
    shaped = personal.withColumn("shape", F.when(F.col("n") == 1, "first").when(F.col("n") == 2, "first.last").otherwise("f.last"))
    counted = shaped.groupBy("company_id", "shape").agg(F.count(F.lit(1)).alias("count"), F.min("place").alias("place"))
    best = counted.groupBy("company_id").agg(F.max_by(F.struct("shape", "count"), F.struct("count", F.struct(-F.col("place.id"), -F.col("place.seq")))).alias("b"), F.count(F.lit(1)).alias("shapes"))
    sure = F.when(F.col("b.count") == 1, 0.5).otherwise(F.least(F.lit(0.85), F.lit(0.5) + F.lit(0.12) * F.col("b.count")))
    return best.select("company_id", F.col("b.shape").alias("pattern"), F.round(F.greatest(F.lit(0.0), sure - F.when(F.col("shapes") > 1, 0.1).otherwise(0.0)), 2).alias("confidence"))


def inferred_emails(people: DataFrame, patterns: DataFrame, companies: DataFrame) -> DataFrame:
    """(person_id, email, confidence): the pattern applied to people of two words or more, never above 0.55."""
    words = F.filter(F.split(T.squeeze(F.regexp_replace(F.lower(T.blank(F.col("name"))), r"(?U)[^\p{L}\p{N}_\s]", " ")), r"[\s.]+"), lambda t: t != "")
    domain = F.regexp_replace(F.lower(T.blank(F.col("domain"))), r"^www\.", "")
    joined = people.select("person_id", "company_id", words.alias("w")).filter(F.size("w") >= 2).join(patterns, "company_id").join(companies.select("company_id", domain.alias("d")), "company_id").filter("d <> ''")
    first, last = F.get("w", 0), F.get("w", F.size("w") - 1)
    local = F.when(F.col("pattern") == "first.last", F.concat(first, F.lit("."), last)).when(F.col("pattern") == "f.last", F.concat(F.substring(first, 1, 1), F.lit("."), last)).otherwise(first)
    return joined.select("person_id", F.concat(local, F.lit("@"), "d").alias("email"), F.round(F.least(F.lit(0.55), F.col("confidence") * 0.6), 2).alias("confidence"))


def contact_forms(parsed: DataFrame) -> DataFrame:
    """(page_id, url): where a message with a sender can be sent; without consent, newsletter, search and account forms."""
    forms = parsed.select("page_id", F.col("url").alias("page_url"), F.posexplode("forms").alias("seq", "f")).select("page_id", "page_url", "seq", "f.*")
    blob = F.concat_ws(" ", "about", "controls")
    can = (T.has_any(blob, L.FORM_MESSAGE) | T.has_any(F.col("about"), L.FORM_NAMES)) & T.has_any(blob, L.FORM_IDENTITY)
    kept = forms.filter(~T.has_any(F.col("about"), L.NOT_CONTACT_FORM) & can)
    own = (F.trim("action") == "") | F.lower("action").startswith("javascript:")
    base = F.regexp_extract("page_url", r"^https?://[^/?#]+", 0)
    full = F.when(own, F.col("page_url")).when(F.col("action").rlike("^https?://"), F.col("action")).when(F.startswith("action", F.lit("/")), F.concat(base, "action")).otherwise(F.concat(F.regexp_extract("page_url", r"^(https?://[^?#]*/)", 1), "action"))
    targets = kept.withColumn("url", full).filter(~T.has_any(F.lower("url"), L.SEARCH_ENDPOINTS) & F.col("url").rlike("^https?://"))
    return targets.groupBy("page_id", F.regexp_replace("url", "/+$", "").alias("k")).agg(F.min_by("url", "seq").alias("url")).select("page_id", "url")
