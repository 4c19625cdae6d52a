"""Problem 3: the best representative of each group of duplicates, by iterative truth discovery.

Every usable value of a record is a claim of the record's sources. Two more witnesses claim a value of every person and field: LATEST that
of the latest usable record, SUREST that of the most confident one. Two steps alternate until no reliability moves by more than
TOLERANCE (not within ROUNDS: an error, never an unfinished result):

* a value's support is the share of its sources' claims (each claim weighs the record's confidence times the mean reliability of its sources)
  in all those of its person and field, plus the weight of the witnesses that claim it: WITNESS times their reliability, of FLOOR at least;
  its share is its support over that of all values;
* a source's or witness's reliability is the mean share of the values it claims, drawn towards 1/2 by PRIOR claims.

The value of most support survives, in every group. Where both witnesses claim one value, it wins whatever the reliabilities are, as
2 * WITNESS * FLOOR > 1 and all other claims weigh 1 together. Such groups are therefore counted once per source, as right or wrong; the rounds
go over the contested groups only, and start from the reliabilities that the others give. The vote over all groups follows with the final ones.

``settled`` is an exact check of the outcome: the surviving value's record is the latest usable one and also the most confident.
Ties: higher share, then later, more confident, earlier loaded, smaller version_id.

A value is usable if it is present, of the field's kind, not a stand-in and not cut short.

Skew: claims are reduced to (person, field, value, source) weights before anything is joined; sums are partial
aggregates; reliabilities are joined on a salted key, as one source may stand behind a third of all claims. No group is
collected: the surviving record's sources are those of the (at most three) records whose values survive.

Results at the edges: a group without a usable value of a field has null there (version_id null); rows with a null
person_key are ignored; repeated rows strengthen their value, and of equal rows the earlier loaded one is named; null confidence
weighs 0 and ranks below any other, null retrieved_at is the oldest. Jobs run while the result is built (the rounds).
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import checkpointed, host_of, written

log = logging.getLogger(__name__)

ROUNDS = 100
TOLERANCE = 0.005
PRIOR = 4.0
#: The witnesses' names can't be hosts.
LATEST, SUREST = "<latest>", "<surest>"
WITNESS, FLOOR = 2.0, 0.3
SALTS = 8
FIELDS = ("title", "location", "linkedin")

# What stands for a missing value, in lower case.
STAND_INS = [
    "-", "--", "?", "??", "???", ".", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "undefined", "tbd", "tba", "tbc", "todo", "unknown",
    "not available", "not specified", "no data", "keine angabe", "k.a.", "unbekannt", "inconnu", "desconocido", "x", "xx", "xxx", "test",
    "title", "(title)", "[title]", "job title", "position", "view profile", "see profile", "profile", "see website", "read more", "more",
    "location", "(location)", "[location]", "earth", "worldwide", "everywhere", "anywhere", "city", "country", "#",
]
CUT = r"(?:…|\.\.+|[-–—])\s*(?:more|mehr|plus|más)?\s*$"
PERSON_LINK = r"^https?://[^/\s]+/(?:[^/\s]+/)*(?:in|pub|people|profile|profiles|person|user|users|u)/[^/?#\s]*[\p{L}\p{N}][^/?#\s]*/?(?:[?#]\S*)?$"


def usable(field: str, value: Column) -> Column:
    text = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    if field == "linkedin":
        return F.coalesce(F.lower(text).rlike(PERSON_LINK) & ~text.rlike(r"(?:…|\.\.+|-)$"), F.lit(False))
    there = text.rlike(r"[\p{L}\p{N}]") & ~F.lower(text).isin(STAND_INS) & ~text.rlike(CUT) & ~F.lower(text).rlike(r"^(?:https?://|www\.)|@")
    return F.coalesce(there, F.lit(False))


def _form(field: str, value: Column) -> Column:
    """What makes two values the same vote."""
    text = F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))
    return F.regexp_replace(text, r"[/?#]+$", "") if field == "linkedin" else text


def claims(versions: DataFrame) -> DataFrame:
    """(person_key, field, value, form, ...): one row per usable value of each record."""
    fields = [F.when(usable(f, F.col(f)), F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), _form(f, F.col(f)).alias("form"))) for f in FIELDS]
    rows = versions.filter(F.col("person_key").isNotNull()).select("person_key", "version_id", "confidence", "retrieved_at", "loaded_at", "sources", F.explode(F.array_compact(F.array(*fields))).alias("c"))
    return rows.select("person_key", "version_id", "confidence", "retrieved_at", "loaded_at", "sources", "c.*")


def _rank() -> Column:
    """The order of records by recency; its largest is the latest, and of equal ones the earlier loaded."""
    return F.struct("retrieved_at", "confidence", (-F.unix_micros("loaded_at")).alias("loaded"), (-F.col("version_id")).alias("version"))


def witnesses(claimed: DataFrame) -> DataFrame:
    """(person_key, field, latest, surest): the (form, version_id) of the latest usable record and of the most confident one, the later if equal."""
    surest = F.struct("confidence", "retrieved_at", (-F.unix_micros("loaded_at")).alias("loaded"), (-F.col("version_id")).alias("version"))
    named = F.struct("form", "version_id")
    return claimed.groupBy("person_key", "field").agg(F.max_by(named, _rank()).alias("latest"), F.max_by(named, surest).alias("surest"))


def _votes(claimed: DataFrame, ends: DataFrame) -> DataFrame:
    """(p, v, salt, source, w, n, witness, decided, right): one row per person and field p, value v and source, with the weight of its claims."""
    source = F.when(F.size(F.coalesce("sources", F.array())) > 0, F.transform("sources", lambda u: F.coalesce(F.nullif(host_of(u), F.lit("")), F.lit("?")))).otherwise(F.array(F.lit("?")))
    weighed = claimed.select("person_key", "field", "form", F.array_distinct(source).alias("hosts"), F.coalesce(F.greatest("confidence", F.lit(0.0)), F.lit(0.0)).alias("w"))
    ordinary = (
        weighed.select("person_key", "field", "form", F.explode("hosts").alias("source"), (F.col("w") / F.size("hosts")).alias("w"))
        .groupBy("person_key", "field", "form", "source")
        .agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n"))
        .join(ends, ["person_key", "field"])
        .select("person_key", "field", "form", "source", "w", "n", F.lit(False).alias("witness"), "latest", "surest")
    )
    claim = lambda name, end: F.struct(F.lit(name).alias("source"), F.col(f"{end}.form").alias("form"))
    witnessed = ends.select("*", F.explode(F.array(claim(LATEST, "latest"), claim(SUREST, "surest"))).alias("c"))
    witnessed = witnessed.select("person_key", "field", "c.form", "c.source", F.lit(0.0).alias("w"), F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("witness"), "latest", "surest")
    keyed = ordinary.unionByName(witnessed).select(
        _group().alias("p"), _value().alias("v"), "source", "w", "n", "witness", (F.col("latest.form") == F.col("surest.form")).alias("decided"), (F.col("form") == F.col("latest.form")).cast("double").alias("right")
    )
    return keyed.withColumn("salt", F.pmod("v", F.lit(SALTS)).cast("int"))


def _group() -> Column:
    return F.xxhash64("person_key", "field")


def _value() -> Column:
    return F.xxhash64("form", "field", "person_key")


def _shares(votes: DataFrame, reliability: DataFrame) -> DataFrame:
    """(p, v, share): every value's share of the support in its group."""
    copies = reliability.select("source", "r", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    claims_, witness = F.when(~F.col("witness"), F.col("w") * F.col("r")), F.when(F.col("witness"), WITNESS * F.greatest("r", F.lit(FLOOR)))
    support = votes.join(copies, ["source", "salt"]).groupBy("p", "v").agg(F.coalesce(F.sum(claims_), F.lit(0.0)).alias("s"), F.coalesce(F.sum(witness), F.lit(0.0)).alias("b"))
    total = support.groupBy("p").agg(F.sum("s").alias("all"), F.sum("b").alias("bonus"), F.count(F.lit(1)).alias("values"))
    part = F.when(F.col("all") > 0, F.col("s") / F.col("all")).otherwise(1 / F.col("values"))
    return support.join(total, "p").select("p", "v", ((part + F.col("b")) / (1 + F.col("bonus"))).alias("share"))


def reliabilities(votes: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, r): the reliabilities that stand."""
    r = lambda hits, n: (hits + PRIOR / 2) / (n + PRIOR)
    hits, known = F.sum(F.when(F.col("decided"), F.col("right") * F.col("n")).otherwise(0.0)), F.sum(F.when(F.col("decided"), F.col("n")).otherwise(0))
    now = checkpointed(votes.groupBy("source").agg(hits.alias("hits"), known.alias("known")).withColumn("r", r(F.col("hits"), F.col("known"))))
    contested = written(votes.filter(~F.col("decided")).drop("decided", "right"))
    for n in range(1, max(1, rounds) + 1):
        better = contested.join(_shares(contested, now), ["p", "v"]).groupBy("source").agg(F.sum(F.col("share") * F.col("n")).alias("more"), F.sum("n").alias("m"))
        next_r = r(F.col("hits") + F.coalesce("more", F.lit(0.0)), F.col("known") + F.coalesce("m", F.lit(0)))
        now = checkpointed(now.join(better, "source", "left").select("source", "hits", "known", next_r.alias("r"), F.abs(next_r - F.col("r")).alias("moved")))
        furthest = now.agg(F.max("moved")).first()[0]
        if furthest is None or furthest <= tolerance:
            log.info("reliabilities stand after %d rounds", n)
            return now.select("source", "r")
    raise RuntimeError(f"reliabilities still move by {furthest} after {n} rounds (tolerance {tolerance})")


def resolve(versions: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(person_key, field, value, version_id, share, settled): the surviving value of every person and field that has one."""
    claimed = written(claims(versions))
    ends = written(witnesses(claimed))
    votes = written(_votes(claimed, ends))
    shares = _shares(votes, reliabilities(votes, rounds, tolerance))
    # The record that stands for a value: the latest that claims it.
    record = claimed.groupBy("person_key", "field", "form").agg(F.max_by(F.struct("value", "version_id"), _rank()).alias("record"), F.max(_rank()).alias("rank"))
    best = (
        record.select("person_key", "field", "record", "rank", _group().alias("p"), _value().alias("v"))
        .join(shares, ["p", "v"])
        .groupBy("person_key", "field")
        .agg(F.max_by(F.struct("record.value", "record.version_id", "share"), F.struct("share", "rank")).alias("best"))
    )
    one = (F.col("best.version_id") == F.col("latest.version_id")) & (F.col("best.version_id") == F.col("surest.version_id"))
    return best.join(ends, ["person_key", "field"]).select("person_key", "field", "best.value", "best.version_id", "best.share", one.alias("settled"))


def people(versions: DataFrame) -> DataFrame:
    """One Person per person_key: the surviving values, the best confidence behind them, and those records' sources."""
    found = resolve(versions)
    columns = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS]
    wide = found.groupBy("person_key").agg(*columns)
    behind = found.select("person_key", "version_id").distinct().join(versions.select("version_id", "confidence", "sources"), "version_id")
    # At most three records stand behind a person, so this gathers a bounded number of lists.
    carried = behind.groupBy("person_key").agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sources", F.array().cast("array<string>")))))).alias("sources"))
    every = versions.filter(F.col("person_key").isNotNull()).groupBy("person_key").agg(F.count(F.lit(1)).alias("records"), F.max("confidence").alias("top"))
    joined = every.join(wide, "person_key", "left").join(carried, "person_key", "left")
    return joined.select("person_key", "records", *FIELDS, F.coalesce("confidence", "top").alias("confidence"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))
