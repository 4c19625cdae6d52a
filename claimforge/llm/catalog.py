"""The queries of this folder, by problem number, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.llm import bpe, lookalike, mainbody, mixture, personal, repeated, residue, survivor, titles, variants
from claimforge.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---- 8: encoding ------------------------------------------------------------------------------------


@query("p8_ids")
def p8_ids(spark, folder):
    return bpe.encode_texts(table(spark, folder, "documents"))


@query(
    "p8_round_trip",
    "SELECT doc_id, true AS same FROM documents",
)
def p8_round_trip(spark, folder):
    """Whether decoding gives each text back (null and empty texts: '')."""
    docs = table(spark, folder, "documents")
    back = bpe.decode_ids(bpe.encode_texts(docs)).withColumnRenamed("text", "decoded")
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


# ---- 5: look-alike text -----------------------------------------------------------------------------


def _p5_sql(columns: str, where: str) -> str:
    """The embedded SQL over whole tables at once: no Arrow batches, no values left out as plain."""
    ctes, final = lookalike.SQL.strip().removeprefix("WITH").rsplit("SELECT replace(", 1)
    clean = "SELECT row, replace(" + final.removesuffix("ORDER BY row")
    values = "SELECT 'pages.text' AS field, page_id AS row_id, text AS value FROM pages UNION ALL SELECT 'people.name', person_id, name FROM people"
    return f"WITH batch AS (SELECT *, row_number() OVER () AS row FROM ({values})), {ctes}, cleaned AS ({clean}) SELECT {columns} FROM batch JOIN cleaned USING (row) {where}"


@query("p5_found", _p5_sql("field, row_id", "WHERE value <> clean"))
def p5_found(spark, folder):
    return lookalike.unify_all(table(spark, folder, "pages"), table(spark, folder, "people")).filter("changed").select("field", "row_id")


@query("p5_clean", _p5_sql("field, row_id, clean AS value, coalesce(value <> clean, false) AS changed", ""))
def p5_clean(spark, folder):
    return lookalike.unify_all(table(spark, folder, "pages"), table(spark, folder, "people"))


# ---- 4: repeated lines ------------------------------------------------------------------------------

_HOST_SQL = r"regexp_replace(lower(regexp_extract(final_url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"
_P4_SQL = rf"""
WITH split AS (
  SELECT page_id, final_url, {_HOST_SQL} AS host, unnest(string_split(text, chr(10))) AS line,
         CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no
  FROM pages WHERE text IS NOT NULL AND final_url IS NOT NULL
), formed AS (
  SELECT page_id, final_url, host, line_no,
         trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '', 'g'), '[\t-\r \x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ') AS form
  FROM split
), frequent AS (
  SELECT host, form FROM formed WHERE form <> '' GROUP BY host, form HAVING count(DISTINCT final_url) >= 8
)
"""


@query("p4_found", _P4_SQL + "SELECT page_id, line_no FROM formed JOIN frequent USING (host, form)")
def p4_found(spark, folder):
    return repeated.occurrences(table(spark, folder, "pages")).select("page_id", "line_no")


@query(
    "p4_clean",
    _P4_SQL
    + """, gone AS (SELECT page_id, list(line_no) AS gone FROM formed JOIN frequent USING (host, form) GROUP BY page_id)
SELECT p.page_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string([x for x, i in string_split(text, chr(10)) if NOT list_contains(gone, i - 1)], chr(10)) END AS text
FROM pages p LEFT JOIN gone USING (page_id)""",
)
def p4_clean(spark, folder):
    return repeated.remove(table(spark, folder, "pages").select("page_id", "final_url", "text")).select("page_id", "text")


@query("p4_sequences")
def p4_sequences(spark, folder):
    return repeated.sequences(table(spark, folder, "pages").select("page_id", "final_url", "text"))


# ---- 2: titles --------------------------------------------------------------------------------------


def _titles(spark, folder):
    return titles.match_titles(table(spark, folder, "people"), table(spark, folder, "role_reference"))


@query("p2_found")
def p2_found(spark, folder):
    return _titles(spark, folder).select("person_id", "role_id")


@query("p2_titles")
def p2_titles(spark, folder):
    """Every person with the entry the title means and its role_category; null where unmatched."""
    reference = table(spark, folder, "role_reference").select("role_id", "canonical_title", "role_category")
    return _titles(spark, folder).join(reference, "role_id", "left").select("person_id", "title", "role_id", "canonical_title", "role_category", "score")


@query("p2_unmatched")
def p2_unmatched(spark, folder):
    """The titles that match nothing, with the number of people."""
    return _titles(spark, folder).filter("role_id = -1").groupBy("title").agg(F.count(F.lit(1)).alias("people"))


# ---- 3: surviving records ---------------------------------------------------------------------------


def _p3_sql() -> str:
    """The settled values by their definition: the latest usable record is also the most confident."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    text = r"trim(regexp_replace(value, '[\t-\r\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), ' ')"
    stand_ins = ", ".join(map(quoted, survivor.STAND_INS))
    plain = rf"regexp_matches(t, '[\p{{L}}\p{{N}}]') AND lower(t) NOT IN ({stand_ins}) AND NOT regexp_matches(t, {quoted(survivor.CUT)}) AND NOT regexp_matches(lower(t), '^(?:https?://|www\.)|@')"
    link = rf"regexp_matches(lower(t), {quoted(survivor.PERSON_LINK)}) AND NOT regexp_matches(t, '(?:…|\.\.+|-)$')"
    fields = " UNION ALL ".join(f"SELECT person_key, version_id, confidence, retrieved_at, loaded_at, '{f}' AS field, {f} AS value FROM person_versions" for f in survivor.FIELDS)
    return f"""WITH usable AS (SELECT * FROM (SELECT *, {text} AS t FROM ({fields})) WHERE person_key IS NOT NULL AND value IS NOT NULL AND CASE WHEN field = 'linkedin' THEN {link} ELSE {plain} END),
ranked AS (SELECT *, row_number() OVER (PARTITION BY person_key, field ORDER BY retrieved_at DESC NULLS LAST, confidence DESC NULLS LAST, loaded_at NULLS LAST, version_id) AS n, max(confidence) OVER (PARTITION BY person_key, field) AS top FROM usable)
SELECT person_key, field, version_id FROM ranked WHERE n = 1 AND confidence IS NOT DISTINCT FROM top AND person_key IN (SELECT person_key FROM person_versions GROUP BY person_key HAVING count(*) >= 2)"""


@query("p3_found", _p3_sql())
def p3_found(spark, folder):
    versions = table(spark, folder, "person_versions")
    several = versions.groupBy("person_key").count().filter("count >= 2").select("person_key")
    return survivor.resolve(versions).filter("settled").join(several, "person_key", "left_semi").select("person_key", "field", "version_id")


@query("p3_people")
def p3_people(spark, folder):
    return survivor.people(table(spark, folder, "person_versions"))


# ---- 6: variant names -------------------------------------------------------------------------------


@query("p6_found")
def p6_found(spark, folder):
    people = variants.person_pairs(table(spark, folder, "people")).select(F.lit("person").alias("entity"), "id_a", "id_b")
    companies = variants.company_pairs(table(spark, folder, "companies")).select(F.lit("company").alias("entity"), "id_a", "id_b")
    return people.unionByName(companies)


def _p6(people: DataFrame, companies: DataFrame, ids: list[str]) -> DataFrame:
    return people.select(F.lit("person").alias("entity"), *ids).unionByName(companies.select(F.lit("company").alias("entity"), *ids))


@query("p6_members")
def p6_members(spark, folder):
    """The classes of equal keys that every row is in."""
    return _p6(variants.person_members(table(spark, folder, "people")), variants.company_members(table(spark, folder, "companies")), ["id", "class_id"])


@query("p6_links")
def p6_links(spark, folder):
    """The linked classes; copies are not expanded."""
    return _p6(variants.person_classes(table(spark, folder, "people"))[1], variants.company_classes(table(spark, folder, "companies"))[1], ["class_a", "class_b"])


# ---- 1: main body -----------------------------------------------------------------------------------


@query("p1_found")
def p1_found(spark, folder):
    pages = table(spark, folder, "pages")
    return mainbody.furniture_lines(pages, mainbody.fit(pages))


@query("p1_main")
def p1_main(spark, folder):
    pages = table(spark, folder, "pages")
    return mainbody.main_texts(pages, mainbody.fit(pages))


# ---- 7: residue -------------------------------------------------------------------------------------


@query("p7_found")
def p7_found(spark, folder):
    return residue.residue_pages(table(spark, folder, "pages"))


@query("p7_clean")
def p7_clean(spark, folder):
    """The pages without residue."""
    pages = table(spark, folder, "pages")
    return pages.select("page_id", "final_url", "text").join(residue.residue_pages(pages), "page_id", "left_anti")


# ---- 9: mixture -------------------------------------------------------------------------------------


@query("p9_mixture")
def p9_mixture(spark, folder):
    return mixture.mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


@query("p9_shares")
def p9_shares(spark, folder):
    return mixture.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


# ---- 10: personal details ---------------------------------------------------------------------------


@query("p10_found")
def p10_found(spark, folder):
    return personal.find(table(spark, folder, "documents"), personal.field())


@query("p10_redacted")
def p10_redacted(spark, folder):
    return personal.redact(table(spark, folder, "documents"), personal.field())
