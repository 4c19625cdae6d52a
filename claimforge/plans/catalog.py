"""Named queries over the tables of a folder, and their SQL twins.

Every query reads its tables whole. The SQL is written for DuckDB, apart from the Spark code, from the same fixed values.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge import lexicon as L
from claimforge.functions import html
from claimforge.functions import text as T
from claimforge.operators import contacts, identity, metrics, people, search, stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF_YEAR = 2025


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return top_people(spark, folder)


# ---- pieces of SQL ----------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _b(c: str) -> str:
    return f"coalesce({c}, '')"


def _any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(w)})" for w in words) + ")"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(map(_q, words)) + ")"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _case(c: str, rules, otherwise: str, show=_q) -> str:
    return "CASE " + " ".join(f"WHEN {_any(c, words)} THEN {show(v)}" for v, words in rules) + f" ELSE {otherwise} END"


def _host(url: str) -> str:
    return rf"regexp_replace(lower(regexp_extract({_b(url)}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', '')"


def _squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'), ' ')"


def _site(h: str) -> str:
    return f"(contains({h}, '.') AND (" + " OR ".join(f"ends_with({h}, {_q(s)})" for s in L.SITE_SUFFIXES) + "))"


def _source_type(url: str, title: str) -> str:
    h = _host(url)
    return _case(f"lower({h} || ' ' || {_b(title)})", L.SOURCE_RULES, f"CASE WHEN {_site(h)} THEN 'company_website' ELSE 'other' END")


_NORM_TITLE = f"lower({_squeeze(_b('title'))})"
_WORD_EDGE = r"(^|[^\p{L}\p{N}_])"
_TERMS_SQL = rf"""own AS (
  SELECT company_id, list_slice(list_distinct_in_order, 1, 10) AS terms, domain FROM (
    SELECT company_id, regexp_replace(lower({_b('domain')}), '^www\.', '') AS domain,
      list_filter(list_concat(list_slice(list_filter(w1, lambda x, i: list_position(w1, x) = i), 1, 10), w2),
        lambda x, i: list_position(list_concat(list_slice(list_filter(w1, lambda y, j: list_position(w1, y) = j), 1, 10), w2), x) = i) AS list_distinct_in_order
    FROM (SELECT company_id, domain,
        list_filter(flatten(list_transform([{_b('canonical_name')}, {_b('legal_name')}, {_b('company_name')}, {_b('domain')}], lambda v: string_split_regex(trim(regexp_replace(lower(v), '[^\p{{L}}\p{{N}}_\s.\-]', ' ', 'g')), '\s+'))), lambda t: length(t) > 2) AS w1,
        flatten(list_transform(coalesce(aliases, []), lambda a: list_slice(list_filter(list_filter(string_split_regex(trim(regexp_replace(lower(coalesce(a, '')), '[^\p{{L}}\p{{N}}_\s.\-]', ' ', 'g')), '\s+'), lambda t: length(t) > 2), lambda t, i: list_position(list_filter(string_split_regex(trim(regexp_replace(lower(coalesce(a, '')), '[^\p{{L}}\p{{N}}_\s.\-]', ' ', 'g')), '\s+'), lambda u: length(u) > 2), t) = i), 1, 10))) AS w2
      FROM companies)))"""


# ---- pages and URLs ---------------------------------------------------------------------------------

_PATH = r"regexp_extract(coalesce(final_url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(
    rf"""SELECT page_id, {_host('final_url')} AS host, {_site(_host('final_url'))} AS company_site, {_source_type('final_url', 'title')} AS found_type,
  NOT regexp_matches({_b('final_url')}, {_q(L.LOW_VALUE_URL)}) AND {_host('final_url')} <> '' AND NOT contains({_host('final_url')}, 'play.google.com') AS worth_fetching,
  len(list_filter(string_split({_PATH}, '/'), lambda s: list_contains({_list(L.PEOPLE_SEGMENTS)}, replace(regexp_replace(lower(trim(s)), '(\.html|\.htm|\.php|\.aspx)$', ''), '_', '-')))) > 0 AS people_page,
  coalesce(status_code >= 200 AND status_code < 400, false) AND {_b('error')} = '' AS ok
FROM pages"""
)
def page_profile(spark, folder):
    """Host, kind and use of every page."""
    url = F.col("final_url")
    ok = F.coalesce((F.col("status_code") >= 200) & (F.col("status_code") < 400), F.lit(False)) & (T.blank(F.col("error")) == "")
    return table(spark, folder, "pages").select("page_id", T.host(url).alias("host"), T.company_site(T.host(url)).alias("company_site"), T.source_type(url, F.col("title")).alias("found_type"), T.worth_fetching(url).alias("worth_fetching"), T.people_page(url).alias("people_page"), ok.alias("ok"))


@query(f"SELECT found_type, count(*) AS items, count(DISTINCT company_id) AS companies FROM (SELECT company_id, {_source_type('source_url', 'source_title')} AS found_type FROM evidence) GROUP BY found_type")
def source_type_counts(spark, folder):
    kinds = table(spark, folder, "evidence").select("company_id", T.source_type(F.col("source_url"), F.col("source_title")).alias("found_type"))
    return kinds.groupBy("found_type").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("company_id").alias("companies"))


@query(f"SELECT evidence_id, NOT regexp_matches({_b('source_url')} || ' ' || {_b('source_title')}, {_q(L.NOT_PEOPLE_SOURCE)}) AS people_source, {_any(f"lower({_b('source_url')} || ' ' || {_b('source_title')})", L.CONTACT_PATHS)} OR {_any(f"lower({_b('source_title')})", L.FORM_HINTS)} AS contact_page FROM evidence")
def evidence_pages(spark, folder):
    """Which sources may name people, and which are contact pages."""
    url, title = F.col("source_url"), F.col("source_title")
    return table(spark, folder, "evidence").select("evidence_id", T.people_source(url, title).alias("people_source"), T.contact_page(url, title).alias("contact_page"))


_SOCIAL_SQL = "CASE " + " ".join(f"WHEN h = {_q(n)} OR ends_with(h, {_q('.' + n)}) THEN {_q(k)}" for n, k in L.SOCIAL_HOSTS.items()) + " END"


@query(f"SELECT network, count(*) AS links FROM (SELECT {_SOCIAL_SQL} AS network FROM (SELECT {_host('u')} AS h FROM (SELECT linkedin AS u FROM people UNION ALL SELECT source_url FROM evidence UNION ALL SELECT final_url FROM pages))) GROUP BY network")
def social_links(spark, folder):
    urls = table(spark, folder, "people").select(F.col("linkedin").alias("u")).unionAll(table(spark, folder, "evidence").select("source_url")).unionAll(table(spark, folder, "pages").select("final_url"))
    return urls.select(T.socials(F.col("u")).alias("network")).groupBy("network").agg(F.count(F.lit(1)).alias("links"))


def _unescaped(c: str) -> str:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        c = f"replace({c}, {_q(entity)}, {_q(sign)})"
    return c


_BARE_HTML = "coalesce(html, '')"
for _gone in ("script", "style", "noscript", "template", "svg"):
    _BARE_HTML = rf"regexp_replace({_BARE_HTML}, '(?is)<{_gone}\b[^>]*>.*?</{_gone}>', '', 'g')"
_INLINE_TAGS = "a|b|i|em|strong|span|small|sup|sub|u|abbr|code|time|img|mark|q|cite|font|label|input|select|option|textarea"
_LINK = _q(r'(?is)<a [^>]*?href="([^"]*)"[^>]*>(.*?)</a>')
# Links in double quotes, made whole by the page's own address.
_LINKS_SQL = rf"""SELECT page_id, url, n, CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-z]+:)', 1) || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href ELSE regexp_extract(url, '^[a-z]+://[^?#]*/') || href END AS target,
  starts_with(href, '#') AS here, {_squeeze("anchor")} AS anchor FROM (
  SELECT page_id, url, unnest(range(len(hrefs))) AS n, trim({_unescaped("unnest(hrefs)")}, ' ') AS href, {_unescaped("regexp_replace(unnest(anchors), '<[^>]*>', '', 'g')")} AS anchor FROM (
    SELECT page_id, coalesce(final_url, url, '') AS url, regexp_extract_all(h, {_LINK}, 1) AS hrefs, regexp_extract_all(h, {_LINK}, 2) AS anchors FROM (SELECT *, {_BARE_HTML} AS h FROM pages)))"""
_WEB_LINKS_SQL = rf"SELECT page_id, url, regexp_replace(target, '#.*$', '') AS target, min(n) AS n, first(anchor ORDER BY n) AS anchor FROM ({_LINKS_SQL}) WHERE NOT here AND regexp_matches(target, '(?i)^https?://') GROUP BY page_id, url, regexp_replace(target, '#.*$', '')"


@query(
    rf"""WITH t AS (SELECT page_id, {_BARE_HTML} AS h FROM pages), named AS (SELECT page_id, {_squeeze(_unescaped("regexp_extract(h, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title, regexp_replace(regexp_replace(h, '(?is)<title[^>]*>.*?</title>', '', 'g'), '(?is)<!--.*?-->', '', 'g') AS h FROM t),
sized AS (SELECT page_id, CASE WHEN title <> '' THEN title ELSE {_squeeze(_unescaped("regexp_replace(regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} END AS title,
  len(list_filter(string_split_regex(regexp_replace(h, '(?i)</?({_INLINE_TAGS})(\s[^>]*)?/?>', '', 'g'), '<[^>]*>'), lambda x: regexp_matches(x, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]'))) AS blocks,
  len(regexp_extract_all(h, '(?is)<h[1-6][^>]*>[^<]*[^<\s]')) AS headings, len(regexp_extract_all(h, '(?i)</tr>')) AS rows, len(regexp_extract_all(h, '(?i)<form\b')) AS forms FROM named)
SELECT page_id, title, blocks, CAST(coalesce(links, 0) AS INTEGER) AS links, forms, rows, headings, CAST(coalesce(mailto, 0) AS INTEGER) AS mailto, CAST(coalesce(tel, 0) AS INTEGER) AS tel FROM sized
LEFT JOIN (SELECT page_id, count(*) AS links FROM ({_WEB_LINKS_SQL}) GROUP BY page_id) USING (page_id) LEFT JOIN (SELECT page_id, count(*) FILTER (regexp_matches(target, '(?i)^mailto:')) AS mailto, count(*) FILTER (regexp_matches(target, '(?i)^tel:')) AS tel FROM ({_LINKS_SQL}) GROUP BY page_id) USING (page_id)"""
)
def page_parts(spark, folder):
    """What one pass over the HTML finds: title, and numbers of blocks, links, forms, rows."""
    parsed = html.parse_pages(table(spark, folder, "pages"), anchor_length=None, form_length=None)
    return parsed.select("page_id", "title", *[F.size(c).alias(c) for c in ("blocks", "links", "forms", "rows", "headings", "mailto", "tel")])


@query(
    rf"""WITH links AS (SELECT page_id, target, n, anchor FROM ({_WEB_LINKS_SQL}) WHERE {_host('target')} = {_host('url')} AND NOT regexp_matches(lower(target), '\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp4|mp3|css|js|ico|woff2?)(\?|$)') AND regexp_replace(target, '/+$', '') <> regexp_extract(target, '^https?://[^/]+')),
weighed AS (SELECT *, {_case("lower(target || ' ' || anchor)", L.LINK_WEIGHTS, "CAST(0 AS DOUBLE)", lambda v: f"CAST({v} AS DOUBLE)")} AS w FROM links),
scored AS (SELECT page_id, target, n, round(w + greatest(CAST(0 AS DOUBLE), CAST(0.6 AS DOUBLE) - CAST(0.2 AS DOUBLE) * greatest(length(target) - length(replace(target, '/', '')) - 4, 0)) + CASE WHEN length(anchor) BETWEEN 1 AND 39 THEN CAST(0.4 AS DOUBLE) ELSE 0 END, 2) AS weight FROM weighed WHERE w > 0)
SELECT page_id, target AS url, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, n) AS rank FROM scored) WHERE rank <= 8"""
)
def internal_link_rank(spark, folder):
    return search.rank_links(html.parse_pages(table(spark, folder, "pages"), anchor_length=None))


# ---- companies --------------------------------------------------------------------------------------


@query(rf"SELECT company_id, {_squeeze(rf"regexp_replace(replace({_b('company_name')}, chr(160), ' '), '[?\x{{FFFD}}\x{{0}}-\x{{1F}}]', ' ', 'g')")} AS clean_name, trim({_b('company_name')}, ' ') = '' OR contains({_b('company_name')}, '?') AS degraded FROM companies")
def clean_company_names(spark, folder):
    name = F.col("company_name")
    return table(spark, folder, "companies").select("company_id", T.clean_name(name).alias("clean_name"), T.degraded_name(name).alias("degraded"))


@query(f"WITH {_TERMS_SQL} SELECT company_id, terms FROM own")
def company_terms(spark, folder):
    """The words each company is known by."""
    return people.company_words(table(spark, folder, "companies")).select("company_id", "terms")


_DOMAIN = rf"regexp_replace(lower({_b('domain')}), '^www\.', '')"
_QUERIES_SQL = rf"""asked AS (
  SELECT company_id, list_filter([q for q in list_concat(
      [CASE WHEN usable THEN '"' || name || '"' || s END for s in {_list(["", *(f" {r}" for r in L.PRIORITY_ROLES), " team"])}],
      [CASE WHEN dom <> '' THEN '"' || dom || '"' END],
      [CASE WHEN dom <> '' THEN 'site:' || dom || s END for s in {_list([f" {p}" for p in L.SITE_PATHS])}],
      [CASE WHEN dom <> '' AND degraded THEN dom || s END for s in {_list([f" {r}" for r in L.PRIORITY_ROLES])}]) if q IS NOT NULL], lambda q: true) AS qs
  FROM (SELECT company_id, {_squeeze(_b('company_name'))} AS name, {_DOMAIN} AS dom, trim({_b('company_name')}, ' ') = '' OR contains({_b('company_name')}, '?') AS degraded,
        {_squeeze(_b('company_name'))} <> '' AND NOT (trim({_b('company_name')}, ' ') = '' OR contains({_b('company_name')}, '?')) AS usable FROM companies)
), initial AS (
  SELECT company_id, unnest(range(len(d))) AS seq, unnest(d) AS query FROM (
    SELECT company_id, list_filter(qs, lambda q, i: list_position(list_transform(qs, lambda x: lower(x)), lower(q)) = i) AS d FROM asked)
)"""


@query(f"WITH {_QUERIES_SQL} SELECT company_id, CAST(seq AS INTEGER) AS seq, query FROM initial")
def initial_queries(spark, folder):
    return search.initial_queries(table(spark, folder, "companies"))


_NATIVE_SQL = "CASE lang " + " ".join(f"WHEN {_q(n)} THEN {_list(w)}" for n, _, w in L.LANGUAGES) + " ELSE [] END"
_LANGUAGE_SQL = _case(f"lower({_b('country')} || ' ' || {_b('language')})", [(n, k) for n, k, _ in L.LANGUAGES], "''")


@query(
    f"""WITH {_QUERIES_SQL}, pass AS (
  SELECT company_id, list_concat([dom || t for t in {_list([*(f" {t}" for t in L.PEOPLE_TERMS), ' "meet the team" OR "our team"'])}], [dom || ' ' || w for w in {_NATIVE_SQL}]) AS qs
  FROM (SELECT company_id, 'site:' || {_DOMAIN} AS dom, {_LANGUAGE_SQL} AS lang FROM companies WHERE {_DOMAIN} <> '')
), numbered AS (
  SELECT company_id, unnest(range(len(d))) AS seq, unnest(d) AS query FROM (SELECT company_id, list_filter(qs, lambda q, i: list_position(list_transform(qs, lambda x: lower(x)), lower(q)) = i) AS d FROM pass)
) SELECT company_id, CAST(seq AS INTEGER) AS seq, query FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM initial i WHERE i.company_id = n.company_id AND i.query = n.query)"""
)
def people_queries(spark, folder):
    return search.people_queries(table(spark, folder, "companies"))


@query(f"SELECT company_id, {_case(f"lower({_b('country')} || ' ' || {_b('language')})", [(n, k) for n, k, _ in L.LANGUAGES], "''")} AS vocabulary FROM companies")
def company_language(spark, folder):
    """The native vocabulary that country and language select."""
    return table(spark, folder, "companies").select("company_id", T.language(F.col("country"), F.col("language")).alias("vocabulary"))




@query(
    rf"""SELECT DISTINCT company_id, relation, name FROM (
  SELECT company_id, 'legal_entity_of' AS relation, legal_name AS name FROM companies WHERE {_b('legal_name')} <> '' AND lower(legal_name) <> lower({_squeeze(rf"regexp_replace(replace({_b('company_name')}, chr(160), ' '), '[?\x{{FFFD}}\x{{0}}-\x{{1F}}]', ' ', 'g')")})
  UNION ALL SELECT company_id, 'parent_of', parent_company FROM companies WHERE {_b('parent_company')} <> ''
  UNION ALL SELECT company_id, 'alias_of', a FROM (SELECT company_id, unnest(list_slice(coalesce(aliases, []), 1, 4)) AS a FROM companies) WHERE {_b('a')} <> '')"""
)
def related_entities(spark, folder):
    return identity.related(table(spark, folder, "companies"))


# ---- people and evidence ----------------------------------------------------------------------------

_ROLE_SQL = (
    f"CASE WHEN norm = '' THEN ['unknown', '0'] "
    + " ".join(f"WHEN {_any('norm', words)} THEN [{_q(c)}, '{a}']" for c, a, words in L.ROLE_TIERS)
    + rf" WHEN regexp_matches(norm, '{_WORD_EDGE}(chief|ceo|president)($|[^\p{{L}}\p{{N}}_])') THEN ['chief_executive', '22'] ELSE ['unknown', '4'] END"
)
_RANK_SQL = "CASE " + " ".join(f"WHEN contains(lower({_b('title')}), {_q(w)}) THEN {len(L.SENIORITY) - i}" for i, w in enumerate(L.SENIORITY)) + " ELSE 0 END"


@query(f"SELECT person_id, r[1] AS category, CAST(r[2] AS INTEGER) AS authority, rank FROM (SELECT person_id, {_ROLE_SQL} AS r, rank FROM (SELECT person_id, {_NORM_TITLE} AS norm, {_RANK_SQL} AS rank FROM people))")
def role_classification(spark, folder):
    title = F.col("title")
    rows = table(spark, folder, "people").withColumn("r", T.role(title))
    return rows.select("person_id", "r.category", "r.authority", T.title_rank(title).alias("rank"))


_OPENERS_SQL = "|".join(re.escape(w) for w in sorted(L.TITLE_OPENERS, key=lambda w: (-len(w), w)))
_IS_TITLE_SQL = rf"(trim({_b('title')}, ' ') <> '' AND length(trim({_b('title')}, ' ')) <= 60 AND regexp_matches(trim({_b('title')}, ' '), {_q(rf'(?i)^\s*(?:{_OPENERS_SQL})($|[^\p{{L}}\p{{N}}_])')}) AND NOT regexp_matches(trim({_b('title')}, ' '), {_q(L.TITLE_PROSE)}) AND NOT regexp_matches(trim({_b('title')}, ' '), {_q(L.TITLE_CHROME)}))"
# Noise words stand between characters that are no word characters; a doubled space lets neighbours match too.
_NAME_SQL = rf"""named AS (
  SELECT *, list_filter(string_split({_squeeze(rf"lower(regexp_replace(replace(' ' || regexp_replace(trim({_b('name')}, ' '), '[^\p{{L}}\p{{N}}_\s.''-]', ' ', 'g') || ' ', ' ', '  '), '([^\p{{L}}\p{{N}}_])({'|'.join(L.NAME_NOISE)})([^\p{{L}}\p{{N}}_])', '\1 \3', 'g'))")}, ' '), lambda t: t <> '') AS words FROM people
), keyed AS (
  SELECT *, CASE len(words) WHEN 0 THEN '' WHEN 1 THEN words[1] ELSE words[-1] || '|' || substr(words[1], 1, 1) END AS name_key FROM named
)"""


@query(f"WITH {_NAME_SQL} SELECT person_id, name_key FROM keyed")
def person_keys(spark, folder):
    return table(spark, folder, "people").select("person_id", T.person_key(F.col("name")).alias("name_key"))


@query(
    f"""WITH {_NAME_SQL}, ranked AS (SELECT *, {_b('title')} AS t, {_RANK_SQL} AS rank, {_IS_TITLE_SQL} AS clean FROM keyed WHERE name_key <> '')
SELECT company_id, name_key, min(person_id) AS person_id, arg_min(name, person_id) AS name,
  first(t ORDER BY (t <> '') DESC, rank DESC, clean DESC, length(t) DESC, person_id) AS title,
  arg_min(current_company, person_id) FILTER ({_b('current_company')} <> '') AS current_company, arg_min(linkedin, person_id) FILTER ({_b('linkedin')} <> '') AS linkedin, arg_min(location, person_id) FILTER ({_b('location')} <> '') AS location,
  bool_and(coalesce(is_current, true)) AS is_current, count(*) AS sightings
FROM ranked GROUP BY company_id, name_key"""
)
def person_merge(spark, folder):
    return people.merge_people(table(spark, folder, "people"))


@query(
    """WITH rows AS (SELECT company_id, person_id, claim_type, source_url, source_text, confidence, min(evidence_id) AS evidence_id, arg_min(claim_value, evidence_id) FILTER (true) AS claim_value FROM evidence GROUP BY ALL),
marked AS (SELECT *, length(coalesce(source_text, '')) AS size, coalesce(max(length(coalesce(source_text, ''))) OVER (PARTITION BY company_id, person_id, claim_type, source_url ORDER BY evidence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) < length(coalesce(source_text, '')) AS longest FROM rows)
SELECT company_id, person_id, claim_type, source_url, first(evidence_id ORDER BY size DESC, evidence_id) AS evidence_id, first(source_text ORDER BY size DESC, evidence_id) AS source_text, max(confidence) FILTER (longest) AS confidence, count(*) AS quotes
FROM marked GROUP BY company_id, person_id, claim_type, source_url""".replace("arg_min(claim_value, evidence_id) FILTER (true) AS claim_value", "1 AS one").replace("GROUP BY ALL", "GROUP BY company_id, person_id, claim_type, source_url, source_text, confidence")
)
def evidence_dedupe(spark, folder):
    return people.dedupe_evidence(table(spark, folder, "evidence")).drop("claim_value")


_TRUST_SQL = "CASE kind " + " ".join(f"WHEN {_q(k)} THEN CAST({v} AS DOUBLE)" for k, v in L.HOST_TRUST.items()) + " ELSE CAST(0.4 AS DOUBLE) END"
_SHIFT_SQL = "CASE size " + " ".join(f"WHEN {_q(s)} THEN CASE category " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in t.items()) + " ELSE 0 END" for s, t in L.SIZE_PREFERENCE.items()) + " END"
_RELEVANCE_SQL = "CASE category " + " ".join(f"WHEN {_q(k)} THEN CAST({v} AS DOUBLE)" for k, v in L.RELEVANCE.items()) + " ELSE CAST(4 AS DOUBLE) END"
_SCORES_SQL = rf"""WITH {_TERMS_SQL}, sized AS (SELECT company_id, CASE WHEN size_hint IN ('small', 'medium', 'large') THEN size_hint ELSE 'medium' END AS size FROM companies),
tied AS (
  SELECT person_id, {_source_type('source_url', 'source_title')} AS kind, domain <> '' AND contains(lower({_b('source_url')}), domain) AS by_host,
    len(list_filter(terms, lambda t: contains(lower({_b('claim_value')} || ' ' || {_b('source_text')} || ' ' || {_b('source_url')}), t))) > 0 AS by_term,
    TRY_CAST(nullif(regexp_extract(CASE WHEN {_b('source_text')} <> '' THEN source_text ELSE {_b('claim_value')} END, '{_WORD_EDGE}(20[12][0-9])($|[^\p{{L}}\p{{N}}_])', 2), '') AS INTEGER) AS year,
    {_any(f"lower({_b('claim_value')})", L.ENDED_HINTS)} AS ended
  FROM evidence JOIN own USING (company_id) WHERE person_id IS NOT NULL
), items AS (
  SELECT person_id, avg(CASE WHEN by_host AND by_term THEN 30 WHEN by_host OR by_term THEN 18 ELSE 6 END) AS match, avg({_TRUST_SQL}) AS trust, count(*) AS n, max(year) AS newest, bool_or(ended) AS ended_claim FROM tied GROUP BY person_id
), base AS (
  SELECT p.company_id, person_id, p.name, {_ROLE_SQL} AS r, coalesce(match, 0.0) AS match, trust, coalesce(n, 0) AS n, newest, coalesce(size, 'medium') AS size, coalesce(is_current, true) AS current,
    {_b('current_company')} <> '' AND coalesce(len(list_filter(terms, lambda t: contains(lower({_b('current_company')}), t))) > 0, false) AS here,
    {_any(f"lower({_b('p.name')} || ' ' || {_b('title')} || ' ' || {_b('current_company')} || ' ' || {_b('location')})", L.ENDED_HINTS)} OR coalesce(ended_claim, false) AS ended
  FROM (SELECT *, {_NORM_TITLE} AS norm FROM people) p LEFT JOIN items USING (person_id) LEFT JOIN own ON own.company_id = p.company_id LEFT JOIN sized ON sized.company_id = p.company_id
), parts AS (
  SELECT *, r[1] AS category, CAST(r[2] AS INTEGER) AS authority FROM base
), scored AS (
  SELECT company_id, person_id, name, category AS role_category, round(least(30.0, CASE WHEN here THEN least(30.0, match + 6) ELSE match END), 1) AS company_match,
    round(CAST(greatest(0, least(25, CASE WHEN ended THEN CASE WHEN current THEN CAST(floor(authority * CAST(0.3 AS DOUBLE)) AS INTEGER) ELSE greatest(0, CAST(floor(authority * CAST(0.3 AS DOUBLE)) AS INTEGER) - 5) END ELSE authority END + {_SHIFT_SQL})) AS DOUBLE), 1) AS decision_authority,
    round({_RELEVANCE_SQL} * CASE WHEN current THEN CAST(1 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END, 1) AS role_relevance,
    CASE WHEN n > 0 THEN round(trust * 15 * (CAST(0.55 AS DOUBLE) + CAST(0.45 AS DOUBLE) * least(CAST(1 AS DOUBLE), n / CAST(3 AS DOUBLE))), 1) ELSE CAST(0 AS DOUBLE) END AS evidence_quality,
    CASE WHEN n = 0 THEN CAST(0 AS DOUBLE) WHEN newest IS NULL THEN CAST(4 AS DOUBLE) WHEN {AS_OF_YEAR} - newest <= 1 THEN 10 WHEN {AS_OF_YEAR} - newest = 2 THEN 8 WHEN {AS_OF_YEAR} - newest <= 4 THEN 6 ELSE 3 END AS evidence_recency
  FROM parts
), totals AS (SELECT *, round(company_match + decision_authority + role_relevance + evidence_quality + evidence_recency, 1) AS total FROM scored)"""


@query(_SCORES_SQL + " SELECT * FROM totals")
def person_scores(spark, folder):
    return people.score_people(table(spark, folder, "people"), table(spark, folder, "evidence"), table(spark, folder, "companies"), AS_OF_YEAR)


@query(_SCORES_SQL + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY total DESC, name NULLS FIRST, person_id) AS rank FROM totals) SELECT company_id, person_id, name, total, rank FROM ranked WHERE rank <= 8")
def top_people(spark, folder):
    return people.top_people(person_scores(spark, folder)).select("company_id", "person_id", "name", "total", "rank")


@query(
    rf"""SELECT person_id, round(least(CAST(0.98 AS DOUBLE), greatest(max(coalesce(confidence, 0) + CASE WHEN domain <> '' AND contains(lower({_b('source_url')}), domain) THEN CAST(0.15 AS DOUBLE) ELSE 0 END
  + CASE WHEN claim_type = 'person_title' AND {_b('source_text')} <> '' THEN CAST(0.1 AS DOUBLE) ELSE 0 END), 0) + least(CAST(0.15 AS DOUBLE), CAST(0.05 AS DOUBLE) * (count(*) - 1))), 2) AS confidence
FROM evidence JOIN (SELECT company_id, {_DOMAIN} AS domain FROM companies) USING (company_id) WHERE person_id IS NOT NULL GROUP BY person_id"""
)
def person_confidence(spark, folder):
    return people.person_confidence(table(spark, folder, "evidence"), table(spark, folder, "companies"))


# ---- hits -------------------------------------------------------------------------------------------

_HIT_SQL = rf"""WITH {_TERMS_SQL}, hits AS (
  SELECT evidence_id AS hit_id, company_id, {_host('source_url')} AS h, lower({_b('source_title')}) AS head, lower({_b('source_title')} || ' ' || {_b('source_text')}) AS blob, {_source_type('source_url', 'source_title')} AS source_type,
    CAST(1 + evidence_id % 20 AS INTEGER) AS position FROM evidence
), scored AS (
  SELECT company_id, hit_id, position, source_type, CASE WHEN h = '' OR h IN {_in(L.LOW_VALUE_HOSTS)} THEN CAST(0 AS DOUBLE) ELSE round(CAST(1 AS DOUBLE) + CASE WHEN {_any('h', L.HIGH_VALUE_HOSTS)} THEN 3 ELSE 0 END
    + len(list_filter(terms, lambda t: contains(blob, t))) * CAST(1.4 AS DOUBLE) + CASE WHEN {_site('h')} THEN CAST(1.2 AS DOUBLE) ELSE 0 END
    + CASE WHEN source_type IN ('company_website', 'registry', 'press_release', 'partner_announcement') THEN 1 ELSE 0 END + CASE WHEN source_type IN ('directory', 'job_board', 'forum', 'social_profile') THEN CAST(-1.5 AS DOUBLE) ELSE 0 END
    + CASE WHEN len(list_filter(terms, lambda t: starts_with(head, t))) > 0 THEN CAST(0.8 AS DOUBLE) ELSE 0 END + greatest(CAST(0 AS DOUBLE), CAST(1.5 AS DOUBLE) - position * CAST(0.1 AS DOUBLE)) + CASE WHEN ends_with(h, '.pdf') THEN CAST(-0.3 AS DOUBLE) ELSE 0 END, 2) END AS score
  FROM hits JOIN own USING (company_id)
)"""


@query(_HIT_SQL + " SELECT company_id, hit_id, source_type, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, position, hit_id) AS rank FROM scored) WHERE rank <= 12")
def hit_ranking(spark, folder):
    """Evidence as search hits: the twelve best of each company."""
    hits = table(spark, folder, "evidence").select(F.col("evidence_id").alias("hit_id"), "company_id", F.col("source_url").alias("url"), F.col("source_title").alias("title"), F.col("source_text").alias("snippet"), (1 + F.pmod("evidence_id", F.lit(20))).cast("int").alias("position"))
    return search.rank_hits(hits, table(spark, folder, "companies"))


# ---- texts ------------------------------------------------------------------------------------------

_PLAIN_AT = r"regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\s*(?:\(at\)|\[at\])\s*', '@', 'g'), '(?i)\s*(?:\(dot\)|\[dot\])\s*', '.', 'g')"


@query(rf"SELECT doc_id, CAST(unnest(range(len(m))) AS INTEGER) AS seq, unnest(m) AS email FROM (SELECT doc_id, regexp_extract_all({_PLAIN_AT}, {_q(r'(?:^|[^\p{L}\p{N}_.+-])(' + L.EMAIL + ')')}, 1) AS m FROM documents)")
def document_emails_raw(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(T.raw_emails(F.col("text"))).alias("seq", "email"))


def _mails_sql(junk: list[str]) -> str:
    """(doc_id, company_id, seq, email): usable addresses of every document, first seen first."""
    edge = _q("^[.,;:!?\"'<>()\\[\\]]+|[.,;:!?\"'<>()\\[\\]]+$")
    spoiled = f"OR {_any('e', junk)}" if junk else ""
    return rf"""SELECT doc_id, company_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(n)) - 1 AS seq, e AS email FROM (
  SELECT doc_id, company_id, n, e, string_split(e, '@')[1] AS l, string_split(e, '@')[-1] AS d FROM (
    SELECT doc_id, company_id, unnest(range(len(m))) AS n, lower(regexp_replace(trim(unnest(m), ' '), {edge}, '', 'g')) AS e
    FROM (SELECT doc_id, company_id, regexp_extract_all({_PLAIN_AT}, {_q(r'(?:^|[^\p{L}\p{N}_.+-])(' + L.EMAIL + ')')}, 1) AS m FROM documents)))
  WHERE NOT (contains(e, '..') OR NOT contains(e, '@') OR l = '' OR NOT contains(d, '.') OR regexp_matches(l, '^(www\.|http|ftp|smtp|mail\.)|://|[.\-_+]$') {spoiled} OR l IN {_in(L.GENERIC_LOCALS)} OR length(l) < 2 OR regexp_matches(replace(l, '.', ''), '^[0-9]+$'))
  GROUP BY doc_id, company_id, e"""


def _kind_sql(fit: str) -> str:
    """[kind, confidence] of an address e with local part l and domain d; fit: the first fit of a name, or null."""
    roles = " OR ".join(f"starts_with(l, {_q(r)})" for r in L.ROLE_LOCALS if len(r) > 4)
    return f"""CASE WHEN {fit} IS NOT NULL THEN ['direct', CAST({fit} AS VARCHAR)] WHEN d IN {_in(L.PERSONAL_PROVIDERS)} THEN ['direct', '0.5'] WHEN l IN {_in(L.ROLE_LOCALS)} OR {roles} THEN ['general', '0.7']
  WHEN length(string_split(l, '.')[1]) <= 2 AND contains(l, '.') THEN ['general', '0.6'] WHEN contains(l, '.') THEN ['direct', '0.45'] ELSE ['general', '0.4'] END"""


_NAME_WORDS = rf"list_filter(string_split_regex({_squeeze(r"regexp_replace(lower(coalesce(n, '')), '[^\p{L}\p{N}_\s]', ' ', 'g')")}, '[\s.]+'), lambda t: length(t) > 1)"
_FIT_SQL = """CASE WHEN len(w) = 0 THEN 0 WHEN l = w[1] OR l = array_to_string(w, '.') THEN 0.8 WHEN l = w[-1] OR l = w[-1] || '.' || w[1] THEN 0.75 WHEN l = w[1] || w[-1] OR l = w[-1] || w[1] THEN 0.6 WHEN len(list_filter(w, lambda x: NOT contains(l, x))) = 0 THEN 0.55 ELSE 0 END"""


@query(f"SELECT doc_id, email, k[1] AS kind, CAST(k[2] AS DOUBLE) AS confidence FROM (SELECT doc_id, email, {_kind_sql('NULL')} AS k FROM (SELECT *, string_split(email, '@')[1] AS l, string_split(email, '@')[-1] AS d FROM ({_mails_sql(L.EMAIL_JUNK)})))")
def document_email_kinds(spark, folder):
    """Usable addresses, and whether they are a person's or a role's."""
    found = contacts.text_emails(table(spark, folder, "documents"))
    return found.select("doc_id", "email", T.email_kind(F.col("email"), F.array().cast("array<string>")).alias("k")).select("doc_id", "email", "k.kind", "k.confidence")


# A number's neighbours are no word characters or dots; signs that can't stand inside one are doubled, so that two numbers may share a neighbour.
_PHONES_SQL = rf"""SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY rank, line, k) AS place, digits FROM (
  SELECT doc_id, line, rank, k, regexp_replace({_squeeze('raw')}, '^[ .-]+|[ .-]+$', '', 'g') AS raw, regexp_replace(raw, '[^0-9]', '', 'g') AS digits FROM (
    SELECT doc_id, line, rank, unnest(range(len(m))) AS k, trim(unnest(m), ' ') AS raw FROM (
      SELECT doc_id, line, CASE WHEN regexp_matches(t, {_q(L.PHONE_LABEL)}) THEN 0 ELSE 2 END AS rank,
        regexp_extract_all(regexp_replace(t, '([^\w\s().+\-])', '\1\1', 'g'), '(?:^|[^\w.])((?:\+|00)?\d[\d\s().\-]{{6,18}}\d)(?:[^\w.]|$)', 1) AS m
      FROM (SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS t FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\r]') AS l FROM documents)))))
  WHERE length(digits) BETWEEN 7 AND 15 AND NOT (NOT regexp_matches(raw, '[\s().\-+]') AND length(digits) > 11) AND NOT regexp_matches(digits, '^20[0-9]{{6,}}$') AND replace(digits, digits[1], '') <> ''"""
_PHONE_LIST_SQL = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(place)) - 1 AS seq, arg_min(raw, place) AS phone FROM ({_PHONES_SQL}) GROUP BY doc_id, digits"


@query(f"SELECT doc_id, CAST(seq AS INTEGER) AS seq, phone FROM ({_PHONE_LIST_SQL})")
def document_phones(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(T.phones(F.col("text"), None)).alias("seq", "phone"))


# Java's word characters in RE2; a name begins where no word character stands before it. Signs that no name holds, and spaces, are doubled, so that names may share a neighbour.
_W = r"[\p{L}\p{M}\p{N}\p{Pc}]"
_LATIN_SQL = L.LATIN_LEGAL.removeprefix(r"(?U)\b").removesuffix("(?![A-Za-z0-9])").replace(r"[\w&'’\-\.]", r"[\p{L}\p{M}\p{N}\p{Pc}&'’\-\.]").replace(r"\s", r"[\t-\r\x{85}\p{Z}]")
_TRIM_SIGNS = "'^[ ,.;]+|[ ,.;]+$', '', 'g'"
_LEGAL_SQL = rf"""SELECT doc_id, name, min(place) AS place FROM (
  SELECT doc_id, place, regexp_replace(array_to_string(w[list_max(list_transform(w, lambda t, i: CASE WHEN regexp_replace(lower(t), '^[.,]+|[.,]+$', '', 'g') IN {_in(L.GENERIC_LOCALS)} THEN i ELSE 0 END)) + 1 :], ' '), {_TRIM_SIGNS}) AS name FROM (
    SELECT doc_id, place, string_split(n, ' ') AS w FROM (
      SELECT doc_id, unnest(range(len(ns))) AS place, unnest(ns) AS n FROM (
        SELECT doc_id, list_concat(regexp_extract_all(t, {_q(f'({L.JP_LEGAL})')}, 1), regexp_extract_all(t, {_q(f'({L.CN_LEGAL})')}, 1),
          list_filter(list_transform(regexp_extract_all(t, {_q(rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])({_LATIN_SQL})(?:[^A-Za-z0-9]|$)")}, 1), lambda x: regexp_replace({_squeeze('x')}, {_TRIM_SIGNS})),
            lambda x: length(x) BETWEEN 2 AND 70 AND contains(x, ' ') AND len(list_filter(string_split(x, ' '), lambda v: lower(v) NOT IN {_in(L.GENERIC_LOCALS)})) > 0)) AS ns
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), {_q(r"([^\p{L}\p{M}\p{N}\p{Pc}&'’.\-])")}, '\1\1', 'g') AS t FROM documents)))))
  WHERE name <> '' GROUP BY doc_id, name"""


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS seq, name FROM ({_LEGAL_SQL})")
def document_legal_names(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(T.legal_names(F.col("text"))).alias("seq", "name"))


def _distinct(items: str) -> str:
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def _distinctive(c: str) -> str:
    return rf"list_filter(string_split_regex(lower({_b(c)}), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 3 AND t NOT IN {_in(L.LEGAL_NOISE)})"


_CLEAN_NAME_SQL = _squeeze(rf"regexp_replace(replace({_b('company_name')}, chr(160), ' '), '[?\x{{FFFD}}\x{{0}}-\x{{1F}}]', ' ', 'g')")


@query(
    rf"""WITH target AS (SELECT company_id, {_CLEAN_NAME_SQL} AS canonical, list_concat({_distinctive('company_name')}, {_distinctive('domain')}, list_filter(string_split_regex(lower({_b('domain')}), '[.\-]'), lambda t: length(t) >= 3)) AS words FROM companies),
found AS (SELECT company_id, n.name, min((doc_id, place)) AS place FROM ({_LEGAL_SQL}) n JOIN documents USING (doc_id) JOIN target USING (company_id) WHERE list_has_any({_distinctive('n.name')}, words) GROUP BY company_id, n.name),
best AS (SELECT company_id, first(name ORDER BY length(name) DESC, place) AS legal, count(*) AS spellings FROM found GROUP BY company_id)
SELECT company_id, canonical AS canonical_name, coalesce(legal, '') AS legal_name, coalesce(spellings, 0) AS spellings, CASE WHEN lower(legal) <> lower(canonical) THEN 'brand' ELSE 'unknown' END AS product_or_company,
  CASE WHEN lower(legal) <> lower(canonical) THEN CAST(0.55 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS confidence FROM target LEFT JOIN best USING (company_id)"""
)
def company_identity(spark, folder):
    """Legal names found in each company's documents."""
    return identity.resolve(table(spark, folder, "documents"), table(spark, folder, "companies"))


def _code_sql(kind: str, pattern: str) -> str:
    """Edges of words by their neighbours. A bare number may share one with the next: signs are doubled where none can stand inside a code."""
    flags, rest = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    edged = flags + re.sub(r"\\b$", r"(?:[^\\p{L}\\p{N}_]|$)", re.sub(r"^\\b", r"(?:^|[^\\p{L}\\p{N}_])", rest))
    text = r"regexp_replace(coalesce(text, ''), '([^\p{L}\p{N}_])', '\1\1', 'g')" if rest.startswith(r"\b([") else "coalesce(text, '')"
    return f"SELECT doc_id, {_q(kind)} AS kind, unnest(regexp_extract_all({text}, {_q(edged)}, 1)) AS value FROM documents"


@query("SELECT DISTINCT doc_id, kind, trim(value, ' ') AS value FROM (" + " UNION ALL ".join(_code_sql(k, p) for k, p in L.REGISTRY_CODES) + ")")
def document_registry_codes(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.explode(T.registry_codes(F.col("text"), None)).alias("c")).select("doc_id", "c.kind", "c.value")


# "(?U)" makes Java's classes Unicode ones; an address begins where no word character stands before it and ends where none follows.
_ADDRESS_FORMS = [
    rf"(?:^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])({L.LATIN_ADDRESS.removeprefix(r'(?U)\b').removesuffix(r'\b').replace(r'\w', r'\p{L}\p{M}\p{N}\p{Pc}').replace(r'\s', r'[\t-\r\x{85}\p{Z}]').replace(r'\d', r'\p{Nd}')})(?:[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]|$)",
    f"({L.JP_ADDRESS})",
    f"({L.CJK_ADDRESS})",
]
_EDGES = "'^[ ,;]+|[ ,;]+$', '', 'g'"
_ADDRESSES_SQL = rf"""WITH hinted AS (
  SELECT doc_id, n, coalesce({", ".join(f"regexp_extract_all(t, {_q(f)}, 1)[1]" for f in _ADDRESS_FORMS)}) AS a FROM (SELECT doc_id, unnest(range(len(l))) AS n, trim(unnest(l), ' ') AS t FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\r\n|[\n\r]') AS l FROM documents)) WHERE {_any('lower(t)', L.ADDRESS_HINTS)}
), lined AS (SELECT doc_id, n, regexp_replace(a, {_EDGES}) AS a FROM hinted WHERE a IS NOT NULL),
whole AS (SELECT doc_id, unnest(range(len(m))) AS n, regexp_replace(unnest(m), {_EDGES}) AS a FROM (SELECT doc_id, {"CASE " + " ".join(f"WHEN len(regexp_extract_all(t, {_q(_ADDRESS_FORMS[i])}, 1)) > 0 THEN regexp_extract_all(t, {_q(_ADDRESS_FORMS[i])}, 1)" for i in (1, 2, 0)) + " ELSE [] END"} AS m FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM lined))))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(n)) - 1 AS INTEGER) AS seq, a AS address FROM (SELECT * FROM lined UNION ALL SELECT * FROM whole) GROUP BY doc_id, a"""


@query(_ADDRESSES_SQL)
def document_addresses(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(T.addresses(F.col("text"), None, None, None)).alias("seq", "address"))


@query(
    r"""SELECT doc_id, CASE WHEN gate AND n >= 250 THEN 'large' WHEN gate AND n >= 25 THEN 'medium' WHEN regexp_matches(low, '\b(solo founder|one-person|2[- ]person|tiny team|small team|indie hacker)\b') THEN 'small'
  WHEN regexp_matches(low, '\b(series [a-e]\b|funding round|raised \$|unicorn|ipo|nasdaq|fortune 500)\b') THEN 'large' WHEN regexp_matches(low, '\b(saas platform|enterprise software|global team|offices in)\b') THEN 'medium' ELSE '' END AS size
FROM (SELECT doc_id, low, regexp_matches(low, '\b([0-9]{1,3})\s*[-+]?\s*(employees|staff|people)\b') AS gate, coalesce(TRY_CAST(regexp_extract(low, '\b([0-9]{1,4})\s*[-+]?\s*(employees|staff|people)\b', 1) AS INTEGER), 0) AS n FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents))"""
)
def size_hints(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.size_hint(F.col("text")).alias("size"))


@query("SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text")
def distinct_documents(spark, folder):
    """The first document of every text, with the number of copies. Texts are grouped by a hash of 256 bits and fetched for the first documents only."""
    docs = table(spark, folder, "documents").filter("text IS NOT NULL")
    first = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return docs.select("doc_id", "text").join(first.select("doc_id", "copies"), "doc_id").select("text", "doc_id", "copies")


# ---- contacts ---------------------------------------------------------------------------------------


def _names(spark, folder):
    ranked = top_people(spark, folder)
    # At most eight names a company.
    return ranked.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))


_CANDIDATES_SQL = rf"""{_SCORES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY total DESC, name NULLS FIRST, person_id) AS rank FROM totals),
named AS (SELECT company_id, rank, {_NAME_WORDS.replace("coalesce(n,", "coalesce(name,")} AS w FROM ranked WHERE rank <= 8), sites AS (SELECT company_id, {_DOMAIN} AS domain FROM companies),
mails AS (SELECT m.*, domain, string_split(email, '@')[1] AS l, string_split(email, '@')[-1] AS d FROM ({_mails_sql([])}) m JOIN sites USING (company_id)),
fits AS (SELECT doc_id, email, arg_min(fit, rank) AS fit FROM (SELECT doc_id, email, rank, {_FIT_SQL} AS fit FROM mails JOIN named USING (company_id)) WHERE fit > 0 GROUP BY doc_id, email),
kinds AS (SELECT *, domain <> '' AND (d = domain OR ends_with(d, '.' || domain)) AS official, {_kind_sql("fit")} AS k FROM mails LEFT JOIN fits USING (doc_id, email)),
sightings AS (
  SELECT company_id, k[1] || '_email' AS kind, email AS value, doc_id, seq, round(CASE WHEN k[1] = 'direct' THEN CASE WHEN official THEN least(CAST(0.95 AS DOUBLE), CAST(k[2] AS DOUBLE) + CAST(0.2 AS DOUBLE)) ELSE least(CAST(k[2] AS DOUBLE), CAST(0.5 AS DOUBLE)) END ELSE least(CAST(0.95 AS DOUBLE), CAST(k[2] AS DOUBLE) + CAST(0.2 AS DOUBLE)) END, 2) AS confidence
  FROM kinds WHERE official OR k[1] = 'direct'
  UNION ALL SELECT company_id, 'phone', phone, doc_id, seq, CAST(0.5 AS DOUBLE) FROM ({_PHONE_LIST_SQL}) JOIN documents USING (doc_id) JOIN sites USING (company_id)
  UNION ALL SELECT company_id, 'other', 'WeChat: ' || id, doc_id, 0, CAST(0.6 AS DOUBLE) FROM (SELECT doc_id, company_id, regexp_extract({_b('text')}, {_q(L.WECHAT)}, 1) AS id FROM documents) JOIN sites USING (company_id) WHERE id <> ''
), candidates AS (
  SELECT company_id, kind, first(value ORDER BY doc_id, seq) AS value, first(confidence ORDER BY doc_id, seq) AS confidence, min((doc_id, seq)) AS place FROM sightings GROUP BY company_id, kind, lower(value)
)"""


@query(_CANDIDATES_SQL + " SELECT company_id, kind, value, confidence, place[1] AS doc_id, CAST(place[2] AS INTEGER) AS seq FROM candidates")
def contact_candidates(spark, folder):
    return contacts.candidates(table(spark, folder, "documents"), table(spark, folder, "companies"), _names(spark, folder), junk=[])


@query(_CANDIDATES_SQL + " SELECT company_id, kind, first(value ORDER BY confidence DESC, place, value) AS value, max(confidence) AS confidence FROM candidates GROUP BY company_id, kind")
def contact_choice(spark, folder):
    return contacts.choose(contact_candidates(spark, folder))


def _patterns(spark, folder):
    own = table(spark, folder, "companies").select("company_id", F.regexp_replace(F.lower(T.blank(F.col("domain"))), r"^www\.", "").alias("d"))
    mails = contacts.text_emails(table(spark, folder, "documents"), junk=[]).join(own, "company_id").filter("d <> ''")
    at = F.substring_index("email", "@", -1)
    official = mails.filter((at == F.col("d")) | F.endswith(at, F.concat(F.lit("."), "d")))
    return contacts.email_pattern(official.groupBy("company_id", "email").agg(F.min(F.struct(F.col("doc_id").alias("id"), "seq")).alias("place")))


_PATTERNS_SQL = rf"""WITH sites AS (SELECT company_id, {_DOMAIN} AS domain FROM companies),
official AS (SELECT company_id, email, string_split(email, '@')[1] AS l, min((doc_id, seq)) AS place FROM ({_mails_sql([])}) JOIN sites USING (company_id) WHERE domain <> '' AND (string_split(email, '@')[-1] = domain OR ends_with(string_split(email, '@')[-1], '.' || domain)) GROUP BY company_id, email),
shapes AS (SELECT company_id, CASE n WHEN 1 THEN 'first' WHEN 2 THEN 'first.last' ELSE 'f.last' END AS shape, count(*) AS c, min(place) AS place
  FROM (SELECT *, len(list_filter(string_split_regex(l, '[._-]'), lambda t: t <> '')) AS n FROM official WHERE l NOT IN {_in(L.PATTERN_LOCALS)}) WHERE n > 0 GROUP BY company_id, shape),
patterns AS (SELECT company_id, pattern, round(greatest(CAST(0 AS DOUBLE), CASE WHEN c = 1 THEN CAST(0.5 AS DOUBLE) ELSE least(CAST(0.85 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(0.12 AS DOUBLE) * c) END - CASE WHEN kinds > 1 THEN CAST(0.1 AS DOUBLE) ELSE 0 END), 2) AS confidence
  FROM (SELECT company_id, first(shape ORDER BY c DESC, place) AS pattern, max(c) AS c, count(*) AS kinds FROM shapes GROUP BY company_id))"""


@query(_PATTERNS_SQL + " SELECT company_id, pattern, confidence FROM patterns")
def email_patterns(spark, folder):
    return _patterns(spark, folder)


_ALL_WORDS = rf"list_filter(string_split_regex({_squeeze(r"regexp_replace(lower(coalesce(name, '')), '[^\p{L}\p{N}_\s]', ' ', 'g')")}, '[\s.]+'), lambda t: t <> '')"


@query(
    _PATTERNS_SQL + rf""" SELECT person_id, CASE pattern WHEN 'first.last' THEN w[1] || '.' || w[-1] WHEN 'f.last' THEN w[1][1] || '.' || w[-1] ELSE w[1] END || '@' || domain AS email, round(least(CAST(0.55 AS DOUBLE), confidence * CAST(0.6 AS DOUBLE)), 2) AS confidence
FROM (SELECT person_id, company_id, {_ALL_WORDS} AS w FROM people) JOIN patterns USING (company_id) JOIN sites USING (company_id) WHERE len(w) >= 2 AND domain <> ''"""
)
def inferred_emails(spark, folder):
    return contacts.inferred_emails(table(spark, folder, "people"), _patterns(spark, folder), table(spark, folder, "companies"))


# ---- stores and budgets -----------------------------------------------------------------------------

_TTL_SQL = """WITH cache AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY user_id, event_type), probes AS (SELECT DISTINCT user_id, event_type FROM events)"""


@query(
    "WITH log AS (SELECT substr(sha256('lf1:' || event_type || user_id), 1, 32) AS key, ts, value, event_id FROM events), cache AS (SELECT key, max(ts) AS fetched_at, first(value ORDER BY ts DESC, event_id DESC) AS value FROM log GROUP BY key) "
    "SELECT key, CASE WHEN fetched_at >= TIMESTAMP '2024-01-31' - INTERVAL 336 HOUR THEN value END AS value, fetched_at >= TIMESTAMP '2024-01-31' - INTERVAL 336 HOUR AS hit FROM cache"
)
def cache_fresh_reads(spark, folder):
    """Events as a cache log: what a read at 2024-01-31 finds within 336 hours."""
    log = table(spark, folder, "events").select(stores.cache_key(F.concat("event_type", F.col("user_id").cast("string"))).alias("key"), F.col("ts").alias("fetched_at"), "event_id", "value")
    cache = log.groupBy("key").agg(F.max_by(F.struct("fetched_at", "value"), F.struct("fetched_at", "event_id")).alias("r")).select("key", "r.*")
    return stores.fresh_reads(log.select("key").distinct(), cache, "key", "fetched_at", "2024-01-31", 336).select("key", "value", "hit")


@query(
    "SELECT user_id, event_type, max(ts) AS ts, first(value ORDER BY ts DESC, event_id DESC) AS value, min(event_id) AS event_id FROM events GROUP BY user_id, event_type"
)
def cache_upsert(spark, folder):
    """Even events stored, odd ones upserted by (user, type): the latest wins, the first id stays."""
    rows = table(spark, folder, "events").select("user_id", "event_type", "ts", "value", "event_id")
    even, odd = rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")
    key = ["user_id", "event_type"]
    both = even.unionByName(odd)
    newest = both.groupBy(*key).agg(F.max_by(F.struct("ts", "value"), F.struct("ts", "event_id")).alias("r"), F.min("event_id").alias("event_id"))
    return newest.select(*key, "r.ts", "r.value", "event_id")


@query(
    """WITH people_kept AS (SELECT company_id, name, min(person_id) AS person_id FROM people GROUP BY company_id, name), versions AS (SELECT company_id, name, min(version_id) AS version_id FROM person_versions GROUP BY company_id, name)
SELECT company_id, name, person_id AS id, 'people' AS origin FROM people_kept
UNION ALL SELECT company_id, name, version_id, 'versions' FROM versions v WHERE NOT EXISTS (SELECT 1 FROM people_kept p WHERE p.company_id IS NOT DISTINCT FROM v.company_id AND p.name IS NOT DISTINCT FROM v.name)"""
)
def insert_ignore(spark, folder):
    """People by (company, name), and of the versions those that they lack."""
    stored = table(spark, folder, "people").groupBy("company_id", "name").agg(F.min("person_id").alias("id")).withColumn("origin", F.lit("people"))
    new = table(spark, folder, "person_versions").select("company_id", "name", F.col("version_id").alias("id"), F.lit("versions").alias("origin"))
    return stores.insert_ignore(stored, new, ["company_id", "name"], "id")


@query("SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 20")
def budget_running_cap(spark, folder):
    """Events as queries of users: the first twenty of each."""
    return stores.within_budget(table(spark, folder, "events"), "user_id", ["ts", "event_id"], 20).select("user_id", "event_id", "n")


# ---- figures ----------------------------------------------------------------------------------------

_CATEGORIES = [c for c, _, _ in L.ROLE_TIERS] + ["unknown"]


@query(f"WITH r AS (SELECT {_ROLE_SQL.replace('norm', _NORM_TITLE)} AS r FROM people), c AS (SELECT unnest({_list(_CATEGORIES)}) AS category) SELECT category, coalesce(n, 0) AS rows, CASE WHEN (SELECT count(*) FROM r) > 0 THEN round(100.0::DOUBLE * coalesce(n, 0) / (SELECT count(*) FROM r), 1) ELSE 0 END AS share FROM c LEFT JOIN (SELECT r[1] AS category, count(*) AS n FROM r GROUP BY 1) USING (category)")
def role_histogram(spark, folder):
    """People by role category, empty categories included."""
    roles = table(spark, folder, "people").select(T.role(F.col("title"))["category"].alias("category"))
    return metrics.histogram(roles, "category", _CATEGORIES)


@query(
    f"""WITH n AS (SELECT company_id, count(*) AS people, count(*) FILTER (r[1] IN {_in(['founder', 'owner', 'chief_executive', 'chief_operating', 'executive', 'senior_leader', 'commercial_leader'])} AND coalesce(is_current, true)) AS deciders FROM (SELECT company_id, is_current, {_ROLE_SQL.replace('norm', _NORM_TITLE)} AS r FROM people) GROUP BY company_id)
SELECT count(*) AS companies, round(100.0::DOUBLE * count(*) FILTER (coalesce(people, 0) >= 1) / count(*), 1) AS with_person, round(100.0::DOUBLE * count(*) FILTER (coalesce(deciders, 0) >= 1) / count(*), 1) AS with_decider, round(100.0::DOUBLE * count(*) FILTER (coalesce(deciders, 0) >= 2) / count(*), 1) AS with_two,
  round(avg(coalesce(people, 0)), 2) AS mean_people, round(median(coalesce(people, 0)), 2) AS median_people, round(100.0::DOUBLE * count(*) FILTER (confidence >= 0.5) / count(*), 1) AS resolved FROM companies LEFT JOIN n USING (company_id)"""
)
def headline_rates(spark, folder):
    """Shares of companies with people and decision makers, mean and median number of people."""
    role = T.role(F.col("title"))["category"]
    decides = role.isin("founder", "owner", "chief_executive", "chief_operating", "executive", "senior_leader", "commercial_leader") & F.coalesce("is_current", F.lit(True))
    n = table(spark, folder, "people").groupBy("company_id").agg(F.count(F.lit(1)).alias("people"), F.count_if(decides).alias("deciders"))
    rows = table(spark, folder, "companies").join(n, "company_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("people", "deciders")})
    whole = F.count(F.lit(1))
    return rows.agg(
        whole.alias("companies"),
        metrics.percent(F.count_if(F.col("people") >= 1), whole).alias("with_person"),
        metrics.percent(F.count_if(F.col("deciders") >= 1), whole).alias("with_decider"),
        metrics.percent(F.count_if(F.col("deciders") >= 2), whole).alias("with_two"),
        metrics.mean(F.col("people")).alias("mean_people"),
        metrics.median(F.col("people")).alias("median_people"),
        metrics.percent(F.count_if(F.col("confidence") >= 0.5), whole).alias("resolved"),
    )


@query(
    """WITH inputs AS (SELECT lower(domain) AS domain, max(row_index) AS row_index FROM companies GROUP BY lower(domain)), found AS (SELECT lower(c.domain) AS domain, count(DISTINCT p.person_id) AS people FROM companies c JOIN people p USING (company_id) GROUP BY lower(c.domain)),
base AS (SELECT lower(c.domain) AS domain, count(DISTINCT v.person_key) AS people FROM companies c JOIN person_versions v USING (company_id) GROUP BY lower(c.domain))
SELECT count(*) AS inputs, count(*) FILTER (coalesce(f.people, 0) > 0) AS ours, count(*) FILTER (coalesce(b.people, 0) > 0) AS theirs, count(*) FILTER (coalesce(f.people, 0) > 0 AND coalesce(b.people, 0) > 0) AS both_have, count(*) FILTER (coalesce(f.people, 0) > 0 AND coalesce(b.people, 0) = 0) AS ours_only,
  count(*) FILTER (coalesce(f.people, 0) = 0 AND coalesce(b.people, 0) > 0) AS theirs_only, CAST(coalesce(sum(f.people), 0) AS BIGINT) AS our_people, CAST(coalesce(sum(b.people), 0) AS BIGINT) AS their_people FROM inputs LEFT JOIN found f USING (domain) LEFT JOIN base b USING (domain)"""
)
def baseline_comparison(spark, folder):
    """People harvested against the persons of earlier runs, by domain; of repeated domains the last row counts."""
    companies = table(spark, folder, "companies")
    domain = F.lower("domain").alias("domain")
    inputs = metrics.last_by(companies.select(domain, "row_index"), ["domain"], "row_index")
    of = lambda name, key: companies.select("company_id", domain).join(table(spark, folder, name), "company_id").groupBy("domain").agg(F.count_distinct(key).alias(name))
    joined = inputs.join(of("people", "person_id"), "domain", "left").join(of("person_versions", "person_key"), "domain", "left")
    a, b = F.coalesce("people", F.lit(0)), F.coalesce("person_versions", F.lit(0))
    return joined.agg(F.count(F.lit(1)).alias("inputs"), F.count_if(a > 0).alias("ours"), F.count_if(b > 0).alias("theirs"), F.count_if((a > 0) & (b > 0)).alias("both_have"), F.count_if((a > 0) & (b == 0)).alias("ours_only"), F.count_if((a == 0) & (b > 0)).alias("theirs_only"), F.sum(a).alias("our_people"), F.sum(b).alias("their_people"))


@query("SELECT company_id, domain FROM companies c WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.company_id = c.company_id)")
def missing_inputs(spark, folder):
    """Companies without a page."""
    return table(spark, folder, "companies").join(table(spark, folder, "pages"), "company_id", "left_anti").select("company_id", "domain")
