"""More named queries: operators whose input no table holds ready-made get it by arithmetic and lists from whole tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge import lexicon as L
from claimforge.functions import html
from claimforge.functions import text as T
from claimforge.operators import contacts, facts, identity, metrics, people, search, selection
from claimforge.plans import catalog as C
from claimforge.plans.catalog import _b, _any, _DOMAIN, _host, _in, _list, _q, _squeeze, _unescaped, query, table
from claimforge.sources import responses
from claimforge.sources.tables import limited

_EDGE, _AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: The class of word characters that "(?U)" gives Java, for RE2.
_WORD = r"\p{L}\p{M}\p{N}\p{Pc}"


# ---- pieces of SQL ----------------------------------------------------------------------------------


def _is_title(c: str) -> str:
    return C._IS_TITLE_SQL.replace(_b("title"), _b(c))


_BARRED = sorted({*L.NOT_PERSON_TOKENS, *L.SUFFIX_TOKENS, *L.STACK_TOKENS, *L.ROLE_TOKENS, *L.PRODUCT_TOKENS})


def _is_name(c: str) -> str:
    v = f"trim({_b(c)}, ' ')"
    tokens = rf"list_filter(string_split_regex({v}, '[\s\-.’'']+'), lambda t: t <> '')"
    latin = rf"(len({tokens}) BETWEEN 2 AND 4 AND len(list_filter({tokens}, lambda t: regexp_replace(lower(t), '^[.,]+|[.,]+$', '', 'g') IN {_in(_BARRED)} OR NOT regexp_matches(t, '^\p{{Lu}}') OR length(t) > 18)) = 0)"
    return f"(length({v}) BETWEEN 3 AND 60 AND NOT regexp_matches({v}, '@|https?://|[0-9]{{3}}') AND CASE WHEN regexp_matches({v}, '^[゠-ヿ一-鿿㐀-䶿]+$') THEN length({v}) BETWEEN 2 AND 4 ELSE {latin} END)"


def _name_key(c: str) -> str:
    """The key of a name: see catalog._NAME_SQL."""
    words = C._NAME_SQL.split("SELECT *, ", 1)[1].split(" AS words FROM", 1)[0].replace(_b("name"), _b(c))
    return f"list_transform([{words}], lambda w: CASE len(w) WHEN 0 THEN '' WHEN 1 THEN w[1] ELSE w[-1] || '|' || substr(w[1], 1, 1) END)[1]"


def _name_words(c: str) -> str:
    return C._NAME_SQL.split("SELECT *, ", 1)[1].split(" AS words FROM", 1)[0].replace(_b("name"), _b(c))


def _clean_url(c: str) -> str:
    t = f"trim({_b(c)}, ' ')"
    return rf"regexp_replace(CASE WHEN {t} = '' OR regexp_matches({t}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN {t} ELSE 'https://' || {t} END, '#.*$', '')"


def _same_site(url: str, domain: str) -> str:
    h, d = _host(url), rf"regexp_replace(lower({_b(domain)}), '^www\.', '')"
    return f"({h} <> '' AND {d} <> '' AND ({h} = {d} OR ends_with({h}, '.' || {d}) OR ends_with({d}, '.' || {h})))"


def _worth(url: str) -> str:
    return f"(NOT regexp_matches({_b(url)}, {_q(L.LOW_VALUE_URL)}) AND {_host(url)} <> '' AND NOT contains({_host(url)}, 'play.google.com'))"


def _people_page(url: str) -> str:
    path = rf"regexp_extract({_b(url)}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
    return rf"(len(list_filter(string_split({path}, '/'), lambda s: list_contains({_list(L.PEOPLE_SEGMENTS)}, replace(regexp_replace(lower(trim(s)), '(\.html|\.htm|\.php|\.aspx)$', ''), '_', '-')))) > 0)"


# ---- people on pages and in snippets ----------------------------------------------------------------


@query(
    rf"""WITH cards AS (SELECT person_id AS page_id, person_id % 3 AS layout, {_squeeze(_b('name'))} AS n, {_squeeze(_b('title'))} AS t FROM people),
blocks AS (SELECT page_id, unnest(CASE WHEN layout = 2 THEN [n || ', ' || t] ELSE [n, t] END) AS b FROM cards),
pairs AS (
  SELECT page_id, n AS x, t AS y FROM cards WHERE layout < 2
  UNION ALL SELECT page_id, regexp_extract({_squeeze('b')}, '^(.{{3,60}}?)\s*[,，|–—:]\s*(.+)$', 1), regexp_extract({_squeeze('b')}, '^(.{{3,60}}?)\s*[,，|–—:]\s*(.+)$', 2) FROM blocks
  UNION ALL SELECT page_id, regexp_extract({_squeeze('b')}, '^(.{{3,60}}?)\s+-\s+(.+)$', 1), regexp_extract({_squeeze('b')}, '^(.{{3,60}}?)\s+-\s+(.+)$', 2) FROM blocks
), turned AS (SELECT page_id, x, y FROM pairs UNION ALL SELECT page_id, y, x FROM pairs)
SELECT page_id, min(trim(x, ' ')) AS name, min(trim(y, ' ')) AS title FROM turned WHERE x <> '' AND y <> '' AND {_is_name('x')} AND {_is_title('y')} GROUP BY page_id, lower(trim(x, ' ')), lower(trim(y, ' '))"""
)
def people_cards(spark, folder):
    """People read off cards made of the rows of people: table rows, headings with a paragraph, and "Name, Title" lines in turn."""
    n, t = facts.escaped(F.col("name")), facts.escaped(F.col("title"))
    kind = F.pmod("person_id", F.lit(3))
    row = F.concat(F.lit("<table><tr><td>"), n, F.lit("</td><td>"), t, F.lit("</td></tr></table>"))
    head = F.concat(F.lit("<h3>"), n, F.lit("</h3><p>"), t, F.lit("</p>"))
    line = F.concat(F.lit("<p>"), n, F.lit(", "), t, F.lit("</p>"))
    cards = table(spark, folder, "people").select(F.col("person_id").alias("page_id"), F.lit("https://a.example/team").alias("url"), F.lit("https://a.example/team").alias("final_url"), F.when(kind == 0, row).when(kind == 1, head).otherwise(line).alias("html"))
    return people.page_people(html.parse_pages(cards), inline_length=None)


_FORMS = [
    '<form action="/contact" id="contact-form"><input name="email"><textarea name="message"></textarea></form>',
    '<form action="/news" class="newsletter"><input name="email"><button>Subscribe</button></form>',
    '<form action="/search?q="><input name="comment email"></form>',
    '<form action="/login" id="login"><input name="email"><textarea name="message"></textarea></form>',
    '<form class="kontakt"><p>Rückruf</p><input name="phone"></form>',
    '<form action="https://forms.example/enquiry/"><input placeholder="your name"><input name="message"></form>',
    '<form action="reach/us"><p>tell us</p><select name="subject"></select></form>',
]


@query(
    f"""SELECT company_id AS page_id, CASE company_id % {len(_FORMS)} WHEN 0 THEN 'https://' || {_b('domain')} || '/contact' WHEN 4 THEN 'https://' || {_b('domain')} || '/about/page' WHEN 5 THEN 'https://forms.example/enquiry/' WHEN 6 THEN 'https://' || {_b('domain')} || '/about/reach/us' END AS url
FROM companies WHERE company_id % {len(_FORMS)} IN (0, 4, 5, 6)"""
)
def company_forms(spark, folder):
    """Where messages can be sent: one made page a company, with forms for contact, news, search and login in turn."""
    kind = F.pmod("company_id", F.lit(len(_FORMS)))
    source = F.get(T.strings(_FORMS), kind.cast("int"))
    url = F.concat(F.lit("https://"), T.blank(F.col("domain")), F.lit("/about/page"))
    pages = table(spark, folder, "companies").select(F.col("company_id").alias("page_id"), url.alias("url"), url.alias("final_url"), source.alias("html"))
    return contacts.contact_forms(html.parse_pages(pages, form_length=None))


_SNIPPET_NAME = r"[A-Z][\p{L}'’.-]+(?: [A-Z][\p{L}'’.-]+){1,3}"
_SNIPPET_PAIR = rf"({_SNIPPET_NAME})\s*[,|–—-]\s*([^,|.;\n]{{3,60}})"
_OPENERS_SQL = C._OPENERS_SQL
_ORDINARY = sorted({*_BARRED, *L.DEPARTMENTS})
_TITLE_WORDS = L.ATTRIBUTION.split(r"\b(?:", 1)[1].split(")", 1)[0]
_ATTRIBUTION_SQL = rf"(?i)(?:^|[^{_WORD}])(?:{_TITLE_WORDS})[^{_WORD}.!?;](?:[^.!?;]*?[^{_WORD}.!?;])??(?:of|at)[\t-\r\x{{85}}\p{{Z}}]+([{_WORD}’'&][{_WORD}’'&.\-]*(?:[\t-\r\x{{85}}\p{{Z}}-][{_WORD}’'&][{_WORD}’'&.\-]*){{1,3}})"
_EXPECTED = rf"list_filter(flatten(list_transform(terms, lambda t: string_split_regex(lower(t), '[^\p{{L}}\p{{N}}_]+'))), lambda t: length(t) >= 3 AND t NOT IN {_in(sorted(L.SUFFIX_TOKENS))})"
_ORG_PIECES = r"""list_filter(list_transform(string_split_regex(replace(org, '-', ' '), '\s+'), lambda t: regexp_replace(t, '^[.''’"]+|[.''’"]+$', '', 'g')), lambda t: t <> '')"""


@query(
    rf"""WITH {C._TERMS_SQL}, made AS (SELECT p.person_id AS hit_id, p.company_id, 'https://' || {_b('c.domain')} || '/team' AS url, {_b('p.name')} || ' - ' || {_b('p.title')} || '. ' || {_b('c.company_name')} AS text FROM people p JOIN companies c USING (company_id)),
near AS (SELECT hit_id, company_id, terms, text FROM made JOIN own USING (company_id) WHERE len(list_filter(terms, lambda t: contains(lower(url || ' ' || text), t))) > 0 AND NOT regexp_matches(url || ' ' || text, {_q(L.NOT_PEOPLE_SOURCE)})),
pairs AS (SELECT hit_id, company_id, terms, text, unnest(range(len(ns))) AS seq, trim(unnest(ns), ' ') AS name, trim(unnest(ts), ' ') AS title FROM (SELECT *, regexp_extract_all(text, {_q(_SNIPPET_PAIR)}, 1) AS ns, regexp_extract_all(text, {_q(_SNIPPET_PAIR)}, 2) AS ts FROM near)),
titled AS (SELECT *, regexp_extract(title, {_q(rf'(?i)((?:{_OPENERS_SQL}).*)$')}, 1) AS tail FROM pairs),
kept AS (SELECT *, {_EXPECTED} AS known FROM titled WHERE {_is_name('name')} AND ({_is_title('title')} OR (tail <> '' AND length(title) - length(tail) BETWEEN 2 AND 41 AND {_is_title('tail')}))),
tied AS (SELECT hit_id, seq, known, trim(unnest(regexp_extract_all(title || ' ' || text, {_q(_ATTRIBUTION_SQL)}, 1)), ' ') AS org FROM kept),
foreign_org AS (SELECT DISTINCT hit_id, seq FROM (SELECT *, {_ORG_PIECES} AS pieces, list_transform({_ORG_PIECES}, lambda t: lower(t)) AS low FROM tied)
  WHERE len(known) > 0 AND NOT (list_has_any(low, known) OR len(list_filter(known, lambda k: contains(lower(org), k))) > 0 OR org IN ('Board', 'Division', 'Operations', 'Product')) AND len(pieces) > 0
    AND (list_has_any(low, {_list(sorted(L.SUFFIX_TOKENS))}) OR (len(list_filter(low, lambda t: t NOT IN {_in(_ORDINARY)})) > 0 AND len(list_filter(pieces, lambda t: t = lower(t) AND t <> upper(t))) = 0))),
named AS (SELECT *, {_name_key('name')} AS name_key FROM kept WHERE (hit_id, seq) NOT IN (SELECT (hit_id, seq) FROM foreign_org))
SELECT company_id, name_key, first(name ORDER BY hit_id, seq) AS name, first(title ORDER BY hit_id, seq) AS title, min(hit_id) AS hit_id FROM named WHERE name_key <> '' GROUP BY company_id, name_key"""
)
def people_snippets(spark, folder):
    """People named in snippets made of the rows of people: "Name - Title. Company" on the company's team page."""
    own = table(spark, folder, "companies").select("company_id", "domain", "company_name")
    text = F.concat(T.blank(F.col("name")), F.lit(" - "), T.blank(F.col("title")), F.lit(". "), T.blank(F.col("company_name")))
    hits = table(spark, folder, "people").join(own, "company_id").select(F.col("person_id").alias("hit_id"), "company_id", F.concat(F.lit("https://"), T.blank(F.col("domain")), F.lit("/team")).alias("url"), text.alias("snippet"))
    return people.snippet_people(hits, table(spark, folder, "companies"))


_COPYRIGHT_SQL = L.COPYRIGHT.replace("(?iU)", "(?i)").replace(r"[\w&", rf"[{_WORD}&").replace(r"\s", r"[\t-\r\x{85}\p{Z}]")


@query(
    rf"""WITH made AS (SELECT company_id, CASE company_id % 4 WHEN 0 THEN 'Imprint' || chr(10) || '© ' || {_b('company_name')} || ', 2019' WHEN 1 THEN 'WeChat ID: wx_' || company_id || 'office' WHEN 2 THEN 'Copyright ' || {_b('legal_name')} || '. All rights reserved' ELSE {_b('company_name')} END AS t FROM companies),
found AS (SELECT company_id, regexp_extract(t, {_q(L.WECHAT)}, 1) AS wechat, regexp_replace({_squeeze(f"regexp_extract(t, {_q(_COPYRIGHT_SQL)}, 1)")}, '^[ .,;]+|[ .,;]+$', '', 'g') AS c FROM made)
SELECT company_id, wechat, CASE WHEN len(string_split(c, ' ')) > 6 OR length(c) > 60 THEN '' ELSE c END AS copyright FROM found"""
)
def imprint_facts(spark, folder):
    """Chat ids and copyright holders in imprints made of the companies."""
    kind, name = F.pmod("company_id", F.lit(4)), T.blank(F.col("company_name"))
    made = (
        F.when(kind == 0, F.concat(F.lit("Imprint\n© "), name, F.lit(", 2019")))
        .when(kind == 1, F.concat(F.lit("WeChat ID: wx_"), F.col("company_id").cast("string"), F.lit("office")))
        .when(kind == 2, F.concat(F.lit("Copyright "), T.blank(F.col("legal_name")), F.lit(". All rights reserved")))
        .otherwise(name)
    )
    return table(spark, folder, "companies").select("company_id", T.wechat(made).alias("wechat"), T.copyright_entity(made).alias("copyright"))


@query(
    rf"""WITH named AS (SELECT company_id, {_name_key('name')} AS k, min(person_id) AS person_id, count(*) AS harvested FROM people GROUP BY ALL), old AS (SELECT company_id, {_name_key('name')} AS k, count(DISTINCT person_key) AS persons FROM person_versions GROUP BY ALL)
SELECT company_id, k AS name_key, person_id, harvested, persons FROM named JOIN old USING (company_id, k) WHERE k <> ''"""
)
def people_in_both(spark, folder):
    """People harvested whose name key earlier runs have too, within the company."""
    key = T.person_key(F.col("name")).alias("name_key")
    now = table(spark, folder, "people").select("company_id", key, "person_id").groupBy("company_id", "name_key").agg(F.min("person_id").alias("person_id"), F.count(F.lit(1)).alias("harvested"))
    old = table(spark, folder, "person_versions").select("company_id", key, "person_key").groupBy("company_id", "name_key").agg(F.count_distinct("person_key").alias("persons"))
    return now.filter("name_key <> ''").join(old, ["company_id", "name_key"]).select("company_id", "name_key", "person_id", "harvested", "persons")


@query(
    rf"""WITH firsts AS (SELECT person_key, arg_min(name, version_id) FILTER (name IS NOT NULL) AS first_name FROM person_versions GROUP BY person_key),
both_names AS (SELECT version_id, {_name_key('name')} AS a, {_name_key('first_name')} AS b, list_filter({_name_words('name')}, lambda t: t NOT IN {_in(L.NAME_STOPWORDS)}) AS x, list_filter({_name_words('first_name')}, lambda t: t NOT IN {_in(L.NAME_STOPWORDS)}) AS y FROM person_versions JOIN firsts USING (person_key))
SELECT version_id, a <> '' AND b <> '' AND a <> b AND len(x) > 0 AND len(y) > 0 AND NOT list_has_any(x, y) AS conflict FROM both_names"""
)
def name_conflicts(spark, folder):
    """Whether the name of each version surely names another person than the first version of its group."""
    versions = table(spark, folder, "person_versions")
    first = versions.filter("name IS NOT NULL").groupBy("person_key").agg(F.min_by("name", "version_id").alias("first_name"))
    every = versions.select("person_key").distinct().join(first, "person_key", "left")
    return versions.join(every, "person_key").select("version_id", T.names_conflict(F.col("name"), F.col("first_name")).alias("conflict"))


@query(
    rf"""WITH t AS (SELECT e.evidence_id, {_b('e.source_text')} AS q, {_b('p.name')} AS n FROM evidence e JOIN people p USING (person_id)), placed AS (SELECT *, strpos(lower(q), lower(n)) AS i FROM t)
SELECT evidence_id, CASE WHEN n = '' OR i = 0 THEN '' ELSE {_squeeze("substr(q, greatest(0, i - 1 - 73) + 1, i - 1 + 220 - greatest(0, i - 1 - 73))")} END AS quote FROM placed"""
)
def evidence_quotes(spark, folder):
    """What stands around the person's name in the quotes that name them."""
    named = table(spark, folder, "people").select("person_id", "name")
    return table(spark, folder, "evidence").join(named, "person_id").select("evidence_id", T.quote_around(F.col("source_text"), F.col("name")).alias("quote"))


# ---- sources and selection --------------------------------------------------------------------------

_SUPPORTED_SQL = f"SELECT * FROM evidence e WHERE EXISTS (SELECT 1 FROM pages p WHERE p.company_id = e.company_id AND contains(coalesce(p.final_url, ''), {_b('e.source_url')}))"


def _known(spark, folder) -> DataFrame:
    return table(spark, folder, "pages").select("company_id", F.col("final_url").alias("url"))


@query(f"SELECT evidence_id, company_id FROM ({_SUPPORTED_SQL})")
def supported_evidence(spark, folder):
    """Claims whose source is a fetched page of the company or part of its address."""
    return selection.supported(table(spark, folder, "evidence"), _known(spark, folder)).select("evidence_id", "company_id")


@query(f"SELECT company_id, person_id, source_url, count(*) AS items, min(evidence_id) AS first_id FROM ({_SUPPORTED_SQL}) WHERE person_id IS NOT NULL GROUP BY company_id, person_id, source_url")
def supported_people(spark, folder):
    """People that supported claims name, with their sources."""
    return selection.supported_people(selection.supported(table(spark, folder, "evidence"), _known(spark, folder)))


@query("SELECT company_id, url, count(*) AS sightings FROM (SELECT company_id, final_url AS url FROM pages UNION ALL SELECT company_id, source_url FROM evidence) WHERE coalesce(url, '') <> '' GROUP BY company_id, url")
def allowed_urls(spark, folder):
    """What may be cited: pages fetched and addresses that snippets show, each once."""
    shown = table(spark, folder, "evidence").select("company_id", F.col("source_url").alias("url"))
    return _known(spark, folder).unionByName(shown).filter(T.blank(F.col("url")) != "").groupBy("company_id", "url").agg(F.count(F.lit(1)).alias("sightings"))


@query(f"SELECT company_id, url, arg_min(title, page_id) AS title, arg_min(kind, page_id) AS source_type FROM (SELECT company_id, page_id, coalesce(nullif({_b('final_url')}, ''), {_b('url')}) AS url, coalesce(nullif({_b('title')}, ''), nullif({_b('final_url')}, ''), {_b('url')}) AS title, {C._source_type("coalesce(nullif(final_url, ''), url)", 'title')} AS kind FROM pages WHERE coalesce(status_code >= 200 AND status_code < 400, false) AND {_b('error')} = '') GROUP BY company_id, url")
def page_sources(spark, folder):
    """The sources that usable pages are: each address once, its first fetch's title (or the address), its kind."""
    ok = F.coalesce((F.col("status_code") >= 200) & (F.col("status_code") < 400), F.lit(False)) & (T.blank(F.col("error")) == "")
    url = F.coalesce(F.nullif("final_url", F.lit("")), T.blank(F.col("url")))
    rows = table(spark, folder, "pages").filter(ok).select("company_id", "page_id", url.alias("u"), F.coalesce(F.nullif("title", F.lit("")), url).alias("title"), T.source_type(url, F.col("title")).alias("source_type"))
    return rows.groupBy("company_id", F.col("u").alias("url")).agg(F.min_by("title", "page_id").alias("title"), F.min_by("source_type", "page_id").alias("source_type"))


@query(f"SELECT page_id, {_clean_url('url')} AS clean_url, {_same_site('final_url', 'domain')} AS same_site, {_host('final_url')} <> '' AND {_host('final_url')} <> {_DOMAIN} AND NOT ({' OR '.join(f'ends_with({_host(chr(102) + 'inal_url')}, {_q(e)})' for e in L.UNFETCHED_ENDINGS)}) AS off_site FROM pages JOIN companies USING (company_id)")
def page_sites(spark, folder):
    """Every page's address made whole, and whether it lies on its company's site or off it."""
    own = table(spark, folder, "companies").select("company_id", "domain")
    url, domain = F.col("final_url"), F.col("domain")
    return table(spark, folder, "pages").join(own, "company_id").select("page_id", T.clean_url(F.col("url")).alias("clean_url"), T.same_site(url, domain).alias("same_site"), T.off_site(url, domain).alias("off_site"))


def _hits(spark, folder) -> DataFrame:
    return table(spark, folder, "evidence").select("company_id", F.col("claim_type").alias("query"), F.col("source_url").alias("url"), F.col("evidence_id").alias("place"))


_OFF_SITE = f"({_host('e.source_url')} <> '' AND {_host('e.source_url')} <> {_DOMAIN} AND NOT (" + " OR ".join(f"ends_with({_host('e.source_url')}, {_q(x)})" for x in L.UNFETCHED_ENDINGS) + f") AND {_worth('e.source_url')})"


@query(f"SELECT company_id, url, rank FROM (SELECT company_id, url, row_number() OVER (PARTITION BY company_id ORDER BY place, url) AS rank FROM (SELECT e.company_id, source_url AS url, min(evidence_id) AS place FROM evidence e JOIN companies USING (company_id) WHERE {_OFF_SITE} GROUP BY e.company_id, source_url)) WHERE rank <= 4")
def off_site_pages(spark, folder):
    """Evidence as search results: the first four pages a company off its site that would be fetched."""
    return selection.off_site_pages(_hits(spark, folder), table(spark, folder, "companies"))


@query(
    f"""SELECT company_id, url, row_number() OVER (PARTITION BY company_id ORDER BY place, url) AS rank FROM (SELECT e.company_id, source_url AS url, min(evidence_id) AS place FROM evidence e JOIN companies USING (company_id)
  WHERE {_people_page('e.source_url')} AND {_same_site('e.source_url', 'domain')} AND NOT regexp_matches({_b('e.source_url')} || ' ', {_q(L.NOT_PEOPLE_SOURCE)}) AND {_worth('e.source_url')} AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.company_id = e.company_id AND p.final_url = e.source_url) GROUP BY e.company_id, source_url)"""
)
def people_pages_to_fetch(spark, folder):
    """Team pages that evidence names on the company's own site and nobody fetched."""
    return selection.people_pages(_hits(spark, folder), table(spark, folder, "companies"), _known(spark, folder))


@query(f"SELECT company_id, query, url, rank FROM (SELECT company_id, claim_type AS query, source_url AS url, row_number() OVER (PARTITION BY company_id, claim_type ORDER BY evidence_id, source_url) AS rank FROM evidence WHERE {_b('source_url')} <> '') e WHERE rank <= 6 AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.company_id = e.company_id AND p.final_url = e.url)")
def unseen_results(spark, folder):
    """Of the first six results of every query (here: kind of claim) those that were not fetched."""
    return selection.unseen_results(_hits(spark, folder), _known(spark, folder))


_CLAMPED = "least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), coalesce(confidence, 0)))"


@query(
    rf"""WITH fetched AS (SELECT company_id, page_id, coalesce(final_url, url, '') AS url, {_b('title')} AS title, {_b('text')} AS text FROM pages),
cited AS (SELECT company_id, unnest(range(len(evidence_urls))) AS n, unnest(evidence_urls) AS url FROM companies),
firsts AS (SELECT company_id, arg_min(page_id, n) AS page_id, true AS cited FROM cited JOIN (SELECT company_id, url, max(page_id) AS page_id FROM fetched GROUP BY company_id, url) USING (company_id, url) GROUP BY company_id),
homes AS (SELECT company_id, min(page_id) AS page_id, false AS cited FROM fetched WHERE company_id NOT IN (SELECT company_id FROM firsts) GROUP BY company_id),
legal AS (SELECT page_id, name FROM ({C._LEGAL_SQL.replace('doc_id', 'page_id').replace('FROM documents', 'FROM pages')})),
based AS (SELECT c.company_id, f.url, f.title, f.text, cited, canonical_name, legal_name, country, language, domain, {_CLAMPED} AS sure, strpos(f.text, legal_name) AS spot, EXISTS (SELECT 1 FROM legal l WHERE l.page_id = f.page_id AND l.name = c.legal_name) AS stands
  FROM companies c JOIN (SELECT * FROM firsts UNION ALL SELECT * FROM homes) USING (company_id) JOIN (SELECT page_id, url, title, text FROM fetched) f USING (page_id)),
claims AS (
  SELECT company_id, 'company_name' AS claim_type, canonical_name AS claim_value, url, title, 'resolved canonical name for ' || {_b('domain')} AS q, sure FROM based WHERE cited
  UNION ALL SELECT company_id, 'legal_name', legal_name, url, title, CASE WHEN stands AND spot > 0 THEN substr(text, greatest(1, spot - 120), spot + 240 - greatest(1, spot - 120)) ELSE substr(text, 1, 300) END, sure FROM based WHERE cited
  UNION ALL SELECT company_id, 'country', country, url, title, 'country per resolved identity (' || coalesce(nullif(language, ''), 'n/a') || ')', sure * CAST(0.8 AS DOUBLE) FROM based WHERE cited
  UNION ALL SELECT company_id, 'domain', domain, url, title, substr(text, 1, 200), CAST(0.5 AS DOUBLE) FROM based WHERE NOT cited)
SELECT company_id, claim_type, claim_value, url AS source_url, title AS source_title, substr(regexp_replace(q, '[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'), 1, 600) AS source_text, round(sure, 2) AS confidence FROM claims WHERE {_b('claim_value')} <> ''"""
)
def identity_evidence(spark, folder):
    """What backs the identity of every company that has pages."""
    return selection.identity_evidence(table(spark, folder, "companies"), table(spark, folder, "pages"))


_LANGUAGE_NAMES = rf"list_filter(list_concat([canonical_name, legal_name, domain], coalesce(aliases, []), terms), lambda n: {_b('n')} <> '')"
_BRAND_WORDS = rf"list_filter(flatten(list_transform(list_filter(list_concat([canonical_name, domain], coalesce(aliases, [])), lambda n: {_b('n')} <> ''), lambda t: string_split_regex(lower(t), '[^\p{{L}}\p{{N}}_]+'))), lambda w: length(w) >= 3 AND w NOT IN {_in(sorted(L.SUFFIX_TOKENS))})"


@query(rf"WITH {C._TERMS_SQL} SELECT company_id, list_sort(list_distinct({_BRAND_WORDS})) AS brand, {C._distinct(_LANGUAGE_NAMES)} AS names FROM (SELECT c.company_id, canonical_name, legal_name, c.domain, aliases, terms FROM companies c JOIN own USING (company_id))")
def identity_names(spark, folder):
    """The distinctive words and every spelling of each company."""
    companies = table(spark, folder, "companies")
    terms = people.company_words(companies).select("company_id", "terms")
    named = T.identity_names(*[F.col(c) for c in ("canonical_name", "legal_name", "domain", "aliases", "terms")])
    return companies.join(terms, "company_id").select("company_id", named.alias("i")).select("company_id", "i.brand", "i.names")


# ---- texts ------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {_any(f"lower(substr(trim({_b('text')}, ' '), 1, 4000))", L.BOT_WALL)} OR length(trim({_b('text')}, ' ')) < 80 AS wall FROM pages")
def bot_walls(spark, folder):
    """Pages that are walls against robots, or nearly empty."""
    return table(spark, folder, "pages").select("page_id", T.bot_wall(F.col("text")).alias("wall"))


@query(rf"SELECT doc_id, CASE WHEN length(t) <= 400 THEN t ELSE substr(t, 1, 200) || chr(10) || '...[truncated]...' || chr(10) || right(t, 200) END AS clipped FROM (SELECT doc_id, regexp_replace({_b('text')}, '^[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+|[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g') AS t FROM documents)")
def clipped_documents(spark, folder):
    """The beginning and end of every long text, as prompts show them."""
    return table(spark, folder, "documents").select("doc_id", T.clip(F.col("text"), 400).alias("clipped"))


@query(
    rf"""SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace({C._BARE_HTML}, '(?is)<title[^>]*>.*?</title>', '', 'g'), '(?is)<!--.*?-->', '', 'g'), '(?i)</?({C._INLINE_TAGS})(\s[^>]*)?/?>', '', 'g'), '<[^>]*>'), lambda x: {_squeeze(_unescaped('x'))}), lambda x: x <> ''), chr(10)) AS text FROM pages"""
)
def page_texts(spark, folder):
    """The visible text of every page's HTML, a line a block."""
    return html.parse_pages(table(spark, folder, "pages")).select("page_id", "text")


# ---- figures and reports ----------------------------------------------------------------------------

_STATUSES = ["COMPLETED", "FAILED_DOMAIN", "FAILED_ENTITY_RESOLUTION", "FAILED_PERSON_DISCOVERY", "FAILED_CONTACT_DISCOVERY", "ERROR", "PARTIAL"]
_OWN_CATEGORIES = ["", "", "person failure", "blocked by the host"]
_GRADES = ["A", "B", "C", "D", "E", "FAIL"]


def _results(spark, folder) -> DataFrame:
    """Results of a batch, made of the companies by arithmetic."""
    pick = lambda values, shift: F.get(T.strings(values), F.pmod(F.col("company_id") + shift, F.lit(len(values))).cast("int"))
    return table(spark, folder, "companies").select("company_id", "company_name", "domain", "canonical_name", "legal_name", "country", pick(_GRADES, 0).alias("lead_grade"), pick(_STATUSES, 1).alias("status"), F.nullif(pick(_OWN_CATEGORIES, 2), F.lit("")).alias("failure_category"))


_RESULTS_SQL = "SELECT company_id, company_name, domain, canonical_name, legal_name, country, " + ", ".join(f"{_list(v)}[CAST((company_id + {shift}) % {len(v)} AS INTEGER) + 1] AS {name}" for v, shift, name in ((_GRADES, 0, "lead_grade"), (_STATUSES, 1, "status"), (_OWN_CATEGORIES, 2, "failure_category"))) + " FROM companies"
_OF_STATUS = "CASE status " + " ".join(f"WHEN {_q(s)} THEN {_q(c)}" for s, c in L.STATUS_CATEGORY.items()) + " ELSE 'insufficient evidence' END"


@query(
    f"""WITH n AS (SELECT coalesce(nullif(failure_category, ''), {_OF_STATUS}) AS category, count(*) AS results FROM ({_RESULTS_SQL}) WHERE lead_grade NOT IN ('A', 'B', 'C', 'D', 'E') GROUP BY 1), known AS (SELECT unnest({_list(L.FAILURE_CATEGORIES)}) AS category, unnest(range({len(L.FAILURE_CATEGORIES)})) AS place)
SELECT category, coalesce(results, 0) AS results, CAST(coalesce(place, {len(L.FAILURE_CATEGORIES)}) AS INTEGER) AS place FROM known FULL JOIN n USING (category)"""
)
def failure_categories(spark, folder):
    return metrics.failures(_results(spark, folder))


@query(f"SELECT status, count(*) AS results FROM ({_RESULTS_SQL}) GROUP BY status")
def status_counts(spark, folder):
    return _results(spark, folder).groupBy("status").agg(F.count(F.lit(1)).alias("results"))


@query("SELECT person_id, count(DISTINCT source_url) AS sources, count(*) AS items FROM evidence WHERE person_id IS NOT NULL GROUP BY person_id")
def source_counts(spark, folder):
    """Different sources of every person."""
    return table(spark, folder, "evidence").filter("person_id IS NOT NULL").groupBy("person_id").agg(F.count_distinct("source_url").alias("sources"), F.count(F.lit(1)).alias("items"))


@query(
    f"""WITH {C._QUERIES_SQL}, q AS (SELECT company_id, count(*) AS searches FROM initial GROUP BY company_id), p AS (SELECT company_id, count(*) AS pages, count(DISTINCT final_url) AS distinct_pages FROM pages GROUP BY company_id), e AS (SELECT company_id, count(*) AS items FROM evidence GROUP BY company_id)
SELECT company_id, coalesce(searches, 0) AS searches, coalesce(pages, 0) AS pages, coalesce(distinct_pages, 0) AS distinct_pages, coalesce(items, 0) AS items FROM companies LEFT JOIN q USING (company_id) LEFT JOIN p USING (company_id) LEFT JOIN e USING (company_id)"""
)
def company_counters(spark, folder):
    """Searches, fetches and evidence of every company."""
    companies = table(spark, folder, "companies")
    searches = search.initial_queries(companies).groupBy("company_id").agg(F.count(F.lit(1)).alias("searches"))
    pages = table(spark, folder, "pages").groupBy("company_id").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("final_url").alias("distinct_pages"))
    items = table(spark, folder, "evidence").groupBy("company_id").agg(F.count(F.lit(1)).alias("items"))
    joined = companies.select("company_id").join(searches, "company_id", "left").join(pages, "company_id", "left").join(items, "company_id", "left")
    return joined.select("company_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("searches", "pages", "distinct_pages", "items")])


_CHANNELS_SQL = C._CANDIDATES_SQL + """, chosen AS (SELECT company_id, kind, first(value ORDER BY confidence DESC, place, value) AS value, max(confidence) AS confidence FROM candidates GROUP BY company_id, kind),
channels AS (SELECT company_id, max(value) FILTER (kind = 'direct_email') AS direct_email, max(value) FILTER (kind = 'general_email') AS general_email, max(value) FILTER (kind = 'contact_form') AS contact_form, max(value) FILTER (kind = 'phone') AS phone, max(value) FILTER (kind = 'other') AS other,
  round(coalesce(nullif(max(confidence) FILTER (kind = 'direct_email'), 0), max(confidence) FILTER (kind = 'general_email') * CAST(0.6 AS DOUBLE), 0), 3) AS email_confidence FROM chosen GROUP BY company_id)"""


@query(_CHANNELS_SQL + " SELECT * FROM channels")
def contact_channels(spark, folder):
    """The channel of each kind of every company."""
    return facts.channels(C.contact_choice(spark, folder))


_COUNTED = "n AS (SELECT person_id, count(DISTINCT source_url) AS sources FROM evidence WHERE person_id IS NOT NULL GROUP BY person_id)"
_MARK = "CASE WHEN total >= 70 THEN 'high overall authority score' WHEN total >= 45 THEN 'moderate overall authority score' ELSE 'weak evidence; verify before outreach' END"


@query(
    C._SCORES_SQL + f""", {_COUNTED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY total DESC, name NULLS FIRST, person_id) AS rank FROM totals)
SELECT person_id, concat_ws('; ', replace(role_category, '_', ' ') || ' at this company', CASE WHEN {_b('title')} <> '' THEN 'titled ''' || title || '''' END, CASE WHEN sources > 0 THEN 'supported by ' || sources || ' source' || CASE WHEN sources > 1 THEN 's' ELSE '' END END, {_MARK}) AS reason
FROM ranked JOIN (SELECT person_id, people.title FROM people) USING (person_id) LEFT JOIN n USING (person_id) WHERE rank <= 8"""
)
def person_reasons(spark, folder):
    """Why each of the top people was taken."""
    top = people.top_people(C.person_scores(spark, folder)).select("person_id", "role_category", "total")
    joined = top.join(table(spark, folder, "people").select("person_id", "title"), "person_id").join(source_counts(spark, folder), "person_id", "left")
    return joined.select("person_id", facts.person_reason(F.col("role_category"), F.col("title"), F.coalesce("sources", F.lit(0)), F.col("total")).alias("reason"))


def _report(spark, folder) -> DataFrame:
    best = C.top_people(spark, folder).filter("rank = 1").join(table(spark, folder, "people").select("person_id", "title"), "person_id").select("company_id", F.col("name").alias("person"), F.col("title").alias("person_title"))
    return _results(spark, folder).join(best, "company_id", "left").join(contact_channels(spark, folder), "company_id", "left")


_REPORT_SQL = _CHANNELS_SQL + f", best AS (SELECT company_id, name AS person, person_id FROM ranked WHERE rank = 1), results AS ({_RESULTS_SQL}), report AS (SELECT r.*, person, p.title AS person_title, direct_email, general_email, contact_form, phone, other FROM results r LEFT JOIN best USING (company_id) LEFT JOIN (SELECT person_id, title FROM people) p USING (person_id) LEFT JOIN channels USING (company_id))"


@query(
    _REPORT_SQL + f""" SELECT company_id, CASE WHEN {_b('canonical_name')} = '' THEN 'unresolved company' ELSE concat_ws(' ', canonical_name, CASE WHEN {_b('legal_name')} <> '' AND legal_name <> canonical_name THEN '(' || legal_name || ')' END, CASE WHEN {_b('country')} <> '' THEN '[' || country || ']' END,
  CASE WHEN {_b('person')} <> '' THEN rtrim('- ' || person || ' ' || {_b('person_title')}, ' ') END, CASE WHEN {_b('direct_email')} <> '' THEN '<' || direct_email || '>' WHEN {_b('general_email')} <> '' THEN '<' || general_email || '>' WHEN {_b('contact_form')} <> '' THEN contact_form END) END AS summary FROM report"""
)
def summary_lines(spark, folder):
    """One line of text for every company."""
    return _report(spark, folder).select("company_id", facts.summary_line(*[F.col(c) for c in ("canonical_name", "legal_name", "country", "person", "person_title", "direct_email", "general_email", "contact_form")]).alias("summary"))


_CELL = lambda c: f"replace(coalesce(nullif({c}, ''), '-'), '|', chr(92) || '|')"
_ENTITY = f"CASE WHEN {_b('canonical_name')} <> '' AND coalesce(nullif(legal_name, ''), canonical_name) <> canonical_name THEN canonical_name || ' (' || legal_name || ')' ELSE coalesce(nullif(legal_name, ''), nullif(canonical_name, ''), '-') END"
_CONTACT = "coalesce(" + ", ".join(f"nullif({c}, '')" for c in ("direct_email", "general_email", "contact_form", "phone", "other")) + ")"
_PERSON = f"CASE WHEN {_b('person')} <> '' THEN CASE WHEN {_b('person_title')} <> '' THEN person || ' - ' || person_title ELSE person END END"


@query(
    _REPORT_SQL + f" SELECT row_number() OVER (ORDER BY lead_grade, company_name NULLS FIRST, company_id) AS place, '| ' || concat_ws(' | ', {', '.join(_CELL(c) for c in ('company_name', 'domain', _ENTITY, _PERSON, _CONTACT, 'lead_grade'))}) || ' |' AS line FROM report"
)
def report_rows(spark, folder):
    """The table of a batch's report by grade and name: a row of Markdown for each company."""
    from pyspark.sql import Window as W

    c = F.col
    there = lambda x: T.blank(x) != ""
    entity = F.when(there(c("canonical_name")) & (F.coalesce(F.nullif("legal_name", F.lit("")), c("canonical_name")) != c("canonical_name")), F.concat("canonical_name", F.lit(" ("), "legal_name", F.lit(")"))).otherwise(F.coalesce(F.nullif("legal_name", F.lit("")), F.nullif("canonical_name", F.lit("")), F.lit("-")))
    contact = F.coalesce(*[F.nullif(x, F.lit("")) for x in ("direct_email", "general_email", "contact_form", "phone", "other")])
    person = F.when(there(c("person")), T.display(c("person"), c("person_title")))
    rows = _report(spark, folder).select("lead_grade", "company_name", "company_id", facts.report_line([c("company_name"), c("domain"), entity, person, contact, c("lead_grade")]).alias("line"))
    # A report lists a batch, one row a company: numbering it needs one order over all.
    return rows.select(F.row_number().over(W.orderBy("lead_grade", F.col("company_name").asc_nulls_first(), "company_id")).alias("place"), "line")


@query(
    f"""SELECT company_id, CASE WHEN coalesce(confidence, 0) < 0.6 OR {_b('canonical_name')} = '' OR coalesce(n, 0) = 0 THEN 'no confirmed decision-maker yet' WHEN n = 1 THEN 'only one candidate; a second would corroborate' ELSE '' END AS people_gap, {_CLAMPED} AS confidence FROM companies LEFT JOIN (SELECT company_id, count(*) AS n FROM people GROUP BY company_id) USING (company_id)"""
)
def people_gaps(spark, folder):
    """What is missing about the people of every company, and its confidence between 0 and 1."""
    n = table(spark, folder, "people").groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, folder, "companies").join(n, "company_id", "left")
    none = (F.coalesce("confidence", F.lit(0.0)) < 0.6) | (T.blank(F.col("canonical_name")) == "") | (F.coalesce("n", F.lit(0)) == 0)
    return rows.select("company_id", F.when(none, "no confirmed decision-maker yet").when(F.col("n") == 1, "only one candidate; a second would corroborate").otherwise("").alias("people_gap"), T.clamped(F.col("confidence")).alias("confidence"))


@query("SELECT row_index, company_id, company_name FROM companies WHERE row_index >= 10 AND row_index < 60")
def companies_page(spark, folder):
    """Rows 10 to 59 of the list of companies."""
    return limited(table(spark, folder, "companies").select("row_index", "company_id", "company_name"), 10, 50)


# ---- answers of services, proposals, batches --------------------------------------------------------


@query(
    f"""SELECT evidence_id, 1 AS position, trim(source_url, ' ') AS url, trim({_b('source_title')}, ' ') AS title, trim({_b('source_text')}, ' ') AS snippet, 'web' AS engine, CAST(0 AS DOUBLE) AS score, {C._source_type("trim(source_url, ' ')", "trim(coalesce(source_title, ''), ' ')")} AS source_type
FROM evidence WHERE evidence_id % 7 <> 0 AND starts_with(trim({_b('source_url')}, ' '), 'http')"""
)
def web_answers(spark, folder):
    """Hits read out of JSON made of the evidence, a hit an answer; every seventh answer is broken."""
    hit = F.struct(F.col("source_url").alias("url"), F.col("source_title").alias("title"), F.col("source_text").alias("description"))
    other = F.struct(F.lit("ftp://x.example/a").alias("url"), F.lit("x").alias("title"), F.lit("y").alias("description"))
    body = F.to_json(F.struct(F.struct(F.array(hit, other).alias("results")).alias("web")))
    answers = table(spark, folder, "evidence").select("evidence_id", F.when(F.col("evidence_id") % 7 == 0, F.lit("<html>busy</html>")).otherwise(body).alias("body"))
    return responses.json_hits(answers, responses.WEB)


@query(
    f"""SELECT evidence_id, CAST(2 AS INTEGER) AS position, trim(source_url, ' ') AS url, trim({_b('source_title')}, ' ') AS title, coalesce(nullif(trim({_b('source_text')}, ' '), ''), trim({_b('source_title')}, ' ')) AS snippet, CASE WHEN evidence_id % 2 = 0 THEN 'alpha' ELSE 'meta' END AS engine, coalesce(confidence, 0) AS score,
  {C._source_type("trim(source_url, ' ')", "trim(coalesce(source_title, ''), ' ')")} AS source_type FROM evidence WHERE starts_with(trim({_b('source_url')}, ' '), 'http')"""
)
def meta_answers(spark, folder):
    """The same in the form of a service that asks others: with an engine and a score, after an entry without an address."""
    engine = F.when(F.col("evidence_id") % 2 == 0, "alpha")
    hit = F.struct(F.col("source_url").alias("url"), F.col("source_title").alias("title"), F.col("source_text").alias("content"), engine.alias("engine"), F.col("confidence").alias("score"))
    nothing = F.struct(F.lit("").alias("url"), F.lit("x").alias("title"), F.lit("y").alias("content"), F.lit(None).cast("string").alias("engine"), F.lit(1.0).alias("score"))
    answers = table(spark, folder, "evidence").select("evidence_id", F.to_json(F.struct(F.array(nothing, hit).alias("results"))).alias("body"))
    return responses.json_hits(answers, responses.META, None)


@query(f"SELECT page_id, {_b('final_url')} AS target FROM pages")
def redirect_links(spark, folder):
    """Addresses of pages wrapped into redirect links, and out again."""
    link = F.concat(F.lit("//go.example/l/?kh=-1&uddg="), F.url_encode(T.blank(F.col("final_url"))), F.lit("&rut=a1"))
    return table(spark, folder, "pages").select("page_id", responses.unwrapped(link).alias("target"))


@query(
    """WITH h AS (SELECT company_id, claim_type, evidence_id, CAST(evidence_id % 3 AS INTEGER) AS service FROM evidence), f AS (SELECT company_id, claim_type, min(service) AS service FROM h GROUP BY ALL)
SELECT company_id, claim_type, evidence_id, service, rank FROM (SELECT h.*, row_number() OVER (PARTITION BY company_id, claim_type ORDER BY evidence_id) AS rank FROM h JOIN f USING (company_id, claim_type, service)) WHERE rank <= 12"""
)
def first_answers(spark, folder):
    """Evidence as hits of three services, asked one after the other: of every query (here: kind of claim) the hits of the first that has any."""
    hits = table(spark, folder, "evidence").select("company_id", "claim_type", "evidence_id", F.pmod("evidence_id", F.lit(3)).cast("int").alias("service"))
    return responses.first_answer(hits, ["company_id", "claim_type"], place="evidence_id")


_BOTH_ALIASES = f"list_filter(list_concat(coalesce(aliases, []), al), lambda a: {_b('a')} <> '')"


@query(
    rf"""WITH said AS (SELECT company_id, upper(canonical_name) AS n, CASE WHEN company_id % 2 = 0 THEN '' ELSE legal_name END AS l, 'Utopia' AS c, [lower(canonical_name)] AS al, least(CAST(1 AS DOUBLE), coalesce(confidence, 0) + CAST(0.5 AS DOUBLE)) AS sure,
    EXISTS (SELECT 1 FROM pages p WHERE p.company_id = companies.company_id AND list_contains(coalesce(evidence_urls, []), p.final_url)) AS cited FROM companies WHERE company_id % 3 <> 0)
SELECT company_id, coalesce(nullif(n, ''), canonical_name) AS canonical_name, coalesce(nullif(l, ''), legal_name) AS legal_name, coalesce(nullif(c, ''), country) AS country, language,
  CASE WHEN sure IS NULL THEN coalesce(aliases, []) ELSE list_slice({C._distinct(_BOTH_ALIASES)}, 1, 8) END AS aliases,
  CASE WHEN sure IS NULL THEN confidence WHEN cited THEN sure ELSE least(sure, CAST(0.3 AS DOUBLE)) END AS confidence FROM companies LEFT JOIN said USING (company_id)"""
)
def identity_overlay(spark, folder):
    """Proposals made of two thirds of the companies, laid over all of them."""
    companies = table(spark, folder, "companies")
    even = F.col("company_id") % 2 == 0
    proposals = companies.filter("company_id % 3 <> 0").select(
        "company_id", F.upper("canonical_name").alias("canonical_name"), F.when(even, "").otherwise(F.col("legal_name")).alias("legal_name"), F.lit("Utopia").alias("country"), F.lit("").alias("language"),
        F.array(F.lower("canonical_name")).alias("aliases"), (F.coalesce("confidence", F.lit(0.0)) + 0.5).alias("confidence"), F.col("evidence_urls").alias("source_urls"),
    )
    base = companies.select("company_id", "canonical_name", "legal_name", "country", "language", "aliases", "confidence")
    return identity.overlay(base, proposals, _known(spark, folder))


@query(
    rf"""WITH t AS (SELECT company_id, page_id, {_b('final_url')} AS url, coalesce(nullif(title, ''), {_b('final_url')}) AS title, regexp_replace({_b('text')}, '^[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+|[\t-\r\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g') AS t, row_number() OVER (PARTITION BY company_id ORDER BY page_id) AS n FROM pages)
SELECT company_id, string_agg('[' || n || '] ' || title || chr(10) || 'URL: ' || url || chr(10) || CASE WHEN length(t) <= 1800 THEN t ELSE substr(t, 1, 900) || chr(10) || '...[truncated]...' || chr(10) || right(t, 900) END || chr(10), chr(10) ORDER BY n) AS sources FROM t WHERE n <= 8 GROUP BY company_id"""
)
def numbered_sources(spark, folder):
    """The first eight pages of every company as a prompt lists them."""
    pages = table(spark, folder, "pages").select("company_id", F.col("final_url").alias("url"), "title", "text", F.col("page_id").alias("place"))
    return facts.numbered_sources(pages)


@query(f"SELECT company_id, CASE WHEN company_id % 5 = 0 THEN 'FAIL' ELSE lead_grade END AS lead_grade, CASE WHEN company_id % 5 = 0 THEN 'ERROR' ELSE status END AS status, CASE WHEN company_id % 5 = 0 THEN 'technical failure' ELSE nullif(failure_category, '') END AS failure_category FROM ({_RESULTS_SQL})")
def batch_results(spark, folder):
    """One result for every company; a fifth of them came without any."""
    results = _results(spark, folder)
    some = results.filter("company_id % 5 <> 0").withColumn("place", F.lit(2))
    stale = some.withColumn("place", F.lit(1)).withColumn("status", F.lit("STALE"))
    return facts.every_input(results, some.unionByName(stale), "company_id")


@query(f"SELECT count(*) || ' companies | A-D ' || printf('%.1f', round(100.0::DOUBLE * count(*) FILTER (lead_grade IN ('A', 'B', 'C', 'D')) / count(*), 1)) || '% | A-E ' || printf('%.1f', round(100.0::DOUBLE * count(*) FILTER (lead_grade <> 'FAIL') / count(*), 1)) || '%' AS line FROM ({_RESULTS_SQL}) HAVING count(*) > 0")
def batch_line(spark, folder):
    """The figures of a batch in one line."""
    rows = _results(spark, folder).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lead_grade").isin("A", "B", "C", "D")).alias("d"), F.count_if(F.col("lead_grade") != "FAIL").alias("e")).filter("n > 0")
    return rows.select(F.format_string("%d companies | A-D %.1f%% | A-E %.1f%%", F.col("n"), metrics.percent(F.col("d"), F.col("n")), metrics.percent(F.col("e"), F.col("n"))).alias("line"))


def _html_cell(c: str) -> str:
    out = _b(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = f"replace({out}, {_q(sign)}, {_q(entity)})"
    return f"'<td>' || {out} || '</td>'"


_HTML_COLUMNS = ("company_name", "domain", "legal_name", "lead_grade", "failure_category")


@query(f"SELECT company_id, '<tr>' || {' || '.join(map(_html_cell, _HTML_COLUMNS))} || '</tr>' AS line FROM ({_RESULTS_SQL})")
def report_html_rows(spark, folder):
    """A row of the HTML report for each company."""
    return _results(spark, folder).select("company_id", facts.html_row([F.col(c) for c in _HTML_COLUMNS]).alias("line"))


@query(
    f"""WITH s AS (SELECT DISTINCT company_id, person_id FROM ({_SUPPORTED_SQL}) WHERE person_id IS NOT NULL), some_named AS (SELECT DISTINCT company_id FROM s JOIN people USING (company_id, person_id))
SELECT person_id, p.company_id, EXISTS (SELECT 1 FROM s WHERE s.company_id = p.company_id AND s.person_id = p.person_id) AS supported FROM people p WHERE p.company_id NOT IN (SELECT company_id FROM some_named) OR EXISTS (SELECT 1 FROM s WHERE s.company_id = p.company_id AND s.person_id = p.person_id)"""
)
def finalised_people(spark, folder):
    """The people of every company that supported evidence names, or all where it names none."""
    kept = selection.supported(table(spark, folder, "evidence"), _known(spark, folder))
    return selection.supported_or_all(table(spark, folder, "people"), kept).select("person_id", "company_id", "supported")


def page_facts(spark, folder):
    """All facts of every page in one row each."""
    return facts.page_facts(table(spark, folder, "pages"))


query()(page_facts)
