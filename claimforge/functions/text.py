"""Column expressions: URLs, names, roles, mail, telephone numbers, legal names, recency. No Python runs in them.

A word character is a letter, a number or _ (so joiners and combining marks are none), spelled out as Java's own class has more.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimforge import lexicon as L


def blank(c: Column) -> Column:
    """'' for null: a missing text and an empty one mean the same."""
    return F.coalesce(c, F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once: branches of CASE and OR would compute it again in each."""
    return F.get(F.transform(F.array(value), body), 0)


def has_any(c: Column, needles: list[str]) -> Column:
    return let(c, lambda b: reduce(or_, [F.contains(b, F.lit(n)) for n in needles]))


def ends_any(c: Column, ends: list[str]) -> Column:
    return let(c, lambda b: reduce(or_, [F.endswith(b, F.lit(e)) for e in ends]))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def first_match(c: Column, rules: list[tuple[object, list[str]]], otherwise: object) -> Column:
    """The value of the first rule of which a word stands in c."""

    def ladder(b: Column) -> Column:
        out = F
        for value, needles in rules:
            out = out.when(reduce(or_, [F.contains(b, F.lit(n)) for n in needles]), F.lit(value))
        return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))

    return let(c, ladder)


# ---- URLs -------------------------------------------------------------------------------------------


def host(url: Column) -> Column:
    """Lower case, without user, port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(blank(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(blank(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def clean_url(url: Column) -> Column:
    """With https in front where no scheme stands, without a fragment."""
    text = F.trim(blank(url))
    full = F.when(text == "", text).when(text.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), text).otherwise(F.concat(F.lit("https://"), text))
    return F.regexp_replace(full, r"#.*$", "")


def same_site(url: Column, domain: Column) -> Column:
    h, d = host(url), F.regexp_replace(F.lower(blank(domain)), r"^www\.", "")
    return (h != "") & (d != "") & ((h == d) | F.endswith(h, F.concat(F.lit("."), d)) | F.endswith(d, F.concat(F.lit("."), h)))


def company_site(h: Column) -> Column:
    return let(h, lambda b: F.contains(b, F.lit(".")) & reduce(or_, [F.endswith(b, F.lit(e)) for e in L.SITE_SUFFIXES]))


def worth_fetching(url: Column) -> Column:
    h = host(url)
    return ~blank(url).rlike(L.LOW_VALUE_URL) & (h != "") & ~F.contains(h, F.lit("play.google.com"))


def people_page(url: Column) -> Column:
    """Whether a path segment, without its ending, is one of pages about people."""
    listed = strings(L.PEOPLE_SEGMENTS)
    segment = lambda s: F.replace(F.regexp_replace(F.lower(F.trim(s)), r"(\.html|\.htm|\.php|\.aspx)$", ""), F.lit("_"), F.lit("-"))
    return F.exists(F.split(path(url), "/"), lambda s: F.array_contains(listed, segment(s)))


def people_source(url: Column, title: Column) -> Column:
    return ~F.concat_ws(" ", blank(url), blank(title)).rlike(L.NOT_PEOPLE_SOURCE)


def contact_page(url: Column, title: Column) -> Column:
    both = F.lower(F.concat_ws(" ", blank(url), blank(title)))
    return has_any(both, L.CONTACT_PATHS) | has_any(F.lower(blank(title)), L.FORM_HINTS)


def source_type(url: Column, title: Column) -> Column:
    kind = lambda h: first_match(F.lower(F.concat(h, F.lit(" "), blank(title))), L.SOURCE_RULES, F.when(company_site(h), F.lit("company_website")).otherwise("other"))
    return let(host(url), kind)


def link_weight(url: Column, anchor: Column) -> Column:
    return first_match(F.lower(F.concat_ws(" ", url, anchor)), L.LINK_WEIGHTS, 0.0)


def hit_score(url: Column, title: Column, snippet: Column, kind: Column, position: Column, terms: Column) -> Column:
    """How useful a search hit is; terms: array of lower-case words."""
    bonus = lambda test, value: F.when(test, F.lit(value)).otherwise(0.0)

    def total(h: Column, head: Column, blob: Column) -> Column:
        matched = F.size(F.filter(terms, lambda t: (t != "") & F.contains(blob, t)))
        points = (
            F.lit(1.0)
            + bonus(has_any(h, L.HIGH_VALUE_HOSTS), 3.0)
            + matched * F.lit(1.4)
            + bonus(company_site(h), 1.2)
            + bonus(kind.isin("company_website", "registry", "press_release", "partner_announcement"), 1.0)
            + bonus(kind.isin("directory", "job_board", "forum", "social_profile"), -1.5)
            + bonus(F.exists(terms, lambda t: (t != "") & F.startswith(head, t)), 0.8)
            + F.when(position > 0, F.greatest(F.lit(0.0), F.lit(1.5) - position * F.lit(0.1))).otherwise(0.0)
            + bonus(F.endswith(h, F.lit(".pdf")), -0.3)
        )
        return F.when((h == "") | h.isin(L.LOW_VALUE_HOSTS), F.lit(0.0)).otherwise(F.round(points, 2))

    text = F.struct(host(url).alias("h"), F.lower(blank(title)).alias("t"), F.lower(F.concat(blank(title), F.lit(" "), blank(snippet))).alias("b"))
    return let(text, lambda x: total(x["h"], x["t"], x["b"]))


def socials(url: Column) -> Column:
    """The key of the social network a URL belongs to, or null."""


    def ladder(h: Column) -> Column:
        out = F
        for name, key in L.SOCIAL_HOSTS.items():
            out = out.when((h == name) | F.endswith(h, F.lit("." + name)), F.lit(key))
        return out.otherwise(F.lit(None).cast("string"))

    return let(host(url), ladder)


def off_site(url: Column, domain: Column) -> Column:
    """Whether a URL lies outside the company's own host and the social networks that aren't fetched."""
    own = F.regexp_replace(F.lower(blank(domain)), r"^www\.", "")
    return let(host(url), lambda h: (h != "") & (h != own) & ~reduce(or_, [F.endswith(h, F.lit(e)) for e in L.UNFETCHED_ENDINGS]))


def bot_wall(text: Column, head: int | None = 4000, least: int = 80) -> Column:
    """Whether a rendered page is a wall against robots: a marker near its beginning, or hardly any text."""
    t = F.trim(blank(text))
    begin = t if head is None else F.substring(t, 1, head)
    return has_any(F.lower(begin), L.BOT_WALL) | (F.length(t) < least)


def clip(c: Column, limit: int) -> Column:
    """The text, or its beginning and end around a mark where it is longer than the limit."""
    return let(F.regexp_replace(blank(c), r"(?U)^\s+|\s+$", ""), lambda t: F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit // 2), F.lit("\n...[truncated]...\n"), F.right(t, F.lit(limit // 2)))))


def clamped(c: Column) -> Column:
    """A confidence between 0 and 1; null is 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c.cast("double"), F.lit(0.0))))


def identity_names(canonical: Column, legal: Column, domain: Column, aliases: Column, terms: Column) -> Column:
    """(brand, names): the distinctive words of name, domain and aliases, never of the legal name; and every different spelling."""
    none = F.array().cast("array<string>")
    nick = F.coalesce(aliases, none)
    names = F.array_distinct(F.filter(F.concat(F.array(canonical, legal, domain), nick, F.coalesce(terms, none)), lambda n: blank(n) != ""))
    brand = F.filter(F.concat(F.array(canonical, domain), nick), lambda n: blank(n) != "")
    return F.struct(F.array_sort(target_words(brand)).alias("brand"), names.alias("names"))


def target_words(terms: Column) -> Column:
    """The words of at least three characters in terms of at least three, without endings of company names."""
    endings = strings(sorted(L.SUFFIX_TOKENS))
    words = F.flatten(F.transform(terms, lambda t: F.split(F.lower(t), r"[^\p{L}\p{N}_]+")))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(endings, w)))


# ---- companies --------------------------------------------------------------------------------------


def clean_name(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.replace(blank(c), F.lit(" "), F.lit(" ")), r"[?�\u0000-\u001F]", " "))


def degraded_name(c: Column) -> Column:
    return (F.trim(blank(c)) == "") | F.contains(blank(c), F.lit("?"))


def distinctive_tokens(c: Column) -> Column:
    noise = strings(L.LEGAL_NOISE)
    return F.array_distinct(F.filter(F.split(F.lower(blank(c)), r"[^\p{L}\p{N}_]+"), lambda t: (F.length(t) >= 3) & ~F.array_contains(noise, t)))


def first(c: Column, most: int | None) -> Column:
    """The first entries of a list; all of them if most is None."""
    return c if most is None else F.slice(c, 1, most)


def query_terms(*values: Column, most: int | None = 10) -> Column:
    """The first different words of more than two characters; values: strings or arrays of them."""
    words = F.flatten(F.transform(F.array(*[blank(v) for v in values]), lambda v: F.split(F.trim(F.regexp_replace(F.lower(v), r"(?U)[^\p{L}\p{N}_\s.\-]", " ")), r"(?U)\s+")))
    return first(F.array_distinct(F.filter(words, lambda t: F.length(t) > 2)), most)


def size_hint(c: Column) -> Column:
    """Band of company size by head counts of up to three digits, then by phrases."""
    return let(F.lower(blank(c)), _size_of)


def _size_of(low: Column) -> Column:
    gate = low.rlike(r"\b([0-9]{1,3})\s*[-+]?\s*(employees|staff|people)\b")
    count = F.coalesce(F.regexp_extract(low, r"\b([0-9]{1,4})\s*[-+]?\s*(employees|staff|people)\b", 1).try_cast("int"), F.lit(0))
    return (
        F.when(gate & (count >= 250), "large")
        .when(gate & (count >= 25), "medium")
        .when(low.rlike(r"\b(solo founder|one-person|2[- ]person|tiny team|small team|indie hacker)\b"), "small")
        .when(low.rlike(r"\b(series [a-e]\b|funding round|raised \$|unicorn|ipo|nasdaq|fortune 500)\b"), "large")
        .when(low.rlike(r"\b(saas platform|enterprise software|global team|offices in)\b"), "medium")
        .otherwise("")
    )


def legal_names(c: Column) -> Column:
    """Japanese, Chinese, then Latin legal names, first seen first; Latin ones of two words or more and 2 to 70 characters.

    Latin ones of generic words alone are left out, and each name begins after its last generic word, unless nothing would be left.
    """
    text = blank(c)
    generic = strings(L.GENERIC_LOCALS)
    edge = lambda x: F.regexp_replace(x, r"^[ ,.;]+|[ ,.;]+$", "")
    east = F.concat(F.regexp_extract_all(text, F.lit(f"({L.JP_LEGAL})"), 1), F.regexp_extract_all(text, F.lit(f"({L.CN_LEGAL})"), 1))
    latin = F.transform(F.regexp_extract_all(text, F.lit(f"({L.LATIN_LEGAL})"), 1), lambda x: edge(squeeze(x)))
    words = lambda x: F.split(x, " ")
    kept = F.filter(latin, lambda x: F.length(x).between(2, 70) & (F.size(words(x)) >= 2) & ~F.forall(words(x), lambda w: F.array_contains(generic, F.lower(w))))

    def tight(x: Column) -> Column:
        bare = F.transform(words(x), lambda w: F.regexp_replace(F.lower(w), r"^[.,]+|[.,]+$", ""))
        last = F.array_max(F.transform(bare, lambda w, i: F.when(F.array_contains(generic, w), i + 1).otherwise(0)))
        return edge(F.array_join(F.slice(words(x), last + 1, F.size(words(x))), " "))

    return F.array_distinct(F.filter(F.transform(F.array_distinct(F.concat(east, kept)), tight), lambda x: x != ""))


def copyright_entity(c: Column) -> Column:
    name = F.regexp_replace(squeeze(F.regexp_extract(blank(c), L.COPYRIGHT, 1)), r"^[ .,;]+|[ .,;]+$", "")
    return F.when((F.size(F.split(name, " ")) > 6) | (F.length(name) > 60), "").otherwise(name)


def registry_codes(c: Column, most: int | None = 8) -> Column:
    """Array of (kind, value): the first different codes, by kind and place."""
    text = blank(c)

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(F.lit(kind).alias("kind"), F.trim(v).alias("value")))

    every = [of(kind, pattern) for kind, pattern in L.REGISTRY_CODES]
    return first(F.array_distinct(F.concat(*every)), most)


def wechat(c: Column) -> Column:
    return F.regexp_extract(blank(c), L.WECHAT, 1)


def language(country: Column, tongue: Column) -> Column:
    """The first language of which a key stands in "country language"; '' if none."""
    return first_match(F.lower(F.concat_ws(" ", blank(country), blank(tongue))), [(name, keys) for name, keys, _ in L.LANGUAGES], "")


def native_words(lang: Column) -> Column:
    out = F
    for name, _, words in L.LANGUAGES:
        out = out.when(lang == name, strings(words))
    return out.otherwise(F.array().cast("array<string>"))


# ---- people -----------------------------------------------------------------------------------------


def role(title: Column) -> Column:
    """(category, authority) of a title."""
    return let(F.lower(squeeze(blank(title))), _role_of)


def _role_of(norm: Column) -> Column:
    pair = lambda category, authority: F.struct(F.lit(category).alias("category"), F.lit(authority).alias("authority"))
    out = F.when(norm == "", pair("unknown", 0))
    for category, authority, words in L.ROLE_TIERS:
        out = out.when(reduce(or_, [F.contains(norm, F.lit(w)) for w in words]), pair(category, authority))
    return out.when(norm.rlike(r"(?U)\bchief\b|\bceo\b|\bpresident\b"), pair("chief_executive", 22)).otherwise(pair("unknown", 4))


def title_rank(title: Column) -> Column:
    low = F.lower(blank(title))
    return first_match(low, [(len(L.SENIORITY) - i, [w]) for i, w in enumerate(L.SENIORITY)], 0)


_OPENERS = "|".join(re.escape(w) for w in sorted(L.TITLE_OPENERS, key=lambda w: (-len(w), w)))


def looks_like_title(title: Column) -> Column:
    t = F.trim(blank(title))
    return (t != "") & (F.length(t) <= 60) & t.rlike(rf"(?iuU)^\s*(?:{_OPENERS})\b") & ~t.rlike(L.TITLE_PROSE) & ~t.rlike(L.TITLE_CHROME)


def looks_like_name(name: Column) -> Column:
    v = F.trim(blank(name))
    east = v.rlike(r"^[゠-ヿ一-鿿㐀-䶿]+$")
    tokens = F.filter(F.split(v, r"[\s\-.’']+"), lambda t: t != "")
    low = F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), r"^[.,]+|[.,]+$", ""))
    barred = strings(sorted({*L.NOT_PERSON_TOKENS, *L.SUFFIX_TOKENS, *L.STACK_TOKENS, *L.ROLE_TOKENS, *L.PRODUCT_TOKENS}))
    latin = F.size(tokens).between(2, 4) & ~F.arrays_overlap(low, barred) & F.forall(tokens, lambda t: t.rlike(r"^\p{Lu}") & (F.length(t) <= 18))
    return F.length(v).between(3, 60) & ~v.rlike(r"@|https?://|[0-9]{3}") & F.when(east, F.length(v).between(2, 4)).otherwise(latin)


_NAME_NOISE = "|".join(L.NAME_NOISE)


def person_tokens(name: Column) -> Column:
    """Comparable words of a name; the noise words are removed only in lower case."""
    text = F.regexp_replace(F.trim(blank(name)), r"(?U)[^\p{L}\p{N}_\s.'-]", " ")
    plain = F.lower(squeeze(F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_])({_NAME_NOISE})(?![\p{{L}}\p{{N}}_])", " ")))
    return F.filter(F.split(plain, " "), lambda t: t != "")


def person_key(name: Column) -> Column:
    """"surname|initial", or the only word."""
    t = person_tokens(name)
    return F.when(F.size(t) == 0, "").when(F.size(t) == 1, F.get(t, 0)).otherwise(F.concat(F.get(t, F.size(t) - 1), F.lit("|"), F.substring(F.get(t, 0), 1, 1)))


def names_conflict(a: Column, b: Column) -> Column:
    """Whether two names are surely two persons: other keys and no word in common; unreadable ones never conflict."""
    stop = strings(L.NAME_STOPWORDS)
    words = lambda n: F.filter(person_tokens(n), lambda t: ~F.array_contains(stop, t))
    keys = F.struct(person_key(a).alias("a"), person_key(b).alias("b"), words(a).alias("x"), words(b).alias("y"))
    return let(keys, lambda k: (k["a"] != "") & (k["b"] != "") & (k["a"] != k["b"]) & (F.size(k["x"]) > 0) & (F.size(k["y"]) > 0) & ~F.arrays_overlap(k["x"], k["y"]))


def display(name: Column, title: Column) -> Column:
    return F.when(blank(title) != "", F.concat(name, F.lit(" - "), title)).otherwise(name)


def recency(newest_year: Column, as_of_year: int) -> Column:
    """Points of the newest year found in a person's evidence; 4 where none is dated."""
    age = F.greatest(F.lit(0), F.lit(as_of_year) - newest_year)
    return F.when(newest_year.isNull(), 4.0).when(age <= 1, 10.0).when(age == 2, 8.0).when(age <= 4, 6.0).otherwise(3.0)


# ---- mail and telephone -----------------------------------------------------------------------------


def plain_at(c: Column) -> Column:
    """(at), [at] and a spaced "at" as @, the same for dots. A bare at or dot inside a word stays as it is."""
    at = F.regexp_replace(blank(c), r"(?i)\s*(?:\(at\)|\[at\])\s*", "@")
    return F.regexp_replace(at, r"(?i)\s*(?:\(dot\)|\[dot\])\s*", ".")


def raw_emails(c: Column) -> Column:
    """Candidates in the order of the text, after a character that can't belong to them."""
    return F.regexp_extract_all(plain_at(c), F.lit(rf"(?<![\p{{L}}\p{{N}}_.+-])({L.EMAIL})"), 1)


def normal_email(raw: Column, junk: list[str] = L.EMAIL_JUNK) -> Column:
    """Lower case without punctuation around it; '' where it is no usable address."""
    return let(F.lower(F.regexp_replace(F.trim(blank(raw)), r"^[.,;:!?\"'<>()\[\]]+|[.,;:!?\"'<>()\[\]]+$", "")), lambda e: _usable_email(e, junk))


def _usable_email(e: Column, junk: list[str]) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    bad = F.contains(e, F.lit("..")) | ~F.contains(e, F.lit("@")) | (local == "") | ~F.contains(domain, F.lit(".")) | local.rlike(r"^(www\.|http|ftp|smtp|mail\.)|://|[.\-_+]$")
    if junk:
        bad = bad | has_any(e, junk)
    return F.when(bad | local.isin(L.GENERIC_LOCALS) | (F.length(local) < 2) | F.replace(local, F.lit("."), F.lit("")).rlike(r"^[0-9]+$"), "").otherwise(e)


def emails(c: Column, junk: list[str] = L.EMAIL_JUNK) -> Column:
    return F.array_distinct(F.filter(F.transform(raw_emails(c), lambda x: normal_email(x, junk)), lambda x: x != ""))


def local_part(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def name_words(name: Column) -> Column:
    """Words of two letters or more, in lower case."""
    return F.filter(F.split(squeeze(F.regexp_replace(F.lower(blank(name)), r"(?U)[^\p{L}\p{N}_\s]", " ")), r"[\s.]+"), lambda t: F.length(t) > 1)


def mailbox_fit(local: Column, words: Column) -> Column:
    """How well a person's words fit a mailbox: 0.8, 0.75, 0.6, 0.55 or 0."""
    n = F.size(words)
    first, last = F.get(words, 0), F.get(words, n - 1)
    return (
        F.when(n == 0, 0.0)
        .when((local == first) | (local == F.array_join(words, ".")), 0.8)
        .when((local == last) | (local == F.concat(last, F.lit("."), first)), 0.75)
        .when((local == F.concat(first, last)) | (local == F.concat(last, first)), 0.6)
        .when(F.forall(words, lambda w: F.contains(local, w)), 0.55)
        .otherwise(0.0)
    )


def email_kind(email: Column, names: Column) -> Column:
    """(kind, confidence) of an address; names: the persons' names, of which the first that fits decides."""
    local, domain = local_part(email), F.substring_index(email, "@", -1)
    fits = F.filter(F.transform(names, lambda n: mailbox_fit(local, name_words(n))), lambda x: x > 0)
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), (c if isinstance(c, Column) else F.lit(c)).alias("confidence"))
    prefixes = [r for r in L.ROLE_LOCALS if len(r) > 4]
    return (
        F.when(email == "", pair("", 0.0))
        .when(F.size(fits) > 0, pair("direct", F.get(fits, 0)))
        .when(domain.isin(L.PERSONAL_PROVIDERS), pair("direct", 0.5))
        .when(local.isin(L.ROLE_LOCALS) | reduce(or_, [F.startswith(local, F.lit(p)) for p in prefixes]), pair("general", 0.7))
        .when((F.length(F.substring_index(local, ".", 1)) <= 2) & F.contains(local, F.lit(".")), pair("general", 0.6))
        .when(F.contains(local, F.lit(".")), pair("direct", 0.45))
        .otherwise(pair("general", 0.4))
    )


def phones(c: Column, most: int | None = 8) -> Column:
    """The first different numbers: those on lines with a label first, then by place."""

    digits = lambda x: F.regexp_replace(x, r"[^0-9]", "")

    def of_line(line: Column, n: Column) -> Column:
        rank = F.when(line.rlike(L.PHONE_LABEL), 0).otherwise(2)
        found = F.transform(F.regexp_extract_all(line, F.lit(f"({L.PHONE})"), 1), lambda raw, k: F.struct(rank.alias("rank"), n.alias("line"), k.alias("at"), F.trim(raw).alias("raw"), digits(raw).alias("digits")))
        return F.filter(
            found,
            lambda x: F.length(x["digits"]).between(7, 15) & ~(~x["raw"].rlike(r"[\s().\-+]") & (F.length(x["digits"]) > 11)) & ~x["digits"].rlike(r"^20[0-9]{6,}$|^([0-9])\1+$"),
        )

    every = F.array_sort(F.flatten(F.transform(F.filter(F.split(blank(c), r"\r\n|[\n\r]"), lambda line: line.rlike(r"[0-9]")), of_line)))
    shown = F.transform(every, lambda x: F.regexp_replace(squeeze(x["raw"]), r"^[ .-]+|[ .-]+$", ""))
    once = lambda s: let(F.transform(s, digits), lambda d: F.filter(s, lambda x, i: F.array_position(d, digits(x)) == i + 1))
    return first(let(shown, once), most)


def quote_around(text: Column, needle: Column, width: int = 220) -> Column:
    place = F.call_function("locate", F.lower(blank(needle)), F.lower(blank(text)))
    begin = F.greatest(F.lit(0), place - 1 - width // 3)
    cut = F.substring(blank(text), begin + 1, place - 1 + width - begin)
    return F.when((blank(needle) == "") | (place == 0), "").otherwise(squeeze(cut))


def addresses(c: Column, most: int | None = 5, line_length: int | None = 200, whole: int | None = 3) -> Column:
    """The first addresses: the first of each hinted line of at most line_length characters; without any, the first of the first form that the whole text has."""
    text = blank(c)
    edge = lambda x: F.regexp_replace(x, r"^[ ,;]+|[ ,;]+$", "")
    forms = [F.lit(f"({p})") for p in (L.LATIN_ADDRESS, L.JP_ADDRESS, L.CJK_ADDRESS)]
    hinted = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), F.trim), lambda x: (x != "") & (F.lit(True) if line_length is None else F.length(x) <= line_length) & has_any(F.lower(x), L.ADDRESS_HINTS))
    of_lines = F.array_distinct(F.array_compact(F.transform(hinted, lambda x: F.coalesce(*[F.get(F.regexp_extract_all(x, f, 1), 0) for f in forms]))))
    of_text = [F.regexp_extract_all(text, forms[i], 1) for i in (1, 2, 0)]
    fallback = F.coalesce(*[F.when(F.size(w) > 0, first(F.array_distinct(F.transform(w, edge)), whole)) for w in of_text], F.array().cast("array<string>"))
    return first(let(F.transform(of_lines, edge), lambda x: F.when(F.size(x) > 0, x).otherwise(fallback)), most)


def other_company(text: Column, terms: Column) -> Column:
    """Whether a title ties the person ("... of X", "... at X") to an organisation other than the one of the terms.

    Department headings are none: X counts if it has a legal ending, or words that are not all role, product or department
    words and not in lower case.
    """
    ordinary = strings(sorted({*L.NOT_PERSON_TOKENS, *L.SUFFIX_TOKENS, *L.STACK_TOKENS, *L.ROLE_TOKENS, *L.PRODUCT_TOKENS, *L.DEPARTMENTS}))
    endings = strings(sorted(L.SUFFIX_TOKENS))
    expected = target_words(terms)

    def foreign(org: Column, known: Column) -> Column:
        pieces = F.filter(F.transform(F.split(F.replace(org, F.lit("-"), F.lit(" ")), r"\s+"), lambda t: F.regexp_replace(t, "^[.'’\"]+|[.'’\"]+$", "")), lambda t: t != "")
        low = F.transform(pieces, F.lower)
        usual = F.forall(low, lambda t: F.array_contains(ordinary, t))
        small = F.exists(pieces, lambda t: (t == F.lower(t)) & (t != F.upper(t)))
        ours = F.arrays_overlap(low, known) | F.exists(known, lambda k: F.contains(F.lower(org), k)) | org.isin("Board", "Division", "Operations", "Product")
        return ~ours & (F.size(pieces) > 0) & (F.arrays_overlap(low, endings) | (~usual & ~small))

    return let(expected, lambda known: (F.size(known) > 0) & F.exists(F.regexp_extract_all(blank(text), F.lit(L.ATTRIBUTION), 1), lambda org: foreign(F.trim(org), known)))
