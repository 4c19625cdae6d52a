"""All facts of a page in one row, and the short texts that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimforge.functions import html
from claimforge.functions import text as T
from claimforge.operators import contacts, people


def page_facts(pages: DataFrame, most_phones: int | None = 8) -> DataFrame:
    """One row per page: addresses of mail and numbers of its text, then of its links and contact blocks; profiles, legal names (also in links), chat id,
    copyright holder, codes, postal addresses, contact forms and people. pages: page_id, final_url, url, html, text; a repeated page_id is one page."""
    none = F.array().cast("array<string>")
    parsed = html.parse_pages(pages).withColumnRenamed("text", "_shown").dropDuplicates(["page_id"])
    text = pages.select("page_id", F.col("text").alias("_text")).dropDuplicates(["page_id"])
    joined = parsed.join(text, "page_id", "left")
    hrefs = F.transform("links", lambda x: x["url"])
    listed = F.concat_ws("\n", F.concat_ws("\n", "mailto"), F.concat_ws("\n", "contact_texts"))
    body = F.col("_text")
    networks = F.filter(F.transform(hrefs, lambda u: F.struct(T.socials(u).alias("network"), u.alias("url"))), lambda x: x["network"].isNotNull())
    facts = joined.select(
        "page_id",
        F.array_distinct(F.concat(T.emails(body), T.emails(listed))).alias("emails"),
        T.first(F.array_distinct(F.concat(T.phones(body), T.phones(F.concat_ws("\n", F.concat_ws("\n", "tel"), F.concat_ws("\n", "contact_texts"))))), most_phones).alias("phones"),
        networks.alias("socials"),
        T.wechat(body).alias("wechat"),
        T.legal_names(F.concat_ws("\n", T.blank(body), F.array_join(hrefs, " "))).alias("legal_names"),
        T.copyright_entity(body).alias("copyright_entity"),
        T.registry_codes(body).alias("registry_codes"),
        T.addresses(body).alias("addresses"),
    )
    forms = contacts.contact_forms(parsed.withColumnRenamed("_shown", "text")).groupBy("page_id").agg(F.array_sort(F.collect_list("url")).alias("contact_forms"))
    named = people.page_people(parsed).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("name", "title"))).alias("people"))
    full = facts.join(forms, "page_id", "left").join(named, "page_id", "left")
    return full.withColumn("contact_forms", F.coalesce("contact_forms", none)).withColumn("people", F.coalesce("people", F.array().cast("array<struct<name:string,title:string>>")))


def summary_line(canonical: Column, legal: Column, country: Column, name: Column, title: Column, direct: Column, general: Column, form: Column) -> Column:
    """One line of a lead: name, (legal name), [country], - person, and the best channel."""
    there = lambda c: T.blank(c) != ""
    bits = F.concat_ws(
        " ",
        canonical,
        F.when(there(legal) & (legal != canonical), F.concat(F.lit("("), legal, F.lit(")"))),
        F.when(there(country), F.concat(F.lit("["), country, F.lit("]"))),
        F.when(there(name), F.rtrim(F.concat(F.lit("- "), name, F.lit(" "), T.blank(title)))),
        F.when(there(direct), F.concat(F.lit("<"), direct, F.lit(">"))).when(there(general), F.concat(F.lit("<"), general, F.lit(">"))).when(there(form), form),
    )
    return F.when(there(canonical), bits).otherwise("unresolved company")


def person_reason(category: Column, title: Column, sources: Column, total: Column) -> Column:
    """Why a person was taken, in at most four parts."""
    many = F.when(sources > 1, "s").otherwise("")
    return F.concat_ws(
        "; ",
        F.concat(F.replace(category, F.lit("_"), F.lit(" ")), F.lit(" at this company")),
        F.when(T.blank(title) != "", F.concat(F.lit("titled '"), title, F.lit("'"))),
        F.when(sources > 0, F.concat(F.lit("supported by "), sources.cast("string"), F.lit(" source"), many)),
        F.when(total >= 70, "high overall authority score").when(total >= 45, "moderate overall authority score").otherwise("weak evidence; verify before outreach"),
    )


def channels(chosen: DataFrame) -> DataFrame:
    """One row per company: the channel of each kind; without a personal address the confidence is 0.6 of the general one's. chosen: company_id, kind, value, confidence."""
    of = lambda kind, c="value": F.max(F.when(F.col("kind") == kind, F.col(c)))
    wide = chosen.groupBy("company_id").agg(of("direct_email").alias("direct_email"), of("general_email").alias("general_email"), of("contact_form").alias("contact_form"), of("phone").alias("phone"), of("other").alias("other"), of("direct_email", "confidence").alias("_d"), of("general_email", "confidence").alias("_g"))
    return wide.select("company_id", "direct_email", "general_email", "contact_form", "phone", "other", F.round(F.coalesce(F.nullif("_d", F.lit(0.0)), F.col("_g") * 0.6, F.lit(0.0)), 3).alias("email_confidence"))


def report_line(cells: list[Column]) -> Column:
    """A row of a Markdown table; null and '' are shown as -, and a bar inside a cell is escaped."""
    return F.concat(F.lit("| "), F.array_join(F.array(*[F.replace(F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("-")), F.lit("|"), F.lit("\\|")) for c in cells]), " | "), F.lit(" |"))


def escaped(c: Column) -> Column:
    """Text for HTML."""
    out = T.blank(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def write_report(lines: DataFrame, head: list[str], path: str) -> None:
    """A folder of text: the head, then the lines (order, line) in their order, as one file: a report is small, one row per company."""
    top = lines.sparkSession.createDataFrame([(-len(head) + i, x) for i, x in enumerate(head)], "order long, line string")
    lines.select(F.col("order").cast("long"), "line").unionByName(top).orderBy("order").select("line").coalesce(1).write.mode("overwrite").text(path)


def html_row(cells: list[Column]) -> Column:
    """A row of an HTML table, its cells escaped."""
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(c.cast("string")), F.lit("</td>")) for c in cells], F.lit("</tr>"))


def numbered_sources(pages: DataFrame, most: int = 8, characters: int = 1800) -> DataFrame:
    """(company_id, sources): the first pages of each company as a numbered list of title, address and clipped text. pages: company_id, url, title, text, place."""
    order = W.partitionBy("company_id").orderBy("place")
    first = pages.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)
    shown = F.format_string("[%d] %s\nURL: %s\n%s\n", F.col("n"), F.coalesce(F.nullif("title", F.lit("")), T.blank(F.col("url"))), T.blank(F.col("url")), T.clip(F.col("text"), characters))
    # At most so many pages a company are gathered.
    return first.select("company_id", "n", shown.alias("s")).groupBy("company_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]), "\n").alias("sources"))


def every_input(inputs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One result for every input: of repeated results the last by place, and for inputs without any a technical failure. results: key, place, lead_grade, status, failure_category."""
    last = results.groupBy(key).agg(F.max_by(F.struct("lead_grade", "status", "failure_category"), "place").alias("r"))
    joined = inputs.select(key).join(last, key, "left")
    missing = F.struct(F.lit("FAIL").alias("lead_grade"), F.lit("ERROR").alias("status"), F.lit("technical failure").alias("failure_category"))
    return joined.select(key, F.coalesce("r", missing).alias("r")).select(key, "r.*")
