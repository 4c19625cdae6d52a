import json

import pytest
from pyspark.sql import functions as F

from claimforge.functions import html, matching
from claimforge.functions import text as T
from claimforge.operators import contacts, metrics, people, search, stores
from claimforge.sources import tables

TEAM = """<html><head><title>Team</title><script>if (a<b) {}</script></head><body><table><tr><td>Jane Smith</td><td>Founder & CEO</td></tr></table>
<h3>Marco Rossi</h3><p>Head of Partnerships<p>He joined in 2019 and likes rail.</p><div>Elena Duarte, Managing Director</div><p>Channel Manager - Property Management System</p>
<footer class="footer">Write to <a href="mailto:info@acme.io?x=1">us</a> or <a href="tel:+44 20 7946 0123">call</a> <a href="/about">About us</a></footer>
<form action="/search"><input name="q"></form><form action="/contact" id="contact-form"><input name="email"><textarea name="message"></textarea></form></body></html>"""


def test_page_parts(spark):
    got = html.parse(TEAM, "https://acme.io/team")
    assert got["title"] == "Team" and got["mailto"] == ["info@acme.io"] and got["tel"] == ["+44 20 7946 0123"]
    assert {"url": "https://acme.io/about", "anchor": "About us"} in got["links"] and ["Jane Smith", "Founder & CEO"] in got["rows"]
    assert html.parse(None, "")["blocks"] == [] and html.parse("<p>a<p>b<td", "")["blocks"] == ["a", "b<td"]


def test_people_and_forms_of_a_page(spark):
    pages = spark.createDataFrame([(1, "https://acme.io/team", TEAM), (2, None, None), (3, "https://x.io", "")], "page_id long, final_url string, html string").withColumn("url", F.col("final_url"))
    parsed = html.parse_pages(pages)
    got = {(r.name, r.title) for r in people.page_people(parsed).collect()}
    assert {("Jane Smith", "Founder & CEO"), ("Marco Rossi", "Head of Partnerships"), ("Elena Duarte", "Managing Director")} <= got
    assert not [n for n, _ in got if "Manager" in n or "System" in n]
    assert [(r.page_id, r.url) for r in contacts.contact_forms(parsed).collect()] == [(1, "https://acme.io/contact")]
    assert [r.url for r in search.rank_links(parsed).collect()] == ["https://acme.io/about"]


PEOPLE = "person_id long, company_id long, name string, title string, current_company string, linkedin string, location string, is_current boolean"


@pytest.mark.parametrize("turned", [False, True])
def test_merge_keeps_the_best_title(spark, turned):
    rows = [(1, 1, "Frank Verhagen", "WebRezPro Team Frank Verhagen Founder & ...", None, None, None, True), (2, 1, "Frank Verhagen", "Founder & President", "", "l", None, False), (3, 1, "F. Verhagen", None, "Acme", "m", "x", None), (4, 1, "", "CEO", None, None, None, True), (5, None, "Frank Verhagen", "CEO", None, None, None, True)]
    if turned:
        rows[0], rows[1] = (1, *rows[1][1:]), (2, *rows[0][1:])
    got = {(r.company_id, r.name_key): r for r in people.merge_people(spark.createDataFrame(rows, PEOPLE)).collect()}
    best = got[1, "verhagen|f"]
    assert best.title == "Founder & President" and best.sightings == 3 and best.is_current is False and best.current_company == "Acme" and best.linkedin == "l"
    assert set(got) == {(1, "verhagen|f"), (None, "verhagen|f")}


def test_evidence_dedupe(spark):
    rows = [(1, 1, 1, "title", "v", "u", "short", 0.4), (2, 1, 1, "title", "v", "u", "much longer", 0.3), (3, 1, 1, "title", "v", "u", "tiny", 0.9), (4, 1, 1, "title", "v", "u", "much longer", 0.3), (5, 1, None, "title", "v", "u", None, None)]
    got = {r.person_id: r for r in people.dedupe_evidence(spark.createDataFrame(rows, "evidence_id long, company_id long, person_id long, claim_type string, claim_value string, source_url string, source_text string, confidence double")).collect()}
    assert (got[1].source_text, got[1].confidence, got[1].evidence_id) == ("much longer", 0.4, 2) and got[None].source_text is None


def test_email_pattern(spark):
    rows = [(1, "jo.x@a.io", 1), (1, "al.y@a.io", 2), (1, "info@a.io", 3), (1, "kim@a.io", 4), (2, "kim@a.io", 1)]
    df = spark.createDataFrame(rows, "company_id long, email string, n long").select("company_id", "email", F.struct(F.col("n").alias("id"), F.lit(0).alias("seq")).alias("place"))
    got = {r.company_id: (r.pattern, r.confidence) for r in contacts.email_pattern(df).collect()}
    assert got == {1: ("first.last", 0.64), 2: ("first", 0.5)}
    known = spark.createDataFrame([(9, 1, "Jane Q. Smith"), (8, 1, "Cher")], "person_id long, company_id long, name string")
    firms = spark.createDataFrame([(1, "www.A.io")], "company_id long, domain string")
    out = contacts.inferred_emails(known, contacts.email_pattern(df), firms).collect()
    assert [(r.person_id, r.email, r.confidence) for r in out] == [(9, "jane.smith@a.io", 0.38)]


def test_stores(spark):
    schema = "k string, v int, t int, born int"
    a = spark.createDataFrame([("x", 1, 1, 1), (None, 2, 1, 1)], schema)
    b = spark.createDataFrame([("x", 9, 2, 5), ("y", 3, 1, 5), ("y", 4, 2, 6), (None, 7, 1, 9)], schema)
    assert {(r.k, r.v) for r in stores.insert_ignore(a, b, ["k"], "t").collect()} == {("x", 1), (None, 2), ("y", 3)}
    assert {(r.k, r.v, r.born) for r in stores.upsert(a, b, ["k"], "t", "born").collect()} == {("x", 9, 1), ("y", 4, 5), (None, 7, 1)}
    assert stores.insert_ignore(a.limit(0), b.limit(0), ["k"], "t").count() == 0


def test_histogram_and_rates(spark):
    df = spark.createDataFrame([("A",), ("A",), ("z",)], "g string")
    assert {r.g: (r.rows, r.share) for r in metrics.histogram(df, "g", ["A", "B"]).collect()} == {"A": (2, 66.7), "B": (0, 0.0)}
    assert {r.share for r in metrics.histogram(df.limit(0), "g", ["A"]).collect()} == {0.0}


def test_company_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("﻿Company, Website ,Fit\nFlex IN???,https://www.Flex.example/de,high\n,acme.example,\n,,x\nNoDomain,,y\n", encoding="utf-8")
    got = [(r.row_index, r.company_name, r.domain, r.meta["fit"]) for r in tables.read_companies(spark, str(path)).orderBy("row_index").collect()]
    assert got == [(0, "Flex IN", "flex.example", "high"), (1, "acme.example", "acme.example", "")]
    assert [r.row_index for r in tables.limited(tables.read_companies(spark, str(path)), 1, 1).collect()] == [1]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 0.5)], "id int, urls array<string>, c double")
    tables.write_people_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().urls == "a | b"
    (tmp_path / "r.json").write_text(json.dumps({"count": 2, "results": [{"a": 1}, {"a": 2}]}))
    assert sorted(r.a for r in tables.read_results(spark, str(tmp_path / "r.json")).collect()) == [1, 2]


@pytest.mark.parametrize(("text", "found"), [('x ```json\n{"a": 1}\n``` y', {"a": 1}), ('so {"a": [1, {"b": "}"}]} ok', {"a": [1, {"b": "}"}]}), ("[1, 2]", {"items": [1, 2]}), ("none {", None), (None, None)])
def test_salvage(text, found):
    got = matching.salvage(text)
    assert (None if got is None else json.loads(got)) == found


def test_same_company(spark):
    rows = [("World Web Technologies", True), ("World Web Technologies Inc", True), ("WebRezPro", True), ("World Wide Technology", False), ("WWT", False), ("Duetto Inc", False), ("", True)]
    df = spark.createDataFrame(rows, "c string, want boolean")
    got = df.select("c", "want", matching.same_company(F.col("c"), F.lit("World Web Technologies Inc"), F.array(F.lit("webrezpro"))).alias("got")).collect()
    assert all(r.got == r.want for r in got)


def test_people_queries(spark):
    df = spark.createDataFrame([(1, "WebRezPro", "webrezpro.com", "Japan", "Japanese"), (2, "??", "x.com", None, None), (3, None, None, None, None)], "company_id long, company_name string, domain string, country string, language string")
    got = {(r.company_id, r.query) for r in search.people_queries(df).collect()}
    assert (1, "site:webrezpro.com leadership") in got and (1, "site:webrezpro.com 代表取締役") in got and (1, "site:webrezpro.com team") not in got
    first = [r.query for r in search.initial_queries(df).filter("company_id = 2").orderBy("seq").collect()]
    assert first[0] == '"x.com"' and "x.com founder" in first


def test_stream(spark, tmp_path):
    from claimforge.streaming import arrivals

    rows = spark.sql("SELECT id AS page_id, timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id AS INT)) AS retrieved_at, 'https://a.io/team' AS final_url, 'x' AS title FROM range(5)")
    rows.union(rows).write.parquet(str(tmp_path / "in"))
    source = arrivals.read_pages(spark, str(tmp_path / "in"), rows)
    arrivals.profile_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 5 and out.filter("people_page").count() == 5


def test_snippet_people(spark):
    firm = [(1, "WebRezPro", "World Web Technologies", "WebRezPro", "webrezpro.com", [], None)]
    firms = spark.createDataFrame(firm, "company_id long, canonical_name string, legal_name string, company_name string, domain string, aliases array<string>, size_hint string")
    rows = [
        (1, 1, "https://webrezpro.com/directory", "WebRezPro Team: Frank Verhagen, Founder &amp; President"),
        (2, 1, "https://news.example/a", "WebRezPro works with partners. Peter Gorla, Managing Director of Voila Hotel Rewards"),
        (3, 1, "https://news.example/b", "Duetto Co, Director of WebRezPro"),
        (4, 1, "https://other.example", "Jane Smith, Director"),
        (5, 1, None, None),
    ]
    got = people.snippet_people(spark.createDataFrame(rows, "hit_id long, company_id long, url string, snippet string"), firms).collect()
    assert [(r.name, r.title) for r in got] == [("Frank Verhagen", "Founder & President")]


def test_addresses(spark):
    rows = [("Head office: 12 Main Street, Springfield, IL 62701", 1), ("住所 東京都渋谷区神南1-2-3", 1), ("nothing here", 0), (None, 0)]
    df = spark.createDataFrame(rows, "t string, n int")
    assert all(len(r.a) == r.n for r in df.select("n", T.addresses(F.col("t")).alias("a")).collect())
