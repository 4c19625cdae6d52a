"""Support, identity evidence, pages to fetch, facts, failures, reports, names: small cases with edges."""

import pytest
from pyspark.sql import functions as F

from claimforge.functions import text as T
from claimforge.functions.matching import salvage
from claimforge.operators import facts, metrics, selection


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_supported(spark):
    known = [(1, "https://a.example/team/"), (1, None), (1, "https://web.example/copy/http://b.example/x"), (2, "https://c.example/")]
    cases = {1: (1, "https://a.example/team"), 2: (1, "https://a.example/team/"), 3: (1, "https://a.example/team/x"), 4: (1, "http://b.example/x"), 5: (2, "https://a.example/team"), 6: (1, ""), 7: (1, None), 8: (3, ""), 9: (1, "/copy/"), 10: (None, "https://a.example/team"), 11: (1, "team")}
    evidence = spark.createDataFrame([(i, c, 5, u, "x") for i, (c, u) in cases.items()] + [(1, 1, 5, "https://a.example/team", "again")], "evidence_id long, company_id long, person_id long, source_url string, url string")
    urls = spark.createDataFrame(known, "company_id long, url string")
    got = selection.supported(evidence, urls)
    assert sorted(r.evidence_id for r in got.collect()) == [1, 1, 2, 4, 6, 7, 9, 11] and got.columns == evidence.columns
    people = selection.supported_people(got).orderBy("first_id", "source_url").collect()
    assert sum(r["items"] for r in people) == 8 and [r.source_url for r in people][:2] == ["https://a.example/team", "https://a.example/team/"]
    assert selection.supported(evidence.limit(0), urls).count() == 0 and selection.supported(evidence, urls.limit(0)).count() == 0


def test_supported_against_brute_force(spark):
    import random

    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("ab/") for _ in range(rng.randint(0, n)))
    known, claims = [(rng.randint(1, 2), text(30)) for _ in range(60)], [(i, rng.randint(1, 2), text(12)) for i in range(200)]
    got = selection.supported(spark.createDataFrame([(i, c, u) for i, c, u in claims], "evidence_id long, company_id int, source_url string"), spark.createDataFrame(known, "company_id int, url string"))
    assert {r.evidence_id for r in got.collect()} == {i for i, c, u in claims if any(c == k and u in v for k, v in known)}


def test_identity_evidence(spark):
    companies = [
        (1, "a.example", "Acme", "Acme Works GmbH", "Germany", None, ["https://gone.example", "https://a.example/imprint"], 0.9),
        (2, "b.example", "B", None, "", "x", [], 7.0),
        (3, "c.example", "C", None, None, None, None, None),
    ]
    companies = spark.createDataFrame(companies, "company_id long, domain string, canonical_name string, legal_name string, country string, language string, evidence_urls array<string>, confidence double")
    pages = spark.createDataFrame([(5, 1, "https://a.example/imprint", None, "Old", "old"), (6, 1, "https://a.example/imprint", None, "Imprint", "x " * 100 + "Acme Works GmbH, Street 5"), (7, 2, None, "https://b.example", None, None)], "page_id long, company_id long, final_url string, url string, title string, text string")
    got = {(r.company_id, r.claim_type): r for r in selection.identity_evidence(companies, pages).collect()}
    assert set(got) == {(1, "company_name"), (1, "legal_name"), (1, "country"), (2, "domain")}
    legal = got[1, "legal_name"]
    assert "Acme Works GmbH" in legal.source_text and legal.source_title == "Imprint" and legal.confidence == 0.9 and got[1, "country"].confidence == 0.72
    assert got[1, "country"].source_text == "country per resolved identity (n/a)" and got[2, "domain"].source_url == "https://b.example"
    assert selection.identity_evidence(companies.limit(0), pages).count() == 0 and selection.identity_evidence(companies, pages.limit(0)).count() == 0


def test_pages_to_fetch(spark):
    companies = spark.createDataFrame([(1, "a.example"), (2, None)], "company_id long, domain string")
    urls = ["https://a.example/team", "https://x.example/1", "https://x.example/1", "https://m.facebook.com/a", "https://y.example/tag/z", "https://y.example/2", "https://z.example/3", "https://www.a.example/about-us", None, ""]
    hits = spark.createDataFrame([(1, "q", u, i) for i, u in enumerate(urls)], "company_id long, query string, url string, place int")
    assert [(r.url, r.rank) for r in selection.off_site_pages(hits, companies, 2).orderBy("rank").collect()] == [("https://x.example/1", 1), ("https://y.example/2", 2)]
    assert selection.off_site_pages(hits, companies, None).count() == 3
    fetched = spark.createDataFrame([(1, "https://a.example/team")], "company_id long, url string")
    assert [r.url for r in selection.people_pages(hits, companies, fetched).collect()] == ["https://www.a.example/about-us"]
    assert [r.rank for r in selection.unseen_results(hits, fetched, 3).orderBy("rank").collect()] == [2, 3]
    assert selection.people_pages(hits.limit(0), companies, fetched).count() == 0


HTML = """<html><head><style>@font-face{src:url(x@2x.png)}</style></head><body><footer><p>Write to <a href="mailto:info@availroom.com?subject=x">info@availroom.com</a> or <a href="tel:+34 911 234 567">call</a></p><a href="https://www.linkedin.com/company/x">in</a></footer>
<form id="cookie-consent"><input type="checkbox"></form><form action="/contact"><input name="email"><textarea name="message"></textarea></form><table><tr><td>Jane Smith</td><td>Founder & CEO</td></tr></table></body></html>"""


def test_page_facts(spark):
    rows = [(1, "https://x.com/p", "https://x.com/p", HTML, "Tel: +34 933 111 222\nAvailRoom is a product of TravelBy Software S.L., registered in Spain."), (1, "https://x.com/p", "https://x.com/p", HTML, "Tel: +34 933 111 222\nAvailRoom is a product of TravelBy Software S.L., registered in Spain."), (2, None, None, None, None), (3, "https://y.com", None, "", "")]
    got = {r.page_id: r for r in facts.page_facts(spark.createDataFrame(rows, "page_id long, final_url string, url string, html string, text string")).collect()}
    assert set(got) == {1, 2, 3} and got[2].emails == [] == got[3].people
    page = got[1]
    assert page.emails == ["info@availroom.com"] and len(page.phones) == 2 and page.contact_forms == ["https://x.com/contact"] and [s.network for s in page.socials] == ["linkedin"]
    assert [(p.name, p.title) for p in page.people] == [("Jane Smith", "Founder & CEO")] and any("TravelBy Software" in n for n in page.legal_names)


@pytest.mark.parametrize(("a", "b", "want"), [("Jane Smith", "Marco Rossi", True), ("Jane Smith", "John Smith", False), ("Jane Smith", "J. Smith", False), ("", "Jane Smith", False), (None, None, False), ("Jane of Oz", "Marco of Rossi", True), ("Cher", "Cher", False)])
def test_names_conflict(spark, a, b, want):
    assert one(spark, T.names_conflict(F.lit(a).cast("string"), F.lit(b).cast("string"))) is want


def test_short_texts(spark):
    assert one(spark, T.clip(F.lit(" " + "a" * 30 + "b" * 30), 10)) == "aaaaa\n...[truncated]...\nbbbbb" and one(spark, T.clip(F.lit(None).cast("string"), 10)) == ""
    assert [one(spark, T.clamped(F.lit(v).cast("double"))) for v in (None, -1.0, 0.4, 3.0)] == [0.0, 0.0, 0.4, 1.0]
    assert one(spark, T.bot_wall(F.lit("Just a moment" + "." * 100))) and one(spark, T.bot_wall(F.lit("short"))) and not one(spark, T.bot_wall(F.lit("A long and honest text. " * 9)))
    assert one(spark, T.legal_names(F.lit("Send Mail Here Acme Works Ltd now"))) == ["Acme Works Ltd"] and one(spark, T.legal_names(F.lit(None).cast("string"))) == []
    assert len(one(spark, T.phones(F.lit("\n".join(f"+49 30 12345{i:02d}" for i in range(12))), None))) == 12 and len(one(spark, T.phones(F.lit("\n".join(f"+49 30 12345{i:02d}" for i in range(12)))))) == 8
    assert salvage("x" * 200_000 + '{"a": 1}') is None and salvage("x" * 200_000 + '{"a": 1}', None) == '{"a": 1}'
    assert one(spark, facts.escaped(F.lit("<a href=\'x\'>&"))) == "&lt;a href=&#x27;x&#x27;&gt;&amp;"


def test_failures(spark):
    rows = [("A", "ERROR", None), ("FAIL", "ERROR", None), ("FAIL", "ODD", ""), (None, "FAILED_DOMAIN", None), ("FAIL", "ERROR", "blocked")]
    got = {r.category: (r.results, r.place) for r in metrics.failures(spark.createDataFrame(rows, "lead_grade string, status string, failure_category string")).collect()}
    assert got == {"entity failure": (0, 0), "person failure": (0, 1), "contact failure": (0, 2), "wrong/invalid domain": (1, 3), "insufficient evidence": (1, 4), "technical failure": (1, 5), "blocked": (1, 6)}


def test_report(spark, tmp_path):
    lines = spark.createDataFrame([(i, f"row {i}") for i in range(5)], "order long, line string")
    facts.write_report(lines, ["# Report", ""], str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split("\n")[:4] == ["# Report", "", "row 0", "row 1"]
    assert one(spark, facts.report_line([F.lit("a|b"), F.lit(None), F.lit("")])) == "| a\\|b | - | - |"
    none = F.lit(None).cast("string")
    assert one(spark, facts.summary_line(F.lit("Acme"), F.lit("Acme Ltd"), F.lit("UK"), F.lit("Jo"), none, none, F.lit("i@a.example"), none)) == "Acme (Acme Ltd) [UK] - Jo <i@a.example>" and one(spark, facts.summary_line(none, none, none, none, none, none, none, none)) == "unresolved company"
