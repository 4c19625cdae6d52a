"""Recorded answers, failover, proposals, batches: small cases with edges."""

from pyspark.sql import functions as F

from claimforge.operators import facts, identity, selection
from claimforge.sources import responses


def test_json_hits(spark):
    web = '{"web": {"results": [{"url": "ftp://x"}, {"url": " https://a.com/x ", "title": "T", "description": "D"}, {"title": "no address"}, {"url": "https://b.com"}]}}'
    meta = '{"results": [{"url": "https://a.com", "title": "T", "content": "", "score": 2.5}, {"url": "https://b.com", "engine": "alpha", "content": "C"}]}'
    rows = [(1, web), (2, meta), (3, None), (4, ""), (5, "<html>"), (6, "[]"), (7, '{"web": null, "results": []}')]
    answers = spark.createDataFrame(rows, "id int, body string")
    got = [(r.id, r.position, r.url, r.title, r.snippet, r.engine) for r in responses.json_hits(answers, responses.WEB).orderBy("id", "position").collect()]
    assert got == [(1, 2, "https://a.com/x", "T", "D", "web"), (1, 4, "https://b.com", "", "", "web")]
    got = [(r.id, r.position, r.snippet, r.engine, r.score) for r in responses.json_hits(answers, responses.META).orderBy("id", "position").collect()]
    assert got == [(2, 1, "T", "meta", 2.5), (2, 2, "C", "alpha", 0.0)]
    assert responses.json_hits(answers, responses.WEB, 1).count() == 1 and responses.json_hits(answers.limit(0), responses.META).count() == 0


def test_unwrapped(spark):
    links = ["//go.example/l/?uddg=https%3A%2F%2Fa.com%2Fx%3Fy%3D1&rut=z", "https://a.com", None, "//go.example/?uddg=%ZZ"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i int, u string").select("i", responses.unwrapped(F.col("u")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == ["https://a.com/x?y=1", "https://a.com", "", None]


def test_first_answer(spark):
    hits = spark.createDataFrame([("q", 2, 1), ("q", 1, 5), ("q", 1, 4), ("r", 2, 1), (None, 1, 1)], "query string, service int, place int")
    got = sorted((r.query, r.service, r.place, r["rank"]) for r in responses.first_answer(hits, ["query"]).collect())
    assert got == [("q", 1, 4, 1), ("q", 1, 5, 2), ("r", 2, 1, 1)] and responses.first_answer(hits, ["query"], most=1).count() == 2


def test_overlay(spark):
    schema = "company_id int, canonical_name string, legal_name string, country string, language string, aliases array<string>, confidence double"
    base = spark.createDataFrame([(1, "A", "A Ltd", None, "en", ["x"], 0.2), (2, "B", None, "DE", None, None, 0.5), (3, "C", None, None, None, [None, "c"], None)], schema)
    said = spark.createDataFrame([(1, "AA", "", "UK", None, ["x", "y", ""], 1.7, ["https://a.com"]), (2, None, "B AG", "", "", None, 0.9, ["https://nowhere"])], schema + ", source_urls array<string>")
    known = spark.createDataFrame([(1, "https://a.com"), (2, "https://a.com")], "company_id int, url string")
    got = {r.company_id: tuple(r)[1:] for r in identity.overlay(base, said, known).collect()}
    assert got[1] == ("AA", "A Ltd", "UK", "en", ["x", "y"], 1.0) and got[2] == ("B", "B AG", "DE", None, [], 0.3) and got[3] == ("C", None, None, None, [None, "c"], None)
    assert identity.overlay(base, said.limit(0), known).count() == 3 and identity.overlay(base.limit(0), said, known).count() == 0


def test_every_input_and_finalised_people(spark):
    inputs = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    results = spark.createDataFrame([(1, 1, "A", "OLD", None), (1, 2, "B", "NEW", None), (9, 1, "A", "X", None)], "k int, place int, lead_grade string, status string, failure_category string")
    assert sorted(map(tuple, facts.every_input(inputs, results, "k").collect())) == [(1, "B", "NEW", None), (2, "FAIL", "ERROR", "technical failure"), (3, "FAIL", "ERROR", "technical failure")]
    people = spark.createDataFrame([(1, 10, "x"), (1, 11, "y"), (2, 20, None)], "company_id int, person_id int, supported string").drop("supported")
    kept = spark.createDataFrame([(1, 11), (1, 11), (2, 99), (1, None)], "company_id int, person_id int")
    assert sorted((r.person_id, r.supported) for r in selection.supported_or_all(people, kept).collect()) == [(11, True), (20, False)]
    pages = spark.createDataFrame([(1, f"u{i}", None if i % 2 else f"t{i}", "x" * 3000 if i == 0 else None, i) for i in range(10)], "company_id int, url string, title string, text string, place int")
    text = facts.numbered_sources(pages).first().sources
    assert text.startswith("[1] t0\nURL: u0\n" + "x" * 900 + "\n...[truncated]...") and "[2] u1\n" in text and "[8]" in text and "[9]" not in text
