"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from claimforge.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(x):
    return F.lit(x).cast("string")


@pytest.mark.parametrize(
    ("title", "category", "authority"),
    [("Director of Marketing", "executive", 19), ("Managing Director", "executive", 19), ("Vice President", "executive", 19), ("Coordinator", "chief_operating", 20), ("Product Owner", "owner", 24), ("Partnerships", "senior_leader", 16), ("Chief Marketing Officer", "marketing_leader", 9), ("Chief", "chief_executive", 22), ("Editor", "unknown", 4), ("", "unknown", 0), (None, "unknown", 0)],
)
def test_role(spark, title, category, authority):
    assert tuple(value(spark, T.role(lit(title)))) == (category, authority)


@pytest.mark.parametrize(("title", "rank"), [("Founder & President", 16), ("Director", 8), ("Engineer", 0), (None, 0)])
def test_title_rank(spark, title, rank):
    assert value(spark, T.title_rank(lit(title))) == rank


@pytest.mark.parametrize(("text", "hint"), [("1200 employees", ""), ("300 employees", "large"), ("40 staff", "medium"), ("12 people", ""), ("small team", "small"), ("Series A", "large"), (None, "")])
def test_size_hint(spark, text, hint):
    assert value(spark, T.size_hint(lit(text))) == hint


@pytest.mark.parametrize(("name", "key"), [("Frank Verhagen", "verhagen|f"), ("Dr Jane Smith", "smith|d"), ("Cher", "cher"), ("", ""), (None, ""), ("dr jane smith", "smith|j")])
def test_person_key(spark, name, key):
    assert value(spark, T.person_key(lit(name))) == key


@pytest.mark.parametrize(("raw", "email"), [("info@example.com", ""), ("a..b@x.com", ""), ("@x.com", ""), ("no-at-sign", ""), ("Support@Company.com", "support@company.com"), ("www.ireserv@ion.it", ""), (None, ""), ("<jo@acme.io>,", "jo@acme.io")])
def test_normal_email(spark, raw, email):
    assert value(spark, T.normal_email(lit(raw))) == email


@pytest.mark.parametrize(("text", "emails"), [("visit https://example.com/en/ now", []), ("write to Info@Availroom.com", ["info@availroom.com"]), ("jo (at) acme [dot] io, Jo@acme.io", ["jo@acme.io"]), ("that natalie@x.com dotted", ["natalie@x.com"]), (None, [])])
def test_emails(spark, text, emails):
    assert value(spark, T.emails(lit(text))) == emails


@pytest.mark.parametrize(("email", "kind", "confidence"), [("jane.smith@acme.com", "direct", 0.8), ("info@acme.com", "general", 0.7), ("jane@gmail.com", "direct", 0.8), ("jo.x@acme.com", "general", 0.6), ("kim.lee@acme.com", "direct", 0.45), ("zeta@acme.com", "general", 0.4), ("", "", 0.0)])
def test_email_kind(spark, email, kind, confidence):
    assert tuple(value(spark, T.email_kind(F.lit(email), F.array(F.lit("Jane Smith"))))) == (kind, confidence)


@pytest.mark.parametrize(
    ("text", "phones"),
    [("id 2024123456\nTel +44 (0)20 7946 0123\n030 23125 100", ["+44 (0)20 7946 0123", "030 23125 100"]), ("1111111 and 123456789012", []), (None, []), ("call 020 7946 0123 or 02079460123", ["020 7946 0123"])],
)
def test_phones(spark, text, phones):
    assert value(spark, T.phones(lit(text))) == phones


@pytest.mark.parametrize(("url", "yes"), [("https://x.com/directory/frank-verhagen/", True), ("https://x.com/team", True), ("https://x.com/leadership-team.html", True), ("https://x.com/About_Us", True), ("https://x.com/blog/post-1", False), ("https://x.com/products/team-sync", False), ("https://x.com", False), (None, False)])
def test_people_page(spark, url, yes):
    assert value(spark, T.people_page(lit(url))) is yes


@pytest.mark.parametrize(("url", "yes"), [("https://x.com/blog/page/2", False), ("https://x.com/search?q=availroom", False), ("https://play.google.com/store/apps", False), ("https://www.availroom.com/legal", True), ("https://fr.linkedin.com/company/availroom", True), ("", False)])
def test_worth_fetching(spark, url, yes):
    assert value(spark, T.worth_fetching(lit(url))) is yes


@pytest.mark.parametrize(("url", "title", "kind"), [("https://wix.com/a", "", "social_profile"), ("https://acme.io", "Our partners", "partner_announcement"), ("https://acme.io", "", "company_website"), ("https://acme.example", "", "other"), (None, None, "other")])
def test_source_type(spark, url, title, kind):
    assert value(spark, T.source_type(lit(url), lit(title))) == kind


@pytest.mark.parametrize(("country", "language", "found"), [("United States", "English", "spanish"), ("Japan", "Japanese", "japanese"), ("Netherlands", "Dutch", "dutch"), ("", "", "")])
def test_language(spark, country, language, found):
    assert value(spark, T.language(F.lit(country), F.lit(language))) == found


@pytest.mark.parametrize(("title", "yes"), [("Founder & CEO", True), ("Channel Manager - sells rooms. Fast", False), ("Editor", False), ("代表取締役", True), ("", False)])
def test_looks_like_title(spark, title, yes):
    assert value(spark, T.looks_like_title(F.lit(title))) is yes


@pytest.mark.parametrize(("name", "yes"), [("Frank Verhagen", True), ("Channel Manager", False), ("Property Management System", False), ("Duetto Co", False), ("frank verhagen", False), ("Cher", False), ("山田太郎", True), ("Google Fonts", False)])
def test_looks_like_name(spark, name, yes):
    assert value(spark, T.looks_like_name(F.lit(name))) is yes


def test_legal_names_codes_and_quotes(spark):
    assert any("TravelBy Software" in x for x in value(spark, T.legal_names(F.lit("AvailRoom is a product of TravelBy Software S.L., registered in Spain."))))
    assert any("株式会社" in x for x in value(spark, T.legal_names(F.lit("株式会社チャットボットは東京に本社を置く"))))
    assert [tuple(x) for x in value(spark, T.registry_codes(F.lit("HRB 12345, KvK 12345678")))][0] == ("de_register", "12345")
    assert value(spark, T.wechat(F.lit("WeChat: acme_2024"))) == "acme_2024"
    assert value(spark, T.quote_around(F.lit("a  b needle c"), F.lit("NEEDLE"))) == "a b needle c"
    assert value(spark, T.clean_name(F.lit(" Flex IN??? "))) == "Flex IN"


def test_hit_score(spark):
    terms = F.array(F.lit("acme"), F.lit("rail"))
    got = value(spark, T.hit_score(F.lit("https://acme.io/team"), F.lit("Acme team"), F.lit("the rail people"), F.lit("company_website"), F.lit(1), terms))
    assert got == round(1 + 2 * 1.4 + 1.2 + 1.0 + 0.8 + 1.4, 2)
    assert value(spark, T.hit_score(F.lit("https://x.com/a"), F.lit(""), F.lit(""), F.lit("other"), F.lit(1), terms)) == 0
