import itertools

import pytest
from pyspark.sql import functions as F

from claimforge.llm import titles


@pytest.fixture(scope="module")
def reference(spark):
    rows = [(1, "Founder", "founder"), (2, "Co-Founder", "founder"), (3, "Owner", "owner"), (4, "Chief Executive Officer", "x"), (5, "Managing Director", "x"), (13, "President", "x"), (14, "Vice President", "x"), (26, "Product Owner", "x"), (90, "Night Sky Warden", "x"), (91, None, "x")]
    return spark.createDataFrame(rows, "role_id int, canonical_title string, role_category string")


def test_titles(spark, reference):
    cases = {
        "Founder": 1, "  FOUNDER ": 1, "Foudner (f/m/d)": 1, "co founder": 2, "CoeFounder": 2, "Gruenderin": 1, "創業者, Firma": 1,
        "President, Vice, Penazede": 14, "President, Penazede": 13, "Officer, Chief Executive": 4, "Title - C.E.O.": 4,
        "Geschaeftsfuehrer bei Mellona": 5, "Owner, Product @ Foo": 26, "Night  Sky Wardne": 90, "présidente": 13,
        "Assistant to the CEO": -1, "Wife of the owner": -1, "Driver": -1, "-": -1, "受付": -1, "x" * 20_000: -1,
    }
    rows = [(i, t, "r") for i, t in enumerate(cases)] + [(500, None, "r"), (501, "  ", "r"), (502, "", "r"), (0, "Founder", "r")]
    people = spark.createDataFrame(rows, "person_id long, title string, role_id string")
    got = titles.match_titles(people, reference).collect()
    assert len(got) == len(cases) + 1
    assert {r.title: r.role_id for r in got} == cases
    assert titles.match_titles(people.limit(0), reference).count() == 0
    assert {r.role_id for r in titles.match_titles(people, reference.limit(0)).collect()} == {-1}


def test_join_finds_every_similar_pair(spark):
    """The prefix, length and positional filters lose no pair of Jaccard t or more."""
    words = ["founder", "fonder", "founders", "cofounder", "owner", "onwer", "manager", "amnager", "managre", "managerin", "aaa", "aaaa", "po", "op", "presidente", "president", "prseident"]
    known = ["founder", "owner", "manager", "president", "aaaa", "po"]
    sets = {w: {("^" + w + "$")[i : i + 2] for i in range(len(w) + 1)} for w in words + known}
    want = {(a, b) for a, b in itertools.product(words, known) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}
    original, titles._typing_error = titles._typing_error, lambda a, b, d: F.lit(True)
    try:
        found = titles.match_forms(spark.createDataFrame([(w,) for w in words], "form string"), spark.createDataFrame(list(zip(known, range(9))), "form string, role_id int"))
        got = {(r.form, known[r.role_id]) for r in found.collect()}
    finally:
        titles._typing_error = original
    assert got == want
