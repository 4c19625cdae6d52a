import random

import pytest

from claimforge.llm import variants


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("r", [1, 2, 3])
def test_radius_join_is_exact(spark, r):
    rng = random.Random(r)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(120)} | {"a", "ab", "koestenbach", "kostenbach", "kostenbahc"}
    rows = [(block, w) for block in "xy" for w in sorted(words) if block == "x" or rng.random() < 0.5]
    got = {(x.block, x.a, x.b): x.d for x in variants.radius_join(spark.createDataFrame(rows + rows[:9] + [("x", ""), (None, "abc"), ("x", None)], "block string, s string"), r).collect()}
    want = {}
    for i, (p, a) in enumerate(rows):
        for q, b in rows[i + 1 :]:
            if p == q and a != b and (d := distance(a, b)) <= r:
                want[(p, *sorted((a, b), key=lambda s: (len(s), s)))] = d
    assert got == want


@pytest.mark.parametrize(
    ("name", "parts"),
    [
        ("Dr. Anna B. Kostley", ("kostley", "anna")), ("KOSTLEY Anna", ("kostley", "anna")), ("Kostley, Anna", ("kostley", "anna")), ("Kostley A.", ("kostley", "a")),
        ("A. Kostley", ("kostley", "a")), ("ANNA KOSTLEY", ("kostley", "anna")), ("Søren Køst-Bäck", ("kostback", "soren")), ("", None), (None, None), ("Cher", None), (",", None),
    ],
)
def test_person_parts(name, parts):
    assert variants.person_parts(name) == parts


def test_people(spark):
    names = {1: "Margaret Kostley", 2: "Peggy Kostley", 3: "KOSTLEY, Magraret", 4: "M. Kostley", 5: "Hugo Kostley", 6: "Margaret Kostley", 7: None, 8: "", 9: "Oscar Lind", 10: "Omar Lind"}
    rows = [(i, 1, n, "x") for i, n in names.items()] + [(20, 2, "Margaret Kostley", "x"), (21, None, "Margaret Kostley", "x")]
    df = spark.createDataFrame(rows, "person_id long, company_id long, name string, s string")
    got = {(r.id_a, r.id_b) for r in variants.person_pairs(df).collect()}
    group = [1, 2, 3, 4, 6]
    assert got == {(a, b) for a in group for b in group if a < b}
    assert variants.person_pairs(df.limit(0)).count() == 0


def test_companies(spark):
    rows = [
        (1, "Vorelmanta Travel Systems Ltd", ["VTS"]), (2, "Travel Sys., Vorelmatna Limited", None), (3, "Vorelmanta Timber Systems Ltd", []), (4, "Sunhub", ["The Vorel-Manta Travel"]),
        (5, None, ["VTS"]), (6, "", None), (7, "Vorelmanta Travel Systems Ltd", []), (8, "Vorelmanta Travel Logistics Ltd", []),
    ]
    df = spark.createDataFrame([(i, n, None, a, 1) for i, n, a in rows], "company_id long, legal_name string, canonical_name string, aliases array<string>, id_a int")
    got = {(r.id_a, r.id_b) for r in variants.company_pairs(df).collect()}
    assert {(1, 2), (1, 4), (1, 7), (2, 4), (2, 7), (4, 7)} <= got and not {p for p in got if {3, 5, 6} & set(p)} and (1, 8) not in got
    assert variants.company_pairs(df.limit(0)).count() == 0


def test_a_firm_under_many_domains_keeps_its_links(spark):
    """One firm on twenty rows, a word with many brands, and names of common words alone."""
    brands = ["balvori", "cendulat", "dorvenik", "fasilmo", "gurentap", "hilvasto", "jokamend", "kestrupo", "lavondir", "mirtelka", "nostuvel", "pardimon", "quelvast", "rostibel"]
    rows = [(i, "Menulorso Travel Services Ltd") for i in range(20)] + [(20, "Menulrso Travel"), (21, "Menulorso Travel")]
    rows += [(100 + i, f"{b.title()} Dental GmbH") for i, b in enumerate(brands)] + [(130, "Dental Balvori"), (131, "Dental Ltd"), (132, "Dental Ltd"), (140, "Travel Services Ltd"), (141, "Travel Services")]
    df = spark.createDataFrame([(i, n, None, None) for i, n in rows], "company_id long, legal_name string, canonical_name string, aliases array<string>")
    got = {(r.id_a, r.id_b) for r in variants.company_pairs(df).collect()}
    assert got == {(a, b) for a in range(22) for b in range(a + 1, 22)} | {(100, 130), (131, 132), (140, 141)}


def test_pairs_of_a_hot_class(spark, monkeypatch):
    """Classes cut into pieces give the same pairs."""
    members = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, 2) for i in range(38, 45)] + [(99, 3)], "id long, class_id long")
    links = spark.createDataFrame([(1, 2), (2, 1)], "class_a long, class_b long")
    want = {(a, b) for a in range(45) for b in range(a + 1, 45)}
    assert {tuple(r) for r in variants.pairs(members, links).collect()} == want
    monkeypatch.setattr(variants, "PIECE", 7)
    got = [tuple(r) for r in variants.pairs(members, links).collect()]
    assert set(got) == want and len(got) == len(want) and variants.pairs(members.limit(0), links.limit(0)).count() == 0


def test_what_is_found_is_written_and_pairs_are_not_shuffled(spark):
    """The driver holds no plan of the whole search, and the pairs, by far the most rows, go through no aggregate."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    keys = spark.createDataFrame([("x", "koestenbach"), ("x", "kostenbach"), ("y", "kostenbahc")], "block string, s string")
    near = variants.radius_join(keys, 2)
    assert [tuple(r) for r in near.collect()] == [("x", "kostenbach", "koestenbach", 1)] and "Join" not in plan(near) and "Exchange" not in plan(near)
    rng = random.Random(4)
    of = {(i, c) for i in range(30) for c in rng.sample(range(9), rng.randint(1, 3))}
    linked = {(1, 2), (2, 1), (3, 3), (4, 7)}
    members = spark.createDataFrame(sorted(of) + [(None, 1), (5, next(c for i, c in of if i == 5))], "id long, class_id long")
    got = variants.pairs(members, spark.createDataFrame(sorted(linked), "class_a long, class_b long"))
    want = sorted({(i, j) for i, c in of for j, d in of if i < j and (c == d or {(c, d), (d, c)} & linked)})
    assert sorted(tuple(r) for r in got.collect()) == want and "Aggregate" not in plan(got)


@pytest.mark.parametrize("whole", [1, 1000])
def test_whole_blocks_and_cells_give_the_same(spark, monkeypatch, whole):
    """Also with keys of over 255 letters."""
    monkeypatch.setattr(variants, "WHOLE", whole)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(40)} | {"c" * 300, "c" * 299 + "d", "c" * 302, "c" * 303})
    got = {(x.block, x.a, x.b): x.d for x in variants.radius_join(spark.createDataFrame([("x", w) for w in words], "block string, s string"), 2).collect()}
    order = lambda s: (len(s), s)
    assert got == {("x", *sorted((a, b), key=order)): d for i, a in enumerate(words) for b in words[i + 1 :] if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2}


def test_common_words_come_from_the_table(spark):
    """Words that stand with many brands are common, in a trade that no list names."""
    brands = ["balvori", "cendulat", "dorvenik", "fasilmo", "gurentap", "hilvasto", "jokamend", "kestrupo", "lavondir", "mirtelka", "nostuvel", "pardimon", "quelvast", "rostibel"]
    trades = ["Falconry", "Cheesemaking"]
    names = [f"{b.title()} {t} Ltd" for b in brands for t in trades] + ["Balvori Flaconry", "Falconry Cendulat GmbH", "Dorvenki Falconry"]
    df = spark.createDataFrame([(i, n, None, None) for i, n in enumerate(names)], "company_id long, legal_name string, canonical_name string, aliases array<string>")
    got = {tuple(sorted((names[r.id_a], names[r.id_b]))) for r in variants.company_pairs(df).collect()}
    assert got == {("Balvori Falconry Ltd", "Balvori Flaconry"), ("Cendulat Falconry Ltd", "Falconry Cendulat GmbH"), ("Dorvenik Falconry Ltd", "Dorvenki Falconry")}


def test_finder_of_words_one_slip_away():
    rng = random.Random(2)
    known = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(60)})
    find = variants._near(known)
    for _ in range(500):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(3, 8)))
        want = [k for k in known if len(k) >= 5 and (distance(w, k) <= 1 or (len(w) == len(k) and any(w[:i] + w[i + 1] + w[i] + w[i + 2 :] == k for i in range(len(w) - 1))))]
        assert find(w) == (want[0] if want else None)
