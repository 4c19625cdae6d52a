from datetime import datetime

import pytest

from claimforge.llm import survivor

SCHEMA = "version_id long, person_key long, title string, location string, linkedin string, confidence double, sources array<string>, retrieved_at timestamp, loaded_at timestamp, value string, field int"
GOOD = "https://a.example/in/jo-1"


def day(n):
    return None if n is None else datetime(2024, 1, n)


@pytest.fixture(scope="module")
def versions(spark):
    rows = [
        # person 1: title settled by the latest and most confident record; location differs; link only once usable.
        (1, 1, "CEO", "Lund", "#", 0.9, ["https://x.example/a"], day(5), day(6), None, 0),
        (2, 1, "Founder", "Bergen", GOOD, 0.5, ["https://y.example/a"], day(2), day(3), None, 0),
        (3, 1, "Found…", "Oslo", "https://a.example/in/", 0.95, ["https://z.example/a"], day(4), day(6), None, 0),
        # person 2: repeated rows; person 3: a single row; person 4: nothing usable.
        (4, 2, "CTO", None, None, 0.5, [], day(2), day(9), None, 0),
        (5, 2, "CTO", None, None, 0.5, None, day(2), day(8), None, 0),
        (6, 3, "CTO", "Rome", GOOD, 0.5, [], day(2), day(9), None, 0),
        (7, 4, "n/a", "", "profile", 0.5, [], day(2), day(9), None, 0),
        (8, 4, None, "Earth", None, None, None, None, None, None, 0),
        (9, None, "CTO", "Rome", None, 0.5, [], day(2), day(9), None, 0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_resolve(versions):
    got = {(r.person_key, r.field): (r.value, r.version_id, r.settled) for r in survivor.resolve(versions).collect()}
    assert got[1, "title"] == ("CEO", 1, True)
    assert got[1, "linkedin"] == (GOOD, 2, True)
    assert got[1, "location"][2] is False
    assert got[2, "title"] == ("CTO", 5, True) and got[3, "location"] == ("Rome", 6, True)
    assert not [k for k in got if k[0] in (4, None)]


def test_people(versions):
    got = {r.person_key: r for r in survivor.people(versions).collect()}
    assert set(got) == {1, 2, 3, 4} and got[4].title is None and got[4].sources == [] and got[1].title == "CEO"
    assert got[1].records == 3 and "https://x.example/a" in got[1].sources


def test_reliable_sources_win(spark):
    """Where latest and most confident differ, the value of the source that was right elsewhere survives."""
    rows, v = [], 0
    for p in range(40):
        for title, source, c, d in (("CEO", "good", 0.9, 9), ("CFO", "bad", 0.4, 3)):
            v += 1
            rows.append((v, p, title, None, None, c, [f"https://{source}.example/{p}"], day(d), day(10), None, 0))
    rows += [(1000, 99, "CEO", None, None, 0.5, ["https://good.example/q"], day(3), day(10), None, 0), (1001, 99, "CFO", None, None, 0.45, ["https://bad.example/q"], day(9), day(10), None, 0), (1002, 99, "CFO", None, None, 0.3, ["https://bad.example/r"], day(2), day(10), None, 0)]
    got = {r.person_key: r.value for r in survivor.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[99] == "CEO" and got[0] == "CEO"


def test_empty(versions):
    assert survivor.resolve(versions.limit(0)).count() == 0 and survivor.people(versions.limit(0)).count() == 0


@pytest.mark.parametrize(("field", "value", "good"), [("title", "C.E.O.", True), ("title", "account exec.", True), ("title", "Own ..", False), ("title", "Fou-", False), ("title", "Own… more", False), ("title", "View profile", False), ("title", "社長", True), ("title", "???", False), ("location", "Saint-Orvan", True), ("location", "Earth", False), ("linkedin", GOOD, True), ("linkedin", "https://a.example/", False), ("linkedin", "https://a.example/in/", False), ("linkedin", None, False)])
def test_usable(spark, field, value, good):
    from pyspark.sql import functions as F

    assert spark.range(1).select(survivor.usable(field, F.lit(value).cast("string"))).first()[0] is good


def test_unfinished_rounds_are_an_error(spark):
    """Two sources contest many persons: the weights move for more than one round, and stand in the end."""
    rows = []
    for p in range(20):
        rows.append((2 * p, p, "Chief", None, None, 0.9, ["https://a.example/x"], day(1), day(1), None, 0))
        rows.append((2 * p + 1, p, "Head" if p % 3 else "Chief", None, None, 0.5, ["https://b.example/x"], day(2), day(2), None, 0))
    df = spark.createDataFrame(rows, SCHEMA)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        survivor.resolve(df, rounds=1, tolerance=1e-9)
    tight = {r.person_key: r.share for r in survivor.resolve(df, tolerance=1e-4).collect()}
    tighter = {r.person_key: r.share for r in survivor.resolve(df, tolerance=1e-5).collect()}
    assert all(abs(tight[p] - tighter[p]) < 0.01 for p in tight) and len(tight) == 20


def exact(rows):
    """The method in plain Python, for usable titles only: (reliability by source, winner by person)."""
    claims = {}
    for v, p, title, source, c, d in rows:
        claims.setdefault(p, []).append((title.lower(), source, c, d, v))
    votes, ends = {}, {}
    for p, own in claims.items():
        latest, surest = max(own, key=lambda x: (x[3], x[2], -x[4])), max(own, key=lambda x: (x[2], x[3], -x[4]))
        ends[p] = latest[0], surest[0]
        for t, s, c, _, _ in own:
            w, n = votes.get((p, t, s), (0.0, 0))
            votes[p, t, s] = w + c, n + 1
        for name, t in ((survivor.LATEST, latest[0]), (survivor.SUREST, surest[0])):
            votes[p, t, name] = 0.0, 1
    decided = lambda p: ends[p][0] == ends[p][1]
    mean = lambda hits, n: (hits + survivor.PRIOR / 2) / (n + survivor.PRIOR)
    sources = {s for _, _, s in votes}
    fixed = {s: (sum(n * (t == ends[p][0]) for (p, t, x), (_, n) in votes.items() if x == s and decided(p)), sum(n for (p, t, x), (_, n) in votes.items() if x == s and decided(p))) for s in sources}
    r = {s: mean(*fixed[s]) for s in sources}

    def shares():
        s_of, b_of = {}, {}
        for (p, t, s), (w, _) in votes.items():
            witness = s in (survivor.LATEST, survivor.SUREST)
            s_of[p, t] = s_of.get((p, t), 0.0) + (0.0 if witness else w * r[s])
            b_of[p, t] = b_of.get((p, t), 0.0) + (survivor.WITNESS * max(r[s], survivor.FLOOR) if witness else 0.0)
        whole = {p: (sum(x for (q, _), x in s_of.items() if q == p), sum(x for (q, _), x in b_of.items() if q == p), sum(q == p for q, _ in s_of)) for p in claims}
        return {(p, t): ((x / whole[p][0] if whole[p][0] > 0 else 1 / whole[p][2]) + b_of[p, t]) / (1 + whole[p][1]) for (p, t), x in s_of.items()}

    for _ in range(survivor.ROUNDS):
        now = shares()
        new = {s: mean(fixed[s][0] + sum(now[p, t] * n for (p, t, x), (_, n) in votes.items() if x == s and not decided(p)), fixed[s][1] + sum(n for (p, _, x), (_, n) in votes.items() if x == s and not decided(p))) for s in sources}
        moved, r = max(abs(new[s] - r[s]) for s in sources), new
        if moved <= survivor.TOLERANCE:
            break
    now = shares()
    return r, {p: max((now[q, t], max((d, c, -v) for x, _, c, d, v in claims[p] if x == t), t) for q, t in now if q == p)[2] for p in claims}, ends


def test_planted_conflicts_against_an_exact_model(spark):
    import random

    rng = random.Random(6)
    rows, v = [], 0
    for p in range(80):
        truth = rng.choice(["CEO", "CFO", "CTO"])
        for _ in range(rng.randint(1, 6)):
            v += 1
            source = rng.choice(["good", "fair", "bad"])
            right = rng.random() < {"good": 0.95, "fair": 0.7, "bad": 0.2}[source]
            rows.append((v, p, truth if right else rng.choice(["Clerk", "Buyer"]), source, round(rng.uniform(0.4, 1) if right else rng.uniform(0.1, 0.8), 3), rng.randint(1, 28)))
    r, winners, ends = exact(rows)
    df = spark.createDataFrame([(v, p, t, None, None, c, [f"https://{s}/x"], day(d), day(1), None, 0) for v, p, t, s, c, d in rows], SCHEMA)
    claimed = survivor.claims(df)
    got = {x.source: x.r for x in survivor.reliabilities(survivor._votes(claimed, survivor.witnesses(claimed))).collect()}
    assert got.keys() == r.keys() and all(abs(got[s] - r[s]) < 1e-6 for s in r) and r["good"] > r["fair"] > r["bad"]
    resolved = {x.person_key: x for x in survivor.resolve(df).collect()}
    assert {p: x.value.lower() for p, x in resolved.items()} == winners
    contested = [p for p, (a, b) in ends.items() if a != b]
    # The vote decides: neither the latest nor the most confident value wins always.
    assert {winners[p] == ends[p][0] for p in contested} == {True, False} == {winners[p] == ends[p][1] for p in contested}
    assert all(winners[p] == a for p, (a, b) in ends.items() if a == b) and any(x.settled for x in resolved.values()) and not all(x.settled for x in resolved.values())
