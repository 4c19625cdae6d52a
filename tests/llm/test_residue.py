import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimforge.llm import residue

GOOD = ["The ferry leaves at nine and waits for the last train if the guard rings the bell.", "In a template you write {{guest}} and the system puts in the guest's name before the message is sent.", "We use cookies. Accept all | Reject", "Error 404 was the most frequent ticket in 2017; after the move it fell to 3 cases.", "Nothing was found in the old barn but a bell.", "Our designers never start from lorem ipsum: each draft is made with real room names and real prices."]
BAD = ["Page not found", "PAGE NOT FOUND", "Acme Works - Page not found", "404 - page not found [a0f3]", "The bell tower was built by {{name}} in 1903.", "{COMPANY} - %%CITY%%", "Lorem ipsum dolor sit amet consectetur", "Welcome to undefined, your partner for null.", "Ihr Browser wird nicht unterstützt!", "Website coming soon /index"]


def test_pages(spark):
    texts = [(i, "Home\n" + t, "k") for i, t in enumerate(GOOD)] + [(100 + i, "Home\n" + t + "\nContact", "k") for i, t in enumerate(BAD)] + [(200, None, "k"), (201, "", "k"), (202, "  \n ", "k"), (100, "Page not found", "k"), (203, "Page not found " * 3000, "k")]
    df = spark.createDataFrame(texts, "page_id long, text string, line_no string")
    got = sorted(r.page_id for r in residue.residue_pages(df).collect())
    assert got == [100 + i for i in range(len(BAD))]
    assert residue.residue_pages(df.limit(0)).count() == 0


def test_labels_spread_through_chains(spark):
    """a is near the seed, b near a but not near the seed: b gets the label; a far line doesn't."""
    base = "this long notice tells that the page of the harbour office which you asked for has been taken away from this server and will not come back before the next spring tide".split()
    chain = [" ".join(base)]
    rng = random.Random(5)
    words = list(base)
    for k in range(40):
        words = list(words)
        words[(7 * k) % len(words)] = rng.choice("ab cd ef gh".split())
        chain.append(" ".join(words))
    sims = dict(zip(chain, residue.simhash(chain).tolist()))
    frame = lambda rows: spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(rows)], "uid long, unit string, sim long")
    nodes = [(u, sims[u]) for u in chain]
    seed = spark.createDataFrame([(chain[0], sims[chain[0]], False)], "unit string, sim long, talk boolean")
    got = {r.uid for r in residue.spread(frame(nodes), seed).collect()}
    grams = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in chain]
    near = lambda a, b: bin((nodes[a][1] ^ nodes[b][1]) & (2**64 - 1)).count("1") <= 3 and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8
    want, frontier = {0}, [0]
    while frontier:
        frontier = [b for b in range(len(nodes)) if b not in want and any(near(a, b) for a in frontier)]
        want |= set(frontier)
    assert got == want


def test_both_ways_to_meet_the_frontier(spark, monkeypatch):
    rng = random.Random(3)
    sims = [rng.getrandbits(63) for _ in range(40)]
    sims += [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in sims]
    sims = [x - (1 << 64) if x >> 63 else x for x in sims]
    nodes = spark.createDataFrame([(i, f"u{i}", s) for i, s in enumerate(sims)], "uid long, unit string, sim long")
    edge = nodes.filter("uid < 40").withColumn("talk", F.lit(False))
    small = sorted(map(tuple, residue._near(nodes, edge).collect()))
    monkeypatch.setattr(residue, "BROADCAST_ROWS", 5)
    assert small == sorted(map(tuple, residue._near(nodes, edge).collect())) and len(small) >= 80
    assert residue._near(nodes.limit(0), edge).count() == 0 and residue._near(nodes, edge.limit(0)).count() == 0


def test_tables_miss_no_pair(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        x = rng.getrandbits(64)
        y = x
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << bit
        rows.append((i, x - (1 << 64) if x >> 63 else x, y - (1 << 64) if y >> 63 else y))
    df = spark.createDataFrame(rows, "i int, x long, y long")
    assert df.filter(~F.arrays_overlap(residue.table_keys(F.col("x")), residue.table_keys(F.col("y")))).count() == 0


def test_simhash_is_local():
    a, b, c = residue.simhash(["the page you are looking for is gone", "the page you were looking for is gone", "cheap kilns for orchard growers"])
    bits = lambda x, y: bin(int(np.uint64(x ^ y))).count("1")
    assert bits(a, b) < bits(a, c) and len(residue.simhash([])) == 0
    assert len({int(x) for x in residue.simhash(["x", "", "long " * 5000])}) == 3


@pytest.mark.parametrize(("line", "slot"), [("{{x}}", True), ("Dear ${first}", True), ("__A_B__", True), ("#{tag}", True), ("[Enter headline]", True), ("<%= t %>", True), ("<SITE_TITLE>", True), ("a {b c} d", False), ("50% of 20%", False), ("f(x) [1]", False), ("__init", False), ("{%city%}", True), ("@@A@@", True)])
def test_slots(line, slot):
    assert (residue.SLOT in residue.normal(line, frozenset())) is slot


def test_links_are_those_of_the_jaccard_alone(spark):
    """Against all pairs: hashes of most links differ in more bits than tables of bit blocks reach."""
    base = ["the page you were looking for does not exist", "something went wrong please try again", "the site is down for maintenance and will be back shortly", "please enable javascript in your browser and continue", "lorem"]
    long = "this long notice tells that the page of the harbour office which you asked for has been taken away from this server and will not come back before the next spring tide".split()
    rng = random.Random(11)
    texts = list(base)
    for t in base[:4]:
        for k in range(60):
            words = t.split()
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = [rng.choice(["", "now", "a", words[at] + "s", words[at][1:]])]
            texts.append(" ".join(" ".join(words).split()))
    texts += [" ".join(long[:k] + ["x"] * (k % 3) + long[k + k % 2 :]) for k in range(len(long))]
    texts = sorted(set(texts))
    sims = residue.simhash(texts).tolist()

    def grams(t):
        w, p = t.split(), f"^{t}$"
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 12 else {p[i : i + 4] for i in range(max(1, len(p) - 3))}

    sets = list(map(grams, texts))
    want = {(a, b) for a in range(len(texts)) for b in range(len(texts)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    nodes = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sims))], "uid long, unit string, sim long")
    number = {t: i for i, t in enumerate(texts)}
    got = {(r.uid, number[r.f_unit]) for r in residue._near(nodes, nodes.withColumn("talk", F.lit(False)), residue.REACH, similar=True).collect()}
    far = [1 for a, b in want if bin((sims[a] ^ sims[b]) & (2**64 - 1)).count("1") > 3]
    assert got == want and len(far) > len(want) / 2


def test_only_units_that_cannot_reach_the_frontier_are_left_out():
    rng = random.Random(7)
    texts = [" ".join(rng.choices("a bell rang over the long quay at nine and no one came".split(), k=rng.randint(1, 30))) for _ in range(400)]
    frontier = texts[::40]
    every = frozenset().union(*map(residue._grams, frontier))
    for t in texts:
        for f in frontier:
            a, b = residue._grams(t), residue._grams(f)
            if len(a & b) / len(a | b) >= residue.SIMILARITY:
                assert residue._may_reach(t, every)
    assert not all(residue._may_reach(t, every) for t in texts) and not residue._may_reach("bell", frozenset())


def test_filler_words(spark):
    made = ["Lorem kalmo ipsum vestri amet kalmo", "amet vestri ipsum kalmo lorem", "lorem ipsum amet kalmo unda"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*made, "the unda is a river", "unda again", "unda", "unda too", None, ""])], "page_id long, text string")
    got = residue.filler_words(df)
    assert "kalmo" in got and "unda" not in got and "#" not in got and residue.filler_words(df.limit(0)) == frozenset(residue.LATIN)


def test_long_placeholders_and_tails():
    filler = frozenset(residue.LATIN)
    long = "x" * 500
    assert residue.SLOT in residue.normal("Dear {{" + long + "}}, welcome", filler) and residue.SLOT in residue.normal("[Enter " + long + "]", filler) and residue.SLOT in residue.normal("(" + long + " here)", filler)
    assert residue.normal("Page not found [a1] (b2) [c3] (d4) [e5]", filler) == "page not found" and residue.normal("Access denied (" + "7" * 200 + ")", filler) == "access denied"
    assert "page not found" in residue.units("Firm | Page not found | Site", filler) and {"a", "b", "c", "d"} < residue.units("a - b - c - d", filler)
    residue.normal("(" + "1" * 200_000, filler), residue.units("a: " * 300, filler)


def test_no_shortcut_changes_a_normal_form():
    filler = frozenset(residue.LATIN)
    assert {residue.normal(t, filler) for t in ("Lorem, ipsum, dolor, amet.", "lorem lorem lorem lorem")} == {residue.FILL}
    assert residue.normal("The page is gone./index", filler) == "the page is gone" and residue.normal("Access denied ref deadbeef", filler) == "access denied"
