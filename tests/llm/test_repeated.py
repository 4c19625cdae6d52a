import itertools
import random
from collections import defaultdict

from claimforge.llm import repeated

SCHEMA = "page_id long, final_url string, text string, a int"


def pages(spark):
    rows = []
    for i in range(10):
        rows.append((i, f"https://WWW.x.example/{i}", f"Menu {i}\nHome\n\nbody {'abcdefghij'[i]}\n 7 \nFoot  {i}er", 1))
    rows += [(100, "https://x.example/0", "menu\nother", 1), (100, "https://x.example/0", "menu\nother", 1)]
    rows += [(200 + i, f"https://y.example/{i}", "menu\nhome", 1) for i in range(7)]
    rows += [(300, "https://y.example/6", "menu\nhome", 1), (301, None, "menu", 1), (302, "https://x.example/q", None, 1), (303, "https://x.example/z", "", 1)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    import re

    urls = defaultdict(set)
    at = []
    for r in rows:
        if r.text is None or r.final_url is None:
            continue
        host = re.sub(r"^www\.", "", r.final_url.split("/")[2].lower())
        for n, line in enumerate(r.text.split("\n")):
            form = " ".join(re.sub("[0-9]", "", line.lower()).split())
            if form:
                urls[host, form].add(r.final_url)
                at.append((r.page_id, n, host, form))
    return sorted((p, n) for p, n, h, f in at if len(urls[h, f]) >= 8)


def test_against_brute_force(spark):
    df = pages(spark)
    got = sorted((r.page_id, r.line_no) for r in repeated.occurrences(df).select("page_id", "line_no").collect())
    assert got == brute(df.collect()) and (0, 0) in got and (200, 0) not in got
    assert repeated.occurrences(df.repartition(7)).count() == len(got)
    assert repeated.occurrences(df.limit(0)).count() == 0


def test_remove(spark):
    out = {r.page_id: r.text for r in repeated.remove(pages(spark)).collect()}
    assert out[0] == "\nbody a\n 7 " and out[302] is None and out[303] == "" and out[200] == "menu\nhome"


def test_sequences_cover_the_same_lines(spark):
    got = {(r.host, r.length, r.first_line, r.last_line): r.urls for r in repeated.sequences(pages(spark)).collect()}
    assert got["x.example", 2, "menu", "home"] == 10 and got["x.example", 3, "menu", "foot er"] == 10
    singles = {k[2] for k in got if k[1] == 1}
    assert singles == {"menu", "home", "foot er"} and all({k[2], k[3]} <= singles for k in got)


def test_sequences_with_lines_between_and_of_any_length(spark):
    """The pages hold nine lines in order and a frequent line between two of them on some."""
    rows = [(i, f"https://z.example/{i}", "\n".join(["a", *(["x"] if i % 2 else []), *"bcdefghi"]), 1) for i in range(16)]
    got = {tuple(r.lines): (r.length, r.urls, r.occurrences) for r in repeated.sequences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["a", "b"] == (2, 16, 16) and got["a", "x"] == (2, 8, 8) and got[tuple("abcdefghi")] == (9, 16, 16) and got[tuple("axbcdefghi")] == (10, 8, 8)
    assert sum(k[0] > 2 for k in got.values()) == 2 and len(got) == 10 + 45 + 2


def test_closed_sequences_against_all_subsequences():
    rng = random.Random(1)
    holds = lambda p, s: (lambda it: all(x in it for x in p))(iter(s))
    for _ in range(60):
        groups = [(rng.randint(1, 3), [(tuple(rng.choice("abcde") for _ in range(rng.randint(1, 7))), 1) for _ in range(rng.choice([1, 1, 2]))]) for _ in range(rng.randint(2, 7))]
        every = {p for _, pages in groups for s, _ in pages for n in range(1, len(s) + 1) for p in itertools.combinations(s, n)}
        urls = {p: n for p in every if (n := sum(w for w, pages in groups if any(holds(p, s) for s, _ in pages))) >= 3}
        want = sorted((p, n) for p, n in urls.items() if len(p) <= 2 or not any(len(q) > len(p) and urls[q] == n and holds(p, q) for q in urls))
        assert sorted((p, n) for p, n, _ in repeated.closed_sequences(groups, 3)) == want
        assert sorted((p, n) for x in "abcde" for p, n, _ in repeated.closed_sequences(groups, 3, x)) == want
