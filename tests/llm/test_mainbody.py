import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimforge.llm import mainbody

SENTENCES = ["The kiln was lit on a cold morning and nobody left before the first plate came out of it.", "Every plate is numbered by hand, and the numbers are kept in a green book behind the door."]


def page(rng, host, named=True):
    """(text, html, furniture line numbers) of a made-up page."""
    nav = rng.sample(["Home", "Products", "Pricing", "Careers", "Sign in", "Contact"], 4)
    body = [f"A note on plate {rng.randint(1, 99)}", "All prices are net.", *[rng.choice(SENTENCES) for _ in range(rng.randint(2, 4))]]
    side = ["Related articles", f"A note on cups {rng.randint(1, 99)}"]
    foot = [f"© 2020 {host}", "Privacy policy", "Back to top"]
    text = "\n".join([*nav, "", *body, *side, *foot])
    furniture = [*range(4), *range(5 + len(body), 5 + len(body) + 5)]
    a, b = ("nav", "main") if named else ("div", "div")
    html = f"<html><body><script>x<y</script><{a}>" + "".join(f'<li><a href="/{x}">{x}</a>' for x in nav) + f"</{a}><{b}><h1>{body[0]}</h1>" + "".join(f"<p>{x}" for x in body[1:]) + f'</{b}><div><h3>{side[0]}</h3><li><a href="/c">{side[1]}</a></li></div><div>' + "".join(f"<p>{x}</p>" for x in foot) + "</div></body></html>"
    return text, html, furniture


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return mainbody.train([page(rng, f"Host {i % 7}")[:2] for i in range(60)])


def test_held_out(model):
    rng = random.Random(2)
    pages = [page(rng, f"Other {i}", named=False) for i in range(40)]
    for hidden in (False, True):
        got = model.furniture([(t, None if hidden else h) for t, h, _ in pages])
        right = sum(len(set(g) & set(f)) for g, (_, _, f) in zip(got, pages))
        assert right / sum(map(len, got)) > 0.95 and right / sum(len(f) for _, _, f in pages) > 0.95


def flat(text):
    """Markup without any container: one div a line."""
    return "<html><body>" + "".join(f"<div>{x}</div>\n" for x in text.split("\n") if x) + "</body></html>"


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>"])
def test_one_container_for_the_whole_page_says_nothing(model, wrap):
    rng = random.Random(4)
    pages = [page(rng, f"Other {i}") for i in range(40)]
    got = model.furniture([(t, wrap.format(flat(t))) for t, _, _ in pages])
    right = sum(len(set(g) & set(f)) for g, (_, _, f) in zip(got, pages))
    assert right / sum(map(len, got)) > 0.95 and right / sum(len(f) for _, _, f in pages) > 0.95


def test_pages_with_one_article_are_labelled(spark):
    rng = random.Random(6)
    rows = [(i, f"https://h{i % 4}.example/{i}", *(x.replace("<main", "<article").replace("</main", "</article") for x in page(rng, "h")[:2])) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, final_url string, text string, html string")
    assert mainbody.fit(df).scores != mainbody.train([]).scores
    twice = df.withColumn("html", F.concat("html", F.lit("<article>Teaser</article>")))
    assert mainbody.fit(twice).scores == mainbody.train([]).scores


def test_alignment_is_a_longest_common_subsequence():
    def block(x):
        return mainbody.Block(x, 0.0, "p", -1, (0,))

    extra = [block(f"only in the markup {i}") for i in range(40)]
    got = mainbody.align([(0, "a"), (1, "x"), (2, "b"), (3, "c"), (4, "the end is cu")], [block("a"), *extra, block("b"), block("a"), block("c"), block("the end is cut off")])
    assert [b and b.text for b in got] == ["a", None, "b", "c", "the end is cut off"]
    assert mainbody.align([(0, "a")], []) == [None] and mainbody.align([], extra) == []
    rng = random.Random(5)
    for _ in range(200):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(0, 9))], [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
        got = [x.text for x in mainbody.align(list(enumerate(a)), [block(x) for x in b]) if x is not None]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(got) >= best[-1][-1]


def test_edges(model):
    assert model.furniture([(None, None), ("", "<p>x"), (" \n \n", None), ("a" * 50_000, "<div")])[:3] == [[], [], []]
    assert model.furniture([]) == []
    assert mainbody.train([]).furniture([("Home\n" + SENTENCES[0], None)]) is not None


def test_markup_blocks():
    got = [(b.text, b.linked, b.region) for b in mainbody.markup_blocks("<nav><a>A &amp; B</a></nav><main><p>x <b>y</b><p>z<br>w</main><!-- c --><style>q</style>t")]
    assert got == [("A & B", 1.0, 0), ("x y", 0.0, 1), ("z", 0.0, 1), ("w", 0.0, 1), ("t", 0.0, -1)]


def test_tree_separates():
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.6)).astype(float)
    assert ((mainbody.Tree().fit(x, y).predict(x) > 0.5) == y).mean() > 0.99


def test_rows(spark):
    rng = random.Random(3)
    rows = [(i, f"https://h{i % 3}.example/{i}", *page(rng, "h")[:2], 5) for i in range(30)] + [(50, "https://a.example", None, None, 5), (51, None, "Home", None, 5), (0, "https://h0.example/0", "Home", None, 5)]
    df = spark.createDataFrame(rows, "page_id long, final_url string, text string, html string, line_no int")
    model = mainbody.fit(df)
    assert mainbody.furniture_lines(df, model).columns == ["page_id", "line_no"]
    out = mainbody.main_texts(df, model).collect()
    assert len(out) == 33 and {r.main for r in out if r.page_id == 50} == {None}
    assert mainbody.fit(df, chars=10).scores == mainbody.train([]).scores
    assert mainbody.furniture_lines(df.limit(0), mainbody.fit(df.limit(0))).count() == 0
