import itertools
import random

import numpy as np
import pytest

from claimforge.llm import personal, personal_seed


@pytest.fixture(scope="module")
def field():
    return personal.field()


def test_held_out_accuracy(field):
    """On sentences drawn with another seed, by exact value."""
    table = personal_seed.sentences(1, seed=4242)
    right = found = there = 0
    for (text, marks), got in zip(table, field.mark([t for t, _ in table])):
        want = {(k, text[a:b]) for a, b, k in marks}
        have = {(k, text[a:b]) for a, b, k in got}
        right, found, there = right + len(want & have), found + len(have), there + len(want)
    assert right / found > 0.9 and right / there > 0.9


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to jobs.team (at) kalmora [dot] example for the report.", [("email", "jobs.team (at) kalmora [dot] example")]),
        ("Contact <a.moor@kal.example> before noon.", [("email", "a.moor@kal.example")]),
        ("Hotline +44 20 7946 0123, open day and night.", [("phone", "+44 20 7946 0123")]),
        ("VAT no. ZZ 999 54 01, registry file B-199.", []),
        ("The firm of Marskman & Sons Ltd supplied the glass.", []),
        ("According to Dr. Thornbach, the matter is settled.", [("name", "Thornbach")]),
        ("Deliver to 12 Merrow Lane before noon.", [("address", "12 Merrow Lane")]),
    ],
)
def test_examples(field, text, want):
    assert [(k, text[a:b]) for a, b, k in field.mark([text])[0]] == want


def test_viterbi_is_exact(field):
    """Against all label sequences of short random segments."""
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(9, len(personal.LABELS))).astype(np.float32) * 3
    starts, lengths = np.array([0, 1, 4]), np.array([1, 3, 5])
    got = field.viterbi(scores, starts, np.minimum(lengths, 3))
    for s, n in zip(starts, np.minimum(lengths, 3)):
        value = lambda y: field.start[y[0]] + sum(scores[s + t, y[t]] for t in range(n)) + sum(field.moves[y[t - 1], y[t]] for t in range(1, n))
        best = max(itertools.product(range(len(personal.LABELS)), repeat=int(n)), key=value)
        assert abs(value(best) - value(tuple(got[s : s + n]))) < 1e-3


def test_batches_change_nothing(field):
    texts = [t for t, _ in personal_seed.sentences(1, seed=5)][:120] + ["", "x " * 30_000 + "Write to a.b@kal.example now.", "\n\n"]
    whole = field.mark(texts)
    assert whole == [field.mark([t])[0] for t in texts]
    assert [texts[-2][a:b] for a, b, _ in whole[-2]] == ["a.b@kal.example"]


def test_rows(spark, field):
    rows = [(1, "Mail ann@kal.example or ann@kal.example.", "k"), (2, None, "k"), (3, "", "k"), (4, " \n", "k"), (1, "Mail ann@kal.example or ann@kal.example.", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert sorted(map(tuple, personal.find(df, field).collect())) == [(1, "email", "ann@kal.example")] * 2
    out = {r.doc_id: r.text for r in personal.redact(df, field).collect()}
    assert out == {1: "Mail [EMAIL] or [EMAIL].", 2: None, 3: "", 4: " \n"}
    assert personal.find(df.limit(0), field).count() == 0


def test_outlines_are_the_matches_of_the_patterns():
    rng = random.Random(9)
    parts = ["a.b@c.de", "jo [at] firm dot com", " at ", "AT", "(at)", "@", " ", "  ", "x_y", ".", "-", "+", "(", ")", "12 34 567", "+49 30 1234567", "AB123456C", "X-1234567-L", "555-12-3456", "Z 12345678", "é", "K", "\n", "com", "firm.example", "2019年", "123456789012345678901234567890", "/", "12"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        got = personal.Outlines(text)
        assert got.mail == [m.span() for m in personal.MAIL.finditer(text)], text
        assert got.digits == [m.span() for m in personal.DIGITS.finditer(text)], text
        assert got.papers == [m.span() for m in personal.PAPERS.finditer(text)], text


def test_details_far_inside_long_lines():
    """No window and no cut: one line of thousands of words, a mailbox of a hundred letters."""
    model = personal.field()
    line = "The report was read in the hall and nobody left before noon. " * 400
    text = line + "Write to " + "m" * 100 + "@mail.firm.example today. " + line
    assert ("email", "m" * 100 + "@mail.firm.example") in {(k, text[a:b]) for a, b, k in model.mark([text])[0]}
