import random

import pyarrow as pa
import pytest

from claimforge.llm import lookalike


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("Jos​é", "José"),
        ("Renée", "Renée"),
        ("Ｐｒｏｆ． A", "Prof. A"),
        ("Аlеx", "Alex"),
        ("a b　c", "a b c"),
        ("ﬁrst", "first"),
        ("one о two", "one o two"),
        ("𝗣𝗿𝗶𝘆𝗮 ℝ 𝟗", "Priya R 9"),
        ("Σήμερα οne", "Σήμερα one"),
        ("​", ""),
        ("x‍‍y" * 5000, "xy" * 5000),
    ],
)
def test_changed(text, clean):
    assert lookalike.clean_array(pa.array([text])).to_pylist() == [clean]


@pytest.mark.parametrize("text", [None, "", "  ", "Renée Größe", "О компании IT-отдел", "これは（例）です", "👩‍🔧🏳️‍🌈", "東京　大阪", "नमस्‍ते", "Αθήνα and Rome"])
def test_kept(text):
    assert lookalike.clean_array(pa.array([text], pa.string())).to_pylist() == [text]


def test_no_ascii_text_would_change():
    """Why plain values need no SQL: run by it all the same beside a sign of another script's digits, they stay as they are."""
    rng = random.Random(4)
    texts = ["".join(chr(rng.randrange(128)) for _ in range(rng.randrange(40))) for _ in range(2000)]
    assert lookalike.clean_array(pa.array(texts)).to_pylist() == texts
    assert lookalike.clean_array(pa.array([f"é {t}" for t in texts])).to_pylist() == [f"é {t}" for t in texts]
    mixed = ["plain", None, "Аlеx", "", "ﬁrst"]
    assert lookalike.clean_array(pa.array(mixed)).to_pylist() == ["plain", None, "Alex", "", "first"] and len(lookalike.clean_array(pa.array([], pa.string()))) == 0


def test_batches_of_long_texts(monkeypatch):
    """Large batches go through SQL in parts, with the same results and bounded memory."""
    long = ["例です Ａlex Аlex " * 6000 + str(i) for i in range(80)]
    got = lookalike.clean_array(pa.array([*long, None, "plain", ""])).to_pylist()
    assert got[0].startswith("例です Alex Alex ") and got[80:] == [None, "plain", ""] and [x[-2:] for x in got[70:80]] == [str(i) for i in range(70, 80)]
    short = ["Аlex", "ﬁrst", None, "x", "a\u200bb"]
    whole = lookalike.clean_array(pa.array(short)).to_pylist()
    monkeypatch.setattr(lookalike, "SQL_BYTES", 5)
    assert lookalike.clean_array(pa.array(short)).to_pylist() == whole == ["Alex", "first", None, "x", "ab"]


def test_idempotent_and_rows(spark):
    rows = [(1, "Αlex", "x"), (1, "Αlex", "x"), (2, None, "y"), (None, "ok", "z")]
    df = spark.createDataFrame(rows, "k long, value string, field string")
    out = lookalike.unify(df, "k", "value", "f").collect()
    assert sorted((r.row_id or 0, r.value or "", r.changed) for r in out) == [(0, "ok", False), (1, "Alex", True), (1, "Alex", True), (2, "", False)]
    assert lookalike.unify(df.limit(0), "k", "value", "f").count() == 0
