"""What SQL functions can't say: similarity of whole names, and JSON inside prose. Arrow batches, never single rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from claimforge.functions import text as T


@F.pandas_udf(DoubleType())
def _ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype="float64")


def name_ratio(a, b):
    """Share of matching characters of two texts, in lower case with dashes as spaces."""
    plain = lambda c: T.squeeze(F.replace(F.lower(T.blank(c)), F.lit("-"), F.lit(" ")))
    return _ratio(F.lower(T.blank(a)), plain(b))


def same_company(current, full_name, words):
    """Whether a stated company is the target: 0.85 alike to its name, or sharing a distinctive word; an empty one is."""
    own = F.transform(F.split(F.replace(F.lower(T.blank(current)), F.lit("-"), F.lit(" ")), r"\s+"), lambda t: F.regexp_replace(t, r"^[.'’\"]+|[.'’\"]+$", ""))
    return (T.blank(current) == "") | (name_ratio(current, full_name) >= 0.85) | F.arrays_overlap(own, words)


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def salvage(text: str | None, most_characters: int | None = 100_000, most_starts: int | None = 200) -> str | None:
    """The first JSON object or list in a reply: fenced, else the first balanced one; lists become {"items": ...}."""
    body = (text or "")[:most_characters]
    tries = [m.strip() for m in _FENCE.findall(body)] + [body.strip()]
    decoder = json.JSONDecoder()
    starts = [m.start() for m in re.finditer(r"[{\[]", body)][:most_starts]
    for piece in tries:
        try:
            found = json.loads(piece)
        except ValueError:
            continue
        if isinstance(found, (dict, list)):
            return json.dumps(found if isinstance(found, dict) else {"items": found}, ensure_ascii=False)
    for at in starts:
        try:
            found, _ = decoder.raw_decode(body[at:])
        except ValueError:
            continue
        return json.dumps(found if isinstance(found, dict) else {"items": found}, ensure_ascii=False)
    return None


def salvage_json(texts, most_characters: int | None = 100_000, most_starts: int | None = 200):
    """salvage as a column; limits of None take replies of any length."""

    @F.pandas_udf(StringType())
    def run(replies: pd.Series) -> pd.Series:
        return replies.map(lambda t: salvage(t, most_characters, most_starts))

    return run(texts)
