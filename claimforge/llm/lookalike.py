"""Problem 5: one consistent form for text that looks the same, by DuckDB inside Arrow partitions.

Each Arrow batch is a table for an embedded DuckDB, whose SQL maps, in this order: joiners that do their
work (in emoji, in scripts that need them) set aside; invisible characters dropped; other spaces to the
space; full-width letters, digits and punctuation, ligatures and letter-like numerals to the plain ones;
``nfc_normalize``; and in words that mix Latin with Cyrillic or Greek, look-alike letters to the word's
own script. Nothing else is changed (no case folding, no trimming), so *changed* means that the value held
a look-alike.

Results at the edges: null stays null (not changed), '' and blank plain text stay as they are, a lone
invisible character becomes ''; repeated rows come out repeatedly; texts of any length are taken whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Character classes in RE2's notation.
PICTURE = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{20E3}"
JOINED_SCRIPTS = r"\p{Arabic}\p{Syriac}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Mongolian}"
INVISIBLE = r"\x{00AD}\x{034F}\x{180E}\x{200B}-\x{200D}\x{2060}-\x{2064}\x{FEFF}"
DIRECTION = r"\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}"
SPACE = r"\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}"
IDEOGRAPH = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\x{3001}-\x{303F}\x{30FB}\x{30FC}"
WIDE_SIGN = r"\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF5E}"

# Look-alike letters, Latin against Cyrillic and Greek, in the same places.
CYRILLIC = "АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝ"
CYRILLIC_AS_LATIN = "ABEKMHOPCTYXSIJaeopcyxsijhdqw"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXova"
NUMERAL = "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ‐‑․"
NUMERAL_AS = "IVXLCDMivxlcdm--."
LIGATURE = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

_wide = [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]
# Letters and digits that only differ in style: the mathematical alphabets and the letter-like signs that fill their gaps.
_styled = [c for c in (*range(0x1D400, 0x1D800), *range(0x210A, 0x2135)) if re.fullmatch(r"[\w]", unicodedata.normalize("NFKC", chr(c))) and unicodedata.normalize("NFKC", chr(c)) != chr(c)]
WIDE = "".join(map(chr, [*_wide, *_styled]))
WIDE_AS = "".join(chr(c - 0xFEE0) for c in _wide) + "".join(unicodedata.normalize("NFKC", chr(c)) for c in _styled)
_signs = [*range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41), *range(0xFF5B, 0xFF5F)]
WIDE_SIGNS = "".join(map(chr, _signs))
WIDE_SIGNS_AS = "".join(chr(c - 0xFEE0) for c in _signs)
KEPT_JOINER, KEPT_SPLITTER = "", ""
#: Stands for a NUL while SQL runs: a sign that is none in any text.
KEPT_NUL = "\ufdd9"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sub(value: str, pattern: str, to: str) -> str:
    return f"regexp_replace({value}, {_quoted(pattern)}, {_quoted(to)}, 'g')"


SQL = f"""
WITH protected AS (
  SELECT row, value, {_sub(_sub("value", f"([{PICTURE}])\\x{{200D}}([{PICTURE}])", rf"\1{KEPT_JOINER}\2"), f"([{PICTURE}])\\x{{200D}}([{PICTURE}])", rf"\1{KEPT_JOINER}\2")} AS v
  FROM batch
), kept AS (
  SELECT row, value, CASE WHEN regexp_matches(v, '[{JOINED_SCRIPTS}]')
    THEN {_sub(_sub("v", f"([{JOINED_SCRIPTS}])\\x{{200D}}", rf"\1{KEPT_JOINER}"), f"([{JOINED_SCRIPTS}])\\x{{200C}}", rf"\1{KEPT_SPLITTER}")}
    ELSE v END AS v
  FROM protected
), seen AS (
  SELECT row, value, {_sub("v", f"[{INVISIBLE}]", "")} AS v FROM kept
), straight AS (
  SELECT row, value, CASE WHEN regexp_matches(v, '[{DIRECTION}]') AND NOT regexp_matches(v, '[\\p{{Arabic}}\\p{{Hebrew}}\\p{{Syriac}}\\p{{Thaana}}]')
    THEN {_sub("v", f"[{DIRECTION}]", "")} ELSE v END AS v
  FROM seen
), spaced AS (
  SELECT row, value, {_sub("v", f"[{SPACE}]", " ")} AS v FROM straight
), wide_space AS (
  SELECT row, value, CASE WHEN contains(v, chr(12288)) THEN array_to_string(list_transform(
      regexp_extract_all(v, '[{IDEOGRAPH}]\\x{{3000}}+|\\x{{3000}}+[{IDEOGRAPH}]|[{IDEOGRAPH}]|\\x{{3000}}+|[^\\x{{3000}}{IDEOGRAPH}]+'),
      lambda s: CASE WHEN regexp_full_match(s, '\\x{{3000}}+') THEN replace(s, chr(12288), ' ')
                     WHEN regexp_full_match(s, '\\x{{3000}}+[{IDEOGRAPH}]') THEN replace(s, chr(12288), ' ') ELSE s END), '') ELSE v END AS v
  FROM spaced
), narrow AS (
  SELECT row, value, translate(v, {_quoted(WIDE + NUMERAL)}, {_quoted(WIDE_AS + NUMERAL_AS)}) AS v FROM wide_space
), signs AS (
  SELECT row, value, CASE WHEN regexp_matches(v, '[{WIDE_SIGN}]') THEN array_to_string(list_transform(
      regexp_extract_all(v, '[{IDEOGRAPH}][{WIDE_SIGN}]+|[{WIDE_SIGN}]+[{IDEOGRAPH}]|[{IDEOGRAPH}]|[{WIDE_SIGN}]+|[^{WIDE_SIGN}{IDEOGRAPH}]+'),
      lambda s: CASE WHEN regexp_matches(s, '[{IDEOGRAPH}]') THEN s ELSE translate(s, {_quoted(WIDE_SIGNS)}, {_quoted(WIDE_SIGNS_AS)}) END), '') ELSE v END AS v
  FROM narrow
), joined AS (
  SELECT row, value, nfc_normalize({"".join("replace(" for _ in LIGATURE)}v{"".join(f", {_quoted(a)}, {_quoted(b)})" for a, b in LIGATURE.items())}) AS v FROM signs
), words AS (
  SELECT row, value, v, regexp_matches(v, '\\p{{Latin}}') AND regexp_matches(v, '[{CYRILLIC}{GREEK}]') AS mixed,
    regexp_matches(v, '[\\p{{Cyrillic}}]') AND regexp_matches({_sub("v", f"[{CYRILLIC}]", "")}, '\\p{{Cyrillic}}') AS cyrillic,
    regexp_matches(v, '[\\p{{Greek}}]') AND regexp_matches({_sub("v", f"[{GREEK}]", "")}, '\\p{{Greek}}') AS greek
  FROM joined
), one_script AS (
  SELECT row, value, CASE WHEN mixed THEN array_to_string(list_transform(regexp_extract_all(v, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda s: CASE
      WHEN NOT regexp_matches(s, '[{CYRILLIC}{GREEK}]') THEN s
      WHEN regexp_matches(s, '\\p{{Latin}}') THEN CASE
        WHEN regexp_matches({_sub("s", f"[{CYRILLIC}]", "")}, '\\p{{Cyrillic}}') AND NOT regexp_matches({_sub("s", f"[{CYRILLIC_AS_LATIN}]", "")}, '\\p{{Latin}}') THEN translate(s, {_quoted(CYRILLIC_AS_LATIN)}, {_quoted(CYRILLIC)})
        WHEN regexp_matches({_sub("s", f"[{GREEK}]", "")}, '\\p{{Greek}}') AND NOT regexp_matches({_sub("s", f"[{GREEK_AS_LATIN}]", "")}, '\\p{{Latin}}') THEN translate(s, {_quoted(GREEK_AS_LATIN)}, {_quoted(GREEK)})
        ELSE translate(s, {_quoted(CYRILLIC + GREEK)}, {_quoted(CYRILLIC_AS_LATIN + GREEK_AS_LATIN)}) END
      WHEN NOT cyrillic AND regexp_full_match(s, '[{CYRILLIC}]+') THEN translate(s, {_quoted(CYRILLIC)}, {_quoted(CYRILLIC_AS_LATIN)})
      WHEN NOT greek AND regexp_full_match(s, '[{GREEK}]+') THEN translate(s, {_quoted(GREEK)}, {_quoted(GREEK_AS_LATIN)})
      WHEN cyrillic AND regexp_matches(s, '\\p{{Cyrillic}}') AND regexp_matches(s, '[{GREEK}]') THEN translate(s, {_quoted(GREEK)}, {_quoted("".join(dict(zip(CYRILLIC_AS_LATIN, CYRILLIC)).get(c, c) for c in GREEK_AS_LATIN))})
      ELSE s END), '') ELSE v END AS v
  FROM words
)
SELECT replace(replace(v, '{KEPT_JOINER}', chr(8205)), '{KEPT_SPLITTER}', chr(8204)) AS clean FROM one_script ORDER BY row
"""

_connection = None


#: Bytes of text that go through SQL at once (a longer text alone): its steps hold a text many times over.
SQL_BYTES = 2 << 20


def _duck():
    """A connection of its own for each worker; it never writes to disk."""
    global _connection
    if _connection is None:
        import duckdb

        _connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "2GB", "temp_directory": ""})
    return _connection


def clean_array(values: pa.Array) -> pa.Array:
    """The consistent form of each value. Values of ASCII signs alone are their own form, as no expression of SQL changes one."""
    import pyarrow.compute as pc

    foreign = pc.fill_null(pc.invert(pc.string_is_ascii(values)), False)
    some = values.filter(foreign)
    if not len(some):
        return values
    # DuckDB's nfc_normalize ends a text at its first NUL.
    some = pc.replace_substring(some, "\0", KEPT_NUL)
    sizes = pc.binary_length(some).to_pylist()
    cleaned, start, size = [], 0, 0
    for k, n in enumerate(sizes):
        if k > start and size + n > SQL_BYTES:
            cleaned.append(_through_sql(some.slice(start, k - start)))
            start, size = k, 0
        size += n
    cleaned.append(_through_sql(some.slice(start)))
    return pc.replace_with_mask(values, foreign, pc.replace_substring(pa.concat_arrays(cleaned), KEPT_NUL, "\0"))


def _through_sql(values: pa.Array) -> pa.Array:
    duck = _duck()
    duck.register("batch", pa.table({"row": pa.array(range(len(values)), pa.int64()), "value": values}))
    try:
        got = duck.sql(SQL).to_arrow_table()
    finally:
        duck.unregister("batch")
    return got.column("clean").combine_chunks().cast(pa.string())


def unify(df: DataFrame, key: str, column: str, field: str) -> DataFrame:
    """(field, row_id, value, changed): each row's value in the one consistent form."""
    source = df.select(F.col(key).cast("bigint").alias("k"), F.col(column).cast("string").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            value = batch.column(1).cast(pa.string())
            clean = clean_array(value)
            changed = pc.fill_null(pc.not_equal(value, clean), False)
            yield pa.RecordBatch.from_arrays([batch.column(0), clean, changed], names=["row_id", "value", "changed"])

    return source.mapInArrow(run, "row_id bigint, value string, changed boolean").select(F.lit(field).alias("field"), "row_id", "value", "changed")


def unify_all(pages: DataFrame, people: DataFrame) -> DataFrame:
    return unify(pages, "page_id", "text", "pages.text").unionByName(unify(people, "person_id", "name", "people.name"))
