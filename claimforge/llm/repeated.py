"""Problem 4: lines repeated across one site's pages, by PrefixSpan over line identifiers per site.

A page is the sequence of its lines' identifiers; an identifier stands for (host, normal form of the
line), so that no pattern reaches beyond one host. The first level of PrefixSpan, the frequent single
lines, is one distributed count of distinct URLs. Longer patterns grow from it: a page keeps only its
frequent lines, and each prefix is extended by every later frequent line of the pages that hold it (the
projected database is pairs of page and position, never a copy of the rest of a page), to any length. As
every part of a frequent sequence is frequent, only closed ones are reported beyond pairs, those that no
longer sequence holds on as many URLs; the urls of any other are those of the closed one around it.

Every line of a frequent sequence is itself frequent, so the lines to delete are exactly the occurrences
of the frequent single lines; ``sequences`` reports the longer patterns.

Hot hosts: keys are (host, line), counted after map-side de-duplication; the join that brings the frequent
lines back to their occurrences is salted, so that a footer on a third of all pages is spread over tasks.
Longer patterns grow per host and first line, from the distinct lists of lines with their numbers of URLs.

Results at the edges: pages with null text or null final_url have no lines; '' and blank lines (or lines of
digits only) never count; a page fetched twice under one URL counts once but both pages lose the line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimforge.llm.common import host_of, written

MIN_URLS = 8
SALTS = 8
#: White space as Unicode sees it, for Java and RE2 alike.
BLANK = r"[\t-\r \x1c-\x1f\x85\p{Z}]+"


def line_form(line: Column) -> Column:
    """Lower case without digits 0-9, white space made one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", ""), BLANK, " "))


def _formed(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, host, form, a, b, u): lines with their host and form."""
    split = pages.filter(F.col("text").isNotNull() & F.col("final_url").isNotNull()).select(
        "page_id", host_of(F.col("final_url")).alias("host"), F.xxhash64("final_url").alias("u"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    formed = split.select("page_id", "line_no", "host", "u", line_form(F.col("line")).alias("form")).filter("form <> ''")
    return formed.select("page_id", "line_no", "host", "form", F.xxhash64("host", "form").alias("a"), F.xxhash64("form", F.lit(1), "host").alias("b"), "u")


def lines(pages: DataFrame) -> DataFrame:
    """(page_id, line_no, a, b, u): every countable line; a and b are 128 bits of (host, form), u of the URL."""
    return _formed(pages).select("page_id", "line_no", "a", "b", "u")


def frequent_lines(found: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """(a, b, urls): the first level: lines that stand on at least min_urls different URLs of their host."""
    return found.select("a", "b", "u").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("urls")).filter(F.col("urls") >= min_urls)


def occurrences(pages: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """(page_id, line_no, a, b, u, urls): every occurrence of a frequent line. The lines are written once and read twice."""
    return _frequent(written(lines(pages)), min_urls)


def _frequent(found: DataFrame, min_urls: int) -> DataFrame:
    """found without infrequent lines, with urls."""
    copies = frequent_lines(found, min_urls).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return found.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(copies, ["a", "b", "salt"]).drop("salt")


def remove(pages: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """pages with the frequent lines taken out of text; null text stays null."""
    gone = occurrences(pages, min_urls).groupBy("page_id").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return pages.join(gone, "page_id", "left").withColumn("text", text).drop("_gone")


def closed_sequences(groups: list[tuple[int, list[tuple[tuple[str, ...], int]]]], least: int, first: str | None = None) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """(lines, urls, occurrences) of the frequent sequences that no longer one holds on as many URLs, and of all of one or two lines;
    with first, of those that begin with it.

    groups: (urls, [(lines of a page, rows)]): URLs whose pages hold the same sequences. PrefixSpan with the tests of BIDE: a prefix into which a
    line fits everywhere before its first occurrence ends is not grown; a sequence is closed if no line fits into it on all its URLs.
    """
    held = [(g, tuple(lines), rows) for g, (_, pages) in enumerate(groups) for lines, rows in pages]
    weight = [n for n, _ in groups]
    support = lambda projected: sum(weight[g] for g in {held[k][0] for k, _ in projected})

    def grown(projected):
        found = {}
        for k, at in projected:
            lines, seen = held[k][1], set()
            for n in range(at, len(lines)):
                if lines[n] not in seen:
                    seen.add(lines[n])
                    found.setdefault(lines[n], []).append((k, n + 1))
        return {x: (p, s) for x, p in found.items() if (s := support(p)) >= least}

    def fits(prefix, projected, first_only):
        """Whether a line fits into prefix on all its URLs; with first_only, before its first occurrence ends in every sequence."""
        left, right = {}, {}
        for k, end in projected:
            lines = held[k][1]
            at, marks = 0, [0]
            for x in prefix:
                at = lines.index(x, at) + 1
                marks.append(at)
            at, back = end if first_only else len(lines), []
            for x in reversed(prefix):
                at -= 1
                while lines[at] != x:
                    at -= 1
                back.append(at)
            left[k], right[k] = marks, back[::-1]
        for i in range(len(prefix)):
            common, by_group = None, {}
            for k, _ in projected:
                by_group.setdefault(k if first_only else held[k][0], set()).update(held[k][1][left[k][i] : right[k][i]])
            for items in by_group.values():
                common = items if common is None else common & items
                if not common:
                    break
            if common:
                return True
        return False

    stack = [((x,), p, s) for x, (p, s) in grown([(k, 0) for k in range(len(held))]).items() if first in (None, x)]
    while stack:
        prefix, projected, urls = stack.pop()
        cut = fits(prefix, projected, True)
        if cut and len(prefix) >= 2:
            closed, longer = False, {}
        else:
            longer = grown(projected)
            closed = not cut and all(s < urls for _, s in longer.values()) and not fits(prefix, projected, False)
        if closed or len(prefix) <= 2:
            yield prefix, urls, sum(weight[held[k][0]] * held[k][2] for k, _ in projected)
        stack += [((*prefix, x), p, s) for x, (p, s) in longer.items()]


def sequences(pages: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """(host, length, first_line, last_line, urls, occurrences, lines): the frequent sequences, of any length and with any lines between.

    Reported are all single lines and pairs, and of longer sequences the closed ones. occurrences are pages, repeated rows taken once.
    """
    kept = _frequent(_formed(pages), min_urls).groupBy("host", "u", "page_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "form"))).alias("l"))
    listed = kept.groupBy("host", "u", F.col("l.form").alias("lines")).agg(F.count(F.lit(1)).alias("rows"))
    by_url = listed.groupBy("host", "u").agg(F.array_sort(F.collect_list(F.struct("lines", "rows"))).alias("pages"))
    groups = by_url.groupBy("host", "pages").agg(F.count(F.lit(1)).alias("n"))
    begun = groups.select("host", "pages", "n", F.explode(F.array_distinct(F.flatten("pages.lines"))).alias("first"))

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = list(closed_sequences([(r["n"], [(tuple(p["lines"]), p["rows"]) for p in r["pages"]]) for r in rows], min_urls, rows[0]["first"]))
        columns = [[rows[0]["host"]] * len(found), [len(x) for x, _, _ in found], [x[0] for x, _, _ in found], [x[-1] for x, _, _ in found], [n for _, n, _ in found], [n for _, _, n in found], [list(x) for x, _, _ in found]]
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "length", "first_line", "last_line", "urls", "occurrences", "lines"])

    return begun.groupBy("host", "first").applyInArrow(run, "host string, length int, first_line string, last_line string, urls bigint, occurrences bigint, lines array<string>")
