"""One pass over a page's HTML to nested columns: the only Python that page facts need."""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from claimforge import lexicon as L
from claimforge.session import widened

_TOKEN = re.compile(r"<!--.*?-->|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = ("script", "style", "noscript", "template", "svg")
_INLINE = ("a", "b", "i", "em", "strong", "span", "small", "sup", "sub", "u", "abbr", "code", "time", "img", "mark", "q", "cite", "font", "label", "input", "button", "select", "option", "textarea")
_VOID = ("br", "hr", "img", "input", "meta", "link", "source", "wbr")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_FIELDS = ("name", "id", "class", "placeholder", "aria-label", "type")

SCHEMA = (
    "title string, text string, links array<struct<url:string,anchor:string>>, mailto array<string>, tel array<string>, contact_texts array<string>, "
    "rows array<array<string>>, headings array<array<string>>, blocks array<string>, forms array<struct<action:string,about:string,controls:string>>"
)


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html_module.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _tidy(parts: list[str]) -> str:
    return " ".join(html_module.unescape("".join(parts)).split())


def parse(source: str | None, url: str, anchor_length: int | None = 120, form_length: int | None = 600, after_heading: int = 3) -> dict:
    """The parts of a page. Unclosed paragraphs, items and cells end where the next block begins. Lengths of None take anchors and form texts whole."""
    out: dict = {k: [] for k in ("links", "mailto", "tel", "contact_texts", "rows", "headings", "blocks", "forms")}
    title: list[str] = []
    head = {"og": "", "h1": ""}
    text: list[str] = []
    hidden, in_title = "", False
    link: tuple[str, list[str]] | None = None
    row: list[str] | None = None
    form: dict | None = None
    contact: list[tuple[str, int]] = []  # open containers with a hint of contact details, and where their text begins
    blocks: list[tuple[str, str]] = []  # (tag, text)
    tag = "p"
    open_tags: list[str] = []
    flow: list[str] = []

    def flush() -> None:
        value = _tidy(text)
        text.clear()
        if value:
            blocks.append((tag, value))
            flow.append(value)
            if row is not None:
                row.append(value)
            if form is not None:
                form["text"].append(value)

    for m in _TOKEN.finditer(source or ""):
        closing, name, rest, words = m[1], m[2], m[3], m[4]
        if words is not None:
            if in_title:
                title.append(words)
            elif not hidden:
                text.append(words)
                if link is not None:
                    link[1].append(words)
            continue
        if name is None:
            continue
        name = name.lower()
        if hidden:
            if closing and name == hidden:
                hidden = ""
            continue
        if name in _HIDDEN and not closing:
            hidden = name
            continue
        if name == "title":
            in_title = not closing
            continue
        if name == "a":
            if link is not None:
                href, anchor = link
                out["links"].append((href, _tidy(anchor)[:anchor_length]))
                link = None
            if not closing:
                href = _attributes(rest).get("href", "").strip()
                low = href.lower()
                if low.startswith("mailto:"):
                    out["mailto"].append(href[7:].split("?")[0])
                elif low.startswith("tel:"):
                    out["tel"].append(re.sub(r"[^\d+]", " ", href[4:]).strip())
                elif href and not low.startswith(("javascript:", "#")):
                    link = (urljoin(url, href).split("#")[0], [])
            continue
        marks = _attributes(rest) if rest and not closing else {}
        if form is not None and not closing and name in ("input", "textarea", "select", "button"):
            form["controls"].append(" ".join([name if name == "textarea" else "", *(marks.get(a, "") for a in _FIELDS)]))
        if name == "meta" and marks.get("property") == "og:title":
            head["og"] = marks.get("content", "")
        if name in _INLINE and name not in ("button",):
            continue
        flush()
        if closing:
            if name in open_tags:
                while open_tags and open_tags.pop() != name:
                    pass
                while contact and contact[-1][1] > len(open_tags):
                    _, _ = contact[-1]
                    begin = contact.pop()[0]
                    out["contact_texts"].append(" ".join(flow[int(begin) :]))
            if name == "tr" and row is not None:
                out["rows"].append(row)
                row = None
            elif name == "form" and form is not None:
                out["forms"].append(form)
                form = None
            continue
        tag = name
        if name == "tr":
            if row:
                out["rows"].append(row)
            row = []
        if name == "form":
            form = {"about": [marks.get(a, "") for a in ("action", "id", "class", "name", "aria-label")], "action": marks.get("action", ""), "text": [], "controls": []}
        if name not in _VOID:
            open_tags.append(name)
            marker = " ".join([name, *(marks.get(a, "") for a in ("id", "class", "itemprop", "aria-label", "role"))]).lower()
            if any(h in marker for h in L.CONTACT_CONTAINERS):
                contact.append((str(len(flow)), len(open_tags)))
    flush()
    if link is not None:
        out["links"].append((link[0], _tidy(link[1])[:anchor_length]))
    if row:
        out["rows"].append(row)
    if form is not None:
        out["forms"].append(form)
    for begin, _ in contact:
        out["contact_texts"].append(" ".join(flow[int(begin) :]))
    for i, (t, value) in enumerate(blocks):
        if t == "h1" and not head["h1"]:
            head["h1"] = value
        if t in _HEADINGS:
            out["headings"].append([value, *(v for _, v in blocks[i + 1 : i + 1 + after_heading])])
    seen, links = set(), []
    for href, anchor in out["links"]:
        if urlparse(href).scheme in ("http", "https") and href not in seen:
            seen.add(href)
            links.append({"url": href, "anchor": anchor})
    out["links"] = links
    out["blocks"] = [v for _, v in blocks]
    out["title"] = _tidy(title) or head["og"] or head["h1"]
    out["text"] = "\n".join(out["blocks"])
    out["forms"] = [{"action": f["action"], "about": " ".join([*f["about"], " ".join(f["text"])[:form_length]]).lower(), "controls": " ".join(f["controls"]).lower()} for f in out["forms"]]
    return out


def parse_pages(pages: DataFrame, key: str = "page_id", anchor_length: int | None = 120, form_length: int | None = 600, after_heading: int = 3) -> DataFrame:
    """(key, url, and the parts of the page); pages without html give empty parts."""
    source = widened(pages.select(key, F.coalesce("final_url", "url", F.lit("")).alias("url"), "html"))
    kind = source.schema[key].dataType.simpleString()
    names = [part.strip().split(" ")[0] for part in re.split(r",\s(?=\w+ (?:string|array))", SCHEMA)]

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(SCHEMA)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(h, u or "", anchor_length, form_length, after_heading) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([p[n] for p in parsed], t) for n, t in zip(names, types))], names=["key", "url", *names])

    return source.mapInArrow(run, f"key {kind}, url string, {SCHEMA}").withColumnRenamed("key", key)
