"""Viewer pages: tables of contents and sections from HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions import lexicons as lx
from sheetloom.operators.grid import Node, parse_html, table_block
from sheetloom.operators.pages import assign_pages

_WS = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+(?:\.\d+)*")
_NOTE = re.compile(r"^\s*(\(\d+\)|[†‡*§#]+|\d+\))\s*(.*)$", re.S)

TOC = "pos int, number string, title string, level int, url string"
_NOTES = "array<struct<marker:string,text:string>>"
SECTION = (
    "number string, title string, level int, paragraphs array<string>, "
    f"tables array<struct<caption:string,conditions:string,headers:array<string>,grid:array<array<string>>,footnotes:{_NOTES},cited_markers:array<string>>>, "
    "figures array<struct<caption:string,conditions:string,image_url:string>>, error string"
)


def toc_entries(html: str) -> list[tuple]:
    """(pos, number, title, level, url) of the links to sections, in order and
    with repetitions; links that are no content are left out."""
    out = []
    for a in parse_html(html).all("a"):
        href = a.attrs.get("href", "")
        if not re.search(lx.VIEWER_SECTION_URL, href):
            continue
        title = _WS.sub(" ", a.attrs.get("data-navtitle") or a.text()).strip()
        number = a.attrs.get("id", "").strip()
        numbered = _NUMBER.fullmatch(number) is not None
        cover = not numbered and (not title or title.isdigit())
        if not cover:
            out.append((len(out), number if numbered else "", title, number.count(".") + 1 if numbered else 1, href if href.startswith("http") else "https:" + href))
    return out


def _container(root: Node, url: str, title: str) -> Node | None:
    """The section's element: by id, by a heading with the title, or the first
    subsection with some text."""
    guid = re.search(r'(GUID-[^#\s"]+)', url or "")
    by_id = next((n for n in root.all("div") if guid and n.attrs.get("id") == guid[1]), None)
    if by_id:
        return by_id
    subsections = [n for n in root.all("div") if "subsection" in n.classes]
    for s in subsections:
        heading = next(s.all("h1", "h2", "h3"), None)
        if heading and title and title.lower() in heading.text().lower():
            return s
    return next((s for s in subsections if len(s.flat()) > 100), None)


def _blocks(container: Node) -> Iterator[tuple[str, Node]]:
    """Content in reading order: (kind, element). Nothing inside a table or a
    figure is a block, nor an inline element inside another."""
    for n in container.walk():
        up = list(n.ancestors())
        inside = {a.name for a in up}
        if "table" in inside or any(a.name == "div" and "graph" in a.classes for a in up) or n.classes & set(lx.VIEWER_SKIP_CLASSES):
            continue
        if n.name == "table":
            yield "table", n
        elif n.name == "li":
            yield "item", n
        elif n.name == "div" and "tablenote" in n.classes:
            yield "note", n
        elif n.name in ("p", "span") and not inside & {"p", "span"}:
            yield "text", n


def parse_section(html: str, url: str = "", number: str = "", title: str = "") -> dict:
    """The section as the fields of SECTION. Notes go to the table before
    them; a caption or test conditions right before a table go to that table."""
    container = _container(parse_html(html), url, title)
    if container is None:
        raise ValueError(f"no section for {number} {title!r}")
    heading = next(container.all("h1", "h2", "h3"), None)
    printed = _WS.sub(" ", heading.text()).strip() if heading else ""
    m = re.match(r"^(\d+(?:\.\d+)*)\s+(.*)$", printed)
    number, title = number or (m[1] if m else ""), title or (m[2] if m else printed)
    paragraphs: list[str] = []
    tables: list[dict] = []
    before: tuple[str, set[str]] | None = None  # the text block right before, and its classes
    for kind, n in _blocks(container):
        if kind == "note":
            before = None
            note = _NOTE.match(n.flat())
            if note and note[2].strip() and tables:
                known = {f["marker"] for f in tables[-1]["footnotes"]}
                if note[1] not in known:
                    tables[-1]["footnotes"].append({"marker": note[1], "text": _WS.sub(" ", note[2]).strip()})
        elif kind == "table":
            block = table_block(n) if next(n.all("img"), None) is None else {"grid": []}
            if block["grid"]:
                caption = conditions = ""
                if before and "caption" in before[1]:
                    caption = paragraphs.pop()
                elif before and any(h in before[0].lower() for h in lx.CONDITION_HINTS):
                    conditions = paragraphs.pop()
                tables.append(block | {"caption": caption, "conditions": conditions, "footnotes": []})
            before = None
        else:
            text = _WS.sub(" ", n.text(skip=("ul", "ol") if kind == "item" else ())).strip()
            if not text or text.lower() in lx.VIEWER_SKIP_TEXTS:
                continue
            depth = sum(a.name in ("ul", "ol") for a in n.ancestors())
            paragraphs.append("  " * (depth - 1) + "• " + text if kind == "item" else text)
            before = (text, n.classes)
    figures = []
    for g in (n for n in container.all("div") if "graph" in n.classes):
        image = next(g.all("img"), None)
        if image is not None:
            caption = next((x for x in g.all("span") if "caption" in x.classes), None)
            note = next((x for x in g.all("div") if "textnote" in x.classes), None)
            figures.append({"caption": caption.flat() if caption else image.attrs.get("alt", "").strip(), "conditions": note.flat() if note else "", "image_url": image.attrs.get("src", "")})
    return {"number": number, "title": title, "level": number.count(".") + 1 if number else 1, "paragraphs": paragraphs, "tables": tables, "figures": figures, "error": None}


def parse_toc(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pos, number, title, level, url) of contents pages; of repeated
    addresses the first counts. A null page has no entries."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *e) for k, text in zip(batch[key], batch[html], strict=True) for e in toc_entries(text or "")]
            yield pd.DataFrame(rows, columns=[key, "pos", "number", "title", "level", "url"])

    rows = pages.select(key, html).mapInPandas(run, f"`{key}` {kind}, {TOC}")
    first = F.row_number().over(Window.partitionBy(key, "url").orderBy("pos"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def section_of(html: Column, url: Column, number: Column, title: Column) -> Column:
    """A viewer page as a section. What can't be parsed gives an empty section
    with an error, so that one bad page fails no job."""

    @F.pandas_udf(f"struct<{SECTION_TYPE}>")
    def run(pages: pd.Series, urls: pd.Series, numbers: pd.Series, titles: pd.Series) -> pd.DataFrame:
        out = []
        for p, u, n, t in zip(pages, urls, numbers, titles, strict=True):
            try:
                out.append(parse_section(p or "", u or "", n or "", t or ""))
            except ValueError as e:
                level = (n or "").count(".") + 1 if n else 1
                out.append({"number": n or "", "title": t or "", "level": level, "paragraphs": [], "tables": [], "figures": [], "error": str(e)})
        return pd.DataFrame(out)

    return run(html, url, number, title)


SECTION_TYPE = re.sub(r"(^|, )(\w+) (?=\w)", r"\1\2:", SECTION).replace(", ", ",")


def extract_sections(toc: DataFrame, cache: DataFrame, strict: bool = True) -> DataFrame:
    """Each entry of a table of contents with its parsed page from cache(url,
    html); an entry whose page isn't there fails the job (nothing is fetched
    behind the caller's back) or, if not strict, is an empty section with an
    error."""
    joined = toc.join(cache.select("url", "html"), "url", "left")
    missing = F.concat(F.lit("no cached page for "), F.col("url"))
    page = F.coalesce("html", F.raise_error(missing).cast("string")) if strict else F.col("html")
    parsed = joined.withColumn("section", section_of(page, F.col("url"), F.col("number"), F.col("title")))
    if not strict:
        parsed = parsed.withColumn("section", F.col("section").withField("error", F.when(F.col("html").isNull(), missing).otherwise(F.col("section.error"))))
    return parsed.drop("html")


def viewer_sections(contents: DataFrame, cache: DataFrame, outline: DataFrame, strict: bool = True) -> DataFrame:
    """The whole viewer path: contents pages (doc_hash, html) -> entries ->
    cached section pages -> sections with page ranges from the printed outline
    (doc_hash, pos, number, title, level, page)."""
    parsed = extract_sections(parse_toc(contents, "doc_hash"), cache, strict)
    sections = parsed.select("doc_hash", F.col("pos").alias("sec_pos"), "section.number", "section.title", "section.level", "section.paragraphs", "section.tables", "section.figures", "section.error")
    placed = assign_pages(sections.select("doc_hash", "sec_pos", "number", "title", "level"), outline).select("doc_hash", "sec_pos", "method", "page_start", "page_end")
    return sections.join(placed, ["doc_hash", "sec_pos"], "left")
