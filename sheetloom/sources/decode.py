"""PDF files as decoded rows, where a PDF library is installed.

The engine itself only needs the rows; these functions fill its input tables
from files and raise DecoderMissing where the library isn't there."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

PAGES = "doc_hash string, page int, text string"
TOC = "doc_hash string, pos int, number string, title string, level int, page int"
SPANS = "doc_hash string, page int, block int, line_no int, span_no int, x0 double, x1 double, y0 double, y1 double, size double, text string"
DRAWINGS = "doc_hash string, page int, x0 double, y0 double, x1 double, y1 double"


class DecoderMissing(RuntimeError):
    pass


def _library():
    try:
        import pymupdf
    except ImportError:
        try:
            import fitz as pymupdf
        except ImportError as e:
            raise DecoderMissing("no PDF library is installed: bring decoded tables instead") from e
    return pymupdf


def available() -> bool:
    try:
        _library()
    except DecoderMissing:
        return False
    return True


def _pages(doc, key: str) -> Iterator[tuple]:
    for i, page in enumerate(doc, 1):
        yield key, i, page.get_text()


def _toc(doc, key: str) -> Iterator[tuple]:
    import re

    for pos, (level, title, page) in enumerate(doc.get_toc()):
        m = re.match(r"(\d+(?:\.\d+)*)\s*[. ]?\s*(.*)$", title.strip(), re.S)
        number, rest = m.groups() if m else ("", title)
        yield key, pos, number, rest.strip(), level, page or None


def _spans(doc, key: str) -> Iterator[tuple]:
    for i, page in enumerate(doc, 1):
        for b, block in enumerate(page.get_text("dict")["blocks"]):
            for n, line in enumerate(block.get("lines", ())):
                for k, s in enumerate(line["spans"]):
                    x0, y0, x1, y1 = s["bbox"]
                    yield key, i, b, n, k, x0, x1, y0, y1, s["size"], s["text"]


def _drawings(doc, key: str) -> Iterator[tuple]:
    for i, page in enumerate(doc, 1):
        for d in page.get_drawings():
            r = d["rect"]
            yield key, i, r.x0, r.y0, r.x1, r.y1


def decode(files: DataFrame) -> dict[str, DataFrame]:
    """pages, toc, page_spans and page_drawings of files(content_hash,
    content). A file is decoded in the task that reads it; one that can't be
    decoded gives no rows."""
    _library()

    def table(rows, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            library = _library()
            for batch in batches:
                for key, content in zip(batch["content_hash"], batch["content"], strict=True):
                    try:
                        with library.open(stream=content, filetype="pdf") as doc:
                            out = list(rows(doc, key))
                    except Exception:  # noqa: BLE001 - any damage a file may have
                        out = []
                    yield pd.DataFrame(out, columns=names)

        return files.select("content_hash", "content").mapInPandas(run, schema)

    return {"pages": table(_pages, PAGES), "toc": table(_toc, TOC), "page_spans": table(_spans, SPANS), "page_drawings": table(_drawings, DRAWINGS)}
