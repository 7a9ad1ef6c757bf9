"""Page furniture: lines that repeat by fixed pattern or by their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import lexicons as lx
from sheetloom.functions.text import is_boilerplate, is_placed_furniture, strip


def kept_lines(lines: Column) -> Column:
    """Lines of an array that match no boilerplate pattern."""
    return F.filter(lines, lambda x: ~F.coalesce(is_boilerplate(x), F.lit(False)))


def strip_boilerplate(text: Column) -> Column:
    """struct(text, removed): boilerplate lines dropped, the blank runs they
    leave collapsed. Line ends are those of splitlines that regex \\R knows."""
    lines = F.split(text, r"\R")
    kept = kept_lines(lines)
    clean = strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))
    return F.struct(clean.alias("text"), (F.size(lines) - F.size(kept)).alias("removed"))


def page_paragraphs(text: Column, page: Column) -> Column:
    """Non-blank lines of a page, stripped, without its own page number."""
    lines = F.transform(F.split(text, r"\R"), strip)
    return F.filter(lines, lambda x: (x != "") & (x != page.cast("string")))


def furniture_lines(lines: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """lines(doc_hash, page, line_no, x, y, text) with a column ``furniture``.

    A slot is a band of SLOT_HEIGHT points; it recurs if it or a neighbour
    holds lines on enough pages of the document. A line of a recurring slot is
    furniture if it is page machinery or its text stands in this or a
    neighbouring slot on enough pages. page_counts (doc_hash, n_pages) may give
    pages without lines; otherwise pages with lines count.

    Two aggregates over distinct (slot, page) rows, joined back by slot and by
    (slot, text); a document is never gathered in one place."""
    banded = lines.withColumn("band", F.floor(F.col("y") / lx.SLOT_HEIGHT))
    if page_counts is None:
        page_counts = lines.groupBy("doc_hash").agg(F.countDistinct("page").alias("n_pages"))
    enough = F.greatest(F.lit(lx.SLOT_PAGES), F.ceil(F.col("n_pages") * lx.SLOT_SHARE)).alias("enough")
    near = F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])).alias("band")
    slots = banded.select("doc_hash", "band", "page").distinct().select("doc_hash", near, "page").groupBy("doc_hash", "band").agg(F.countDistinct("page").alias("slot_pages"))
    texts = banded.select("doc_hash", "band", "page", "text").distinct()
    texts = texts.select("doc_hash", near, "page", "text").groupBy("doc_hash", "band", "text").agg(F.countDistinct("page").alias("text_pages"))
    joined = banded.join(page_counts.select("doc_hash", enough), "doc_hash").join(slots, ["doc_hash", "band"]).join(texts, ["doc_hash", "band", "text"])
    placed = is_placed_furniture(F.col("text"), F.col("page"), F.col("x"), F.col("y"))
    mark = (F.col("slot_pages") >= F.col("enough")) & (placed | (F.col("text_pages") >= F.col("enough")))
    return joined.select(*lines.columns, mark.alias("furniture"))


def paragraphs_by_block(lines: DataFrame) -> DataFrame:
    """(doc_hash, page, block, paragraph): the lines of a block in order,
    joined by blanks."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    joined = F.array_join(F.transform(ordered, lambda x: x["text"]), " ")
    return lines.groupBy("doc_hash", "page", "block").agg(joined.alias("paragraph"))
