"""Sections from plain page texts: the degraded path of companion documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.operators.furniture import page_paragraphs
from sheetloom.operators.ranges import pages_of, ranges_to_document_end


def plain_sections(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """(doc_hash, sec_pos, number, title, level, page_start, page_end,
    paragraphs) from pages(doc_hash, page, text) and toc(doc_hash, pos, number,
    title, level, page). A section's paragraphs are the lines of its pages; a
    document without any entry that has a page has one section per page, a
    document without pages no section."""
    lines = pages.select("doc_hash", "page", page_paragraphs(F.coalesce("text", F.lit("")), F.col("page")).alias("lines"))
    last = pages.groupBy("doc_hash").agg(F.max("page").alias("last_page"))
    toc = toc.where("page is not null").join(last.select("doc_hash"), "doc_hash", "left_semi")
    ranges = ranges_to_document_end(toc, last)
    placed = pages_of(ranges).select("doc_hash", "pos", "page").join(lines, ["doc_hash", "page"])
    ordered = F.array_sort(F.collect_list(F.struct("page", "lines")))
    texts = placed.groupBy("doc_hash", "pos").agg(F.flatten(F.transform(ordered, lambda x: x["lines"])).alias("paragraphs"))
    none = F.array().cast("array<string>")
    with_toc = ranges.drop("level").join(toc.select("doc_hash", "pos", "number", "title", "level"), ["doc_hash", "pos"]).join(texts, ["doc_hash", "pos"], "left")
    with_toc = with_toc.select("doc_hash", F.col("pos").alias("sec_pos"), "number", "title", "level", "page_start", "page_end", F.coalesce("paragraphs", none).alias("paragraphs"))
    page = F.col("page").cast("string")
    alone = lines.join(toc.select("doc_hash").distinct(), "doc_hash", "left_anti")
    alone = alone.select("doc_hash", (F.col("page") - 1).alias("sec_pos"), page.alias("number"), F.concat(F.lit("Page "), page).alias("title"), F.lit(1).alias("level"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.col("lines").alias("paragraphs"))
    return with_toc.unionByName(alone)
