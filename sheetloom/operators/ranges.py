"""Page ranges of sections, and joins on them. Ranges become pages by explode,
so that every join is an equi-join; the next section of the same or a higher
level comes from one sorted window, without a self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels beyond this are replaced by their rank within the document.
PLAIN_LEVELS = 16


def with_next_page_up(toc: DataFrame, doc: str, pos: str, level: str, page: str) -> DataFrame:
    """toc with ``up``: the page of the next entry of the same or a higher
    level in the document. One window runs backwards with a running value for
    each level that occurs, so frames only grow; levels are ranked first where
    they are large, so that there are as many values as one document has
    different levels."""
    depth = F.col(level)
    lowest, most = toc.agg(F.min(level), F.max(level)).first()
    if most is not None and (most > PLAIN_LEVELS or lowest < 1):
        toc = toc.withColumn("_depth", F.dense_rank().over(Window.partitionBy(doc).orderBy(level)))
        depth, most = F.col("_depth"), toc.agg(F.max("_depth")).first()[0]
    behind = Window.partitionBy(doc).orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, -1)
    by_level = [F.last(F.when(depth <= n, F.col(page)), ignorenulls=True).over(behind) for n in range(1, (most or 1) + 1)]
    return toc.withColumn("up", F.get(F.array(*by_level), depth - 1)).drop("_depth")


def ranges_from_outline(toc: DataFrame, doc: str = "doc_hash", pos: str = "pos") -> DataFrame:
    """(doc, pos, number, page_start, page_end) of numbered entries with a
    page. A range ends before the next numbered, paged entry of the same or a
    higher level, never before its start; the last one ends on its own page."""
    kept = toc.where("number <> '' and page is not null")
    kept = with_next_page_up(kept, doc, pos, "level", "page")
    end = F.coalesce(F.greatest(F.col("page"), F.col("up") - 1), F.col("page"))
    return kept.select(doc, pos, "number", F.col("page").alias("page_start"), end.alias("page_end"))


def ranges_to_document_end(toc: DataFrame, last_pages: DataFrame, doc: str = "doc_hash", pos: str = "pos") -> DataFrame:
    """(doc, pos, level, page_start, page_end) of entries with a page. Like
    ranges_from_outline, but unnumbered entries take part and the last entry of
    a level ends with the document (last_pages: doc, last_page)."""
    kept = with_next_page_up(toc.where("page is not null"), doc, pos, "level", "page")
    joined = kept.join(last_pages, doc, "left")
    end = F.greatest(F.col("page"), F.coalesce(F.col("up") - 1, F.col("last_page")))
    return joined.select(doc, pos, "level", F.col("page").alias("page_start"), end.alias("page_end"))


def pages_of(ranges: DataFrame, page: str = "page") -> DataFrame:
    """One row per page of each range; a null end means one page, a null start
    no page. Ends before their start count as one page too."""
    last = F.greatest(F.col("page_start"), F.coalesce(F.when(F.col("page_end") != 0, F.col("page_end")), F.col("page_start")))
    return ranges.where("page_start is not null").withColumn(page, F.explode(F.sequence("page_start", last)))


def owned_by_deeper(ranges: DataFrame, doc: str = "doc_hash", pos: str = "pos") -> DataFrame:
    """(doc, pos, page, owned): whether a strictly deeper range covers the
    page too. One aggregate per page instead of comparing all pairs."""
    pages = pages_of(ranges)
    deepest = pages.groupBy(doc, "page").agg(F.max("level").alias("deepest"))
    return pages.join(deepest, [doc, "page"]).select(doc, pos, "page", (F.col("deepest") > F.col("level")).alias("owned"))


def covering_sections(questions: DataFrame, sections: DataFrame, question: str = "question_id") -> DataFrame:
    """(question, file) of the sections whose range covers a cited page."""
    asked = questions.select(question, "doc_hash", F.explode("pages").alias("page"))
    covered = pages_of(sections.select("doc_hash", "file", "page_start", "page_end")).select("doc_hash", "file", "page")
    return asked.join(covered, ["doc_hash", "page"]).select(question, "file").distinct()
