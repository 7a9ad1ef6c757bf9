"""Pages for sections and tables that come without any."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions.text import norm_title, squash, strip
from sheetloom.operators.ranges import pages_of, ranges_from_outline

FUZZY_CUTOFF = 0.86
#: A table is pinned by cells of so many first rows, and so many of them are enough.
NEEDLE_ROWS, NEEDLES_ENOUGH, HITS_NEEDED = 3, 6, 2


def _last_wins(df: DataFrame, key: list[str]) -> DataFrame:
    names = [c for c in df.columns if c not in (*key, "pos")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*names), "pos").alias("_v")).select(*key, "_v.*")


def match_sections(sections: DataFrame, toc: DataFrame) -> DataFrame:
    """sections(doc_hash, sec_pos, number, title, level) with method ``exact``
    (same number), ``title`` (same normalised title) or null, and the range.
    Of repeated numbers or titles in toc(doc_hash, pos, number, title, level,
    page) the last counts; an entry without a page matches nothing."""
    ranges = _last_wins(ranges_from_outline(toc), ["doc_hash", "number"])
    titles = _last_wins(toc.where("number <> ''").select("doc_hash", "pos", norm_title(F.col("title")).alias("key"), F.col("number").alias("toc_number")), ["doc_hash", "key"])
    by_number = ranges.select("doc_hash", "number", F.struct("page_start", "page_end").alias("a"))
    by_title = titles.join(ranges.withColumnRenamed("number", "toc_number"), ["doc_hash", "toc_number"]).select("doc_hash", "key", F.struct("page_start", "page_end").alias("b"))
    out = sections.withColumn("key", norm_title(F.col("title"))).join(by_number, ["doc_hash", "number"], "left").join(by_title, ["doc_hash", "key"], "left")
    exact, title = (F.col("number") != "") & F.col("a").isNotNull(), F.col("b").isNotNull()
    method = F.when(exact, "exact").when(title, "title")
    place = F.when(exact, F.col("a")).when(title, F.col("b"))
    return out.select("doc_hash", "sec_pos", "number", "title", "level", "key", method.alias("method"), place["page_start"].alias("page_start"), place["page_end"].alias("page_end"))


def best_title(key: str, titles: list[str], cutoff: float = FUZZY_CUTOFF) -> str | None:
    """The closest title by matching blocks; of equally close ones the
    greatest."""
    best = difflib.get_close_matches(key, titles, n=1, cutoff=cutoff)
    return best[0] if best else None


def fuzzy_sections(matched: DataFrame, toc: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """Tries the titles of the document's outline for sections without a
    match. A document's open titles and its outline meet once, in one row."""
    ranges = _last_wins(ranges_from_outline(toc), ["doc_hash", "number"])
    titles = _last_wins(toc.where("number <> ''").select("doc_hash", "pos", norm_title(F.col("title")).alias("title_key"), F.col("number").alias("toc_number")), ["doc_hash", "title_key"])
    titles = titles.join(ranges.withColumnRenamed("number", "toc_number"), ["doc_hash", "toc_number"])
    outline = titles.groupBy("doc_hash").agg(F.collect_list(F.struct("title_key", "page_start", "page_end")).alias("outline"))
    rest = matched.where("method is null")
    asked = rest.groupBy("doc_hash").agg(F.collect_set("key").alias("asked")).join(outline, "doc_hash")

    @F.pandas_udf("array<struct<key:string,page_start:int,page_end:int>>")
    def closest(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for asked_, outlines in batches:
            out = []
            for keys, entries in zip(asked_, outlines, strict=True):
                by_title = {e["title_key"]: e for e in entries}
                ordered = sorted(by_title)
                hits = [(key, best_title(key, ordered, cutoff)) for key in keys]
                out.append([{"key": k, "page_start": by_title[h]["page_start"], "page_end": by_title[h]["page_end"]} for k, h in hits if h is not None])
            yield pd.Series(out, dtype=object)

    hits = asked.select("doc_hash", F.inline(closest(F.col("asked"), F.col("outline"))).alias("key", "a", "b"))
    met = rest.drop("method", "page_start", "page_end").join(hits, ["doc_hash", "key"], "left")
    found = F.when(F.col("a").isNotNull(), "fuzzy").alias("method")
    met = met.select("doc_hash", "sec_pos", "number", "title", "level", "key", found, F.col("a").alias("page_start"), F.col("b").alias("page_end"))
    return matched.where("method is not null").unionByName(met)


def inherit_pages(matched: DataFrame) -> DataFrame:
    """A section without match inherits the range of the last section before
    it that has pages (inherited ones included), if it lies deeper; otherwise
    it stays ``unmatched``. Between two matched sections the inherited range is
    always that of the first, and the level to be deeper than only grows with
    each section that inherits: so a section inherits if it is deeper than the
    last matched one and all sections between either inherit or lie above it."""
    order = Window.partitionBy("doc_hash").orderBy("sec_pos")
    has = F.col("page_start").isNotNull()
    marked = matched.withColumn("_group", F.count(F.when(has, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("doc_hash", "_group").orderBy("sec_pos")
    # within a group the level to beat is a running maximum of what inherited, beginning with the matched section's
    reached = F.max("level").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first(F.struct("level", "page_start", "page_end")).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumns({"_first": first, "_reached": reached})
    inherits = ~has & F.col("_first.page_start").isNotNull() & (F.col("level") > F.col("_reached"))
    method = F.when(has, F.col("method")).when(inherits, "inherited").otherwise("unmatched")
    start, end = (F.when(has, F.col(c)).when(inherits, F.col(f"_first.{c}")).cast("int").alias(c) for c in ("page_start", "page_end"))
    return out.select("doc_hash", "sec_pos", "number", "title", method.alias("method"), start, end)


def assign_pages(sections: DataFrame, toc: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """The whole cascade: number, title, similar title, inheritance."""
    return inherit_pages(fuzzy_sections(match_sections(sections, toc), toc, cutoff))


def assignment_report(assigned: DataFrame, key: str = "doc_hash") -> DataFrame:
    n = {m: F.count_if(F.col("method").isin(*methods)) for m, methods in {"n_exact": ["exact"], "n_fuzzy": ["title", "fuzzy"], "n_inherited": ["inherited"], "n_unmatched": ["unmatched"]}.items()}
    counted = assigned.groupBy(key).agg(*[c.alias(m) for m, c in n.items()], F.count(F.lit(1)).alias("total"))
    return counted.withColumn("coverage", (F.col("total") - F.col("n_unmatched")) / F.col("total")).drop("total")


def needles(grid: Column) -> Column:
    """Cells that locate a table: with a digit, at least three characters and
    not all digits; or a symbol without digits. Those of the first rows, up to
    and with the row that brings enough."""
    def pick(row: Column) -> Column:
        cells = F.transform(row, lambda c: strip(F.coalesce(c, F.lit(""))))
        def wanted(c: Column) -> Column:
            digit = c.rlike(r"\d")
            return (digit & (F.length(c) >= 3) & ~c.rlike(r"^\d+$")) | (~digit & c.rlike(r"^[A-Za-z][A-Za-z0-9_+/().-]{2,}\z"))
        return F.filter(cells, wanted)

    def fold(done: Column, row: Column) -> Column:
        return F.when(F.size(done) >= NEEDLES_ENOUGH, done).otherwise(F.concat(done, row))

    picked = F.transform(F.slice(grid, 1, NEEDLE_ROWS), pick)
    every = F.aggregate(picked, F.array().cast("array<string>"), fold)
    return F.filter(F.transform(every, squash), lambda n: F.length(n) >= 2)


def pin_table_pages(tables: DataFrame, ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """(table_id, page, hits): the page within the table's section range that
    holds most of its needles (repeated needles count again), the first of
    equals, if it holds at least two. tables(table_id, doc_hash, section,
    grid), ranges(doc_hash, section, page_start, page_end), pages(doc_hash,
    page, text). Ranges become pages by explode; page texts are squashed once."""
    wanted = tables.select("table_id", "doc_hash", "section", needles(F.col("grid")).alias("needles")).where(F.size("needles") > 0)
    spans = pages_of(ranges.select("doc_hash", "section", "page_start", "page_end")).select("doc_hash", "section", "page")
    places = wanted.join(spans, ["doc_hash", "section"])
    squashed = pages.select("doc_hash", "page", squash(F.col("text")).alias("squashed"))
    met = places.join(squashed, ["doc_hash", "page"])
    hits = F.size(F.filter("needles", lambda n: F.contains(F.col("squashed"), n)))
    scored = met.select("table_id", "page", hits.alias("hits")).where(F.col("hits") >= HITS_NEEDED)
    best = F.max(F.struct("hits", -F.col("page"))).alias("best")
    return scored.groupBy("table_id").agg(best).select("table_id", (-F.col("best.col2")).alias("page"), "best.hits")


def printed_page_delta(rows: DataFrame, pages: DataFrame, deltas: tuple[int, ...] = (0, 1, -1, 2, -2)) -> DataFrame:
    """(doc_hash, delta): the shift between printed and real page numbers under
    which most titles of rows(doc_hash, title, page) stand on their page; the
    first of equals; documents without any hit are left out."""
    order = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("delta")) for i, d in enumerate(deltas)])).alias("d")
    shifted = rows.select("doc_hash", squash(F.col("title")).alias("key"), "page", order).select("doc_hash", "key", "d", (F.col("page") + F.col("d.delta")).alias("page"))
    squashed = pages.select("doc_hash", "page", squash(F.col("text")).alias("squashed"))
    hits = shifted.join(squashed, ["doc_hash", "page"]).where((F.col("key") != "") & F.contains(F.col("squashed"), F.col("key")))
    counted = hits.groupBy("doc_hash", "d").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("doc_hash").agg(F.max_by("d.delta", F.struct("n", -F.col("d.i"))).alias("delta"))


def table_of_contents(lines: DataFrame, max_pages: int = 6, least: int = 3) -> DataFrame:
    """(doc_hash, page, line_no, number, title, level, printed_page) of printed
    contents pages: pages of the first few with enough dot-leader lines. Level
    is the rank of the line's rounded left edge."""
    from sheetloom.functions import lexicons as lx

    parts = [F.regexp_extract("text", lx.DOT_LEADER, i) for i in (1, 2, 3)]
    hits = lines.where((F.col("page") <= max_pages) & F.col("text").rlike(lx.DOT_LEADER))
    hits = hits.withColumns({"number": parts[0], "title": strip(parts[1]), "printed_page": parts[2].cast("int"), "edge": F.round("x")})
    per_page = hits.groupBy("doc_hash", "page").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("doc_hash", "page")
    rank = F.dense_rank().over(Window.partitionBy("doc_hash").orderBy("edge"))
    return hits.join(per_page, ["doc_hash", "page"], "left_semi").select("doc_hash", "page", "line_no", "number", "title", rank.alias("level"), "printed_page")
