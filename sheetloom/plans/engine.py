"""Queries that run the layout engine and the HTML reader: tables, outlines and
contents of the test tables are printed onto pages of our own, read back by the
engine and compared with what was printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.operators.html import section_of
from sheetloom.operators.layout import extract_layout
from sheetloom.plans import views as v
from sheetloom.runtime import read_table, staged

#: Where columns begin, how far rows are apart, and the printed header.
EDGES = [56.0, 222.0, 435.0, 460.0, 515.0]
PITCH = 13.0
HEADER = ["Param", "Cond", "Low", "Mid", "Unit"]
_TOC = "doc_hash string, pos int, number string, title string, level int, page int"


def _spans(rows: DataFrame, *parts: tuple[float | Column, Column]) -> DataFrame:
    """Lines of rows(doc_hash, page, y) with a span for each (x, text) that isn't empty."""
    spans = F.array(*[F.struct(F.lit(i).alias("span_no"), (F.lit(x) if isinstance(x, float) else x).alias("x0"), t.alias("text")) for i, (x, t) in enumerate(parts)])
    out = rows.select("doc_hash", "page", "y", F.inline(spans)).where("text <> ''")
    # every line lies at a height of its own
    number = (F.col("y") * 10).cast("int")
    return out.select(
        "doc_hash", F.col("page").cast("int").alias("page"), number.alias("block"), number.alias("line_no"), "span_no", "x0", (F.col("x0") + 8.0).alias("x1"),
        F.col("y").alias("y0"), (F.col("y") + 8.0).alias("y1"), F.lit(8.0).alias("size"), "text",
    )


def _boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_hash string, page int, x0 double, y0 double, x1 double, y1 double")


# --- tables ---------------------------------------------------------------------------------------------------------------------


def _printable(cell: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(cell, F.lit("")), "[^A-Za-z0-9.,]+", ""), 1, 12)


def printed_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(spans, drawings) of one document per table: its rows with two cells or
    more, from the first with a first cell on. Of tables with four rows or more
    the second half stands on a second page, under the caption and header again."""
    t = read_table(spark, d, "table_blocks").dropDuplicates(["table_id"])
    cells = F.slice(F.concat(F.transform("r", _printable), F.array_repeat(F.lit(""), 5)), 1, 5)
    rows = t.select("table_id", F.posexplode("grid").alias("i", "r")).withColumn("c", cells).where(F.size(F.filter("c", lambda x: x != "")) >= 2)
    by_table = Window.partitionBy("table_id")  # a table's rows
    rows = rows.withColumn("first", F.min(F.when(F.col("c")[0] != "", F.col("i"))).over(by_table)).where("i >= first")
    rows = rows.withColumns({"k": F.row_number().over(by_table.orderBy("i")), "n": F.count(F.lit(1)).over(by_table)}).where("n >= 2")
    m = F.when(F.col("n") >= 4, F.ceil(F.col("n") / 2)).otherwise(F.col("n"))
    rows = staged(rows.withColumn("m", m), "printed").withColumn("doc_hash", F.concat(F.lit("t"), "table_id"))
    page = F.when(F.col("k") <= F.col("m"), 1).otherwise(2)
    # the second page begins below where the first ended
    top = 120.0 + F.when(F.col("page") == 2, PITCH * F.col("m") + 100.0).otherwise(0.0)
    body = rows.withColumn("page", page).withColumn("y", top + PITCH * (F.col("k") - F.when(F.col("page") == 2, F.col("m")).otherwise(0)))
    heads = rows.where("k = 1").withColumn("page", F.explode(F.when(F.col("n") > F.col("m"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).withColumn("y", top)
    caption = heads.withColumn("y", F.col("y") - 20.0)
    above = heads.where("page = 1").withColumn("y", F.col("y") - 36.0)
    last = body.where("k = n").withColumn("last", F.col("y"))
    notes = [last.withColumn("y", F.col("last") + PITCH * j) for j in (1, 2)]
    printed = [
        _spans(body, *[(x, F.col("c")[i]) for i, x in enumerate(EDGES)]),
        _spans(heads, *[(x, F.lit(h)) for x, h in zip(EDGES, HEADER, strict=True)]),
        _spans(caption, (56.0, F.concat(F.lit("Table "), F.col("table_id").cast("string"), F.lit(". Block")))),
        _spans(above, (56.0, F.concat(F.lit("Held at state "), F.col("table_id").cast("string")))),
        *[_spans(x, (56.0, F.concat(F.lit(f"({j}) Noted below table "), F.col("table_id").cast("string"), F.lit(" for all rows")))) for j, x in enumerate(notes, 1)],
    ]
    spans = printed[0]
    for p in printed[1:]:
        spans = spans.unionByName(p)
    ruling = heads.select("doc_hash", F.col("page").cast("int").alias("page"), F.lit(200.0).alias("x0"), F.col("y").alias("y0"), F.lit(200.5).alias("x1"), (F.col("y") + 20.0).alias("y1"))
    return spans, ruling


def layout_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every printed table as the engine reads it."""
    spans, rulings = printed_tables(spark, d)
    sections = extract_layout(spans, rulings, spark.createDataFrame([], _TOC))
    t = sections.select("doc_hash", "tables_detected", "tables_accepted", F.round("mean_fidelity", 9).alias("fidelity"), F.explode("tables").alias("t"))
    flat = F.array_join(F.transform("t.grid", lambda r: F.array_join(r, "|")), "\n")
    notes = F.array_join(F.transform("t.footnotes", lambda f: F.concat(f["marker"], F.lit(" "), f["text"])), "\n")
    return t.select("doc_hash", "tables_detected", "tables_accepted", "fidelity", "t.caption", "t.conditions", F.array_join("t.headers", "|").alias("headers"), flat.alias("grid"), notes.alias("footnotes"), "t.page", F.array_join("t.row_pages", ",").alias("row_pages"))


_TABLES_SQL = """
WITH g AS (SELECT table_id, generate_subscripts(grid, 1) AS i, unnest(grid) AS r FROM (SELECT DISTINCT ON (table_id) * FROM table_blocks)),
c AS (SELECT table_id, i, list_concat(list_transform(r, lambda x: substr(regexp_replace(coalesce(x, ''), '[^A-Za-z0-9.,]+', '', 'g'), 1, 12)), ['', '', '', '', ''])[1:5] AS c FROM g),
k0 AS (SELECT *, min(CASE WHEN c[1] <> '' THEN i END) OVER (PARTITION BY table_id) AS first FROM c WHERE len(list_filter(c, lambda x: x <> '')) >= 2),
k1 AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY i) AS k, count(*) OVER (PARTITION BY table_id) AS n FROM k0 WHERE i >= first),
k2 AS (SELECT *, CASE WHEN n >= 4 THEN (n + 1) // 2 ELSE n END AS m FROM k1 WHERE n >= 2),
k3 AS (SELECT *, CASE WHEN k <= m THEN 1 ELSE 2 END AS page,
  max(CASE WHEN c[1] <> '' THEN k END) OVER (PARTITION BY table_id, k <= m ORDER BY k) AS up, min(CASE WHEN c[1] <> '' THEN k END) OVER (PARTITION BY table_id, k <= m ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS down FROM k2),
p1 AS (SELECT a.table_id, a.k, b.c[1] AS param FROM k3 a JOIN k3 b ON b.table_id = a.table_id AND b.k = CASE WHEN a.down IS NULL OR a.k - a.up <= a.down - a.k THEN a.up ELSE a.down END WHERE a.page = 1),
ends AS (SELECT p1.table_id, p1.param FROM p1 JOIN k3 ON k3.table_id = p1.table_id AND k3.k = p1.k WHERE k3.k = k3.m),
p2 AS (SELECT a.table_id, a.k, coalesce(b.c[1], e.param) AS param FROM k3 a LEFT JOIN k3 b ON b.table_id = a.table_id AND b.k = a.up AND b.page = 2 JOIN ends e ON e.table_id = a.table_id WHERE a.page = 2),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
t AS (SELECT k3.table_id, any_value(n) AS n, any_value(m) AS m, sum(len(list_filter(c, lambda x: x <> ''))) + 5 AS w,
  string_agg(p.param || '|' || array_to_string(c[2:5], '|'), chr(10) ORDER BY k3.k) AS grid, string_agg(page, ',' ORDER BY k3.k) AS row_pages FROM k3 JOIN p ON p.table_id = k3.table_id AND p.k = k3.k GROUP BY k3.table_id)
SELECT 't' || table_id AS doc_hash, CASE WHEN n > m THEN 2 ELSE 1 END AS tables_detected, CASE WHEN n > m THEN 2 ELSE 1 END AS tables_accepted, CASE WHEN n > m THEN 1.0::DOUBLE ELSE round(w / (w + 16.0)::DOUBLE, 9) END AS fidelity,
  'Table ' || table_id || '. Block' AS caption, 'Held at state ' || table_id AS conditions, 'Param|Cond|Low|Mid|Unit' AS headers, grid,
  '1 Noted below table ' || table_id || ' for all rows' || chr(10) || '2 Noted below table ' || table_id || ' for all rows' AS footnotes, 1 AS page, row_pages FROM t"""


# --- sections -------------------------------------------------------------------------------------------------------------------


def _bodies(pages: DataFrame) -> DataFrame:
    """A line of text on each page, and its number among the pages."""
    text = F.concat(F.lit("Body text of page "), F.col("page").cast("string"), F.lit(" from "), F.substring("doc_hash", 1, 8))
    numbers = F.concat(F.col("page").cast("string"), F.lit(" of "), F.col("last").cast("string"))
    return _spans(pages.withColumn("y", F.lit(600.0)), (56.0, text)).unionByName(_spans(pages.withColumn("y", F.lit(30.0)), (300.0, numbers)))


def _read(spans: DataFrame, toc: DataFrame) -> DataFrame:
    s = extract_layout(spans, _boxes(spans.sparkSession), toc)
    figures = F.array_join(F.transform("figures", lambda f: f["caption"]), "\n")
    return s.select("doc_hash", "sec_pos", "number", "title", "level", "page_start", "page_end", F.array_join("paragraphs", "\n").alias("paragraphs"), figures.alias("figures"), "ladder")


def layout_sections(spark: SparkSession, d: str) -> DataFrame:
    """Documents of two pages or more printed by their outline: a title where
    each entry begins, a body and a number on each page, a figure on every
    second; read back with the outline."""
    toc = staged(v.outline(spark, d), "outline")
    last = v.unique_sections(spark, d, "page_start", "page_end").groupBy("doc_hash").agg(F.max(F.coalesce("page_end", "page_start")).alias("last")).where("last >= 2")
    toc = toc.join(last, "doc_hash").join(toc.where("page is not null").select("doc_hash").distinct(), "doc_hash", "left_semi")
    pages = toc.select("doc_hash", "last").distinct().withColumn("page", F.explode(F.sequence(F.lit(1), "last")))
    order = F.row_number().over(Window.partitionBy("doc_hash", "page").orderBy("pos"))
    titles = toc.where("page is not null").withColumn("y", 100.0 + 0.5 * order)
    spans = _bodies(pages).unionByName(_spans(titles, (56.0, F.trim(F.concat("number", F.lit(" "), "title")))))
    figures = pages.where("page % 2 = 0").withColumn("y", F.lit(500.0))
    spans = spans.unionByName(_spans(figures, (56.0, F.concat(F.lit("Figure "), F.col("page").cast("string"), F.lit(". Plot of "), F.substring("doc_hash", 1, 8)))))
    return _read(spans, toc.drop("last"))


_OWNERS = """x AS (SELECT doc_hash, pos, level, unnest(range(page_start, page_end + 1)) AS page FROM r),
deep AS (SELECT doc_hash, page, max(level) AS level FROM x GROUP BY ALL),
own AS (SELECT x.* FROM x JOIN deep ON deep.doc_hash = x.doc_hash AND deep.page = x.page AND deep.level <= x.level),
firsts AS (SELECT doc_hash, page, min(pos) AS pos FROM own GROUP BY ALL),
b AS (SELECT doc_hash, pos, string_agg('Body text of page ' || page || ' from ' || substr(doc_hash, 1, 8), chr(10) ORDER BY page) AS paragraphs FROM own GROUP BY ALL)"""

_SECTIONS_SQL = f"""
WITH z AS (SELECT doc_hash, max(coalesce(page_end, page_start)) AS last FROM unique_sections GROUP BY doc_hash),
o AS (SELECT o.*, z.last FROM outline o JOIN z ON z.doc_hash = o.doc_hash WHERE z.last >= 2 AND o.page IS NOT NULL),
up AS (SELECT a.doc_hash, a.pos, arg_min(n.page, n.pos) AS up FROM o a JOIN o n ON n.doc_hash = a.doc_hash AND n.pos > a.pos AND n.level <= a.level GROUP BY ALL),
r AS (SELECT o.doc_hash, o.pos, number, title, level, page AS page_start, greatest(page, coalesce(up - 1, last)) AS page_end FROM o LEFT JOIN up ON up.doc_hash = o.doc_hash AND up.pos = o.pos),
{_OWNERS},
f AS (SELECT doc_hash, pos, string_agg('Figure ' || page || '. Plot of ' || substr(doc_hash, 1, 8), chr(10) ORDER BY page) AS figures FROM firsts WHERE page % 2 = 0 GROUP BY ALL),
nth AS (SELECT doc_hash, pos, row_number() OVER (PARTITION BY doc_hash ORDER BY pos) - 1 AS sec_pos FROM outline)
SELECT r.doc_hash, CAST(nth.sec_pos AS INTEGER) AS sec_pos, r.number, r.title, r.level, page_start, page_end, coalesce(b.paragraphs, '') AS paragraphs, coalesce(f.figures, '') AS figures, 'outline' AS ladder
FROM r JOIN nth ON nth.doc_hash = r.doc_hash AND nth.pos = r.pos LEFT JOIN b ON b.doc_hash = r.doc_hash AND b.pos = r.pos LEFT JOIN f ON f.doc_hash = r.doc_hash AND f.pos = r.pos"""


def printed_contents(spark: SparkSession, d: str) -> DataFrame:
    """Documents without outline, but with a printed contents page whose numbers
    are one short of the real ones; the engine finds the shift."""
    title = F.concat(F.trim(F.regexp_replace("title", "[^A-Za-z]+", " ")), F.lit(" part "), F.col("pos").cast("string"))
    rows = v.outline(spark, d).where(r"page is not null and number rlike '^\\d+(\\.\\d+)*$'").withColumn("title", title)
    counted = rows.groupBy("doc_hash").agg(F.count(F.lit(1)).alias("n"), (F.max("page") + 1).alias("last")).where("n >= 3")
    rows = staged(rows.join(counted, "doc_hash"), "contents")
    order = F.row_number().over(Window.partitionBy("doc_hash").orderBy("pos"))
    lines = rows.withColumns({"printed": F.col("page"), "y": 40.0 + 12.0 * order, "x": 56.0 + 10.0 * F.col("level")}).withColumn("page", F.lit(1))
    entry = F.concat("number", F.lit(" "), "title", F.lit(" ........ "), F.col("printed").cast("string"))
    at = F.row_number().over(Window.partitionBy("doc_hash", "page").orderBy("pos"))
    titles = rows.withColumn("y", 100.0 + 0.5 * at).withColumn("page", F.col("page") + 1)
    pages = counted.withColumn("page", F.explode(F.sequence(F.lit(2), "last")))
    spans = _spans(lines, (F.col("x"), entry)).unionByName(_spans(titles, (56.0, F.col("title")))).unionByName(_bodies(pages))
    return _read(spans, spark.createDataFrame([], _TOC)).drop("figures")


_CONTENTS_SQL = rf"""
WITH o0 AS (SELECT doc_hash, pos, number, trim(regexp_replace(title, '[^A-Za-z]+', ' ', 'g')) || ' part ' || pos AS title, level, page + 1 AS page FROM outline WHERE page IS NOT NULL AND regexp_matches(number, '^\d+(\.\d+)*$')),
z AS (SELECT doc_hash, max(page) AS last FROM o0 GROUP BY doc_hash HAVING count(*) >= 3),
o AS (SELECT o0.doc_hash, row_number() OVER (PARTITION BY o0.doc_hash ORDER BY pos) - 1 AS pos, number, trim(title) AS title, dense_rank() OVER (PARTITION BY o0.doc_hash ORDER BY level) AS level, page, last FROM o0 JOIN z ON z.doc_hash = o0.doc_hash),
up AS (SELECT a.doc_hash, a.pos, arg_min(n.page, n.pos) AS up FROM o a JOIN o n ON n.doc_hash = a.doc_hash AND n.pos > a.pos AND n.level <= a.level GROUP BY ALL),
r AS (SELECT o.doc_hash, o.pos, number, title, level, page AS page_start, greatest(page, coalesce(up - 1, last)) AS page_end FROM o LEFT JOIN up ON up.doc_hash = o.doc_hash AND up.pos = o.pos),
{_OWNERS}
SELECT r.doc_hash, CAST(r.pos AS INTEGER) AS sec_pos, r.number, r.title, CAST(r.level AS INTEGER) AS level, page_start, page_end, coalesce(b.paragraphs, '') AS paragraphs, 'printed_toc' AS ladder FROM r LEFT JOIN b ON b.doc_hash = r.doc_hash AND b.pos = r.pos"""


# --- HTML -----------------------------------------------------------------------------------------------------------------------


def _escaped(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every table as a viewer page, read back: its number and title, its table
    with caption, notes and grid."""
    t = read_table(spark, d, "table_blocks").dropDuplicates(["table_id"]).where("grid is not null and headers is not null")

    def row(cells: Column, tag: str) -> Column:
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), _escaped(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))

    notes = F.array_join(F.transform(F.coalesce("footnotes", F.array().cast("array<struct<marker:string,text:string>>")), lambda f: F.concat(F.lit('<div class="tablenote">'), _escaped(f["marker"]), F.lit(" "), _escaped(f["text"]), F.lit("</div>"))), "")
    page = F.concat(
        F.lit('<html><body><div class="subsection" id="GUID-'), F.col("table_id").cast("string"), F.lit('"><h2>4.2 Limits of a block</h2><p>Read this before the table, please.</p><p class="caption">Block '), F.col("table_id").cast("string"),
        F.lit("</p><table><thead>"), row(F.col("headers"), "th"), F.lit("</thead><tbody>"), F.array_join(F.transform("grid", lambda r: row(r, "td")), ""), F.lit("</tbody></table>"), notes, F.lit("</div></body></html>"),
    )
    s = section_of(page, F.concat(F.lit("https://x.example/#GUID-"), F.col("table_id").cast("string")), F.lit(""), F.lit(""))
    out = t.select("table_id", s.alias("s")).select("table_id", "s.number", "s.title", F.array_join("s.paragraphs", "\n").alias("paragraphs"), F.get("s.tables", F.lit(0)).alias("t"))
    flat = F.array_join(F.transform("t.grid", lambda r: F.array_join(r, "|")), "\n")
    return out.select("table_id", "number", "title", "paragraphs", "t.caption", F.array_join("t.headers", "|").alias("headers"), flat.alias("grid"))


_WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def _flat(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '{_WS}+', ' ', 'g'))"


_HTML_SQL = rf"""
SELECT table_id, '4.2' AS number, 'Limits of a block' AS title, 'Read this before the table, please.' || CASE WHEN len(rows) = 0 THEN chr(10) || 'Block ' || table_id ELSE '' END AS paragraphs, CASE WHEN len(rows) > 0 THEN 'Block ' || table_id END AS caption,
  CASE WHEN len(rows) > 0 THEN array_to_string(list_transform(headers, lambda h: {_flat('h')}), '|') END AS headers, CASE WHEN len(rows) > 0 THEN array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), chr(10)) END AS grid
FROM (SELECT table_id, headers, list_filter(list_transform(grid, lambda r: list_transform(r, lambda c: {_flat('c')})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows
      FROM (SELECT DISTINCT ON (table_id) * FROM table_blocks) WHERE grid IS NOT NULL AND headers IS NOT NULL)"""


def queries() -> dict:
    return {f.__name__: f for f in (layout_tables, layout_sections, printed_contents, html_tables)}


def oracle_sql() -> dict[str, str]:
    return {"layout_tables": _TABLES_SQL, "layout_sections": v.with_views(_SECTIONS_SQL), "printed_contents": v.with_views(_CONTENTS_SQL), "html_tables": _HTML_SQL}
