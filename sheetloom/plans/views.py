"""Projections of the test tables onto the inputs of the operators, each with
the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions.text import split_number
from sheetloom.operators.inventory import dedupe_first
from sheetloom.runtime import numbered, read_table


def unique_sections(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per (doc_hash, sec_pos): the extraction with the smallest id."""
    cols = list(dict.fromkeys(("section_id", "doc_hash", "sec_pos", *columns)))
    rows = read_table(spark, d, "sections").select(*cols)
    return dedupe_first(rows, F.struct("doc_hash", "sec_pos"), ["section_id"])


def outline(spark: SparkSession, d: str) -> DataFrame:
    """toc(doc_hash, pos, number, title, level, page) from the sections."""
    s = unique_sections(spark, d, "number", "title", "level", "page_start")
    return s.select("doc_hash", F.col("sec_pos").alias("pos"), "number", F.coalesce("title", F.lit("")).alias("title"), "level", F.col("page_start").alias("page"))


def unique_plans(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "section_plans").select("plan_id", "doc_hash", "sec_pos", "file", "markdown")
    return dedupe_first(rows, F.struct("doc_hash", "sec_pos"), ["plan_id"])


def placed_plans(spark: SparkSession, d: str) -> DataFrame:
    """(doc_hash, sec_pos, file, page_start, page_end, text) of rendered
    sections; files are kept apart by their position."""
    pages = unique_sections(spark, d, "page_start", "page_end").select("doc_hash", "sec_pos", "page_start", "page_end")
    plans = unique_plans(spark, d).where("markdown is not null")
    file = F.format_string("%03d-%s", "sec_pos", "file")
    return plans.join(pages, ["doc_hash", "sec_pos"]).select("doc_hash", "sec_pos", file.alias("file"), "page_start", "page_end", F.col("markdown").alias("text"))


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """(doc_hash, page, text): what begins on a page, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("sec_pos", "text")))
    text = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    return placed_plans(spark, d).where("page_start is not null").groupBy("doc_hash", F.col("page_start").alias("page")).agg(text.alias("text"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    q = read_table(spark, d, "golden_questions")
    return q.withColumn("is_plot", F.coalesce(F.size("plot_query") > 0, F.lit(False)))


def headings(spark: SparkSession, d: str) -> DataFrame:
    """(doc_hash, sec_pos, number, title, level) from the rendered headings."""
    first = F.regexp_extract("markdown", r"^# ([^\n]*)", 1)
    h = unique_plans(spark, d).where("markdown is not null").select("doc_hash", "sec_pos", split_number(first).alias("h"))
    level = F.when(F.col("h.number") != "", F.size(F.split("h.number", r"\."))).otherwise(1)
    return h.select("doc_hash", "sec_pos", "h.number", "h.title", level.alias("level"))


def figures(spark: SparkSession, d: str) -> DataFrame:
    """Figure lines of rendered sections: ``- **caption** — conditions (p.N)``."""
    pattern = r"(?m)^- \*\*(Figure [^\n]*?)\*\*(?: — ([^\n]*?))?(?: \(p\.(\d+)\))?$"
    groups = F.arrays_zip(*[F.regexp_extract_all("markdown", F.lit(pattern), i).alias(n) for i, n in ((1, "caption"), (2, "conditions"), (3, "page"))])
    rows = unique_plans(spark, d).select("doc_hash", "sec_pos", F.posexplode(groups).alias("fig_pos", "g"))
    heads = headings(spark, d).select("doc_hash", "sec_pos", "number", "title")
    page = F.when(F.col("g.page") != "", F.col("g.page").cast("int"))
    return rows.join(heads, ["doc_hash", "sec_pos"]).select(
        "doc_hash", "sec_pos", "number", "title", "fig_pos", F.col("g.caption").alias("caption"), F.col("g.conditions").alias("conditions"), page.alias("page_start"), page.alias("page_end"), F.lit("").alias("image_url")
    )


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """lines(doc_hash, page, line_no, x, y, block, text): the documents of one
    source and language are the pages of one document, numbered by id."""
    docs = read_table(spark, d, "documents").where("text is not null").select(F.concat_ws("/", "source", "lang").alias("doc_hash"), "doc_id", "text")
    lines = numbered(docs, "doc_hash", "doc_id", "page").select("doc_hash", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.select("doc_hash", "page", "line_no", F.lit(90.0).alias("x"), (F.col("line_no") * 13.0).alias("y"), F.expr("line_no div 3").alias("block"), "text")


# The same in SQL.
SQL = {
    "unique_sections": "SELECT * FROM sections QUALIFY row_number() OVER (PARTITION BY doc_hash, sec_pos ORDER BY section_id) = 1",
    "outline": "SELECT doc_hash, sec_pos AS pos, number, coalesce(title, '') AS title, level, page_start AS page FROM unique_sections",
    "unique_plans": "SELECT * FROM section_plans QUALIFY row_number() OVER (PARTITION BY doc_hash, sec_pos ORDER BY plan_id) = 1",
    "placed_plans": """SELECT p.doc_hash, p.sec_pos, printf('%03d-%s', p.sec_pos, p.file) AS file, s.page_start, s.page_end, p.markdown AS text
        FROM unique_plans p JOIN unique_sections s ON p.doc_hash = s.doc_hash AND p.sec_pos = s.sec_pos WHERE p.markdown IS NOT NULL""",
    "page_texts": "SELECT doc_hash, page_start AS page, string_agg(text, chr(10) ORDER BY sec_pos) AS text FROM placed_plans WHERE page_start IS NOT NULL GROUP BY ALL",
    "questions": "SELECT *, coalesce(cardinality(plot_query) > 0, false) AS is_plot FROM golden_questions",
    "headings": r"""SELECT doc_hash, sec_pos, number, title, CASE WHEN number <> '' THEN len(string_split(number, '.')) ELSE 1 END AS level FROM (
        SELECT doc_hash, sec_pos, CASE WHEN h ~ '^\d.*' THEN regexp_extract(h, '^(\d+(?:\.\d+)*)\s*[. ]?\s*(.*)$', 1) ELSE '' END AS number,
          CASE WHEN h ~ '^\d.*' THEN trim(regexp_extract(h, '^(\d+(?:\.\d+)*)\s*[. ]?\s*(.*)$', 2)) ELSE h END AS title
        FROM (SELECT doc_hash, sec_pos, trim(regexp_extract(markdown, '^# ([^\n]*)', 1)) AS h FROM unique_plans WHERE markdown IS NOT NULL))""",
    "document_lines": """SELECT doc_hash, page, i AS line_no, 90.0::DOUBLE AS x, (i * 13.0)::DOUBLE AS y, i // 3 AS block, text FROM (
        SELECT doc_hash, page, unnest(string_split(t, chr(10))) AS text, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM (
          SELECT concat_ws('/', source, lang) AS doc_hash, text AS t, row_number() OVER (PARTITION BY concat_ws('/', source, lang) ORDER BY doc_id) AS page
          FROM documents WHERE text IS NOT NULL))""",
}


def with_views(sql: str) -> str:
    """sql with the views it names (and those these name) defined before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in SQL.items():
            if name in text.replace(",", " ").replace("(", " ").replace(")", " ").split() and name not in needed:
                need(body)
                needed.append(name)

    need(sql)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in needed)
    if not head:
        return sql
    body = sql.strip()
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
