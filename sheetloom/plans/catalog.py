"""Queries over the test tables, one per operator, with reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.functions import lexicons as lx
from sheetloom.functions import text as tx
from sheetloom.operators import figures as fg
from sheetloom.operators import furniture as fu
from sheetloom.operators import index as ix
from sheetloom.operators import inventory as inv
from sheetloom.operators import lookup as lk
from sheetloom.operators import pages as pg
from sheetloom.operators import ranges as rg
from sheetloom.operators import tables as tb
from sheetloom.operators import verify as vf
from sheetloom.operators.registrations import plain_hash, plain_path
from sheetloom.plans import views as v
from sheetloom.runtime import numbered, read_table, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL classes and pieces: Unicode white space, and what to strip.
_S = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_S}+', ''), '{_S}+$', '')"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '{_S}+', ' ', 'g'))"


def _squash(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def _contains(h: str, n: str) -> str:
    return f"(contains({h}, {n}) OR contains({_squash(h)}, {_squash(n)}))"


def _in(*values: str) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", v.with_views(sql))
        return f

    return add


# --- scalar functions ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, (coalesce(length(text), 0) + 3) // 4 AS tokens FROM documents")
def token_counts(spark, d):
    return read_table(spark, d, "documents").select("doc_id", tx.count_tokens(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, CASE WHEN (length(text) + 3) // 4 <= 12 THEN text
    WHEN contains(substr(text, 1, 46), ' ') THEN regexp_extract(substr(text, 1, 46), '(?s)^(.*) [^ ]*$', 1) || ' …' ELSE substr(text, 1, 46) || ' …' END AS short
    FROM documents WHERE text IS NOT NULL""")
def truncate_budget(spark, d):
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", tx.truncate_to_tokens(F.col("text"), 12).alias("short"))


@query(f"SELECT doc_id, {_squash('text')} AS squashed FROM documents")
def squash_key(spark, d):
    return read_table(spark, d, "documents").select("doc_id", tx.squash(F.col("text")).alias("squashed"))


@query("SELECT section_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM sections")
def normalize_title(spark, d):
    return read_table(spark, d, "sections").select("section_id", tx.norm_title(F.col("title")).alias("title_key"))


@query(f"SELECT table_id, {_collapse('translate(conditions, chr(8211) || chr(8722) || chr(8212), repeat(chr(45), 3))')} AS conditions FROM table_blocks")
def normalize_conditions(spark, d):
    return read_table(spark, d, "table_blocks").select("table_id", tx.normalize_text(F.col("conditions")).alias("conditions"))


_SLUG = r"regexp_replace(substr(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '')"


@query("SELECT section_id, " + _SLUG.format("CASE WHEN number <> '' THEN replace(number, '.', '-') || '-' || title ELSE title END") + " AS stem FROM sections")
def slug_stems(spark, d):
    return read_table(spark, d, "sections").select("section_id", tx.section_stem(F.col("number"), F.col("title")).alias("stem"))


@query("SELECT doc_hash, sec_pos, number, title, level FROM headings")
def split_numbers(spark, d):
    return v.headings(spark, d).select("doc_hash", "sec_pos", "number", "title", "level")


@query(rf"""WITH p AS (SELECT section_id, unnest(paragraphs) AS p, generate_subscripts(paragraphs, 1) AS i FROM sections),
w AS (SELECT section_id, i, list_filter(regexp_split_to_array(regexp_extract({_strip("regexp_replace(" + _strip('p') + ", '^[• ]+', '')")}, '(?s)^(.*?[.!?]){_S}', 1), '{_S}+'), x -> x <> '') AS short,
  list_filter(regexp_split_to_array({_strip("regexp_replace(" + _strip('p') + ", '^[• ]+', '')")}, '{_S}+'), x -> x <> '') AS whole FROM p WHERE p IS NOT NULL),
s AS (SELECT section_id, i, CASE WHEN len(short) > 0 THEN short ELSE whole END AS words FROM w),
f AS (SELECT section_id, arg_min(words, i) AS words FROM s WHERE len(words) >= 4 GROUP BY section_id)
SELECT section_id, coalesce(array_to_string(f.words[1:28], ' '), '') AS sentence FROM sections LEFT JOIN f USING (section_id)""")
def first_sentence(spark, d):
    return read_table(spark, d, "sections").select("section_id", tx.first_sentence(F.col("paragraphs")).alias("sentence"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash_identity(spark, d):
    return read_table(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash"))


@query("SELECT source_id, CASE " + " ".join(rf"WHEN regexp_matches(lower(regexp_extract(path, '([^/\\]*)$', 1)), '{p}') THEN '{k}'" for k, p in lx.DOC_TYPE_PATTERNS) + " ELSE 'unknown' END AS kind FROM sources")
def doc_type_priority(spark, d):
    return read_table(spark, d, "sources").select("source_id", tx.detect_doc_type(F.col("path")).alias("kind"))


@query(r"""WITH p AS (SELECT doc_id, unnest([substr(text, 1, 40), substr(text, 41, 400), text, 'Rev. Z9']) AS t, unnest([1, 2, 3, 4]) AS i FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, i, regexp_extract_all(t, '\bRev[.\s]*([A-Z][A-Z0-9]?|\d{1,3})', 1) AS revs, regexp_extract(t, '\bS[A-Z]{2}[A-Z0-9]*\d[A-Z0-9]*\b') AS id FROM p WHERE i <= 3),
f AS (SELECT doc_id, i, CASE WHEN len(revs) > 0 THEN 'Rev. ' || revs[len(revs)] ELSE id END AS revision FROM r)
SELECT doc_id, coalesce(arg_min(revision, i) FILTER (WHERE revision <> ''), '') AS revision FROM f GROUP BY doc_id""")
def sniff_revision(spark, d):
    pages = F.array(F.substring("text", 1, 40), F.substring("text", 41, 400), F.col("text"), F.lit("Rev. Z9"))
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", tx.sniff_revision(pages).alias("revision"))


@query("""WITH s AS (SELECT source_id, CASE source_id % 4 WHEN 0 THEN '.GIF' WHEN 1 THEN '.png' WHEN 2 THEN '.exe' ELSE '' END AS e, path FROM sources),
u AS (SELECT source_id, e, path || e AS u FROM s)
SELECT source_id, substr(sha1(u), 1, 16) || '.html' AS cache_name, substr(sha1(u), 1, 16) || CASE WHEN e IN ('.GIF', '.png') THEN lower(e) ELSE '.bin' END AS binary_name FROM u""")
def cache_names(spark, d):
    n = F.col("source_id") % 4
    url = F.concat("path", F.when(n == 0, ".GIF").when(n == 1, ".png").when(n == 2, ".exe").otherwise(""))
    return read_table(spark, d, "sources").select("source_id", tx.cache_name(url).alias("cache_name"), tx.binary_cache_name(url).alias("binary_name"))


@query("""SELECT section_id, CASE WHEN page_start IS NULL THEN '?' WHEN page_end IS NOT NULL AND page_end <> 0 AND page_end <> page_start
    THEN page_start || '-' || page_end ELSE CAST(page_start AS VARCHAR) END AS label FROM sections""")
def pages_labels(spark, d):
    return read_table(spark, d, "sections").select("section_id", tx.pages_label(F.col("page_start"), F.col("page_end")).alias("label"))


@query(rf"""WITH f AS (SELECT table_id, unnest(footnotes) AS f, generate_subscripts(footnotes, 1) - 1 AS pos FROM table_blocks),
n AS (SELECT table_id, pos, f.marker || ' ' || f.text AS note FROM f)
SELECT table_id, pos, regexp_extract(note, '(?s)^\s*(\(\d+\)|[†‡*§#]+|\d+\))\s*(.*)$', 1) AS marker, {_collapse("regexp_extract(note, '(?s)^" + chr(92) + "s*(" + chr(92) + "(" + chr(92) + "d+" + chr(92) + ")|[†‡*§#]+|" + chr(92) + "d+" + chr(92) + "))" + chr(92) + "s*(.*)$', 2)")} AS text FROM n""")
def parse_tablenotes(spark, d):
    rows = read_table(spark, d, "table_blocks").select("table_id", F.posexplode("footnotes").alias("pos", "f"))
    note = tx.parse_tablenote(F.concat("f.marker", F.lit(" "), "f.text"))
    return rows.select("table_id", "pos", note["marker"].alias("marker"), note["text"].alias("text"))


@query("""WITH g AS (SELECT table_id, unnest(grid) AS r, generate_subscripts(grid, 1) - 1 AS i FROM table_blocks),
u AS (SELECT table_id, i, trim(r[len(r)]) AS key FROM g),
c AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in lx.CANONICAL_UNITS.items()) + """) t(key, canonical))
SELECT table_id, i AS "row", u.key AS verbatim, coalesce(c.canonical, u.key) AS canonical, c.key IS NOT NULL AS known FROM u LEFT JOIN c ON u.key = c.key""")
def unit_canonical(spark, d):
    rows = read_table(spark, d, "table_blocks").select("table_id", F.posexplode("grid").alias("row", "r"))
    unit = tx.canonical_unit(F.trim(F.element_at("r", -1)))
    return rows.select("table_id", "row", unit["verbatim"].alias("verbatim"), unit["canonical"].alias("canonical"), unit["known"].alias("known"))


_KEYWORDS = "[" + ", ".join(f"'{k}'" for k in lx.MEASURE_KEYWORDS) + "]"


@query(f"SELECT doc_id, array_to_string(list_filter({_KEYWORDS}, k -> contains(lower(text), k)), ',') AS tags FROM documents WHERE text IS NOT NULL")
def caption_tags(spark, d):
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(tx.caption_tags(F.col("text")), ",").alias("tags"))


@query(r"""WITH b AS (SELECT source_id, path, regexp_replace(path, '\.[^.]+$', '') AS base FROM sources)
SELECT source_id, array_to_string(list_concat([path], list_filter([base || '-high.gif', base || '.gif', base || '.png', base || '.jpg', base], x -> x <> path)), ' ') AS variants FROM b""")
def image_variants(spark, d):
    return read_table(spark, d, "sources").select("source_id", F.array_join(tx.image_variants(F.col("path")), " ").alias("variants"))


@query(f"""SELECT source_id, doc_type || '-' || substr({r"regexp_replace(regexp_replace(lower(content_hash), '\s+', '', 'g'), '^[a-z0-9-]+:', '')"}, 1, 8) AS folder FROM sources""")
def document_folders(spark, d):
    return read_table(spark, d, "sources").select("source_id", tx.doc_dir_name(F.col("doc_type"), plain_hash(F.col("content_hash"))).alias("folder"))


_PATH_TAGS = "[" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{t}' END" for t, p in lx.SECTION_TAGS) + "]"


@query(rf"""WITH t AS (SELECT doc_id, text, lower(text) AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, unnest(regexp_extract_all(t, '{lx.FREQUENCY}', 1)) AS n, unnest(regexp_extract_all(t, '{lx.FREQUENCY}', 2)) AS u FROM t),
m AS (SELECT doc_id, list(DISTINCT CASE WHEN f = floor(f) THEN CAST(CAST(f AS BIGINT) AS VARCHAR) ELSE CAST(f AS VARCHAR) END || 'mhz') AS ms FROM (SELECT doc_id, CAST(n AS DOUBLE) * CASE u WHEN 'ghz' THEN 1000.0 ELSE 1.0 END AS f FROM n) GROUP BY doc_id)
SELECT t.doc_id, array_to_string(list_sort(list_concat(list_filter({_PATH_TAGS}, x -> x IS NOT NULL), coalesce(ms, []))), ',') AS tags FROM t LEFT JOIN m USING (doc_id)""")
def section_tags(spark, d):
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.array_sort(tx.section_tags(F.col("text"))), ",").alias("tags"))


@query("SELECT table_id, " + " OR ".join(f"contains(lower(conditions), '{h}')" for h in lx.CONDITION_HINTS) + " AS is_conditions FROM table_blocks")
def condition_hints(spark, d):
    return read_table(spark, d, "table_blocks").select("table_id", tx.looks_like_conditions(F.col("conditions")).alias("is_conditions"))


@query(rf"""SELECT doc_hash, page, line_no, regexp_matches(text, '{lx.N_OF_M}') OR regexp_matches(text, '{lx.PAGE_OF}') OR regexp_matches(text, '{lx.BARE_REVISION}') OR (regexp_matches(text, '^\d+$') AND ltrim(text, '0') = CAST(page AS VARCHAR) AND (x < 80 OR y > 700)) AS machinery FROM document_lines""")
def page_machinery(spark, d):
    machinery = tx.is_placed_furniture(F.col("text"), F.col("page"), F.col("x"), F.col("y"))
    return v.document_lines(spark, d).select("doc_hash", "page", "line_no", machinery.alias("machinery"))


@query(rf"""WITH p AS (SELECT part_number, doc_hash, sec_pos, lower(trim(title)) AS t, unnest(paragraphs) AS p, generate_subscripts(paragraphs, 1) - 1 AS pos FROM unique_sections WHERE title IS NOT NULL),
b AS (SELECT part_number, arg_min(p, {{'a': doc_hash, 'b': sec_pos, 'c': pos}}) AS brief FROM p WHERE p IS NOT NULL AND t IN ('description', 'general description') AND len(list_filter(regexp_split_to_array(p, '{_S}+'), w -> w <> '')) >= 8 GROUP BY part_number)
SELECT DISTINCT s.part_number, coalesce(b.brief, '') AS brief FROM unique_sections s LEFT JOIN b USING (part_number)""")
def part_briefs(spark, d):
    s = v.unique_sections(spark, d, "part_number", "title", "paragraphs")
    return ix.brief_and_facts(s, ["part_number"]).select("part_number", "brief")


@query("""WITH d AS (SELECT coalesce(source, '') AS doc_hash, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS page, coalesce(text, '') AS text FROM documents)
SELECT doc_hash, CAST(page - 1 AS INTEGER) AS sec_pos, 'Page ' || page AS title, page AS page_start FROM d""")
def plain_sections(spark, d):
    """Page texts without contents: one section per page."""
    from sheetloom.operators.plain import plain_sections as plain

    pages = read_table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("doc_hash"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pages = numbered(pages, "doc_hash", "doc_id", "page")
    toc = spark.createDataFrame([], "doc_hash string, pos int, number string, title string, level int, page int")
    return plain(pages.select("doc_hash", "page", "text"), toc).select("doc_hash", "sec_pos", "title", "page_start")


@query(rf"""WITH o AS (SELECT * FROM outline WHERE page IS NOT NULL AND doc_hash IN (SELECT doc_hash FROM page_texts)),
e AS (SELECT doc_hash, max(page) AS last_page FROM page_texts GROUP BY ALL),
r AS (SELECT o.doc_hash, o.pos, o.title, o.page AS a, arg_min(n.page, n.pos) AS up FROM o LEFT JOIN o AS n ON n.doc_hash = o.doc_hash AND n.pos > o.pos AND n.level <= o.level GROUP BY ALL),
g AS (SELECT r.doc_hash, pos, title, a, greatest(a, coalesce(up - 1, last_page)) AS b FROM r JOIN e USING (doc_hash)),
l0 AS (SELECT doc_hash, page, unnest(regexp_split_to_array(text, '\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')) AS t0 FROM page_texts),
l AS (SELECT doc_hash, page, {_strip('t0')} AS t FROM l0),
k AS (SELECT doc_hash, page, count(*) AS n, sum(length(t)) AS chars FROM l WHERE t <> '' AND t <> CAST(page AS VARCHAR) GROUP BY ALL)
SELECT g.doc_hash, pos AS sec_pos, title, a AS page_start, b AS page_end, coalesce(sum(n), 0) AS n_paragraphs, coalesce(sum(chars), 0) AS chars
FROM g LEFT JOIN k ON k.doc_hash = g.doc_hash AND k.page BETWEEN a AND b GROUP BY ALL""")
def plain_outline_sections(spark, d):
    """Page texts under their contents: the lines of all pages of a range."""
    from sheetloom.operators.plain import plain_sections as plain

    # both are read several times
    s = plain(staged(v.page_texts(spark, d), "page-texts"), staged(v.outline(spark, d), "outline"))
    chars = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda n, p: n + F.length(p))
    return s.select("doc_hash", "sec_pos", "title", "page_start", "page_end", F.size("paragraphs").alias("n_paragraphs"), chars.alias("chars"))


# --- furniture -----------------------------------------------------------------------------------------------------------------

_BOILER = " OR ".join(rf"regexp_matches({_strip('line')}, '{p}')" for p in lx.BOILERPLATE_PATTERNS)


@query(rf"""WITH p AS (SELECT section_id, unnest(paragraphs) AS para, generate_subscripts(paragraphs, 1) AS i FROM sections),
l AS (SELECT section_id, i, unnest(regexp_split_to_array(para, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(para, '\r?\n'), 1) AS j FROM p WHERE para IS NOT NULL)
SELECT section_id, count(*) FILTER (WHERE {_BOILER}) AS removed, count(*) AS lines, coalesce(string_agg(line, chr(10) ORDER BY i, j) FILTER (WHERE NOT ({_BOILER})), '') AS kept FROM l GROUP BY section_id""")
def boilerplate_strip(spark, d):
    lines = F.filter(F.flatten(F.transform(F.filter("paragraphs", lambda p: p.isNotNull()), lambda p: F.split(p, r"\R"))), lambda x: x.isNotNull())
    out = read_table(spark, d, "sections").withColumn("ls", lines).where("size(ls) > 0").withColumn("kept", fu.kept_lines(F.col("ls")))
    return out.select("section_id", (F.size("ls") - F.size("kept")).alias("removed"), F.size("ls").alias("lines"), F.array_join("kept", "\n").alias("kept"))


@query(rf"""WITH l0 AS (SELECT doc_hash, page, line_no, unnest(regexp_split_to_array(text, '\r\n|[\x0b\x0c\r\x{{85}}\x{{2028}}\x{{2029}}]')) AS t0, generate_subscripts(regexp_split_to_array(text, '\r\n|[\x0b\x0c\r\x{{85}}\x{{2028}}\x{{2029}}]'), 1) AS i FROM document_lines),
l AS (SELECT doc_hash, page, line_no, i, {_strip('t0')} AS t FROM l0)
SELECT doc_hash, page, string_agg(t, chr(10) ORDER BY line_no, i) AS kept FROM l WHERE t <> '' AND t <> CAST(page AS VARCHAR) GROUP BY ALL""")
def page_number_furniture(spark, d):
    lines = v.document_lines(spark, d).select("doc_hash", "page", "line_no", fu.page_paragraphs(F.col("text"), F.col("page")).alias("ts"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "ts"))), lambda x: x["ts"]))  # a page's lines
    return lines.groupBy("doc_hash", "page").agg(whole.alias("ts")).where("size(ts) > 0").select("doc_hash", "page", F.array_join("ts", "\n").alias("kept"))


@query(r"""WITH l AS (SELECT *, CAST(floor(y / 15.0) AS BIGINT) AS band FROM document_lines),
n AS (SELECT doc_hash, greatest(2, ceil(count(DISTINCT page) * 0.4)) AS enough FROM l GROUP BY doc_hash),
o AS (SELECT unnest([-1, 0, 1]) AS o),
s AS (SELECT doc_hash, band + o AS band, count(DISTINCT page) AS sp FROM l, o GROUP BY ALL),
t AS (SELECT doc_hash, band + o AS band, text, count(DISTINCT page) AS tp FROM l, o GROUP BY ALL)
SELECT l.doc_hash, l.page, l.line_no FROM l JOIN n USING (doc_hash) JOIN s USING (doc_hash, band) JOIN t USING (doc_hash, band, text)
WHERE sp >= enough AND (tp >= enough
  OR regexp_matches(text, '(?i)^\s*(?:rev\.?\s+[a-z0-9][^|\n]*\s*[|·•]?\s*)?[-–—]?\s*\d+\s+of\s+\d+\s*[-–—]?\s*$')
  OR regexp_matches(text, '(?i)^\s*(?:rev\.?\s+[a-z0-9]\s*[|·•]\s*)?page\s+\d+(?:\s+of\s+\d+)?\s*$')
  OR regexp_matches(text, '(?i)^\s*rev\.?\s*[.|×: ]*\s*[a-z0-9]\s*$')
  OR (regexp_matches(text, '^\d+$') AND ltrim(text, '0') = CAST(page AS VARCHAR) AND (x < 80 OR y > 700)))""")
def furniture_slots(spark, d):
    return fu.furniture_lines(v.document_lines(spark, d)).where("furniture").select("doc_hash", "page", "line_no")


@query("SELECT doc_hash, page, block, string_agg(text, ' ' ORDER BY line_no) AS paragraph FROM document_lines GROUP BY ALL")
def paragraphs_by_block(spark, d):
    return fu.paragraphs_by_block(v.document_lines(spark, d))


# --- ranges and pages --------------------------------------------------------------------------------------------------------

_UP = """(SELECT arg_min(b.page, b.pos) FROM {0} b WHERE b.doc_hash = a.doc_hash AND b.pos > a.pos AND b.level <= a.level)"""


@query(f"""WITH k AS (SELECT * FROM outline WHERE number <> '' AND page IS NOT NULL)
SELECT doc_hash, pos, number, page AS page_start, coalesce(greatest(page, {_UP.format('k')} - 1), page) AS page_end FROM k a""")
def section_ranges_outline(spark, d):
    return rg.ranges_from_outline(v.outline(spark, d))


_TO_END = f"""k AS (SELECT * FROM outline WHERE page IS NOT NULL),
z AS (SELECT doc_hash, max(coalesce(page_end, page_start)) AS last_page FROM unique_sections GROUP BY doc_hash),
r AS (SELECT a.doc_hash, a.pos, a.level, a.page AS page_start, greatest(a.page, coalesce({_UP.format('k')} - 1, z.last_page)) AS page_end FROM k a LEFT JOIN z ON a.doc_hash = z.doc_hash)"""


def _doc_end(spark, d):
    last = v.unique_sections(spark, d, "page_start", "page_end").groupBy("doc_hash").agg(F.max(F.coalesce("page_end", "page_start")).alias("last_page"))
    return rg.ranges_to_document_end(v.outline(spark, d), last)


@query(f"WITH {_TO_END} SELECT doc_hash, pos, level, page_start, page_end FROM r")
def section_ranges_doc_end(spark, d):
    return _doc_end(spark, d)


@query(f"""WITH {_TO_END}, p AS (SELECT doc_hash, pos, level, unnest(range(page_start, page_end + 1)) AS page FROM r)
SELECT a.doc_hash, a.pos, a.page, EXISTS (SELECT 1 FROM p b WHERE b.doc_hash = a.doc_hash AND b.page = a.page AND b.level > a.level) AS owned FROM p a""")
def owned_by_deeper(spark, d):
    return rg.owned_by_deeper(_doc_end(spark, d))


@query("""SELECT DISTINCT q.question_id, s.file FROM (SELECT question_id, doc_hash, unnest(pages) AS page FROM questions) q
JOIN placed_plans s ON s.doc_hash = q.doc_hash AND q.page BETWEEN s.page_start AND greatest(s.page_start, coalesce(nullif(s.page_end, 0), s.page_start))""")
def covering_sections(spark, d):
    return rg.covering_sections(v.questions(spark, d), v.placed_plans(spark, d))


_MATCH = f"""k AS (SELECT * FROM outline WHERE number <> '' AND page IS NOT NULL),
r0 AS (SELECT doc_hash, pos, number, page AS page_start, coalesce(greatest(page, {_UP.format('k')} - 1), page) AS page_end FROM k a),
r AS (SELECT * FROM r0 QUALIFY row_number() OVER (PARTITION BY doc_hash, number ORDER BY pos DESC) = 1),
t0 AS (SELECT doc_hash, pos, number, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS key FROM outline WHERE number <> ''),
t AS (SELECT * FROM t0 QUALIFY row_number() OVER (PARTITION BY doc_hash, key ORDER BY pos DESC) = 1),
m AS (SELECT h.doc_hash, h.sec_pos, CASE WHEN h.number <> '' AND a.page_start IS NOT NULL THEN 'exact' WHEN b.page_start IS NOT NULL THEN 'title' END AS method,
  CASE WHEN h.number <> '' AND a.page_start IS NOT NULL THEN a.page_start ELSE b.page_start END AS page_start,
  CASE WHEN h.number <> '' AND a.page_start IS NOT NULL THEN a.page_end ELSE b.page_end END AS page_end
  FROM headings h LEFT JOIN r a ON a.doc_hash = h.doc_hash AND a.number = h.number
  LEFT JOIN t ON t.doc_hash = h.doc_hash AND t.key = trim(regexp_replace(lower(h.title), '[^a-z0-9]+', ' ', 'g'))
  LEFT JOIN r b ON b.doc_hash = t.doc_hash AND b.number = t.number)"""


@query(f"WITH {_MATCH} SELECT doc_hash, sec_pos, method, page_start, page_end FROM m")
def assign_by_number_or_title(spark, d):
    return pg.match_sections(v.headings(spark, d), v.outline(spark, d)).select("doc_hash", "sec_pos", "method", "page_start", "page_end")


@query(f"""WITH {_MATCH}, l AS (SELECT h.doc_hash, h.sec_pos, h.number, h.title, h.level, m.method, m.page_start, m.page_end FROM headings h JOIN m ON m.doc_hash = h.doc_hash AND m.sec_pos = h.sec_pos),
b AS (SELECT a.doc_hash, a.sec_pos, max(x.sec_pos) AS at FROM l a JOIN l x ON x.doc_hash = a.doc_hash AND x.sec_pos < a.sec_pos AND x.page_start IS NOT NULL WHERE a.page_start IS NULL GROUP BY ALL),
th AS (SELECT b.doc_hash, b.sec_pos, max(x.level) AS reached, arg_min(x.page_start, x.sec_pos) AS p0, arg_min(x.page_end, x.sec_pos) AS p1 FROM b JOIN l x ON x.doc_hash = b.doc_hash AND x.sec_pos >= b.at AND x.sec_pos < b.sec_pos GROUP BY ALL)
SELECT l.doc_hash, l.sec_pos, CASE WHEN l.page_start IS NOT NULL THEN method WHEN l.level > reached THEN 'inherited' ELSE 'unmatched' END AS method,
  CASE WHEN l.page_start IS NOT NULL THEN l.page_start WHEN l.level > reached THEN p0 END AS page_start, CASE WHEN l.page_start IS NOT NULL THEN l.page_end WHEN l.level > reached THEN p1 END AS page_end
FROM l LEFT JOIN th ON th.doc_hash = l.doc_hash AND th.sec_pos = l.sec_pos""")
def inherited_pages(spark, d):
    """The cascade without similar titles."""
    return pg.inherit_pages(pg.match_sections(v.headings(spark, d), v.outline(spark, d))).select("doc_hash", "sec_pos", "method", "page_start", "page_end")


@query(ORACLES["inherited_pages"].replace("\nFROM l LEFT JOIN th", ", l.level AS level\nFROM l LEFT JOIN th").join(["WITH o AS (", """) SELECT doc_hash, count(*) FILTER (WHERE method = 'exact') AS n_exact, count(*) FILTER (WHERE method = 'title') AS n_fuzzy, count(*) FILTER (WHERE method = 'inherited') AS n_inherited,
  count(*) FILTER (WHERE method = 'unmatched') AS n_unmatched, (count(*) - count(*) FILTER (WHERE method = 'unmatched')) / count(*) AS coverage FROM o GROUP BY doc_hash"""]))
def inherited_report(spark, d):
    return pg.assignment_report(pg.inherit_pages(pg.match_sections(v.headings(spark, d), v.outline(spark, d))))


@query()
def assign_pages(spark, d):
    return pg.assign_pages(v.headings(spark, d), v.outline(spark, d))


@query()
def assignment_report(spark, d):
    return pg.assignment_report(pg.assign_pages(v.headings(spark, d), v.outline(spark, d)))


def _unique_ranges(spark, d):
    s = v.unique_sections(spark, d, "number", "page_start", "page_end").where("number <> '' and page_start is not null")
    return s.groupBy("doc_hash", F.col("number").alias("section")).agg(F.min_by(F.struct("page_start", "page_end"), "sec_pos").alias("r")).select("doc_hash", "section", "r.page_start", "r.page_end")


@query(rf"""WITH c0 AS (SELECT table_id, unnest(grid[1:3]) AS r, generate_subscripts(grid[1:3], 1) AS i FROM table_blocks),
c1 AS (SELECT table_id, i, list_filter(list_transform(r, x -> {_strip("coalesce(x, '')")}), c -> (regexp_matches(c, '\d') AND length(c) >= 3 AND NOT regexp_matches(c, '^\d+$')) OR (NOT regexp_matches(c, '\d') AND regexp_matches(c, '^[A-Za-z][A-Za-z0-9_+/().-]{{2,}}$'))) AS ns FROM c0),
c2 AS (SELECT *, coalesce(sum(len(ns)) OVER (PARTITION BY table_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c1),
n AS (SELECT table_id, {_squash('x')} AS needle FROM (SELECT table_id, unnest(ns) AS x FROM c2 WHERE before < 6) WHERE length({_squash('x')}) >= 2),
r AS (SELECT doc_hash, number AS section, arg_min({{'a': page_start, 'b': page_end}}, sec_pos) AS r FROM unique_sections WHERE number <> '' AND page_start IS NOT NULL GROUP BY ALL),
p AS (SELECT t.table_id, x.page, {_squash('x.text')} AS sq FROM table_blocks t JOIN r ON t.doc_hash = r.doc_hash AND t.section = r.section
  JOIN page_texts x ON x.doc_hash = t.doc_hash AND x.page BETWEEN r.r.a AND greatest(r.r.a, coalesce(r.r.b, r.r.a))),
h AS (SELECT p.table_id, p.page, count(*) AS hits FROM p JOIN n ON n.table_id = p.table_id AND contains(p.sq, n.needle) GROUP BY ALL HAVING count(*) >= 2)
SELECT table_id, page, hits FROM h QUALIFY row_number() OVER (PARTITION BY table_id ORDER BY hits DESC, page) = 1""")
def pin_pages(spark, d):
    tables = read_table(spark, d, "table_blocks").select("table_id", "doc_hash", "section", "grid")
    return pg.pin_table_pages(tables, _unique_ranges(spark, d), v.page_texts(spark, d))


_DELTA = f"""WITH p AS (SELECT doc_hash, page, {_squash('text')} AS sq FROM page_texts), o AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, -1), (3, 2), (4, -2)) t(i, delta)),
h AS (SELECT t.doc_hash, o.i, o.delta, count(*) AS n FROM outline t, o JOIN p ON p.doc_hash = t.doc_hash AND p.page = t.page + o.delta
  WHERE {_squash('t.title')} <> '' AND contains(p.sq, {_squash('t.title')}) GROUP BY ALL)
SELECT doc_hash, delta FROM h QUALIFY row_number() OVER (PARTITION BY doc_hash ORDER BY n DESC, i) = 1"""


@query(_DELTA)
def printed_page_delta(spark, d):
    return pg.printed_page_delta(v.outline(spark, d).where("page is not null"), v.page_texts(spark, d))


@query(f"""SELECT DISTINCT doc_hash, {_squash('title')} AS title_key FROM outline EXCEPT SELECT DISTINCT doc_hash, {_squash('title')} FROM headings""")
def outline_against_headings(spark, d):
    keys = [x.select("doc_hash", tx.squash(F.col("title")).alias("title_key")) for x in (v.outline(spark, d), v.headings(spark, d))]
    return keys[0].subtract(keys[1])


# --- tables and lookups -----------------------------------------------------------------------------------------------------

_ROLE = "CASE " + " ".join(f"WHEN regexp_matches(trim(h), '(?i){p}') THEN '{r}'" for r, p in lx.ROLE_PATTERNS) + " ELSE 'other' END"
_ROLES = f"""h0 AS (SELECT table_id, unnest(headers) AS h, generate_subscripts(headers, 1) AS i FROM table_blocks),
h1 AS (SELECT *, {_ROLE} AS r FROM h0),
h2 AS (SELECT *, row_number() OVER (PARTITION BY table_id, r ORDER BY i) AS k FROM h1),
h3 AS (SELECT table_id, i, h, CASE WHEN r = 'parameter' THEN CASE k WHEN 1 THEN 'symbol' WHEN 2 THEN 'name' ELSE 'other' END ELSE r END AS r FROM h2),
f AS (SELECT table_id, min(i) FILTER (WHERE r IN {_in(*lx.NUMERIC_ROLES)}) AS fn FROM h3 GROUP BY table_id),
h4 AS (SELECT h3.*, (trim(h) = '' AND r = 'other' AND i < coalesce(fn, 0)) AS blank FROM h3 JOIN f USING (table_id)),
h5 AS (SELECT *, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY i) AS b FROM h4),
h6 AS (SELECT table_id, i, h, CASE WHEN blank AND b = 1 THEN 'symbol' WHEN blank AND b = 2 THEN 'name' WHEN blank AND b = 3 THEN 'conditions' ELSE r END AS r FROM h5),
g AS (SELECT table_id, min(i) FILTER (WHERE r = 'unit') AS u, bool_or(r IN {_in(*lx.VALUE_ROLES)}) AS hasv, min(i) FILTER (WHERE r = 'name') AS nm FROM h6 GROUP BY table_id),
h7 AS (SELECT h6.table_id, i, h, CASE WHEN u IS NOT NULL AND NOT hasv AND i = u - 1 AND r = 'other' AND trim(h) <> '' AND nm < i THEN 'value' ELSE r END AS r FROM h6 JOIN g USING (table_id)),
roles AS (SELECT table_id, list(r ORDER BY i) AS roles, coalesce(list(trim(h) ORDER BY i) FILTER (WHERE r = 'other' AND trim(h) <> ''), []) AS unmapped FROM h7 GROUP BY table_id)"""
_KIND = """CASE WHEN list_has_any(roles, ['symbol', 'name']) AND list_has_any(roles, ['min', 'typ', 'max', 'value']) AND list_contains(roles, 'unit') THEN 'parametric'
  WHEN list_has_any(roles, ['symbol', 'name']) AND NOT list_contains(roles, 'unit') AND NOT list_has_any(roles, ['min', 'typ', 'max']) THEN 'info' ELSE 'unmapped' END"""


@query(f"WITH {_ROLES} SELECT table_id, array_to_string(roles, ',') AS roles FROM roles")
def spec_roles(spark, d):
    return tb.spec_tables(read_table(spark, d, "table_blocks")).select("table_id", F.array_join("roles", ",").alias("roles"))


@query(f"""WITH {_ROLES} SELECT t.table_id, {_KIND} AS kind, array_to_string(unmapped, ',') AS unmapped,
  len(list_filter(grid, r -> len(list_filter(r, c -> {_strip('c')} <> '')) > 0)) AS n_records FROM table_blocks t JOIN roles USING (table_id)""")
def table_kinds(spark, d):
    t = tb.spec_tables(read_table(spark, d, "table_blocks"))
    return t.select("table_id", "kind", F.array_join("unmapped_headers", ",").alias("unmapped"), "n_records")


def _cell(role: str) -> str:
    return f"coalesce(list_filter(list_zip(r, roles), x -> x[2] = '{role}' AND {_strip('x[1]')} <> '')[1][1], '')"


def _norm(x: str) -> str:
    return _collapse(f"translate({x}, chr(8211) || chr(8722) || chr(8212), repeat(chr(45), 3))")


_SPECS = f"""{_ROLES}, g0 AS (SELECT table_id, unnest(grid) AS r, generate_subscripts(grid, 1) - 1 AS row_index FROM table_blocks),
specs AS (SELECT t.table_id, t.doc_hash, t.section, t.part_number, t.table_index, g0.row_index, {", ".join(_norm(_cell(c)) + " AS " + ('"' + c + '"') for c in ("symbol", "name", "conditions", "min", "typ", "max", "value"))},
  {_norm("coalesce(t.conditions, '')")} AS table_conditions, {_cell('unit')} AS unit, coalesce(t.row_pages[g0.row_index + 1], t.page) AS page
  FROM table_blocks t JOIN roles USING (table_id) JOIN g0 USING (table_id) WHERE len(list_filter(r, c -> {_strip('c')} <> '')) > 0)"""
_SPEC_COLUMNS = ["table_id", "row_index", "symbol", "name", "conditions", "min", "typ", "max", "value", "unit", "page"]


@query(f"WITH {_SPECS} SELECT " + ", ".join(f'"{c}"' for c in _SPEC_COLUMNS) + " FROM specs")
def spec_records(spark, d):
    return tb.spec_records(read_table(spark, d, "table_blocks")).select(*_SPEC_COLUMNS)


@query(f"WITH {_SPECS} SELECT table_id, row_index, name FROM specs WHERE contains(lower(symbol), 'v_') AND contains(lower(name), 'voltage') AND contains(lower(section), '1')")
def spec_lookup_and(spark, d):
    specs = lk.with_lowered(tb.spec_records(read_table(spark, d, "table_blocks")))
    return lk.find_specs(specs, symbol="V_", name="Voltage", section="1").select("table_id", "row_index", "name")


@query()
def spec_answers(spark, d):
    specs = tb.spec_records(read_table(spark, d, "table_blocks"))
    return lk.format_answers(lk.find_specs(specs, name="supply"), ["part_number"])


@query(f"""WITH {_SPECS}, v AS (SELECT table_id, row_index, CASE WHEN value <> '' THEN value ELSE array_to_string(list_filter(["min", typ, "max"], x -> x <> ''), '/') END AS shown FROM specs)
SELECT table_id, row_index, shown FROM v""")
def value_fields(spark, d):
    s = tb.spec_records(read_table(spark, d, "table_blocks"))
    return s.select("table_id", "row_index", tx.value_field(F.col("value"), F.col("min"), F.col("typ"), F.col("max")).alias("shown"))


@query(r"""WITH g AS (SELECT table_id, unnest(grid) AS r, generate_subscripts(grid, 1) - 1 AS row_index, list_transform(footnotes, f -> f.marker) AS ms FROM table_blocks),
t AS (SELECT table_id, row_index, array_to_string(r, ' ') AS txt, ms FROM g)
SELECT table_id, row_index, array_to_string(list_concat(list_filter(ms, m -> contains(txt, m)), list_filter(regexp_extract_all(txt, '\(\d+\)'), m -> NOT list_contains(list_filter(ms, k -> contains(txt, k)), m))), ',') AS markers FROM t""")
def cited_markers(spark, d):
    rows = read_table(spark, d, "table_blocks").select("table_id", "footnotes", F.posexplode("grid").alias("row_index", "r"))
    return rows.select("table_id", "row_index", F.array_join(tb.cited_markers(F.col("r"), F.col("footnotes")), ",").alias("markers"))


@query(r"""WITH a AS (SELECT table_id, list_distinct(regexp_extract_all(coalesce(caption, '') || ' (1) ' || array_to_string(flatten(grid), ' '), '\(\d+\)')) AS cited, list_transform(footnotes, f -> f.marker) AS noted FROM table_blocks)
SELECT table_id, array_to_string(list_sort(list_filter(cited, x -> NOT list_contains(noted, x))), ',') AS orphans, array_to_string(list_sort(list_filter(list_distinct(noted), x -> NOT list_contains(cited, x))), ',') AS uncited FROM a""")
def footnote_audit(spark, d):
    text = F.concat(F.coalesce("caption", F.lit("")), F.lit(" (1) "), F.array_join(F.flatten("grid"), " "))
    audit = tb.footnote_audit(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\(\d+\))"), 1)), F.col("footnotes"))
    return read_table(spark, d, "table_blocks").select("table_id", F.array_join(audit["orphans"], ",").alias("orphans"), F.array_join(audit["uncited"], ",").alias("uncited"))


@query("""WITH o AS (SELECT table_id, footnotes, list_concat(list_transform(footnotes, f -> {'marker': f.marker, 'text': 'again'}), [{'marker': '(9)', 'text': 'nine'}, {'marker': '(9)', 'text': 'ten'}]) AS more FROM table_blocks WHERE footnotes IS NOT NULL),
n AS (SELECT table_id, unnest(list_concat(footnotes, more)) AS f, generate_subscripts(list_concat(footnotes, more), 1) AS i FROM o),
k AS (SELECT table_id, i, f.marker || ' ' || f.text AS m FROM n QUALIFY row_number() OVER (PARTITION BY table_id, f.marker ORDER BY i) = 1)
SELECT table_id, string_agg(m, chr(10) ORDER BY i) AS notes FROM k GROUP BY table_id""")
def attach_footnotes(spark, d):
    note = lambda m, t: F.struct(m.alias("marker"), F.lit(t).alias("text"))
    more = F.concat(F.transform("footnotes", lambda f: note(f["marker"], "again")), F.array(note(F.lit("(9)"), "nine"), note(F.lit("(9)"), "ten")))
    both = tb.attach_footnotes(F.col("footnotes"), more)
    return read_table(spark, d, "table_blocks").where("footnotes is not null").select("table_id", F.array_join(F.transform(both, lambda f: F.concat(f["marker"], F.lit(" "), f["text"])), "\n").alias("notes"))


@query("""WITH h AS (SELECT table_id, unnest(headers) AS h, generate_subscripts(headers, 1) AS i FROM table_blocks), n AS (SELECT *, row_number() OVER (PARTITION BY table_id, h ORDER BY i) AS k FROM h)
SELECT table_id, string_agg(CASE WHEN k > 1 THEN h || '_' || k ELSE h END, '|' ORDER BY i) AS headers FROM n GROUP BY table_id""")
def header_disambiguate(spark, d):
    return read_table(spark, d, "table_blocks").select("table_id", F.array_join(tb.disambiguate(F.col("headers")), "|").alias("headers"))


_MD_CELL = _strip("replace(replace(coalesce(c, ''), '|', chr(92) || '|'), chr(10), ' ')")


@query(f"""SELECT table_id, array_to_string(list_concat(['| ' || array_to_string(list_transform(headers, c -> {_MD_CELL}), ' | ') || ' |', '|' || array_to_string(list_transform(headers, c -> ' --- '), '|') || '|'],
  list_transform(grid, r -> '| ' || array_to_string(list_transform(r, c -> {_MD_CELL}), ' | ') || ' |')), chr(10)) AS markdown FROM table_blocks""")
def grid_markdown(spark, d):
    return read_table(spark, d, "table_blocks").select("table_id", tb.grid_markdown(F.col("headers"), F.col("grid")).alias("markdown"))


_CSV_CELL = """CASE WHEN regexp_matches(c, '[",\\r\\n]') THEN '"' || replace(c, '"', '""') || '"' ELSE coalesce(c, '') END"""


@query(f"""WITH h0 AS (SELECT table_id, unnest(headers) AS h, generate_subscripts(headers, 1) AS i FROM table_blocks), h1 AS (SELECT *, row_number() OVER (PARTITION BY table_id, h ORDER BY i) AS k FROM h0),
hs AS (SELECT table_id, list(CASE WHEN k > 1 THEN h || '_' || k ELSE h END ORDER BY i) AS named FROM h1 GROUP BY table_id)
SELECT table_id, array_to_string(list_transform(list_concat(CASE WHEN len(named) > 0 THEN [named] ELSE [] END, grid), r -> CASE WHEN len(r) = 1 AND coalesce(r[1], '') = '' THEN '""' ELSE array_to_string(list_transform(r, c -> {_CSV_CELL}), ',') END || chr(10)), '') AS csv
FROM table_blocks LEFT JOIN hs USING (table_id)""")
def grid_csv(spark, d):
    headers = F.coalesce("headers", F.array().cast("array<string>"))
    return read_table(spark, d, "table_blocks").select("table_id", tb.grid_csv(headers, F.col("grid")).alias("csv"))


@query("""WITH g AS (SELECT doc_hash, section, table_index, table_id, unnest(grid) AS r, generate_subscripts(grid, 1) - 1 AS i FROM table_blocks),
f AS (SELECT doc_hash, section, r[1] AS symbol, min({'a': table_index, 'b': table_id, 'c': i}) AS place FROM g WHERE length(r[1]) BETWEEN 2 AND 14 GROUP BY ALL),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_hash, section ORDER BY place, symbol) <= 8)
SELECT doc_hash, section, string_agg(symbol, ',' ORDER BY place, symbol) AS symbols FROM k GROUP BY ALL""")
def key_symbols(spark, d):
    return tb.key_symbols(read_table(spark, d, "table_blocks")).select("doc_hash", "section", F.array_join("symbols", ",").alias("symbols"))


# --- figures -----------------------------------------------------------------------------------------------------------------

_FIGURES = r"""l0 AS (SELECT doc_hash, sec_pos, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS i FROM unique_plans WHERE markdown IS NOT NULL),
l1 AS (SELECT * FROM l0 WHERE regexp_matches(line, '^- \*\*Figure .*?\*\*')),
figs AS (SELECT l1.doc_hash, l1.sec_pos, h.number, h.title, row_number() OVER (PARTITION BY l1.doc_hash, l1.sec_pos ORDER BY i) AS k,
  regexp_extract(line, '^- \*\*(Figure .*?)\*\*', 1) AS caption, regexp_extract(line, '\*\* — (.*?)(?: \(p\.\d+\))?$', 1) AS conditions, TRY_CAST(regexp_extract(line, '\(p\.(\d+)\)$', 1) AS INTEGER) AS page
  FROM l1 JOIN headings h ON h.doc_hash = l1.doc_hash AND h.sec_pos = l1.sec_pos)"""


@query(f"""WITH {_FIGURES} SELECT doc_hash, printf('%s-f%03d', CASE WHEN number <> '' THEN number ELSE {_SLUG.format('title')} END, k) AS id, number AS section, caption,
  regexp_extract(caption, '(?i)Figure\\s+(\\d+(?:[-.]\\d+)?[a-z]?)', 1) AS figure_number, conditions, page AS page_start FROM figs""")
def plot_ids(spark, d):
    return fg.plot_records(v.figures(spark, d)).select("doc_hash", "id", "section", "caption", "figure_number", "conditions", "page_start")


@query(f"WITH {_FIGURES} SELECT doc_hash, caption, conditions FROM figs WHERE contains(lower(caption || ' ' || conditions), 'versus') AND contains(lower(caption), 'figure 2') AND contains(lower(conditions), 'm') AND number = '2'")
def plot_lookup(spark, d):
    return fg.find_plots(fg.plot_records(v.figures(spark, d)), q="Versus", caption="Figure 2", conditions="M", section="2").select("doc_hash", "caption", "conditions")


@query(f"WITH {_FIGURES} SELECT doc_hash, caption, conditions FROM figs WHERE list_contains(list_filter({_KEYWORDS}, k -> contains(lower(caption), k)), 'nf')")
def plot_lookup_tags(spark, d):
    return fg.find_plots(fg.plot_records(v.figures(spark, d)), tags=["NF"]).select("doc_hash", "caption", "conditions")


@query(f"""WITH {_FIGURES} SELECT doc_hash, caption || ' — §' || number || ' (' || CASE WHEN page IS NULL THEN '?' ELSE 'p.' || page END || ')' || CASE WHEN conditions <> '' THEN ' — ' || conditions ELSE '' END AS line FROM figs""")
def plot_answers(spark, d):
    return fg.plot_records(v.figures(spark, d)).select("doc_hash", fg.plot_answer_line().alias("line"))


# --- verification --------------------------------------------------------------------------------------------------------------

_VERIFY = f"""a AS (SELECT DISTINCT question_id, doc_hash, unnest(pages) AS page FROM questions WHERE NOT is_plot),
fl AS (SELECT DISTINCT a.question_id, s.doc_hash, s.file, s.text FROM a JOIN placed_plans s ON s.doc_hash = a.doc_hash
  AND a.page BETWEEN s.page_start AND greatest(s.page_start, coalesce(nullif(s.page_end, 0), s.page_start))),
co AS (SELECT question_id, string_agg(text, chr(10) ORDER BY file) AS corpus, string_agg(file, ',' ORDER BY file) AS files, min(file) AS first_file FROM fl GROUP BY question_id),
ci AS (SELECT a.question_id, string_agg(p.text, chr(10) ORDER BY a.page) AS cited FROM a JOIN page_texts p ON p.doc_hash = a.doc_hash AND p.page = a.page GROUP BY a.question_id),
su AS (SELECT question_id, unnest(expected_substrings) AS s FROM questions),
ok AS (SELECT su.question_id, bool_and({_contains("coalesce(corpus, '')", 's')}) AS c, bool_and({_contains("coalesce(cited, '')", 's')}) AS p FROM su LEFT JOIN co ON co.question_id = su.question_id LEFT JOIN ci ON ci.question_id = su.question_id GROUP BY su.question_id),
res AS (SELECT q.question_id, q.doc_hash, q.is_plot OR (co.corpus IS NOT NULL AND coalesce(ok.c, true)) AS corpus_contains, q.is_plot OR (coalesce(ci.cited, '') <> '' AND coalesce(ok.p, true)) AS page_truth, coalesce(co.files, '') AS matched_files, co.first_file
  FROM questions q LEFT JOIN co ON co.question_id = q.question_id LEFT JOIN ci ON ci.question_id = q.question_id LEFT JOIN ok ON ok.question_id = q.question_id)"""


def _verified(spark, d):
    return vf.verify_questions(v.questions(spark, d), v.placed_plans(spark, d), v.page_texts(spark, d))


@query(f"WITH {_VERIFY} SELECT question_id, corpus_contains, page_truth, corpus_contains AND page_truth AS passed, matched_files FROM res")
def verify_questions(spark, d):
    return _verified(spark, d).select("question_id", "corpus_contains", "page_truth", "passed", F.array_join("matched_files", ",").alias("matched_files"))


@query(f"""WITH {_VERIFY} SELECT count(*) AS total, count(*) FILTER (WHERE corpus_contains AND page_truth) AS passed, count(*) FILTER (WHERE NOT (corpus_contains AND page_truth)) AS failed,
  count(*) FILTER (WHERE corpus_contains AND page_truth) / count(*) AS accuracy, count(*) FILTER (WHERE matched_files = '') AS without_section FROM res""")
def verify_summary(spark, d):
    return vf.summarize(_verified(spark, d))


@query(f"""WITH {_VERIFY}, t AS (SELECT doc_hash, file, (length(text) + 3) // 4 AS tokens FROM placed_plans), c AS (SELECT 2500 + coalesce(t.tokens, 0) AS cost FROM res LEFT JOIN t ON t.doc_hash = res.doc_hash AND t.file = res.first_file)
SELECT avg(cost) AS avg_per_question, max(cost) AS max_per_question, (SELECT CAST(sum(tokens) AS BIGINT) FROM t) AS full_dump_tokens FROM c""")
def lookup_economics(spark, d):
    return vf.lookup_economics(_verified(spark, d), v.placed_plans(spark, d), v.questions(spark, d), 2500)


@query(f"""WITH {_SPECS}, a AS (SELECT question_id, doc_hash, pages, unnest(CASE WHEN len(coalesce(expected_substrings, [])) = 0 THEN [NULL] ELSE expected_substrings END) AS sub,
  lower(coalesce(spec_query['symbol'], '')) AS qs, lower(coalesce(spec_query['name'], '')) AS qn, lower(coalesce(spec_query['section'], '')) AS qx FROM golden_questions WHERE spec_query IS NOT NULL),
r AS (SELECT doc_hash, page, lower(symbol) AS s, lower(name) AS n, lower(coalesce(section, '')) AS x, concat_ws(' ', symbol, name, conditions, table_conditions, "min", typ, "max", value, unit) AS t FROM specs),
m AS (SELECT a.question_id, a.sub, bool_or(r.doc_hash IS NOT NULL AND (a.sub IS NULL OR {_contains('r.t', 'a.sub')})) AS ok FROM a
  LEFT JOIN r ON r.doc_hash = a.doc_hash AND list_contains(a.pages, r.page) AND contains(r.s, a.qs) AND contains(r.n, a.qn) AND contains(r.x, a.qx) GROUP BY ALL)
SELECT question_id, bool_and(coalesce(ok, false)) AS passed FROM m GROUP BY question_id""")
def verify_specs(spark, d):
    return vf.verify_specs(v.questions(spark, d), tb.spec_records(read_table(spark, d, "table_blocks")))


@query(f"""WITH {_FIGURES}, a AS (SELECT question_id, doc_hash, pages, lower(coalesce(plot_query['caption_contains'], '')) AS qc, lower(coalesce(plot_query['conditions_contain'], '')) AS qd, coalesce(plot_query['section'], '') AS qx
  FROM golden_questions WHERE plot_query IS NOT NULL)
SELECT a.question_id, bool_or(f.doc_hash IS NOT NULL) AS found FROM a LEFT JOIN figs f ON f.doc_hash = a.doc_hash AND contains(lower(f.caption), a.qc) AND contains(lower(f.conditions), a.qd)
  AND (a.qx = '' OR a.qx = f.number) AND list_contains(a.pages, f.page) GROUP BY a.question_id""")
def verify_plots(spark, d):
    return vf.verify_plots(v.questions(spark, d), fg.plot_records(v.figures(spark, d)))


# --- inventory and builds --------------------------------------------------------------------------------------------------------

_HASH = r"regexp_replace(regexp_replace(lower(content_hash), '\s+', '', 'g'), '^[a-z0-9-]+:', '')"


@query(f"SELECT source_id, part_number FROM sources QUALIFY row_number() OVER (PARTITION BY {_HASH} ORDER BY registered_at, source_id) = 1")
def inventory_dedupe(spark, d):
    return inv.dedupe_first(read_table(spark, d, "sources"), plain_hash(F.col("content_hash")), ["registered_at", "source_id"]).select("source_id", "part_number")


@query(f"""WITH s AS (SELECT source_id, {_HASH} AS content_hash, registered_at < TIMESTAMP '2024-06-01' AS old FROM sources),
n AS (SELECT * FROM s WHERE NOT old AND content_hash NOT IN (SELECT content_hash FROM s WHERE old) QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY source_id) = 1)
SELECT source_id, content_hash FROM s WHERE old UNION ALL SELECT source_id, content_hash FROM n""")
def inventory_append(spark, d):
    s = read_table(spark, d, "sources").select("source_id", plain_hash(F.col("content_hash")).alias("content_hash"), "registered_at")
    old = s.where("registered_at < timestamp_ntz '2024-06-01'").drop("registered_at")
    return inv.append_inventory(old, s.where("registered_at >= timestamp_ntz '2024-06-01'").drop("registered_at"))


_VENDOR = "CASE " + " ".join(f"WHEN contains(t, '{m}') THEN '{n}'" for n, ms, _ in lx.VENDOR_PROFILES for m in ms) + " ELSE 'ti' END"


@query(f"WITH x AS (SELECT doc_id, lower(coalesce(text, '') || ' ' || coalesce(source, '')) AS t FROM documents) SELECT doc_id, {_VENDOR} AS vendor FROM x")
def vendor_detect(spark, d):
    return read_table(spark, d, "documents").select("doc_id", inv.vendor_of(F.col("text"), F.col("source"))["vendor"].alias("vendor"))


_CHAINS = " ".join(f"WHEN vendor = '{n}' THEN '{chain[0]}'" for n, _, chain in lx.VENDOR_PROFILES)


@query(f"SELECT source_id, CASE WHEN doc_type <> 'datasheet' THEN 'pdf_text' {_CHAINS} END AS backend FROM sources")
def backend_routed(spark, d):
    """The backend by the source's own vendor; null for one without profile."""
    return read_table(spark, d, "sources").select("source_id", inv.backend_of(F.col("vendor"), F.col("doc_type"), ["pdf_layout", "pdf_text", "ti_html"]).alias("backend"))


_SEEN = " ".join(f"WHEN contains(t, '{m}') THEN ['{n}', 'brand:\"{m}\" (p.1)'] WHEN contains(f, '{m}') THEN ['{n}', 'brand:\"{m}\" (filename)']" for n, ms, _ in lx.VENDOR_PROFILES for m in ms)


@query(rf"""WITH p AS (SELECT doc_hash, lower(string_agg(text, chr(10))) AS t FROM page_texts WHERE page = 1 GROUP BY doc_hash),
x AS (SELECT source_id, vendor, coalesce(p.t, '') AS t, lower(regexp_extract(path, '([^/\\]*)$', 1)) AS f FROM sources LEFT JOIN p ON p.doc_hash = {_HASH} WHERE doc_type = 'datasheet' AND NOT starts_with(coalesce(vendor_evidence, ''), 'cli-override')),
y AS (SELECT *, CASE {_SEEN} ELSE ['{lx.DEFAULT_VENDOR}', ''] END AS v FROM x)
SELECT source_id, vendor, v[1] AS detected, v[2] AS evidence FROM y WHERE vendor IS DISTINCT FROM v[1]""")
def vendor_drift(spark, d):
    first = v.page_texts(spark, d).where("page = 1").select(F.col("doc_hash").alias("content_hash"), "text")
    return inv.vendor_drift(read_table(spark, d, "sources"), first)


@query("""SELECT part_number, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped,
  count(*) FILTER (WHERE status = 'failed') = 0 AS ok FROM builds GROUP BY part_number""")
def batch_counts(spark, d):
    return inv.status_counts(read_table(spark, d, "builds"), ["part_number"])


@query("SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_stage(spark, d):
    return inv.latest_stage(read_table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("""SELECT part_number, coalesce(sum(tables_detected), 0) AS tables_detected, coalesce(sum(tables_accepted), 0) AS tables_accepted, coalesce(sum(tables_rejected), 0) AS tables_rejected,
  round(coalesce(avg(mean_fidelity), 0), 9) AS mean_fidelity, array_to_string(list_sort(list(DISTINCT backend)), ',') AS backends FROM builds GROUP BY part_number""")
def extraction_stats(spark, d):
    s = inv.extraction_stats(read_table(spark, d, "builds"), ["part_number"])
    return s.withColumns({"mean_fidelity": F.round("mean_fidelity", 9), "backends": F.array_join("backends", ",")})


_PATH = r"regexp_replace(regexp_replace(trim(path), '[\\/]+', '/', 'g'), '^(\./)+', '')"


@query(f"""WITH v AS (SELECT backend, any_value(pipeline_version) AS p, any_value(output_version) AS o FROM current_versions GROUP BY backend),
b AS (SELECT part_number, {_HASH} AS h, coalesce(pipeline_version = p AND extractor_version = o, false) AS fresh FROM builds LEFT JOIN v ON v.backend = builds.backend WHERE status = 'done'),
a AS (SELECT part_number, bool_and(fresh) AS f FROM b GROUP BY part_number), k AS (SELECT DISTINCT part_number, h FROM b)
SELECT s.source_id, coalesce(a.f AND k.h IS NOT NULL, false) AS skip, CASE WHEN a.f IS NULL THEN 'nothing published' WHEN NOT a.f THEN 'built by other versions' WHEN k.h IS NULL THEN 'new or changed file' END AS reason FROM (SELECT source_id, part_number, {_HASH} AS h FROM sources) s
LEFT JOIN a ON a.part_number = s.part_number LEFT JOIN k ON k.part_number = s.part_number AND k.h = s.h""")
def skip_gate(spark, d):
    plain = plain_hash(F.col("content_hash")).alias("content_hash")
    jobs = read_table(spark, d, "sources").select("source_id", "part_number", plain)
    published = read_table(spark, d, "builds").where("status = 'done'").select("part_number", plain, "pipeline_version", "extractor_version", "backend")
    return inv.skip_reason(jobs, published, read_table(spark, d, "current_versions"))


@query(f"""WITH v AS (SELECT backend, any_value(pipeline_version) AS p, any_value(output_version) AS o FROM current_versions GROUP BY backend),
b AS (SELECT part_number, {_HASH} AS h, {_PATH} AS file, coalesce(pipeline_version = p AND extractor_version = o, false) AS fresh FROM builds LEFT JOIN v ON v.backend = builds.backend WHERE status = 'done' AND coalesce(pipeline_version = p AND extractor_version = o, false)),
a AS (SELECT DISTINCT part_number FROM b), k AS (SELECT DISTINCT part_number, h, file FROM b)
SELECT s.source_id, k.h IS NOT NULL AS skip, CASE WHEN a.part_number IS NULL THEN 'nothing published' WHEN k.h IS NULL THEN 'new or changed file' END AS reason
FROM (SELECT source_id, part_number, {_HASH} AS h, {_PATH} AS file FROM sources) s LEFT JOIN a ON a.part_number = s.part_number LEFT JOIN k ON k.part_number = s.part_number AND k.h = s.h AND k.file = s.file""")
def skip_gate_by_path(spark, d):
    """The gate over what today's versions built, file by file."""
    plain = plain_hash(F.col("content_hash")).alias("content_hash")
    versions = read_table(spark, d, "current_versions")
    jobs = read_table(spark, d, "sources").select("source_id", "part_number", "path", plain)
    today = versions.select("backend", "pipeline_version", F.col("output_version").alias("extractor_version")).distinct()
    published = read_table(spark, d, "builds").where("status = 'done'").join(today, ["backend", "pipeline_version", "extractor_version"], "left_semi")
    return inv.skip_reason(jobs, published.select("part_number", "path", plain, "pipeline_version", "extractor_version", "backend"), versions)


@query(f"SELECT source_id, {_PATH} AS file, {_HASH} AS hash FROM sources")
def plain_identity(spark, d):
    return read_table(spark, d, "sources").select("source_id", plain_path(F.col("path")).alias("file"), plain_hash(F.col("content_hash")).alias("hash"))


@query(f"""WITH {_SPECS}, t AS (SELECT doc_hash, section, count(*) AS n, sum(coalesce(len(footnotes), 0)) AS notes FROM table_blocks GROUP BY ALL),
c AS (SELECT s.part_number, count(*) AS n_sections, CAST(sum((coalesce(length(p.markdown), 0) + 3) // 4) AS BIGINT) AS total_tokens, CAST(coalesce(sum(t.n), 0) AS BIGINT) AS n_tables, count(*) FILTER (WHERE s.page_start IS NOT NULL) AS sections_with_pages,
  count(*) FILTER (WHERE s.page_start IS NULL) AS sections_without_pages, count(DISTINCT s.doc_hash) AS n_documents, count(DISTINCT CASE WHEN s.page_start IS NULL THEN s.doc_hash END) AS failed_documents, CAST(coalesce(sum(t.notes), 0) AS BIGINT) AS n_footnotes, count(*) AS lines_removed
  FROM unique_sections s LEFT JOIN unique_plans p ON p.doc_hash = s.doc_hash AND p.sec_pos = s.sec_pos LEFT JOIN t ON t.doc_hash = s.doc_hash AND t.section = s.number GROUP BY s.part_number),
n AS (SELECT part_number, count(*) AS n_specs FROM specs GROUP BY part_number)
SELECT c.*, n.n_specs FROM c LEFT JOIN n USING (part_number)""")
def corpus_stats(spark, d):
    """The build's stats over the rendered sections; a section without page
    stands for a failed document."""
    from sheetloom.plans.build import corpus_stats as stats

    s = v.unique_sections(spark, d, "part_number", "number", "page_start")
    p = v.unique_plans(spark, d).select("doc_hash", "sec_pos", tx.count_tokens(F.col("markdown")).alias("token_count"))
    notes = F.sum(F.coalesce(F.size("footnotes"), F.lit(0))).alias("n_footnotes")
    n = read_table(spark, d, "table_blocks").groupBy("doc_hash", F.col("section").alias("number")).agg(F.count(F.lit(1)).alias("n_tables"), notes)
    files = s.join(p, ["doc_hash", "sec_pos"], "left").join(n, ["doc_hash", "number"], "left").withColumns({"n_tables": F.coalesce("n_tables", F.lit(0)), "token_count": F.coalesce("token_count", F.lit(0)), "n_figures": F.lit(0), "n_footnotes": F.coalesce("n_footnotes", F.lit(0)), "boilerplate_removed": F.lit(1)})
    extracted = s.select("part_number", "doc_hash", F.lit("x").alias("backend"), F.when(F.col("page_start").isNull(), "no page").alias("error"))
    out = stats({"section_files": files, "specs": tb.spec_records(read_table(spark, d, "table_blocks"))}, extracted)
    return out.select("part_number", "n_sections", "total_tokens", "n_tables", "sections_with_pages", "sections_without_pages", "n_documents", "failed_documents", "n_specs", "n_footnotes", "lines_removed")


@query("""SELECT s.part_number, s.doc_hash, s.sec_pos, s.number, s.title, s.page_start, s.page_end, p.file, (coalesce(length(p.markdown), 0) + 3) // 4 AS token_count, '2' AS pipeline_version
FROM unique_sections s JOIN unique_plans p ON p.doc_hash = s.doc_hash AND p.sec_pos = s.sec_pos WHERE s.part_number IS NOT NULL""")
def manifest_sections(spark, d):
    """The sections of every part's manifest, written as JSON and read back."""
    from sheetloom.plans.build import part_manifests
    from sheetloom.sources.readers import MANIFEST, manifest_sections as sections_of

    s = v.unique_sections(spark, d, "part_number", "number", "title", "page_start", "page_end").where("part_number is not null")
    p = v.unique_plans(spark, d).select("doc_hash", "sec_pos", "file", tx.count_tokens(F.col("markdown")).alias("token_count"))
    files = s.join(p, ["doc_hash", "sec_pos"]).withColumns({"n_tables": F.lit(0), "n_figures": F.lit(0), "boilerplate_removed": F.lit(0), "description": F.lit("")})
    documents = s.select("part_number", F.col("doc_hash").alias("content_hash"), F.lit("x").alias("backend"), F.lit("1").alias("extractor_version"), F.lit("done").alias("status")).distinct()
    stats = s.groupBy("part_number").agg(F.count(F.lit(1)).alias("n_sections"))
    texts = part_manifests(files, documents, stats)
    parsed = texts.select(F.from_json("text", MANIFEST).alias("m")).select("m.*")
    return sections_of(parsed).select("part_number", "doc_hash", "sec_pos", "number", "title", "page_start", "page_end", "file", "token_count", "pipeline_version")


# --- rendered sections and the index -----------------------------------------------------------------------------------------


def _described(spark, d):
    """Sections as the index sees them."""
    s = v.unique_sections(spark, d, "part_number", "number", "title", "page_start", "page_end", "paragraphs")
    p = v.unique_plans(spark, d).select("doc_hash", "sec_pos", "file", tx.count_tokens(F.col("markdown")).alias("token_count"))
    keys = tb.key_symbols(read_table(spark, d, "table_blocks")).select("doc_hash", F.col("section").alias("number"), "symbols")
    n = read_table(spark, d, "table_blocks").groupBy("doc_hash", F.col("section").alias("number")).agg(F.count(F.lit(1)).cast("int").alias("n_tables"))
    f = v.figures(spark, d).groupBy("doc_hash", "sec_pos").agg(F.count(F.lit(1)).cast("int").alias("n_figures"))
    out = s.join(p, ["doc_hash", "sec_pos"]).join(keys, ["doc_hash", "number"], "left").join(n, ["doc_hash", "number"], "left").join(f, ["doc_hash", "sec_pos"], "left")
    out = out.withColumns({"title": F.coalesce("title", F.lit("")), "n_tables": F.coalesce("n_tables", F.lit(0)), "n_figures": F.coalesce("n_figures", F.lit(0)), "symbols": F.coalesce("symbols", F.array().cast("array<string>"))})
    return out.withColumn("description", ix.describe(F.col("paragraphs"), F.col("symbols"), F.col("n_figures")))


_DESCRIBED = rf"""{_FIGURES}, pp AS (SELECT section_id, unnest(paragraphs) AS p, generate_subscripts(paragraphs, 1) AS i FROM unique_sections),
ww AS (SELECT section_id, i, list_filter(regexp_split_to_array(regexp_extract({_strip("regexp_replace(" + _strip('p') + ", '^[• ]+', '')")}, '(?s)^(.*?[.!?]){_S}', 1), '{_S}+'), x -> x <> '') AS short,
  list_filter(regexp_split_to_array({_strip("regexp_replace(" + _strip('p') + ", '^[• ]+', '')")}, '{_S}+'), x -> x <> '') AS whole FROM pp WHERE p IS NOT NULL),
ss AS (SELECT section_id, i, CASE WHEN len(short) > 0 THEN short ELSE whole END AS words FROM ww),
sentences AS (SELECT section_id, array_to_string(arg_min(words, i)[1:28], ' ') AS sentence FROM ss WHERE len(words) >= 4 GROUP BY section_id),
gg AS (SELECT doc_hash, section, table_index, table_id, unnest(grid) AS r, generate_subscripts(grid, 1) - 1 AS i FROM table_blocks),
places AS (SELECT doc_hash, section, r[1] AS symbol, min({{'a': table_index, 'b': table_id, 'c': i}}) AS place FROM gg WHERE length(r[1]) BETWEEN 2 AND 14 GROUP BY ALL),
firsts AS (SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY doc_hash, section ORDER BY place, symbol) <= 8),
syms AS (SELECT doc_hash, section, string_agg(symbol, ', ' ORDER BY place, symbol) AS symbols FROM firsts GROUP BY ALL),
nt AS (SELECT doc_hash, section, count(*) AS n_tables FROM table_blocks GROUP BY ALL), nf AS (SELECT doc_hash, sec_pos, count(*) AS n_figures FROM figs GROUP BY ALL),
described AS (SELECT u.doc_hash, u.sec_pos, u.part_number, u.number, coalesce(u.title, '') AS title, u.page_start, u.page_end, p.file, (coalesce(length(p.markdown), 0) + 3) // 4 AS token_count, coalesce(n_tables, 0) AS n_tables, coalesce(n_figures, 0) AS n_figures,
  coalesce(nullif(concat_ws(' ', nullif(sentence, ''), 'Parameters: ' || symbols || '.', CASE WHEN n_figures > 0 THEN n_figures || ' plots.' END), ''), '(no content)') AS description
  FROM unique_sections u JOIN unique_plans p ON p.doc_hash = u.doc_hash AND p.sec_pos = u.sec_pos LEFT JOIN sentences USING (section_id) LEFT JOIN syms ON syms.doc_hash = u.doc_hash AND syms.section = u.number
  LEFT JOIN nt ON nt.doc_hash = u.doc_hash AND nt.section = u.number LEFT JOIN nf ON nf.doc_hash = u.doc_hash AND nf.sec_pos = u.sec_pos)"""
_STEPS = ", ".join(f"({i}, {b}, {str(c).lower()}, {str(f).lower()})" for i, (b, c, f) in enumerate(lx.INDEX_LADDER))
_LINES = f"""{_DESCRIBED}, steps(step, desc_budget, with_conventions, with_facts) AS (VALUES {_STEPS}),
cut AS (SELECT d.*, s.*, CASE WHEN (length(description) + 3) // 4 <= desc_budget THEN description ELSE substr(description, 1, greatest(desc_budget * 4 - 2, 0)) END AS head, (length(description) + 3) // 4 > desc_budget AS is_cut FROM described d, steps s),
lines AS (SELECT *, '- **' || trim(number || ' ' || title) || '** — p.' || CASE WHEN page_start IS NULL THEN '?' WHEN page_end IS NOT NULL AND page_end <> 0 AND page_end <> page_start THEN page_start || '-' || page_end ELSE CAST(page_start AS VARCHAR) END
  || ' — `' || file || '` (' || token_count || ' tok' || CASE WHEN n_tables > 0 THEN ', ' || n_tables || ' tables' ELSE '' END || CASE WHEN n_figures > 0 THEN ', ' || n_figures || ' figs' ELSE '' END || ')'
  || CASE WHEN desc_budget = 0 OR description = '' THEN '' ELSE chr(10) || '  ' || CASE WHEN NOT is_cut THEN head WHEN contains(head, ' ') THEN regexp_extract(head, '(?s)^(.*) [^ ]*$', 1) || ' …' ELSE head || ' …' END END AS line FROM cut)"""


def _ladder(head: int, conventions: int, facts: int) -> str:
    return f"""{_LINES}, chars AS (SELECT part_number, step, desc_budget, with_conventions, with_facts, sum(length(line)) + count(*) - 1 AS chars FROM lines GROUP BY ALL),
sums AS (SELECT * EXCLUDE (chars), (chars + 3) // 4 + {head} + CASE WHEN with_conventions THEN {conventions} ELSE 0 END + CASE WHEN with_facts THEN {facts} ELSE 0 END AS tokens FROM chars),
ladder AS (SELECT *, tokens <= {lx.INDEX_TOKEN_BUDGET} AS fits FROM sums QUALIFY row_number() OVER (PARTITION BY part_number ORDER BY tokens <= {lx.INDEX_TOKEN_BUDGET} DESC, CASE WHEN tokens <= {lx.INDEX_TOKEN_BUDGET} THEN step ELSE -step END) = 1)"""


@query(f"WITH {_DESCRIBED} SELECT doc_hash, sec_pos, description FROM described")
def section_descriptions(spark, d):
    return _described(spark, d).select("doc_hash", "sec_pos", "description")


@query(f"WITH {_ladder(40, 110, 60)} SELECT part_number, step, desc_budget, with_conventions, with_facts, CAST(tokens AS BIGINT) AS tokens, fits FROM ladder")
def index_ladder(spark, d):
    return ix.index_ladder(_described(spark, d), ["part_number"], head_tokens=40, conventions_tokens=110, facts_tokens=60)


@query(f"WITH {_ladder(0, 0, 0)} SELECT l.part_number, l.number, l.file, l.line FROM lines l JOIN ladder c ON c.part_number = l.part_number AND c.step = l.step")
def index_lines(spark, d):
    rows = _described(spark, d)
    return ix.index_lines(rows, ix.index_ladder(rows, ["part_number"]), ["part_number"])


_HEAD = """CASE WHEN trim(number || ' ' || title) = '' THEN '# ' ELSE '# ' || trim(number || ' ' || title) END"""


@query(rf"""SELECT doc_hash, sec_pos, regexp_replace({_HEAD} || chr(10) || chr(10) || '<!-- source: ' || substr(doc_hash, 1, 8) ||
    CASE WHEN page_start IS NULL THEN '' WHEN page_end IS NOT NULL AND page_end <> 0 AND page_end <> page_start THEN ' p.' || page_start || '-' || page_end ELSE ' p.' || page_start END || ' -->' || chr(10) || chr(10) ||
    array_to_string(list_transform(list_filter(coalesce(paragraphs, []), p -> p IS NOT NULL), p -> p || chr(10) || chr(10)), ''), '{_S}+$', '') || chr(10) AS markdown
FROM (SELECT * REPLACE (coalesce(title, '') AS title) FROM unique_sections)""")
def section_markdown(spark, d):
    s = v.unique_sections(spark, d, "number", "title", "page_start", "page_end", "paragraphs")
    none = F.array().cast("array<struct<caption:string,conditions:string,headers:array<string>,grid:array<array<string>>,footnotes:array<struct<marker:string,text:string>>,csv_file:string>>")
    s = s.withColumns({
        "title": F.coalesce("title", F.lit("")), "paragraphs": F.filter(F.coalesce("paragraphs", F.array().cast("array<string>")), lambda p: p.isNotNull()),
        "tables": none, "figures": F.array().cast("array<struct<caption:string,conditions:string,page:int>>"),
    })
    return s.select("doc_hash", "sec_pos", ix.section_markdown(F.substring("doc_hash", 1, 8)).alias("markdown"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
