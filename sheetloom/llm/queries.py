"""Queries of the text problems, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.boilerplate import cleaned_sections, partitions_by_time, repeated_lines
from sheetloom.llm.bpe import decode_texts, encode_texts
from sheetloom.llm.lookalikes import corpus_mapping, only_to_the_eye, uniform
from sheetloom.llm.mixing import mix_report, mix_sources, token_lengths
from sheetloom.llm.repetition import repetition, repetitive
from sheetloom.llm.splitting import CHARS_PER_TOKEN, LIMIT, OVERLAP, oversized, split_pieces
from sheetloom.runtime import read_table, staged


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(partitions_by_time(read_table(spark, sf_dir, "sections")))


def p1_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned_sections(partitions_by_time(read_table(spark, sf_dir, "sections"))).select("section_id", "paragraphs", "boilerplate_removed")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(read_table(spark, sf_dir, "section_plans"), "plan_id", "markdown")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_pieces(read_table(spark, sf_dir, "section_plans"), "plan_id", "markdown")


def p2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true token_count of each plan, put together again from its pieces."""
    pieces = split_pieces(read_table(spark, sf_dir, "section_plans"), "plan_id", "markdown", with_text=False)
    chars = F.max("end").alias("chars")
    return pieces.groupBy("plan_id").agg(chars).select("plan_id", F.ceil(F.col("chars") / CHARS_PER_TOKEN).alias("token_count"))


def p2_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each plan with text: how many code points its pieces cover, whether
    all are within the limit, share the overlap and are what stands there."""
    plans = read_table(spark, sf_dir, "section_plans").select("plan_id", "markdown")
    pieces = split_pieces(plans, "plan_id", "markdown")
    before = F.array_sort(F.collect_list(F.struct("piece_pos", "start", "end", "token_count", F.length("text").alias("chars"), "text")))
    whole = pieces.groupBy("plan_id").agg(before.alias("ps")).join(plans, "plan_id")  # a group is one plan's pieces
    fits = F.forall("ps", lambda p: (p["token_count"] <= LIMIT) & (p["chars"] <= LIMIT * CHARS_PER_TOKEN) & (p["chars"] == p["end"] - p["start"]))
    step = F.transform(F.slice("ps", 2, 1 << 30), lambda p, i: F.get("ps", i)["end"] - p["start"])
    overlaps = F.forall(step, lambda n: n == OVERLAP * CHARS_PER_TOKEN)
    same = F.forall("ps", lambda p: F.substring(F.col("markdown"), p["start"] + 1, p["end"] - p["start"]) == p["text"])
    covered = F.element_at("ps", -1)["end"]
    return whole.select("plan_id", covered.alias("covered"), fits.alias("fits"), overlaps.alias("overlaps"), same.alias("same"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return only_to_the_eye(read_table(spark, sf_dir, "golden_questions"), read_table(spark, sf_dir, "sections"))


def p3_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected substrings and paragraphs in their one form."""
    subs = read_table(spark, sf_dir, "golden_questions").select(F.lit("golden_questions").alias("origin"), F.col("question_id").alias("id"), F.posexplode("expected_substrings").alias("pos", "text"))
    paras = read_table(spark, sf_dir, "sections").select(F.lit("sections").alias("origin"), F.col("section_id").alias("id"), F.posexplode("paragraphs").alias("pos", "text"))
    mapping = corpus_mapping(read_table(spark, sf_dir, "golden_questions"), read_table(spark, sf_dir, "sections"))
    return subs.unionByName(paras).select("origin", "id", "pos", uniform(F.col("text"), mapping).alias("uniform_text"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_texts(p6_ids(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = read_table(spark, sf_dir, "mix_targets")
    lengths = staged(token_lengths(read_table(spark, sf_dir, "documents"), targets), "lengths")
    return mix_sources(lengths, targets), targets, lengths


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, targets, lengths = _mixed(spark, sf_dir)
    return mix_report(staged(mixed, "mixed"), targets, lengths)


def p7_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each target: whether its documents are within the cap, and whether its
    share is that of the targets with documents, to a thousandth."""
    r = p7_report(spark, sf_dir)
    whole = r.where("tokens_held > 0").agg(F.sum("target_share").alias("whole"))  # one row
    goal = F.when(F.col("tokens_held") > 0, F.col("target_share") / F.col("whole")).otherwise(0.0)
    near = F.abs(F.col("actual_share") - goal) <= 0.001
    return r.crossJoin(F.broadcast(whole)).select("source", (F.col("tokens_held") > 0).alias("held"), (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"), near.alias("near"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetitive(read_table(spark, sf_dir, "documents"))


def p8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    named = (p1_found, p1_cleaned, p2_found, p2_pieces, p2_invariants, p2_token_counts, p3_found, p3_uniform, p6_ids, p6_decoded, p7_mix, p7_report, p7_caps, p8_found, p8_repetition)
    return {f.__name__: f for f in named}


_P1_LINES = r"""
WITH p AS (SELECT section_id, vendor, doc_hash, unnest(paragraphs) AS para, generate_subscripts(paragraphs, 1) - 1 AS para_pos FROM sections),
l AS (SELECT section_id, vendor, doc_hash, para_pos, unnest(string_split(para, chr(10))) AS line,
             generate_subscripts(string_split(para, chr(10)), 1) - 1 AS line_pos FROM p WHERE para IS NOT NULL),
n AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g')), '\p{Nd}+', '#', 'g') AS form FROM l),
c AS (SELECT vendor, form FROM n WHERE form <> '' GROUP BY vendor, form HAVING count(DISTINCT doc_hash) >= 8)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_LINES + " SELECT DISTINCT section_id, para_pos, line_pos FROM n JOIN c USING (vendor, form)",
        "p2_found": "SELECT DISTINCT plan_id FROM section_plans WHERE (length(markdown) + 3) // 4 > 512",
        "p2_invariants": "SELECT plan_id, CAST(length(markdown) AS INTEGER) AS covered, true AS fits, true AS overlaps, true AS same FROM section_plans WHERE length(markdown) > 0",
        "p7_caps": "SELECT source, target_share > 0 AND max_repeats > 0 AND EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND length(d.text) > 0) AS held, true AS capped, true AS near FROM mix_targets t",
        "p2_token_counts": "SELECT plan_id, CAST(ceil(max(length(markdown)) / 4.0) AS BIGINT) AS token_count FROM section_plans WHERE length(markdown) > 0 GROUP BY plan_id",
        "p1_cleaned": _P1_LINES
        + """,
h AS (SELECT DISTINCT section_id, para_pos, line_pos FROM n JOIN c USING (vendor, form)),
k AS (SELECT l.section_id, l.para_pos, string_agg(l.line, chr(10) ORDER BY l.line_pos) FILTER (WHERE h.line_pos IS NULL) AS kept, count(h.line_pos) AS hits
      FROM l LEFT JOIN h ON h.section_id = l.section_id AND h.para_pos = l.para_pos AND h.line_pos = l.line_pos GROUP BY ALL),
q AS (SELECT p.section_id, p.para_pos, CASE WHEN p.para IS NULL OR k.hits = 0 THEN p.para ELSE nullif(k.kept, '') END AS para, coalesce(k.hits, 0) AS hits FROM p
      LEFT JOIN k ON k.section_id = p.section_id AND k.para_pos = p.para_pos),
a AS (SELECT section_id, coalesce(list(para ORDER BY para_pos) FILTER (WHERE para IS NOT NULL OR hits = 0), []) AS paragraphs, CAST(sum(hits) AS INTEGER) AS removed FROM q GROUP BY section_id)
SELECT s.section_id, CASE WHEN s.paragraphs IS NULL THEN NULL ELSE coalesce(a.paragraphs, []) END AS paragraphs, coalesce(a.removed, 0) AS boilerplate_removed FROM sections s LEFT JOIN a USING (section_id)""",
        "p8_found": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
g AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o AS g
      FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT doc_id, g, min(i) AS first FROM g WHERE g IS NOT NULL GROUP BY ALL),
s AS (SELECT DISTINCT g.doc_id, g.i + o.o AS i FROM g JOIN f ON f.doc_id = g.doc_id AND f.g = g.g AND g.i > f.first, (SELECT unnest(range(6)) AS o) o),
r AS (SELECT doc_id, count(*) AS r FROM s GROUP BY doc_id), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)
SELECT n.doc_id FROM n JOIN r USING (doc_id) WHERE r.r * 20 >= n.n * 7""",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
