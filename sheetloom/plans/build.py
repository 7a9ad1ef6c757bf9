"""The corpus build: decoded documents in, a queryable corpus out.

Documents are rows, so one job builds any number of parts. The work list is
taken by hash and version (see parts_to_build); what is published is a set of
tables, partitioned by part, and the text artifacts people read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sheetloom.functions import lexicons as lx
from sheetloom.functions import text as tx
from sheetloom.operators import index as ix
from sheetloom.operators.figures import plot_records
from sheetloom.operators.furniture import kept_lines
from sheetloom.operators.html import viewer_sections
from sheetloom.operators.inventory import backend_of, shown_reasons, skip_reason
from sheetloom.operators.layout import extract_layout
from sheetloom.operators.pages import pin_table_pages
from sheetloom.operators.plain import plain_sections
from sheetloom.operators.tables import grid_csv, key_symbols, spec_records, spec_tables
from sheetloom.runtime import staged
from sheetloom.sources.cache import ExtractionCache
from sheetloom.sources.readers import PLOT_RECORD, SPEC_RECORD, backend, backends, register_backend
from sheetloom.sources.writers import EventLog, write_table, write_text_files

PIPELINE_VERSION = "2"
OUTPUT_VERSION = {"pdf_layout": "layout-1", "pdf_text": "text-1", "ti_html": "viewer-1"}
#: The error of a document without any section.
NO_PAGES, NO_BACKEND = "no decoded pages", "no backend for the vendor"
TABLES = ("documents", "sections", "section_files", "specs", "spec_tables", "plots", "stats", "index")


@dataclass
class Documents:
    """Decoded input: sources(part_number, content_hash, doc_type, revision,
    path, page_count[, vendor]), and spans, drawings, toc and page texts by
    doc_hash. Of documents that a viewer serves, contents(doc_hash, html) and
    viewer_pages(url, html)."""

    sources: DataFrame
    page_spans: DataFrame
    page_drawings: DataFrame
    toc: DataFrame
    pages: DataFrame
    contents: DataFrame | None = None
    viewer_pages: DataFrame | None = None


def _layout(docs: Documents, hashes: DataFrame) -> DataFrame:
    return extract_layout(*[d.join(hashes, "doc_hash", "left_semi") for d in (docs.page_spans, docs.page_drawings, docs.toc)])


def _plain(docs: Documents, hashes: DataFrame) -> DataFrame:
    return plain_sections(docs.pages.join(hashes, "doc_hash", "left_semi"), docs.toc.join(hashes, "doc_hash", "left_semi"))


def _viewer(docs: Documents, hashes: DataFrame) -> DataFrame:
    """Pages that weren't fetched or can't be parsed are empty sections with an
    error. Tables and figures get the fields of the other backends'."""
    spark = hashes.sparkSession
    contents = spark.createDataFrame([], "doc_hash string, html string") if docs.contents is None else docs.contents
    cached = spark.createDataFrame([], "url string, html string") if docs.viewer_pages is None else docs.viewer_pages
    sections = viewer_sections(contents.join(hashes, "doc_hash", "left_semi"), cached.where("html is not null").dropDuplicates(["url"]), docs.toc.join(hashes, "doc_hash", "left_semi"), strict=False)
    tables = F.transform("tables", lambda t: t.withField("page", F.lit(None).cast("int")).withField("row_pages", F.lit(None).cast("array<int>")))
    return sections.withColumn("tables", tables).drop("method")


register_backend("pdf_layout", _layout)
register_backend("pdf_text", _plain)
register_backend("ti_html", _viewer)


def _routed(docs: Documents) -> DataFrame:
    """sources with the backend of their vendor's chain. The viewer backend is
    there only for documents with a contents page; sources without vendor are
    the default's, those of a vendor without profile have no backend."""
    sources = docs.sources if "vendor" in docs.sources.columns else docs.sources.withColumn("vendor", F.lit(lx.DEFAULT_VENDOR))
    vendor, kind = F.coalesce("vendor", F.lit(lx.DEFAULT_VENDOR)), F.coalesce("doc_type", F.lit(lx.UNKNOWN_DOC_TYPE))
    pdf = backend_of(vendor, kind, [b for b in backends() if b != "ti_html"])
    if docs.contents is None:
        return sources.withColumn("backend", pdf)
    served = docs.contents.where("html is not null").select(F.col("doc_hash").alias("content_hash")).distinct().withColumn("_served", F.lit(True))
    joined = sources.join(served, "content_hash", "left")
    return joined.withColumn("backend", F.when(F.col("_served"), backend_of(vendor, kind, backends())).otherwise(pdf)).drop("_served")


def _figure(sections: DataFrame):
    """The figures of all backends with the same fields."""
    held = sections.schema["figures"].dataType.elementType.names
    field = lambda f, name, type_: (f[name] if name in held else F.lit("" if type_ == "string" else None)).cast(type_).alias(name)
    return lambda f: F.struct(*[field(f, n, t) for n, t in (("caption", "string"), ("page", "int"), ("conditions", "string"), ("image_url", "string"))])


def extract(docs: Documents, cache: ExtractionCache | None = None) -> DataFrame:
    """Sections of all documents: datasheets by the backend of their vendor, the
    others (also those of unknown type) from their page texts, all with part,
    type and backend. A document that brings no section is one row with an
    error. With a cache only documents that it lacks for today's version of
    their backend are extracted."""
    kinds = _routed(docs).select("part_number", F.col("content_hash").alias("doc_hash"), F.coalesce("doc_type", F.lit(lx.UNKNOWN_DOC_TYPE)).alias("doc_type"), F.coalesce(F.when(F.col("revision") != "", F.col("revision")), F.col("path")).alias("label"), "backend")
    out = None
    for name in OUTPUT_VERSION:
        wanted = kinds.where(F.col("backend") == name).select("doc_hash").distinct()
        cached, missing = (None, wanted) if cache is None else cache.lookup(wanted, name, OUTPUT_VERSION[name])
        sections = staged(backend(name)(docs, missing), "sections")
        if cache is not None:
            # what failed is tried again next time
            whole = sections.join(sections.where("error is not null").select("doc_hash").distinct(), "doc_hash", "left_anti") if "error" in sections.columns else sections
            cache.store(whole, name, OUTPUT_VERSION[name])
        if cached is not None:
            sections = sections.unionByName(cached, allowMissingColumns=True)
        if "figures" in sections.columns:
            sections = sections.withColumn("figures", F.transform("figures", _figure(sections)))
        sections = sections.withColumn("backend", F.lit(name))
        out = sections if out is None else out.unionByName(sections, allowMissingColumns=True)
    # a document of two types has the sections of each backend once
    found = kinds.join(out.withColumn("_found", F.lit(True)), ["doc_hash", "backend"], "left")
    none = F.when(F.col("backend").isNull(), NO_BACKEND).otherwise(NO_PAGES)
    return found.withColumn("error", F.when(F.col("_found").isNull(), none).otherwise(F.col("error"))).drop("_found")


def ledger(extracted: DataFrame) -> DataFrame:
    """One row per document: what built it, and how it went."""
    stats = [F.max(c).alias(c) for c in ("tables_detected", "tables_accepted", "tables_rejected", "mean_fidelity", "error")]
    reasons = shown_reasons(F.coalesce(F.first("rejection_reasons", ignorenulls=True), F.array().cast("array<string>"))).alias("rejection_reasons")
    version = F.create_map(*[F.lit(x) for kv in OUTPUT_VERSION.items() for x in kv])[F.col("backend")]
    rows = extracted.groupBy("part_number", F.col("doc_hash").alias("content_hash"), "backend").agg(*stats, reasons)
    status = F.when(F.col("error").isNull(), "done").otherwise("failed")
    return rows.withColumns({"status": status, "pipeline_version": F.lit(PIPELINE_VERSION), "extractor_version": version, "generated_at": F.current_timestamp()})


def parts_to_build(spark: SparkSession, sources: DataFrame, out: str) -> DataFrame:
    """(part_number, skip, reason) of the parts of sources: a part is skipped
    if all of its documents are published by today's versions from the same
    path. Without a readable ledger nothing is."""
    try:
        published = spark.read.parquet(f"{out}/tables/documents").where("status = 'done'")
    except AnalysisException:
        return sources.select("part_number", F.lit(False).alias("skip"), F.lit("nothing published").alias("reason")).distinct()
    versions = spark.createDataFrame([(b, v, PIPELINE_VERSION) for b, v in OUTPUT_VERSION.items()], "backend string, output_version string, pipeline_version string")
    jobs = sources.select(F.concat_ws("/", "part_number", "content_hash", "path").alias("source_id"), "part_number", "content_hash", "path")
    skip = skip_reason(jobs, published, versions)
    return jobs.join(skip, "source_id").groupBy("part_number").agg(F.min("skip").alias("skip"), F.min("reason").alias("reason"))


def with_table_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """sections whose tables carry the page where their cells stand in the page
    texts; a table that isn't found keeps its page."""
    key = ["doc_hash", "backend", "sec_pos"]
    # a document of several parts is pinned once
    held = sections.where("size(tables) > 0").select(*key, F.concat_ws("/", "backend", "sec_pos").alias("section"), "page_start", "page_end", "tables").dropDuplicates(key)
    tables = held.select("doc_hash", "section", F.posexplode("tables").alias("i", "t")).select(F.struct("doc_hash", "section", "i").alias("table_id"), "doc_hash", "section", "t.grid")
    pinned = pin_table_pages(tables, held.select("doc_hash", "section", "page_start", "page_end"), pages)
    found = pinned.groupBy("table_id.doc_hash", "table_id.section").agg(F.map_from_entries(F.collect_list(F.struct("table_id.i", F.col("page").cast("int")))).alias("_pins"))
    found = staged(found, "pins")
    joined = sections.withColumn("section", F.concat_ws("/", "backend", "sec_pos")).join(found, ["doc_hash", "section"], "left")
    return joined.withColumn("tables", F.transform("tables", lambda t, i: t.withField("page", F.coalesce(F.col("_pins")[i], t["page"])))).drop("_pins", "section")


def structure(sections: DataFrame, pages: DataFrame) -> dict[str, DataFrame]:
    """The derived tables of extracted sections. A section with an error is
    an empty one; a document that couldn't be read has none."""
    good = sections.where("sec_pos is not null")
    # page texts bring no tables and figures
    good = good.withColumns({c: F.coalesce(c, F.array().cast(good.schema[c].dataType)) for c in ("tables", "figures", "paragraphs")})
    good = with_table_pages(good, pages)
    clean = kept_lines(F.col("paragraphs"))
    good = good.withColumns({"paragraphs_clean": clean, "boilerplate_removed": F.size("paragraphs") - F.size(clean), "stem": tx.section_stem(F.col("number"), F.col("title")), "dir": F.concat(F.lit("docs/"), tx.doc_dir_name(F.col("doc_type"), F.col("doc_hash")))})
    # keys carry the position: sections of one stem stay apart
    good = good.withColumn("stem", F.format_string("%03d-%s", "sec_pos", "stem"))
    tables = good.where("size(tables) > 0").select("part_number", "doc_hash", "sec_pos", F.col("number").alias("section"), "page_start", "dir", "stem", F.posexplode("tables").alias("table_index", "t"))
    tables = tables.select("part_number", "doc_hash", "sec_pos", "section", "table_index", "dir", "stem", F.concat_ws("/", "doc_hash", "sec_pos", "table_index").alias("table_id"), "t.*", F.col("page_start").alias("_start"))
    tables = tables.withColumn("page", F.coalesce("page", "_start"))
    figures = good.where("size(figures) > 0").select("part_number", "doc_hash", "sec_pos", "number", "title", "page_start", "page_end", F.posexplode("figures").alias("fig_pos", "f"))
    figures = figures.select("doc_hash", "sec_pos", "number", "title", "fig_pos", "f.caption", "f.conditions", "page_start", "page_end", "f.image_url")
    parts = good.select("part_number", "doc_hash").distinct()
    numbered = F.transform("tables", lambda t, i: t.withField("csv_file", F.concat(F.lit("tables/"), F.col("stem"), F.format_string("-t%02d.csv", i + 1))))
    figs = F.transform("figures", lambda f: F.struct(f["caption"].alias("caption"), f["conditions"].alias("conditions"), f["page"].alias("page")))
    rendered = good.withColumns({"paragraphs": F.col("paragraphs_clean"), "tables": numbered, "figures": figs})
    files = rendered.select(
        "part_number", "doc_hash", "sec_pos", "number", "title", "page_start", "page_end", "dir", "stem", "backend", ix.section_markdown(F.col("label")).alias("markdown"),
        F.size("tables").alias("n_tables"), F.size("figures").alias("n_figures"), "paragraphs", "boilerplate_removed",
        F.aggregate("tables", F.lit(0), lambda n, t: n + F.coalesce(F.size(t["footnotes"]), F.lit(0))).alias("n_footnotes"),
    )
    symbols = key_symbols(tables).select("doc_hash", F.col("section").alias("number"), "symbols")
    files = files.join(symbols, ["doc_hash", "number"], "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))
    files = files.withColumns({"file": F.concat("dir", F.lit("/sections/"), "stem", F.lit(".md")), "token_count": tx.count_tokens(F.col("markdown")), "description": ix.describe(F.col("paragraphs"), F.col("symbols"), F.col("n_figures"))})
    csvs = tables.select(F.concat("part_number", F.lit("/"), "dir", F.lit("/tables/"), "stem", F.format_string("-t%02d.csv", F.col("table_index") + 1)).alias("path"), grid_csv(F.col("headers"), F.col("grid")).alias("text"))
    return {
        "sections": good.select("part_number", "doc_hash", "sec_pos", "number", "title", "level", "page_start", "page_end", "paragraphs", "tables", "figures", "backend"),
        "section_files": files.drop("paragraphs", "symbols", "stem"),
        "specs": spec_records(tables),
        "spec_tables": spec_tables(tables).select("part_number", "doc_hash", "section", "table_index", "kind", "n_records", "unmapped_headers"),
        "plots": plot_records(figures).join(parts, "doc_hash"),
        "csvs": csvs,
    }


def corpus_stats(tables: dict[str, DataFrame], extracted: DataFrame) -> DataFrame:
    """One row per part: counts of what was published and what was not."""
    s = tables["section_files"].groupBy("part_number").agg(
        F.count(F.lit(1)).alias("n_sections"), F.sum("token_count").alias("total_tokens"), F.sum("n_tables").alias("n_tables"), F.sum("n_figures").alias("n_figures"),
        F.count("page_start").alias("sections_with_pages"), F.count_if(F.col("page_start").isNull()).alias("sections_without_pages"), F.countDistinct("doc_hash").alias("n_documents"),
        F.sum("n_footnotes").alias("n_footnotes"), F.sum("boilerplate_removed").alias("lines_removed"),
    )
    n = tables["specs"].groupBy("part_number").agg(F.count(F.lit(1)).alias("n_specs"))
    failed = extracted.groupBy("part_number").agg(F.countDistinct(F.when(F.col("error").isNotNull(), F.struct("doc_hash", "backend"))).alias("failed_documents"), F.max("error").alias("error"))
    return failed.join(s, "part_number", "left").join(n, "part_number", "left").withColumn("pipeline_version", F.lit(PIPELINE_VERSION))


def part_manifests(files: DataFrame, documents: DataFrame, stats: DataFrame) -> DataFrame:
    """(part_number, text): one manifest per part, as JSON: its documents, its
    sections without their texts, and its stats. documents is the ledger, files
    the section files. A part's manifest is one file, as its index is."""
    section = F.struct("doc_hash", "sec_pos", "number", "title", "page_start", "page_end", "file", "token_count", "n_tables", "n_figures", "boilerplate_removed", "description")
    sections = files.groupBy("part_number").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    listed = documents.groupBy("part_number").agg(F.array_sort(F.collect_set(F.struct("content_hash", "backend", "extractor_version", "status"))).alias("documents"))
    counts = stats.select("part_number", F.struct(*[c for c in stats.columns if c not in ("part_number", "pipeline_version")]).alias("stats"))
    whole = listed.join(sections, "part_number", "left").join(counts, "part_number", "left")
    return whole.select("part_number", F.to_json(F.struct(F.lit(PIPELINE_VERSION).alias("pipeline_version"), "part_number", "documents", "sections", "stats")).alias("text"))


def record_files(tables: dict[str, DataFrame]) -> DataFrame:
    """(path, text) of specs.json and plots.json of each document that has
    records; a file holds one document's."""
    dirs = tables["section_files"].select("part_number", "doc_hash", "dir").distinct()

    def files(rows: DataFrame, fields: str, name: str, order: list[str]) -> DataFrame:
        kept = [F.col(c).cast(t).alias(c) for c, t in (f.split(" ", 1) for f in fields.split(", ")) if c in rows.columns]
        records = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(o).alias(f"_{o}") for o in order], F.struct(*kept).alias("r")))), lambda x: x["r"])
        docs = rows.groupBy("part_number", "doc_hash").agg(records.alias("all")).join(dirs, ["part_number", "doc_hash"])
        return docs.select(F.concat("part_number", F.lit("/"), "dir", F.lit(f"/{name}.json")).alias("path"), F.to_json(F.struct("part_number", "doc_hash", F.col("all").alias("records" if name == "specs" else "plots"))).alias("text"))

    units = tables["specs"].withColumn("unit", F.struct(F.col("unit").alias("verbatim"), F.col("unit_canonical").alias("canonical")))
    specs = files(units, SPEC_RECORD, "specs", ["section", "table_index", "row_index"])
    return specs.unionByName(files(tables["plots"], PLOT_RECORD, "plots", ["id"]))


def build(spark: SparkSession, docs: Documents, out: str, budget: int = 3000, progress=lambda stage: None, cache: ExtractionCache | None = None) -> DataFrame:
    """Builds and publishes the corpus of all documents below out. Tables are
    overwritten by part, so parts that aren't among the documents stay. A
    document that can't be read is counted in the stats and fails no other.
    The ledger is written last: a build that breaks off is built again.
    Returns the stats of what was built."""
    progress("extracting")
    extracted = staged(extract(docs, cache), "extracted")
    progress("structuring")
    tables = structure(extracted, docs.pages)
    tables["section_files"] = staged(tables["section_files"], "files")
    progress("enriching")
    files = tables["section_files"].withColumns({"doc_dir": F.regexp_extract("dir", "/(.*)$", 1), "pos": F.struct("doc_hash", "sec_pos")})
    briefs = ix.brief_and_facts(tables["sections"], ["part_number"])
    heads = ix.index_heads(briefs, docs.sources, "part_number")
    meta = files.select("part_number", "doc_dir", "pos", "number", "title", "file", "page_start", "page_end", "token_count", "n_tables", "n_figures", "description")
    tables["index"] = ix.index_markdown(meta, heads, "part_number", budget)
    tables["stats"] = staged(corpus_stats(tables, extracted), "stats")
    known = [c for c in ("path", "vendor", "vendor_evidence") if c in docs.sources.columns]
    registered = docs.sources.select("part_number", "content_hash", *known).distinct()
    tables["documents"] = staged(ledger(extracted).join(registered, ["part_number", "content_hash"], "left"), "ledger")
    progress("publishing")
    texts = tables["section_files"].select(F.concat("part_number", F.lit("/"), "file").alias("path"), F.col("markdown").alias("text"))
    index = tables["index"].select(F.concat("part_number", F.lit("/INDEX.md")).alias("path"), F.col("markdown").alias("text"))
    manifests = part_manifests(tables["section_files"], tables["documents"], tables["stats"]).select(F.concat("part_number", F.lit("/manifest.json")).alias("path"), "text")
    # summed so that every file is written
    write_text_files(texts.unionByName(index).unionByName(tables["csvs"]).unionByName(record_files(tables)).unionByName(manifests), f"{out}/parts").agg(F.sum("bytes")).collect()
    for name in (*TABLES[1:], TABLES[0]):
        write_table(tables[name], f"{out}/tables/{name}", ["part_number"])
    return tables["stats"]


def run_batch(spark: SparkSession, docs: Documents, out: str, log: EventLog, budget: int = 3000, force: bool = False, cache: ExtractionCache | None = None) -> DataFrame:
    """(part_number, status, error) of every part: builds those that aren't
    published by today's versions (all, if forced) and logs each part's way."""
    gate = parts_to_build(spark, docs.sources, out)
    gate = staged(gate.withColumn("skip", F.lit(False)) if force else gate, "gate")
    # parts are numbered as their events come; none but the one at hand is on the driver
    log.total, job = gate.count(), count(1)
    log.emit("header", jobs=log.total)
    for (part,) in gate.where("skip").select("part_number").orderBy("part_number").toLocalIterator():
        log.emit("skipped", next(job), part, "already built by these versions")
    todo = gate.where("not skip").select("part_number")
    result = gate.where("skip").select("part_number", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("error"))
    if not todo.isEmpty():
        wanted = Documents(docs.sources.join(todo, "part_number", "left_semi"), docs.page_spans, docs.page_drawings, docs.toc, docs.pages, docs.contents, docs.viewer_pages)
        stats = build(spark, wanted, out, budget, lambda stage: log.emit(stage), cache)
        built = stats.select("part_number", F.when(F.col("failed_documents") > 0, "failed").otherwise("done").alias("status"), "error")
        for r in built.orderBy("part_number").toLocalIterator():
            log.emit(r.status, next(job), r.part_number, r.error or "")
        result = result.unionByName(built)
    return result
