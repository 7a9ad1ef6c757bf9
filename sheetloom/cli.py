"""Command line: build, batch, add-doc, query, plots, verify, status, version.

Exit codes: 0 all well, 1 nothing found or failed, 2 wrong use."""

from __future__ import annotations

import argparse
import hashlib
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import functions as F

from sheetloom import __version__
from sheetloom.operators.figures import find_plots, plot_answer_line
from sheetloom.operators.inventory import append_inventory, register_sources, status_counts
from sheetloom.operators.lookup import find_specs, format_answers
from sheetloom.operators.verify import lookup_economics, summarize, verification_report, verify_plots, verify_questions, verify_specs
from sheetloom.plans.build import Documents, run_batch
from sheetloom.runtime import local_session
from sheetloom.sources.cache import ExtractionCache
from sheetloom.sources.readers import read_golden, read_inventory
from sheetloom.sources.writers import EventLog, log_path, save_inventory

PLOTS_SHOWN, SPECS_SHOWN = 8, 5


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or local_session("sheetloom", str(os.cpu_count() or 2))


def _table(spark, corpus: str, name: str, part: str | None = None):
    df = spark.read.parquet(f"{corpus}/tables/{name}")
    return df if part is None else df.where(F.col("part_number") == part)


def _has(corpus: str, part: str) -> bool:
    if os.path.isdir(f"{corpus}/tables/stats/part_number={part}"):
        return True
    print(f"no corpus of {part} below {corpus}: build it first", file=sys.stderr)
    return False


def _build(a) -> int:
    spark = _session()
    names = ("sources", "page_spans", "page_drawings", "toc", "pages")
    missing = [n for n in names if not os.path.exists(f"{a.input}/{n}.parquet")]
    if missing:
        print(f"no such tables below {a.input}: {', '.join(missing)}", file=sys.stderr)
        return 2
    given = [*names, *[n for n in ("contents", "viewer_pages") if os.path.exists(f"{a.input}/{n}.parquet")]]
    docs = Documents(**{n: spark.read.parquet(f"{a.input}/{n}.parquet") for n in given})
    cache = None if a.no_cache else ExtractionCache(spark, f"{a.corpus}/cache/extract")
    log = EventLog(log_path(f"{a.corpus}/cache", a.input, datetime.now(timezone.utc)), 0)
    counts = status_counts(run_batch(spark, docs, a.corpus, log, a.budget, a.force, cache), []).first()
    print(f"{counts.done} done, {counts.failed} failed, {counts.skipped} skipped")
    return 0 if counts.ok else 1


def _batch(a) -> int:
    """Builds every folder in turn; one that fails stops none."""
    codes = [_build(argparse.Namespace(**(vars(a) | {"input": folder}))) for folder in a.inputs]
    return max(codes)


def _add_doc(a) -> int:
    """Registers a file in its part's inventory. The same bytes twice change
    nothing."""
    if not os.path.isfile(a.file):
        print(f"no file {a.file}", file=sys.stderr)
        return 2
    spark = _session()
    with open(a.file, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    texts = []
    if a.pages:
        pages = spark.read.parquet(a.pages).where(F.col("doc_hash") == digest).orderBy("page").limit(3)
        texts = [r.text for r in pages.select("text").collect()]  # at most three pages
    files = spark.createDataFrame([(a.file, digest, texts)], "path string, content_hash string, page_texts array<string>")
    try:
        new = register_sources(files, a.part, a.vendor or None, a.nda)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    path = f"{a.corpus}/parts/{a.part}/sources.json"
    old = read_inventory(spark, path)
    new = new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema])
    kept = append_inventory(old, new, order="path").cache()
    save_inventory(kept, path)
    print(f"{a.part}: {kept.count()} documents")
    return 0


def _query(a) -> int:
    if not _has(a.corpus, a.part):
        return 2
    found = find_specs(_table(_session(), a.corpus, "specs", a.part), a.symbol, a.name, a.section)
    rows = format_answers(found, ["part_number"], SPECS_SHOWN).collect()
    print(rows[0].answer if rows else "No matching spec records.")
    return 0 if rows else 1


def _plots(a) -> int:
    if not _has(a.corpus, a.part):
        return 2
    tags = [t.strip() for t in a.tag.split(",") if t.strip()]
    found = find_plots(_table(_session(), a.corpus, "plots", a.part), q=a.q, section=a.section, tags=tags)
    rows = found.select(plot_answer_line().alias("line"), "doc_hash", "id").orderBy("doc_hash", "id").limit(PLOTS_SHOWN + 1).collect()
    if not rows:
        print("No matching plots.")
        return 1
    print("\n".join(r.line for r in rows[:PLOTS_SHOWN]))
    if len(rows) > PLOTS_SHOWN:
        print(f"... and {found.count() - PLOTS_SHOWN} more matches")
    return 0


def _verify(a) -> int:
    if not _has(a.corpus, a.part):
        return 2
    if not os.path.exists(a.golden):
        print(f"no golden questions at {a.golden}", file=sys.stderr)
        return 2
    spark = _session()
    files = _table(spark, a.corpus, "section_files", a.part).select("doc_hash", "file", "page_start", "page_end", F.col("markdown").alias("text"))
    documents = files.select("doc_hash").distinct()
    if a.pages:
        pages = spark.read.parquet(a.pages).join(documents, "doc_hash", "left_semi")
    else:
        print("no page texts: page citations can't be verified, text questions fail", file=sys.stderr)
        pages = spark.createDataFrame([], "doc_hash string, page int, text string")
    golden = read_golden(spark, a.golden).withColumn("question_id", F.monotonically_increasing_id())
    if golden.isEmpty():
        print(f"no questions in {a.golden}", file=sys.stderr)
        return 2
    # a part is asked as a whole: its documents count as one
    golden = golden.withColumns({"doc_hash": F.lit(a.part), "is_plot": F.coalesce(F.size("plot_query") > 0, F.lit(False))})
    as_part = [df.withColumn("doc_hash", F.lit(a.part)) for df in (files, pages)]
    results = verify_questions(golden, *as_part).cache()
    s = summarize(results).first()
    print(f"{s.passed}/{s.total} passed ({s.accuracy:.0%})\n\n| # | Question | Pages | Corpus has answer | Page cite correct |\n|---|---|---|---|---|")
    for r in verification_report(results, golden).orderBy("question_id").toLocalIterator():
        print(r.line)
    failed = s.failed
    if a.specs:
        asked = golden.withColumn("doc_hash", F.lit(a.part))
        records, plots = (_table(spark, a.corpus, t, a.part).withColumn("doc_hash", F.lit(a.part)) for t in ("specs", "plots"))
        for title, rows in (("Spec record found", verify_specs(asked, records).withColumnRenamed("passed", "ok")), ("Plot found", verify_plots(asked, plots).withColumnRenamed("found", "ok"))):
            print(f"\n| # | {title} |\n|---|---|")
            for r in rows.orderBy("question_id").toLocalIterator():
                print(f"| {r.question_id} | {'✅' if r.ok else '❌'} |")
                failed += not r.ok
    index = _table(spark, a.corpus, "index", a.part).first()
    e = lookup_economics(results, as_part[0], golden, index.tokens if index else 0).first()
    print(f"\ntokens per question: {e.avg_per_question:.0f} on average, {e.max_per_question} at most; all sections: {e.full_dump_tokens}")
    return 0 if failed == 0 else 1


def _status(a) -> int:
    print(f"sheetloom {__version__}\ncorpus: {a.corpus}")
    if os.path.isdir(f"{a.corpus}/tables/stats"):
        spark = _session()
        documents = _table(spark, a.corpus, "documents")
        for c in ("vendor", "vendor_evidence"):
            documents = documents if c in documents.columns else documents.withColumn(c, F.lit(None).cast("string"))
        # backends, vendors and their evidence are a few per part
        seen = documents.groupBy("part_number").agg(*[F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(c) for c in ("backend", "vendor", "vendor_evidence")])
        for r in _table(spark, a.corpus, "stats").join(seen, "part_number", "left").orderBy("part_number").toLocalIterator():
            print(f"  {r.part_number}: {r.n_documents or 0} documents, {r.n_sections or 0} sections, {r.failed_documents} failed" + (f" ({r.error})" if r.error else ""))
            print(f"    backends: {r.backend or '-'}; vendor: {r.vendor or '-'} ({r.vendor_evidence or 'no evidence'}); {r.n_tables or 0} tables, {r.n_specs or 0} specs, {r.n_footnotes or 0} footnotes, {r.lines_removed or 0} lines removed")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sheetloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, run, help_: str, part: bool = False):
        p = sub.add_parser(name, help=help_)
        p.add_argument("--corpus", default=os.environ.get("SHEETLOOM_CORPUS", "corpus"))
        if part:
            p.add_argument("--part", required=True)
        p.set_defaults(run=run)
        return p

    b = command("build", _build, "build a corpus from decoded documents")
    batch = command("batch", _batch, "build several folders of decoded documents")
    batch.add_argument("inputs", nargs="+")
    for x in (b, batch):
        x.add_argument("--budget", type=int, default=3000)
        x.add_argument("--force", action="store_true", help="build parts that are up to date too")
        x.add_argument("--no-cache", action="store_true", help="extract documents again")
    d = command("add-doc", _add_doc, "register a document of a part", part=True)
    d.add_argument("file")
    d.add_argument("--pages", default="", help="decoded page texts, to tell revision and vendor by")
    d.add_argument("--vendor", default="")
    d.add_argument("--nda", action="store_true")
    b.add_argument("input", help="folder of sources, page_spans, page_drawings, toc and pages, with viewer pages also contents and viewer_pages, as Parquet")
    q = command("query", _query, "look up spec records", part=True)
    for name in ("symbol", "name", "section"):
        q.add_argument(f"--{name}", default="")
    p = command("plots", _plots, "look up plots", part=True)
    for name in ("q", "section", "tag"):
        p.add_argument(f"--{name}", default="")
    v = command("verify", _verify, "check golden questions", part=True)
    v.add_argument("--golden", required=True)
    v.add_argument("--pages", default="")
    v.add_argument("--specs", action="store_true", help="check spec and plot queries too")
    command("status", _status, "what is built")
    command("version", lambda a: print(f"sheetloom {__version__}") or 0, "print the version")
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
