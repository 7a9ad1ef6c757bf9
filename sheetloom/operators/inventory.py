"""The inventory of source documents, vendors and the state of builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import lexicons as lx
from sheetloom.functions.text import detect_doc_type, sniff_revision
from sheetloom.operators.registrations import plain_hash, plain_path
from sheetloom.runtime import sized


def dedupe_first(sources: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Of the rows with equal key the first in order. A struct minimum with
    map-side combine, so that a hot key costs one row per task."""
    names = sources.columns
    first = sources.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
    return first.select("_r.*")


def append_inventory(existing: DataFrame, new: DataFrame, key: str = "content_hash", order: str = "source_id") -> DataFrame:
    """existing and what of new has another key; existing rows win, and the
    first of equal new ones. Appending the same twice changes nothing."""
    fresh = dedupe_first(new, F.col(key), [order]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh)


def vendor_of(page_text: Column, file_name: Column) -> Column:
    """struct(vendor, evidence): the first profile one of whose marks is in
    the first page, else in the file name; without any the default, without
    evidence."""
    text, name = F.lower(F.coalesce(page_text, F.lit(""))), F.lower(F.coalesce(file_name, F.lit("")))
    out = None
    for vendor, marks, _ in lx.VENDOR_PROFILES:
        for mark in marks:
            for where, label in ((text, "p.1"), (name, "filename")):
                evidence = F.struct(F.lit(vendor).alias("vendor"), F.lit(f'brand:"{mark}" ({label})').alias("evidence"))
                out = (F if out is None else out).when(F.contains(where, F.lit(mark)), evidence)
    return out.otherwise(F.struct(F.lit(lx.DEFAULT_VENDOR).alias("vendor"), F.lit("").alias("evidence")))


def backend_of(vendor: Column, doc_type: Column, registered: list[str]) -> Column:
    """The first registered backend of the vendor's chain, the companion
    backend for other documents than datasheets, null where there is none."""
    out = F.when(doc_type != "datasheet", lx.COMPANION_BACKEND)
    for name, _, chain in lx.VENDOR_PROFILES:
        first = next((b for b in chain if b in registered), None)
        out = out.when(vendor == name, F.lit(first).cast("string"))
    return out


def vendor_drift(sources: DataFrame, first_pages: DataFrame) -> DataFrame:
    """Datasheets whose pinned vendor isn't the detected one and wasn't set by
    hand: (source_id, vendor, detected, evidence). Hashes of sources and of
    first_pages(content_hash, text) may be written differently."""
    pages = first_pages.groupBy(plain_hash(F.col("content_hash")).alias("_hash")).agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("_text"))
    asked = sources.where("doc_type = 'datasheet' and not startswith(coalesce(vendor_evidence, ''), 'cli-override')")
    joined = asked.withColumn("_hash", plain_hash(F.col("content_hash"))).join(pages, "_hash", "left")
    seen = joined.withColumn("_v", vendor_of(F.col("_text"), F.regexp_extract("path", r"([^/\\]*)$", 1)))
    return seen.where(~F.col("vendor").eqNullSafe(F.col("_v.vendor"))).select("source_id", "vendor", F.col("_v.vendor").alias("detected"), "_v.evidence")


def status_counts(jobs: DataFrame, by: list[str], statuses: tuple[str, ...] = ("done", "failed", "skipped")) -> DataFrame:
    """Jobs per status, and whether none failed."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in statuses]
    return jobs.groupBy(*by).agg(*counts, (F.count_if(F.col("status") == "failed") == 0).alias("ok"))


def latest_stage(events: DataFrame, job: str, stage: str, time: str, tie: str) -> DataFrame:
    """The last stage of each job; of equal times the greatest tie key."""
    return events.groupBy(job).agg(F.max_by(F.struct(stage, time), F.struct(time, tie)).alias("_e")).select(job, f"_e.{stage}", f"_e.{time}")


def extraction_stats(builds: DataFrame, by: list[str]) -> DataFrame:
    """Tables detected, accepted and rejected, and the mean fidelity weighted
    by build (0 without any)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tables_detected", "tables_accepted", "tables_rejected")]
    backends = F.array_sort(F.collect_set("backend")).alias("backends")  # as many as there are backends
    return builds.groupBy(*by).agg(*sums, F.coalesce(F.avg("mean_fidelity"), F.lit(0.0)).alias("mean_fidelity"), backends)


def skip_reason(jobs: DataFrame, published: DataFrame, versions: DataFrame) -> DataFrame:
    """(source_id, skip, reason): jobs(source_id, part_number, content_hash[,
    path]) may be skipped if their part has published documents, all of them
    built by today's pipeline and output versions, and the job's hash is among
    them, at the job's path where both sides have one. Whatever can't be
    verified is built, and the reason says why."""
    place = ["part_number", "content_hash"]
    if "path" in jobs.columns and "path" in published.columns:
        place.append("file")
        jobs, published = (df.withColumn("file", plain_path(F.col("path"))) for df in (jobs, published))
    v = versions.select("backend", F.col("pipeline_version").alias("_p"), F.col("output_version").alias("_o"))
    fresh = F.coalesce((F.col("pipeline_version") == F.col("_p")) & (F.col("extractor_version") == F.col("_o")), F.lit(False))
    docs = published.join(sized(v.dropDuplicates(["backend"])), "backend", "left").select(*place, fresh.alias("fresh"))
    parts = docs.groupBy("part_number").agg(F.min("fresh").alias("all_fresh"))
    known = docs.select(*place).distinct().withColumn("known", F.lit(True))
    out = jobs.join(parts, "part_number", "left").join(known, place, "left")
    reason = F.when(F.col("all_fresh").isNull(), "nothing published").when(~F.col("all_fresh"), "built by other versions").when(F.col("known").isNull(), "new or changed file")
    return out.select("source_id", reason.isNull().alias("skip"), reason.alias("reason"))


def override_evidence(vendor: str) -> str:
    return f"cli-override: --vendor {vendor}"


def register_sources(files: DataFrame, part_number: str | None = None, vendor: str | None = None, nda: bool = False) -> DataFrame:
    """files(path, content_hash, page_texts array<string>[, part_number]) as
    source documents: type by name, revision by the first pages, vendor by
    marks unless it is given. An unknown vendor is refused."""
    if vendor is not None and vendor not in {v for v, _, _ in lx.VENDOR_PROFILES}:
        raise ValueError(f"unknown vendor {vendor!r} (known: {', '.join(sorted(v for v, _, _ in lx.VENDOR_PROFILES))})")
    texts = F.coalesce("page_texts", F.array().cast("array<string>"))
    found = vendor_of(F.get(texts, F.lit(0)), F.regexp_extract("path", r"([^/\\]*)$", 1))
    part = F.lit(part_number) if part_number is not None else F.col("part_number") if "part_number" in files.columns else F.lit("")
    return files.select(
        "content_hash", "path", part.alias("part_number"), detect_doc_type(F.col("path")).alias("doc_type"), sniff_revision(texts).alias("revision"),
        F.size(texts).alias("page_count"), F.lit(nda).alias("nda"), (F.lit(vendor) if vendor else found["vendor"]).alias("vendor"),
        (F.lit(override_evidence(vendor)) if vendor else found["evidence"]).alias("vendor_evidence"), F.current_timestamp().alias("registered_at"),
    )


def pin_vendor(sources: DataFrame, vendor: str) -> DataFrame:
    return sources.withColumns({"vendor": F.lit(vendor), "vendor_evidence": F.lit(override_evidence(vendor))})


def backfill_evidence(sources: DataFrame, first_pages: DataFrame) -> DataFrame:
    """Fills in missing evidence where detection agrees with the pinned
    vendor; nothing else changes."""
    joined = sources.join(first_pages.select("content_hash", F.col("text").alias("_text")), "content_hash", "left")
    found = vendor_of(F.col("_text"), F.regexp_extract("path", r"([^/\\]*)$", 1))
    missing = (F.coalesce("vendor_evidence", F.lit("")) == "") & (found["vendor"] == F.col("vendor"))
    return joined.withColumn("vendor_evidence", F.when(missing, found["evidence"]).otherwise(F.col("vendor_evidence"))).select(*sources.columns)


def refresh_by_path(inventory: DataFrame, current: DataFrame) -> DataFrame:
    """inventory with the rows of files whose bytes have changed replaced by
    their current registration; rows of other files stay."""
    key = ["part_number", "path"]
    changed = current.join(inventory.select(*key).distinct(), key, "left_semi").join(inventory.select(*key, "content_hash"), [*key, "content_hash"], "left_anti")
    return inventory.join(changed.select(*key), key, "left_anti").unionByName(changed.select(*inventory.columns))


def shown_reasons(reasons: Column, shown: int = 3) -> Column:
    """The first reasons, and a sign that there are more."""
    text = F.array_join(F.slice(reasons, 1, shown), "; ")
    return F.when(F.size(reasons) > shown, F.concat(text, F.lit("; …"))).otherwise(text)
