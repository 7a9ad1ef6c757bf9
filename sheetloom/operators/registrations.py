"""Files whose current bytes still need a build (the work list of a run)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.operators.merkle import build_tree, changed_leaves, changed_records, depth_for, keyed_records
from sheetloom.runtime import sized, staged

#: The value of a saved record that no current record can equal.
STALE = "\u0000stale"
UNKNOWN = "\u0000unknown"


def plain_hash(c: Column) -> Column:
    """Letter case, an ``algorithm:`` prefix and blanks don't matter."""
    squeezed = F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    return F.regexp_replace(squeezed, r"^[a-z0-9-]+:", "")


def plain_path(c: Column) -> Column:
    """Separators and ``./`` don't matter; letter case does."""
    slashed = F.regexp_replace(F.trim(c), r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(slashed, r"(?<=^|/)(?:\./)+", ""), r"/\.$", "")


def current_registrations(sources: DataFrame) -> DataFrame:
    """(part_number, file, value, source_id): per file the registration with
    the greatest registered_at, its hash and the smallest source_id of that
    time. A null registered_at counts as the earliest; a null or blank hash is
    unknown content. Repeated rows change nothing."""
    rank = F.struct("registered_at", (-F.col("source_id")).alias("minus_id"))  # null compares lowest
    h = plain_hash(F.col("content_hash"))
    return (
        sources.select("part_number", plain_path(F.col("path")).alias("file"), rank.alias("rank"), F.when(h != "", h).alias("h"))
        .groupBy("part_number", "file")
        .agg(F.max(F.struct("rank", "h")).alias("top"))
        .select("part_number", "file", F.coalesce("top.h", F.lit(UNKNOWN)).alias("value"), (-F.col("top.rank.minus_id")).alias("source_id"))
    )


def finished_builds(builds: DataFrame, versions: DataFrame) -> DataFrame:
    """(part_number, file, value): per file its done build with the greatest
    generated_at; value is the hash it built, or STALE unless the build's
    pipeline and output versions are those of ``versions`` for its backend. A
    null time counts as the earliest, equal times fall to the greatest
    build_id."""
    rank = F.struct("generated_at", "build_id")  # null compares lowest
    done = (
        builds.where(F.col("status") == "done")
        .select(
            "part_number",
            plain_path(F.col("path")).alias("file"),
            F.struct(rank.alias("rank"), plain_hash(F.col("content_hash")).alias("h"), "pipeline_version", "extractor_version", "backend").alias("b"),
        )
        .groupBy("part_number", "file")
        .agg(F.max("b").alias("b"))
        .select("part_number", "file", "b.h", "b.pipeline_version", "b.extractor_version", "b.backend")
    )
    # one row per backend: a fixed table of a few rows
    today = versions.groupBy("backend").agg(F.collect_set(F.struct("pipeline_version", "output_version")).alias("today"))
    blank = (F.trim("pipeline_version") == "") | (F.trim("extractor_version") == "")
    met = F.array_contains(F.coalesce("today", F.array()), F.struct("pipeline_version", F.col("extractor_version").alias("output_version")))
    known = F.col("pipeline_version").isNotNull() & F.col("extractor_version").isNotNull() & ~blank
    return done.join(sized(today), "backend", "left").select("part_number", "file", F.when(known & met & (F.col("h") != ""), F.col("h")).otherwise(F.lit(STALE)).alias("value"))


def files_to_build(sources: DataFrame, builds: DataFrame, versions: DataFrame) -> DataFrame:
    """(source_id, part_number, file, change) of each file whose current bytes
    have no valid finished build. The saved side is the ledger of builds; both
    sides become Merkle trees, and only leaves whose digests differ are read
    again. Files that are only in builds are no work. Empty tables give an
    empty list."""
    current = staged(current_registrations(sources), "registrations")
    saved = staged(finished_builds(builds, versions), "finished")
    depth = depth_for(current.count())
    keys = ["part_number", "file"]
    a, b = keyed_records(current, keys, "value", depth, "source_id"), keyed_records(saved, keys, "value", depth)
    trees = [staged(build_tree(x, depth), "tree") for x in (a, b)]
    leaves = changed_leaves(*trees, depth)
    return changed_records(a, b, leaves, keys, "value", "source_id").where("change <> 'removed'").select("source_id", "part_number", "file", "change")
