"""Lines printed again and again across one source's documents.

A store below a folder keeps, per source (vendor), which documents hold which
line, and the lines that have crossed the threshold. A new partition of sections
is merged as a delta: its distinct (source, line, document) triples are counted
together with those the store holds of the same lines, lines that cross the
threshold are detected, and only documents that hold a newly crossed line (and
the delta's own) are rebuilt. The store outlives the process: it is opened again
by its folder.

Triples are appended in buckets of their line, lines and cleaned sections in
buckets of their document, so that a merge opens only the buckets its delta
names, looks up only the delta's lines there and writes only what is new. Triples
of crossed lines are never looked up again; every COMPACT_EVERY merges they are
dropped and the rest is written as one batch.

Lines are told apart by a 128-bit hash of their compared form. A line printed by
a third of all documents is counted by map-side combined aggregates, and its
triples are spread over several files of its bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheetloom.runtime import hash128, shared_dir, sized, spread, staged
from sheetloom.sources.versions import Versions

#: A line is boilerplate if it occurs in so many documents of one source.
THRESHOLD = 8
COMPACT_EVERY = 16
#: Buckets of a store: so many per partition of its first delta, within bounds.
BUCKETS_PER_PARTITION = 4
BUCKETS = (8, 4096)
#: Parts into which a bucket is spread while it is written.
SALTS = 4

LINE = ["vendor", "h1", "h2"]
DOCUMENT = ["d1", "d2"]


def line_form(c: Column) -> Column:
    """The form in which lines are compared: lower case, trimmed, each run of
    white space one blank, each run of digits one mark."""
    blanks = F.regexp_replace(F.lower(c), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.regexp_replace(F.trim(blanks), r"(?U)\d+", "#")


def lines_of(sections: DataFrame, *keep: str) -> DataFrame:
    """(keep..., vendor, para_pos, line_pos, h1, h2, d1, d2): one row per line
    that isn't blank. Positions count all pieces of a paragraph between
    newlines. Rows without vendor or doc_hash, null paragraphs and null
    elements have no lines."""
    h1, h2 = hash128(F.col("form"))
    d1, d2 = hash128(F.col("doc_hash"))
    return (
        sections.where("vendor is not null and doc_hash is not null and paragraphs is not null")
        .select(*keep, "vendor", d1.alias("d1"), d2.alias("d2"), F.posexplode("paragraphs").alias("para_pos", "_para"))
        .select(*keep, "vendor", "d1", "d2", "para_pos", F.posexplode(F.split("_para", "\n")).alias("line_pos", "_line"))
        .withColumn("form", line_form(F.col("_line")))
        .where("form <> ''")
        .select(*keep, "vendor", "para_pos", "line_pos", h1.alias("h1"), h2.alias("h2"), "d1", "d2")
    )


def marked_lines(lines: DataFrame, crossed: DataFrame, *keep: str) -> DataFrame:
    """Those of lines (from lines_of) that are in crossed, as (keep...,
    para_pos, line_pos). A small set of crossed lines is broadcast (it is
    counted first); a larger one is joined by shuffle, where adaptive execution
    splits the partitions of hot lines."""
    return lines.join(sized(crossed.select(*LINE)), LINE, "left_semi").select(*keep, "para_pos", "line_pos")


def _bucket(hashed: str, buckets: int) -> Column:
    return F.pmod(F.col(hashed), F.lit(buckets)).cast("int")


class LineCounts:
    """The store. A merge writes folders of its own and is published as the
    next version; what older versions hold isn't changed, so a failed merge
    leaves the last state intact and a merge that raced with another is
    refused. A document may come in several partitions and a row repeatedly: a
    document counts once per line, and keeps the lines of all its extractions.

    Subclasses derive a result from each merge (see ``derive``), which is
    published together with it."""

    #: Columns of the sections that the lines carry.
    keep: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, root: str | None = None, threshold: int = THRESHOLD) -> None:
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/sheetloom/lines-{uuid.uuid4().hex}"
        self.versions = Versions(spark, self.root)
        self.number, self.state = self.versions.latest()
        self.threshold = self.state.get("threshold", threshold)
        if self.threshold != threshold:
            raise ValueError(f"the store counts with threshold {self.threshold}")

    def _write(self, df: DataFrame, table: str, batch: str, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{table}/batch={batch}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        schema = StructType([f for f in df.schema if f.name != by] + [f for f in df.schema if f.name == by])
        self.state.setdefault("schemas", {})[table] = schema.json()
        self.state.setdefault(table, []).append(batch)
        return self.spark.read.schema(schema).parquet(path)

    def table(self, name: str, before: str | None = None) -> DataFrame | None:
        """The published batches of a table (but ``before``'s own), with the
        column ``batch``; None if there are none."""
        batches = [b for b in self.state.get(name, []) if b != before]
        if not batches:
            return None
        schema = StructType.fromJson(json.loads(self.state["schemas"][name])).add("batch", "string")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("batch").isin(batches))

    def _in_buckets(self, df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
        """df's buckets that wanted names: read from no other folder."""
        named = [r[0] for r in wanted.select(column).distinct().collect()]  # at most as many as there are buckets
        return df if len(named) == self.state["buckets"] else df.where(F.col(column).isin(named))

    def merge(self, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Adds a partition. Returns (newly crossed lines, documents of earlier
        partitions that hold one, as d1, d2)."""
        self.number, self.state = self.versions.latest()
        if not self.state:
            wide = sections._jdf.queryExecution().toRdd().getNumPartitions() * BUCKETS_PER_PARTITION
            buckets = min(max(1 << max(wide - 1, 0).bit_length(), BUCKETS[0]), BUCKETS[1])
            self.state = {"threshold": self.threshold, "buckets": buckets}
        buckets, batch = self.state["buckets"], f"{self.number:06d}-{uuid.uuid4().hex[:8]}"
        rows = self.prepare(spread(sections))
        # the text is read and brought into compared form once; what is kept of a line is its place and hashes
        lines = lines_of(rows, *self.keep).withColumn("docs", _bucket("d1", buckets))
        lines = self._write(lines.repartition("docs", F.pmod("h1", F.lit(SALTS))), "lines", batch, "docs")
        crossed, old = self.table("crossed"), self.table("pairs")
        triples = lines.select(*LINE, *DOCUMENT, "docs", _bucket("h1", buckets).alias("bucket"), F.pmod("d1", F.lit(SALTS)).alias("salt"))
        if crossed is not None:
            # what is known to be boilerplate needs no counting any more
            triples = triples.join(sized(crossed.select(*LINE)), LINE, "left_anti")
        fresh = triples.repartition("bucket", "salt").dropDuplicates(["bucket", "salt", *LINE, *DOCUMENT]).drop("salt")
        fresh = self._write(fresh, "pairs", batch, "bucket")
        counted, held = fresh, None
        if old is not None:
            known = fresh.select(*LINE, "bucket").distinct()
            held = self._in_buckets(old, "bucket", fresh).join(sized(known.select(*LINE)), LINE, "left_semi").select(*LINE, *DOCUMENT, "docs")
            held = staged(held.distinct(), "held")
            counted = fresh.select(*LINE, *DOCUMENT).unionByName(held.select(*LINE, *DOCUMENT)).distinct()
        newly = counted.groupBy(*LINE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.threshold).select(*LINE)
        newly = self._write(newly, "crossed", batch)
        touched = (held if held is not None else fresh.where("false")).join(sized(newly), LINE, "left_semi").select(*DOCUMENT, "docs").distinct()
        touched = self._write(touched, "touched", batch)
        self.derive(batch, rows, lines, newly, touched)
        if len(self.state["pairs"]) > COMPACT_EVERY:
            self._compact()
        self.versions.publish(self.number + 1, self.state)
        self.number += 1
        return newly, touched.select(*DOCUMENT)

    def _compact(self) -> None:
        pairs = self.table("pairs").drop("batch").join(sized(self.crossed.select(*LINE)), LINE, "left_anti")
        self.state["pairs"] = []
        spread_out = pairs.withColumn("salt", F.pmod("d1", F.lit(SALTS))).repartition("bucket", "salt").dropDuplicates(["bucket", "salt", *LINE, *DOCUMENT])
        self._write(spread_out.drop("salt"), "pairs", f"compact-{self.number:06d}-{uuid.uuid4().hex[:8]}", "bucket")

    @property
    def crossed(self) -> DataFrame:
        return self.table("crossed")

    def rows_of(self, table: str, batch: str, documents: DataFrame) -> DataFrame | None:
        """Rows of the batches of a table before ``batch`` that belong to the
        documents (d1, d2, docs); only their buckets are read."""
        earlier = self.table(table, batch)
        if earlier is None:
            return None
        return self._in_buckets(earlier, "docs", documents).join(sized(documents.select(*DOCUMENT)), DOCUMENT, "left_semi")

    def prepare(self, sections: DataFrame) -> DataFrame:
        return sections

    def derive(self, batch: str, rows: DataFrame, lines: DataFrame, newly: DataFrame, touched: DataFrame) -> None:
        """Called in each merge before it is published."""


class RepeatedLines(LineCounts):
    """Keeps the places of repeated lines: a line is reported once, with the
    delta that brings it if its line has crossed by then, else when an earlier
    document is rebuilt because its line crosses later."""

    keep = ("section_id",)

    def derive(self, batch: str, rows: DataFrame, lines: DataFrame, newly: DataFrame, touched: DataFrame) -> None:
        found = marked_lines(lines, self.crossed, "section_id")
        if (earlier := self.rows_of("lines", batch, touched)) is not None:
            found = found.unionByName(marked_lines(earlier, newly, "section_id"))
        self._write(found, "found", batch)

    def found(self) -> DataFrame:
        return self.table("found").select("section_id", "para_pos", "line_pos").distinct()


class CleanedSections(LineCounts):
    """Keeps the cleaned sections. The sections of a touched document are read
    in their last cleaned form, cleaned of the newly crossed lines and written
    again; older rows of that document don't count any more."""

    keep = ("_row",)

    def prepare(self, sections: DataFrame) -> DataFrame:
        record = F.struct(*[c for c in sections.columns if c not in ("paragraphs", "boilerplate_removed")])
        rows = sections.select(record.alias("record"), "vendor", "doc_hash", "paragraphs", F.lit(0).alias("removed"))
        return staged(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")

    def derive(self, batch: str, rows: DataFrame, lines: DataFrame, newly: DataFrame, touched: DataFrame) -> None:
        clean = _taken_out(rows, marked_lines(lines, self.crossed, "_row"))
        if (earlier := self.rows_of("clean", batch, touched)) is not None:
            again = self._valid(earlier, batch).select("record", "vendor", "doc_hash", "paragraphs", "removed")
            again = staged(again.withColumn("_row", F.monotonically_increasing_id()), "rows")
            clean = clean.unionByName(_taken_out(again, marked_lines(lines_of(again, "_row"), newly, "_row")))
        d1, d2 = hash128(F.col("doc_hash"))
        clean = clean.select("record", "vendor", "doc_hash", "paragraphs", "removed", d1.alias("d1"), d2.alias("d2")).withColumn("docs", _bucket("d1", self.state["buckets"]))
        self._write(clean.repartition("docs", F.pmod(F.xxhash64("record"), F.lit(SALTS))), "clean", batch, "docs")

    def _valid(self, clean: DataFrame, before: str | None = None) -> DataFrame:
        """Rows that were written when their document was touched last, or later."""
        touched = self.table("touched", before)
        if touched is None:
            return clean
        last = touched.groupBy(*DOCUMENT).agg(F.max("batch").alias("last"))
        return clean.join(sized(last), DOCUMENT, "left").where(F.col("last").isNull() | (F.col("batch") >= F.col("last")))

    def sections(self) -> DataFrame:
        """All sections with cleaned ``paragraphs`` and the true
        ``boilerplate_removed``; other columns as they came."""
        return self._valid(self.table("clean")).select("record.*", "paragraphs", F.col("removed").alias("boilerplate_removed"))


def repeated_lines(deltas: list[DataFrame], threshold: int = THRESHOLD, root: str | None = None) -> DataFrame:
    """(section_id, para_pos, line_pos) of every repeated line, after merging
    the deltas one by one into the store below ``root`` (a new one if None)."""
    store = RepeatedLines(deltas[0].sparkSession, root, threshold)
    for delta in deltas:
        store.merge(delta)
    return store.found()


def partitions_by_time(sections: DataFrame, column: str = "extracted_at", parts: int = 2) -> list[DataFrame]:
    """The table as the sequence of partitions it arrived in: all but the
    newest hundredth of its time span first, then equal steps up to the
    newest. Rows without a time belong to the first."""
    if parts < 2:
        return [sections]
    lo, hi = sections.agg(F.min(column), F.max(column)).first()
    if lo is None or lo == hi:
        return [sections]
    step = (hi - lo) / 100
    cuts = [hi - step * k for k in range(parts - 1, 0, -1)]
    t = F.col(column)
    out = [sections.where(t.isNull() | (t < F.lit(cuts[0])))]
    for a, b in zip(cuts, [*cuts[1:], None], strict=True):
        out.append(sections.where((t >= F.lit(a)) if b is None else (t >= F.lit(a)) & (t < F.lit(b))))
    return out


def _taken_out(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """rows without the marked lines (_row, para_pos, line_pos); ``removed``
    grows by their number. A paragraph that loses its last line goes as a whole;
    null paragraphs stay null and lose nothing. Rows meet their marks by one
    shuffle on the row id."""
    hits = marked.groupBy("_row").agg(F.collect_set(F.struct("para_pos", "line_pos")).alias("_hits"))
    joined = rows.join(hits, "_row", "left").withColumn("_hits", F.coalesce("_hits", F.array().cast("array<struct<para_pos:int,line_pos:int>>")))
    cleaned = F.expr("""
        filter(transform(paragraphs, (p, i) -> if(p is null or not exists(_hits, h -> h.para_pos = i), p,
            nullif(array_join(filter(split(p, '\\n'), (l, j) -> not array_contains(_hits, struct(i as para_pos, j as line_pos))), '\\n'), ''))),
          (p, i) -> p is not null or not exists(_hits, h -> h.para_pos = i))""")
    return joined.withColumns({"paragraphs": cleaned, "removed": F.col("removed") + F.size("_hits")}).drop("_hits")


def cleaned_sections(deltas: list[DataFrame], threshold: int = THRESHOLD, root: str | None = None) -> DataFrame:
    """The sections of all deltas, merged one by one, without their repeated
    lines. Other columns pass unchanged, and so do repeated rows."""
    store = CleanedSections(deltas[0].sparkSession, root, threshold)
    for delta in deltas:
        store.merge(delta)
    return store.sections()
