"""Extracted sections by document, backend and version, so that unchanged
documents aren't extracted again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


@dataclass
class ExtractionCache:
    """Partitions (backend, version) of one table. A damaged partition
    fails the read: stale or half data is never served."""

    spark: SparkSession
    path: str

    def _read(self, backend: str, version: str) -> DataFrame | None:
        try:
            # the partition's own columns: backends differ in theirs
            return self.spark.read.option("mergeSchema", False).parquet(f"{self.path}/cache_backend={backend}/cache_version={version}")
        except AnalysisException:
            return None

    def lookup(self, documents: DataFrame, backend: str, version: str) -> tuple[DataFrame | None, DataFrame]:
        """(cached sections, documents without any) of documents(doc_hash)."""
        held = self._read(backend, version)
        if held is None:
            return None, documents
        hashes = held.select("doc_hash").distinct()
        cached = held.join(documents.select("doc_hash"), "doc_hash", "left_semi")
        return cached, documents.join(hashes, "doc_hash", "left_anti")

    def store(self, sections: DataFrame, backend: str, version: str) -> None:
        """Adds the sections of documents that lookup didn't find. Files are
        only ever added, so readers of older files go on undisturbed."""
        keyed = sections.withColumns({"cache_backend": F.lit(backend), "cache_version": F.lit(version)})
        keyed.write.mode("append").partitionBy("cache_backend", "cache_version").parquet(self.path)
