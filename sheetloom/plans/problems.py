"""Queries of the general (not text-specific) training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetloom.operators.quantities import agreeing_rows, stated_values, to_common_units
from sheetloom.operators.registrations import files_to_build
from sheetloom.plans.unit_sql import agreeing_rows_sql
from sheetloom.runtime import read_table, staged


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (read_table(spark, sf_dir, t) for t in ("sources", "builds", "current_versions"))
    return files_to_build(*tables).select("source_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = (read_table(spark, sf_dir, t) for t in ("table_blocks", "common_units"))
    return agreeing_rows(staged(stated_values(*tables), "stated"))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_common_units(*(read_table(spark, sf_dir, t) for t in ("table_blocks", "common_units")))


def queries() -> dict:
    return {"p4_found": p4_found, "p5_found": p5_found, "p5_values": p5_values}


def oracle_sql() -> dict[str, str]:
    path = r"regexp_replace(regexp_replace(trim(path), '[\\/]+', '/', 'g'), '^(\./)+', '')"
    hash_ = r"regexp_replace(regexp_replace(lower(content_hash), '\s+', '', 'g'), '^[a-z0-9-]+:', '')"
    return {
        "p4_found": f"""
WITH s AS (SELECT part_number, {path} AS file, {hash_} AS h, registered_at, source_id FROM sources),
cur AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY part_number, file ORDER BY registered_at DESC NULLS LAST, source_id) = 1),
b AS (SELECT part_number, {path} AS file, {hash_} AS h, pipeline_version, extractor_version, backend, generated_at, build_id
      FROM builds WHERE status = 'done'),
done AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY part_number, file ORDER BY generated_at DESC NULLS LAST, build_id DESC) = 1)
SELECT cur.source_id FROM cur
LEFT JOIN done USING (part_number, file)
LEFT JOIN current_versions v ON v.backend = done.backend
WHERE NOT coalesce(done.h = cur.h AND cur.h <> '' AND done.pipeline_version = v.pipeline_version
  AND done.extractor_version = v.output_version AND trim(v.output_version) <> '' AND trim(v.pipeline_version) <> '', false)""",
        "p5_found": agreeing_rows_sql(),
    }
