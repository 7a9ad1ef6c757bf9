"""Readers: files of documents, decoded rows, inventories and answers."""

from __future__ import annotations

import itertools
import time
import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.functions.text import binary_cache_name, cache_name

SOURCE_DOCUMENT = "content_hash string, path string, part_number string, doc_type string, revision string, page_count int, nda boolean, vendor string, vendor_evidence string, registered_at timestamp"
FOOTNOTES = "array<struct<marker:string,text:string>>"
SPEC_RECORD = (
    "section string, table_index int, row_index int, symbol string, name string, conditions string, table_conditions string, min string, typ string, max string, value string, "
    f"unit struct<verbatim:string,canonical:string>, footnotes {FOOTNOTES}, cited_markers array<string>, page int, row_verbatim array<string>"
)
PLOT_RECORD = "id string, section string, caption string, figure_number string, conditions string, page_start int, page_end int, image_url string, file string, tags array<string>"
GOLDEN = "id string, question string, expected_substrings array<string>, pages array<int>, section string, kind string, spec_query map<string,string>, plot_query map<string,string>, notes string"


def _struct(ddl: str) -> str:
    """A DDL column list as a struct's field list."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()


@dataclass
class Settings:
    """Folders and budgets; environment variables SHEETLOOM_<NAME> override."""

    parts_dir: str = "parts"
    cache_dir: str = "cache"
    index_token_budget: int = 3000
    plot_image_dpi: int = 150
    batch_workers: int = 4
    env: dict = field(default_factory=lambda: dict(os.environ), repr=False)

    def __post_init__(self) -> None:
        for f in fields(self):
            text = self.env.get(f"SHEETLOOM_{f.name.upper()}")
            if text is not None and f.name != "env":
                setattr(self, f.name, int(text) if isinstance(f.default, int) else text)
        if self.batch_workers < 1:
            raise ValueError("batch_workers must be at least 1")


def discover_documents(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """(path, part, content_hash, length) of the files right in a folder whose
    name ends in suffix, in any case; the part is the name without its
    extension in upper case. A missing folder is an error."""
    files = spark.read.format("binaryFile").load(folder).where(F.endswith(F.lower("path"), F.lit(suffix)))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    part = F.upper(F.regexp_replace(name, r"\.[^.]*$", ""))
    return files.select("path", part.alias("part"), F.sha2("content", 256).alias("content_hash"), "length")


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file, with ``_path``. Unreadable files are left out;
    count them with unreadable_documents."""
    raw = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.withColumn("_path", F.input_file_name()).where("_corrupt_record is null").drop("_corrupt_record")


def unreadable_documents(spark: SparkSession, path: str) -> DataFrame:
    """(_path, _corrupt_record) of JSON files that can't be read."""
    # a field that no file has: the parser must be asked for more than the broken text
    raw = spark.read.schema("_none string, _corrupt_record string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.where("_corrupt_record is not null and _none is null").select(F.input_file_name().alias("_path"), "_corrupt_record")


MANIFEST = (
    "pipeline_version string, part_number string, documents array<struct<content_hash:string,backend:string,extractor_version:string,status:string>>, "
    "sections array<struct<doc_hash:string,sec_pos:int,number:string,title:string,page_start:int,page_end:int,file:string,token_count:long,n_tables:int,n_figures:int,boilerplate_removed:int,description:string>>"
)


def manifest_sections(manifests: DataFrame) -> DataFrame:
    """The sections of manifests, one per row, with part and pipeline version."""
    return manifests.select("part_number", "pipeline_version", F.inline("sections"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """The manifests of all parts below path, one per row; broken ones are
    left out."""
    return read_json_documents(spark, path, MANIFEST)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """The source documents of an inventory file (a JSON array); none if there
    is no file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], SOURCE_DOCUMENT)
    return spark.read.schema(SOURCE_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Spec records of all spec files, one per row, with part and document."""
    files = read_json_documents(spark, path, f"part_number string, doc_hash string, records array<{_struct(SPEC_RECORD)}>")
    rows = files.where("records is not null").select("part_number", "doc_hash", F.posexplode("records").alias("pos", "r"))
    return rows.select("part_number", "doc_hash", "pos", "r.*")


def read_plots(spark: SparkSession, path: str) -> DataFrame:
    files = read_json_documents(spark, path, f"part_number string, doc_hash string, plots array<{_struct(PLOT_RECORD)}>")
    rows = files.where("plots is not null").select("part_number", "doc_hash", F.posexplode("plots").alias("pos", "r"))
    return rows.select("part_number", "doc_hash", "pos", "r.*")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a YAML file with a list ``questions``; fails on anything
    else. The file is a hand-written list, read by the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        items = yaml.safe_load(f)["questions"]
    names = [c.split()[0] for c in GOLDEN.split(", ")]
    for item in items:
        if not {"id", "question"} <= item.keys():
            raise ValueError(f"a question without id or text: {item}")
    defaults = {"expected_substrings": [], "pages": [], "kind": "direct", "notes": ""}
    return spark.createDataFrame([tuple(i.get(n, defaults.get(n)) for n in names) for i in items], GOLDEN)


def fetch_plan(urls: DataFrame, cache: DataFrame, binary: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cached, missing): addresses that are in the cache table, and the names
    under which the others have to be stored."""
    name = (binary_cache_name if binary else cache_name)(F.col("url"))
    known = cache.select("url").distinct()
    return urls.join(cache, "url"), urls.join(known, "url", "left_anti").select("url", name.alias("name"))


def fetch_missing(missing: DataFrame, get: Callable[[str], bytes], delay: float = 0.0, attempts: int = 1) -> DataFrame:
    """(url, data, error) by calling get on the workers, one address at a time
    per task with a delay (seconds) before each call but the first; a call that
    fails is tried again up to ``attempts`` times. An error is a value, not a
    failed job."""
    def once(url: str, n: int) -> bytes:
        try:
            return get(url)
        except Exception:
            if n >= attempts:
                raise
            time.sleep(delay)
            return once(url, n + 1)

    def run(batches):
        waits = itertools.chain([0.0], itertools.repeat(delay))
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    time.sleep(next(waits))
                    rows.append((url, once(url, 1), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, str(e)))
            yield pd.DataFrame(rows, columns=["url", "data", "error"])

    return missing.select("url").mapInPandas(run, "url string, data binary, error string")


_BACKENDS: dict[str, Callable[..., DataFrame]] = {}


def register_backend(name: str, build: Callable[..., DataFrame]) -> None:
    """A backend is a function from decoded rows to sections."""
    _BACKENDS[name] = build


def backend(name: str) -> Callable[..., DataFrame]:
    if name not in _BACKENDS:
        raise KeyError(f"unknown backend {name!r} (known: {', '.join(sorted(_BACKENDS))})")
    return _BACKENDS[name]


def backends() -> list[str]:
    return sorted(_BACKENDS)
