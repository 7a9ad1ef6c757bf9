"""Writers: the corpus as tables and as text artifacts, and event logs."""

from __future__ import annotations

import json
import os
import re
import tempfile
import threading
import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Overwrites only the partitions that df brings."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def atomic_write(path: str, text: str, retries: int = 10) -> None:
    """A file appears whole or not at all; its temporary name is unique and
    doesn't stay behind."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".part-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        for left in range(retries, -1, -1):
            try:
                os.replace(temporary, path)
                return
            except PermissionError:
                if not left:
                    raise
                time.sleep(0.05)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_text_files(files: DataFrame, root: str) -> DataFrame:
    """Writes files(path, text) below a shared folder from the workers, and
    gives (path, bytes). Of equal paths one text survives, so keys with
    positions are safer; see repeated_paths."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                atomic_write(os.path.join(root, path), text)
            yield pd.DataFrame({"path": batch["path"], "bytes": [len(t.encode()) for t in batch["text"]]})

    return files.select("path", "text").mapInPandas(run, "path string, bytes long")


def repeated_paths(files: DataFrame) -> DataFrame:
    return files.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def save_inventory(inventory: DataFrame, path: str) -> None:
    """An inventory as one JSON array, for people; a part has a few documents."""
    rows = [json.loads(r) for r in inventory.toJSON().collect()]
    atomic_write(path, json.dumps(rows, indent=2, ensure_ascii=False))


def log_path(cache_dir: str, batch_dir: str, start: datetime) -> str:
    """Where a run's events go: named by its folder and start."""
    stem = re.sub(r'[\\/:*?"<>|]', "_", os.path.splitext(os.path.basename(batch_dir.rstrip("/")))[0])
    return os.path.join(cache_dir, "batches", f"{stem}-{start.strftime('%Y%m%d-%H%M%S-%f')}", "batch.jsonl")


class EventLog:
    """Stage events of a run: a line on the terminal and a line of JSON each,
    never mixed with one another. A log that can't be written is reported once
    and stops nothing."""

    def __init__(self, path: str, total: int, show=print) -> None:
        self.path, self.total, self.show = path, total, show
        self._lock, self._warned = threading.Lock(), False

    def emit(self, stage: str, job: int | None = None, part: str | None = None, detail: str = "", **more) -> None:
        event = {"timestamp": datetime.now(timezone.utc).isoformat(timespec="milliseconds"), "job": job, "part": part, "stage": stage, "detail": detail} | more
        who = "batch" if job is None else f"[{job}/{self.total}] {part}"
        note = f" ({' '.join(detail.splitlines())})" if detail else ""
        with self._lock:
            self.show(f"{who}: {stage}{note}")
            try:
                os.makedirs(os.path.dirname(self.path), exist_ok=True)
                with open(self.path, "a", encoding="utf-8") as f:
                    f.write(json.dumps(event) + "\n")
            except OSError:
                if not self._warned:
                    self._warned = True
                    self.show(f"batch log unavailable: {self.path}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp timestamp, job int, part string, stage string, detail string").json(path)
