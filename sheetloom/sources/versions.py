"""Numbered versions of a store in a shared folder. A version is published by
renaming a finished file to a name that must not exist yet: readers see all of
it or nothing, and of two writers that started from the same version only the
first succeeds. The rename is atomic on file systems such as HDFS; on a plain
object store the fence needs a committer that refuses to overwrite."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Outrun(RuntimeError):
    """Another writer has published the version meanwhile; start again from it."""


class Versions:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> tuple[int, dict]:
        """(number, content) of the newest version; (0, {}) if there is none."""
        p, fs = self._fs(f"{self.root}/versions")
        if not fs.exists(p):
            return 0, {}
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        numbers = [int(n) for n in names if n.isdigit()]
        if not numbers:
            return 0, {}
        at, _ = self._fs(f"{self.root}/versions/{max(numbers):08d}")
        stream = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def publish(self, number: int, content: dict) -> None:
        """Makes content version ``number``; raises Outrun if it exists."""
        jvm = self.spark._jvm
        tmp, fs = self._fs(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(json.dumps(content), "utf-8"))
        finally:
            out.close()
        target, _ = self._fs(f"{self.root}/versions/{number:08d}")
        ctx = jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            ctx.rename(tmp, target, options)
        except Exception as e:
            fs.delete(tmp, False)
            if fs.exists(target):
                raise Outrun(f"version {number} of {self.root} exists already") from e
            raise
