"""Processing only new or changed records, by a Merkle tree over key ranges.

Keys are placed on the 64-bit hash ring and cut into ranges of equal width (the
leaves). A leaf's digest is the XOR of 128-bit record digests, so neither row
order nor partitioning matters; an inner node's digest is that of its 256
children. Two trees are compared from the root and descended only where the
digests differ; the records of the leaves that are left are compared key by
key. A level is compared by one aggregate over the nodes of both trees (equal
digests cancel out), records by one aggregate over both sides.

Trees, frontiers and records all stay DataFrames; the driver sees the two roots.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.runtime import hash128, sized, staged
from sheetloom.sources.versions import Versions

FANOUT_BITS = 8
#: A tree is cut so deep that a leaf holds about so many records.
LEAF_ROWS = 64
MAX_DEPTH = 5


def depth_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    depth = 1
    while depth < MAX_DEPTH and leaf_rows << (FANOUT_BITS * depth) < rows:
        depth += 1
    return depth


def _leaf(keys: list[str], depth: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(7), *keys), 64 - FANOUT_BITS * depth)


def keyed_records(df: DataFrame, keys: list[str], value: str, depth: int, *carried: str) -> DataFrame:
    """(keys, value, carried, leaf, d1, d2); one row per key is expected. A
    null key is a key of its own, a null value a value of its own. Carried
    columns take no part in the comparison."""
    marked = [F.struct(*keys, F.col(value).isNull(), value)]
    d1, d2 = hash128(*marked)
    return df.select(*keys, value, *carried, _leaf(keys, depth).alias("leaf"), d1.alias("d1"), d2.alias("d2"))


def build_tree(records: DataFrame, depth: int) -> DataFrame:
    """(level, node, d1, d2, n) of all levels over the output of keyed_records;
    level 0 is the root. One shuffle of the records (combined map-side to one
    row per leaf) and one of the leaves, each sent to its ancestors."""
    leaves = records.groupBy(F.col("leaf").alias("node")).agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.count(F.lit(1)).alias("n"))
    return (
        leaves.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(depth))))
        .withColumn("node", F.expr(f"shiftrightunsigned(node, {FANOUT_BITS} * up)"))
        .withColumn("level", F.lit(depth) - F.col("up"))
        .groupBy("level", "node")
        .agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n"))
        .selectExpr("cast(level as int) level", "node", "d1", "d2", "n")
    )


def _root(tree: DataFrame) -> tuple | None:
    row = tree.where("level = 0").select("d1", "d2", "n").first()
    return tuple(row) if row else None


def changed_leaves(current: DataFrame, saved: DataFrame, depth: int) -> DataFrame:
    """Leaf numbers whose digests differ, found by descending from the root.
    Equal roots end it at once; below, only children of nodes that differ are
    compared."""
    digests = ["level", "node", "d1", "d2"]
    both = current.select(*digests, "n").unionByName(saved.select(*digests, (-F.col("n")).alias("n")))
    if _root(current) == _root(saved):
        return both.where("false").select(F.col("node").alias("leaf"))
    frontier = None
    for level in range(1, depth + 1):
        nodes = both.where(F.col("level") == level)
        if frontier is not None:
            parent = F.expr(f"shiftrightunsigned(node, {FANOUT_BITS})")
            nodes = nodes.withColumn("parent", parent).join(sized(frontier.select(F.col("node").alias("parent"))), "parent", "left_semi")
        met = nodes.groupBy("node").agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n"))
        frontier = staged(met.where("d1 <> 0 or d2 <> 0 or n <> 0").select("node"), "frontier")
    return frontier.select(F.col("node").alias("leaf"))


def changed_records(
    current: DataFrame, saved: DataFrame, leaves: DataFrame, keys: list[str], value: str, *carried: str
) -> DataFrame:
    """(keys, value, carried, change) of every key that is ``new`` or
    ``changed`` in current, or ``removed`` from it, among the given leaves.
    Both sides come from keyed_records of one depth; carried columns are those
    of current."""
    few = sized(leaves)
    now = F.struct(value, *carried)
    a = current.join(few, "leaf", "left_semi").select(*keys, now.alias("now"), F.lit(None).cast("struct<v:bigint,w:bigint>").alias("was"), F.struct(F.col("d1").alias("v"), F.col("d2").alias("w")).alias("is"))
    b = saved.join(few, "leaf", "left_semi").select(*keys, F.lit(None).cast(a.schema["now"].dataType).alias("now"), F.struct(F.col("d1").alias("v"), F.col("d2").alias("w")).alias("was"), F.lit(None).cast("struct<v:bigint,w:bigint>").alias("is"))
    met = a.unionByName(b).groupBy(*keys).agg(F.max("now").alias("now"), F.max("was").alias("was"), F.max("is").alias("is"))
    change = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(F.col("is") != F.col("was"), "changed")
    return met.select(*keys, *[f"now.{c}" for c in (value, *carried)], change.alias("change")).where(F.col("change").isNotNull())


@dataclass
class IncrementalRun:
    """Runs a job over just the records that changed since the last successful
    run below ``root``.

    A run writes its output, its changes, its tree and the records of the
    leaves that differ into a folder of its own and is published as the next
    version, so output and tree appear together or not at all: after a failure
    at any point the next run starts from the same version and meets the same
    records. Of two runs at once the second to publish raises Outrun. A leaf of
    the tree names the run that holds its records, so what is read and written
    besides the comparison follows the changes. A tree that has become too
    shallow for its records is built anew, deeper, from the saved records.

    Keys are unique in ``current``; process keeps the key columns.
    """

    spark: SparkSession
    root: str
    keys: list[str]
    value: str
    leaf_rows: int = LEAF_ROWS

    def __post_init__(self) -> None:
        self.versions = Versions(self.spark, self.root)

    def published(self) -> list[str]:
        """Names of the published runs, oldest first."""
        return self.versions.latest()[1].get("runs", [])

    def _load(self, name: str, what: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{what}")

    def _all(self, runs: list[str], what: str) -> DataFrame:
        out = None
        for i, name in enumerate(runs):
            one = self._load(name, what).withColumn("_run", F.lit(i))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        return out

    def outputs(self) -> DataFrame | None:
        """The output of every key that still exists, by the run that processed
        it last: what a changed key gave before, and what a removed key gave,
        is gone."""
        runs = self.published()
        if not runs:
            return None
        last = self._all(runs, "changes").groupBy(*self.keys).agg(F.max(F.struct("_run", "change")).alias("last")).where("last.change <> 'removed'")
        last = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col("last._run").alias("_last"))
        out = self._all(runs, "output")
        on = F.col("_run") == F.col("_last")
        for i, k in enumerate(self.keys):
            on = on & out[k].eqNullSafe(F.col(f"_k{i}"))
        return out.join(last, on, "left_semi").drop("_run")

    def _saved(self, runs: list[str], leaves: DataFrame) -> DataFrame:
        """Records of the given leaves (leaf, run), each from the run that
        holds it. Only runs that hold one are read."""
        held = [r.run for r in leaves.select("run").distinct().collect()]  # at most one row per run
        parts = [self._load(runs[r], "records").withColumn("run", F.lit(r)) for r in sorted(held)]
        if not parts:
            return self._load(runs[0], "records").where("false")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.join(sized(leaves), ["leaf", "run"], "left_semi").drop("run")

    def run(self, current: DataFrame, process: Callable[[DataFrame], DataFrame]) -> str:
        """Finds the new, changed and removed records of current, writes
        process(new and changed ones) and publishes. Returns the run's name."""
        number, state = self.versions.latest()
        runs, depth = state.get("runs", []), state.get("depth")
        name, here = f"run-{number:06d}-{uuid.uuid4().hex[:8]}", len(runs)
        at = f"{self.root}/{name}"
        # current may not be the same twice: tree and records must come from one reading
        snapshot = staged(current.select(*self.keys, self.value), "snapshot")
        wanted = depth_for(snapshot.count(), self.leaf_rows)
        saved_tree, deepened = None, False
        if runs:
            saved_tree = self._load(runs[-1], "tree")
            if wanted > depth:
                every = self._saved(runs, saved_tree.where(F.col("level") == depth).select(F.col("node").alias("leaf"), "run"))
                saved = staged(keyed_records(every, self.keys, self.value, wanted), "deeper")
                saved_tree, depth, deepened = staged(build_tree(saved, wanted), "tree"), wanted, True
        else:
            depth = wanted
        records = keyed_records(snapshot, self.keys, self.value, depth)
        tree = staged(build_tree(records, depth), "tree")
        leaf_level = F.col("level") == depth
        if runs:
            leaves = staged(changed_leaves(tree, saved_tree, depth), "leaves")
            if not deepened:
                holders = saved_tree.where(leaf_level).select(F.col("node").alias("leaf"), "run")
                saved = self._saved(runs, holders.join(sized(leaves), "leaf", "left_semi"))
            changes = changed_records(records, saved, leaves, self.keys, self.value)
        else:
            changes = records.select(*self.keys, self.value, F.lit("new").alias("change"))
        if not runs or deepened:
            kept, pointers = records, tree.withColumn("run", F.lit(here))
        else:
            kept = records.join(sized(leaves), "leaf", "left_semi")
            before = saved_tree.where(leaf_level).select("level", "node", F.col("run").alias("before"))
            fresh = leaves.select(F.lit(depth).alias("level"), F.col("leaf").alias("node"), F.lit(here).alias("fresh"))
            pointers = tree.join(before, ["level", "node"], "left").join(fresh, ["level", "node"], "left").select(*tree.columns, F.coalesce("fresh", "before", F.lit(here)).alias("run"))
        staged(kept.sortWithinPartitions("leaf"), "records", f"{at}/records")
        staged(pointers, "tree", f"{at}/tree")
        changes = staged(changes, "changes", f"{at}/changes")
        staged(process(changes.where("change <> 'removed'")), "output", f"{at}/output")
        self.versions.publish(number + 1, {"runs": [*runs, name], "depth": depth})
        return name
