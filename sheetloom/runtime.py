"""Session, shared folder and size-checked planning helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes below which a side may be broadcast after it has been counted.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20


def local_session(app: str = "sheetloom", cpus: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster
    sets it, otherwise (local tests) a temporary one that is set here. On a
    cluster without that setting there is no such folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sheetloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when it ends."""
    path = os.path.join(shared_dir(spark), "sheetloom", spark.sparkContext.applicationId)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def staged(df: DataFrame, name: str, at: str | None = None) -> DataFrame:
    """Cuts the lineage: writes df as a table of the shared folder, reads it
    back. Survives the loss of any executor."""
    spark = df.sparkSession
    path = at or os.path.join(scratch_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for df, but only if it was counted and holds at most
    ``rows`` rows of ``size`` bytes altogether; larger sides stay with a
    shuffled (skew-split) join."""
    nested = [F.length(F.to_json(F.struct(f.name))) for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    wide = [F.octet_length(f.name) for f in df.schema if f.dataType.typeName() in ("string", "binary")] + nested
    each = reduce(lambda a, b: a + b, [F.coalesce(w, F.lit(0)) for w in wide], F.lit(16 * len(df.columns)))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(each.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def numbered(df: DataFrame, key: str, order: str, name: str, block: int = 1 << 16) -> DataFrame:
    """df with the place of each row within its key (from 1) in the order of a
    whole number. A key's rows are numbered in blocks of that number, which are
    shifted by the counts of the blocks before, so no task sees a whole key."""
    blocked = df.withColumn("_block", F.expr(f"`{order}` div {block}"))
    counts = blocked.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), F.coalesce(before, F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy(key, "_block").orderBy(order))
    met = F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of"))
    out = blocked.withColumn("_place", place).join(sized(shifts), met)
    return out.select(*df.columns, (F.col("_place") + F.col("_shift")).cast("int").alias(name))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan gives fewer partitions than there are
    (a table of one file has one row group to read), else df as it is. Only for
    input tables in front of work that costs far more than moving the rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes of the same columns."""
    return F.xxhash64(F.lit(0x51), *cols), F.xxhash64(F.lit(0xA7), *cols)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
