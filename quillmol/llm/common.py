"""Tables in the shared folder, ranks without hot windows, and small helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranks are first made in buckets: so many at least, and one more for every ROWS_A_BUCKET rows.
RANK_BUCKETS = 2048
ROWS_A_BUCKET = 1 << 20

_written: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where it is unset and all tasks run in this machine's JVM, as in tests, a
    temporary one; on a cluster, whose executors don't share such a folder, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillmol-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stash(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage.
    The files go when the session's process ends, or earlier by discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillmol-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes stashed tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df._stashed_at)
        _written[:] = [x for x in _written if x[1] != df._stashed_at]
    if frames:
        free_shuffles(frames[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished steps stay on the executors' disks until the driver collects its garbage: this asks for it."""
    spark.sparkContext._jvm.System.gc()


def held() -> set[str]:
    """The paths of all stashed tables that are there."""
    return {path for _, path in _written}


def discard_since(spark: SparkSession, before: set[str], *but: DataFrame) -> None:
    """Deletes what was stashed after held() gave before, except the frames but."""
    kept = before | {df._stashed_at for df in but}
    for path in held() - kept:
        _delete(spark, path)
    _written[:] = [x for x in _written if x[1] in kept]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended before
            return


def counted(df: DataFrame, copies: str = "copies") -> DataFrame:
    """Each distinct row once, and how many there are: equal rows, however many, are summed before the shuffle."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(copies))


def gapless(df: DataFrame, group: list[str], order: list[str], rank: str, size: Column, rows: int, total: str | None = None) -> DataFrame:
    """Adds rank, the sum of size over the rows before in the group (with size 1: 0, 1, 2, ...), and with total the group's
    whole sum. No two rows of a group may be alike in order (see counted()); rows: about how many there are.

    A window over a hot group would put it in one task. Rows are dealt by a hash of the order columns to buckets, whose number
    grows with the rows; windows run within (bucket, group), and the offsets of a group's buckets, at most buckets rows a group,
    are joined to the rows.
    """
    buckets = RANK_BUCKETS + rows // ROWS_A_BUCKET
    work = df.withColumn("_one", size.cast("long")).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sums = work.groupBy(*group, "_bucket").agg(F.sum("_one").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")))
    if total:
        offsets = offsets.withColumn(total, F.sum("_sum").over(Window.partitionBy(*group)))
    offsets = offsets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_bucket").alias("_b"), "_before", *([total] if total else []))
    within = Window.partitionBy("_bucket", *group).orderBy(*order)
    ranked = work.repartition("_bucket").withColumn("_within", F.coalesce(F.sum("_one").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    same = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = ranked.join(offsets, same, "left")
    return joined.withColumn(rank, F.col("_within") + F.col("_before")).drop("_one", "_bucket", "_within", "_before", "_b", *[f"_g{i}" for i in range(len(group))])


#: Copies of a row that one row of copied() makes at once.
COPIES = 1 << 16


def copied(df: DataFrame, copies: str, copy: str) -> DataFrame:
    """Each row as often as copies says, with copy 0, 1, ...; a row of very many copies is split first."""
    some = df.where(F.col(copies) <= COPIES).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)))
    runs = df.where(F.col(copies) > COPIES).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPIES)))).repartition("_run")
    last = F.least(F.col(copies), (F.col("_run") + 1) * COPIES) - 1
    many = runs.withColumn(copy, F.explode(F.sequence(F.col("_run") * COPIES, last))).drop("_run")
    return some.unionByName(many)
