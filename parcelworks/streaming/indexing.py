"""Indexes that follow streams of files: cabinets rebuilt where their listing is newer, rows merged by key, a log that only grows.

Each micro-batch rewrites the partitions that it changes and no others, and gives the same files when it is run again, so a batch
that is replayed after a failure does no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelworks.functions.deeds import cabinet_files
from parcelworks.storage import stored

LISTING = "cabinet string, indexed_at timestamp, file string, path string"
#: Partitions that a merged table's keys are dealt to; a batch rewrites those that its keys fall in.
BUCKETS = 64


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path; null if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _rewrite(rows: DataFrame, path: str, partition: str) -> None:
    """Overwrites just the partitions that rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def rebuild_stale(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over listings (LISTING): each a whole cabinet at a time, of which a batch may hold several.

    A cabinet's newest listing replaces its part of the index at path if it is newer than that; older and repeated listings change nothing.
    An empty listing can't be told from none, so a cabinet that was emptied keeps its last files until one comes.
    """

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy("cabinet").agg(F.max("indexed_at").alias("indexed_at"))
        index = _read(spark, path)
        if index is not None:
            built = index.groupBy("cabinet").agg(F.max("indexed_at").alias("__at"))
            newest = newest.join(built, "cabinet", "left").filter(F.col("__at").isNull() | (F.col("indexed_at") > F.col("__at"))).drop("__at")
        stamps = newest.select("cabinet", "indexed_at")
        rows = stored(batch.join(stamps, ["cabinet", "indexed_at"]).distinct(), "stale-cabinets")
        if not rows.isEmpty():
            files = cabinet_files(rows.select("cabinet", "file", "path")).join(rows.groupBy("cabinet").agg(F.max("indexed_at").alias("indexed_at")), "cabinet")
            _rewrite(files.select("file", "path", "display", "name_norm", "file_norm", "doc_number", "indexed_at", "cabinet"), path, "cabinet")

    return run


def merge_by_key(path: str, key: str, seq: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: of each key's rows the one with the highest seq stays in the table at path; rows without a key are left out.

    Keys are dealt to buckets, which are the table's partitions; only those that a batch touches are read and rewritten.
    """

    def run(batch: DataFrame, _: int) -> None:
        columns = [c for c in batch.columns if c != "bucket"]
        rows = batch.filter(F.col(key).isNotNull()).select(*columns).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        old = _read(batch.sparkSession, path)
        if old is not None:
            touched = rows.select("bucket").distinct()  # at most `buckets` rows
            rows = rows.unionByName(old.join(F.broadcast(touched), "bucket", "left_semi").select(*columns, "bucket"))
        whole = F.struct(*columns)
        best = stored(rows.groupBy("bucket", key).agg(F.max_by(whole, F.struct(F.col(seq), whole)).alias("__v")).select("__v.*", "bucket"), "merged")
        if not best.isEmpty():
            _rewrite(best, path, "bucket")

    return run


def follow(source: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a stream through foreachBatch over what is there now."""
    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(source: DataFrame, path: str, checkpoint: str, time: str = "ts") -> StreamingQuery:
    """Appends a stream's rows to a log by day; every row comes in once, whatever is started again.  Rows without a time go to the day `none`."""
    rows = source.withColumn("day", F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit("none")))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").trigger(availableNow=True).start()
