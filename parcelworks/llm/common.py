"""Helpers shared by the corpus operators: words, shared folders, checked broadcasts."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that are no part of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing.
_BREAKS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TO_SPACE = bytes.maketrans(_BREAKS, b" " * len(_BREAKS))

#: Rows handed to Python at once; with texts of a few KB a batch stays at a MB or two.
ARROW_ROWS = 500
ARROW_BYTES = 2 << 20

#: Bytes of a row group of stored tables: what a writer holds, and the most that a reader's batch of long rows takes.
ROW_GROUP = 16 << 20

#: A table of at most so many bytes may be broadcast or collected; beyond it a shuffle does the work.
BROADCAST_BYTES = 8 << 20


def alnum_words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_TO_SPACE).split() if text else []


def space_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8 (bytes.split() splits at just these six); null has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def tidy() -> None:
    """Give what the last batch has freed back to the system: Python workers live on between tasks and keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small: ARROW_BYTES, and ARROW_ROWS unless the session already asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{ARROW_BYTES}b")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a session on one machine gets a folder in its warehouse; a cluster's must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, what: str, files: int | None = None) -> DataFrame:
    """Write the frame to the shared folder and read it back: the lineage ends at files that outlive executors.

    files: at most so many, for tables whose counted source is small.
    """
    path = shared_dir(frame.sparkSession, what)
    (frame if files is None else frame.coalesce(files)).write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables that stored() made, once nothing is left that would be computed from them again."""
    for frame in frames:
        spark, files = frame.sparkSession, frame.inputFiles()
        if files:
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(frame: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored frame for broadcast if its counted rows fit the bound; else leave the join to a shuffle."""
    return F.broadcast(frame) if frame.count() * row_bytes <= bound else frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsigned_crc_fold(doc_id: str = "doc_id", folds: int = 5):
    """crc32 of the id's text modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds
