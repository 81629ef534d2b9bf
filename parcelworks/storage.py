"""Tables that cut a plan's lineage, in the folder that driver and executors share, and joins whose small side is counted first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many bytes may be broadcast; beyond it a shuffle does the work.
BROADCAST_BYTES = 8 << 20
#: Rows of a task where a step holds all of its rows.
TASK_ROWS = 250_000
#: What a column of a row takes in memory at least, by which stored() judges a table.
COLUMN_BYTES = 8


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a session on one machine gets one in its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.checkpoints"
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, what: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: the lineage ends at files that outlive executors.

    Spark would judge the table by its files, which may hold millions of alike rows in a few MB, and gather it in the driver to
    broadcast it.  So a table whose counted rows pass the bound is marked for joins by shuffle; broadcast_if_small on the other
    side comes before that mark.
    """
    path = shared_dir(frame.sparkSession, what)
    frame.write.parquet(path)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    return out.hint("merge") if out.count() * COLUMN_BYTES * len(out.columns) > BROADCAST_BYTES else out


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks rows are dealt to so that one's share doesn't grow with them: at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def broadcast_if_small(frame: DataFrame, row_bytes: int, bound: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored frame for broadcast if its counted rows fit the bound; else the join shuffles, whatever the size of its files."""
    return F.broadcast(frame) if frame.count() * row_bytes <= bound else frame.hint("merge")
