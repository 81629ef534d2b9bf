from datetime import datetime, timedelta

import pytest

from parcelworks.streaming import limiter


def test_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    t0 = datetime(2024, 1, 1)
    rows = [("a" if i % 3 else "b", i, t0 + timedelta(seconds=7 * i)) for i in range(40)]
    kind = "key string, id long, ts timestamp"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for n in range(4):  # four files, one a micro-batch
        spark.createDataFrame(rows[10 * n : 10 * n + 10], kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = limiter.limited_stream(stream, 3, 60.0)
    run = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    assert run.awaitTermination(180)
    want = {r.id: r.allowed for r in limiter.limited(spark.createDataFrame(rows, kind), 3, 60.0).collect()}
    got = {r.id: r.allowed for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == want and not all(want.values())
