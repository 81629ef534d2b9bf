import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parcelworks.streaming import events as E
from parcelworks.streaming import limiter

T0 = datetime(2024, 1, 1)


def run(spark, tmp_path, batches, schema, stream):
    """The stream's rows over batches, a micro-batch each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"file://{tmp_path}/in")
    query = stream(source).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.read.parquet(f"file://{tmp_path}/out").collect()


def test_lockout_stream_equals_batch_with_late_events(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    draw = random.Random(4)
    rows = [(draw.choice("abc"), i, T0 + timedelta(seconds=40 * i), draw.random() < 0.12) for i in range(120)]
    late = rows[:]
    for i in range(0, 115, 5):  # up to four places late
        late.insert(i + draw.randint(1, 4), late.pop(i))
    end = [("z", 999, T0 + timedelta(days=2), True)]  # moves the watermark past all others
    schema = "user string, id long, ts timestamp, ok boolean"
    got = run(spark, tmp_path, [late[:40], late[40:80], late[80:], end], schema, lambda s: E.lockout_stream(s, 3, 5))
    want = limiter.lockouts(spark.createDataFrame(rows, schema), 3, 5).collect()
    row = lambda r: (r.user, r.id, r.ts, r.ok, r.blocked, r.locked_until)
    assert sorted(map(row, got), key=lambda r: r[1]) == sorted(map(row, want), key=lambda r: r[1])
    assert any(r.blocked for r in got) and len(got) == 120


def test_subscription_stream_equals_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    draw = random.Random(9)
    kinds = ["checkout.session.completed", "customer.subscription.updated", "customer.subscription.deleted", "invoice.payment_failed"]
    bodies = []
    for i in range(60):
        thing = {"customer": f"c{draw.randrange(5)}", "status": draw.choice(["active", "trialing", "canceled", "unpaid", "past_due"]), "metadata": {"tier": draw.choice(["pro", "team", ""])}}
        bodies.append((json.dumps({"id": f"e{i:03d}", "type": draw.choice(kinds), "created": 1_700_000_000 + 60 * i, "data": {"object": thing}}),))
    end = [(json.dumps({"id": "end", "type": kinds[0], "created": 1_800_000_000, "data": {"object": {"client_reference_id": "end"}}}),)]
    odd = [("no json",), (None,), ('{"type": "x", "created": 1}',), ('{"data": {"object": {"customer": "c1"}}}',)]
    shuffled = bodies[:]
    for i in range(0, 55, 5):
        shuffled.insert(i + draw.randint(1, 4), shuffled.pop(i))
    got = run(spark, tmp_path, [shuffled[:30] + odd, shuffled[30:], end], "body string", E.tier_stream)
    parsed = E.parsed_events(spark.createDataFrame(bodies + odd, "body string"))
    batch = limiter.subscription_tiers(parsed.select("user", F.col("ts").alias("at"), "id", "type", "status", "tier"))
    want = {r.user: r.tier for r in batch.collect()}
    last = {}
    for r in sorted(got, key=lambda r: (r.ts, r.id)):
        last[r.user] = r.tier
    assert {u: last.get(u, "free") for u in want} == want and len(set(want.values())) > 1
    assert parsed.count() == 60
