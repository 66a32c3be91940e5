import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from mnesis.streaming.ingest import Conversation, ingest_batch, ingest_stream, upsert_sink

SCHEMA = "conversation_id string, message_id string, sent_at timestamp, us bigint, vec array<double>, boundary double"


def rows():
    rng = np.random.default_rng(2)
    base = dt.datetime(2026, 4, 2)
    out = []
    for i in range(120):
        t = base + dt.timedelta(minutes=i)
        us = int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
        out.append((f"c{i % 4}", f"m{i:03d}", t, us, [float(x) for x in rng.normal(size=4)] if i % 7 else None, float(rng.random()) if i % 5 else None))
    return out


def test_gate():
    c = Conversation()
    assert c.step(1, [1.0, 0.0], None) == ("NEW", 1)
    assert c.step(2, [1.0, 0.1], 0.1) == ("APPEND", 1)
    assert c.step(3, None, 0.5) == ("SLOW_PATH", 1)
    assert c.step(4, [0.0, 1.0], 0.9) == ("NEW", 2)
    assert c.step(5, [1.0, 0.0], 0.9) == ("REACTIVATE", 1)
    assert Conversation.unpack(c.pack()) == c


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA)
    want = sorted(map(tuple, ingest_batch(df).collect()))
    src = tmp_path / "in"
    for k, part in enumerate((df.where("us < %d" % rows()[60][3]), df.where("us >= %d" % rows()[60][3]))):
        part.coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = ingest_stream(stream).writeStream.foreachBatch(upsert_sink(str(tmp_path / "out"))).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).select("conversation_id", "message_id", "us", "decision", "episode_id")
    assert sorted(map(tuple, got.collect())) == want


def test_batch_skips_rows_without_key_and_empty(spark):
    df = spark.createDataFrame([(None, "m", None, 1, None, None), ("c", "n", None, None, None, None)], SCHEMA)
    assert ingest_batch(df).count() == 0
    assert ingest_batch(df.where(F.lit(False))).count() == 0
