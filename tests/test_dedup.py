from pyspark.sql import functions as F

from mnesis.operators.dedup import MessageStore, canonical_id, dropped_copies

SCHEMA = "delivery_id bigint, message_id string, channel string, received_at timestamp, content string, bucket int, k1 string, rank string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, 1, "k", "r") for r in rows], SCHEMA)


def dropped(spark, rows):
    return sorted(r.delivery_id for r in dropped_copies(frame(spark, rows)).collect())


def test_spellings(spark):
    rows = [("<AbC@x.y> ",), ("\tabc@X.Y",), ("''",), (None,), ("​abc@x.y",)]
    got = [r[0] for r in spark.createDataFrame(rows, "i string").select(canonical_id("i")).collect()]
    assert got == ["abc@x.y", "abc@x.y", None, None, "abc@x.y"]


def test_latest_stays_then_largest_delivery(spark, at):
    rows = [(1, "m", "sms", at(8)), (2, "<M>", " SMS", at(9)), (3, "m\t", "Sms", at(9)), (4, "m", "email", at(7)), (5, "m", "email", None), (6, "n", None, at(8)), (7, "N", None, at(8))]
    assert dropped(spark, rows) == [1, 2, 5, 6]


def test_rows_without_identifier_are_no_copies(spark, at):
    assert dropped(spark, [(1, None, "sms", at(8)), (2, None, "sms", at(8)), (3, " ", "sms", at(8)), (4, "<>", "sms", at(8))]) == []


def test_empty(spark):
    assert dropped(spark, []) == []


def test_upsert_is_idempotent_and_compaction_merges_batches(spark, at):
    a = frame(spark, [(1, "m", "sms", at(8)), (2, "x", "sms", at(8))])
    b = frame(spark, [(3, "M", "sms", at(10)), (4, "y", "sms", at(8))])
    store = MessageStore(spark, buckets=3)
    for batch, name in ((a, "1"), (b, "2"), (a, "1"), (b, "2")):
        store.upsert(batch, name)
    want = [2, 3, 4]
    assert sorted(r.delivery_id for r in store.read().collect()) == want and len(store.runs) == 2
    store.compact()
    assert sorted(r.delivery_id for r in store.read().collect()) == want and len(store.runs) == 1
    store.upsert(a, "1")
    assert sorted(r.delivery_id for r in store.read().collect()) == want
    again = MessageStore(spark, store.path)  # a store opened at its path knows its runs
    assert again.buckets == 3 and again.runs == store.runs and sorted(r.delivery_id for r in again.read().collect()) == want
    again.upsert(b, "2")
    again.compact()
    assert sorted(r.delivery_id for r in MessageStore(spark, store.path).read().collect()) == want
    assert "Exchange" not in again._collapse(again._rows())._jdf.queryExecution().executedPlan().toString()


def test_copies_in_several_batches(spark, at):
    rows = [(i, f"m{i % 7}", "sms", at(8)) for i in range(40)]
    batches = frame(spark, rows).withColumn("batch_id", F.expr("case when delivery_id % 5 < 4 then concat('b', delivery_id % 5) end"))
    assert sorted(r.delivery_id for r in dropped_copies(batches).collect()) == list(range(33))
