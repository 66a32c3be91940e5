from mnesis import shared


def test_release_deletes_what_was_written(spark, monkeypatch):
    monkeypatch.setattr(shared, "_made", [])  # tables of other tests stay
    df = shared.materialise(spark.range(5), "numbers")
    path = spark._jvm.org.apache.hadoop.fs.Path(shared._made[0])
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    assert df.count() == 5 and fs.exists(path)
    shared.release(spark)
    assert not fs.exists(path) and shared._made == []
