import datetime as dt

from corvane.streaming import history as h


def rows(spark, path):
    t = dt.datetime(2026, 1, 1)
    data = [(1, "a", t), (2, "b", t + dt.timedelta(minutes=7)), (1, "c", t + dt.timedelta(minutes=8))]
    df = spark.createDataFrame([(k, v, n, at) for n, (k, v, at) in enumerate(data)], "k int, v string, n int, at timestamp")
    df.write.parquet(path)
    return df


def test_streams_agree_with_batches(spark, tmp_path):
    df = rows(spark, str(tmp_path / "in"))
    stream = lambda: h.history_stream(spark, str(tmp_path / "in"), df.schema)
    h.append_history(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    h.append_history(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()  # nothing new: nothing twice
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    latest = {r["k"]: r["v"] for r in h.drained(h.latest_requests(stream(), "k", "v", "n"), "complete").collect()}
    assert latest == {1: "c", 2: "b"}
    counts = h.drained(h.windowed_counts(stream(), "at", "k"), "complete")
    assert sorted((r["k"], r["n"]) for r in counts.collect()) == [(1, 1), (1, 1), (2, 1)]
