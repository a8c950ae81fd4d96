"""Streams over files, run to completion, against their batch twins."""

import datetime as dt

from strandline.streaming import jobs


def drain(df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_running_counts(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "word string").write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("word string").parquet(str(tmp_path / "w"))
    assert set(drain(jobs.running_counts(stream), "counts", "complete")) == {("a", 2), ("b", 1)}


def test_polite_stream_keeps_its_clock(spark, tmp_path):
    t0 = dt.datetime(2022, 1, 1)
    schema = "host string, ts timestamp"
    folder = str(tmp_path / "h")
    spark.createDataFrame([("h", t0 + dt.timedelta(seconds=s)) for s in (0, 4, 10, 15, 21)], schema).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    got = sorted(drain(jobs.polite(stream, 10), "polite", "append"), key=lambda r: r[1])
    assert [r[2] for r in got] == [True, False, True, False, True]


def test_windowed_counts_and_sessions(spark, tmp_path):
    t0 = dt.datetime(2022, 1, 1)
    schema = "worker string, ts timestamp"
    folder = str(tmp_path / "e")
    times = [0, 5, 12, 60, 7200]
    spark.createDataFrame([("w", t0 + dt.timedelta(seconds=s)) for s in times], schema).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    assert [r[2] for r in drain(jobs.windowed_counts(stream, "worker"), "wins", "append")] == [4]
    lives = drain(jobs.worker_sessions(stream), "lives", "append")
    assert sorted(r[3] for r in lives) == [1, 3]
