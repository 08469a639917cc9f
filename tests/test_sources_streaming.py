"""Files, manifests, and streams that must end with what the batch gives."""

import json

import pytest
from pyspark.sql import functions as F

from spanwise.sources import files
from spanwise.streaming import events as stream


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"b": 1, "a": "x"}, indent=1))
    (tmp_path / "b.json").write_text("{no json")
    rows = files.read_json(spark, str(tmp_path), "a string, b long").collect()
    assert {(r.a, r.b) for r in rows} == {("x", 1), (None, None)} and any(r._corrupt for r in rows)
    files.write_json(spark.createDataFrame([(1, "x")], "b long, a string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":"x","b":1}'


@pytest.mark.parametrize("fmt", ["parquet", "orc", "csv", "json"])
def test_formats(spark, tmp_path, fmt):
    df = spark.range(5).select(F.col("id").alias("k"), (F.col("id") % 2).alias("part"))
    files.write_table(df, str(tmp_path / fmt), fmt, ["part"])
    back = spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt))
    assert sorted(int(r.k) for r in back.collect()) == list(range(5))
    with pytest.raises(ValueError):
        files.write_table(df, str(tmp_path / "x"), "xml")


def test_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in "ab":
        (tmp_path / "d" / f"{n}.txt").write_text(n)
    found = files.scan_files(spark, str(tmp_path), "*.txt", checksums=True)
    sums = {r.name: r.checksum for r in found.collect()}
    manifest = spark.createDataFrame([("a.txt", sums["a.txt"]), ("b.txt", "0"), ("c.txt", None), ("e.txt", None), ("e.txt", None), (None, None)], "name string, checksum string")
    got = sorted((r.name or "", r.status) for r in files.check_manifest(manifest, found).collect())
    assert got == [("", "no_name"), ("a.txt", "ok"), ("b.txt", "checksum_mismatch"), ("c.txt", "missing_file"), ("e.txt", "duplicate"), ("e.txt", "duplicate")]
    with pytest.raises(Exception, match="checksum is missing"):
        files.require(manifest, ["checksum"]).collect()


@pytest.mark.parametrize("name", ["window", "session", "first"])
def test_streams_end_like_batches(spark, small, tmp_path, name):
    make = {
        "window": lambda df: stream.window_counts(df, ["event_type"], "ts", "1 day", late="400 days"),
        "session": lambda df: stream.sessions(df, ["user_id"], "ts", "6 hours", late="400 days"),
        "first": lambda df: stream.first_of_each(df, ["user_id", "event_type"], "ts", "400 days").select("user_id", "event_type"),
    }[name]
    batch = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(4).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = make(source).writeStream.format("memory").queryName(f"out_{name}").outputMode("append" if name == "first" else "complete" if name == "window" else "update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck"))
    query = query.outputMode("append" if name != "window" else "complete").start()
    query.awaitTermination(120)
    got = spark.table(f"out_{name}")
    want = make(batch)
    if name == "session":  # sessions that the watermark has not passed are still open
        assert got.exceptAll(want).count() == 0
    else:
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_histogram_of_a_batch(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet")
    assert stream.histogram(e, ["event_type"], "value").agg(F.sum("n")).first()[0] == e.where("true").count()
