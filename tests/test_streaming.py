import json
import os
from glob import glob

import pytest
from pyspark.sql import functions as F

from tests import wiki_stub
from wikiloom.sources import wiki
from wikiloom.streaming.ingest import hourly, ingest, newer_versions, start_ingest


def test_ingest_replaces_and_is_incremental(spark, tmp_path):
    source, sink, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "id long, title string, text string"
    run = lambda: start_ingest(spark, source, schema, sink, state).awaitTermination()
    spark.createDataFrame([(1, "A", "old text"), (2, "B", "kept text")], schema).coalesce(1).write.parquet(source)
    run()
    assert {r["content"] for r in spark.read.parquet(sink).collect()} == {"[A]\nold text", "[B]\nkept text"}
    spark.createDataFrame([(1, "A", "new text")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert sorted(r["content"] for r in spark.read.parquet(sink).collect()) == ["[A]\nnew text", "[B]\nkept text"]


def test_ingest_of_several_versions_in_a_batch(spark, tmp_path):
    source, sink, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "id long, title string, text string"
    for name, second in (("c", 1000), ("a", 3000), ("b", 2000)):
        rows = [(i, "P", f"{name} {k} of {i}") for k in range(2) for i in range(20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/made_{name}")
        (file,) = glob(f"{tmp_path}/made_{name}/*.parquet")
        os.makedirs(source, exist_ok=True)
        os.rename(file, f"{source}/{name}.parquet")
        os.utime(f"{source}/{name}.parquet", (1_700_000_000 + second,) * 2)
    start_ingest(spark, source, schema, sink, state).awaitTermination()
    assert sorted(r["content"] for r in spark.read.parquet(sink).collect()) == sorted(f"[P]\na 1 of {i}" for i in range(20))


def test_ingest_by_version(spark, tmp_path):
    source, sink, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    schema = "id long, title string, text string, v int"
    run = lambda: start_ingest(spark, source, schema, sink, state, version="v").awaitTermination()
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    got = lambda: sorted((r["id"], r["content"], r["v"]) for r in spark.read.parquet(sink).collect())
    add([(1, "A", "second", 2), (2, "B", "only", None)])
    add([(1, "A", "first", 1)])
    run()
    assert got() == [(1, "[A]\nsecond", 2), (2, "[B]\nonly", None)]
    add([(1, "A", "late first", 1), (2, "B", "next", 1)])
    run()
    assert got() == [(1, "[A]\nsecond", 2), (2, "[B]\nnext", 1)]
    add([(1, "A", "third", 3)])
    run()
    assert got() == [(1, "[A]\nthird", 3), (2, "[B]\nnext", 1)]


def test_hourly_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 0{h}:10:00", k, float(h)) for h in range(6) for k in ("a", "b")], "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    query = hourly(stream).writeStream.format("memory").queryName("hourly_out").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("hourly_out").collect())) == sorted(map(tuple, hourly(events).collect()))


def test_ingest_that_breaks_off_is_tried_again(spark, tmp_path):
    source, sink, state, log = (f"{tmp_path}/{n}" for n in ("in", "out", "state", "log"))
    schema = "id long, title string, text string"
    spark.createDataFrame([(i, "P", f"old {i}") for i in range(6)], schema).coalesce(1).write.parquet(source)
    start_ingest(spark, source, schema, sink, state, buckets=2, log=log).awaitTermination()
    spark.createDataFrame([(1, "P", "new 1")], schema).coalesce(1).write.mode("append").parquet(source)

    def breaks(chunks, number):
        raise RuntimeError("the model is down")

    with pytest.raises(Exception, match="the model is down"):
        start_ingest(spark, source, schema, sink, state, buckets=2, log=log, after=breaks).awaitTermination()
    start_ingest(spark, source, schema, sink, state, buckets=2, log=log).awaitTermination()
    assert sorted(r["content"] for r in spark.read.parquet(sink).collect()) == sorted(["[P]\nnew 1"] + [f"[P]\nold {i}" for i in (0, 2, 3, 4, 5)])
    assert len(glob(f"{sink}/bucket=*")) == 2 and not glob(f"{sink}-pending/*")
    noted = sorted((r["status"], r["items_processed"], r["items_failed"], r["error_message"] is not None) for r in spark.read.parquet(log).collect())
    assert noted == [("completed", 1, 0, False), ("completed", 6, 0, False), ("failed", 0, 1, True)]


def test_ingest_removes_emptied_pages(spark, tmp_path):
    """A page whose text becomes empty loses its chunks, alone in its bucket or beside another page."""
    source, sink, state, log = (f"{tmp_path}/{n}" for n in ("in", "out", "state", "log"))
    schema = "id long, title string, text string"
    run = lambda buckets: start_ingest(spark, source, schema, sink, state, buckets=buckets, log=log).awaitTermination()
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    got = lambda: sorted(r["content"] for r in spark.read.schema("id long, content string").parquet(sink).collect())
    add([(i, "P", f"text {i}") for i in range(4)])
    run(64)
    assert len(glob(f"{sink}/bucket=*")) == 4
    add([(1, "P", ""), (2, "P", None), (3, "P", "new 3")])
    run(64)
    assert got() == ["[P]\nnew 3", "[P]\ntext 0"] and len(glob(f"{sink}/bucket=*")) == 2
    add([(0, "P", ""), (3, "P", "  ")])
    run(64)
    assert got() == [] and not glob(f"{sink}/bucket=*") and not glob(f"{sink}-pending/*")
    one = f"{tmp_path}/one"
    start_ingest(spark, source, schema, one, f"{tmp_path}/s1", buckets=1).awaitTermination()
    add([(7, "P", "seven"), (8, "P", "eight")])
    start_ingest(spark, source, schema, one, f"{tmp_path}/s1", buckets=1).awaitTermination()
    add([(7, "P", "")])
    start_ingest(spark, source, schema, one, f"{tmp_path}/s1", buckets=1).awaitTermination()
    assert [r["content"] for r in spark.read.parquet(one).collect()] == ["[P]\neight"]
    assert sorted(r["items_processed"] for r in spark.read.parquet(log).collect()) == [2, 3, 4]


def changed(rows):
    with open(wiki_stub.CHANGES, "w") as f:
        json.dump(rows, f)


def test_wiki_is_followed(spark, tmp_path):
    """Each change is read once, over restarts too; a batch that fails is read again."""
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"

    def run(sink=None):
        stream = wiki.follow_wiki(spark, "tests.wiki_stub:changes", "tests.wiki_stub:newest", limit=3, tasks=3)
        writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
        (writer.foreachBatch(sink) if sink else writer.foreachBatch(lambda b, n: b.write.mode("append").parquet(out))).start().awaitTermination()

    got = lambda: sorted((int(r["external_id"]), r["html"], r["modified"]) for r in spark.read.parquet(out).collect())
    changed([])
    run()
    first = [[i, f"<p>{i}</p>", 100 + i // 2] for i in range(20)]
    changed(first)
    run()
    assert got() == sorted(map(tuple, first))
    run()
    second = [*first, [3, "<p>again</p>", 200], [50, "<p>new</p>", 201]]
    changed(second)

    def breaks(batch, number):
        batch.count()
        raise RuntimeError("the sink is down")

    with pytest.raises(Exception, match="the sink is down"):
        run(breaks)
    changed([*second, [60, "<p>later</p>", 202]])
    run()
    run()
    assert got() == sorted(map(tuple, [*second, [60, "<p>later</p>", 202]]))


def test_wiki_to_chunks(spark, tmp_path):
    """Changes of a wiki become chunks; an older version that comes late changes nothing."""
    sink = f"{tmp_path}/sink"

    def run():
        stream = wiki.follow_wiki(spark, "tests.wiki_stub:changes", "tests.wiki_stub:newest")
        pages = stream.selectExpr("external_id id", "title", "html text", "modified version")
        ingest(newer_versions(pages), sink, f"{tmp_path}/state").awaitTermination()

    changed([[1, "<p>one</p>", 10], [2, "<p>two</p>", 11], [1, "<p>one, later</p>", 12]])
    run()
    got = lambda: sorted(r["content"] for r in spark.read.parquet(sink).collect())
    assert got() == ["[Page 1]\none, later", "[Page 2]\ntwo"]
    changed([[2, "", 20]])
    run()
    assert got() == ["[Page 1]\none, later"]


def test_versions_in_different_batches(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "id string, text string, version long"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = newer_versions(spark.readStream.schema(schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["id"], r["text"]) for r in spark.read.schema(schema).parquet(out).collect())

    assert run([("a", "a1", 1), ("a", "a3", 3), ("b", "b", None), (None, "x", 1)]) == [("a", "a3"), ("b", "b")]
    assert run([("a", "a2", 2), ("a", "a3 again", 3), ("b", "b again", None)]) == [("a", "a3"), ("b", "b")]
    assert run([("a", "a4", 4), ("b", "b0", 0), ("c", "c", 1)]) == [("a", "a3"), ("a", "a4"), ("b", "b"), ("b", "b0"), ("c", "c")]
