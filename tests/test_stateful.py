"""Streams with state against their batch operators, on shuffled, repeated and late events."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import index, review
from quillspark.streaming import stateful

START = datetime.datetime(2026, 1, 1, 12)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    stateful.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, folder, batches, schema):
    """A stream that reads one file of rows in each micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        for f in (folder / "in").glob("part-*"):
            f.rename(folder / "in" / f"{k:03d}.parquet")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def drained(stream, folder, mode):
    """(batch number, row) of all output."""
    out = []
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(folder / "check")).foreachBatch(lambda b, n: out.extend((n, tuple(r)) for r in b.collect()))
    assert query.trigger(availableNow=True).start().awaitTermination(120)
    return out


def test_debounce_agrees_with_the_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "session string, at timestamp, query string"
    events = [(rng.choice("ab"), START + datetime.timedelta(milliseconds=rng.randrange(20_000)), f"q{k}") for k in range(120)]
    events = sorted(events, key=lambda e: e[1])
    # order within two seconds is lost, some events come twice
    order = sorted(events + rng.sample(events, 20), key=lambda e: e[1] + datetime.timedelta(milliseconds=rng.randrange(2000)))
    ends = [("end", START + datetime.timedelta(seconds=100 + k), "end") for k in range(2)]
    batches = [order[k : k + 35] for k in range(0, len(order), 35)] + [[e] for e in ends]
    out = drained(stateful.settled(streamed(spark, tmp_path, batches, schema), 120, "5 seconds"), tmp_path, "append")
    want = review.settled(spark.createDataFrame(events, schema), 120).collect()
    assert len(want) > 50
    assert sorted(r for _, r in out if r[0] != "end") == sorted(tuple(r) for r in want)


def test_unread_counts_with_corrections(spark, tmp_path):
    rng = random.Random(5)
    schema = "space string, id long, at timestamp, is_read boolean"
    rows = [(rng.choice("xy"), rng.randrange(12), START + datetime.timedelta(seconds=rng.randrange(40)), rng.random() < 0.5) for _ in range(90)]
    batches = [rows[k : k + 30] for k in range(0, 90, 30)] + [rows[:10]]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # lifetimes would keep the query running
    try:
        out = drained(stateful.unread_counts(streamed(spark, tmp_path, batches, schema)), tmp_path, "update")
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    last = {r[0]: r[1] for _, r in sorted(out)}
    want = {r["space"]: r["unread"] for r in stateful.unread_now(spark.createDataFrame(rows, schema)).collect()}
    assert last == want and sum(want.values()) > 3


def test_readiness_runs_out(spark, tmp_path):
    schema = "agent string, checked_at timestamp, ready boolean"
    at = lambda s: START + datetime.timedelta(seconds=s)
    batches = [[("a", at(0), True), ("b", at(0), True)], [("b", at(20), False), ("b", at(5), True)], [("c", at(60), True)], [("c", at(62), True)]]
    out = drained(stateful.readiness(streamed(spark, tmp_path, batches, schema), 30, "1 second"), tmp_path, "update")
    told = {}
    for _, (agent, state) in sorted(out, key=lambda x: x[0]):
        told.setdefault(agent, []).append(state)
    assert told["a"] == ["ready", "unknown"] and told["b"] == ["ready", "not ready", "unknown"] and told["c"] == ["ready", "ready"]
    now = review.ready(spark.createDataFrame([r for b in batches for r in b], schema), F.lit(at(62))).collect()
    assert [(r["agent"], r["ready"]) for r in now] == [("c", True)]


def test_a_stream_of_pages_is_taken_in_once(spark, tmp_path):
    schema = "space_id string, path string, title string, body string, modified_ns long"
    batches = [[("s", "a.md", "A", "alpha", 1), ("s", "b.md", "B", "beta", 1)], [("s", "a.md", "A", "gamma", 2)]]
    stream = streamed(spark, tmp_path, batches, schema)
    kept = index.SearchIndex(spark, str(tmp_path / "index"))
    stateful.index_stream(stream, kept, "pages", str(tmp_path / "check")).awaitTermination(300)
    assert kept.facts()["version"] == 2 and [r["path"] for r in kept.search("gamma").collect()] == ["a.md"] and kept.search("alpha").count() == 0
    # a stream which lost its checkpoint runs the same batches again
    stateful.index_stream(stream, kept, "pages", str(tmp_path / "again")).awaitTermination(300)
    assert kept.facts()["version"] == 2 and kept.facts()["n_docs"] == 2
