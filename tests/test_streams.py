"""Streams that run: a log with rotation, truncation and half lines, and timers of event time."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from notelattice.sources import log
from notelattice.streaming import events


class Tail:
    """A running stream of a log, and the lines that it has forwarded since the last look."""

    def __init__(self, spark, path, checkpoint, **options):
        self.lines = []
        self.query = (
            log.follow(spark, str(path), **options)
            .writeStream.foreachBatch(lambda df, _: self.lines.extend(r["line"] for r in df.orderBy("at").collect()))
            .option("checkpointLocation", str(checkpoint))
            .trigger(processingTime="100 milliseconds")
            .start()
        )

    def new(self):
        self.query.processAllAvailable()
        out, self.lines = self.lines[:], []
        return out


def test_a_log_is_followed(spark, tmp_path):
    at = tmp_path / "logs" / "one" / "sync.log"
    at.parent.mkdir(parents=True)
    at.write_text("old line\nold half")
    tail = Tail(spark, tmp_path / "logs", tmp_path / "check", maxBytes="64")
    try:
        assert tail.new() == []
        with at.open("a") as f:
            f.write(" done\nfirst\n\nsecond\r\nhal")
        assert tail.new() == ["old half done", "first", "second"]
        with at.open("a") as f:
            f.write("f\n")
        assert tail.new() == ["half"]
        with at.open("a") as f:  # more than is forwarded at once: the end, from a whole line on
            f.write("".join(f"line {i:04}\n" for i in range(100)))
        assert tail.new() == [f"line {i:04}" for i in range(94, 100)]
        at.write_text("short\n")  # truncated
        assert tail.new() == ["short"]
        at.rename(at.with_name("sync.log.1"))  # rotated
        assert tail.new() == []
        at.write_text("a new file, which is longer\n")
        assert tail.new() == ["a new file, which is longer"]
        later = tmp_path / "logs" / "two" / "sync.log"
        later.parent.mkdir()
        later.write_text("of a newer folder\n")
        os.utime(later, ns=(at.stat().st_mtime_ns + 10**9,) * 2)
        assert tail.new() == ["of a newer folder"]
    finally:
        tail.query.stop()
    with later.open("a") as f:
        f.write("while it was down\n")
    tail = Tail(spark, tmp_path / "logs", tmp_path / "check", maxBytes="64")
    try:
        assert tail.new() == ["while it was down"]
    finally:
        tail.query.stop()


def test_positions_of_lines(tmp_path):
    at = tmp_path / "sync.log"
    at.write_bytes(b"one\n\xfftwo\n" + b"x" * 300_000)
    reader = log.LogReader({"path": str(tmp_path), "from": "start"})
    end = reader.latestOffset()
    assert end["at"] == 9 and reader.initialOffset()["at"] == 0
    (span,) = reader.partitions(reader.initialOffset(), end)
    assert list(reader.read(span)) == [(str(at), 0, "one"), (str(at), 4, "�two")]
    assert reader.partitions(end, end) == [] and log.last_line_end(str(at), 3) == 0
    at.unlink()
    assert list(reader.read(span)) == [] and reader.latestOffset()["path"] == ""
    assert log.newest(str(tmp_path / "nowhere")) is None


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def test_silences_by_timer(spark, rocks, tmp_path):
    """Timers fire while a vault is silent; in the end the stream has told of what the batch form finds,
    and of the silences that still last."""
    begin = datetime(2024, 1, 1)
    log_of = lambda *rows: [(v, begin + timedelta(seconds=s)) for v, s in rows]
    batches = [log_of(("a", 0), ("a", 5), ("b", 0)), log_of(("b", 30), ("b", 31)), log_of(("a", 60), ("b", 65)), log_of(("b", 70), ("b", 100), ("c", 100))]
    source, told = tmp_path / "in", []
    source.mkdir()
    rows = spark.readStream.schema("vault string, ts timestamp").parquet(str(source))
    query = (
        events.silence_stream(rows, 10)
        .writeStream.foreachBatch(lambda df, _: told.append({(r["vault"], (r["since"] - begin).total_seconds()) for r in df.collect()}))
        .option("checkpointLocation", str(tmp_path / "check"))
        .start()
    )
    seen = []
    try:
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, "vault string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
            (part,) = (tmp_path / f"part{i}").glob("part-*.parquet")
            part.rename(source / f"{i}.parquet")
            query.processAllAvailable()
            seen.append(set().union(*told))
    finally:
        query.stop()
    assert ("a", 5.0) in seen[1]  # by its timer: vault a said nothing in this batch
    every = spark.createDataFrame([r for b in batches for r in b], "vault string, ts timestamp")
    closed = {(r["vault"], (r["since"] - begin).total_seconds()) for r in events.silences(every, 10).collect()}
    assert closed == {("a", 5.0), ("b", 0.0), ("b", 31.0), ("b", 70.0)}
    open_ = {("a", 60.0)}  # nothing came after, and event time has gone on
    assert seen[-1] == closed | open_ and sum(map(len, told)) == len(seen[-1])
    assert every.select(F.max("ts")).first()[0] == begin + timedelta(seconds=100)
