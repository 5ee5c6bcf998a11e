"""Streams: state that shrinks, batches that run again, restarts from a stream's own checkpoint."""

import os

import pytest
from pyspark.sql import functions as F

from bytebasin.streaming import streams


def parts(spark, folder, rows, schema):
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))


def run(stream, tmp_path, name="out", **how):
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True)
    query = writer.foreachBatch(how["each"]).start() if how else writer.format("parquet").option("path", str(tmp_path / name)).start()
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_names_are_forgotten_behind_the_watermark(spark, tmp_path):
    day = 86_400
    schema = "name string, ts long"
    rows = [[("a", 0), ("b", 5), ("a", 3)], [("a", 10), ("c", day * 10)], [("d", day * 20)], [("a", day * 30), ("e", day * 40)], [("f", day * 50)]]
    parts(spark, tmp_path / "in", rows, schema)
    stream = streams.table_stream(spark, str(tmp_path / "in"), 1).withColumn("ts", F.timestamp_seconds("ts"))
    held = run(streams.unique_names(stream, ("ts", "1 day")), tmp_path)
    names = sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert names == ["a", "a", "b", "c", "d", "e", "f"]  # the last a comes long after the first was forgotten
    assert max(held) <= 4 and held[-1] < sum(map(len, rows))


def test_restart_goes_on_where_the_stream_was(spark, tmp_path):
    schema = "name string, ts long"
    parts(spark, tmp_path / "in", [[("a", 1), ("b", 2)]], schema)
    stream = lambda: streams.unique_names(streams.table_stream(spark, str(tmp_path / "in"), 1).withColumn("ts", F.timestamp_seconds("ts")), ("ts", "1 day"))
    run(stream(), tmp_path)
    parts(spark, tmp_path / "in", [[("b", 3), ("c", 4)], [("a", 5)]], schema)
    run(stream(), tmp_path)
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_packing_reads_one_mark_and_runs_again(spark, tmp_path):
    folder = str(tmp_path / "packed")
    write = streams.packer(folder, 3)
    batches = [spark.createDataFrame([(f"{b}-{i}",) for i in range(n)], "name string") for b, n in enumerate((4, 0, 5, 2, 7))]
    for b, df in enumerate(batches):
        write(df, b)
        marks = [m for m in os.listdir(tmp_path / "packed/_next") if m.isdigit()]
        assert len(marks) <= 2 and str(b) in marks
    first = {r["name"]: (r.idx, r.shard) for r in streams.packed_rows(spark, folder).collect()}
    assert sorted(i for i, _ in first.values()) == list(range(18)) and all(s == i // 3 for i, s in first.values())
    write(batches[4], 4)  # the last batch once more, as after a failure
    assert {r["name"]: (r.idx, r.shard) for r in streams.packed_rows(spark, folder).collect()} == first


def test_packing_in_a_stream(spark, tmp_path):
    parts(spark, tmp_path / "in", [[(f"{k}-{i}",) for i in range(5)] for k in range(3)], "name string")
    run(streams.table_stream(spark, str(tmp_path / "in"), 1), tmp_path, each=streams.packer(str(tmp_path / "packed"), 4))
    parts(spark, tmp_path / "in", [[(f"3-{i}",) for i in range(5)]], "name string")
    run(streams.table_stream(spark, str(tmp_path / "in"), 1), tmp_path, each=streams.packer(str(tmp_path / "packed"), 4))
    rows = streams.packed_rows(spark, str(tmp_path / "packed")).collect()
    assert sorted(r.idx for r in rows) == list(range(20)) and len({r["name"] for r in rows}) == 20


@pytest.mark.parametrize("expires", [None, ("ts", "10 seconds", 100)])
def test_early_stops_and_their_state(spark, tmp_path, expires):
    """Runs of ten: each is over before the next begins, and so is its state where it expires."""
    schema = "run long, step long, value double, ts long"
    rows = [[(run_, s, float(s if s < 3 else 0), 1000 * run_ + s) for s in range(1, 9)] for run_ in range(1, 6)]
    parts(spark, tmp_path / "in", [p[k:k + 4] for p in rows for k in (0, 4)] + [[(9, 1, 0.0, 20_000)], [(9, 2, 0.0, 20_001)]], schema)
    stream = streams.table_stream(spark, str(tmp_path / "in"), 1).withColumn("ts", F.timestamp_seconds("ts"))
    held = run(streams.early_stops(stream, 2, expires=expires), tmp_path)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(r, 5) for r in range(1, 6)]
    assert held[-1] == 6 if expires is None else held[-1] < 6


def test_batches_do_not_grow_with_files(spark, tmp_path):
    from bytebasin.plans import stream_queries as sq

    for i in range(101):
        path = tmp_path / "in" / str(i % 2) / f"{i}.bin"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"%d" % (i // 2))
    folder = str(tmp_path / "in")
    found = streams.fingerprinted(streams.blob_stream(spark, folder, "*.bin", sq._files_a_batch(spark, folder, "*.bin")))
    seen = []
    run(streams.unique_names(found, ("modificationTime", "1 day")), tmp_path, each=lambda batch, k: seen.append((k, batch.count())))
    assert len({k for k, n in seen if n}) <= sq.PARTS and sum(n for _, n in seen) == 51


def test_appended_rows_are_made_by_all_tasks(spark, tmp_path):
    from bytebasin.plans import stream_queries as sq

    sq._append(spark.range(0, 100, 1, 4).withColumn("made_in", F.spark_partition_id()), str(tmp_path / "in"), "id")
    made = spark.read.parquet(str(tmp_path / "in"))
    assert {r[0] for r in made.select("made_in").distinct().collect()} == {0, 1, 2, 3} and made.count() == 100
    assert len(list((tmp_path / "in").glob("*.parquet"))) == sq.PARTS
