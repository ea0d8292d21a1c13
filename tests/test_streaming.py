"""The streaming operators over a stream that is read to its end, against the same operators over the table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tripleflow.streaming import events as ev

SCHEMA = "event_id long, ts timestamp, user_id long, kind string, value double"
ROWS = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), i % 3, "ab"[i // 4 % 2], float(i)) for i in range(60)]


def source(spark, tmp_path):
    table = spark.createDataFrame(ROWS, SCHEMA)
    table.write.parquet(f"file://{tmp_path}/in")
    return table, spark.readStream.schema(SCHEMA).parquet(f"file://{tmp_path}/in")


def plain_changes(rows):
    want, last = set(), {}
    for i, t, user, kind, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if user not in last or last[user] != kind:
            want.add(i)
        last[user] = kind
    return want


def all_changes(spark, rows, tmp_path, files, late):
    """The rows as a stream of ``files`` files, one a trigger, in batches of 4 rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    for k in range(files):
        spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/changes"
    q = ev.changed(stream, "user_id", "kind", ["ts", "event_id"], out, f"file://{tmp_path}/mark", late, once_only=True)
    q.awaitTermination()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rest = ev.changed_rest(spark, out, "user_id", "kind", ["ts", "event_id"], q.lastProgress["batchId"])
    done = spark.read.schema(rest.schema).option("recursiveFileLookup", "true").parquet(f"{out}/changes")
    found = [r.event_id for r in done.unionByName(rest).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_changes_across_batches_and_triggers(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * (i // 2)), i % 3, "ab"[i // 5 % 2], 0.0) for i in range(60)]
    assert all_changes(spark, rows, tmp_path, 2, "30 days") == plain_changes(rows)


def test_changes_of_late_events(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    rows = [(0, at(0), 1, "a", 0.0), (1, at(3), 1, "b", 0.0), (2, at(20), 1, "b", 0.0), (3, at(1), 1, "x", 0.0), (4, at(21), 1, "c", 0.0), (5, at(15), 1, "z", 0.0)]
    # the second trigger brings 1, 3 and 5; 0 and 2 are there, 2 is not settled: 3 comes in time, and so does 5
    assert all_changes(spark, rows, tmp_path, 2, "30 minutes") == plain_changes(rows)


def test_buffered_sink(spark, tmp_path):
    _, stream = source(spark, tmp_path)
    ev.buffered(stream, f"file://{tmp_path}/buffer", f"file://{tmp_path}/mark", rows_per_file=10, once_only=True).awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/buffer")
    assert got.count() == 60 and len(list((tmp_path / "buffer").glob("*.parquet"))) >= 6


def test_tables(spark):
    table = spark.createDataFrame(ROWS, SCHEMA)
    assert {(r.user_id, r.event_id, r.n) for r in ev.latest(table, "user_id", ["ts"], ["event_id"]).collect()} == {(0, 57, 20), (1, 58, 20), (2, 59, 20)}
    assert sum(r.n for r in ev.windows(table, "ts", "1 hour", ["kind"], "value").collect()) == 60
    assert ev.sessions(table, "ts", "20 minutes", "user_id").count() == 60 and ev.sessions(table, "ts", "30 minutes", "user_id").count() == 3
    want = {}
    for _, _, user, _, v in ROWS:
        want[user] = v if user not in want else 0.8 * want[user] + 0.2 * v
    got = {r.user_id: r.ewma for r in ev.ewma(table, "user_id", ["ts"], "value").collect()}
    assert all(abs(got[u] - w) < 1e-9 for u, w in want.items()) and table.select(F.max("event_id")).first()[0] == 59
