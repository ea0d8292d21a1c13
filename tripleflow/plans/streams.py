"""Queries of the streaming operators. Event tables are read as they are; the ``stream_`` queries run the same rows as a stream, to its end."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path, ship, table
from ..streaming import events as ev
from .workflow import Workflow, manifest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files; the table is copied to a folder of its own, as a stream reads folders."""
    path = new_path(s, "events")
    rows = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(path)
    return s.readStream.schema(rows.schema).parquet(path)


def _ended(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What the stream gives up to its end, as a table."""
    spark = stream.sparkSession
    out, mark = new_path(spark, "stream"), new_path(spark, "mark")
    if mode == "append":
        stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    else:
        keep = lambda batch, _: batch.write.mode("overwrite").parquet(out)
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


_add("progress_latest", lambda s, d: ev.latest(table(s, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id"]), "select user_id, arg_max(event_type, {'t': ts, 'e': event_id}) event_type, arg_max(event_id, {'t': ts, 'e': event_id}) event_id, count(*) n from events group by 1")
_add("ewma", lambda s, d: ev.ewma(table(s, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("ewma", 6).alias("ewma")), "with l as (select user_id, value v, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 k, count(*) over (partition by user_id) n from events) select user_id, round(sum(v * pow(0.8, k) * case when k = n - 1 then 1 else 0.2 end), 6) ewma from l group by 1")
_WIN = "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all"
_add("tumbling_windows", lambda s, d: ev.windows(table(s, d, "events"), "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4)), _WIN.replace("as start", 'as "start"'))
_SES = 'with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hour then 0 else 1 end b from events window w as (partition by user_id order by ts)), h as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) as "start", max(ts) + interval 6 hour as "end", count(*) n from h group by user_id, k'
_add("session_windows", lambda s, d: ev.sessions(table(s, d, "events"), "ts", "6 hours", "user_id"), _SES)
_add("stream_latest", lambda s, d: _ended(ev.latest(_stream(s, d), "user_id", ["ts", "event_id"], ["event_type", "event_id"]), "complete"), SQL["progress_latest"])
_add("stream_windows", lambda s, d: _ended(ev.windows(_stream(s, d), "ts", "1 hour", ["event_type"], "value"), "complete").withColumn("total", F.round("total", 4)), SQL["tumbling_windows"])


def _changes(s: SparkSession, d: str) -> DataFrame:
    """The changes of each user's event type, over several triggers."""
    out, order = new_path(s, "changes"), ["ts", "event_id"]
    rows = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = new_path(s, "events")
    for k, few in enumerate(rows.randomSplit([1.0, 1.0, 1.0], seed=7)):  # three files that overlap in time
        few.coalesce(1).write.mode("append").parquet(path)
    stream = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = ev.changed(stream, "user_id", "event_type", order, out, new_path(s, "mark"), late="1000 days", once_only=True)
    q.awaitTermination()
    rest = ev.changed_rest(s, out, "user_id", "event_type", order, q.lastProgress["batchId"])
    done = s.read.schema(rest.schema).option("recursiveFileLookup", "true").parquet(f"{out}/changes")
    return done.unionByName(rest).select("event_id")


_add("stream_changes", _changes, "select event_id from (select event_id, event_type, lag(event_type) over w p, row_number() over w rn from events window w as (partition by user_id order by ts, event_id)) where rn = 1 or event_type is distinct from p")
_add("stream_dedup", lambda s, d: _ended(ev.once(_stream(s, d), ["event_id"], "ts", "100 days")).select("event_id"), "select distinct event_id from events")


def _buffered(s: SparkSession, d: str) -> DataFrame:
    out = new_path(s, "buffer")
    ev.buffered(_stream(s, d), out, new_path(s, "mark"), rows_per_file=5000, once_only=True).awaitTermination()
    return s.read.parquet(out).select("event_id", "value")


_add("stream_buffered", _buffered, "select event_id, value from events")


def _workflow(s: SparkSession, d: str) -> DataFrame:
    """A manifest whose tasks run a sequence with a condition, a loop, a nested sequence and stored results."""
    name = f"orders_{uuid.uuid4().hex[:8]}"
    methods = {
        "load": lambda least: table(s, d, "orders").where(F.col("o_totalprice") >= least),
        "count": lambda frame, status: frame.where(F.col("o_orderstatus") == status).agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit(status)),
        "collect": lambda done, one: done + [one],
    }
    sequences = {
        "main": [
            {"set": "least", "value": "{{ 1000 * 100 }}"},
            {"method": "load", "args": {"least": "{{ least }}"}, "save_as": name},
            {"when": "least > 5", "next_sequence": "per_status"},
            {"when": "least < 5", "set": "statuses", "value": []},
        ],
        "per_status": [{"set": "statuses", "value": ["F", "O", "P"]}, {"loop_over": "statuses", "next_sequence": "one"}],
        "one": [{"method": "count", "args": {"frame": f"{{{{ {name} }}}}", "status": "{{ item }}"}, "save_as": "n"}, {"method": "collect", "args": {"done": "{{ out['all'] }}", "one": "{{ n }}"}, "save_as": "got"}, {"method": "keep", "args": {"frames": "{{ got }}"}}],
    }
    out: dict[str, list] = {"all": []}
    methods["keep"] = lambda frames: out["all"].append(frames[-1])
    flow = Workflow(s, sequences, methods)
    assert not flow.lint()
    flow.run("main", {"out": out})
    first, *rest = out["all"]
    for r in rest:
        first = first.unionByName(r)
    return first


_add("workflow", _workflow, "select o_orderstatus status, count(*) n from orders where o_totalprice >= 100000 group by 1")


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return manifest(s, {"execution_id": "e1", "tasks": [{"msisdn": 5500000000001, "sequence": "main"}, {"msisdn": "5500000000002", "sequence": "main", "payload": {"a": 1}}]})


_add("manifest", _manifest, "select 'e1' execution_id, '5500000000001' msisdn, 'main' as sequence, '{}' payload union all select 'e1', '5500000000002', 'main', '{\"a\": 1}'")
