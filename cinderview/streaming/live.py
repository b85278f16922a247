"""The batch operators on arriving telemetry, with state per key."""

import json
from typing import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.ordered import carried, spread_join, union_all
from ..functions.text import severity
from ..operators import batches as bt
from ..operators.failures import dedup_failures
from ..operators.logs import timed
from ..operators.progress import parse_progress, progress_report
from ..operators.rates import rate_since, with_previous
from ..session import delete, scratch_path, written
from ..sources.logfiles import app_of_file
from .keyed import KeyedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _time_mode(ttl_ms):
    """State that expires needs processing time; a run to the end of its input has none."""
    return "none" if ttl_ms is None else "processingTime"


class _Expiring(StatefulProcessor):
    """Keyed state that is dropped after ``ttl_ms`` without rows (None keeps it)."""

    def __init__(self, ttl_ms=None):
        self.ttl_ms = ttl_ms

    def state(self, handle, name, schema):
        return handle.getValueState(name, schema) if self.ttl_ms is None else handle.getValueState(name, schema, self.ttl_ms)

    def close(self) -> None:
        pass


def use_state_store(spark):
    """Keyed state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _each_epoch(frame, name, checkpoint, land, trigger):
    """Start a stream that hands every epoch to ``land(df, epoch)``."""
    writer = frame.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(land)
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()


_EVENT_FACTS = ["first_poll", "kind", "title", "detail"]


def _told(events):
    """What was last told of each failure; a detail told later completes it."""
    newest = F.max_by(F.struct(*_EVENT_FACTS), F.struct("first_poll", F.col("detail").isNotNull(), "detail"))
    return events.groupBy("app_id", "key").agg(newest.alias("_f")).select("app_id", "key", "_f.*")


def start_failure_events(sightings, path, checkpoint, keep_polls=None, trigger=None):
    """Failures once when first seen, and once more when their detail arrives later.

    ``sightings`` are rows of ``failure_sightings``; polls arrive in order, rows
    of one poll in any. Events go to ``path/events``. What was told is a keyed
    table; an epoch reads only the buckets its failures are in and adds only its
    events. With ``keep_polls`` failures first seen more polls ago are forgotten
    (and would be told again if they came back).
    """

    def land(df, epoch):
        spark = df.sparkSession
        polls = df.agg(F.min("poll").alias("first"), F.max("poll").alias("last")).first()
        if polls.first is None:
            return
        told = KeyedTable(spark, f"{path}/state", ["app_id", "key"], _told)
        now = dedup_failures(df).select("app_id", "key", *_EVENT_FACTS)
        before = told.read(told.touched(now), epoch)
        if before is None:
            events = now.withColumn("event", F.lit("new"))
        else:
            if keep_polls is not None:
                before = before.where(F.col("first_poll") >= polls.first - keep_polls)
            old = before.select("app_id", "key", *[F.col(c).alias(f"_{c}") for c in _EVENT_FACTS])
            both = now.join(old, ["app_id", "key"], "left")
            known = F.col("_first_poll").isNotNull()
            late = known & F.col("_detail").isNull() & F.col("detail").isNotNull()
            facts = [F.when(known, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in _EVENT_FACTS[:-1]]
            events = both.select("app_id", "key", *facts, "detail", F.when(~known, "new").when(late, "detail").alias("event"))
            events = events.where("event IS NOT NULL")
        events.write.mode("overwrite").parquet(f"{path}/events/epoch={epoch}")
        forgotten = None if keep_polls is None else F.col("first_poll") >= polls.first - keep_polls
        told.add(spark.read.parquet(f"{path}/events/epoch={epoch}").drop("event"), epoch, forgotten)

    return _each_epoch(sightings, "failure-events", checkpoint, land, trigger)


def stream_failures(sightings):
    """The failure log as a streaming aggregate, for output mode ``update``.

    A key's row is written again whenever the key is seen, so the sink keeps
    the last row per key (:func:`start_failures`).
    """
    return dedup_failures(sightings)


def start_failures(sightings, path, checkpoint, trigger=None):
    """Write changed failures, one folder per epoch; an epoch written twice is replaced."""

    def land(df, epoch):
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    writer = (
        stream_failures(sightings).writeStream.queryName("failure-log").outputMode("update")
        .option("checkpointLocation", checkpoint).foreachBatch(land)
    )
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()


def failures_so_far(spark, path):
    """The failure log as of the last finished epoch."""
    rows = spark.read.parquet(path)
    facts = [c for c in rows.columns if c not in ("app_id", "key", "epoch")]
    return rows.groupBy("app_id", "key").agg(F.max_by(F.struct(*facts), "epoch").alias("_f")).select("app_id", "key", "_f.*")


_WINDOW = ["batch_id", "arrival", "num_input_rows", "input_rps", "processed_rps"]


def _newest(rows):
    """The five newest batches of one run; the first report of a batch counts."""
    first = rows.sort_values("arrival", kind="stable").drop_duplicates("batch_id")
    return first.nlargest(bt.BEHIND_WINDOW, "batch_id")


# How long after its last row a replaced run or query id is known as such.
LATE_MS = 7 * 24 * 3600 * 1000


def _stale(known, name, arrival):
    """Whether a run (or query id) was replaced; if so its last arrival is noted."""
    if name not in known:
        return False
    known[name] = max(known[name], arrival)
    return True


class _BehindState(_Expiring):
    """Last five batches of the live run of one query name.

    Arrivals are reduced to five batches per run while they are read, so a
    busy query needs no more memory than a quiet one. Replaced runs and ids without
    a row for ``late_ms`` are forgotten, so the state does not grow with restarts; rows
    of other runs than the live one that are older than that are left out.
    """

    def __init__(self, ttl_ms=None, late_ms=LATE_MS):
        super().__init__(ttl_ms)
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = self.state(handle, "live", "doc string")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        live = json.loads(self.live.get()[0]) if self.live.exists() else {
            "id": None, "run": None, "retired": {}, "past": {}, "window": [], "newest": None
        }
        runs = {}
        for pdf in rows:
            for run, part in pdf.groupby(["query_id", "run_id"], sort=False):
                first, window = runs.get(run, (None, None))
                seen = part["arrival"].min()
                merged = part[_WINDOW] if window is None else pd.concat([window, part[_WINDOW]])
                runs[run] = (seen if first is None else min(first, seen), _newest(merged))
        last = int(max(window["arrival"].max() for _, window in runs.values()))
        live["newest"] = last if live["newest"] is None else max(last, live["newest"])
        start = live["newest"] - self.late_ms
        for (query, run), (_, window) in sorted(runs.items(), key=lambda kv: kv[1][0]):
            if window["arrival"].max() >= start or (query, run) == (live["id"], live["run"]):
                self._take(live, query, run, window)
        for replaced in ("retired", "past"):
            live[replaced] = {name: at for name, at in live[replaced].items() if at >= start}
        self.live.update((json.dumps(live),))
        recent = [w for w in live["window"] if w[2] > 0]
        slow = sum(1 for w in recent if w[4] < w[3])
        yield pd.DataFrame(
            {"app_id": [key[0]], "who": [key[1]], "query_id": [live["id"]], "run_id": [live["run"]],
             "last_batch": [live["window"][0][0] if live["window"] else None], "arrival": [last], "with_input": [len(recent)], "slow": [slow],
             "behind": [len(recent) >= bt.BEHIND_MIN and slow >= bt.BEHIND_MIN]}
        )

    def _take(self, live, query, run, window):
        first, last = int(window["arrival"].min()), int(window["arrival"].max())
        if query != live["id"]:
            if _stale(live["retired"], query, last):
                return
            if live["id"] is not None:
                live["retired"][live["id"]] = first
            live.update(id=query, run=None, past={}, window=[])
        if run != live["run"]:
            if _stale(live["past"], run, last):
                return
            if live["run"] is not None:
                live["past"][live["run"]] = first
            live.update(run=run, window=[])
        known = pd.DataFrame(live["window"], columns=_WINDOW)
        merged = window if known.empty else pd.concat([known, window])
        live["window"] = [
            [int(w.batch_id), int(w.arrival), int(w.num_input_rows), float(w.input_rps), float(w.processed_rps)]
            for w in _newest(merged).itertuples(index=False)
        ]


def stream_behind(progress, ttl_ms=None, late_ms=LATE_MS):
    """Falling-behind state of every query after each arrival; a restart empties its window.

    Rows of a run that is not the live one are left out when they are more than
    ``late_ms`` older than the newest row of their query.
    """
    cols = ["app_id", "query_id", "run_id", "batch_id", "arrival", "num_input_rows", "input_rps", "processed_rps"]
    who = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("query_id"))
    return (
        progress.select(who.alias("who"), *cols)
        .groupBy("app_id", "who")
        .transformWithStateInPandas(
            _BehindState(ttl_ms, late_ms),
            "app_id string, who string, query_id string, run_id string, last_batch long, arrival long, with_input long, slow long, behind boolean",
            "append",
            _time_mode(ttl_ms),
        )
    )


_POLL = ["app_id", "key"]


def _polls(late_s):
    """Merge rule of polls: one for each counter and time, the largest value where there are several.

    With ``late_s`` only the polls of that time before a counter's last one are
    kept, and the last one before them.
    """

    def merge(rows):
        one = rows.groupBy(*_POLL, "ts").agg(F.max("value").alias("value"))
        if late_s is None:
            return one
        ends = one.groupBy(*_POLL).agg((F.max("ts") - late_s).alias("_cut"))
        cut = spread_join(one, ends, _POLL, ["ts"])
        starts = cut.where("ts <= _cut").groupBy(*_POLL).agg(F.max("ts").alias("_start"))
        return spread_join(cut, starts, _POLL, ["ts"], "left").where("_start IS NULL OR ts >= _start").drop("_cut", "_start")

    return merge


def start_rates(samples, path, checkpoint, ts="poll_s", value="value", late_s=None, keep_s=None, trigger=None):
    """Counter rates on arriving polls, to ``path/rates``; :func:`rates_so_far` reads them.

    An epoch rates its polls and rates again the polls next after them, so in the
    end rates are those of the batch operator over all polls, in whatever order
    they came. Polls are a keyed table, of which an epoch reads the buckets it has
    news of; polls of one counter and time count once, with the largest value.
    ``late_s`` bounds it: polls so much older than the last one their counter had
    before the epoch are left out. With ``keep_s`` counters without a poll for so
    long are forgotten.
    """

    def land(df, epoch):
        spark = df.sparkSession
        times = df.agg(F.min(ts).cast("long").alias("first")).first()
        if times.first is None:
            return
        table = KeyedTable(spark, f"{path}/state", _POLL, _polls(late_s))
        now = df.select(*_POLL, F.col(ts).cast("long").alias("ts"), F.col(value).cast("double").alias("value"))
        before = table.read(table.touched(now), epoch)
        fresh = None if keep_s is None else F.col("ts") > times.first - keep_s
        polls = now.withColumn("_new", F.lit(True))
        if before is not None:
            before = before if fresh is None else before.where(fresh)
            if late_s is not None:
                ends = before.groupBy(*_POLL).agg((F.max("ts") - late_s).alias("_cut"))
                now = spread_join(now, ends, _POLL, ["ts"], "left").where("_cut IS NULL OR ts > _cut").drop("_cut")
                polls = now.withColumn("_new", F.lit(True))
            known = before.join(now.select(*_POLL).distinct(), _POLL, "left_semi")
            polls = polls.unionByName(known.withColumn("_new", F.lit(False)))
        one = polls.groupBy(*_POLL, "ts").agg(F.max("value").alias("value"), F.max("_new").alias("_new"))
        rated = with_previous(one, _POLL, "ts", ["value", "_new"]).withColumn("rate", rate_since("ts", "value"))
        rated = rated.where(F.col("_new") | F.coalesce("prev__new", F.lit(False)))
        rated.select(*_POLL, "ts", "value", "rate").write.mode("overwrite").parquet(f"{path}/rates/epoch={epoch}")
        table.add(now, epoch, fresh)

    return _each_epoch(samples, "counter-rates", checkpoint, land, trigger)


def rates_so_far(spark, path):
    """Of each counter and time the rate that was written last."""
    rows = spark.read.parquet(f"{path}/rates")
    return rows.groupBy(*_POLL, "ts").agg(F.max_by(F.struct("value", "rate"), "epoch").alias("_r")).select(*_POLL, "ts", "_r.*")


def batch_facts(progress=None, sql=None):
    """Progress and SQL rows in one shape, so both arrive through one stream."""
    parts = []
    if progress is not None:
        parts.append(progress.withColumn("fact", F.lit("progress")))
    if sql is not None:
        parts.append(sql.withColumn("fact", F.lit("sql")))
    return union_all(parts)


_SQL_FACTS = ["execution_id", "status", "submitted_ms", "duration_ms"]


def compacted(facts):
    """What later merges need of a batch's facts, however often and in whatever order they came.

    The first progress; of the executions the last, the last with a submission
    and the earliest submitted one.
    """
    rest = [c for c in facts.columns if c not in (*bt.BATCH, "fact")]
    row = F.struct(*rest)
    is_sql = F.col("fact") == "sql"
    dated = is_sql & F.col("submitted_ms").isNotNull()
    kept = facts.groupBy(*bt.BATCH, "fact").agg(
        F.min_by(row, F.when(~is_sql, F.struct("arrival", "started_ms"))).alias("_a"),
        F.max_by(row, F.when(is_sql, F.struct(*_SQL_FACTS))).alias("_b"),
        F.max_by(row, F.when(dated, F.struct(*_SQL_FACTS))).alias("_c"),
        F.min_by(row, F.when(dated, F.struct("submitted_ms", *_SQL_FACTS))).alias("_d"),
    )
    rows = F.array_distinct(F.filter(F.array("_a", "_b", "_c", "_d"), lambda x: x.isNotNull()))
    return kept.select(*bt.BATCH, "fact", F.explode(rows).alias("_r")).select(*bt.BATCH, "fact", "_r.*")


def _facts_table(spark, path):
    return KeyedTable(spark, path, bt.BATCH, compacted)


def batch_table(spark, path):
    """Merged facts of all batches as of the last epoch."""
    return _facts_table(spark, path).read()


def start_batches(facts, path, checkpoint, trigger=None):
    """Merge arriving facts into a table keyed by batch.

    An epoch only adds its own merged facts; buckets are written anew when what
    was added outgrows half of them, and what they replace is deleted.
    """

    def land(df, epoch):
        if not df.isEmpty():
            _facts_table(df.sparkSession, path).add(df, epoch)

    return _each_epoch(facts, "batch-facts", checkpoint, land, trigger)


def stream_batches(spark, path, progress_columns, sql_columns):
    """Live batches from the merged table."""
    facts = batch_table(spark, path)
    progress = facts.where("fact = 'progress'").select(*progress_columns)
    sql = facts.where("fact = 'sql'").select(*sql_columns)
    return bt.merge_batches(progress, sql)


LOG = ["app_id", "log"]
# Bytes of a log whose lines are filled together.
LOG_CHUNK = 8 << 20


def _last_times(rows):
    return rows.groupBy(*LOG).agg(F.max_by("time_ms", "at").alias("time_ms"), F.max("at").alias("at"))


def start_log_counts(raw, path, checkpoint, app_id=None, trigger=None):
    """Lines and failure lines per app, file, minute and severity of arriving lines, for :func:`log_counts`.

    ``raw`` are lines of ``growing.stream_growing_logs``. Undated lines (stack
    traces) take the time of the dated line before them, also of an earlier epoch:
    the last time of each log is a keyed table. Ahead of the first dated line
    they take the file's own time. The lines of an epoch are read from their files
    once and kept with their time until they are counted.
    """

    def land(df, epoch):
        spark = df.sparkSession
        read = scratch_path(spark, "log-read")
        dated = timed(df.withColumn("app_id", app_of_file(app_id))).select(*LOG, "file", "at", "file_ms", "ts_ms", "line")
        dated.write.option("compression", "zstd").parquet(read)
        lines = spark.read.parquet(read).withColumn("_chunk", F.floor(F.col("at") / LOG_CHUNK))
        seen = carried(lines, LOG, ["_chunk"], ["at"], fill={"time_ms": F.col("ts_ms")})
        seen = written(spark, seen.select(*LOG, "file", "at", "file_ms", "time_ms", "line"), "log-lines")
        delete(spark, read)
        if seen.isEmpty():
            return
        table = KeyedTable(spark, f"{path}/state", LOG, _last_times)
        before = table.read(table.touched(seen), epoch)
        past = F.lit(None).cast("long").alias("_past")
        lines = seen.withColumn("_past", past)
        if before is not None:
            lines = spread_join(seen, before.select(*LOG, F.col("time_ms").alias("_past")), LOG, ["at"], "left")
        at = F.coalesce("time_ms", "_past", "file_ms")
        counts = (
            lines.groupBy("app_id", "file", F.timestamp_millis(F.floor(at / 60000) * 60000).alias("minute"), severity("line").alias("severity"))
            .agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.lower("line").contains("fail")).alias("failures"))
        )
        counts.write.mode("overwrite").parquet(f"{path}/counts/epoch={epoch}")
        table.add(seen.where("time_ms IS NOT NULL").select(*LOG, "at", "time_ms"), epoch)

    return _each_epoch(raw, "log-counts", checkpoint, land, trigger)


def log_counts(spark, path):
    """Counts of all epochs together, by the names files had when their lines were read."""
    rows = spark.read.parquet(f"{path}/counts")
    return rows.groupBy("app_id", "file", "minute", "severity").agg(F.sum("lines").alias("lines"), F.sum("failures").alias("failures"))


def active_report(spark, app_id, queries):
    """Status of the given streaming queries of this session, from their last progress."""
    rows = [(app_id, str(q.id), q.isActive, json.dumps(q.lastProgress, default=str) if q.lastProgress else None) for q in queries]
    df = spark.createDataFrame(rows, "app_id string, query_id string, is_active boolean, json string")
    seen = parse_progress(df.where("json IS NOT NULL").select("app_id", "json"))
    return progress_report(seen, df.select("app_id", "query_id", "is_active"))
