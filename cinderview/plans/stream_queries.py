"""Streaming queries, run to the end of their input."""

from pyspark.sql import functions as F

from ..operators import batches as bt, failures as fl
from ..session import scratch_path, written
from ..sources.growing import stream_growing_logs
from ..streaming import live, orders
from . import failure_queries
from .registry import query


def _finish(started):
    started.awaitTermination()


def _ms(col):
    return F.unix_millis(F.col(col).cast("timestamp")).alias(col)


def _epoch(col):
    return f"CAST(floor(epoch_us({col}) / 1000) AS BIGINT) AS {col}"


def landed(v, name, start):
    """Run a stream into a fresh folder and read that folder."""
    out = scratch_path(v.spark, name)
    _finish(start(f"{out}/data", f"{out}/checkpoint"))
    return v.spark.read.parquet(f"{out}/data")


_ORDERS = f"SELECT {_epoch('event_time')}, order_id, customer_id, amount, region FROM fx_orders_stream"


@query("orders_projection", _ORDERS)
def orders_projection(v):
    stream = orders.orders_stream(v.spark, v.sf_dir, "events.parquet")
    rows = landed(v, "orders", lambda out, ckpt: orders.start_raw(stream, out, ckpt, None, None))
    return rows.select(_ms("event_time"), "order_id", "customer_id", "amount", "region")


@query("stream_parquet_sink", "SELECT region, order_id, amount FROM fx_orders_stream")
def stream_parquet_sink(v):
    stream = orders.orders_stream(v.spark, v.sf_dir, "events.parquet")
    rows = landed(v, "sink", lambda out, ckpt: orders.start_raw(stream, out, ckpt, None))
    return rows.select("region", "order_id", "amount")


@query("raw_append", "SELECT region, count(*) AS orders, sum(amount) AS amount FROM fx_orders_stream GROUP BY region")
def raw_append(v):
    stream = orders.orders_stream(v.spark, v.sf_dir, "events.parquet")
    rows = landed(v, "raw", lambda out, ckpt: orders.start_raw(stream, out, ckpt, None))
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("orders"), F.sum("amount").alias("amount"))


@query("windowed_revenue", """
SELECT CAST(epoch_ms(window_start) AS BIGINT) AS window_start, customer_id, sum(amount) AS revenue, count(order_id) AS orders
FROM (SELECT *, date_trunc('minute', event_time) AS window_start FROM fx_orders_stream) o
WHERE window_start + INTERVAL 1 MINUTE <= (SELECT max(event_time) FROM fx_orders_stream) - INTERVAL 30 SECOND
GROUP BY window_start, customer_id""")
def windowed_revenue(v):
    stream = orders.windowed_revenue(orders.orders_stream(v.spark, v.sf_dir, "events.parquet"))
    rows = landed(v, "revenue", lambda out, ckpt: orders.start_revenue(stream, out, ckpt, None))
    return rows.select(_ms("window_start"), "customer_id", "revenue", "orders")


@query("poison_guard", "SELECT order_id, customer_id, amount FROM fx_orders_stream")
def poison_guard(v):
    guarded = orders.poison_guard(orders.orders_stream(v.spark, v.sf_dir, "events.parquet"), 1 << 60)
    rows = landed(v, "guarded", lambda out, ckpt: orders.start_raw(guarded, out, ckpt, None, None))
    return rows.select("order_id", "customer_id", "amount")


def fed(v, df, name, order, parts, start):
    """Feed a table in steps; the stream ends with each step and goes on from its checkpoint."""
    path = scratch_path(v.spark, name)
    df = written(v.spark, df, f"{name}-all")
    for part in parts:
        df.where(F.col(order) == part).write.mode("append").parquet(path)
        _finish(start(v.spark.readStream.schema(df.schema).parquet(path)))


def kept(v, name, transform):
    """A start function that appends ``transform(stream)`` to Parquet, and the place it writes to."""
    out = scratch_path(v.spark, name)

    def start(stream):
        return (
            transform(stream).writeStream.format("parquet").outputMode("append").option("path", f"{out}/data")
            .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        )

    return start, f"{out}/data"


@query("stream_file_source", "SELECT event_id, user_id, event_type, value, props FROM {events}")
def stream_file_source(v):
    """A table's files taken in as a stream, row by row as they are."""
    raw = v.spark.readStream.schema(v.events.schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    start, out = kept(v, "files", lambda s: s.select("event_id", "user_id", "event_type", "value", "props"))
    _finish(start(raw))
    return v.spark.read.parquet(out)


@query("stream_failure_log", f"WITH {failure_queries._LOG} SELECT app_id, key, kind, first_poll, title, detail FROM failures")
def stream_failure_log(v):
    sightings = fl.failure_sightings(
        **failure_queries.polled(v, "stages", "jobs", "executors", "sql", "tasks"),
        job_stages=v.fx_job_stages, sql_jobs=v.fx_sql_jobs,
    )
    out = scratch_path(v.spark, "failures")
    fed(v, sightings, "sightings", "poll", [1, 2, 3], lambda s: live.start_failures(s, f"{out}/log", f"{out}/checkpoint"))
    log = live.failures_so_far(v.spark, f"{out}/log")
    return log.select("app_id", "key", "kind", "first_poll", "title", "detail")


@query("stream_falling_behind", """
SELECT app_id, query_id, CAST(sum(CASE WHEN num_input_rows > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_input,
       CAST(sum(CASE WHEN num_input_rows > 0 AND processed_rps < input_rps THEN 1 ELSE 0 END) AS BIGINT) AS slow,
       sum(CASE WHEN num_input_rows > 0 AND processed_rps < input_rps THEN 1 ELSE 0 END) >= 3 AND sum(CASE WHEN num_input_rows > 0 THEN 1 ELSE 0 END) >= 3 AS behind
FROM (SELECT *, row_number() OVER (PARTITION BY app_id, query_id ORDER BY batch_id DESC) AS pos FROM fx_progress WHERE run_id = 'r2') p
WHERE pos <= 5 GROUP BY app_id, query_id""")
def stream_falling_behind(v):
    live.use_state_store(v.spark)
    rows = v.fx_progress.withColumn("part", F.when(F.col("run_id") == "r1", 1).otherwise(2))
    start, out = kept(v, "behind", live.stream_behind)
    fed(v, rows, "progress", "part", [1, 2], start)
    last = v.spark.read.parquet(out).groupBy("app_id", "who").agg(
        F.max_by(F.struct("query_id", "with_input", "slow", "behind"), "arrival").alias("_s")
    )
    return last.select("app_id", "_s.*")


@query("stream_failure_events", f"""WITH {failure_queries._LOG},
per_poll AS (
  SELECT app_id, key, poll, arg_min(title, row(kind_order, place, sub, title, coalesce(executor_id, ''))) AS title,
         arg_min(detail, row(kind_order, place, sub, title, coalesce(executor_id, ''))) FILTER (WHERE detail IS NOT NULL) AS detail
  FROM sightings GROUP BY app_id, key, poll),
heads AS (SELECT *, row_number() OVER (PARTITION BY app_id, key ORDER BY poll) AS rn,
                 first_value(detail) OVER (PARTITION BY app_id, key ORDER BY poll) AS head_detail,
                 first_value(title) OVER (PARTITION BY app_id, key ORDER BY poll) AS head_title,
                 first_value(poll) OVER (PARTITION BY app_id, key ORDER BY poll) AS head_poll,
                 row_number() OVER (PARTITION BY app_id, key, detail IS NULL ORDER BY poll) AS rd FROM per_poll)
SELECT app_id, key, 'new' AS event, CAST(head_poll AS BIGINT) AS first_poll, head_title AS title, head_detail AS detail FROM heads WHERE rn = 1
UNION ALL
SELECT app_id, key, 'detail', CAST(head_poll AS BIGINT), head_title, detail FROM heads WHERE head_detail IS NULL AND detail IS NOT NULL AND rd = 1""")
def stream_failure_events(v):
    sightings = fl.failure_sightings(
        **failure_queries.polled(v, "stages", "jobs", "executors", "sql", "tasks"),
        job_stages=v.fx_job_stages, sql_jobs=v.fx_sql_jobs,
    )
    out = scratch_path(v.spark, "events")
    fed(v, sightings, "sightings", "poll", [1, 2, 3], lambda s: live.start_failure_events(s, out, f"{out}/checkpoint"))
    return v.spark.read.parquet(f"{out}/events").select("app_id", "key", "event", "first_poll", "title", "detail")


# Polls come in three steps; every ninth of the first half arrives only with the last step.
@query("stream_rates", """
SELECT app_id, key, poll_s AS ts, value, (value - lag(value) OVER w) / CAST(poll_s - lag(poll_s) OVER w AS DOUBLE) AS rate
FROM fx_metrics WINDOW w AS (PARTITION BY app_id, key ORDER BY poll_s)""")
def stream_rates(v):
    hour = F.col("poll_s") / 3600
    part = F.when(F.col("poll_s") >= 1200000, 2).when(hour % 9 == 4, 3).otherwise(1)
    rows = v.fx_metrics.select("app_id", "key", "poll_s", "value").withColumn("part", part)
    out = scratch_path(v.spark, "rates")
    fed(v, rows, "samples", "part", [1, 2, 3], lambda s: live.start_rates(s, out, f"{out}/checkpoint"))
    return live.rates_so_far(v.spark, out)


def _merged_check():
    from . import batch_queries

    return f"""WITH {batch_queries._MERGED}
SELECT app_id, query_id, run_id, batch_id, status, submitted_ms, duration_ms, has_progress FROM merged"""


@query("stream_batch_upsert", _merged_check())
def stream_batch_upsert(v):
    progress, sql = v.fx_progress, v.fx_batch_sql
    # Executions and progress come mixed; a seventh of the executions is repeated with the last step.
    again = sql.where("execution_id % 7 = 0").withColumn("part", F.lit(3))
    first = live.batch_facts(progress, sql).withColumn("part", F.when(F.coalesce("execution_id", "arrival") % 2 == 0, 1).otherwise(2))
    facts = first.unionByName(live.batch_facts(sql=again), allowMissingColumns=True)
    out = scratch_path(v.spark, "batches")
    fed(v, facts, "facts", "part", [1, 2, 3], lambda s: live.start_batches(s, f"{out}/facts", f"{out}/checkpoint"))
    merged = live.stream_batches(v.spark, f"{out}/facts", progress.columns, sql.columns)
    return merged.select(*bt.BATCH, "status", "submitted_ms", "duration_ms", "has_progress")


@query("stream_log_tail", """
WITH filled AS (SELECT *, last_value(stamp_ms IGNORE NULLS) OVER (PARTITION BY app_id, file ORDER BY line_no) AS time_ms FROM fx_log_lines)
SELECT app_id, file, CAST(floor(time_ms / 60000) AS BIGINT) * 60000 AS minute,
       CASE WHEN contains(line, ' ERROR ') OR contains(line, 'Exception') OR contains(line, 'Error:') OR contains(line, 'FATAL') THEN 'ERROR'
            WHEN contains(line, ' WARN ') THEN 'WARN' ELSE 'PLAIN' END AS severity, count(*) AS lines,
       CAST(sum(CASE WHEN contains(lower(line), 'fail') THEN 1 ELSE 0 END) AS BIGINT) AS failures
FROM filled GROUP BY 1, 2, 3, 4""")
def stream_log_tail(v):
    """Log files are read in three steps that end inside lines; lines ahead of the first dated one carry the file's time, shown as none."""
    path = scratch_path(v.spark, "loglines")
    lines = v.fx_log_lines.select("app_id", "file", "line_no", "line")
    files = lines.repartition("app_id", "file").sortWithinPartitions("app_id", "file", "line_no")
    files.select("app_id", "file", "line").write.partitionBy("app_id", "file").text(path)
    out = scratch_path(v.spark, "minutes")
    for upto in (1 << 10, 1 << 14, None):
        raw = stream_growing_logs(v.spark, path, "*.txt", upto)
        _finish(live.start_log_counts(raw, out, f"{out}/checkpoint"))
    rows = live.log_counts(v.spark, out)
    part = lambda name: F.regexp_extract("file", rf"/{name}=([^/]+)/", 1).alias(name)
    minute = F.unix_millis("minute")
    # All lines are of one January; the files were written long after it.
    return rows.select(
        part("app_id"), part("file"), F.when(minute < 1704067200000 + 40 * 24 * 3600000, minute).alias("minute"), "severity", "lines", "failures"
    )
