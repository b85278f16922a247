"""Queries that read source formats; the formats are written from the tables first."""

from pyspark.sql import functions as F

from ..functions.ordered import union_all
from ..operators import report
from ..session import delete, rename, scratch_path, written
from ..sources import eventlog, events as ev, logfiles, registry_json, rest
from ..streaming.event_tables import EventTables
from . import failure_queries
from .registry import query


def _event(df, name, *fields):
    return df.select("app_id", F.to_json(F.struct(F.lit(name).alias("Event"), *fields)).alias("value"))


def _as(col, name):
    return (F.col(col) if isinstance(col, str) else col).alias(name)


def event_lines(v, *kinds):
    """Event log lines of the fixture fleet: all of them, or some kinds."""
    failed = F.col("status") == "FAILED"
    tasks = _event(
        v.fx_tasks, "SparkListenerTaskEnd", _as("stage_id", "Stage ID"), _as("attempt_id", "Stage Attempt ID"),
        F.struct(
            F.when(failed, "ExceptionFailure").otherwise("Success").alias("Reason"), _as("error_message", "Full Stack Trace")
        ).alias("Task End Reason"),
        F.struct(
            _as("task_id", "Task ID"), _as("attempt", "Attempt"), _as("executor_id", "Executor ID"), _as("host", "Host"),
            _as("locality", "Locality"), _as("speculative", "Speculative"), F.lit(1000).alias("Launch Time"),
            (F.col("duration_ms") + 1000).alias("Finish Time"), failed.alias("Failed"), F.lit(False).alias("Killed"),
        ).alias("Task Info"),
        F.struct(
            _as("gc_ms", "JVM GC Time"), _as("spill_bytes", "Memory Bytes Spilled"), _as("duration_ms", "Executor Run Time"),
            F.struct(_as("shuffle_read_bytes", "Remote Bytes Read"), F.lit(0).alias("Local Bytes Read")).alias("Shuffle Read Metrics"),
        ).alias("Task Metrics"),
    )
    info = lambda s: F.struct(s.alias("Stage ID"), F.lit(0).alias("Stage Attempt ID"),
                              F.concat(F.lit("stage "), s.cast("string")).alias("Stage Name"), F.lit(7).alias("Number of Tasks"))
    # Tasks are shuffled as they are: there are few of a job in one task, whose sets would be sorted first.
    by_job = v.fx_tasks.select("app_id", "job_id", "stage_id").repartition("app_id", "job_id")
    listed = by_job.groupBy("app_id", "job_id").agg(F.sort_array(F.collect_set("stage_id")).alias("Stage IDs"))
    jobs = v.fx_jobs.join(listed, ["app_id", "job_id"]).withColumn("Stage Infos", F.transform("Stage IDs", info))
    start = _event(
        jobs, "SparkListenerJobStart", _as("job_id", "Job ID"), F.lit(5).alias("Submission Time"), "Stage Infos", "Stage IDs",
        F.create_map(
            F.lit("spark.job.description"), F.col("description"), F.lit("spark.sql.execution.id"), F.col("execution_id").cast("string")
        ).alias("Properties"),
    )
    end = _event(
        jobs.where("status <> 'RUNNING'"), "SparkListenerJobEnd", _as("job_id", "Job ID"), F.lit(9).alias("Completion Time"),
        F.struct(F.when(failed, "JobFailed").otherwise("JobSucceeded").alias("Result")).alias("Job Result"),
    )
    stages = _event(
        v.fx_stages.where("status IN ('FAILED', 'COMPLETE')"), "SparkListenerStageCompleted",
        F.struct(
            _as("stage_id", "Stage ID"), _as("attempt_id", "Stage Attempt ID"), _as("name", "Stage Name"), _as("num_tasks", "Number of Tasks"),
            F.when(failed, F.coalesce("failure_reason", F.lit("unknown"))).alias("Failure Reason"),
        ).alias("Stage Info"),
    )
    ex = v.fx_executors
    added = _event(
        ex, "SparkListenerExecutorAdded", _as("add_ms", "Timestamp"), _as("executor_id", "Executor ID"),
        F.struct(F.substring_index("host_port", ":", 1).alias("Host"), _as("total_cores", "Total Cores"), _as("resource_profile_id", "Resource Profile Id")).alias("Executor Info"),
    )
    removed = _event(
        ex.where("NOT is_active"), "SparkListenerExecutorRemoved", _as("remove_ms", "Timestamp"), _as("executor_id", "Executor ID"),
        _as("remove_reason", "Removed Reason"),
    )
    # Every executor of an odd number was excluded and released; those excluded now were so (again) later.
    scheduler = "org.apache.spark.scheduler.SparkListenerExecutor"
    odd = ex.where("CAST(executor_id AS INT) % 2 = 1")
    turn = lambda df, name, at: _event(df, scheduler + name, F.lit(at).alias("time"), _as("executor_id", "executorId"), _as("failed_tasks", "taskFailures"))
    excluded = union_all([turn(odd, "Excluded", 1), turn(odd, "Unexcluded", 2), turn(ex.where("is_excluded"), "Excluded", 3)])
    managers = _event(
        ex, "SparkListenerBlockManagerAdded",
        F.struct(_as("executor_id", "Executor ID"), F.lit("h").alias("Host"), F.lit(7079).alias("Port")).alias("Block Manager ID"),
        _as("max_memory", "Maximum Memory"),
    )
    sql_start = _event(
        v.fx_sql, eventlog.SQL_UI + "SparkListenerSQLExecutionStart", _as("execution_id", "executionId"), "description", _as("submitted_ms", "time")
    )
    sql_end = _event(
        v.fx_sql.where("status <> 'RUNNING'"), eventlog.SQL_UI + "SparkListenerSQLExecutionEnd", _as("execution_id", "executionId"),
        (F.col("submitted_ms") + F.col("duration_ms")).alias("time"),
        F.when(failed, F.coalesce("error_message", F.lit("failed"))).otherwise("").alias("errorMessage"),
    )
    parts = {
        "tasks": [tasks], "jobs": [start, end], "stages": [stages], "executors": [added, removed, excluded, managers],
        "sql": [sql_start, sql_end],
    }
    return union_all([df for kind, dfs in parts.items() if not kinds or kind in kinds for df in dfs])


def landed_events(v, *kinds):
    """The fleet's events split by kind once, as a reader of many tables would do."""
    return eventlog.land_events(eventlog.events_of(event_lines(v, *kinds)), scratch_path(v.spark, "events"))


def progress_lines(v):
    iso = F.date_format(F.timestamp_millis("started_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    mark = F.date_format(F.timestamp_millis("watermark_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    progress = F.struct(
        _as("query_id", "id"), _as("run_id", "runId"), "name", iso.alias("timestamp"), _as("batch_id", "batchId"),
        _as("num_input_rows", "numInputRows"), _as("input_rps", "inputRowsPerSecond"), _as("processed_rps", "processedRowsPerSecond"),
        F.create_map(F.lit("addBatch"), F.col("add_batch_ms"), F.lit("triggerExecution"), F.col("trigger_ms")).alias("durationMs"),
        F.create_map(F.lit("watermark"), F.coalesce(mark, F.lit(""))).alias("eventTime"),
        F.array(
            F.struct(_as("state_rows", "numRowsTotal"), _as("state_bytes", "memoryUsedBytes"), _as("rows_dropped", "numRowsDroppedByWatermark"))
        ).alias("stateOperators"),
    )
    return _event(v.fx_progress, eventlog.PROGRESS_EVENT, progress.alias("progress"))


@query("event_log_tables", """
SELECT app_id, stage_id, attempt_id, task_id, attempt, executor_id, host, locality, speculative, duration_ms, status, error_message, gc_ms, shuffle_read_bytes, spill_bytes
FROM fx_tasks""")
def event_log_tables(v):
    # One table reads its log once, so nothing is landed.
    t = eventlog.tasks(eventlog.events_of(event_lines(v)))
    return t.select(
        "app_id", "stage_id", "attempt_id", "task_id", "attempt", "executor_id", "host", "locality", "speculative", "duration_ms",
        "status", "error_message", "gc_ms", "shuffle_read_bytes", "spill_bytes",
    )


_EL_STAGES = """
run_jobs AS (SELECT j.* FROM fx_jobs j WHERE EXISTS (SELECT 1 FROM fx_job_stages b WHERE b.app_id = j.app_id AND b.job_id = j.job_id)),
open_stage AS (SELECT b.app_id, b.stage_id, max(CASE WHEN j.status = 'RUNNING' THEN 1 ELSE 0 END) AS waiting
               FROM fx_job_stages b JOIN run_jobs j ON b.app_id = j.app_id AND b.job_id = j.job_id GROUP BY b.app_id, b.stage_id),
el_stages AS (
  SELECT s.app_id, s.stage_id, s.attempt_id, CASE WHEN s.status IN ('FAILED', 'COMPLETE') THEN s.status WHEN o.waiting = 1 THEN 'PENDING' ELSE 'SKIPPED' END AS status,
         CASE WHEN s.status IN ('FAILED', 'COMPLETE') THEN s.num_tasks ELSE 7 END AS num_tasks, s.num_complete_tasks, s.num_failed_tasks,
         s.executor_run_time, s.jvm_gc_time, s.memory_bytes_spilled,
         CASE WHEN s.status = 'FAILED' THEN coalesce(s.failure_reason, 'unknown') END AS failure_reason
  FROM fx_stages s JOIN open_stage o ON s.app_id = o.app_id AND s.stage_id = o.stage_id)"""


@query("event_log_stages", f"WITH {_EL_STAGES} SELECT * FROM el_stages")
def event_log_stages(v):
    s = eventlog.stages(landed_events(v, "tasks", "jobs", "stages"))
    return s.select(
        "app_id", "stage_id", "attempt_id", "status", "num_tasks", "num_complete_tasks", "num_failed_tasks", "executor_run_time",
        "jvm_gc_time", "memory_bytes_spilled", "failure_reason",
    )


@query("event_log_jobs", f"""WITH {_EL_STAGES}
SELECT j.app_id, j.job_id, j.execution_id, j.status, j.description, count(*) * 7 AS num_tasks,
       CAST(sum(s.num_complete_tasks) AS BIGINT) AS num_completed_tasks, CAST(sum(s.num_failed_tasks) AS BIGINT) AS num_failed_tasks,
       CAST(sum(CASE WHEN s.status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS num_failed_stages
FROM run_jobs j JOIN fx_job_stages b ON b.app_id = j.app_id AND b.job_id = j.job_id
JOIN el_stages s ON s.app_id = b.app_id AND s.stage_id = b.stage_id GROUP BY j.app_id, j.job_id, j.execution_id, j.status, j.description""")
def event_log_jobs(v):
    j = eventlog.jobs(landed_events(v, "tasks", "jobs", "stages"))
    return j.select(
        "app_id", "job_id", "execution_id", "status", "description", "num_tasks", "num_completed_tasks", "num_failed_tasks", "num_failed_stages"
    )


@query("event_log_executors", """
WITH t AS (SELECT app_id, executor_id, CAST(sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS done,
                  CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(gc_ms) AS BIGINT) AS gc FROM fx_tasks GROUP BY app_id, executor_id)
SELECT e.app_id, e.executor_id, e.host_port, e.is_active, e.is_excluded, e.add_ms, e.remove_ms, e.remove_reason, e.total_cores, e.max_memory,
       coalesce(t.done, 0) AS completed_tasks, coalesce(t.failed, 0) AS failed_tasks, coalesce(t.gc, 0) AS total_gc_time
FROM fx_executors e LEFT JOIN t ON e.app_id = t.app_id AND e.executor_id = t.executor_id""")
def event_log_executors(v):
    e = eventlog.executors(landed_events(v, "tasks", "executors"))
    return e.select(
        "app_id", "executor_id", "host_port", "is_active", "is_excluded", "add_ms", "remove_ms", "remove_reason", "total_cores", "max_memory",
        "completed_tasks", "failed_tasks", "total_gc_time",
    )


@query("event_log_sql", """
SELECT q.app_id, q.execution_id, q.status, q.description, q.submitted_ms, CASE WHEN q.status = 'RUNNING' THEN 0 ELSE q.duration_ms END AS duration_ms,
       CASE WHEN q.status = 'FAILED' THEN coalesce(q.error_message, 'failed') END AS error_message, coalesce(j.jobs, 0) AS jobs, coalesce(j.failed_jobs, 0) AS failed_jobs
FROM fx_sql q LEFT JOIN (SELECT j.app_id, j.execution_id, count(*) AS jobs, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed_jobs
  FROM fx_jobs j WHERE EXISTS (SELECT 1 FROM fx_job_stages b WHERE b.app_id = j.app_id AND b.job_id = j.job_id) GROUP BY j.app_id, j.execution_id) j
  ON q.app_id = j.app_id AND q.execution_id = j.execution_id""")
def event_log_sql(v):
    events = landed_events(v, "jobs", "sql")
    per = eventlog.sql_jobs(events).groupBy("app_id", "execution_id").agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("state") == "failed").alias("failed_jobs")
    )
    rows = eventlog.sql(events).join(per, ["app_id", "execution_id"], "left").fillna(0, ["jobs", "failed_jobs"])
    return rows.select("app_id", "execution_id", "status", "description", "submitted_ms", "duration_ms", "error_message", "jobs", "failed_jobs")


@query("progress_from_event_log", """
SELECT app_id, query_id, run_id, name, batch_id, started_ms, num_input_rows, input_rps, processed_rps, trigger_ms, state_rows, state_bytes, rows_dropped, watermark_ms
FROM fx_progress""")
def progress_from_event_log(v):
    p = eventlog.progress(eventlog.events_of(progress_lines(v)))
    return p.select(
        "app_id", "query_id", "run_id", "name", "batch_id", "started_ms", "num_input_rows", "input_rps", "processed_rps", "trigger_ms",
        "state_rows", "state_bytes", "rows_dropped", "watermark_ms",
    )


def application_events(v):
    """Start, version, end and settings of the fleet's applications."""
    started = F.unix_millis(F.to_timestamp(F.substring("start_time", 1, 19), "yyyy-MM-dd'T'HH:mm:ss"))
    apps = v.fx_apps.withColumn("_at", started)
    start = _event(
        apps, "SparkListenerApplicationStart", _as("name", "App Name"), _as("app_id", "App ID"), _as("_at", "Timestamp"), _as("spark_user", "User"),
        F.lit("1").alias("App Attempt ID"),
    )
    version = _event(apps, "SparkListenerLogStart", _as("version", "Spark Version"))
    end = _event(apps.where("completed"), "SparkListenerApplicationEnd", (F.col("_at") + F.col("duration_ms")).alias("Timestamp"))
    spark_env = v.fx_env.where("section = 'spark'").groupBy("app_id", "key").agg(F.min("value").alias("value"))
    props = spark_env.groupBy("app_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("Spark Properties"))
    settings = _event(props, "SparkListenerEnvironmentUpdate", F.col("Spark Properties"))
    return union_all([start, version, end, settings])


_EL_COUNTS = """
started AS (SELECT a.*, coalesce(j.jobs, 0) AS jobs, coalesce(j.failed, 0) AS jobs_failed, coalesce(s.stages, 0) AS stages, coalesce(s.failed, 0) AS stages_failed,
         coalesce(e.alive, 0) AS alive, coalesce(e.seen, 0) AS seen, coalesce(e.cores, 0) AS cores FROM fx_apps a
  LEFT JOIN (SELECT app_id, count(*) AS jobs, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM run_jobs GROUP BY app_id) j ON a.app_id = j.app_id
  LEFT JOIN (SELECT app_id, count(*) AS stages, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM el_stages GROUP BY app_id) s ON a.app_id = s.app_id
  LEFT JOIN (SELECT app_id, CAST(sum(CASE WHEN is_active THEN 1 ELSE 0 END) AS BIGINT) AS alive, count(*) AS seen,
                    CAST(sum(CASE WHEN is_active THEN total_cores ELSE 0 END) AS BIGINT) AS cores FROM fx_executors GROUP BY app_id) e ON a.app_id = e.app_id)"""
_EL_FAILED = """
el_tasks AS (SELECT app_id, executor_id, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM fx_tasks GROUP BY app_id, executor_id)"""


_EL_SUMMARY = f"""WITH {_EL_STAGES}, {_EL_COUNTS}, {_EL_FAILED}
SELECT app_id, 'Application' AS section, name || ' [' || app_id || '] @ event log' AS line FROM started
UNION ALL SELECT app_id, 'Application', jobs || ' jobs (' || jobs_failed || ' failed) · ' || stages || ' stages (' || stages_failed || ' failed) · '
  || alive || ' executors alive of ' || seen || ' seen · ' || cores || ' cores' FROM started
UNION ALL SELECT app_id, 'Executors', 'executor ' || executor_id || ' lost (' || host_port || ') — '
  || coalesce(nullif(trim({failure_queries._DETAIL.format('remove_reason')}), ''), 'no reason reported') FROM fx_executors WHERE NOT is_active
UNION ALL SELECT e.app_id, 'Executors', 'executor ' || e.executor_id || ' excluded after ' || coalesce(t.failed, 0) || ' failed tasks'
  FROM fx_executors e LEFT JOIN el_tasks t ON e.app_id = t.app_id AND e.executor_id = t.executor_id WHERE e.is_excluded
UNION ALL SELECT app_id, 'Key settings', key || ' = ' || min(value)
  FROM fx_env WHERE section = 'spark' AND key IN ('spark.executor.memory', 'spark.memory.fraction', 'spark.serializer') GROUP BY app_id, key
-- One line for each query with progress, and one for the query that executions name.
UNION ALL SELECT app_id, 'Streaming', count(*) || ' lines' FROM (SELECT DISTINCT app_id, query_id FROM fx_progress
  UNION ALL SELECT DISTINCT app_id, split_part(description, chr(10), 1) FROM fx_sql WHERE description LIKE '%batch = %') q GROUP BY app_id"""


@query("event_log_summary", _EL_SUMMARY)
def event_log_summary(v):
    """Event log files written, read back, and summed up."""
    path = scratch_path(v.spark, "history")
    lines = union_all([application_events(v), event_lines(v), progress_lines(v)])
    # The fleet has three applications, and a rolling log is a folder of files. Logs are compressed, as Spark's are.
    apps = ("app-0", "app-1", "app-2")
    with ev.open_files(v.spark, len(apps)):
        lines.where(F.col("app_id").isin(*apps)).select("app_id", "value").write.partitionBy("app_id").option("compression", "gzip").text(path)
    for app in apps:
        rename(v.spark, f"{path}/app_id={app}", f"{path}/eventlog_v2_{app}")
    tables = eventlog.read_event_logs(v.spark, path, scratch_path(v.spark, "landed"))
    # All tables read what was landed.
    delete(v.spark, path)
    return _compared(v, tables)


@query("event_log_increments", _EL_SUMMARY)
def event_log_increments(v):
    """The same summary from tables kept up in three pieces, each with a part of every kind of event."""
    lines = union_all([application_events(v), event_lines(v), progress_lines(v)]).withColumn("pos", F.struct(
        F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("block"), F.xxhash64("value").alias("row"),
    ))
    # Pieces are folders, so that each is read alone.
    path = scratch_path(v.spark, "events")
    pieces = eventlog.events_of(lines).withColumn("piece", F.pmod("pos.row", F.lit(3)))
    with ev.open_files(v.spark, 3):
        pieces.write.partitionBy("piece").option("compression", "zstd").parquet(path)
    events = v.spark.read.parquet(path)
    store = EventTables(v.spark, scratch_path(v.spark, "event-tables"), buckets=4)
    for number in range(3):
        store.add(events.where(F.col("piece") == number), number)
    # The store has all it needs of them.
    delete(v.spark, path)
    return _compared(v, store.tables())


def _compared(v, tables):
    """Summary lines; those of streaming are counted, the rest is compared line by line."""
    rows = written(v.spark, report.event_log_summary(v.spark, tables, stored=eventlog.STORED), "event-log-summary")
    fixed = (
        (F.col("section") == "Application") & F.col("ord").isin(0, 2) | (F.col("section") == "Executors") & F.col("ord").isin(0, 1)
        | (F.col("section") == "Key settings")
    )
    streaming = rows.where("section = 'Streaming' AND line LIKE '% batches · trigger mean %'").groupBy("app_id", "section").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" lines")).alias("line")
    )
    return rows.where(fixed).select("app_id", "section", "line").unionByName(streaming)


def _arrays(df, *fields):
    """REST answers: each row as a JSON array of one object."""
    return df.select("app_id", F.to_json(F.array(F.struct(*fields))).alias("json"))


# Objects of a dump are spread over two attempts and three polls by their number.
_POLL_START = 1704067200000


def _dumped(v, entity, df, number, *fields):
    """Objects written as dump files by app, attempt and poll; the folder they are in."""
    path = scratch_path(v.spark, f"dump-{entity}")
    n = F.col(number).cast("long")
    rows = df.select(
        "app_id", (1 + n % 2).alias("app_attempt"), (_POLL_START + 60000 * (n % 3)).alias("poll_ts"), F.to_json(F.array(F.struct(*fields))).alias("value")
    )
    rows.write.partitionBy("app_id", "app_attempt", "poll_ts").text(path)
    return path


def _polled(tab, table, number, text, flag, n, at="NULL"):
    """The check's rows of one entity."""
    return f"""SELECT '{tab}' AS tab, app_id, CAST(1 + CAST({number} AS BIGINT) % 2 AS INTEGER) AS app_attempt, {_POLL_START} + 60000 * (CAST({number} AS BIGINT) % 3) AS poll_ts,
       CAST({number} AS STRING) AS id, {text} AS text, {flag} AS flag, {n} AS n, {at} AS at_ms FROM {table}"""


_SNAPSHOT = " UNION ALL ".join([
    _polled("executors", "fx_executors", "executor_id", "host_port", "is_excluded", "memory_used", "remove_ms"),
    _polled("stages", "fx_stages", "stage_id", "coalesce(failure_reason, '')", "status = 'FAILED'", "executor_run_time"),
    _polled("jobs", "fx_jobs", "job_id", "coalesce(description, '')", "status = 'FAILED'", "num_completed_tasks"),
    _polled("tasks", "fx_tasks", "task_id", "coalesce(error_message, '')", "speculative", "gc_ms"),
    _polled("sql_jobs", "fx_sql_jobs", "execution_id", "state", "TRUE", "job_id"),
    _polled("rdds", "fx_rdds", "rdd_id", "name", "num_cached_partitions < num_partitions", "memory_used"),
])


@query("snapshot_json_tables", f"""{_SNAPSHOT}
UNION ALL SELECT 'applications', app_id, NULL, NULL, app_id, name || ' ' || spark_user || ' ' || version || ' ' || start_time, completed, duration_ms, NULL FROM fx_apps""")
def snapshot_json_tables(v):
    """All entities written as dump files and read back, with the app, attempt and poll of each."""
    when = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'GMT'")
    ids = lambda s, name: F.when(F.col("state") == s, F.array("job_id")).otherwise(F.array().cast("array<bigint>")).alias(name)
    dumps = {
        "executors": _dumped(
            v, "executors", v.fx_executors, "executor_id", _as("executor_id", "id"), _as("host_port", "hostPort"), _as("is_excluded", "isBlacklisted"),
            _as("memory_used", "memoryUsed"), when("remove_ms").alias("removeTime"), F.lit("x").alias("unknownField"),
        ),
        "stages": _dumped(
            v, "stages", v.fx_stages, "stage_id", _as("stage_id", "stageId"), "status", _as("failure_reason", "failureReason"), _as("executor_run_time", "executorRunTime")
        ),
        "jobs": _dumped(v, "jobs", v.fx_jobs, "job_id", _as("job_id", "jobId"), "status", "description", _as("num_completed_tasks", "numCompletedTasks")),
        "tasks": _dumped(
            v, "tasks", v.fx_tasks, "task_id", _as("task_id", "taskId"), "attempt", "speculative", _as("error_message", "errorMessage"),
            F.struct(_as("gc_ms", "jvmGcTime")).alias("taskMetrics"),
        ),
        "sql": _dumped(
            v, "sql", v.fx_sql_jobs, "execution_id", _as("execution_id", "id"), ids("running", "runningJobIds"), ids("success", "successJobIds"), ids("failed", "failedJobIds")
        ),
        "rdds": _dumped(
            v, "rdds", v.fx_rdds, "rdd_id", _as("rdd_id", "id"), "name", _as("num_partitions", "numPartitions"),
            _as("num_cached_partitions", "numCachedPartitions"), _as("memory_used", "memoryUsed"),
        ),
    }
    read = {entity: rest.read_snapshot(v.spark, path, entity, multi_line=False) for entity, path in dumps.items()}
    attempt = F.struct(_as("spark_user", "sparkUser"), _as("version", "appSparkVersion"), _as("start_time", "startTime"), _as("duration_ms", "duration"), "completed")
    listed = rest.applications(rest.parse_entities(_arrays(v.fx_apps, _as("app_id", "id"), "name", F.array(attempt).alias("attempts")).drop("app_id"), "applications"))

    def shape(df, tab, id_col, text, flag, n, at=None):
        at_ms = F.lit(None).cast("long") if at is None else F.col(at)
        return df.select(
            F.lit(tab).alias("tab"), "app_id", "app_attempt", "poll_ts", F.col(id_col).cast("string").alias("id"), text.alias("text"),
            flag.alias("flag"), F.col(n).alias("n"), at_ms.alias("at_ms"),
        )

    failed, named = F.col("status") == "FAILED", lambda c: F.coalesce(c, F.lit(""))
    listed = listed.withColumn("app_attempt", F.lit(None).cast("int")).withColumn("poll_ts", F.lit(None).cast("long"))
    return union_all([
        shape(read["executors"], "executors", "executor_id", F.col("host_port"), F.col("is_excluded"), "memory_used", "remove_ms"),
        shape(read["stages"], "stages", "stage_id", named("failure_reason"), failed, "executor_run_time"),
        shape(read["jobs"], "jobs", "job_id", named("description"), failed, "num_completed_tasks"),
        shape(read["tasks"], "tasks", "task_id", named("error_message"), F.col("speculative"), "gc_ms"),
        shape(rest.sql_jobs(read["sql"], *rest.DUMP), "sql_jobs", "execution_id", F.col("state"), F.lit(True), "job_id"),
        shape(read["rdds"], "rdds", "rdd_id", F.col("name"), F.col("num_cached_partitions") < F.col("num_partitions"), "memory_used"),
        shape(listed, "applications", "app_id", F.concat_ws(" ", "name", "spark_user", "version", "start_time"), F.col("completed"), "duration_ms"),
    ])


@query("metrics_registry", """
SELECT app_id, poll_s, key, source, name, kind, value, CASE WHEN kind IN ('meter', 'timer') THEN m1_rate END AS m1_rate,
       CASE WHEN kind = 'timer' THEN 'milliseconds' END AS units FROM fx_metrics""")
def metrics_registry(v):
    m = v.fx_metrics
    section = F.concat("kind", F.lit("s"))
    body = (
        F.when(F.col("kind") == "gauge", F.to_json(F.struct("value")))
        .when(F.col("kind") == "counter", F.to_json(F.struct(F.col("value").alias("count"))))
        .when(F.col("kind") == "meter", F.to_json(F.struct(F.col("value").alias("count"), "m1_rate")))
        .otherwise(F.to_json(F.struct(F.col("value").alias("count"), "m1_rate", F.lit("milliseconds").alias("duration_units"))))
    )
    entry = F.concat(F.lit('{"'), section, F.lit('":{"ns.'), "app_id", F.lit(".driver."), "key", F.lit('":'), body, F.lit("}}"))
    parsed = registry_json.with_named_fields(registry_json.parse_metrics(m.select("app_id", "poll_s", entry.alias("json"))))
    return parsed.select("app_id", "poll_s", "key", "source", "name", "kind", "value", "m1_rate", "units")


@query("thread_dumps", r"""
SELECT app_id, executor_id, thread_id, thread_name, thread_state, lock_name, len(list_filter(string_split(stack_text, chr(10)), lambda x: trim(x) <> '')) AS frames,
       trim(list_filter(string_split(stack_text, chr(10)), lambda x: trim(x) <> '')[1]) AS first_frame
FROM fx_threads""")
def thread_dumps(v):
    from ..operators.threads import with_frames

    t = with_frames(v.fx_threads)
    shape = F.col("thread_id") % 3
    head = [_as("thread_id", "threadId"), _as("thread_name", "threadName"), _as("thread_state", "threadState"), _as("lock_name", "lockName")]
    dump = lambda df, stack: df.select("app_id", "executor_id", F.to_json(F.array(F.struct(*head, stack.alias("stackTrace")))).alias("json"))
    dumps = union_all([
        dump(t.where(shape == 0), F.struct(F.col("frames").alias("elems"))),
        dump(t.where(shape == 1), F.col("frames")),
        dump(t.where(shape == 2), F.col("stack_text")),
    ])
    rows = rest.threads(rest.parse_entities(dumps, "threads"), "app_id", "executor_id")
    return rows.select(
        "app_id", "executor_id", "thread_id", "thread_name", "thread_state", "lock_name",
        F.size("frames").cast("long").alias("frames"), F.get("frames", F.lit(0)).alias("first_frame"),
    )


@query("environment_tables", f"""
SELECT app_id, CAST(2 AS INTEGER) AS app_attempt, {_POLL_START} + 60000 * (length(key) % 3) AS poll_ts, 'property' AS what, section, key, value FROM fx_env
UNION ALL SELECT app_id, CAST(1 + profile_id % 2 AS INTEGER), {_POLL_START} + 60000 * (profile_id % 3), 'profile', CAST(profile_id AS STRING), resource, CAST(amount AS STRING) FROM fx_profiles""")
def environment_tables(v):
    """Environments written as dump files and read back, with the app, attempt and poll of each."""
    pair = lambda s, name: F.when(F.col("section") == s, F.array(F.array("key", "value"))).alias(name)
    # An odd number (attempt 2) with the remainder by 3 of the key's length (the poll).
    env = v.fx_env.withColumn("n", F.length("key").cast("long") * 4 % 6 + 3)
    resources = F.create_map(F.col("resource"), F.struct(_as("resource", "resourceName"), "amount"))
    props = _dumped(v, "environment", env, "n", *[pair(s, c) for s, c in rest.ENV_SECTIONS if s != "classpath"])
    prof = _dumped(v, "profiles", v.fx_profiles, "profile_id", F.array(F.struct(_as("profile_id", "id"), resources.alias("executorResources"))).alias("resourceProfiles"))
    rows = rest.read_environment(v.spark, props, multi_line=False)["env_properties"]
    profiles = rest.read_environment(v.spark, prof, multi_line=False)["resource_profiles"]
    keys = ["app_id", "app_attempt", "poll_ts"]
    return rows.select(*keys, F.lit("property").alias("what"), "section", "key", "value").unionByName(
        profiles.select(
            *keys, F.lit("profile").alias("what"), F.col("profile_id").cast("string").alias("section"),
            F.col("resource").alias("key"), F.col("amount").cast("string").alias("value"),
        )
    )


@query("log_lines", r"""
SELECT source, CAST(sum(len(string_split_regex(text, '\r\n|\r|\n'))) AS BIGINT) AS lines, CAST(sum(strlen(regexp_replace(text, '[\r\n]', '', 'g'))) AS BIGINT) AS bytes,
       CAST(0 AS BIGINT) AS misnumbered FROM {documents} GROUP BY source""")
def log_lines(v):
    path = scratch_path(v.spark, "logs")
    v.documents.select("source", "text").write.partitionBy("source").text(path)
    lines = logfiles.read_logs(v.spark, path).withColumn("source", F.regexp_extract("file", r"/source=([^/]+)/", 1))
    files = lines.groupBy("source", "file").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line")).alias("bytes"),
        F.min("line_no").alias("_lo"), F.max("line_no").alias("_hi"),
    )
    wrong = F.count_if((F.col("_lo") != 0) | (F.col("_hi") != F.col("lines") - 1))
    return files.groupBy("source").agg(wrong.alias("misnumbered"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
