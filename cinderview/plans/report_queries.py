"""The composite reports."""

from pyspark.sql import functions as F

from ..operators import batches as bt, logs, report, stats
from ..session import scratch_path, written
from ..sources import sinks
from . import batch_queries as bq, failure_queries as fq, log_queries as lq, resource_queries as rq, stage_queries as sq
from .registry import query

AS_OF = rq.AS_OF


def bytes_sql(x):
    """SQL text of a byte count."""
    steps = "".join(
        f" WHEN ({x}) < {1024 ** (i + 1)} THEN printf('%.1f', CAST(({x}) AS DOUBLE) / {1024 ** i}) || ' {u}'"
        for i, u in enumerate(["KiB", "MiB", "GiB", "TiB"], 1)
    )
    return f"CASE WHEN ({x}) <= 0 THEN '0 B' WHEN ({x}) < 1024 THEN CAST(({x}) AS STRING) || ' B'{steps} ELSE printf('%.1f', CAST(({x}) AS DOUBLE) / {1024 ** 5}) || ' PiB' END"


def time_sql(x):
    """SQL text of a duration in ms."""
    s = f"CAST(floor(({x}) / 1000) AS BIGINT)"
    i = lambda e: f"CAST(CAST(floor({e}) AS BIGINT) AS STRING)"
    two = lambda e: f"lpad({i(e)}, 2, '0')"
    return (
        f"CASE WHEN ({x}) <= 0 THEN '-' WHEN {s} >= 3600 THEN {i(f'{s} / 3600')} || 'h' || {two(f'{s} % 3600 / 60')} || 'm' "
        f"WHEN {s} >= 60 THEN {i(f'{s} / 60')} || 'm' || {two(f'{s} % 60')} || 's' WHEN {s} > 0 THEN {i(s)} || '.' || {i(f'({x}) % 1000 / 100')} || 's' "
        f"ELSE {i(x)} || 'ms' END"
    )


_APP_COUNTS = """
app_counts AS (
  SELECT a.*, coalesce(j.jobs, 0) AS jobs, coalesce(j.failed, 0) AS jobs_failed, coalesce(s.stages, 0) AS stages, coalesce(s.failed, 0) AS stages_failed,
         coalesce(e.alive, 0) AS executors_alive, coalesce(e.seen, 0) AS executors_seen, coalesce(e.cores, 0) AS cores
  FROM fx_apps a
  LEFT JOIN (SELECT app_id, count(*) AS jobs, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM fx_jobs GROUP BY app_id) j ON a.app_id = j.app_id
  LEFT JOIN (SELECT app_id, count(*) AS stages, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM fx_stages GROUP BY app_id) s ON a.app_id = s.app_id
  LEFT JOIN (SELECT app_id, CAST(sum(CASE WHEN is_active THEN 1 ELSE 0 END) AS BIGINT) AS alive, count(*) AS seen,
                    CAST(sum(CASE WHEN is_active THEN total_cores ELSE 0 END) AS BIGINT) AS cores FROM fx_executors GROUP BY app_id) e ON a.app_id = e.app_id)"""


@query("app_summary", f"WITH {_APP_COUNTS} SELECT * FROM app_counts")
def app_summary(v):
    return report.app_summary(v.fx_apps, v.fx_jobs, v.fx_stages, v.fx_executors)


def summary_metrics(v):
    """Metric rows with the numbers the report reads by name."""
    return (
        v.fx_metrics.withColumn("text", F.lit(None).cast("string"))
        .withColumn("units", F.lit("milliseconds"))
        .withColumn("m5_rate", F.lit(None).cast("double"))
        .withColumn("mean_rate", F.col("mean"))
        .withColumn("p50", F.lit(0.0))
        .withColumn("p95", F.col("value") * 3)
        .withColumn("max", F.col("value"))
    )


def summary(v, failures=None, measures=sq.MEASURES):
    """The fleet summary; failures and batches feed several sections and are written once."""
    if failures is None:
        failures = written(v.spark, fq.fleet_failures(v), "summary-failures")
    batches = written(v.spark, bq.merged_batches(v), "summary-batches")
    return report.fleet_summary(
        v.fx_apps, v.fx_jobs, v.fx_stages, v.fx_tasks, v.fx_executors, rq.budgeted(v), v.fx_rdds, failures, batches,
        summary_metrics(v), v.fx_env, measures,
    )


_BLANK = "chr(1)"
_SUMMARY = f"""{fq._LOG}, {fq._REASONS}, {sq._LONG}, {sq._SLOWEST}, {rq._WORST_GC}, {rq._BUDGET}, {bq._MERGED}, {bq._SNAPSHOT}, {bq._BEHIND}, {_APP_COUNTS},
kinds AS (SELECT app_id, kind, count(*) AS n FROM failures GROUP BY app_id, kind),
pressure AS (SELECT *, CAST(peak_heap AS DOUBLE) / heap AS heap_ratio FROM budget WHERE CAST(peak_heap AS DOUBLE) / heap >= 0.9),
names AS (SELECT app_id, query_id, coalesce(max(name), substring(query_id, 1, 8)) AS label FROM kept GROUP BY app_id, query_id),
fails AS (SELECT app_id, query_id, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM kept GROUP BY app_id, query_id),
slow3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id, query_id ORDER BY duration_ms DESC, batch_id) AS place FROM kept) k WHERE place <= 3),
now_metrics AS (SELECT m.* FROM fx_metrics m JOIN (SELECT app_id, max(poll_s) AS poll_s FROM fx_metrics GROUP BY app_id) l ON m.app_id = l.app_id AND m.poll_s = l.poll_s),
own AS (SELECT *, count(*) OVER (PARTITION BY app_id, source) AS n
        FROM now_metrics WHERE source NOT IN ('LiveListenerBus', 'DAGScheduler', 'JVMCPUTime')),
summary AS (
  SELECT app_id, 1 AS section_no, 'Application' AS section, 0 AS ord, name || ' [' || app_id || '] @ history' AS line FROM app_counts
  UNION ALL SELECT app_id, 1, 'Application', 1, 'user ' || spark_user || ' · Spark ' || version || ' · started ' || start_time || ' · '
    || CASE WHEN completed THEN 'ran for' ELSE 'up for' END || ' ' || {time_sql('duration_ms')} FROM app_counts
  UNION ALL SELECT app_id, 1, 'Application', 2, jobs || ' jobs (' || jobs_failed || ' failed) · ' || stages || ' stages (' || stages_failed || ' failed) · '
    || executors_alive || ' executors alive of ' || executors_seen || ' seen · ' || cores || ' cores' FROM app_counts
  UNION ALL SELECT app_id, 2, 'Failures', 0, string_agg(n || ' ' || kind, ' · ' ORDER BY kind) FROM kinds GROUP BY app_id
  UNION ALL SELECT app_id, 2, 'Failures', rank, n || '× ' || reason || '  (e.g. ' || example || ')' FROM top_reasons
  UNION ALL SELECT s.app_id, 3, 'Slowest stages', s.rank, s.stage_id || '.' || s.attempt_id || ' ' || s.status || ' · '
    || CASE WHEN s.description IS NOT NULL THEN split_part(s.description, chr(10), 1) ELSE s.name END || ' · task time ' || {time_sql('s.executor_run_time')}
    || ' · ' || s.num_tasks || ' tasks · shuffle r ' || {bytes_sql('s.shuffle_read_bytes')} || ' w ' || {bytes_sql('s.shuffle_write_bytes')}
    || ' · spill ' || {bytes_sql('s.memory_bytes_spilled + s.disk_bytes_spilled')} || coalesce(' · SKEW ' || t.skew, '')
    FROM slowest s LEFT JOIN skew_texts t ON s.app_id = t.app_id AND s.stage_id = t.stage_id
  UNION ALL SELECT app_id, 4, 'Executors', 0, 'executor ' || executor_id || ' lost (' || host_port || ') — '
    || coalesce(nullif(trim({fq._DETAIL.format('remove_reason')}), ''), 'no reason reported') FROM fx_executors WHERE NOT is_active
  UNION ALL SELECT app_id, 4, 'Executors', 1, 'executor ' || executor_id || ' excluded after ' || failed_tasks || ' failed tasks' FROM fx_executors WHERE is_excluded
  UNION ALL SELECT app_id, 4, 'Executors', 2, 'GC: executor ' || executor_id || ' spent ' || printf('%.1f', gc_percent) || '% of task time in GC (worst of ' || of || ')' FROM worst_gc
  UNION ALL SELECT app_id, 4, 'Executors', 3, 'executor ' || executor_id || ': peak heap ' || {bytes_sql('peak_heap')} || ' is ' || printf('%.0f', heap_ratio * 100) || '% of spark.executor.memory' FROM pressure
  UNION ALL SELECT app_id, 5, 'Storage', 0, count(*) || ' cached RDDs · ' || {bytes_sql('CAST(sum(memory_used) AS BIGINT)')} || ' in memory · ' || {bytes_sql('CAST(sum(disk_used) AS BIGINT)')} || ' on disk'
    || CASE WHEN sum(CASE WHEN num_cached_partitions < num_partitions THEN 1 ELSE 0 END) > 0
            THEN ' · ' || CAST(sum(CASE WHEN num_cached_partitions < num_partitions THEN 1 ELSE 0 END) AS BIGINT) || ' only partially cached (recomputed on read)' ELSE '' END FROM fx_rdds GROUP BY app_id
  UNION ALL SELECT b.app_id, 6, 'Streaming', 0, n.label || ': ' || b.batches || ' batches · trigger mean ' || {time_sql('b.mean_ms')} || ' p95 ' || {time_sql('b.p95_ms')} || ' max ' || {time_sql('b.max_ms')}
    || CASE WHEN s.input_rps > 0 OR s.processed_rps > 0 THEN ' · in ' || printf('%.0f', s.input_rps) || '/s vs processed ' || printf('%.0f', s.processed_rps) || '/s' ELSE '' END
    || CASE WHEN h.with_input >= 3 AND h.slow >= 3 THEN ' · FALLING BEHIND' ELSE '' END
    || coalesce(' · watermark lag ' || CASE WHEN s.watermark_lag_ms IS NOT NULL THEN {time_sql('s.watermark_lag_ms')} END, '')
    || CASE WHEN f.failed > 0 THEN ' · ' || f.failed || ' failed batches' ELSE '' END
    FROM batch_stats b JOIN snapshot s ON b.app_id = s.app_id AND b.query_id = s.query_id JOIN fails f ON b.app_id = f.app_id AND b.query_id = f.query_id
    JOIN names n ON b.app_id = n.app_id AND b.query_id = n.query_id LEFT JOIN behind h ON b.app_id = h.app_id AND b.query_id = h.query_id
  UNION ALL SELECT app_id, 6, 'Streaming', 0, '  slowest: ' || string_agg('batch ' || batch_id || ' ' || {time_sql('duration_ms')}, ', ' ORDER BY place) FROM slow3 GROUP BY app_id, query_id
  UNION ALL SELECT app_id, 7, 'Metrics', 1, 'listener events dropped: ' || CASE WHEN value > 0 THEN {rq._num('value')}
    || ' — the UI/REST API has missed events; raise spark.scheduler.listenerbus.eventqueue.capacity  ⚠' ELSE '0' END FROM now_metrics WHERE source = 'LiveListenerBus'
  UNION ALL SELECT app_id, 7, 'Metrics', 2, 'scheduler message time p95: ' || {rq._num('(value * 3)')} || 'ms' || CASE WHEN value * 3 > 1000 THEN '  ⚠' ELSE '' END
    FROM now_metrics WHERE key = 'DAGScheduler.messageProcessingTime'
  UNION ALL SELECT DISTINCT app_id, 7, 'Metrics', 100, 'app source ' || source || ' (' || n || ' metrics):' FROM own
  UNION ALL SELECT app_id, 7, 'Metrics', 100, '  ' || name || ' = ' || {rq._num('value')} || CASE kind WHEN 'meter' THEN '  (' || {rq._num('m1_rate')} || '/s (1m) · 0/s (5m) · ' || {rq._num('mean')} || '/s mean)'
    WHEN 'timer' THEN '  (mean ' || {rq._num('mean')} || 'ms · p50 0ms · p95 ' || {rq._num('(value * 3)')} || 'ms · max ' || {rq._num('value')} || 'ms · ' || {rq._num('m1_rate')} || '/s)' ELSE '' END
    FROM own
  UNION ALL SELECT app_id, 8, 'Key settings', CASE key WHEN 'spark.executor.memory' THEN 1 WHEN 'spark.memory.fraction' THEN 7 ELSE 22 END, key || ' = ' || min(value)
    FROM fx_env WHERE section = 'spark' AND key IN ('spark.executor.memory', 'spark.memory.fraction', 'spark.serializer') GROUP BY app_id, key)"""


@query("fleet_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def fleet_summary(v):
    return summary(v).select("app_id", "section_no", "section", "ord", "line")


@query("summary_highlights", f"""WITH {_SUMMARY}
SELECT app_id, section, line, CASE WHEN contains(line, 'FAILED') OR contains(line, ' lost ') OR contains(line, 'FALLING BEHIND') OR contains(line, 'SKEW')
         OR contains(line, '% of spark.executor.memory') OR starts_with(line, 'GC:') THEN 'bad'
       WHEN contains(line, 'none seen') OR contains(line, 'all executors alive') THEN 'good' ELSE 'neutral' END AS mark FROM summary""")
def summary_highlights(v):
    return report.summary_highlights(summary(v)).select("app_id", "section", "line", "mark")


# The skew of the slowest stages is told of all ten task metrics.
_PLACES_OF_METRICS = "CASE metric WHEN 'duration' THEN 1 WHEN 'gc time' THEN 2 WHEN 'shuffle read' THEN 5 ELSE 8 END"
_PLACES_OF_ALL = "CASE metric " + " ".join(f"WHEN '{m}' THEN {i}" for i, (m, _) in enumerate(stats.TASK_METRICS)) + " END"
_SUMMARY_ALL = _SUMMARY.replace(sq._LONG, sq._QUANT_ALL).replace(_PLACES_OF_METRICS, _PLACES_OF_ALL)


@query("summary_markdown", f"""WITH {_SUMMARY_ALL},
per_section AS (SELECT app_id, section_no, section, count(*) AS lines, CAST(sum(length(line) + 3) AS BIGINT) AS chars FROM summary GROUP BY app_id, section_no, section),
totals AS (SELECT app_id, CAST(sum(lines) AS BIGINT) AS lines, CAST(23 + sum(chars + length(section) + 6) AS BIGINT) AS chars,
       string_agg(section, ', ' ORDER BY section_no) AS sections FROM per_section GROUP BY app_id),
markdown AS (
  SELECT DISTINCT app_id, 0 AS section_no, 0 AS part, 0 AS ord, '# Application summary' AS text FROM summary
  UNION ALL SELECT DISTINCT app_id, 0, 1, 0, '' FROM summary
  UNION ALL SELECT DISTINCT app_id, section_no, 0, 0, '## ' || section FROM summary
  UNION ALL SELECT DISTINCT app_id, section_no, 1, 0, '' FROM summary
  UNION ALL SELECT app_id, section_no, 2, ord, '- ' || line FROM summary
  UNION ALL SELECT DISTINCT app_id, section_no, 3, 0, '' FROM summary)
SELECT m.app_id, m.section_no, m.part, m.ord, m.text, t.lines, t.chars, t.sections FROM markdown m JOIN totals t ON m.app_id IS NOT DISTINCT FROM t.app_id""")
def summary_markdown(v):
    """Every line of each application's Markdown in reading order, next to its counts and sections."""
    rows = written(v.spark, summary(v, measures=sq.ALL_MEASURES), "summary")
    lines = report.summary_markdown(rows)
    text = F.col("text")
    head = F.when(text.startswith("## "), F.struct("section_no", F.substr(text, F.lit(4)).alias("name")))
    totals = lines.groupBy(F.col("app_id").alias("_app")).agg(
        F.count_if(text.startswith("- ")).alias("lines"),
        F.sum(F.length(text) + 1).alias("chars"),
        # Eight sections at most.
        F.array_sort(F.collect_list(head)).alias("_heads"),
    )
    # One row for each application.
    found = lines.join(F.broadcast(totals), F.col("app_id").eqNullSafe(F.col("_app"))).orderBy("app_id", "section_no", "part", "ord", "sub")
    return found.select("app_id", "section_no", "part", "ord", "text", "lines", "chars", F.array_join("_heads.name", ", ").alias("sections"))


@query("stage_report", f"""WITH {sq._LONG}, {sq._FLAGS}, {sq._PLACES}, {sq._SLOWEST},
late AS (SELECT t.app_id, t.stage_id, count(*) AS n FROM fx_tasks t JOIN quant q ON t.app_id = q.app_id AND t.stage_id = q.stage_id AND q.metric = 'duration'
         WHERE q.p50 >= 100 AND t.duration_ms >= 3 * q.p50 GROUP BY t.app_id, t.stage_id),
flagged AS (SELECT app_id, stage_id, count(*) AS n FROM flags WHERE reason <> '' GROUP BY app_id, stage_id)
SELECT s.app_id, s.stage_id, s.attempt_id, s.status, CAST(100.0 AS DOUBLE) * s.jvm_gc_time / s.executor_run_time AS gc_percent, p.tasks, p.line AS locality, p.mostly_remote,
       q.p50 AS median_ms, q.max AS max_ms, k.skew, coalesce(l.n, 0) AS stragglers, coalesce(f.n, 0) AS flagged_executors
FROM fx_stages s LEFT JOIN places p ON s.app_id = p.app_id AND s.stage_id = p.stage_id
LEFT JOIN quant q ON s.app_id = q.app_id AND s.stage_id = q.stage_id AND q.metric = 'duration'
LEFT JOIN skew_texts k ON s.app_id = k.app_id AND s.stage_id = k.stage_id
LEFT JOIN late l ON s.app_id = l.app_id AND s.stage_id = l.stage_id LEFT JOIN flagged f ON s.app_id = f.app_id AND s.stage_id = f.stage_id""")
def stage_report(v):
    rows = report.stage_report(v.fx_stages, v.fx_tasks, sq.marked_executors(v), sq.MEASURES)
    return rows.select(
        *stats.STAGE, "status", "gc_percent", "tasks", "locality", "mostly_remote", "median_ms", "max_ms", "skew", "stragglers", "flagged_executors"
    )


@query("stage_detail", f"""WITH {sq._LONG}, {sq._FLAGS}
SELECT app_id, stage_id, attempt_id, 'quantiles' AS part, metric AS subject, CAST(max AS BIGINT) AS amount,
       concat_ws(' ', CAST(CAST(p05 AS BIGINT) AS STRING), CAST(CAST(p25 AS BIGINT) AS STRING), CAST(CAST(p50 AS BIGINT) AS STRING), CAST(CAST(p75 AS BIGINT) AS STRING),
         CAST(CAST(p95 AS BIGINT) AS STRING), CASE WHEN ratio >= 3 THEN '×' || CASE WHEN ratio = CAST('inf' AS DOUBLE) THEN '∞' ELSE printf('%.1f', ratio) END END) AS note FROM skewed
UNION ALL SELECT app_id, stage_id, attempt_id, 'executors', executor_id, task_time, reason FROM flags
UNION ALL SELECT t.app_id, t.stage_id, t.attempt_id, 'slowest', CAST(t.task_id AS STRING), t.duration_ms,
    CASE WHEN q.p50 >= 100 AND t.duration_ms >= 3 * q.p50 THEN 'straggler ×' || printf('%.1f', t.duration_ms / greatest(q.p50, 1.0)) ELSE '' END
  FROM (SELECT *, row_number() OVER (PARTITION BY app_id, stage_id, attempt_id ORDER BY duration_ms DESC, task_id, attempt, executor_id) AS pos FROM fx_tasks) t
  LEFT JOIN quant q ON t.app_id = q.app_id AND t.stage_id = q.stage_id AND q.metric = 'duration' WHERE t.pos <= 20
UNION ALL SELECT app_id, stage_id, attempt_id, 'failed', CAST(task_id AS STRING), duration_ms, trim({fq._DETAIL.format('error_message')}) FROM fx_tasks WHERE status = 'FAILED'""")
def stage_detail(v):
    return report.stage_detail(v.fx_tasks, sq.marked_executors(v), sq.MEASURES)


# Micro-batches with progress or executions, and those that job and execution descriptions name.
_DESCRIBED = """
SELECT app_id, substring(split_part(description, chr(10), 2), 6) AS query_id, substring(split_part(description, chr(10), 3), 9) AS run_id,
       split_part(description, chr(10), 1) AS name, CAST(substring(split_part(description, chr(10), 4), 9) AS BIGINT) AS batch_id,
       execution_id, status, submitted_ms, duration_ms FROM fx_sql WHERE description LIKE '%batch = %'"""


_BOTH_SQL = f"""
SELECT app_id, query_id, run_id, name, batch_id, execution_id, status, submitted_ms, duration_ms FROM fx_batch_sql
UNION ALL ({_DESCRIBED})"""


@query("batch_report", f"""WITH {bq._JOB_BATCHES}, both_sql AS ({_BOTH_SQL}), {bq._MERGED.replace('fx_batch_sql', 'both_sql')}, {fq._LOG}, {lq._FILLED},
driver AS (SELECT * FROM filled WHERE executor_id = 'driver'),
begin_ms AS (SELECT app_id, min(stamp_ms) AS log_start_ms FROM driver GROUP BY app_id),
spans AS (SELECT *, CASE WHEN has_progress THEN started_ms ELSE submitted_ms END - 1000 AS from_ms, CASE WHEN has_progress THEN started_ms ELSE submitted_ms END
            + greatest(coalesce(CASE WHEN has_progress THEN greatest(trigger_ms, duration_ms) ELSE duration_ms END, 0), 0) + 1000 AS to_ms FROM merged),
stage_ids AS (SELECT DISTINCT k.app_id, k.query_id, k.batch_id, b.stage_id FROM merged k JOIN job_batches j ON j.app_id = k.app_id AND j.run_id = k.run_id AND j.batch_id = k.batch_id
              JOIN fx_job_stages b ON b.app_id = j.app_id AND b.job_id = j.job_id),
fails AS (SELECT DISTINCT * FROM (
  SELECT i.app_id, i.query_id, i.batch_id, f.key FROM failures f JOIN stage_ids i ON f.app_id = i.app_id AND f.stage_id = i.stage_id
  UNION ALL SELECT k.app_id, k.query_id, k.batch_id, f.key FROM failures f JOIN job_batches j ON f.app_id = j.app_id AND f.key = 'job:' || CAST(j.job_id AS STRING)
    JOIN merged k ON j.app_id = k.app_id AND j.run_id = k.run_id AND j.batch_id = k.batch_id
  UNION ALL SELECT k.app_id, k.query_id, k.batch_id, f.key FROM failures f JOIN sql_batches j ON f.app_id = j.app_id AND f.key = 'sql:' || CAST(j.execution_id AS STRING)
    JOIN merged k ON j.app_id = k.app_id AND j.run_id = k.run_id AND j.batch_id = k.batch_id) u),
n_stages AS (SELECT app_id, query_id, batch_id, count(*) AS n FROM stage_ids GROUP BY ALL),
n_fails AS (SELECT app_id, query_id, batch_id, count(*) AS n FROM fails GROUP BY ALL),
n_lines AS (SELECT s.app_id, s.query_id, s.batch_id, count(*) AS n FROM spans s JOIN driver f ON f.app_id = s.app_id
  AND (f.time_ms BETWEEN s.from_ms AND s.to_ms OR (s.from_ms IS NULL AND contains(lower(f.line), 'batch ' || CAST(s.batch_id AS STRING)))) GROUP BY ALL)
SELECT k.app_id, k.query_id, k.batch_id, k.status, k.duration_ms, t.p95_ms > 0 AND k.duration_ms > t.p95_ms AS slow,
       CASE WHEN t.mean_ms > 0 THEN CAST(k.duration_ms AS DOUBLE) / t.mean_ms ELSE 0 END AS vs_mean,
       k.input_rps, k.processed_rps, coalesce(k.num_input_rows > 0 AND k.processed_rps < k.input_rps, FALSE) AS behind,
       coalesce(p.add_batch_ms, 0) AS add_batch_ms, coalesce(p.planning_ms + p.state_rows, 0) AS overhead_ms,
       coalesce(NOT k.has_progress AND x.to_ms < g.log_start_ms, FALSE) AS before_log,
       coalesce(s.n, 0) AS stages, coalesce(f.n, 0) AS failures, coalesce(l.n, 0) AS log_lines
FROM merged k JOIN batch_stats t ON k.app_id = t.app_id AND k.query_id = t.query_id
JOIN spans x ON k.app_id = x.app_id AND k.query_id = x.query_id AND k.batch_id = x.batch_id
LEFT JOIN begin_ms g ON k.app_id = g.app_id
LEFT JOIN fx_progress p ON k.has_progress AND k.app_id = p.app_id AND k.query_id = p.query_id AND k.run_id = p.run_id AND k.batch_id = p.batch_id
LEFT JOIN n_stages s ON k.app_id = s.app_id AND k.query_id = s.query_id AND k.batch_id = s.batch_id
LEFT JOIN n_fails f ON k.app_id = f.app_id AND k.query_id = f.query_id AND k.batch_id = f.batch_id
LEFT JOIN n_lines l ON k.app_id = l.app_id AND k.query_id = l.query_id AND k.batch_id = l.batch_id""")
def batch_report(v):
    phases = F.create_map(
        F.lit("addBatch"), F.col("add_batch_ms"), F.lit("triggerExecution"), F.col("trigger_ms"),
        F.lit("queryPlanning"), F.col("planning_ms"), F.lit("walCommit"), F.col("state_rows"),
    )
    progress = v.fx_progress.withColumn("phases", phases).drop("add_batch_ms", "planning_ms")
    batches = written(v.spark, bt.merge_batches(progress, v.sql(_BOTH_SQL)), "report-batches")
    failures = written(v.spark, fq.fleet_failures(v), "report-failures")
    rows = report.batch_report(batches, v.fx_jobs, v.fx_job_stages, failures, v.fx_sql, v.fx_log_lines)
    return rows.select(
        "app_id", "query_id", "batch_id", "status", "duration_ms", "slow", "vs_mean", "input_rps", "processed_rps", "behind",
        "add_batch_ms", "overhead_ms", "before_log", "stages", "failures", "log_lines",
    )


_PROGRESS = "least(greatest(CAST({0} AS DOUBLE) / nullif({1}, 0), 0), 1)"


@query("running_progress", f"""
SELECT app_id, 'job' AS what, job_id AS id, CASE WHEN num_tasks > 0 THEN {_PROGRESS.format('(num_completed_tasks + num_skipped_tasks)', 'num_tasks')} ELSE 0 END AS progress
FROM fx_jobs WHERE status = 'RUNNING'
UNION ALL SELECT app_id, 'stage', stage_id, CASE WHEN num_tasks > 0 THEN {_PROGRESS.format('num_complete_tasks', 'num_tasks')} ELSE 0 END FROM fx_stages""")
def running_progress(v):
    what = lambda df, name, id_col: df.select("app_id", F.lit(name).alias("what"), F.col(id_col).alias("id"), "progress")
    jobs = report.progress_ratio(v.fx_jobs.where("status = 'RUNNING'"))
    return what(jobs, "job", "job_id").unionByName(what(report.stage_progress(v.fx_stages), "stage", "stage_id"))


@query("jobs_table", f"""WITH {bq._LABELS}, {bq._NAMES},
sizes AS (SELECT app_id, job_id, count(*) AS n FROM fx_job_stages GROUP BY app_id, job_id)
SELECT j.app_id, j.job_id, j.status, j.display_name AS name, CAST(j.num_completed_tasks AS STRING) || '/' || CAST(j.num_tasks AS STRING) AS tasks,
       j.num_failed_tasks AS failed, coalesce(s.n, 0) AS stages, {_PROGRESS.format('(num_completed_tasks + num_skipped_tasks)', 'num_tasks')} AS progress
FROM names j LEFT JOIN sizes s ON j.app_id = s.app_id AND j.job_id = s.job_id""")
def jobs_table(v):
    return report.jobs_table(bq.named_jobs(v), v.fx_job_stages)


@query("stages_table", f"""WITH {bq._LABELS}
SELECT s.app_id, CAST(s.stage_id AS STRING) || '.0' || CASE WHEN failure_reason IS NOT NULL THEN ' ✗' ELSE '' END AS stage, s.status,
       CASE WHEN s.description IS NOT NULL THEN split_part(s.description, chr(10), 1) WHEN l.label IS NOT NULL AND contains(s.name, '<unknown>') THEN l.label ELSE s.name END AS name,
       CAST(num_complete_tasks AS STRING) || '/' || CAST(num_tasks AS STRING) AS tasks, {bytes_sql('input_bytes')} AS input, {bytes_sql('shuffle_read_bytes')} AS shuffle_read,
       {bytes_sql('shuffle_write_bytes')} AS shuffle_write, {bytes_sql('memory_bytes_spilled')} AS spill, {_PROGRESS.format('num_complete_tasks', 'num_tasks')} AS progress
FROM fx_stages s LEFT JOIN stage_labels l ON s.app_id = l.app_id AND s.stage_id = l.stage_id""")
def stages_table(v):
    labels = bt.stage_labels(bt.job_labels(v.fx_sql, v.fx_sql_jobs), v.fx_job_stages)
    again = bt.restarted_queries(v.fx_jobs, v.fx_stages)
    return report.stages_table(report.named_stages(v.fx_stages, labels, again))


@query("executors_table", f"""
SELECT app_id, executor_id, CASE WHEN NOT is_active THEN 'dead' WHEN is_excluded THEN 'excl' ELSE 'up' END AS state,
       CASE WHEN NOT is_active AND remove_reason IS NOT NULL THEN host_port || ' · ' || split_part(remove_reason, chr(10), 1) ELSE host_port END AS host,
       CAST(active_tasks AS STRING) || '/' || CAST(total_cores AS STRING) AS tasks, failed_tasks AS failed,
       {bytes_sql('memory_used')} || ' / ' || {bytes_sql('max_memory')} AS storage, least(greatest(CAST(memory_used AS DOUBLE) / max_memory, 0), 1) AS memory_ratio,
       printf('%.1f', CASE WHEN total_duration > 0 THEN CAST(100.0 AS DOUBLE) * total_gc_time / total_duration ELSE CAST(0 AS DOUBLE) END) || '%' AS gc,
       {bytes_sql('total_shuffle_read')} AS shuffle_read,
       CASE WHEN remove_ms IS NOT NULL THEN 'gone ' || {time_sql(f'({AS_OF} - remove_ms)')} ELSE {time_sql(f'({AS_OF} - add_ms)')} END AS age
FROM fx_executors""")
def executors_table(v):
    return report.executors_table(v.fx_executors, AS_OF)


@query("sql_table", f"""
SELECT q.app_id, q.execution_id, q.status, split_part(q.description, chr(10), 1)
         || CASE WHEN q.description LIKE '%batch = %' THEN ' · batch ' || substring(split_part(q.description, chr(10), 4), 9) ELSE '' END AS query,
       '08:00:00' AS submitted, {time_sql('q.duration_ms')} AS duration,
       '▶' || coalesce(j.r, 0) || ' ✓' || coalesce(j.s, 0) || ' ✗' || coalesce(j.f, 0) AS jobs, coalesce(split_part(q.error_message, chr(10), 1), '') AS error
FROM fx_sql q LEFT JOIN (SELECT app_id, execution_id, CAST(sum(CASE WHEN state = 'running' THEN 1 ELSE 0 END) AS BIGINT) AS r, CAST(sum(CASE WHEN state = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS s,
  CAST(sum(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS f FROM fx_sql_jobs GROUP BY app_id, execution_id) j ON q.app_id = j.app_id AND q.execution_id = j.execution_id""")
def sql_table(v):
    sql = v.fx_sql.withColumn("submission_time", F.lit("2024-01-01T08:00:00.123GMT"))
    return report.sql_table(sql, v.fx_sql_jobs)


@query("applications_table", f"""
SELECT app_id, name, spark_user, substring(start_time, 1, 19) AS start, {time_sql('duration_ms')} AS duration,
       CASE WHEN completed THEN 'completed' ELSE 'running' END AS state, version FROM fx_apps""")
def applications_table(v):
    return report.applications_table(v.fx_apps)


@query("job_stages", """
SELECT b.app_id, b.job_id, s.stage_id, s.status FROM fx_job_stages b JOIN fx_jobs j ON b.app_id = j.app_id AND b.job_id = j.job_id
JOIN fx_stages s ON b.app_id = s.app_id AND b.stage_id = s.stage_id""")
def stages_of_job(v):
    return stats.job_stages(v.fx_jobs, v.fx_job_stages, v.fx_stages).select("app_id", "job_id", "stage_id", "status")


@query("job_stage_filter", """
SELECT b.app_id, b.job_id, s.stage_id FROM fx_job_stages b JOIN fx_jobs j ON b.app_id = j.app_id AND b.job_id = j.job_id
JOIN fx_stages s ON b.app_id = s.app_id AND b.stage_id = s.stage_id
WHERE contains(CAST(s.stage_id AS STRING) || '.' || CAST(s.attempt_id AS STRING), 'fail') OR contains(lower(s.status), 'fail') OR contains(lower(s.name), 'fail')""")
def job_stage_filter(v):
    return stats.stages_of_job(v.fx_stages, v.fx_job_stages, v.fx_jobs, needle="Fail").select("app_id", "job_id", "stage_id")


@query("job_order", "SELECT app_id, job_id, status FROM fx_jobs ORDER BY app_id, job_id DESC")
def job_order(v):
    return stats.job_order(v.fx_jobs).select("app_id", "job_id", "status")


@query("bundle_sink", f"""WITH {_SUMMARY}
SELECT 'failures' AS part, app_id, count(*) AS rows, CAST(sum(length(title)) AS BIGINT) AS chars FROM failures GROUP BY app_id
UNION ALL SELECT 'summary', app_id, count(*), CAST(sum(length(line)) AS BIGINT) FROM summary GROUP BY app_id
UNION ALL SELECT 'environment', app_id, count(*), CAST(sum(length(value)) AS BIGINT) FROM fx_env GROUP BY app_id
UNION ALL SELECT 'metrics', app_id, count(*), CAST(sum(length(key)) AS BIGINT) FROM fx_metrics GROUP BY app_id
UNION ALL SELECT 'streaming', app_id, count(*), CAST(sum(length(query_id)) AS BIGINT) FROM fx_progress GROUP BY app_id
UNION ALL SELECT 'snapshot_jobs', app_id, count(*), CAST(sum(length(status)) AS BIGINT) FROM fx_jobs GROUP BY app_id
UNION ALL SELECT 'snapshot_stages', app_id, count(*), CAST(sum(length(name)) AS BIGINT) FROM fx_stages GROUP BY app_id
UNION ALL SELECT 'snapshot_executors', app_id, count(*), CAST(sum(length(host_port)) AS BIGINT) FROM fx_executors GROUP BY app_id
UNION ALL SELECT 'logs', app_id, count(*), CAST(sum(length(line)) AS BIGINT) FROM fx_log_lines GROUP BY app_id""")
def bundle_sink(v):
    """The whole bundle written and read back: rows of each part, and the length of a text column of each."""
    path = scratch_path(v.spark, "bundle")
    text_of = {
        "failures": "title", "summary": "line", "environment": "value", "metrics": "key", "streaming": "query_id", "snapshot_jobs": "status",
        "snapshot_stages": "name", "snapshot_executors": "host_port", "logs": "line",
    }
    failures = written(v.spark, fq.fleet_failures(v), "bundle-failures")
    tables = {
        "failures": failures, "summary": summary(v, failures), "environment": v.fx_env, "metrics": v.fx_metrics, "streaming": v.fx_progress,
        "snapshot_jobs": v.fx_jobs, "snapshot_stages": v.fx_stages, "snapshot_executors": v.fx_executors,
    }
    sinks.write_bundle(tables, path, v.fx_log_lines)
    return sinks.bundle_contents(v.spark, path, text_of)
