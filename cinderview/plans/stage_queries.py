"""Queries over tasks and stages."""

from pyspark.sql import functions as F

from ..functions import filters
from ..operators import stats
from .registry import query

STAGE = stats.STAGE
MEASURES = {
    "duration": ("duration_ms", "ms"),
    "gc time": ("gc_ms", "ms"),
    "shuffle read": ("shuffle_read_bytes", "bytes"),
    "mem spill": ("spill_bytes", "bytes"),
}
ALL_COLUMNS = dict(zip([m for m, _ in stats.TASK_METRICS], [
    "duration_ms", "gc_ms", "scheduler_delay_ms", "input_bytes", "shuffle_read_bytes", "fetch_wait_ms", "shuffle_write_bytes", "spill_bytes",
    "disk_spill_bytes", "peak_memory",
]))
ALL_MEASURES = {m: (ALL_COLUMNS[m], unit) for m, unit in stats.TASK_METRICS}
_LONG_ALL = "long AS (" + " UNION ALL ".join(
    f"SELECT app_id, stage_id, attempt_id, '{m}' AS metric, {col} AS value, {stats.SKEW_FLOOR[dict(stats.TASK_METRICS)[m]]} AS floor FROM fx_tasks WHERE status = 'SUCCESS'"
    for m, col in ALL_COLUMNS.items()
) + ")"

_LONG = """
long AS (
  SELECT app_id, stage_id, attempt_id, 'duration' AS metric, duration_ms AS value, 1000.0 AS floor FROM fx_tasks WHERE status = 'SUCCESS'
  UNION ALL SELECT app_id, stage_id, attempt_id, 'gc time', gc_ms, 1000.0 FROM fx_tasks WHERE status = 'SUCCESS'
  UNION ALL SELECT app_id, stage_id, attempt_id, 'shuffle read', shuffle_read_bytes, 1048576.0 FROM fx_tasks WHERE status = 'SUCCESS'
  UNION ALL SELECT app_id, stage_id, attempt_id, 'mem spill', spill_bytes, 1048576.0 FROM fx_tasks WHERE status = 'SUCCESS'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY app_id, stage_id, attempt_id, metric ORDER BY value) - 1 AS rk,
         count(*) OVER (PARTITION BY app_id, stage_id, attempt_id, metric) AS n FROM long),
quant AS (
  SELECT app_id, stage_id, attempt_id, metric, max(n) AS n, max(floor) AS floor,
         max(CASE WHEN rk = least(floor(CAST(0.05 AS DOUBLE) * n), n - 1) THEN CAST(value AS DOUBLE) END) AS p05,
         max(CASE WHEN rk = least(floor(CAST(0.25 AS DOUBLE) * n), n - 1) THEN CAST(value AS DOUBLE) END) AS p25,
         max(CASE WHEN rk = least(floor(CAST(0.5 AS DOUBLE) * n), n - 1) THEN CAST(value AS DOUBLE) END) AS p50,
         max(CASE WHEN rk = least(floor(CAST(0.75 AS DOUBLE) * n), n - 1) THEN CAST(value AS DOUBLE) END) AS p75,
         max(CASE WHEN rk = least(floor(CAST(0.95 AS DOUBLE) * n), n - 1) THEN CAST(value AS DOUBLE) END) AS p95,
         max(CAST(value AS DOUBLE)) AS max
  FROM ranked GROUP BY app_id, stage_id, attempt_id, metric),
skewed AS (
  SELECT *, CASE WHEN max >= floor THEN CASE WHEN p50 > 0 THEN max / p50 ELSE CAST('inf' AS DOUBLE) END END AS ratio
  FROM quant)"""


_QUANT_ALL = _LONG_ALL + _LONG[_LONG.index(",\nranked AS"):]


@query("task_quantiles", f"WITH {_QUANT_ALL} SELECT app_id, stage_id, attempt_id, metric, n, p05, p25, p50, p75, p95, max FROM quant")
def task_quantiles(v):
    return stats.quantiles(stats.succeeded(v.fx_tasks), STAGE, ALL_COLUMNS)


@query("task_quantiles_all", f"WITH {_QUANT_ALL} SELECT app_id, stage_id, attempt_id, metric, n, p05, p25, p50, p75, p95, max FROM quant")
def task_quantiles_all(v):
    """All ten task metrics."""
    return stats.quantiles(stats.succeeded(v.fx_tasks), STAGE, ALL_COLUMNS)


@query("skew", f"""WITH {_LONG}
SELECT app_id, stage_id, attempt_id, metric, n, p50 AS median, max, ratio, coalesce(ratio >= 3, FALSE) AS flagged FROM skewed""")
def skew(v):
    return stats.skew(stats.succeeded(v.fx_tasks), STAGE, MEASURES)


@query("median_duration", f"""WITH {_LONG},
mid AS (SELECT *, row_number() OVER (PARTITION BY app_id, stage_id, attempt_id ORDER BY duration_ms) - 1 AS rk,
               count(*) OVER (PARTITION BY app_id, stage_id, attempt_id) AS n FROM fx_tasks WHERE status = 'SUCCESS'),
up AS (SELECT app_id, stage_id, attempt_id, max(CASE WHEN rk = floor(n / 2) THEN duration_ms END) AS upper
       FROM mid GROUP BY app_id, stage_id, attempt_id),
known AS (SELECT q.* FROM quant q JOIN fx_stages s ON q.app_id = s.app_id AND q.stage_id = s.stage_id
          WHERE s.status = 'COMPLETE' AND q.metric = 'duration')
SELECT s.app_id, s.stage_id, s.attempt_id, CAST(coalesce(k.p50, u.upper, 0) AS DOUBLE) AS median_ms
FROM fx_stages s LEFT JOIN known k ON s.app_id = k.app_id AND s.stage_id = k.stage_id
LEFT JOIN up u ON s.app_id = u.app_id AND s.stage_id = u.stage_id""")
def median_duration(v):
    done = v.fx_stages.where("status = 'COMPLETE'").select(*STAGE)
    tasks = v.fx_tasks
    summary = stats.quantiles(
        stats.succeeded(tasks).join(done, STAGE, "left_semi"), STAGE, {"duration": "duration_ms"}, {"p50": 0.5}
    )
    return stats.median_duration(tasks, summary)


@query("stragglers", f"""WITH {_LONG}
SELECT t.app_id, t.stage_id, t.attempt_id, t.task_id, t.executor_id, t.duration_ms, q.p50 AS median_ms,
       'straggler ×' || printf('%.1f', t.duration_ms / greatest(q.p50, 1.0)) AS note
FROM fx_tasks t JOIN quant q ON t.app_id = q.app_id AND t.stage_id = q.stage_id AND q.metric = 'duration'
WHERE q.p50 >= 100 AND t.duration_ms >= 3 * q.p50""")
def stragglers(v):
    tasks = v.fx_tasks
    found = stats.stragglers(tasks, STAGE, "duration_ms", of=stats.succeeded(tasks))
    return found.select(*STAGE, "task_id", "executor_id", "duration_ms", "median_ms", "note")


_ROLLUP = """
rollup AS (
  SELECT app_id, stage_id, attempt_id, executor_id, CAST(sum(duration_ms) AS BIGINT) AS task_time,
         CAST(sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded_tasks,
         CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed_tasks,
         CAST(0 AS BIGINT) AS killed_tasks,
         CAST(sum(shuffle_read_bytes) AS BIGINT) AS shuffle_read, CAST(sum(spill_bytes) AS BIGINT) AS memory_bytes_spilled
  FROM fx_tasks GROUP BY app_id, stage_id, attempt_id, executor_id)"""


@query("stage_executor_rollup", f"WITH {_ROLLUP} SELECT * FROM rollup")
def stage_executor_rollup(v):
    return stats.rollup_executors(v.fx_tasks)


_FLAGS = _ROLLUP + """,
marked AS (
  SELECT r.*, coalesce(e.is_excluded, FALSE) AS is_excluded, succeeded_tasks + r.failed_tasks + killed_tasks AS tasks
  FROM rollup r LEFT JOIN fx_executors e ON r.app_id = e.app_id AND r.executor_id = e.executor_id),
means AS (
  SELECT *, CAST(task_time AS DOUBLE) / tasks AS mean_ms,
         CAST(sum(task_time) OVER w AS DOUBLE) / CAST(sum(tasks) OVER w AS DOUBLE) AS stage_mean_ms
  FROM marked WINDOW w AS (PARTITION BY app_id, stage_id, attempt_id)),
flags AS (
  SELECT *, concat_ws(' · ', CASE WHEN failed_tasks > 0 THEN CAST(failed_tasks AS STRING) || ' failed' END,
                      CASE WHEN is_excluded THEN 'excluded' END,
                      CASE WHEN stage_mean_ms >= 100 AND mean_ms >= 2 * stage_mean_ms
                           THEN printf('%.1f', mean_ms / stage_mean_ms) || '× stage avg' END) AS reason
  FROM means)"""


def marked_executors(v):
    """Per stage and executor totals with the executor's exclusion flag."""
    state = v.fx_executors.select("app_id", "executor_id", "is_excluded")
    rows = stats.rollup_executors(v.fx_tasks).join(state, ["app_id", "executor_id"], "left")
    return rows.withColumn("is_excluded", F.coalesce("is_excluded", F.lit(False)))


@query("executor_flags", f"""WITH {_FLAGS}
SELECT app_id, stage_id, attempt_id, executor_id, task_time, tasks, mean_ms, stage_mean_ms, reason, reason <> '' AS flagged FROM flags""")
def executor_flags(v):
    flagged = stats.executor_order(stats.executor_flags(marked_executors(v)))
    return flagged.select(*STAGE, "executor_id", "task_time", "tasks", "mean_ms", "stage_mean_ms", "reason", "flagged")


_PLACES = """
per_level AS (
  SELECT app_id, stage_id, attempt_id, locality, count(*) AS n,
         CASE locality WHEN 'PROCESS_LOCAL' THEN 1 WHEN 'NODE_LOCAL' THEN 2 WHEN 'NO_PREF' THEN 3 WHEN 'RACK_LOCAL' THEN 4
              ELSE 5 END AS o
  FROM fx_tasks GROUP BY app_id, stage_id, attempt_id, locality),
places AS (
  SELECT app_id, stage_id, attempt_id, CAST(sum(n) AS BIGINT) AS tasks,
         'locality (of ' || CAST(CAST(sum(n) AS BIGINT) AS STRING) || ' tasks) '
           || string_agg(locality || ' ' || CAST(n AS STRING), ' · ' ORDER BY o) AS line,
         coalesce(sum(CASE WHEN locality = 'ANY' THEN n END), 0) * 2 > greatest(sum(n), 1) AS mostly_remote
  FROM per_level GROUP BY app_id, stage_id, attempt_id)"""


@query("locality", f"WITH {_PLACES} SELECT * FROM places")
def locality(v):
    return stats.locality(v.fx_tasks)


@query("failed_tasks", "SELECT app_id, stage_id, attempt_id, task_id, executor_id, error_message FROM fx_tasks WHERE status = 'FAILED'")
def failed_tasks(v):
    return stats.failed_tasks(v.fx_tasks).select(*STAGE, "task_id", "executor_id", "error_message")


@query("slowest_tasks", """
SELECT app_id, stage_id, attempt_id, task_id, executor_id, duration_ms, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY app_id, stage_id, attempt_id ORDER BY duration_ms DESC, task_id, attempt, executor_id) AS BIGINT) AS rank
  FROM fx_tasks) t WHERE rank <= 5""")
def slowest_tasks(v):
    top = stats.slowest_tasks(v.fx_tasks, STAGE, 5)
    return top.select(*STAGE, "task_id", "executor_id", "duration_ms", "rank")


@query("stage_order", """
SELECT app_id, stage_id, attempt_id, status, CASE status WHEN 'ACTIVE' THEN 0 WHEN 'PENDING' THEN 1 WHEN 'FAILED' THEN 2 ELSE 3 END AS status_rank
FROM fx_stages ORDER BY app_id, status_rank, stage_id DESC, attempt_id DESC""")
def stage_order(v):
    return stats.stage_order(v.fx_stages).select(*STAGE, "status", "status_rank")


_SLOWEST = """
slowest AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id ORDER BY executor_run_time DESC,
           CASE status WHEN 'ACTIVE' THEN 0 WHEN 'PENDING' THEN 1 WHEN 'FAILED' THEN 2 ELSE 3 END, stage_id DESC, attempt_id DESC) AS BIGINT) AS rank
         FROM fx_stages WHERE executor_run_time > 0) s WHERE rank <= 5),
skew_texts AS (
  SELECT app_id, stage_id, attempt_id,
         string_agg(metric || ' ×' || CASE WHEN ratio = CAST('inf' AS DOUBLE) THEN '∞' ELSE printf('%.1f', ratio) END, ', '
           ORDER BY CASE metric WHEN 'duration' THEN 1 WHEN 'gc time' THEN 2 WHEN 'shuffle read' THEN 5 ELSE 8 END) AS skew
  FROM skewed WHERE ratio >= 3 GROUP BY app_id, stage_id, attempt_id)"""


@query("slowest_stages", f"""WITH {_LONG}, {_SLOWEST}
SELECT s.app_id, s.stage_id, s.attempt_id, s.status, s.executor_run_time, s.rank, t.skew
FROM slowest s LEFT JOIN skew_texts t ON s.app_id = t.app_id AND s.stage_id = t.stage_id""")
def slowest_stages(v):
    top = stats.slowest_stages(v.fx_stages, v.fx_tasks, MEASURES)
    return top.select(*STAGE, "status", "executor_run_time", "rank", "skew")


@query("text_filter", """
SELECT 'jobs' AS tab, app_id, CAST(job_id AS STRING) AS id FROM fx_jobs
 WHERE contains(lower(CAST(job_id AS STRING)), '12') OR contains(lower(status), '12') OR contains(lower(name), '12')
UNION ALL SELECT 'stages', app_id, CAST(stage_id AS STRING) FROM fx_stages
 WHERE contains(CAST(stage_id AS STRING) || '.' || CAST(attempt_id AS STRING), '7.0') OR contains(lower(status), '7.0') OR contains(lower(name), '7.0')
UNION ALL SELECT 'executors', app_id, executor_id FROM fx_executors
 WHERE contains(executor_id, 'ex') OR contains(host_port, 'ex')
    OR contains(CASE WHEN NOT is_active THEN 'dead' WHEN is_excluded THEN 'excluded' ELSE 'up' END, 'ex')
    OR contains(coalesce(lower(remove_reason), ''), 'ex')
UNION ALL SELECT 'sql', app_id, CAST(execution_id AS STRING) FROM fx_sql
 WHERE contains(CAST(execution_id AS STRING), 'aborted') OR contains(lower(status), 'aborted') OR contains(lower(description), 'aborted')
    OR contains(coalesce(lower(error_message), ''), 'aborted')
UNION ALL SELECT 'rdds', app_id, CAST(rdd_id AS STRING) FROM fx_rdds
 WHERE contains(CAST(rdd_id AS STRING), 'econ') OR contains(lower(name), 'econ') OR contains(lower(storage_level), 'econ')""")
def text_filter(v):
    def pick(tab, df, needle, id_col):
        kept = filters.text_filter(df, needle, filters.FILTER_FIELDS[tab])
        return kept.select(F.lit(tab).alias("tab"), "app_id", F.col(id_col).cast("string").alias("id"))

    return (
        pick("jobs", v.fx_jobs, " 12 ", "job_id")
        .unionByName(pick("stages", filters.with_stage_key(v.fx_stages), "7.0", "stage_id"))
        .unionByName(pick("executors", filters.with_executor_state(v.fx_executors), "EX", "executor_id"))
        .unionByName(pick("sql", v.fx_sql, "Aborted", "execution_id"))
        .unionByName(pick("rdds", v.fx_rdds, "econ", "rdd_id"))
    )


@query("filtered_counts", """
SELECT app_id, CAST(sum(CASE WHEN contains(CAST(rdd_id AS STRING), 'red') OR contains(lower(name), 'red') OR contains(lower(storage_level), 'red')
            THEN 1 ELSE 0 END) AS BIGINT) AS shown, count(*) AS total FROM fx_rdds GROUP BY app_id""")
def filtered_counts(v):
    return filters.filtered_counts(v.fx_rdds, "Red", filters.FILTER_FIELDS["rdds"], ["app_id"])
