"""Queries over the failure log."""

from pyspark.sql import functions as F

from ..functions import text
from ..functions.ordered import top_n
from ..functions import filters
from ..operators import failures as fl
from .registry import query

# Two polls: stage reasons and executor losses only show in the second one.
POLLED = {
    "stages": """SELECT 1 AS poll, app_id, stage_id, attempt_id, status, name, CAST(NULL AS STRING) AS failure_reason,
                        CAST(floor(num_failed_tasks / 2) AS BIGINT) AS num_failed_tasks FROM fx_stages
                 UNION ALL SELECT 2, app_id, stage_id, attempt_id, status, name, failure_reason, num_failed_tasks FROM fx_stages""",
    "jobs": """SELECT 1 AS poll, * FROM fx_jobs WHERE job_id % 2 = 0 UNION ALL SELECT 2 AS poll, * FROM fx_jobs""",
    "executors": """SELECT 2 AS poll, * FROM fx_executors UNION ALL SELECT 3 AS poll, * FROM fx_executors""",
    "sql": """SELECT 1 AS poll, * FROM fx_sql UNION ALL SELECT 2 AS poll, * FROM fx_sql""",
    "tasks": """SELECT CAST(1 + task_id % 3 AS INT) AS poll, * FROM fx_tasks""",
}

_DETAIL = r"coalesce(nullif(regexp_extract(coalesce({0}, ''), '\s*(\S[^\n]*)', 1), ''), '')"

_PER_POLL_STAGES = f"polled_stages AS ({POLLED['stages']})"
_JOB_STAGE = """
job_failed_stage AS (
  SELECT app_id, poll, job_id, stage_id, attempt_id, failure_reason FROM (
    SELECT b.app_id, s.poll, b.job_id, s.stage_id, s.attempt_id, s.failure_reason,
           row_number() OVER (PARTITION BY b.app_id, s.poll, b.job_id ORDER BY s.stage_id DESC, s.attempt_id DESC) AS rn
    FROM fx_job_stages b JOIN polled_stages s ON b.app_id = s.app_id AND b.stage_id = s.stage_id WHERE s.status = 'FAILED') x
  WHERE rn = 1)"""
_SQL_STAGE = """
sql_failed_stage AS (
  SELECT * FROM (SELECT j.app_id, f.poll, j.execution_id, f.stage_id, f.attempt_id, f.failure_reason,
           row_number() OVER (PARTITION BY j.app_id, f.poll, j.execution_id ORDER BY f.stage_id DESC, f.attempt_id DESC) AS rn
    FROM fx_sql_jobs j JOIN job_failed_stage f ON j.app_id = f.app_id AND j.job_id = f.job_id WHERE j.state = 'failed') x
  WHERE rn = 1)"""
_LOG = f"""
{_PER_POLL_STAGES}, {_JOB_STAGE}, {_SQL_STAGE},
bridge_sizes AS (SELECT app_id, job_id, count(*) AS stages FROM fx_job_stages GROUP BY app_id, job_id),
sightings AS (
  SELECT app_id, poll, 'stage:' || CAST(stage_id AS STRING) || '.' || CAST(attempt_id AS STRING) AS key, 'stage' AS kind,
         0 AS kind_order, -stage_id AS place, 0 AS sub,
         'Stage ' || CAST(stage_id AS STRING) || '.' || CAST(attempt_id AS STRING) || ' failed · ' || name AS title,
         failure_reason AS detail, stage_id, attempt_id, CAST(NULL AS STRING) AS executor_id
  FROM polled_stages WHERE status = 'FAILED'
  UNION ALL
  SELECT j.app_id, j.poll, 'job:' || CAST(j.job_id AS STRING), 'job', 1, -j.job_id, 0,
         'Job #' || CAST(j.job_id AS STRING) || ' failed · ' || j.name,
         CAST(num_failed_stages AS STRING) || ' of ' || CAST(coalesce(b.stages, 0) AS STRING) || ' stages failed, '
           || CAST(num_failed_tasks AS STRING) || ' tasks failed'
           || coalesce(chr(10) || 'stage ' || CAST(f.stage_id AS STRING) || '.' || CAST(f.attempt_id AS STRING) || ': ' || f.failure_reason, ''),
         f.stage_id, f.attempt_id, NULL
  FROM ({POLLED['jobs']}) j
  LEFT JOIN job_failed_stage f ON j.app_id = f.app_id AND j.poll = f.poll AND j.job_id = f.job_id
  LEFT JOIN bridge_sizes b ON j.app_id = b.app_id AND j.job_id = b.job_id WHERE j.status = 'FAILED'
  UNION ALL
  SELECT app_id, poll, 'exec:' || executor_id || ':removed', 'executor', 2, 0, 0, 'Executor ' || executor_id || ' lost · ' || host_port,
         remove_reason, NULL, NULL, executor_id
  FROM ({POLLED['executors']}) e WHERE NOT is_active AND remove_reason IS NOT NULL
  UNION ALL
  SELECT app_id, poll, 'exec:' || executor_id || ':excluded', 'executor', 2, 0, 1, 'Executor ' || executor_id || ' excluded · ' || host_port,
         'Excluded by the scheduler after ' || CAST(failed_tasks AS STRING) || ' failed tasks; no new tasks will be scheduled on it.',
         NULL, NULL, executor_id
  FROM ({POLLED['executors']}) e WHERE is_excluded
  UNION ALL
  SELECT q.app_id, q.poll, 'sql:' || CAST(q.execution_id AS STRING), 'sql', 3, -q.execution_id, 0,
         'Query #' || CAST(q.execution_id AS STRING) || ' failed · ' || trim(split_part(q.description, chr(10), 1)),
         coalesce(CASE WHEN trim(error_message) <> '' THEN error_message END,
                  'stage ' || CAST(f.stage_id AS STRING) || '.' || CAST(f.attempt_id AS STRING) || ': ' || f.failure_reason),
         f.stage_id, f.attempt_id, NULL
  FROM ({POLLED['sql']}) q
  LEFT JOIN sql_failed_stage f ON q.app_id = f.app_id AND q.poll = f.poll AND q.execution_id = f.execution_id WHERE q.status = 'FAILED'
  UNION ALL
  SELECT app_id, poll, 'task:' || CAST(task_id AS STRING) || '.' || CAST(attempt AS STRING), 'task', 4, task_id, 0,
         'Task ' || CAST(task_id AS STRING) || '.' || CAST(attempt AS STRING) || ' failed · stage ' || CAST(stage_id AS STRING) || '.'
           || CAST(attempt_id AS STRING) || ' · executor ' || executor_id || ' (' || host || ')',
         error_message, stage_id, attempt_id, executor_id
  FROM ({POLLED['tasks']}) t WHERE status = 'FAILED'),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY app_id, key ORDER BY poll, kind_order, place, sub, title, coalesce(executor_id, '')) AS seen,
         row_number() OVER (PARTITION BY app_id, key, detail IS NULL ORDER BY poll, kind_order, place, sub, title, coalesce(executor_id, '')) AS seen_text
  FROM sightings),
failures AS (
  SELECT a.app_id, a.key, CAST(a.poll AS BIGINT) AS first_poll, a.kind, a.kind_order, CAST(a.place AS BIGINT) AS place, a.sub, a.title,
         a.stage_id, a.attempt_id, a.executor_id, b.detail
  FROM ordered a LEFT JOIN ordered b ON a.app_id = b.app_id AND a.key = b.key AND b.detail IS NOT NULL AND b.seen_text = 1
  WHERE a.seen = 1)"""


def polled(v, *names):
    return {n: v.sql(POLLED[n]) for n in names}


def fleet_failures(v):
    """The failure log over all telemetry of one data folder."""
    return fl.failure_log(
        **polled(v, "stages", "jobs", "executors", "sql", "tasks"), job_stages=v.fx_job_stages, sql_jobs=v.fx_sql_jobs
    )


@query("failed_stage_of_job", f"WITH {_PER_POLL_STAGES}, {_JOB_STAGE} SELECT * FROM job_failed_stage")
def failed_stage_of_job(v):
    return fl.failed_stage_of_job(v.fx_job_stages, v.sql(POLLED["stages"]), fl.POLL)


@query("sql_error_fallback", f"""WITH {_PER_POLL_STAGES}, {_JOB_STAGE}, {_SQL_STAGE}
SELECT q.app_id, q.poll, q.execution_id,
       coalesce(CASE WHEN trim(error_message) <> '' THEN error_message END,
                'stage ' || CAST(f.stage_id AS STRING) || '.' || CAST(f.attempt_id AS STRING) || ': ' || f.failure_reason) AS error,
       f.stage_id AS failed_stage_id, f.attempt_id AS failed_attempt_id
FROM ({POLLED['sql']}) q
LEFT JOIN sql_failed_stage f ON q.app_id = f.app_id AND q.poll = f.poll AND q.execution_id = f.execution_id WHERE q.status = 'FAILED'""")
def sql_error_fallback(v):
    found = fl.sql_errors(v.sql(POLLED["sql"]), v.fx_sql_jobs, v.fx_job_stages, v.sql(POLLED["stages"]), fl.POLL)
    return found.select("app_id", "poll", "execution_id", "error", "failed_stage_id", "failed_attempt_id")


@query("failure_union", f"WITH {_LOG} SELECT app_id, kind, key, CAST(poll AS BIGINT) AS poll, title, detail FROM sightings")
def failure_union(v):
    seen = fl.failure_sightings(
        **polled(v, "stages", "jobs", "executors", "sql", "tasks"), job_stages=v.fx_job_stages, sql_jobs=v.fx_sql_jobs
    )
    return seen.select("app_id", "kind", "key", "poll", "title", "detail")


@query("failure_log", f"WITH {_LOG} SELECT * FROM failures")
def failure_log(v):
    return fleet_failures(v)


@query("unacked", f"""WITH {_LOG},
numbered AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY first_poll, kind_order, place, sub, key) AS seq FROM failures),
acks AS (SELECT app_id, CAST(floor(max(seq) / 2) AS BIGINT) AS acked FROM numbered GROUP BY app_id)
SELECT n.app_id, count(*) AS unacked, max_by(n.title, n.seq) AS latest_title
FROM numbered n JOIN acks a ON n.app_id = a.app_id WHERE n.seq > a.acked GROUP BY n.app_id""")
def unacked(v):
    log = fl.numbered(fleet_failures(v))
    half = log.groupBy("app_id").agg(F.floor(F.max("seq") / 2).alias("acked"))
    return fl.unacked_summary(log.join(half, "app_id"), F.col("acked"))


@query("failures_by_kind", f"WITH {_LOG} SELECT app_id, kind, count(*) AS n FROM failures GROUP BY app_id, kind")
def failures_by_kind(v):
    return fl.failures_by_kind(fleet_failures(v))


_REASONS = f"""
reasons AS (
  SELECT app_id, reason, count(*) AS n, arg_max(title, row(first_poll, kind_order, place, sub, key)) AS example
  FROM (SELECT *, trim({_DETAIL.format('detail')}) AS reason FROM failures) f WHERE reason <> '' GROUP BY app_id, reason),
top_reasons AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id ORDER BY n DESC, reason) AS BIGINT) AS rank FROM reasons) r WHERE rank <= 5)"""


@query("top_reasons", f"WITH {_LOG}, {_REASONS} SELECT * FROM top_reasons")
def top_reasons(v):
    return fl.top_reasons(fleet_failures(v))


@query("retain_last", f"""WITH {_LOG}
SELECT app_id, key, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id ORDER BY first_poll DESC, kind_order DESC, place DESC,
   sub DESC, key DESC) AS BIGINT) AS rank FROM failures) f WHERE rank <= 1000""")
def retain_last(v):
    kept = top_n(fleet_failures(v), ["app_id"], [F.desc(c) for c in fl.SEQ], 1000, ["key"])
    return kept.select("app_id", "key", "rank")


@query("failure_growth", """
SELECT poll, app_id, stage_id, attempt_id, num_failed_tasks, previous FROM (
  SELECT *, coalesce(lag(num_failed_tasks) OVER (PARTITION BY app_id, stage_id, attempt_id ORDER BY poll), 0) AS previous
  FROM (SELECT 1 AS poll, app_id, stage_id, attempt_id, CAST(floor(num_failed_tasks / 2) AS BIGINT) AS num_failed_tasks FROM fx_stages
        UNION ALL SELECT 2, app_id, stage_id, attempt_id, num_failed_tasks FROM fx_stages) p) g
WHERE num_failed_tasks > previous""")
def failure_growth(v):
    grown = fl.failure_growth(v.sql(POLLED["stages"]))
    return grown.select("poll", "app_id", "stage_id", "attempt_id", "num_failed_tasks", "previous")


@query("removal_reasons", f"""
SELECT app_id, coalesce(nullif(trim({_DETAIL.format('remove_reason')}), ''), 'no reason reported') AS reason, count(*) AS executors
FROM fx_executors WHERE NOT is_active GROUP BY 1, 2""")
def removal_reasons(v):
    return fl.removal_reasons(v.fx_executors)


@query("error_token_counts", f"""
SELECT app_id, token, count(*) AS failures FROM (
  SELECT app_id, regexp_extract(trim({_DETAIL.format('error_message')}), '^([^\\s:(]*)', 1) AS token FROM fx_tasks WHERE status = 'FAILED') t
WHERE strlen(token) >= 4 GROUP BY app_id, token""")
def error_token_counts(v):
    token = text.error_token("error_message")
    failed = v.fx_tasks.where("status = 'FAILED'").withColumn("token", token).where("token IS NOT NULL")
    return failed.groupBy("app_id", "token").agg(F.count(F.lit(1)).alias("failures"))


@query("failure_filter", f"""WITH {_LOG}
SELECT app_id, key FROM failures WHERE contains(lower(kind), 'error3') OR contains(lower(title), 'error3') OR contains(coalesce(lower(detail), ''), 'error3')""")
def failure_filter(v):
    hits = filters.text_filter(fleet_failures(v), "Error3", filters.FILTER_FIELDS["failures"])
    return hits.select("app_id", "key")
