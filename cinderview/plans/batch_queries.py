"""Queries over streaming queries and their micro-batches."""

from pyspark.sql import functions as F

from ..operators import batches as bt, stats
from . import failure_queries
from .registry import query

AS_OF = 1704067200000 + 14 * 24 * 3600000

# Micro-batch ids of a description, for fixtures that always list them in order.
def _ids(view):
    return f"""SELECT *, split_part(description, chr(10), 1) AS query_name, substring(split_part(description, chr(10), 2), 6) AS query_id,
       substring(split_part(description, chr(10), 3), 9) AS run_id, CAST(substring(split_part(description, chr(10), 4), 9) AS BIGINT) AS batch_id
       FROM {view} WHERE description LIKE '%batch = %'"""


_JOB_BATCHES = f"job_batches AS ({_ids('fx_jobs')}), sql_batches AS ({_ids('fx_sql')})"


def _live(source, order, name):
    """SQL of the live runs in ``source``: latest first arrival per name, then per id."""
    return f"""
firsts AS (SELECT app_id, query_id, run_id, max(nullif({name}, '')) AS name, min({order}) AS fr FROM {source} GROUP BY app_id, query_id, run_id),
per_id AS (SELECT *, min(fr) OVER (PARTITION BY app_id, query_id) AS fi, max(fr) OVER (PARTITION BY app_id, query_id) AS last_fr FROM firsts),
live AS (SELECT app_id, query_id, run_id, name FROM (
  SELECT *, max(fi) OVER (PARTITION BY app_id, coalesce(name, query_id)) AS top_fi FROM per_id) x WHERE fi = top_fi AND fr = last_fr)"""


@query("batch_jobs", f"""WITH {_JOB_BATCHES}
SELECT app_id, query_id, run_id, batch_id, max(query_name) AS name, count(*) AS jobs,
       CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed_jobs
FROM job_batches GROUP BY app_id, query_id, run_id, batch_id""")
def batch_jobs(v):
    return bt.batch_jobs(v.fx_jobs)


@query("current_run", f"""WITH {_JOB_BATCHES}, {_live('job_batches', 'job_id', 'query_name')}
SELECT j.app_id, j.query_id, j.run_id, j.batch_id, j.job_id FROM job_batches j
JOIN live l ON j.app_id = l.app_id AND j.query_id = l.query_id AND j.run_id = l.run_id""")
def current_run(v):
    rows = bt.with_batch(v.fx_jobs)
    return bt.current_run(rows, "job_id", "query_name").select(*bt.BATCH, "job_id")


@query("retired_ids", f"""WITH {_JOB_BATCHES}, {_live('job_batches', 'job_id', 'query_name')}
SELECT DISTINCT j.app_id, j.query_id FROM job_batches j WHERE NOT EXISTS (
  SELECT 1 FROM live l WHERE j.app_id = l.app_id AND j.query_id = l.query_id)""")
def retired_ids(v):
    return bt.retired_ids(bt.with_batch(v.fx_jobs), "job_id", "query_name")


_MERGED = f"""
arrivals AS (SELECT app_id, query_id, run_id, name, started_ms AS at_ms FROM fx_progress
             UNION ALL SELECT app_id, query_id, run_id, name, submitted_ms FROM fx_batch_sql),
{_live('arrivals', 'at_ms', 'name')},
last_sql AS (SELECT app_id, query_id, run_id, batch_id, max_by(status, execution_id) AS status,
       max_by(submitted_ms, CASE WHEN submitted_ms IS NOT NULL THEN execution_id END) AS submitted_ms,
       max_by(duration_ms, execution_id) AS duration_ms, max(execution_id) AS execution_id
  FROM fx_batch_sql GROUP BY app_id, query_id, run_id, batch_id),
joined AS (
  SELECT coalesce(p.app_id, s.app_id) AS app_id, coalesce(p.query_id, s.query_id) AS query_id, coalesce(p.run_id, s.run_id) AS run_id,
         coalesce(p.batch_id, s.batch_id) AS batch_id, s.status, s.submitted_ms, s.execution_id,
         CASE WHEN p.batch_id IS NOT NULL THEN p.trigger_ms ELSE s.duration_ms END AS duration_ms, p.batch_id IS NOT NULL AS has_progress,
         p.started_ms, p.num_input_rows, p.input_rps, p.processed_rps, p.trigger_ms, p.state_rows, p.state_bytes, p.watermark_ms, p.rows_dropped
  FROM fx_progress p FULL OUTER JOIN last_sql s
    ON p.app_id = s.app_id AND p.query_id = s.query_id AND p.run_id = s.run_id AND p.batch_id = s.batch_id),
merged AS (SELECT j.*, l.name FROM joined j JOIN live l ON j.app_id = l.app_id AND j.query_id = l.query_id AND j.run_id = l.run_id),
kept AS (SELECT * FROM merged),
with_rank AS (SELECT *, row_number() OVER (PARTITION BY app_id, query_id ORDER BY duration_ms) - 1 AS rk,
                     count(*) OVER (PARTITION BY app_id, query_id) AS n FROM kept WHERE duration_ms > 0),
timing AS (SELECT app_id, query_id, CAST(floor(sum(duration_ms) / max(n)) AS BIGINT) AS mean_ms, max(duration_ms) AS max_ms,
                  max(CASE WHEN rk = floor((n - 1) * CAST(0.95 AS DOUBLE) + 0.5) THEN duration_ms END) AS p95_ms
           FROM with_rank GROUP BY app_id, query_id),
batch_stats AS (SELECT k.app_id, k.query_id, k.batches, coalesce(t.mean_ms, 0) AS mean_ms, coalesce(t.p95_ms, 0) AS p95_ms, coalesce(t.max_ms, 0) AS max_ms
  FROM (SELECT app_id, query_id, count(*) AS batches FROM kept GROUP BY app_id, query_id) k
  LEFT JOIN timing t ON k.app_id = t.app_id AND k.query_id = t.query_id)"""


def merged_batches(v):
    """Live batches of the fixtures; some have only progress, some only executions."""
    return bt.merge_batches(v.fx_progress, v.fx_batch_sql)


@query("merge_batches", f"WITH {_MERGED} SELECT * EXCLUDE (rows_dropped, watermark_ms, state_bytes) FROM merged")
def merge_batches(v):
    return merged_batches(v).select(
        *bt.BATCH, "name", "status", "submitted_ms", "execution_id", "duration_ms", "has_progress", "started_ms",
        "num_input_rows", "input_rps", "processed_rps", "trigger_ms", "state_rows",
    )


@query("batch_keys_union", """
SELECT app_id, query_id, run_id, batch_id FROM fx_progress UNION SELECT app_id, query_id, run_id, batch_id FROM fx_batch_sql""")
def batch_keys_union(v):
    return bt.batch_keys(v.fx_progress, v.fx_batch_sql)


@query("batch_stats", f"WITH {_MERGED} SELECT * FROM batch_stats")
def batch_stats(v):
    return bt.batch_stats(merged_batches(v))


_SNAPSHOT = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app_id, query_id ORDER BY batch_id DESC) AS pos FROM kept WHERE has_progress) l WHERE pos = 1),
pace AS (SELECT app_id, query_id, max(batch_id) AS latest_batch, max_by(duration_ms, batch_id) AS latest_ms, count(started_ms) AS n,
                min_by(started_ms, CASE WHEN started_ms IS NOT NULL THEN batch_id END) AS first_ms,
                max_by(started_ms, CASE WHEN started_ms IS NOT NULL THEN batch_id END) AS last_ms FROM kept GROUP BY app_id, query_id),
snapshot AS (
  SELECT p.app_id, p.query_id, p.latest_batch, p.latest_ms, coalesce(l.input_rps, 0.0) AS input_rps, coalesce(l.processed_rps, 0.0) AS processed_rps,
         coalesce(l.state_rows, 0) AS state_rows, coalesce(l.state_bytes, 0) AS state_bytes, l.started_ms - l.watermark_ms AS watermark_lag_ms,
         CASE WHEN p.n > 1 AND p.last_ms > p.first_ms THEN (p.n - 1) * CAST(60000 AS DOUBLE) / CAST(p.last_ms - p.first_ms AS DOUBLE) ELSE 0 END AS batches_per_min
  FROM pace p LEFT JOIN latest l ON p.app_id = l.app_id AND p.query_id = l.query_id)"""


@query("query_snapshot", f"WITH {_MERGED}, {_SNAPSHOT} SELECT * FROM snapshot")
def query_snapshot(v):
    return bt.query_snapshot(merged_batches(v))


@query("failed_batches", f"WITH {_MERGED} SELECT app_id, query_id, CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM kept GROUP BY app_id, query_id")
def failed_batches(v):
    return bt.failed_batches(merged_batches(v))


@query("dropped_rows", f"""WITH {_MERGED}
SELECT app_id, query_id, batch_id, rows_dropped AS dropped, CAST(sum(rows_dropped) OVER (PARTITION BY app_id, query_id) AS BIGINT) AS window_dropped
FROM kept WHERE has_progress""")
def dropped_rows(v):
    return bt.dropped_rows(merged_batches(v).where("has_progress"))


_BEHIND = """
behind AS (
  SELECT app_id, query_id, CAST(sum(CASE WHEN num_input_rows > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_input,
         CAST(sum(CASE WHEN num_input_rows > 0 AND processed_rps < input_rps THEN 1 ELSE 0 END) AS BIGINT) AS slow
  FROM (SELECT *, row_number() OVER (PARTITION BY app_id, query_id ORDER BY batch_id DESC) AS pos FROM kept WHERE has_progress) k
  WHERE pos <= 5 GROUP BY app_id, query_id)"""


@query("falling_behind", f"WITH {_MERGED}, {_BEHIND} SELECT *, with_input >= 3 AND slow >= 3 AS behind FROM behind")
def falling_behind(v):
    return bt.falling_behind(merged_batches(v).where("has_progress"), bt.QUERY, "batch_id")


@query("phase_series", """
SELECT app_id, query_id, batch_id, add_batch_ms, planning_ms + state_rows AS overhead_ms,
       CASE WHEN watermark_ms IS NULL THEN 0 ELSE greatest(started_ms - watermark_ms, 0) END AS lag_ms, rows_dropped AS dropped, state_rows,
       CAST(round(input_rps) AS BIGINT) AS input_rate, CAST(round(processed_rps) AS BIGINT) AS processed_rate FROM fx_progress""")
def phase_series(v):
    phases = F.create_map(
        F.lit("addBatch"), F.col("add_batch_ms"), F.lit("triggerExecution"), F.col("trigger_ms"),
        F.lit("queryPlanning"), F.col("planning_ms"), F.lit("walCommit"), F.col("state_rows"), F.lit("getBatch"), F.lit(-5).cast("long"),
    )
    return bt.phase_series(v.fx_progress.withColumn("phases", phases))


@query("slow_batches", f"""WITH {_MERGED}
SELECT k.app_id, k.query_id, k.batch_id, k.duration_ms, s.p95_ms > 0 AND k.duration_ms > s.p95_ms AS slow,
       CASE WHEN s.mean_ms > 0 THEN CAST(k.duration_ms AS DOUBLE) / s.mean_ms ELSE 0 END AS vs_mean
FROM kept k JOIN batch_stats s ON k.app_id = s.app_id AND k.query_id = s.query_id""")
def slow_batches(v):
    kept = merged_batches(v)
    rows = bt.slow_batches(kept, bt.batch_stats(kept))
    return rows.select(*bt.QUERY, "batch_id", "duration_ms", "slow", "vs_mean")


@query("slowest_batches", f"""WITH {_MERGED}
SELECT app_id, query_id, batch_id, duration_ms, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY app_id, query_id
  ORDER BY duration_ms DESC, batch_id) AS BIGINT) AS rank FROM kept) k WHERE rank <= 3""")
def slowest_batches(v):
    return bt.slowest_batches(merged_batches(v)).select(*bt.QUERY, "batch_id", "duration_ms", "rank")


@query("batch_order", f"WITH {_MERGED} SELECT app_id, coalesce(name, substring(query_id, 1, 8)) AS label, query_id, batch_id FROM kept")
def batch_order(v):
    return bt.batch_order(merged_batches(v)).select("app_id", "label", "query_id", "batch_id")


@query("query_order", f"WITH {_MERGED} SELECT DISTINCT app_id, coalesce(name, substring(query_id, 1, 8)) AS label, query_id FROM merged")
def query_order(v):
    return bt.query_order(merged_batches(v)).select("app_id", "label", "query_id")


@query("log_read_from", "SELECT app_id, min(submitted_ms) - 1000 AS read_from_ms FROM fx_batch_sql WHERE submitted_ms IS NOT NULL GROUP BY app_id")
def log_read_from(v):
    return bt.log_read_from(v.fx_batch_sql)


_BATCH_STAGES = f"""{_JOB_BATCHES}, {_live('job_batches', 'job_id', 'query_name')},
listed AS (SELECT DISTINCT j.app_id, j.query_id, j.run_id, j.batch_id FROM job_batches j
           JOIN live l ON j.app_id = l.app_id AND j.query_id = l.query_id AND j.run_id = l.run_id),
batch_stage_ids AS (SELECT DISTINCT l.app_id, l.query_id, l.batch_id, b.stage_id
  FROM listed l JOIN job_batches j ON j.app_id = l.app_id AND j.run_id = l.run_id AND j.batch_id = l.batch_id
  JOIN fx_job_stages b ON b.app_id = j.app_id AND b.job_id = j.job_id)"""


def listed_batches(v):
    return bt.current_run(bt.with_batch(v.fx_jobs), "job_id", "query_name").select(*bt.BATCH).distinct()


@query("batch_stages", f"""WITH {_BATCH_STAGES}
SELECT i.*, s.attempt_id, s.status, s.name FROM batch_stage_ids i JOIN fx_stages s ON s.app_id = i.app_id AND s.stage_id = i.stage_id""")
def batch_stages(v):
    rows = bt.batch_stages(v.fx_jobs, v.fx_job_stages, v.fx_stages, listed_batches(v))
    ordered = rows.orderBy("app_id", "query_id", "batch_id", stats.stage_status_rank(), F.desc("stage_id"))
    return ordered.select("app_id", "query_id", "batch_id", "stage_id", "attempt_id", "status", "name")


@query("batch_failures", f"""WITH {_BATCH_STAGES}, {failure_queries._LOG}
SELECT DISTINCT * FROM (
  SELECT i.app_id, i.query_id, i.batch_id, f.key FROM failures f JOIN batch_stage_ids i ON f.app_id = i.app_id AND f.stage_id = i.stage_id
  UNION ALL SELECT l.app_id, l.query_id, l.batch_id, f.key FROM failures f JOIN job_batches j ON f.app_id = j.app_id AND f.key = 'job:' || CAST(j.job_id AS STRING)
    JOIN listed l ON j.app_id = l.app_id AND j.run_id = l.run_id AND j.batch_id = l.batch_id
  UNION ALL SELECT l.app_id, l.query_id, l.batch_id, f.key FROM failures f JOIN sql_batches j ON f.app_id = j.app_id AND f.key = 'sql:' || CAST(j.execution_id AS STRING)
    JOIN listed l ON j.app_id = l.app_id AND j.run_id = l.run_id AND j.batch_id = l.batch_id) u""")
def batch_failures(v):
    return bt.batch_failures(failure_queries.fleet_failures(v), v.fx_jobs, v.fx_job_stages, v.fx_sql, listed_batches(v))


_HINT = """'sql #' || CAST(s.execution_id AS STRING) || ' · ' || split_part(s.description, chr(10), 1)
  || CASE WHEN s.description LIKE '%batch = %' THEN ' · batch ' || substring(split_part(s.description, chr(10), 4), 9) ELSE '' END"""
_LABELS = f"""
job_labels AS (SELECT b.app_id, b.job_id, min_by({_HINT}, s.execution_id) AS label
  FROM fx_sql s JOIN fx_sql_jobs b ON s.app_id = b.app_id AND s.execution_id = b.execution_id GROUP BY b.app_id, b.job_id),
stage_labels AS (SELECT b.app_id, b.stage_id, max_by(l.label, l.job_id) AS label
  FROM job_labels l JOIN fx_job_stages b ON l.app_id = b.app_id AND l.job_id = b.job_id GROUP BY b.app_id, b.stage_id)"""


@query("labels", f"""WITH {_LABELS}
SELECT app_id, 'job' AS what, job_id AS id, label FROM job_labels UNION ALL SELECT app_id, 'stage', stage_id, label FROM stage_labels""")
def labels(v):
    jobs = bt.job_labels(v.fx_sql, v.fx_sql_jobs)
    stages = bt.stage_labels(jobs, v.fx_job_stages)
    what = lambda df, name, id_col: df.select("app_id", F.lit(name).alias("what"), F.col(id_col).alias("id"), "label")
    return what(jobs, "job", "job_id").unionByName(what(stages, "stage", "stage_id"))


@query("restarted_queries", f"""WITH {_JOB_BATCHES}
SELECT app_id, query_name, count(DISTINCT run_id) AS runs FROM job_batches GROUP BY app_id, query_name HAVING count(DISTINCT run_id) > 1""")
def restarted_queries(v):
    return bt.restarted_queries(v.fx_jobs, v.fx_stages)


_NAMES = f"""
names AS (
  SELECT j.*, CASE WHEN j.description IS NOT NULL THEN split_part(j.description, chr(10), 1) || ' · batch ' || substring(split_part(j.description, chr(10), 4), 9)
                     || ' · run ' || substring(split_part(j.description, chr(10), 3), 9)
                   ELSE coalesce(l.label, j.name) END AS display_name
  FROM fx_jobs j LEFT JOIN job_labels l ON j.app_id = l.app_id AND j.job_id = l.job_id)"""


def named_jobs(v):
    again = bt.restarted_queries(v.fx_jobs, v.fx_stages)
    return bt.named_rows(v.fx_jobs, bt.job_labels(v.fx_sql, v.fx_sql_jobs), again, ["app_id", "job_id"])


@query("display_names", f"WITH {_LABELS}, {_NAMES} SELECT app_id, job_id, display_name FROM names")
def display_names(v):
    return named_jobs(v).select("app_id", "job_id", "display_name")
