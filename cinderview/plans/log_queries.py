"""Queries over log lines."""

from pyspark.sql import functions as F

from ..functions import filters
from ..operators import batches as bt, logs, progress as pg
from . import batch_queries, failure_queries
from .registry import query

DAY = 24 * 3600000
START = 1704067200000 + 5 * DAY
END = START + 2 * DAY

_FILLED = """
filled AS (SELECT *, last_value(stamp_ms IGNORE NULLS) OVER (PARTITION BY app_id, file ORDER BY line_no) AS time_ms FROM fx_log_lines)"""


@query("log_time_profile", """
SELECT app_id, file, CAST(floor(stamp_ms / 3600000) AS BIGINT) AS hour, count(*) AS lines, min(stamp_ms) AS first_ms, max(stamp_ms) AS last_ms
FROM fx_log_lines GROUP BY app_id, file, 3""")
def log_time_profile(v):
    return logs.log_time_profile(v.fx_log_lines)


@query("log_time_fill", f"WITH {_FILLED} SELECT app_id, file, line_no, stamp_ms AS ts_ms, time_ms FROM filled")
def log_time_fill(v):
    return logs.fill_time(v.fx_log_lines).select("app_id", "file", "line_no", "ts_ms", "time_ms")


@query("severity_counts", f"""WITH {_FILLED}
SELECT app_id, file, CAST(floor(time_ms / 3600000) AS BIGINT) AS hour,
       CASE WHEN contains(line, ' ERROR ') OR contains(line, 'Exception') OR contains(line, 'Error:') OR contains(line, 'FATAL') THEN 'ERROR'
            WHEN contains(line, ' WARN ') THEN 'WARN' ELSE 'PLAIN' END AS severity, count(*) AS lines
FROM filled GROUP BY 1, 2, 3, 4""")
def severity_counts(v):
    return logs.severity_counts(v.fx_log_lines)


@query("log_grep", "SELECT app_id, file, line_no FROM fx_log_lines WHERE contains(lower(line), 'error')")
def log_grep(v):
    return filters.log_grep(v.fx_log_lines, "ERROR").select("app_id", "file", "line_no")


@query("log_time_slice", f"""WITH {_FILLED},
cut AS (SELECT app_id, file, min(line_no) AS cut FROM filled WHERE stamp_ms > {END} GROUP BY app_id, file)
SELECT f.app_id, f.file, f.line_no, f.line FROM filled f LEFT JOIN cut c ON f.app_id = c.app_id AND f.file = c.file
WHERE f.time_ms BETWEEN {START} AND {END} AND (c.cut IS NULL OR f.line_no < c.cut)""")
def log_time_slice(v):
    return logs.log_slice(v.fx_log_lines, START, END).select("app_id", "file", "line_no", "line")


@query("log_tail", """
SELECT app_id, file, line_no FROM (SELECT *, max(line_no) OVER (PARTITION BY app_id, file) AS last FROM fx_log_lines) l WHERE line_no > last - 2000""")
def log_tail(v):
    return logs.log_tail(v.fx_log_lines, 2000).select("app_id", "file", "line_no")


@query("html_log_text", """
SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<html|<pre') THEN replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '<[^>]*>?', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') ELSE html END AS text
FROM {pages}""")
def html_log_text(v):
    return logs.extract_log_text(v.pages, "html").select("page_id", "text")


_WINDOWS = f"""{batch_queries._MERGED},
spans AS (SELECT *, CASE WHEN has_progress THEN started_ms ELSE submitted_ms END - 1000 AS from_ms,
                 CASE WHEN has_progress THEN started_ms ELSE submitted_ms END
                   + greatest(coalesce(CASE WHEN has_progress THEN greatest(trigger_ms, duration_ms) ELSE duration_ms END, 0), 0) + 1000 AS to_ms FROM kept),
{_FILLED}, driver AS (SELECT * FROM filled WHERE executor_id = 'driver')"""


def batch_windows(v):
    return bt.with_window(batch_queries.merged_batches(v))


@query("batch_log_slice", f"""WITH {_WINDOWS}
SELECT s.app_id, s.query_id, s.batch_id, f.file, f.line_no, f.line FROM spans s JOIN driver f ON s.app_id = f.app_id AND f.time_ms BETWEEN s.from_ms AND s.to_ms
UNION ALL
SELECT s.app_id, s.query_id, s.batch_id, f.file, f.line_no, f.line FROM spans s JOIN driver f
  ON s.app_id = f.app_id AND contains(lower(f.line), 'batch ' || CAST(s.batch_id AS STRING)) WHERE s.from_ms IS NULL""")
def batch_log_slice(v):
    return logs.batch_log_slice(batch_windows(v), v.fx_log_lines)


@query("log_coverage", f"""WITH {_WINDOWS},
begin_ms AS (SELECT app_id, min(stamp_ms) AS log_start_ms FROM driver GROUP BY app_id)
SELECT s.app_id, s.query_id, s.batch_id, b.log_start_ms, coalesce(s.to_ms < b.log_start_ms, FALSE) AS before_log
FROM spans s LEFT JOIN begin_ms b ON s.app_id = b.app_id WHERE NOT s.has_progress""")
def log_coverage(v):
    rows = logs.log_coverage(batch_windows(v), v.fx_log_lines)
    return rows.select("app_id", "query_id", "batch_id", "log_start_ms", "before_log")


@query("empty_window_reason", f"""WITH {_WINDOWS},
log_span AS (SELECT app_id, min(stamp_ms) AS first_ms, max(stamp_ms) AS last_ms FROM driver GROUP BY app_id)
SELECT s.app_id, s.query_id, s.batch_id, CASE WHEN l.first_ms > s.to_ms THEN 'log starts after the window' WHEN l.last_ms < s.from_ms THEN 'log ends before the window'
       WHEN l.first_ms IS NOT NULL THEN 'no line is dated inside the window' ELSE 'no line has a readable time' END AS reason
FROM spans s JOIN log_span l ON s.app_id = l.app_id
WHERE s.from_ms IS NOT NULL AND NOT EXISTS (SELECT 1 FROM driver f WHERE f.app_id = s.app_id AND f.time_ms BETWEEN s.from_ms AND s.to_ms)""")
def empty_window_reason(v):
    rows = logs.window_reason(batch_windows(v), v.fx_log_lines, ["query_id", "batch_id"])
    return rows.select("app_id", "query_id", "batch_id", "reason")


@query("failure_log_lines", f"""WITH {failure_queries._LOG},
views AS (
  SELECT app_id, executor_id, CASE WHEN kind = 'task'
           THEN lower(regexp_extract(trim(regexp_extract(detail, '\\s*(\\S[^\\n]*)', 1)), '^([^\\s:(]*)', 1)) ELSE '' END AS needle, count(*) AS failures
  FROM failures WHERE executor_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT l.app_id, l.executor_id, l.file, l.line_no, string_agg(v.needle, ',' ORDER BY v.needle) AS needles, CAST(sum(v.failures) AS BIGINT) AS failures
FROM views v JOIN fx_log_lines l ON v.app_id = l.app_id AND v.executor_id = l.executor_id AND v.needle <> '' AND contains(lower(l.line), v.needle)
GROUP BY l.app_id, l.executor_id, l.file, l.line_no""")
def failure_log_lines(v):
    rows = logs.failure_log_lines(failure_queries.fleet_failures(v), v.fx_log_lines)
    return rows.select("app_id", "executor_id", "file", "line_no", F.array_join("needles", ",").alias("needles"), "failures")


@query("failure_whole_logs", f"""WITH {failure_queries._LOG},
whole AS (
  SELECT app_id, executor_id, count(*) AS failures FROM failures WHERE executor_id IS NOT NULL AND (kind <> 'task'
    OR strlen(regexp_extract(trim(regexp_extract(detail, '\\s*(\\S[^\\n]*)', 1)), '^([^\\s:(]*)', 1)) < 4) GROUP BY 1, 2),
counts AS (SELECT app_id, executor_id, count(*) AS n FROM fx_log_lines GROUP BY 1, 2)
SELECT w.app_id, w.executor_id, w.failures, coalesce(c.n, 0) AS lines
FROM whole w LEFT JOIN counts c ON w.app_id = c.app_id AND w.executor_id = c.executor_id""")
def failure_whole_logs(v):
    return logs.failure_whole_logs(failure_queries.fleet_failures(v), v.fx_log_lines)


@query("progress_blocks", """
SELECT app_id, 'driver-' || query_id AS file, query_id, run_id, batch_id, num_input_rows, trigger_ms
FROM fx_progress WHERE batch_id % 5 = 0 OR batch_id % 7 <> 3""")
def progress_blocks(v):
    rows = pg.parse_progress(pg.progress_blocks(v.fx_progress_log))
    return rows.select("app_id", "file", "query_id", "run_id", "batch_id", "num_input_rows", "trigger_ms")


@query("progress_from_log", """
SELECT app_id, query_id, run_id, name, batch_id, started_ms, num_input_rows, input_rps, processed_rps, trigger_ms, add_batch_ms, state_rows, state_bytes, rows_dropped
FROM fx_progress WHERE batch_id % 5 = 0 OR batch_id % 7 <> 3""")
def progress_from_log(v):
    rows = pg.progress_from_logs(v.fx_progress_log)
    return rows.select(
        "app_id", "query_id", "run_id", "name", "batch_id", "started_ms", "num_input_rows", "input_rps", "processed_rps",
        "trigger_ms", F.col("phases")["addBatch"].alias("add_batch_ms"), "state_rows", "state_bytes", "rows_dropped",
    )


@query("progress_report", """
SELECT app_id, query_id, name, batch_id, trigger_ms, num_input_rows, input_rps, processed_rps, state_rows,
       processed_rps < input_rps AND num_input_rows > 0 AS behind, FALSE AS stopped, TRUE AS has_progress
FROM (SELECT *, row_number() OVER (PARTITION BY app_id, query_id ORDER BY batch_id DESC) AS rn FROM fx_progress) p WHERE rn = 1""")
def progress_report(v):
    return pg.progress_report(v.fx_progress)
