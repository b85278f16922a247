"""Telemetry-shaped views over business tables, as SQL both engines read.

``{name}`` stands for a table: a parquet path for Spark, a view for the check
engine. Views may use other views by their name.
"""

import re

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    "fx_tasks": """
SELECT 'app-' || CAST(l_orderkey % 3 AS STRING) AS app_id, l_partkey AS stage_id, CAST(0 AS BIGINT) AS attempt_id,
       l_orderkey AS job_id, l_orderkey * 10 + l_linenumber AS task_id, CAST(0 AS BIGINT) AS attempt,
       CAST(l_suppkey AS STRING) AS executor_id, 'host-' || CAST(l_suppkey % 25 AS STRING) AS host,
       q * q * q AS duration_ms, q * q * 1024 AS shuffle_read_bytes,
       CASE WHEN q = 50 THEN CAST(536870912 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS spill_bytes,
       CAST(round(l_discount * 100) AS BIGINT) * 100 AS gc_ms,
       q * 3 AS scheduler_delay_ms, q * 8192 AS input_bytes, CAST(l_linenumber AS BIGINT) * 700 AS fetch_wait_ms, q * 512 AS shuffle_write_bytes,
       CASE WHEN q > 48 THEN q * 65536 ELSE CAST(0 AS BIGINT) END AS disk_spill_bytes, q * 131072 AS peak_memory,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'FAILED' ELSE 'SUCCESS' END AS status,
       CASE l_linenumber % 4 WHEN 0 THEN 'ANY' WHEN 1 THEN 'PROCESS_LOCAL' WHEN 2 THEN 'NODE_LOCAL'
            ELSE 'RACK_LOCAL' END AS locality,
       l_linenumber = 7 AS speculative,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F'
            THEN chr(10) || '  java.lang.Error' || CAST(l_suppkey % 7 AS STRING) || ': heap (task)' || chr(10) || '  at x'
            END AS error_message
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM {lineitem}) t""",
    "fx_stages": """
SELECT app_id, stage_id, CAST(0 AS BIGINT) AS attempt_id,
       CASE WHEN stage_id % 11 = 0 THEN 'FAILED' WHEN stage_id % 7 = 0 THEN 'ACTIVE'
            WHEN stage_id % 5 = 0 THEN 'PENDING' ELSE 'COMPLETE' END AS status,
       CASE WHEN stage_id % 4 = 0 THEN 'run at <unknown>:0' ELSE 'stage ' || CAST(stage_id AS STRING) END AS name,
       CASE WHEN stage_id % 9 = 0 THEN 'load part ' || CAST(stage_id AS STRING) || chr(10) || 'more' END AS description,
       CASE WHEN stage_id % 22 = 0 THEN 'Job aborted: part ' || CAST(stage_id AS STRING) END AS failure_reason,
       count(*) AS num_tasks,
       CAST(sum(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS num_failed_tasks,
       CAST(sum(CASE WHEN status = 'SUCCESS' THEN 1 ELSE 0 END) AS BIGINT) AS num_complete_tasks,
       CAST(sum(duration_ms) AS BIGINT) AS executor_run_time, CAST(sum(gc_ms) AS BIGINT) AS jvm_gc_time,
       CAST(sum(shuffle_read_bytes) AS BIGINT) AS shuffle_read_bytes, CAST(0 AS BIGINT) AS shuffle_write_bytes,
       CAST(0 AS BIGINT) AS input_bytes,
       CAST(sum(spill_bytes) AS BIGINT) AS memory_bytes_spilled, CAST(0 AS BIGINT) AS disk_bytes_spilled
FROM fx_tasks GROUP BY app_id, stage_id""",
    "fx_job_stages": "SELECT DISTINCT app_id, job_id, stage_id FROM fx_tasks",
    "fx_jobs": """
SELECT 'app-' || CAST(o_orderkey % 3 AS STRING) AS app_id, o_orderkey AS job_id, o_custkey AS execution_id,
       CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'SUCCEEDED' ELSE 'RUNNING' END AS status,
       'run at <unknown>:0' AS name,
       CASE WHEN o_orderkey % 4 = 0
            THEN 'orders-agg' || chr(10) || 'id = q' || CAST(o_orderkey % 5 AS STRING) || chr(10) || 'runId = r'
                 || CAST(o_orderkey % 7 AS STRING) || chr(10) || 'batch = '
                 || CAST(CAST(floor(o_orderkey / 100) AS BIGINT) AS STRING) END AS description,
       CAST(20 AS BIGINT) AS num_tasks, o_orderkey % 24 AS num_completed_tasks,
       o_orderkey % 2 AS num_skipped_tasks, o_orderkey % 6 AS num_failed_tasks, o_orderkey % 3 AS num_failed_stages
FROM {orders}""",
    "fx_sql": """
SELECT app_id, execution_id,
       CASE execution_id % 3 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'COMPLETED' ELSE 'RUNNING' END AS status,
       CASE WHEN execution_id % 2 = 0
            THEN 'orders-agg' || chr(10) || 'id = q' || CAST(execution_id % 5 AS STRING) || chr(10) || 'runId = r'
                 || CAST(execution_id % 7 AS STRING) || chr(10) || 'batch = '
                 || CAST(CAST(floor(execution_id / 10) AS BIGINT) AS STRING)
            ELSE 'collect at Main.scala:' || CAST(execution_id AS STRING) || chr(10) || '== Physical Plan ==' END AS description,
       CASE WHEN execution_id % 9 = 0 THEN 'Job aborted: query ' || CAST(execution_id AS STRING)
            WHEN execution_id % 9 = 3 THEN '  ' END AS error_message,
       CAST(execution_id * 7 % 5000 AS BIGINT) AS duration_ms,
       CAST(1704067200000 AS BIGINT) + execution_id * 60000 AS submitted_ms
FROM (SELECT DISTINCT app_id, execution_id FROM fx_jobs) x""",
    "fx_sql_jobs": """
SELECT app_id, execution_id, job_id,
       CASE status WHEN 'FAILED' THEN 'failed' WHEN 'RUNNING' THEN 'running' ELSE 'success' END AS state
FROM fx_jobs""",
    "fx_executors": """
SELECT 'app-' || CAST(s_suppkey % 3 AS STRING) AS app_id, CAST(s_suppkey AS STRING) AS executor_id,
       'host-' || CAST(s_nationkey AS STRING) || ':7079' AS host_port,
       s_suppkey % 7 <> 0 AS is_active, s_suppkey % 5 = 0 AS is_excluded,
       CASE WHEN s_suppkey % 14 = 0 THEN chr(10) || ' Container killed. Exit code is 137 ' || chr(10) || 'more' END AS remove_reason,
       CAST(1704067200000 AS BIGINT) + s_suppkey * 1000 AS add_ms,
       CASE WHEN s_suppkey % 7 = 0 THEN CAST(1704067200000 AS BIGINT) + s_suppkey * 2000 END AS remove_ms,
       CAST(4 AS BIGINT) AS total_cores, CAST(s_suppkey % 4 AS BIGINT) AS active_tasks,
       CAST(s_suppkey % 6 AS BIGINT) AS failed_tasks, CAST(s_suppkey * 3 AS BIGINT) AS completed_tasks,
       (s_suppkey % 11) * 390451572 AS memory_used, CAST(4294967296 AS BIGINT) AS max_memory,
       (s_suppkey % 4) * 1048576 AS disk_used, (s_suppkey % 17) * 1000003 AS total_shuffle_read,
       (s_suppkey % 13) * 1000 AS total_duration, (s_suppkey % 3) * 400 AS total_gc_time,
       (s_suppkey % 10 + 1) * 419430400 AS peak_heap, (s_suppkey % 9 + 1) * 524288000 AS peak_rss,
       s_suppkey % 8 * 100 AS major_gc_ms, s_suppkey % 5 * 10 AS minor_gc_ms,
       s_suppkey % 3 AS resource_profile_id
FROM {supplier}""",
    "fx_profiles": """
SELECT DISTINCT 'app-' || CAST(n_nationkey % 3 AS STRING) AS app_id, CAST(n_nationkey % 2 AS BIGINT) AS profile_id,
       CASE WHEN n_nationkey % 5 = 0 THEN 'memory' WHEN n_nationkey % 5 = 1 THEN 'memoryOverhead'
            WHEN n_nationkey % 5 = 2 THEN 'offHeap' ELSE 'cores' END AS resource,
       CASE WHEN n_nationkey % 5 = 0 THEN CAST(4096 AS BIGINT) WHEN n_nationkey % 5 = 1 THEN CAST(512 AS BIGINT)
            WHEN n_nationkey % 5 = 2 THEN CAST(256 AS BIGINT) ELSE CAST(4 AS BIGINT) END AS amount
FROM {nation}""",
    "fx_env": """
SELECT 'app-' || CAST(c_custkey % 3 AS STRING) AS app_id,
       CASE c_nationkey % 4 WHEN 0 THEN 'spark' WHEN 1 THEN 'hadoop' WHEN 2 THEN 'system' ELSE 'metrics' END AS section,
       CASE WHEN c_custkey % 50 < 3 THEN 'spark.memory.fraction' WHEN c_custkey % 50 < 6 THEN 'spark.executor.memory'
            WHEN c_custkey % 50 < 9 THEN 'spark.serializer' ELSE 'conf.' || c_name END AS key,
       CASE WHEN c_custkey % 50 < 3 THEN '0.7' ELSE c_mktsegment END AS value
FROM {customer}""",
    "fx_events": """
SELECT *, CAST((extract(day FROM ts) - 1) * 24 + extract(hour FROM ts) AS BIGINT) AS hour_no FROM {events}""",
    "fx_progress": """
SELECT app_id, query_id, query_id || '-query' AS name, run_id, batch_id, batch_id AS arrival,
       CAST(1704067200000 AS BIGINT) + batch_id * 3600000 AS started_ms,
       num_input_rows, CAST(num_input_rows AS DOUBLE) AS input_rps, CAST(third AS DOUBLE) AS processed_rps,
       users * 10 AS trigger_ms, users * 7 AS add_batch_ms, users * 2 AS planning_ms,
       users * 3 AS state_rows, users * 64 AS state_bytes, dropped AS rows_dropped,
       CASE WHEN batch_id % 10 <> 0
            THEN CAST(1704067200000 AS BIGINT) + batch_id * 3600000 - num_input_rows * 1000 END AS watermark_ms
FROM (SELECT 'app-' || CAST(length(event_type) % 2 AS STRING) AS app_id, event_type AS query_id,
             CASE WHEN hour_no >= 360 THEN 'r2' ELSE 'r1' END AS run_id, hour_no AS batch_id,
             count(*) AS num_input_rows, CAST(sum(user_id % 3) AS BIGINT) AS third,
             CAST(sum(user_id) AS BIGINT) AS users,
             CAST(sum(CASE WHEN user_id % 10 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS dropped
      FROM fx_events GROUP BY event_type, hour_no) p""",
    "fx_batch_sql": """
SELECT 'app-' || CAST(length(event_type) % 2 AS STRING) AS app_id, event_type AS query_id, event_type || '-query' AS name,
       CASE WHEN hour_no >= 360 THEN 'r2' ELSE 'r1' END AS run_id,
       CASE WHEN event_id % 97 = 0 THEN hour_no + 800 ELSE hour_no - hour_no % 2 END AS batch_id,
       event_id AS execution_id,
       CASE event_id % 3 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'COMPLETED' ELSE 'RUNNING' END AS status,
       CASE WHEN event_id % 4 <> 0 THEN CAST(1704067200000 AS BIGINT) + hour_no * 3600000 + event_id % 60 * 1000 END AS submitted_ms,
       CAST(event_id % 5000 AS BIGINT) AS duration_ms
FROM fx_events""",
    "fx_log_lines": """
SELECT 'app-' || CAST(user_id % 2 AS STRING) AS app_id,
       CASE WHEN user_id % 4 < 2 THEN 'driver' ELSE CAST(user_id % 4 AS STRING) END AS executor_id,
       'file-' || CAST(user_id % 4 AS STRING) AS file, event_id AS line_no,
       CASE WHEN event_id % 3 = 2 THEN '  at org.apache.spark.x(A.scala:' || CAST(event_id AS STRING) || ') java.lang.Error'
                 || CAST(event_id % 7 AS STRING)
            ELSE CAST(extract(year FROM ts) - 2000 AS STRING) || '/' || lpad(CAST(extract(month FROM ts) AS STRING), 2, '0')
                 || '/' || lpad(CAST(extract(day FROM ts) AS STRING), 2, '0') || ' ' || lpad(CAST(extract(hour FROM ts) AS STRING), 2, '0')
                 || ':' || lpad(CAST(extract(minute FROM ts) AS STRING), 2, '0') || ':' || lpad(CAST(CAST(floor(extract(second FROM ts)) AS INT) AS STRING), 2, '0')
                 || CASE event_type WHEN 'error' THEN ' ERROR ' WHEN 'click' THEN ' WARN ' ELSE ' INFO ' END || event_type || ': '
                 || CASE WHEN event_type = 'purchase' THEN 'Batch ' || CAST((extract(day FROM ts) - 1) * 24 + extract(hour FROM ts) AS STRING) || ' ' ELSE '' END
                 || props END AS line,
       CASE WHEN event_id % 3 <> 2 THEN 1000 * CAST(floor(CAST(extract(day FROM ts) - 1 AS BIGINT) * 86400
            + extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts))) AS BIGINT)
            + CAST(1704067200000 AS BIGINT) END AS stamp_ms
FROM {events}""",
    "fx_progress_text": """
SELECT *, '  "id" : "' || query_id || '", "runId" : "' || run_id || '", "name" : "' || name || '", "timestamp" : "2024-01-'
                  || lpad(CAST(CAST(floor(batch_id / 24) AS BIGINT) + 1 AS STRING), 2, '0') || 'T' || lpad(CAST(batch_id % 24 AS STRING), 2, '0') || ':00:00.000Z", "batchId" : ' || CAST(batch_id AS STRING) || ',' AS head,
             '  "numInputRows" : ' || CAST(num_input_rows AS STRING) || ', "inputRowsPerSecond" : ' || CAST(num_input_rows AS STRING) || '.0, "processedRowsPerSecond" : '
                  || CAST(CAST(processed_rps AS BIGINT) AS STRING) || '.0, "durationMs" : {"addBatch" : ' || CAST(add_batch_ms AS STRING) || ', "triggerExecution" : '
                  || CAST(trigger_ms AS STRING) || '}, "eventTime" : {}, "stateOperators" : [ {"numRowsTotal" : ' || CAST(state_rows AS STRING)
                  || ', "memoryUsedBytes" : ' || CAST(state_bytes AS STRING) || ', "numRowsDroppedByWatermark" : ' || CAST(rows_dropped AS STRING) || '} ]' AS tail
      FROM fx_progress""",
    "fx_progress_log": """
SELECT app_id, 'driver-' || query_id AS file, batch_id * 10 + part AS line_no,
       CASE WHEN batch_id % 5 = 0 THEN
              CASE part WHEN 0 THEN '{"ts":"2024-01-01T00:00:00.000Z","level":"INFO","msg":"Streaming query made progress: {\\n'
                   || replace(head, '"', '\\"') || '\\n' || replace(tail, '"', '\\"') || '\\n}"}'
              ELSE '24/01/01 00:00:00 INFO Other: line {' || CAST(part AS STRING) || '}' END
            ELSE
              CASE part WHEN 0 THEN '24/01/01 00:00:00 INFO MicroBatchExecution: Streaming query made progress: {'
                        WHEN 1 THEN head WHEN 2 THEN '{"ts":"2024-01-01T00:00:00.000Z","level":"INFO","msg":"noise"}'
                        WHEN 3 THEN tail ELSE CASE WHEN batch_id % 7 = 3 THEN '24/01/01 INFO cut' ELSE '}' END END
            END AS line
FROM (SELECT *, CAST(0 AS BIGINT) AS part FROM fx_progress_text UNION ALL SELECT *, CAST(1 AS BIGINT) FROM fx_progress_text
      UNION ALL SELECT *, CAST(2 AS BIGINT) FROM fx_progress_text UNION ALL SELECT *, CAST(3 AS BIGINT) FROM fx_progress_text
      UNION ALL SELECT *, CAST(4 AS BIGINT) FROM fx_progress_text) p""",
    "fx_metrics": """
SELECT app_id, key, kind, poll_s, value, m1_rate, mean,
       CASE WHEN key LIKE 'spark.streaming.%' THEN 'spark.streaming.' || split_part(key, '.', 3)
            ELSE split_part(key, '.', 1) END AS source,
       CASE WHEN key LIKE 'spark.streaming.%' THEN split_part(key, '.', 4) ELSE split_part(key, '.', 2) END AS name
FROM (SELECT app_id, event_type AS et, hour_no * 3600 AS poll_s,
             CASE event_type WHEN 'error' THEN 'LiveListenerBus.numDroppedEvents' WHEN 'click' THEN 'shop.clicks'
                  WHEN 'view' THEN 'DAGScheduler.messageProcessingTime' WHEN 'signup' THEN 'spark.streaming.signup.rate'
                  ELSE 'JVMCPUTime.jvmCpuTime' END AS key,
             CASE event_type WHEN 'error' THEN 'counter' WHEN 'click' THEN 'counter' WHEN 'view' THEN 'timer'
                  WHEN 'signup' THEN 'meter' ELSE 'gauge' END AS kind,
             CAST(sum(n) OVER (PARTITION BY app_id, event_type ORDER BY hour_no) AS DOUBLE) AS value,
             CAST(n AS DOUBLE) AS m1_rate, CAST(n * 2 AS DOUBLE) AS mean
      FROM (SELECT 'app-' || CAST(user_id % 2 AS STRING) AS app_id, event_type, hour_no, count(*) AS n
            FROM fx_events GROUP BY 1, event_type, hour_no) m) k""",
    "fx_samples": """
SELECT 'app-' || CAST(user_id % 2 AS STRING) AS app_id, event_id * 7 AS poll_s, event_id % 50 * user_id AS completed_tasks,
       user_id % 16 AS active_tasks, user_id % 9 AS alive_executors, CAST(floor(event_id / 100) AS BIGINT) AS removed_executors
FROM {events}""",
    "fx_threads": """
SELECT 'app-' || CAST(conv_id % 3 AS STRING) AS app_id, CAST(conv_id AS STRING) AS executor_id, CAST(turn AS BIGINT) AS thread_id,
       role || '-' || CAST(turn AS STRING) AS thread_name,
       CASE role WHEN 'assistant' THEN 'BLOCKED' WHEN 'user' THEN 'RUNNABLE' ELSE 'WAITING' END AS thread_state,
       CASE WHEN turn % 2 = 0 THEN 'java.lang.Object@' || CAST(turn AS STRING) END AS lock_name,
       CASE WHEN conv_id % 3 <> 0 THEN split('monitor-' || CAST(turn AS STRING) || ',monitor-' || CAST(conv_id AS STRING), ',') END AS holding_locks,
       CASE WHEN role = 'assistant' THEN CAST(turn AS BIGINT) - 1 END AS blocked_by_thread_id,
       CASE WHEN turn % 3 = 0 THEN 'org.apache.spark.' || text ELSE text END AS stack_text
FROM {conversations}""",
    "fx_rdds": """
SELECT 'app-' || CAST(p_partkey % 3 AS STRING) AS app_id, p_partkey AS rdd_id, p_name AS name, p_type AS storage_level,
       CAST(50 AS BIGINT) AS num_partitions, CAST(p_size AS BIGINT) AS num_cached_partitions,
       CAST(round(p_retailprice) AS BIGINT) * 1048576 AS memory_used,
       CASE WHEN p_size % 6 = 0 THEN CAST(p_size AS BIGINT) * 1048576 ELSE CAST(0 AS BIGINT) END AS disk_used
FROM {part}""",
    "fx_rdd_blocks": """
SELECT 'app-' || CAST(l_partkey % 3 AS STRING) AS app_id, l_partkey AS rdd_id,
       'rdd_' || CAST(l_partkey AS STRING) || '_' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS block,
       CAST(l_suppkey AS STRING) AS address,
       CAST(l_quantity AS BIGINT) * 1048576 AS memory_used,
       CASE WHEN l_linenumber = 3 THEN CAST(l_quantity AS BIGINT) * 1024 ELSE CAST(0 AS BIGINT) END AS disk_used
FROM {lineitem}""",
    "fx_apps": """
SELECT 'app-' || CAST(r_regionkey % 3 AS STRING) AS app_id, 'region etl ' || min(r_name) AS name,
       'owner' || CAST(min(r_regionkey) AS STRING) AS spark_user, '4.1.' || CAST(max(r_regionkey) AS STRING) AS version,
       '2024-01-01T00:00:0' || CAST(min(r_regionkey) AS STRING) || '.000GMT' AS start_time,
       CAST(count(*) * 4200000 AS BIGINT) AS duration_ms, min(r_regionkey) % 2 = 0 AS completed
FROM {region} GROUP BY r_regionkey % 3""",
    "fx_nodes": """
SELECT 'app-' || CAST(l_orderkey % 3 AS STRING) AS app_id, l_orderkey AS execution_id, l_partkey AS node_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) AS BIGINT) AS pos,
       CASE l_linenumber WHEN 1 THEN 'spill size' WHEN 2 THEN 'number of output rows' WHEN 3 THEN 'peak memory'
            WHEN 4 THEN 'scan time' WHEN 5 THEN 'size of files read' WHEN 6 THEN 'fetch wait' ELSE 'shuffle bytes' END AS metric,
       CASE WHEN l_quantity < 10 THEN '0.0 B' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) || '.5 MiB' END AS value
FROM {lineitem}""",
    "fx_orders_stream": """
SELECT ts AS event_time, event_id AS order_id, user_id AS customer_id, CAST(value AS DECIMAL(12, 2)) AS amount,
       CASE event_id % 3 WHEN 0 THEN 'eu' WHEN 1 THEN 'us' ELSE 'apac' END AS region
FROM {events}""",
}


def _uses(text):
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def needed_views(text):
    """View names a text depends on, dependencies first."""
    out = []

    def visit(t):
        for v in _uses(t):
            if v not in out:
                visit(VIEWS[v])
                out.append(v)

    visit(text)
    return out


def spark_tables(text, sf_dir):
    return re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir.rstrip('/')}/{m.group(1)}.parquet`", text)


def check_tables(text):
    return re.sub(r"\{(\w+)\}", lambda m: m.group(1), text)


def with_views(text, tables):
    """``text`` with the views it uses as common table expressions."""
    names = needed_views(text)
    if not names:
        return tables(text)
    ctes = ",\n".join(f"{v} AS ({tables(VIEWS[v])}\n)" for v in names)
    body = tables(text).strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def view(spark, sf_dir, name):
    """One view as a DataFrame."""
    return spark.sql(with_views(f"SELECT * FROM {name}", lambda t: spark_tables(t, sf_dir)))
