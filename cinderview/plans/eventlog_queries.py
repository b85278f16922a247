"""Queries on the parts of event logs that are replayed or unfolded: plans, cached blocks, exclusions."""

import json

from pyspark.sql import functions as F

from ..functions.ordered import union_all
from ..operators import resources, settings
from ..session import scratch_path, written
from ..sources import events as ev, exclusions, plans, storage
from .registry import query
from .source_queries import _as, _event

_START = 1704067200000


def landed(v, events):
    """Events written once by kind: several tables read them, each its own kinds."""
    return ev.land_events(events, scratch_path(v.spark, "events"))


def replayed_blocks(v):
    """Landed block events and the blocks stored in the end, replayed once."""
    events = landed(v, block_events(v))
    return events, written(v.spark, storage.rdd_blocks(events), "blocks")


def _node(name, *children, **metrics):
    return {
        "nodeName": name, "simpleString": name, "children": list(children),
        "metrics": [{"name": n.replace("_", " "), "accumulatorId": f"ACC{i}", "metricType": kind} for n, (i, kind) in metrics.items()],
    }


_SCAN = _node("Scan parquet", number_of_files_read=(4, "sum"))
_FIRST = _node("AdaptiveSparkPlan", _node("HashAggregate", _SCAN, number_of_output_rows=(1, "sum")))
_MADE = _node("Exchange", _node("WholeStageCodegen (1)", _SCAN))
_JOINED = _node("InputAdapter", _node("ShuffleQueryStage", _MADE)), _node("InputAdapter", _node("ShuffleQueryStage", _node("ReusedExchange", _MADE)))
_LAST = _node("AdaptiveSparkPlan", _node(
    "WholeStageCodegen (2)", _node("SortMergeJoin", *_JOINED, number_of_output_rows=(1, "sum"), spill_size=(2, "size"), sort_time=(3, "nsTiming")),
    duration=(3, "timing"),
))


def _plan_of(tree):
    """A plan's JSON, its metrics numbered by execution."""
    text = F.lit(json.dumps(tree))
    for i in range(1, 5):
        text = F.replace(text, F.lit(f'"ACC{i}"'), (F.col("execution_id") * 10 + i).cast("string"))
    return text


def plan_events(v):
    """Executions with a first plan, an adaptive update (none for even ones), and what tasks and driver report."""
    sql = v.fx_sql.select("app_id", "execution_id")
    told = lambda df, name, tree, row: df.select(
        "app_id",
        F.concat(F.lit(f'{{"Event":"{ev.SQL_UI}{name}","executionId":'), F.col("execution_id").cast("string"), F.lit(',"sparkPlanInfo":'), _plan_of(tree), F.lit("}")).alias("value"),
        F.struct(F.lit(0).cast("long").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(row).cast("long").alias("row")).alias("pos"),
    )
    odd = sql.where("execution_id % 2 = 1")
    tasks = v.fx_tasks.join(v.fx_jobs.select("app_id", "job_id", "execution_id"), ["app_id", "job_id"])
    update = lambda i, col: F.struct((F.col("execution_id") * 10 + i).alias("ID"), F.col(col).cast("string").alias("Update"), F.lit("sql").alias("Metadata"))
    ended = _event(
        tasks, "SparkListenerTaskEnd", F.struct(F.when(F.col("status") == "FAILED", "ExceptionFailure").otherwise("Success").alias("Reason")).alias("Task End Reason"),
        F.struct(F.array(update(1, "duration_ms"), update(2, "spill_bytes"), update(3, "gc_ms")).alias("Accumulables")).alias("Task Info"),
    )
    pair = F.array(F.array(F.col("execution_id") * 10 + 4, F.col("execution_id") % 7), F.array(F.lit(-1).cast("long"), F.lit(5).cast("long")))
    driver = _event(sql, ev.SQL_UI + "SparkListenerDriverAccumUpdates", _as("execution_id", "executionId"), pair.alias("accumUpdates"))
    return ev.events_of(union_all([
        told(sql, "SparkListenerSQLExecutionStart", _FIRST, 1), told(odd, "SparkListenerSQLAdaptiveExecutionUpdate", _LAST, 9),
        told(odd, "SparkListenerSQLAdaptiveExecutionUpdate", _FIRST, 5), ended, driver,
    ]))


_METRICS = """
sums AS (SELECT t.app_id, j.execution_id, CAST(sum(duration_ms) AS BIGINT) AS a1, CAST(sum(spill_bytes) AS BIGINT) AS a2, CAST(sum(gc_ms) AS BIGINT) AS a3,
                max(duration_ms) AS m1, max(spill_bytes) AS m2, max(gc_ms) AS m3
         FROM fx_tasks t JOIN fx_jobs j ON t.app_id = j.app_id AND t.job_id = j.job_id WHERE t.status = 'SUCCESS' GROUP BY t.app_id, j.execution_id),
x AS (SELECT q.app_id, q.execution_id, q.execution_id % 2 = 1 AS last, a1, a2, a3, m1, m2, m3, q.execution_id % 7 AS a4
      FROM fx_sql q LEFT JOIN sums s ON q.app_id = s.app_id AND q.execution_id = s.execution_id),
shown AS (
  SELECT app_id, execution_id, 1 AS node_id, 'HashAggregate' AS node_name, NULL AS codegen_id, 0 AS pos, 'number of output rows' AS metric, 'sum' AS kind, a1 AS total, m1 AS most FROM x WHERE NOT last
  UNION ALL SELECT app_id, execution_id, 2, 'Scan parquet', NULL, 0, 'number of files read', 'sum', a4, a4 FROM x WHERE NOT last
  UNION ALL SELECT app_id, execution_id, 1, 'WholeStageCodegen (2)', NULL, 0, 'duration', 'timing', a3, m3 FROM x WHERE last
  UNION ALL SELECT app_id, execution_id, 2, 'SortMergeJoin', 2, 0, 'number of output rows', 'sum', a1, m1 FROM x WHERE last
  UNION ALL SELECT app_id, execution_id, 2, 'SortMergeJoin', 2, 1, 'spill size', 'size', a2, m2 FROM x WHERE last
  UNION ALL SELECT app_id, execution_id, 2, 'SortMergeJoin', 2, 2, 'sort time', 'nsTiming', a3, m3 FROM x WHERE last
  UNION ALL SELECT app_id, execution_id, 5, 'Scan parquet', 1, 0, 'number of files read', 'sum', a4, a4 FROM x WHERE last),
timed AS (SELECT *, CASE WHEN kind = 'nsTiming' THEN total // 1000000 ELSE total END AS ms FROM shown WHERE total IS NOT NULL),
metrics AS (
  SELECT *, CASE WHEN kind = 'sum' THEN format('{:,}', total)
       WHEN kind = 'size' THEN CASE WHEN total >= 2199023255552 THEN printf('%.1f TiB', round(total / 1099511627776.0, 1)) WHEN total >= 2147483648 THEN printf('%.1f GiB', round(total / 1073741824.0, 1))
         WHEN total >= 2097152 THEN printf('%.1f MiB', round(total / 1048576.0, 1)) WHEN total >= 2048 THEN printf('%.1f KiB', round(total / 1024.0, 1)) ELSE total || '.0 B' END
       WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN printf('%.1f s', round(ms / 1000.0, 1)) WHEN ms < 3600000 THEN printf('%.1f m', round(ms / 60000.0, 1))
       ELSE printf('%.2f h', round(ms / 3600000.0, 2)) END AS value FROM timed)"""


@query("event_log_plan_nodes", f"""WITH {_METRICS}
SELECT app_id, execution_id, CAST(node_id AS BIGINT) AS node_id, node_name, CAST(codegen_id AS BIGINT) AS codegen_id, CAST(pos AS BIGINT) AS pos, metric, kind, value, total, most FROM metrics""")
def event_log_plan_nodes(v):
    rows = plans.node_metrics(landed(v, plan_events(v)))
    return rows.select("app_id", "execution_id", "node_id", "node_name", "codegen_id", "pos", "metric", "kind", "value", "total", "most")


@query("event_log_top_metrics", f"""WITH {_METRICS},
ranked AS (SELECT *, row_number() OVER (PARTITION BY app_id, execution_id, node_id ORDER BY
    CASE metric WHEN 'number of output rows' THEN 1 WHEN 'spill size' THEN 2 WHEN 'sort time' THEN 4 WHEN 'duration' THEN 5 ELSE 9 END, pos) AS rank FROM metrics)
SELECT app_id, execution_id, CAST(node_id AS BIGINT) AS node_id, metric, value, rank, metric = 'spill size' AND value <> '0.0 B' AS hot FROM ranked WHERE rank <= 3""")
def event_log_top_metrics(v):
    return settings.node_top_metrics(plans.node_metrics(landed(v, plan_events(v))))


_BLOCKS = """
told AS (SELECT 'app-' || CAST(l_orderkey % 3 AS STRING) AS app_id, l_partkey % 20 AS rdd_id, 'rdd_' || CAST(l_partkey % 20 AS STRING) || '_' || CAST(l_orderkey % 50 AS STRING) AS block,
                CAST(l_suppkey % 4 AS STRING) AS executor_id, (l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS seq, l_linenumber % 4 <> 0 AS stored,
                CAST(l_quantity AS BIGINT) * 1024 AS memory_used, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_quantity AS BIGINT) * 10 ELSE CAST(0 AS BIGINT) END AS disk_used FROM {lineitem})"""


def block_events(v):
    """Block updates in the order of their orders; an executor is lost and a dataset freed on the way."""
    told = v.sql(f"WITH {_BLOCKS} SELECT * FROM told")
    managers = lambda: told.select("app_id", "executor_id").distinct()
    who = F.struct(_as("executor_id", "Executor ID"), F.lit("h").alias("Host"), F.col("executor_id").cast("long").alias("Port")).alias("Block Manager ID")
    level = F.struct(F.col("stored").alias("Use Memory"), (F.col("stored") & (F.col("disk_used") > 0)).alias("Use Disk")).alias("Storage Level")
    info = F.struct(who, F.col("block").alias("Block ID"), level, _as("memory_used", "Memory Size"), _as("disk_used", "Disk Size"))
    # Rolling files of 1000 orders; the place in a file is the order again.
    pos = lambda at: F.struct(F.floor(at / 1000000).alias("file"), F.lit(0).cast("long").alias("block"), at.alias("row")).alias("pos")
    at = lambda df, name, place, *fields: df.select("app_id", pos(place), F.to_json(F.struct(F.lit(name).alias("Event"), *fields)).alias("value"))
    apps = told.select("app_id").distinct()
    infos = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct(i.alias("RDD ID"), F.concat(F.lit("data "), i.cast("string")).alias("Name"), F.lit(60).alias("Number of Partitions")))
    number = lambda n: F.lit(n).cast("long")
    return ev.events_of(union_all([
        at(told, "SparkListenerBlockUpdated", F.col("seq"), info.alias("Block Updated Info")),
        at(managers(), "SparkListenerBlockManagerAdded", number(0), who, F.lit(1 << 30).cast("long").alias("Maximum Memory")),
        at(managers().where("executor_id = '3'"), "SparkListenerExecutorRemoved", number(2000500), _as("executor_id", "Executor ID"), F.lit(7).alias("Timestamp")),
        at(apps, "SparkListenerUnpersistRDD", number(3000500), F.lit(7).alias("RDD ID")),
        at(apps, "SparkListenerStageSubmitted", number(1), F.struct(F.lit(1).alias("Stage ID"), infos.alias("RDD Info")).alias("Stage Info")),
    ]))


_STORED = f"""{_BLOCKS},
last AS (SELECT *, row_number() OVER (PARTITION BY app_id, block, executor_id ORDER BY seq DESC) AS rn FROM told),
kept AS (SELECT * FROM last WHERE rn = 1 AND stored AND (executor_id <> '3' OR seq > 2000500) AND (rdd_id <> 7 OR seq > 3000500))"""


@query("event_log_storage", f"""WITH {_STORED},
held AS (SELECT app_id, rdd_id, count(DISTINCT block) AS parts, CAST(sum(memory_used) AS BIGINT) AS memory, CAST(sum(disk_used) AS BIGINT) AS disk FROM kept GROUP BY app_id, rdd_id)
SELECT 'rdd' AS what, app_id, 'data ' || rdd_id AS name, parts AS n, memory, disk FROM held
UNION ALL SELECT 'cache', app_id, CAST(CAST(sum(CASE WHEN parts < 60 THEN 1 ELSE 0 END) AS BIGINT) AS VARCHAR), count(*), CAST(sum(memory) AS BIGINT), CAST(sum(disk) AS BIGINT) FROM held GROUP BY app_id
UNION ALL SELECT 'executor', app_id, executor_id, count(*), CAST(sum(memory_used) AS BIGINT), CAST(sum(disk_used) AS BIGINT) FROM kept GROUP BY app_id, executor_id""")
def event_log_storage(v):
    """Cached datasets, their sums per application, and what each executor stores."""
    events, blocks = replayed_blocks(v)
    rdds = storage.rdds(events, blocks)
    shape = lambda what, df, name, n: df.select(
        F.lit(what).alias("what"), "app_id", F.col(name).cast("string").alias("name"), F.col(n).alias("n"), F.col("memory_used").alias("memory"), F.col("disk_used").alias("disk")
    )
    counts = blocks.groupBy("app_id", "executor_id").agg(F.count(F.lit(1)).alias("n"))
    use = storage.executor_usage(events, blocks).join(counts, ["app_id", "executor_id"])
    return union_all([
        shape("rdd", rdds, "name", "num_cached_partitions"), shape("cache", resources.cache_summary(rdds), "partly_cached", "cached"), shape("executor", use, "executor_id", "n"),
    ])


@query("event_log_spread", f"""WITH {_STORED},
used AS (SELECT app_id, executor_id, CAST(sum(memory_used) AS BIGINT) AS used FROM kept GROUP BY app_id, executor_id),
total AS (SELECT app_id, rdd_id, CAST(sum(memory_used) AS BIGINT) AS total FROM kept GROUP BY app_id, rdd_id)
SELECT k.app_id, k.rdd_id, 'h:' || k.executor_id AS address, count(*) AS partitions, CAST(sum(k.memory_used) AS BIGINT) AS memory_used, 1073741824 - max(u.used) AS memory_remaining,
       CAST(sum(k.memory_used) AS DOUBLE) / max(t.total) AS share
FROM kept k JOIN used u ON k.app_id = u.app_id AND k.executor_id = u.executor_id JOIN total t ON k.app_id = t.app_id AND k.rdd_id = t.rdd_id GROUP BY k.app_id, k.rdd_id, k.executor_id""")
def event_log_spread(v):
    events, blocks = replayed_blocks(v)
    rows = resources.rdd_spread(storage.rdd_distribution(events, blocks), blocks)
    return rows.select("app_id", "rdd_id", "address", "partitions", "memory_used", "memory_remaining", "share")


def exclusion_events(v):
    """Executors excluded and released, excluded for good, excluded with their node, and for one stage."""
    ex = v.fx_executors.withColumn("host", F.substring_index("host_port", ":", 1)).withColumn("n", F.col("executor_id").cast("long"))
    added = _event(ex, "SparkListenerExecutorAdded", _as("add_ms", "Timestamp"), _as("executor_id", "Executor ID"), F.struct(_as("host", "Host")).alias("Executor Info"))
    gone = _event(ex.where("NOT is_active"), "SparkListenerExecutorRemoved", _as("remove_ms", "Timestamp"), _as("executor_id", "Executor ID"))
    turn = lambda df, name, at, *fields: _event(df, ev.SCHEDULER + name, at.alias("time"), *fields)
    own, node = _as("executor_id", "executorId"), _as("host", "hostId")
    odd, hosts = ex.where("n % 2 = 1"), ex.select("app_id", "host").distinct()
    even = hosts.where("CAST(substring(host, 6) AS INT) % 2 = 0")
    stage = [F.lit(20).alias("stageId"), F.lit(0).alias("stageAttemptId")]
    done = F.struct(F.lit(20).alias("Stage ID"), F.lit(0).alias("Stage Attempt ID"), F.lit(_START + 50000).alias("Completion Time")).alias("Stage Info")
    return ev.events_of(union_all([
        added, gone, turn(odd, "ExecutorExcluded", F.col("add_ms") + 100, own), turn(odd, "ExecutorExcluded", F.col("add_ms") + 150, own),
        turn(odd, "ExecutorUnexcluded", F.col("add_ms") + 200, own), turn(ex.where("is_excluded"), "ExecutorExcluded", F.col("add_ms") + 300, own),
        turn(hosts, "NodeExcluded", F.lit(_START + 20000), node), turn(even, "NodeUnexcluded", F.lit(_START + 20500), node),
        turn(ex.where("n % 6 = 5"), "ExecutorExcludedForStage", F.col("add_ms") + 50, own, *stage),
        _event(ex.select("app_id").distinct().where("app_id <> 'app-2'"), "SparkListenerStageCompleted", done),
    ]))


@query("event_log_exclusions", f"""
WITH ex AS (SELECT app_id, executor_id, CAST(executor_id AS BIGINT) AS n, CAST(substring(split_part(host_port, ':', 1), 6) AS INT) AS nation, add_ms, remove_ms, is_excluded FROM fx_executors),
spans AS (
  SELECT app_id, executor_id, NULL AS stage_id, 'executor' AS rule, add_ms + 100 AS from_ms, add_ms + 200 AS to_ms, remove_ms FROM ex WHERE n % 2 = 1
  UNION ALL SELECT app_id, executor_id, NULL, 'executor', add_ms + 300, NULL, remove_ms FROM ex WHERE is_excluded
  UNION ALL SELECT app_id, executor_id, NULL, 'node', {_START + 20000}, CASE WHEN nation % 2 = 0 THEN {_START + 20500} END, remove_ms FROM ex
    WHERE add_ms <= {_START + 20000} AND (remove_ms IS NULL OR remove_ms > {_START + 20000})
  UNION ALL SELECT app_id, executor_id, 20, 'executor', add_ms + 50, CASE WHEN app_id <> 'app-2' THEN {_START + 50000} END, remove_ms FROM ex WHERE n % 6 = 5)
SELECT app_id, executor_id, CAST(stage_id AS BIGINT) AS stage_id, rule, from_ms, least(to_ms, remove_ms) AS to_ms FROM spans""")
def event_log_exclusions(v):
    return exclusions.exclusions(exclusion_events(v)).select("app_id", "executor_id", "stage_id", "rule", "from_ms", "to_ms")
