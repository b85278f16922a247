"""Operators on literal tables with known results."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from cinderview.functions import filters
from cinderview.operators import (
    batches as bt, failures as fl, logs, progress as pg, rates, registry as reg, report, resources as res, settings, stats, threads as th,
)
from cinderview.sources import registry_json

MIB = 1024 * 1024


def test_skew_ratio_floor_and_infinity(spark):
    # Above the floor of a second, below it, and a median of nothing.
    rows = [("u", "gc time", 250.0, 2000.0), ("v", "gc time", 3.0, 999.0), ("w", "input", 0.0, 1.0 * MIB), ("x", "input", 4.0 * MIB, 11.0 * MIB)]
    df = spark.createDataFrame(rows, "s string, metric string, median double, max double")
    marked = stats.with_skew(df, dict(stats.TASK_METRICS))
    got = {r.s: (r.ratio, r.flagged) for r in marked.collect()}
    assert got == {"u": (8.0, True), "v": (None, False), "w": (float("inf"), True), "x": (2.75, False)}
    assert {r.s: r.skew for r in stats.skew_text(marked, ["s"]).collect()} == {"u": "gc time ×8.0", "w": "input ×∞"}


def _tasks(spark, durations, status="SUCCESS"):
    rows = [("a", 1, 0, i, 0, str(i % 3), d, status) for i, d in enumerate(durations)]
    return spark.createDataFrame(
        rows, "app_id string, stage_id long, attempt_id long, task_id long, attempt long, executor_id string, duration_ms long, status string"
    )


def test_stragglers_need_three_medians_of_100_ms(spark):
    keys = stats.STAGE
    slow = _tasks(spark, [120, 200, 200, 240, 599, 600, 1500])
    # The median (rank 3 of 7) is 240, so 720 is the bound.
    assert [(r.duration_ms, r.note) for r in stats.stragglers(slow, keys, "duration_ms").collect()] == [(1500, "straggler ×6.2")]
    assert stats.stragglers(_tasks(spark, [99, 99, 99, 5000]), keys, "duration_ms").count() == 0
    assert stats.stragglers(_tasks(spark, [100, 100, 100, 300]), keys, "duration_ms").first().duration_ms == 300


def test_median_falls_back_to_all_succeeded_tasks(spark):
    tasks = _tasks(spark, [7 * i for i in range(250)])
    none = spark.createDataFrame([], "app_id string, stage_id long, attempt_id long, p50 double")
    assert stats.median_duration(tasks, none).first().median_ms == 7 * 125
    known = spark.createDataFrame([("a", 1, 0, 31.5)], none.schema)
    assert stats.median_duration(tasks, known).first().median_ms == 31.5
    assert stats.median_duration(_tasks(spark, [64], "FAILED"), none).first().median_ms == 0.0


def test_executors_with_failures_or_slow_tasks_come_first(spark):
    # Stage mean: 66000 ms over 110 tasks, 600 ms.
    rows = [("p", 12_000, 40, 0, False), ("q", 26_000, 40, 0, False), ("r", 24_000, 20, 0, False), ("s", 4_000, 9, 1, True)]
    df = spark.createDataFrame(
        [("a", 9, 0, e, t, ok, bad, 0, out) for e, t, ok, bad, out in rows],
        "app_id string, stage_id long, attempt_id long, executor_id string, task_time long, succeeded_tasks long, failed_tasks long, killed_tasks long, is_excluded boolean",
    )
    got = stats.executor_order(stats.executor_flags(df)).collect()
    assert [(r.executor_id, r.reason) for r in got] == [("r", "2.0× stage avg"), ("s", "1 failed · excluded"), ("q", ""), ("p", "")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _stage_tables(spark):
    """One stage with five tasks, and what its reports read."""
    tasks = spark.createDataFrame(
        [("a", 1, 0, i, 0, str(i % 2), d, s, x, "E: x" if s == "FAILED" else None) for i, (d, s, x) in enumerate(
            [(100, "SUCCESS", "ANY"), (200, "SUCCESS", "ANY"), (300, "SUCCESS", "HOST"), (900, "SUCCESS", None), (50, "FAILED", "ANY")])],
        "app_id string, stage_id long, attempt_id long, task_id long, attempt long, executor_id string, duration_ms long, status string, locality string, error_message string",
    ).withColumns({"shuffle_read_bytes": F.lit(0), "spill_bytes": F.lit(0)})
    stages = spark.createDataFrame(
        [("a", 1, 0, "COMPLETE", 10, 1000)], "app_id string, stage_id long, attempt_id long, status string, jvm_gc_time long, executor_run_time long"
    )
    per_executor = stats.rollup_executors(tasks).withColumn("is_excluded", F.lit(False))
    return stages, tasks, per_executor


def test_stage_detail_makes_its_quantiles_once(spark):
    _, tasks, per_executor = _stage_tables(spark)
    found = report.stage_detail(tasks, per_executor, {"duration": ("duration_ms", "ms")})
    assert "collect_list" not in _plan(found)
    assert "Join" not in _plan(stats.executor_flags(per_executor))
    assert sorted((r.part, r.subject, r.amount, r.note) for r in found.collect()) == [
        ("executors", "0", 450, "1 failed"), ("executors", "1", 1100, ""), ("failed", "4", 50, "E: x"),
        ("quantiles", "duration", 900, "100 200 300 900 900"),
        ("slowest", "0", 100, ""), ("slowest", "1", 200, ""), ("slowest", "2", 300, ""), ("slowest", "3", 900, "straggler ×3.0"), ("slowest", "4", 50, ""),
    ]


def test_stage_report_counts_locality_and_stragglers_in_one_shuffle(spark, monkeypatch):
    stages, tasks, per_executor = _stage_tables(spark)
    monkeypatch.setattr(stats, "locality", None)
    got = report.stage_report(stages, tasks, per_executor, {"duration": ("duration_ms", "ms")}).first()
    assert (got.locality, got.tasks, got.mostly_remote) == ("locality (of 5 tasks) ANY 3 · HOST 1", 5, True)
    assert (got.stragglers, got.median_ms, got.max_ms, got.flagged_executors) == (1, 300.0, 900.0, 1)


def test_slowest_stages_are_looked_up_once(spark):
    stages, tasks, _ = _stage_tables(spark)
    found = stats.slowest_stages(stages, tasks, {"duration": ("duration_ms", "ms")})
    assert "jvm_gc_time#" not in "".join(line for line in _plan(found).splitlines() if "LogicalRDD" in line)
    assert [(r.stage_id, r["rank"], r.skew) for r in found.collect()] == [(1, 1, None)]


def test_locality_text(spark):
    levels = ["RACK_LOCAL"] * 120 + ["ANY"] * 130 + ["PROCESS_LOCAL", "", None, "HOST"]
    df = spark.createDataFrame([("a", 1, 0, x) for x in levels], "app_id string, stage_id long, attempt_id long, locality string")
    got = stats.locality(df).first()
    assert got.line == "locality (of 254 tasks) PROCESS_LOCAL 1 · RACK_LOCAL 120 · ANY 130 · HOST 1" and got.mostly_remote


def _poll(spark, n, reason="Job aborted"):
    stages = spark.createDataFrame(
        [("a", n, 4, 0, "FAILED", "collect", reason)],
        "app_id string, poll long, stage_id long, attempt_id long, status string, name string, failure_reason string",
    )
    jobs = spark.createDataFrame(
        [("a", n, 1, "FAILED", "job", 1, 4)],
        "app_id string, poll long, job_id long, status string, name string, num_failed_stages long, num_failed_tasks long",
    )
    executors = spark.createDataFrame(
        [("a", n, "2", "h:1", False, False, "node drained", 1), ("a", n, "3", "h:2", True, True, None, 4)],
        "app_id string, poll long, executor_id string, host_port string, is_active boolean, is_excluded boolean, remove_reason string, failed_tasks long",
    )
    sql = spark.createDataFrame(
        [("a", n, 11, "FAILED", "q", "SparkException"), ("a", n, 12, "FAILED", "orders\nid = q", " ")],
        "app_id string, poll long, execution_id long, status string, description string, error_message string",
    )
    tasks = spark.createDataFrame(
        [("a", n, 412, 3, 4, 0, "2", "h", "FAILED", "DiskFullError"), ("a", n, 413, 0, 4, 0, "2", "h", "SUCCESS", None)],
        "app_id string, poll long, task_id long, attempt long, stage_id long, attempt_id long, executor_id string, host string, status string, error_message string",
    )
    return dict(stages=stages, jobs=jobs, executors=executors, sql=sql, tasks=tasks)


@pytest.fixture()
def bridges(spark):
    return dict(
        job_stages=spark.createDataFrame([("a", 1, 4), ("a", 1, 3)], "app_id string, job_id long, stage_id long"),
        sql_jobs=spark.createDataFrame([("a", 12, 1, "failed")], "app_id string, execution_id long, job_id long, state string"),
    )


def test_one_failure_per_key_across_polls(spark, bridges):
    first, second = _poll(spark, 1, None), _poll(spark, 2)
    both = {k: first[k].unionByName(second[k]) for k in first}
    log = {r.key: r for r in fl.numbered(fl.failure_log(**both, **bridges)).collect()}
    assert sorted(log) == ["exec:2:removed", "exec:3:excluded", "job:1", "sql:11", "sql:12", "stage:4.0", "task:412.3"]
    assert all(r.first_poll == 1 for r in log.values())
    # The reason arrived with the second poll; the job's text was complete in the first.
    assert log["stage:4.0"].detail == "Job aborted"
    assert log["job:1"].detail == "1 of 2 stages failed, 4 tasks failed"
    assert log["sql:12"].detail == "stage 4.0: Job aborted" and log["sql:12"].stage_id == 4
    assert log["sql:12"].title == "Query #12 failed · orders"
    order = sorted(log.values(), key=lambda r: r.seq)
    assert [r.kind for r in order] == ["stage", "job", "executor", "executor", "sql", "sql", "task"]
    assert [r.seq for r in order] == list(range(1, 8))


def test_job_detail_carries_the_stage_reason(spark, bridges):
    log = {r.key: r for r in fl.failure_log(**_poll(spark, 1), **bridges).collect()}
    assert log["job:1"].detail.endswith("\nstage 4.0: Job aborted")
    assert (log["job:1"].stage_id, log["job:1"].attempt_id) == (4, 0)
    summary = fl.unacked_summary(fl.numbered(fl.failure_log(**_poll(spark, 1), **bridges)), 5).first()
    assert (summary.unacked, summary.latest_title) == (2, "Task 412.3 failed · stage 4.0 · executor 2 (h)")


def test_failure_growth(spark):
    rows = [("a", p, s, 0, n) for s, ns in ((1, [0, 2, 2]), (2, [1, 1, 3])) for p, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "app_id string, poll long, stage_id long, attempt_id long, num_failed_tasks long")
    got = sorted((r.poll, r.stage_id, r.previous) for r in fl.failure_growth(df).collect())
    assert got == [(0, 2, 0), (1, 1, 0), (2, 2, 1)]


def test_rates(spark):
    df = spark.createDataFrame([("k", 0, 100.0), ("k", 2, 120.0), ("k", 30000, 20.0)], "key string, ts long, v double")
    got = {r.ts: r.rate for r in rates.counter_rate(df, ["key"], "ts", "v").collect()}
    assert got[0] is None and got[2] == 10.0 and got[30000] < 0
    samples = spark.createDataFrame(
        [("a", 0, 0, 4, 2, 0), ("a", 2, 9, 6, 3, 1), ("a", 4, 8, 5, 1, 2)],
        "app_id string, poll_s long, completed_tasks long, active_tasks long, alive_executors long, removed_executors long",
    )
    assert tuple(rates.task_rate(samples).first()) == ("a", 0.0, 4.5, 5, 6)
    assert tuple(rates.executor_churn(samples).first()) == ("a", 1, 3, 2)


def _registry(rejected, cpu_ns):
    """A registry dump of an invented application with two sources of its own."""
    own = "shop-7.driver.Basket."
    spark_own = "shop-7.driver."
    return json.dumps({
        "gauges": {
            own + "depth": {"value": 17}, own + "ratio": {"value": 0.125}, own + "mode": {"value": "drain"}, own + "open": {"value": False},
            own + "empty": {"value": None}, "shop-7.driver.Ads.shown": {"value": 3}, spark_own + "spark.streaming.returns.latency": {"value": 640},
            spark_own + "BlockManager.memory.memUsed_MB": {"value": 96}, spark_own + "BlockManager.memory.remainingMem_MB": {"value": 288},
            spark_own + "DAGScheduler.stage.waitingStages": {"value": 5}, "shop-7.3.executor.filesystem.file.read_ops": {"value": 8},
            "worker.cores": {"value": 16},
        },
        "counters": {own + "refused": {"count": rejected}, spark_own + "LiveListenerBus.queue.shared.numDroppedEvents": {"count": 0},
                     spark_own + "JVMCPUTime.jvmCpuTime": {"count": cpu_ns}},
        "meters": {own + "sold": {"count": 640, "m1_rate": 8.0, "m5_rate": 4.0, "mean_rate": 2.0, "units": "events/second"}},
        "timers": {spark_own + "DAGScheduler.messageProcessingTime": {"count": 12, "max": 70.0, "mean": 9.5, "p50": 4.0, "p95": 33.0,
                                                                     "m1_rate": 1.0, "duration_units": "milliseconds"}},
    })


def test_registry_rows_order_and_health(spark):
    polls = [("a", 10, _registry(40, 1_000_000_000)), ("a", 14, _registry(50, 7_000_000_000))]
    metrics = registry_json.with_named_fields(registry_json.parse_metrics(spark.createDataFrame(polls, "app_id string, poll_s long, json string")))
    now = {r.key: r for r in metrics.where("poll_s = 14").collect()}
    # Executors' and the worker's own entries are not the driver's.
    assert len(now) == 15 and "worker.cores" not in now
    value = lambda key: (now[key].value, now[key].text)
    assert [value(f"Basket.{k}") for k in ("depth", "ratio", "mode", "open", "empty")] == [
        (17.0, None), (0.125, None), (None, "drain"), (0.0, None), (None, None)
    ]
    assert (now["Basket.sold"].kind, now["Basket.sold"].value, now["Basket.sold"].m5_rate) == ("meter", 640.0, 4.0)
    timer = now["DAGScheduler.messageProcessingTime"]
    assert (timer.kind, timer.p95, timer.max, timer.units) == ("timer", 33.0, 70.0, "milliseconds")
    stream = now["spark.streaming.returns.latency"]
    assert (stream.source, stream.name) == ("spark.streaming.returns", "latency")
    places = {s: i for i, s in reversed(list(enumerate(r.source for r in reg.metric_order(metrics.where("poll_s = 14")).collect())))}
    assert max(places["Ads"], places["Basket"]) < places["spark.streaming.returns"] < places["LiveListenerBus"]
    health = {r.label: (r.value, r.warn) for r in reg.driver_health(metrics).where("poll_s = 14").collect()}
    assert health["listener events dropped"] == ("0", False)
    # Six seconds of CPU in four seconds.
    assert health["driver CPU"] == ("1.50 cores", False)
    assert health["block manager memory"] == ("96 of 384 MiB (25%)", False)
    assert filters.metric_filter(metrics, "BASKET").where("poll_s = 14").count() == 7
    head, detail = reg.metric_text("2.5D")
    assert tuple(metrics.where("poll_s = 14 AND name = 'refused'").select(head, detail).first()) == ("50", "2.50/s since last poll")


def _thread(name, state, lock=None, frames=()):
    return ("a", "1", name, state, lock, None, list(frames), 1)


def test_thread_order(spark):
    rows = [
        _thread("timer", "WAITING", None, ["java.util.TimerThread.mainLoop"]),
        _thread("reader-9", "BLOCKED", "java.lang.Object@5", ["com.shop.Cache.get"]),
        _thread("Executor task launch worker for task 8.0", "RUNNABLE", None, ["org.apache.spark.sql.catalyst.expressions.Murmur3Hash"]),
        _thread("Executor task launch worker for task 2.1", "BLOCKED", "com.shop.Cache@1", ["com.shop.Cache.put"]),
        _thread("main", "RUNNABLE", None, ["com.shop.Main.loop"]),
    ]
    df = spark.createDataFrame(
        rows, "app_id string, executor_id string, thread_name string, thread_state string, lock_name string, blocked_by_thread_id long, frames array<string>, thread_id long"
    )
    names = [r.thread_name for r in th.thread_groups(df).collect()]
    # Waiting for a lock, then task threads, then running ones, then the rest.
    assert set(names[:2]) == {"reader-9", "Executor task launch worker for task 2.1"}
    assert names[2:] == ["Executor task launch worker for task 8.0", "main", "timer"]
    assert [r.thread_name for r in filters.thread_filter(df, "murmur3").collect()] == ["Executor task launch worker for task 8.0"]


def test_memory_verdicts(spark):
    gib = 1024 * MIB
    rows = [("1", 4 * gib, 512 * MIB, 1 * gib, int(4.2 * gib)), ("2", 4 * gib, 512 * MIB, int(3.9 * gib), 4 * gib), ("3", 4 * gib, 512 * MIB, gib, gib)]
    df = spark.createDataFrame(
        [("a", e, h, o, None, h + o, 0.6, peak, rss, 5, 6) for e, h, o, peak, rss in rows],
        "app_id string, executor_id string, heap long, overhead long, off_heap long, container long, fraction double, peak_heap long, peak_rss long, major_gc_ms long, minor_gc_ms long",
    )
    got = {r.executor_id: r for r in res.memory_verdict(df).collect()}
    assert [got[e].verdict for e in "123"] == ["overhead", "heap", "ok"]
    assert got["1"].unified_budget == int((4 * gib - 300 * MIB) * 0.6) and got["1"].gc_ms == 11
    assert [r.executor_id for r in res.heap_pressure(df).collect()] == ["2"]


def test_node_metrics_prefer_useful_names(spark):
    metrics = ["sort time", "data size in bytes", "number of output rows", "peak memory total", "sort time", "spill size"]
    values = ["4 ms", "77", "12", "1.5 MiB", "9 ms", "0.0 B"]
    df = spark.createDataFrame(
        [("a", 1, 1, i, m, x) for i, (m, x) in enumerate(zip(metrics, values))],
        "app_id string, execution_id long, node_id long, pos long, metric string, value string",
    )
    got = settings.node_top_metrics(df, 4).orderBy("rank").collect()
    assert [(r.metric, r.value, r.hot) for r in got] == [
        ("number of output rows", "12", False), ("spill size", "0.0 B", False), ("peak memory total", "1.5 MiB", False), ("sort time", "4 ms", False)
    ]
    spilled = df.where("metric = 'spill size'").withColumn("value", F.lit("3.0 KiB"))
    assert settings.node_top_metrics(spilled).first().hot


def _progress(spark, rows):
    """(id, run, name, batch, arrival, input rows, in/s, processed/s)"""
    return spark.createDataFrame(
        [("a", *r[:4], r[4], 1_790_330_400_000 + r[4] * 1000, *r[5:], 1000 + r[3] * 10, 5, 64, None, 0) for r in rows],
        "app_id string, query_id string, run_id string, name string, batch_id long, arrival long, started_ms long, num_input_rows long, input_rps double, "
        "processed_rps double, trigger_ms long, state_rows long, state_bytes long, watermark_ms long, rows_dropped long",
    )


def _sql(spark, rows):
    return spark.createDataFrame(
        [("a", *r) for r in rows],
        "app_id string, query_id string, run_id string, name string, batch_id long, execution_id long, status string, submitted_ms long, duration_ms long",
    )


def test_progress_upgrades_sql_batches_and_a_new_run_resets(spark):
    p = [("q", "r", "agg", 2, 5, 100, 10.0, 10.0), ("q", "r", "agg", 2, 9, 100, 99.0, 99.0)]
    sql = _sql(spark, [("q", "r", "agg", 1, 1, "COMPLETED", None, 900), ("q", "r", "agg", 2, 2, "RUNNING", 7, 1), ("q", "r", "agg", 2, 3, "COMPLETED", None, 950)])
    got = {r.batch_id: r for r in bt.merge_batches(_progress(spark, p), sql).collect()}
    assert sorted(got) == [1, 2]
    assert (got[1].duration_ms, got[1].has_progress, got[1].status) == (900, False, "COMPLETED")
    assert (got[2].duration_ms, got[2].status, got[2].submitted_ms, got[2].input_rps) == (1020, "COMPLETED", 7, 10.0)
    p.append(("q", "r2", "agg", 3, 20, 100, 10.0, 10.0))
    assert [r.batch_id for r in bt.merge_batches(_progress(spark, p), sql).collect()] == [3]


def test_superseded_ids_and_runs_do_not_return(spark):
    rows = [
        ("q1", "r1", "poison", 4, 1, 1, 1.0, 1.0), ("q2", "r2", "poison", 0, 2, 1, 1.0, 1.0), ("q1", "r1", "poison", 4, 3, 1, 1.0, 1.0),
        ("q3", "r3", "raw", 9, 4, 1, 1.0, 1.0), ("q3", "r4", "raw", 0, 5, 1, 1.0, 1.0), ("q3", "r3", "raw", 10, 6, 1, 1.0, 1.0),
        ("u1", "x", None, 1, 7, 1, 1.0, 1.0), ("u2", "x", None, 1, 8, 1, 1.0, 1.0),
    ]
    df = _progress(spark, rows)
    got = sorted((r.query_id, r.run_id, r.batch_id) for r in bt.current_run(df, "arrival").collect())
    assert got == [("q2", "r2", 0), ("q3", "r4", 0), ("u1", "x", 1), ("u2", "x", 1)]
    assert [r.query_id for r in bt.retired_ids(df, "arrival").collect()] == ["q1"]


def test_falling_behind_takes_five_then_drops_empty_batches(spark):
    fine = [("q", "r", "n", b, b, 100, 100.0, 120.0) for b in range(10)]
    slow = [("q", "r", "n", b, b, 100, 100.0, 80.0) for b in range(10, 14)]
    empty = [("q", "r", "n", b, b, 0, 100.0, 0.0) for b in range(14, 17)]
    verdict = lambda rows: bt.falling_behind(_progress(spark, rows), bt.QUERY, "batch_id").first().behind
    assert not verdict(fine)
    assert verdict(fine + slow)
    assert not verdict(fine + slow + empty)


def test_batch_statistics(spark):
    sql = _sql(spark, [("q", "r", "n", b, b, "COMPLETED", b, d) for b, d in enumerate([0, 10, 20, 30, 45])])
    batches = bt.merge_batches(_progress(spark, []), sql)
    assert bt.retain_batches(batches).count() == 5
    assert sorted(r.batch_id for r in bt.retain_batches(batches, 2).collect()) == [3, 4]
    got = bt.batch_stats(batches).first()
    assert (got.batches, got.mean_ms, got.p95_ms, got.max_ms) == (5, 26, 45, 45)
    assert bt.log_read_from(sql).first().read_from_ms == -1000
    assert bt.log_read_from(sql, keep=2).first().read_from_ms == 3 - 1000
    assert bt.log_read_from(sql, as_of_ms=10**9, back_ms=5000).first().read_from_ms == 10**9 - 5000


def test_phases(spark):
    df = spark.createDataFrame([({"addBatch": 900, "getBatch": 10, "queryPlanning": 30, "triggerExecution": 1200, "walCommit": -5},)], "phases map<string,long>")
    assert tuple(df.select(*bt.phase_columns()).first()) == (900, 40)


def test_labels_and_restarts(spark):
    sql = spark.createDataFrame(
        [("a", 22, "orders-poison\nid = q\nrunId = r\nbatch = 3"), ("a", 30, "later")], "app_id string, execution_id long, description string"
    )
    sql_jobs = spark.createDataFrame([("a", 22, 9), ("a", 30, 9), ("a", 30, 10)], "app_id string, execution_id long, job_id long")
    bridge = spark.createDataFrame([("a", 9, 30), ("a", 9, 31), ("a", 10, 31)], "app_id string, job_id long, stage_id long")
    jobs = bt.job_labels(sql, sql_jobs)
    assert {r.job_id: r.label for r in jobs.collect()} == {9: "sql #22 · orders-poison · batch 3", 10: "sql #30 · later"}
    assert {r.stage_id: r.label for r in bt.stage_labels(jobs, bridge).collect()} == {30: "sql #22 · orders-poison · batch 3", 31: "sql #30 · later"}
    desc = lambda run: f"orders-poison\nid = q\nrunId = {run}\nbatch = 4"
    rows = [("a", 1, "n", desc("aaaaaaaa-1")), ("a", 2, "n", desc("bbbbbbbb-2")), ("a", 3, "n", "orders-raw\nid = x\nrunId = cccccccc\nbatch = 9")]
    df = spark.createDataFrame(rows, "app_id string, job_id long, name string, description string")
    named = bt.named_rows(df, jobs, bt.restarted_queries(df), ["app_id", "job_id"])
    assert {r.job_id: r.display_name for r in named.collect()} == {
        1: "orders-poison · batch 4 · run aaaaaaaa", 2: "orders-poison · batch 4 · run bbbbbbbb", 3: "orders-raw · batch 9"
    }


def _lines(spark, texts, file="f"):
    return spark.createDataFrame([("a", file, i, t) for i, t in enumerate(texts)], "app_id string, file string, line_no long, line string")


# Times of one morning, as minute and second; indented lines carry none.
LOG = [
    "banner without a time", "31/03/04 07:20:00 INFO Boot: ready", "31/03/04 07:21:10 INFO Load: batch 60 opened", "    rows 5120",
    "31/03/04 07:21:40 WARN Load: slow disk", "    retry 1", "31/03/04 07:30:00 INFO Load: closed", "31/03/04 07:21:30 INFO Late: written late",
    "    see batch 6",
]


def _at(clock):
    return int(dt.datetime.fromisoformat(f"2031-03-04T{clock}+00:00").timestamp() * 1000)


def test_time_slice_keeps_continuations_and_stops_past_its_end(spark):
    got = logs.log_slice(_lines(spark, LOG), _at("07:21:00"), _at("07:22:00")).orderBy("line_no").collect()
    # Line 7 is dated inside, but stands behind the first line past the end.
    assert [r.line_no for r in got] == [2, 3, 4, 5]


def test_batch_windows_and_named_lines(spark):
    batches = spark.createDataFrame(
        [("a", "q", 60, _at("07:21:05"), _at("07:21:35")), ("a", "q", 6, None, None), ("a", "q", 61, _at("09:00:00"), _at("09:05:00")),
         ("a", "q", 62, _at("07:25:00"), _at("07:26:00"))],
        "app_id string, query_id string, batch_id long, from_ms long, to_ms long",
    )
    got = sorted((r.batch_id, r.line_no) for r in logs.batch_log_slice(batches, _lines(spark, LOG)).collect())
    # As a text search, "batch 6" is also found in "batch 60".
    assert got == [(6, 2), (6, 8), (60, 2), (60, 3), (60, 7), (60, 8)]
    why = {r.batch_id: r.reason for r in logs.window_reason(batches, _lines(spark, LOG), ["query_id", "batch_id"]).collect()}
    assert why == {61: "log ends before the window", 62: "no line is dated inside the window"}


def test_windows_of_any_length_are_few_pieces(spark):
    day, start = 24 * 3600_000, _at("00:00:00")
    spans = [(0, start, start + 10 * day), (1, start + 5, start + 5), (2, start + 100, start + 40_000), (3, start, start - 1), (4, -(2**63), 2**63 - 1),
             (5, -50_000, 50_000), (6, start - 3 * day, start + 3_600_000)]
    windows = spark.createDataFrame([("a", *s) for s in spans], "app_id string, id long, from_ms long, to_ms long")
    pieces = {}
    for r in logs.window_pieces(windows).collect():
        pieces.setdefault(r.id, []).append((r._piece << (13 + r._level), (r._piece + 1) << (13 + r._level)))
    assert max(map(len, pieces.values())) <= 64 and len(pieces[0]) <= 34 and len(pieces[1]) == 1
    for i, a, b in spans:
        got = sorted(pieces.get(i, []))
        assert all(x[1] == y[0] for x, y in zip(got, got[1:]))
        if a <= b:
            assert got[0][0] <= a and got[-1][1] > b and a - got[0][0] < 8192 and got[-1][1] - b <= 8192

    rng = random.Random(7)
    times = [start + rng.randrange(-4 * day, 12 * day) for _ in range(400)] + [start, start + 10 * day, start + 5, start + 3_600_000, None]
    filled = spark.createDataFrame([("a", "f", i, t) for i, t in enumerate(times)], "app_id string, file string, line_no long, time_ms long")
    got = sorted((r.id, r.line_no) for r in logs.in_windows(windows, filled).collect())
    assert got == sorted((i, n) for i, a, b in spans for n, t in enumerate(times) if t is not None and a <= t <= b)


def test_lines_meet_long_windows_once(spark):
    rng = random.Random(5)
    start, hour = _at("00:00:00"), 3600_000
    # 3000 lines of ten hours, and 2000 of one moment.
    times = [start + rng.randrange(10 * hour) for _ in range(3000)] + [start + hour] * 2000 + [None] * 5
    spans = [(i, start + rng.randrange(5 * hour)) for i in range(40)]
    spans = [(i, a, a + rng.randrange(1, 12) * hour) for i, a in spans] + [(40, start - hour, start - 1), (41, start, start - 1), (42, start + hour, start + hour)]
    spans += [spans[0], (43, None, None), (44, -(2**63), 2**63 - 1)]
    windows = spark.createDataFrame([("a", *s) for s in spans], "app_id string, id long, from_ms long, to_ms long")
    filled = spark.createDataFrame([("a", "f", i, t) for i, t in enumerate(times)], "app_id string, file string, line_no long, time_ms long")
    cells, lines = logs.time_cells(windows, filled)
    sizes = [r["count"] for r in lines.groupBy("_cell").count().collect()]
    assert sum(sizes) == 5000 and max(sizes) < 1.5 * logs.LINES_PER_CELL
    pairs = sorted((i, n) for i, a, b in spans if a is not None for n, t in enumerate(times) if t is not None and a <= t <= b)
    assert cells.count() <= len(pairs) / logs.LINES_PER_CELL + 2 * len(spans)
    assert sorted((r.id, r.line_no) for r in logs.in_windows(windows, filled).collect()) == pairs


def test_lines_of_windows_are_counted_without_pairs(spark):
    rng = random.Random(9)
    start, day = _at("00:00:00"), 24 * 3600_000
    spans = [(i, start + rng.randrange(3 * day), rng.randrange(2 * day)) for i in range(60)]
    spans = [(i, a, a + n) for i, a, n in spans] + [(60, start, start), (61, start, start - 1), (62, start - 9, start + 9 * day), (63, None, None)]
    times = [start + rng.randrange(3 * day) // 1000 * 1000 for _ in range(500)] + [start] * 3 + [spans[0][1], spans[0][2], None]
    windows = spark.createDataFrame([("a", *s) for s in spans], "app_id string, id long, from_ms long, to_ms long")
    filled = spark.createDataFrame([(app, t) for t in times for app in "ab"], "app_id string, time_ms long")
    got = {r.id: r.lines for r in logs.lines_in_windows(windows, filled, ["id"]).collect()}
    inside = {i: sum(t is not None and a <= t <= b for t in times) for i, a, b in spans if a is not None}
    assert got == {i: n for i, n in inside.items() if n}

    batches = spark.createDataFrame(
        [("a", "q", 60, _at("07:21:05"), _at("07:21:35")), ("a", "q", 6, None, None), ("a", "q", 61, _at("09:00:00"), _at("09:05:00"))],
        "app_id string, query_id string, batch_id long, from_ms long, to_ms long",
    )
    assert {r.batch_id: r.lines for r in logs.batch_log_counts(batches, _lines(spark, LOG)).collect()} == {6: 2, 60: 4}


def test_failures_of_batches_read_the_failure_log_once(spark):
    text = lambda n: f"orders\nid = q\nrunId = r\nbatch = {n}"
    jobs = spark.createDataFrame([("a", 1, text(7)), ("a", 2, text(8))], "app_id string, job_id long, description string")
    sql = spark.createDataFrame([("a", 5, text(8))], "app_id string, execution_id long, description string")
    bridge = spark.createDataFrame([("a", 1, 3), ("a", 2, 4)], "app_id string, job_id long, stage_id long")
    batches = spark.createDataFrame([("a", "q", "r", 7), ("a", "q", "r", 8)], "app_id string, query_id string, run_id string, batch_id long")
    # The job's failure is found by its key and by its stage; a key that reads like a stage's number is none.
    rows = [("a", "job:1", 3), ("a", "sql:5", None), ("a", "task:9.0", 4), ("a", "4", None), ("a", "job:3", 9), ("b", "job:1", 3)]
    failures = spark.createDataFrame(rows, "app_id string, key string, stage_id long")
    found = bt.batch_failures(failures, jobs, bridge, sql, batches)
    assert sorted((r.batch_id, r.key) for r in found.collect()) == [(7, "job:1"), (8, "sql:5"), (8, "task:9.0")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "LogicalRDD" in line and "key#" in line]) == 1


def test_the_bundle_makes_its_failure_log_once(monkeypatch):
    from unittest import mock

    from cinderview.plans import report_queries as rq

    made = []
    monkeypatch.setattr(rq.fq, "fleet_failures", lambda v: made.append(v) or "log")
    monkeypatch.setattr(rq, "written", lambda spark, df, name: df)
    for name in ("summary_metrics", "scratch_path"):
        monkeypatch.setattr(rq, name, mock.Mock())
    for owner, name in ((rq.report, "fleet_summary"), (rq.bq, "merged_batches"), (rq.rq, "budgeted"), (rq.sinks, "write_bundle"), (rq.sinks, "bundle_contents")):
        monkeypatch.setattr(owner, name, mock.Mock())
    rq.bundle_sink(mock.MagicMock())
    assert len(made) == 1


def test_log_span_goes_by_time_and_takes_the_driver_only(spark):
    # By name stderr.10 comes before stderr.2, by time it comes last.
    rows = [("a", "driver", "stderr.2", 0, "31/03/04 07:00:00 INFO a"), ("a", "driver", "stderr.10", 0, "31/03/04 08:00:00 INFO b"),
            ("a", "4", "stderr", 0, "31/03/04 01:00:00 INFO executor"), ("a", "driver", "stderr.10", 1, "no time")]
    lines = spark.createDataFrame(rows, "app_id string, executor_id string, file string, line_no long, line string")
    got = logs.log_span(lines).first()
    assert (got.received, got.log_first_ms, got.log_last_ms) == (3, _at("07:00:00"), _at("08:00:00"))
    batches = spark.createDataFrame(
        [("a", "q", 1, False, _at("06:00:00"), _at("06:30:00")), ("a", "q", 2, False, _at("06:00:00"), _at("07:30:00"))],
        "app_id string, query_id string, batch_id long, has_progress boolean, from_ms long, to_ms long",
    )
    assert {r.batch_id: r.before_log for r in logs.log_coverage(batches, lines).collect()} == {1: True, 2: False}


def test_failure_lines_once_with_their_words(spark):
    failures = spark.createDataFrame(
        [("a", "task", "7", "DiskFullError: no space"), ("a", "task", "7", "DiskFullError: again"), ("a", "task", "7", "Timeout after 3 s"), ("a", "executor", "7", "gone")],
        "app_id string, kind string, executor_id string, detail string",
    )
    rows = [("a", "7", "f", 0, "a Timeout and a DiskFullError"), ("a", "7", "f", 1, "timeout"), ("a", "7", "f", 2, "fine"), ("a", "8", "f", 0, "timeout")]
    lines = spark.createDataFrame(rows, "app_id string, executor_id string, file string, line_no long, line string")
    got = sorted((r.line_no, r.needles, r.failures) for r in logs.failure_log_lines(failures, lines).collect())
    assert got == [(0, ["diskfullerror", "timeout"], 3), (1, ["timeout"], 1)]
    assert [tuple(r) for r in logs.failure_whole_logs(failures, lines).collect()] == [("a", "7", 1, 3)]


def test_many_error_words_are_found_as_a_plain_search_does(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcÉß$.") for _ in range(rng.randrange(2, 9)))
    words = [word() for _ in range(60)] + ["éé", "x" * 9, "\U0001f600"]
    failures = [("a", "task", e, f"{w}: why") for e in ("1", "2") for w in words for _ in range(rng.randrange(3))]
    failures += [("a", "task", "3", None), ("a", "executor", "1", "gone"), ("b", "task", "1", "abca")]
    glue = lambda: rng.choice([" ", ":", "(", "\t", "-", "", "::("])
    lines = [(rng.choice("ab"), rng.choice("123"), "f", i, "".join(word() + glue() + rng.choice(["", *words]).upper() + glue() for _ in range(rng.randrange(6)))) for i in range(900)]
    lines.append(("a", "1", "f", 900, None))
    df = spark.createDataFrame(lines, "app_id string, executor_id string, file string, line_no long, line string")
    fails = spark.createDataFrame(failures, "app_id string, kind string, executor_id string, detail string")
    views = [tuple(r) for r in logs.failure_log_views(fails).where("needle <> ''").collect()]
    lower = {r.line_no: r.l for r in df.select("line_no", F.lower("line").alias("l")).collect()}
    want = []
    for app, executor, _, n, _ in lines:
        hit = sorted((v[2], v[3]) for v in views if v[:2] == (app, executor) and lower[n] is not None and v[2] in lower[n])
        if hit:
            want.append((n, [h[0] for h in hit], sum(h[1] for h in hit)))
    got = sorted((r.line_no, r.needles, r.failures) for r in logs.failure_log_lines(fails, df).collect())
    assert got == [(n, sorted(w), f) for n, w, f in sorted(want)] and len(got) > 50


def test_page_text(spark):
    pages = [
        "<html><head><title>x</title></head><body>menu<pre id=a>03:00 WARN 5 &gt; 4 &quot;q&quot;\n03:01 <b>bold</b></pre>foot</body></html>",
        "no markup, 3 < 4",
        "<html>first<pre>old</pre><PRE>new &amp;amp; it&#39;s</PRE></html>",
        "<html><p>only&nbsp;a page</p></html>",
        "<pre>never closed <i>x</i>",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i long, body string")
    got = [r.text for r in logs.extract_log_text(df, "body").orderBy("i").collect()]
    assert got == ['03:00 WARN 5 > 4 "q"\n03:01 bold', "no markup, 3 < 4", "new &amp; it's", "only a page", "never closed x"]


def _block(batch, **more):
    """A progress object of an invented query, spread over lines as the log prints it."""
    value = {"id": "sensor-id", "runId": "sensor-run", "name": "sensors", "timestamp": "2031-03-04T07:21:10.250Z", "batchId": batch, **more}
    return ["31/03/04 07:21:11 INFO MicroBatchExecution: Streaming query made progress: {", *json.dumps(value, indent=1).split("\n")[1:]]


def _found(spark, texts, **limits):
    lines = _lines(spark, texts)
    blocks = pg.parse_progress(pg.progress_blocks(lines, **limits)) if limits else pg.progress_from_logs(lines)
    return {r.batch_id: r for r in blocks.collect()}


def test_progress_block_over_lines(spark):
    block = _block(
        88, numInputRows=64, durationMs={"addBatch": 31, "triggerExecution": 45}, eventTime={"watermark": "2031-03-04T07:21:00.000Z"},
        stateOperators=[{"numRowsTotal": 5, "memoryUsedBytes": 900}, {"numRowsTotal": 6, "memoryUsedBytes": 100, "numRowsDroppedByWatermark": 2}],
        sources=[{"description": "rate", "numInputRows": 64}],
    )
    got = _found(spark, ["before { it", *block, "behind } it"])
    assert list(got) == [88]
    r = got[88]
    assert (r.name, r.num_input_rows, r.trigger_ms, r.state_rows, r.state_bytes, r.rows_dropped) == ("sensors", 64, 45, 11, 1000, 2)
    assert (r.started_ms, r.started_ms - r.watermark_ms, r.sources[0].description) == (_at("07:21:10") + 250, 10_250, "rate")


def test_progress_blocks_cut_mixed_and_structured(spark):
    wrap = lambda msg: json.dumps({"level": "INFO", "msg": msg})
    one_line = "Streaming query made progress: " + json.dumps({"id": "w", "batchId": 70})
    texts = [
        *_block(50)[:3],  # cut off by the next marker
        *_block(51)[:2], wrap("a message { with a brace"), *_block(51)[2:],
        wrap("Streaming query made progress: " + json.dumps({"id": "json-layout", "batchId": 52}, indent=2)),
        one_line, "}} stray",
        "Streaming query made progress:", json.dumps({"batchId": 53}),
        'Streaming query made progress: {"batchId": twelve}',
        *_block(54)[:-1], json.dumps({"msg": 5}), "}",
    ]
    got = _found(spark, texts)
    # The line whose msg is a number is no message: it belongs to block 54 and spoils it.
    assert sorted(got) == [51, 52, 53, 70]
    assert (got[52].query_id, got[51].run_id, got[70].query_id) == ("json-layout", "sensor-run", "w")


def test_message_of_a_json_line_is_text_only(values):
    from cinderview.functions.text import json_message

    lines = ['{"msg":"hello"}', ' {"a":1,"msg":"two words"}', '{"msg":5}', '{"msg":{"a":1}}', '{"msg":null}', '{"msg":["x"]}', "plain msg", '{"msg": broken']
    assert values(*[json_message(F.lit(x)) for x in lines]) == ["hello", "two words", None, None, None, None, None, None]


def test_a_long_block_is_kept_unless_a_limit_is_given(spark):
    long = _block(60, note="y" * 300_000)
    assert sorted(_found(spark, [*long, *_block(61)])) == [60, 61]
    assert sorted(_found(spark, [*long, *_block(61)], block_bytes=1000)) == [61]


def test_long_log_is_folded_in_chunks(spark, monkeypatch):
    texts = [line for b in range(40) for line in [*_block(b), "between"]]
    monkeypatch.setattr(pg, "LINES_PER_CHUNK", 7)
    assert sorted(_found(spark, texts)) == list(range(40))


def _plain_blocks(texts, block_bytes=None):
    """Blocks line by line: ``(marker line, end line, text)``."""
    out, start, depth, held = [], None, 0, ""
    for i, line in enumerate(texts):
        text = line
        if "Streaming query made progress:" in line:
            start, depth, held, text = i, 0, "", line.split("Streaming query made progress:", 1)[1]
        if start is None:
            continue
        depth += text.count("{") - text.count("}")
        held += text + "\n"
        if depth <= 0 and "{" in held:
            out.append((start, i, held[held.find("{") : held.rfind("}") + 1]))
            start = None
        elif block_bytes is not None and len(held) > block_bytes:
            start = None
    return out


@pytest.mark.parametrize("chunk, limit", [(1, None), (5, None), (5, 60), (65536, None)])
def test_brackets_against_a_line_by_line_parser(spark, monkeypatch, chunk, limit):
    monkeypatch.setattr(pg, "LINES_PER_CHUNK", chunk)
    rng = random.Random(chunk)
    parts = ["{", "}", "{}", "}{", "plain", "", "{{ x", "} }", "Streaming query made progress:", "Streaming query made progress: {", "a Streaming query made progress: {} }"]
    texts = [rng.choice(parts) for _ in range(600)]
    got = pg.progress_blocks(_lines(spark, texts), block_bytes=limit).collect()
    want = [(a, b, text) for a, b, text in _plain_blocks(texts, limit)]
    assert len(want) > 50
    assert sorted((r.line_no, r.end_line, r.json) for r in got) == want


def test_an_open_block_is_never_collected(spark, monkeypatch):
    # The last marker never closes and owns the rest of the log; nothing of it is joined or collected.
    monkeypatch.setattr(pg, "LINES_PER_CHUNK", 1000)
    texts = [*_block(1), "Streaming query made progress: {", *["plain text of a crashed driver"] * 60_000]
    lines = _lines(spark, texts).repartition(4)
    blocks = pg.progress_blocks(lines)
    assert [(r.line_no, r.end_line) for r in blocks.collect()] == [(0, len(_block(1)) - 1)]


def test_summary_marks(spark):
    lines = ["3 failed · x FAILED", "GC: executor 1", "x GC: later", "none seen", "executor 3 lost (h)"]
    df = spark.createDataFrame([("a", 1, "S", i, "", t) for i, t in enumerate(lines)], "app_id string, section_no int, section string, ord int, sub string, line string")
    got = [(r.line, r.mark) for r in report.summary_highlights(df).collect()]
    assert got == [(lines[0], "bad"), (lines[1], "bad"), (lines[4], "bad"), (lines[2], "neutral"), (lines[3], "good")]
    md = report.summary_markdown(df.where("ord < 2")).orderBy("section_no", "part", "ord", "sub").collect()
    assert [r.text for r in md] == ["# Application summary", "", "## S", "", "- 3 failed · x FAILED", "- GC: executor 1", ""]
