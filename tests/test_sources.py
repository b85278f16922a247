"""Readers and writers on files."""

import json
import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cinderview.operators import batches as bt, failures as fl, report, stats
from cinderview.operators import settings
from cinderview.sources import eventlog, events as ev, exclusions, logfiles, plans, rest, sinks, storage

MIB = 1024 * 1024


@pytest.fixture(scope="session")
def event_logs(tmp_path_factory):
    folder = tmp_path_factory.mktemp("app")
    os.makedirs(folder / "events")
    script = os.path.join(os.path.dirname(os.path.abspath(__file__)), "app_with_log.py")
    subprocess.run([sys.executable, script, str(folder)], check=True, timeout=180, capture_output=True)
    return str(folder / "events")


def test_own_event_log(spark, event_logs, tmp_path):
    t = eventlog.read_event_logs(spark, event_logs, str(tmp_path / "landed"))
    app = t["applications"].collect()
    assert len(app) == 1 and app[0].name == "probe" and app[0].completed and app[0].version.startswith("4.")
    jobs = t["jobs"].collect()
    assert sorted({j.status for j in jobs}) == ["FAILED", "SUCCEEDED"]
    assert any(j.description == "count by key" for j in jobs)
    assert all(j.num_completed_tasks + j.num_skipped_tasks == j.num_tasks for j in jobs if j.status == "SUCCEEDED")
    tasks = t["tasks"]
    bad = tasks.where("status = 'FAILED'").collect()
    assert bad and all("planned failure" in r.error_message for r in bad)
    assert tasks.where("duration_ms < 0 OR scheduler_delay_ms < 0").count() == 0
    assert {"FAILED", "COMPLETE", "SKIPPED"} <= {r.status for r in t["stages"].collect()}
    sql = t["sql"].collect()
    assert {r.status for r in sql} == {"COMPLETED", "FAILED"} and all(r.duration_ms > 0 for r in sql)
    assert t["env_properties"].where("section = 'spark' AND key = 'spark.app.name'").first().value == "probe"
    assert t["resource_profiles"].where("resource = 'memory'").count() >= 1
    progress = t["progress"].collect()
    assert sum(r.num_input_rows for r in progress) == 100 and progress[0].name == "agg" and progress[0].trigger_ms > 0
    # The tables feed the operators as they are.
    once = lambda df: df.selectExpr("1 AS poll", "*")
    log = fl.failure_log(
        stages=once(t["stages"]), jobs=once(t["jobs"]), executors=once(t["executors"]), sql=once(t["sql"]), tasks=once(tasks),
        job_stages=t["job_stages"], sql_jobs=t["sql_jobs"],
    )
    assert {"stage", "job", "sql", "task"} == {r.kind for r in log.collect()}
    assert stats.quantiles(stats.succeeded(tasks), stats.STAGE, {"duration": "duration_ms"}).count() > 0
    live = bt.batch_jobs(t["jobs"]).collect()
    assert live and {r.name for r in live} == {"agg"}
    lines = report.event_log_summary(spark, t).collect()
    # Sections an event log knows nothing about do not occur.
    sections = {r.section for r in lines}
    assert {"Application", "Failures", "Slowest stages", "Executors", "Streaming"} <= sections and not sections & {"Storage", "Metrics"}
    assert any(r.line.startswith("probe [") for r in lines) and any(r.line.startswith("agg: ") for r in lines)


def test_plans_and_cached_blocks_of_an_own_log(spark, event_logs):
    events = eventlog.read_events(spark, event_logs)
    described = {r.execution_id for r in eventlog.sql(events).collect()}
    nodes = plans.plan_nodes(events).collect()
    assert {r.execution_id for r in nodes} == described
    assert not {r.node_name for r in nodes} & {*plans.WRAPPERS, plans.REUSED}
    by_plan = {}
    for r in nodes:
        by_plan.setdefault(r.execution_id, []).append(r)
    # The first execution counts 1000 rows by key: its last plan is the adaptive one, numbered from the root.
    first = sorted(by_plan[min(by_plan)], key=lambda r: r.node_id)
    assert [r.node_id for r in first] == list(range(len(first))) and first[0].node_name == "AdaptiveSparkPlan"
    assert "isFinalPlan=true" in first[0].description
    assert sum(r.node_name == "HashAggregate" for r in first) == 2 and any(r.codegen_id for r in first)
    metrics = [r for r in plans.node_metrics(events).collect() if r.execution_id == min(by_plan)]
    rows = {(r.node_name, r.total) for r in metrics if r.metric == "number of output rows"}
    assert ("Range", 1000) in rows and ("HashAggregate", 10) in rows
    assert {r.value for r in metrics if r.node_name == "Range" and r.metric == "number of output rows"} == {"1,000"}
    top = settings.node_top_metrics(plans.node_metrics(events))
    assert top.where("rank > 3").count() == 0 and top.where("metric = 'number of output rows' AND rank = 1").count() > 0

    rdds = storage.rdds(events).where("name = 'kept numbers'").collect()
    assert [(r.num_partitions, r.num_cached_partitions) for r in rdds] == [(3, 3)] and rdds[0].memory_used > 0
    # The other persisted dataset was freed.
    assert storage.rdds(events).count() == 1
    usage = {r.executor_id: r.memory_used for r in eventlog.executors(events).collect()}
    assert usage == {"driver": rdds[0].memory_used}


def test_events_of_rolling_logs_are_in_order(spark, tmp_path):
    folder = tmp_path / "eventlog_v2_app-7"
    folder.mkdir()
    update = lambda size: json.dumps({"Event": "SparkListenerBlockUpdated", "Block Updated Info": {
        "Block Manager ID": {"Executor ID": "1", "Host": "h", "Port": 1}, "Block ID": "rdd_0_0",
        "Storage Level": {"Use Disk": False, "Use Memory": size > 0}, "Memory Size": size, "Disk Size": 0}})
    # The tenth file is the last one, though its name sorts before the second's; it is also the smallest.
    (folder / "events_2_app-7").write_text("\n".join([update(20)] * 50))
    (folder / "events_10_app-7").write_text("\n".join([update(0), update(100)]))
    (folder / "events_1_app-7").write_text("\n".join([update(10)] * 9))
    blocks = storage.rdd_blocks(eventlog.read_events(spark, str(tmp_path))).collect()
    assert [(r.app_id, r.memory_used) for r in blocks] == [("app-7", 100)]


def _replay(updates):
    """Block state, event by event: ``(kind, ...)`` tuples in order."""
    state = {}
    for kind, *rest in updates:
        if kind == "block":
            block, executor, size = rest
            state.pop((block, executor), None)
            if size:
                state[block, executor] = size
        elif kind == "lost":
            state = {k: v for k, v in state.items() if k[1] != rest[0]}
        else:
            state = {k: v for k, v in state.items() if not k[0].startswith(f"rdd_{rest[0]}_")}
    return state


def test_blocks_against_a_replay(spark):
    rng = random.Random(4)
    updates, rows = [], []
    for at in range(400):
        kind = rng.choices(["block", "lost", "freed"], [40, 1, 1])[0]
        if kind == "block":
            block, executor, size = f"rdd_{rng.randrange(3)}_{rng.randrange(6)}", str(rng.randrange(4)), rng.choice([0, 10, 20, 30])
            updates.append((kind, block, executor, size))
            event = {"Event": "SparkListenerBlockUpdated", "Block Updated Info": {"Block Manager ID": {"Executor ID": executor, "Host": "h", "Port": 1},
                     "Block ID": block, "Storage Level": {"Use Memory": size > 0, "Use Disk": False}, "Memory Size": size, "Disk Size": 0}}
        elif kind == "lost":
            updates.append((kind, str(rng.randrange(4))))
            event = {"Event": "SparkListenerBlockManagerRemoved", "Block Manager ID": {"Executor ID": updates[-1][1]}, "Timestamp": at}
        else:
            updates.append((kind, rng.randrange(3)))
            event = {"Event": "SparkListenerUnpersistRDD", "RDD ID": updates[-1][1]}
        rows.append(("a", json.dumps(event), (at // 100, 0, at)))
    rng.shuffle(rows)
    lines = spark.createDataFrame(rows, "app_id string, value string, pos struct<file: long, block: long, row: long>")
    got = {(r.block, r.executor_id): r.memory_used for r in storage.rdd_blocks(ev.events_of(lines)).collect()}
    assert got == _replay(updates) and got


def test_exclusion_intervals(spark):
    rows = []
    tell = lambda name, at, **more: rows.append(("a", json.dumps({"Event": ev.SCHEDULER + name, "time": at, **more})))
    for e, host, at in (("1", "x", 1), ("2", "x", 5), ("3", "x", 30), ("4", "y", 1)):
        rows.append(("a", json.dumps({"Event": "SparkListenerExecutorAdded", "Timestamp": at, "Executor ID": e, "Executor Info": {"Host": host}})))
    rows.append(("a", json.dumps({"Event": "SparkListenerExecutorRemoved", "Timestamp": 25, "Executor ID": "2", "Removed Reason": "gone"})))
    tell("NodeExcluded", 20, hostId="x", executorFailures=2)
    tell("NodeUnexcluded", 40, hostId="x")
    tell("ExecutorExcluded", 10, executorId="4")
    tell("ExecutorExcluded", 12, executorId="4")
    tell("ExecutorUnexcluded", 15, executorId="4")
    tell("ExecutorExcluded", 15, executorId="4")
    tell("ExecutorUnexcluded", 15, executorId="1")
    tell("ExecutorExcluded", 50, executorId="4")
    tell("NodeExcludedForStage", 22, hostId="x", stageId=8, stageAttemptId=1)
    tell("ExecutorExcludedForStage", 23, executorId="4", stageId=9, stageAttemptId=0)
    rows.append(("a", json.dumps({"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 8, "Stage Attempt ID": 1, "Completion Time": 60}})))
    found = exclusions.exclusions(ev.events_of(spark.createDataFrame(rows, "app_id string, value string")))
    got = {(r.executor_id, r.stage_id, r.rule, r.from_ms, r.to_ms) for r in found.collect()}
    assert got == {
        ("1", None, "node", 20, 40), ("2", None, "node", 20, 25), ("4", None, "executor", 10, 15), ("4", None, "executor", 50, None),
        ("1", 8, "node", 22, 60), ("2", 8, "node", 22, 25), ("4", 9, "executor", 23, None),
    }
    flags = {(r.stage_id, r.executor_id) for r in exclusions.excluded_in_stages(found).collect()}
    assert flags == {(8, "1"), (8, "2"), (9, "4")}


def test_exclusion_lasts_until_the_release(spark):
    prefix = "org.apache.spark.scheduler.SparkListenerExecutor"
    added = [json.dumps({"Event": "SparkListenerExecutorAdded", "Timestamp": 1, "Executor ID": e, "Executor Info": {"Host": "h", "Total Cores": 2}}) for e in "1234"]
    turns = [("1", "Excluded", 5), ("1", "Unexcluded", 9), ("2", "Excluded", 5), ("3", "Unexcluded", 4), ("3", "Excluded", 5), ("4", "Excluded", 7), ("4", "Unexcluded", 7)]
    values = added + [json.dumps({"Event": prefix + name, "time": at, "executorId": e}) for e, name, at in turns]
    values += [json.dumps({"Event": "SparkListenerTaskStart", "Stage ID": 0, "Task Info": {"Task ID": i, "Executor ID": "2"}}) for i in range(3)]
    values += [json.dumps({"Event": "SparkListenerTaskEnd", "Stage ID": 0, "Task Info": {"Task ID": 0, "Executor ID": "2"}, "Task End Reason": {"Reason": "Success"}})]
    events = eventlog.events_of(spark.createDataFrame([("a", x) for x in values], "app_id string, value string"))
    got = {r.executor_id: (r.is_excluded, r.active_tasks) for r in eventlog.executors(events).collect()}
    assert got == {"1": (False, 0), "2": (True, 2), "3": (True, 0), "4": (False, 0)}


def test_tables_without_landing(spark, event_logs):
    assert eventlog.read_event_logs(spark, event_logs)["tasks"].count() > 0


def _dump(folder, name, value):
    path = os.path.join(str(folder), name)
    with open(path, "w") as f:
        json.dump(value, f, indent=1)
    return path


def test_rest_dumps_are_read_tolerantly(spark, tmp_path):
    jobs = [
        {"jobId": 3, "name": "export", "status": "RUNNING", "numTasks": 36, "numCompletedTasks": 11, "stageIds": [21, 22], "surprise": 1},
        {"jobId": 1, "status": "FAILED", "submissionTime": "2031-03-04T05:06:07.000GMT"},
    ]
    got = {r.job_id: r for r in rest.read_snapshot(spark, _dump(tmp_path, "jobs.json", jobs), "jobs").collect()}
    assert got[3].stage_ids == [21, 22] and got[3].num_failed_tasks == 0
    assert got[1].name == "" and got[1].stage_ids == [] and got[1].submitted_ms == 1_930_367_167_000
    stages = [{"stageId": 9, "status": "ACTIVE", "numCompleteTasks": 14, "executorSummary": {
        "2": {"taskTime": 8800, "succeededTasks": 5, "failedTasks": 1, "isBlacklistedForStage": True}, "3": {"taskTime": 420, "succeededTasks": 9}}}]
    st = rest.read_snapshot(spark, _dump(tmp_path, "stages.json", stages), "stages")
    assert st.first().attempt_id == 0 and st.first().num_complete_tasks == 14
    ex = {r.executor_id: r for r in rest.stage_executors(st).collect()}
    assert ex["2"].is_excluded and not ex["3"].is_excluded and ex["3"].failed_tasks == 0
    executors = [{"id": "1", "isActive": True, "totalGCTime": 7, "peakMemoryMetrics": {"JVMHeapMemory": 5, "MajorGCTime": 2}},
                 {"id": "2", "isExcluded": True, "removeTime": "2031-03-04T05:06:07.000GMT"}]
    got = {r.executor_id: r for r in rest.read_snapshot(spark, _dump(tmp_path, "executors.json", executors), "executors").collect()}
    assert (got["1"].peak_heap, got["1"].major_gc_ms, got["1"].total_gc_time) == (5, 2, 7)
    assert got["2"].is_excluded and not got["2"].is_active and got["2"].remove_ms == 1_930_367_167_000
    tasks = [{"taskId": 77, "status": "SUCCESS", "duration": 640, "taskMetrics": {"jvmGcTime": 12, "shuffleReadMetrics": {"remoteBytesRead": 3, "localBytesRead": 4}}},
             {"taskId": 78, "status": "FAILED", "errorMessage": "boom"}]
    got = {r.task_id: r for r in rest.read_snapshot(spark, _dump(tmp_path, "tasks.json", tasks), "tasks").collect()}
    assert (got[77].shuffle_read_bytes, got[77].gc_ms, got[78].duration_ms) == (7, 12, 0)
    apps = [{"id": "app-1", "name": "etl", "attempts": [{"sparkUser": "u", "duration": 5, "completed": False}, {"sparkUser": "old"}]}, {"id": "app-2"}]
    got = {r.app_id: r for r in rest.read_snapshot(spark, _dump(tmp_path, "apps.json", apps), "applications").collect()}
    assert got["app-1"].spark_user == "u" and got["app-2"].duration_ms == 0
    sql = [{"id": 11, "runningJobIds": [1], "failedJobIds": [2, 3], "nodes": [{"nodeId": 0, "nodeName": "Scan", "metrics": [{"name": "a", "value": "1"}, {"name": "b", "value": "2"}]}]}]
    sq = rest.read_snapshot(spark, _dump(tmp_path, "sql.json", sql), "sql")
    assert sorted((r.state, r.job_id) for r in rest.sql_jobs(sq).collect()) == [("failed", 2), ("failed", 3), ("running", 1)]
    assert [(r.pos, r.metric) for r in rest.sql_node_metrics(sq).orderBy("pos").collect()] == [(0, "a"), (1, "b")]


def test_dumps_know_their_app_attempt_and_time(spark, tmp_path):
    for app, jobs in (("app-1/2", [{"jobId": 4}]), ("app-1/1", [{"jobId": 4}]), ("app-2", [{"jobId": 9}])):
        folder = tmp_path / "applications" / app
        os.makedirs(folder)
        _dump(folder, "jobs.json", jobs)
    os.utime(tmp_path / "applications" / "app-2" / "jobs.json", (1_930_000_000, 1_930_000_000))
    rows = [r for app in ("app-1/2", "app-1/1", "app-2") for r in rest.read_snapshot(spark, str(tmp_path / "applications" / app), "jobs").collect()]
    assert [(r.app_id, r.app_attempt, r.job_id) for r in rows] == [("app-1", 2, 4), ("app-1", 1, 4), ("app-2", None, 9)]
    assert rows[2].poll_ts == 1_930_000_000_000
    given = rest.read_snapshot(spark, str(tmp_path / "applications" / "app-2"), "jobs", app_id="mine").first()
    assert given.app_id == "mine"


def test_one_object_with_all_lists(spark, tmp_path):
    folder = tmp_path / "shop-7"
    os.makedirs(folder)
    path = _dump(folder, "snapshot.json", {
        "jobs": [{"jobId": 1, "stageIds": [5]}, {"jobId": 2}], "stages": [{"stageId": 5, "attemptId": 1, "executorSummary": {"3": {"taskTime": 8}}}],
        "executors": [{"id": "3", "isActive": True}], "surprise": {"x": 1},
    })
    t = rest.read_combined(spark, path)
    assert sorted((r.app_id, r.job_id) for r in t["jobs"].collect()) == [("shop-7", 1), ("shop-7", 2)]
    assert [(r.app_id, r.stage_id, r.task_time) for r in rest.stage_executors(t["stages"], "app_id").collect()] == [("shop-7", 5, 8)]
    assert t["executors"].first().is_active and t["sql"].count() == 0 and t["rdds"].count() == 0


def test_thread_stacks_in_three_shapes(spark, tmp_path):
    dump = [
        {"threadId": 1, "threadName": "a", "stackTrace": {"elems": ["x.A", "x.B"]}},
        {"threadId": 2, "threadName": "b", "stackTrace": ["y.A"]},
        {"threadId": 3, "threadName": "c", "stackTrace": "z.A\n\n  z.B \n", "blockedByThreadId": 1},
        {"threadId": 4, "threadName": "d"},
    ]
    got = {r.thread_id: r for r in rest.read_threads(spark, _dump(tmp_path, "threads.json", dump)).collect()}
    assert [got[i].frames for i in (1, 2, 3, 4)] == [["x.A", "x.B"], ["y.A"], ["z.A", "z.B"], []]
    assert got[3].blocked_by_thread_id == 1


def test_environment(spark, tmp_path):
    env = {"sparkProperties": [["spark.executor.memory", "4g"]], "systemProperties": [["user", "x"]],
           "resourceProfiles": [{"id": 0, "executorResources": {"memory": {"resourceName": "memory", "amount": 4096}}}]}
    got = rest.read_environment(spark, _dump(tmp_path, "env.json", env))
    assert sorted((r.section, r.key, r.value) for r in got["env_properties"].collect()) == [("spark", "spark.executor.memory", "4g"), ("system", "user", "x")]
    assert tuple(got["resource_profiles"].drop(*rest.DUMP).first()) == (0, "memory", 4096)


def test_copied_dumps_keep_their_poll(spark, tmp_path):
    """The order of polls is in the path, whatever the files' times are; attempts and polls do not mix."""
    for attempt, poll, cores, written in ((1, 5000, "2", 30), (1, 9000, "4", 20), (2, 12000, "8", 10)):
        folder = tmp_path / "app_id=shop" / f"app_attempt={attempt}" / f"poll_ts={poll}"
        os.makedirs(folder)
        os.utime(_dump(folder, "env.json", {"sparkProperties": [["spark.executor.cores", cores]]}), (written, written))
        os.utime(_dump(folder, "tasks.json", [{"taskId": 7, "attempt": 3, "status": "SUCCESS"}]), (written, written))
    env = rest.read_environment(spark, str(tmp_path / "*" / "*" / "*" / "env.json"))["env_properties"].orderBy("poll_ts").collect()
    assert [(r.app_id, r.app_attempt, r.poll_ts, r.value) for r in env] == [("shop", 1, 5000, "2"), ("shop", 1, 9000, "4"), ("shop", 2, 12000, "8")]
    tasks = rest.read_snapshot(spark, str(tmp_path / "*" / "*" / "*" / "tasks.json"), "tasks").collect()
    assert sorted((r.app_attempt, r.poll_ts, r.attempt) for r in tasks) == [(1, 5000, 3), (1, 9000, 3), (2, 12000, 3)]


def test_line_numbers_over_many_splits(spark, tmp_path):
    folder = tmp_path / "app-7"
    os.makedirs(folder)
    want = {}
    for f, n in (("a.log", 3000), ("b.log", 1), ("c.log", 700)):
        want[f] = [f"{f} line {i} " + "x" * (i % 50) for i in range(n)]
        (folder / f).write_text("\n".join(want[f]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = logfiles.read_logs(spark, str(folder)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.app_id for r in rows} == {"app-7"}
    for f, lines in want.items():
        got = sorted((r.line_no, r.line) for r in rows if r.file.endswith(f))
        assert got == list(enumerate(lines))


def test_bundle(spark, tmp_path):
    path = str(tmp_path / "bundle")
    lines = spark.range(50).selectExpr("'a' AS app_id", "'f' AS file", "id AS line_no", "concat('line ', id) AS line")
    summary = spark.createDataFrame([("a", "x"), ("b", "y")], "app_id string, line string")
    sinks.write_bundle({"summary": summary}, path, lines, 10)
    got = {(r.part, r.app_id): r.rows for r in sinks.bundle_contents(spark, path, {"summary": "line", "logs": "line"}).collect()}
    assert got == {("summary", "a"): 1, ("summary", "b"): 1, ("logs", "a"): 10}
    place = "app_id string, section_no int, part int, ord int, sub string, text string"
    md = spark.createDataFrame([("a", 1, 2, i, "", f"- line {i}") for i in reversed(range(40))] + [("a", 0, 0, 0, "", "# title")], place)
    sinks.write_markdown(md, str(tmp_path / "md"))
    files = sorted((tmp_path / "md" / "app_id=a").glob("*.txt"))
    assert "".join(p.read_text() for p in files).splitlines() == ["# title", *[f"- line {i}" for i in range(40)]]


def test_events_of_keeps_lines_that_name_an_event_and_evaluates_them_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def line(i):
        calls.add(1)
        return None if i == 0 else "no event" if i == 1 else f' {{ "Event" : "Kind{i % 2}" , "n": {i}}}'

    values = spark.range(6).select(F.lit("a").alias("app_id"), F.udf(line)("id").alias("value"))
    got = ev.events_of(values).collect()
    assert sorted(r.event for r in got) == ["Kind0", "Kind0", "Kind1", "Kind1"] and all(r.pos is None for r in got)
    assert calls.value == 6


def test_landing_keeps_every_kind_and_the_session_as_it_was(spark, tmp_path):
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    lines = spark.range(200).selectExpr("'a' AS app_id", "concat('{\"Event\":\"Kind', id % 100, '\"}') AS value")
    landed = ev.land_events(ev.events_of(lines), str(tmp_path / "landed"))
    assert landed.groupBy("event").count().where("count = 2").count() == 100
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_blocks_that_are_given_are_not_replayed_again(spark, event_logs):
    events = eventlog.read_events(spark, event_logs)
    blocks = storage.rdd_blocks(events).localCheckpoint()
    for table in (storage.rdds, storage.executor_usage, storage.rdd_distribution):
        assert sorted(map(repr, table(events, blocks).collect())) == sorted(map(repr, table(events).collect()))


def test_starts_of_executions_are_parsed_once_and_without_stages(spark):
    start = '{"Event":"SparkListenerJobStart","Job ID":%d,"Stage Infos":[{"Stage ID":1}]%s}'
    end = '{"Event":"SparkListenerJobEnd","Job ID":%s,"Job Result":{"Result":"%s"}}'
    run = eventlog.SQL_UI + "SparkListenerSQLExecution"
    lines = [
        start % (1, ',"Properties":{"spark.sql.execution.id":"7","x":"y"}'), start % (2, ',"Properties":{"x":"y"}'), start % (3, ""),
        start % (4, ',"Properties":{"spark.sql.execution.id":"z"}'), start % (5, ',"Properties":{"spark.sql.execution.id":"7"}'),
        end % (1, "JobFailed"), end % ("null", "JobSucceeded"),
        f'{{"Event":"{run}Start","executionId":7,"physicalPlanDescription":"Scan","time":5}}', f'{{"Event":"{run}End","executionId":7,"time":9,"errorMessage":""}}',
        f'{{"Event":"{run}Start","executionId":8,"description":"d","time":6}}', f'{{"Event":"{run}End","time":9,"errorMessage":"x"}}',
    ]
    events = eventlog.events_of(spark.createDataFrame([("a", x) for x in lines], "app_id string, value string"))
    jobs, runs = eventlog.sql_jobs(events), eventlog.sql(events)
    assert sorted((r.job_id, r.execution_id, r.state) for r in jobs.collect()) == [(1, 7, "failed"), (5, 7, "running")]
    got = sorted((r.execution_id, r.status, r.description, r.submitted_ms, r.duration_ms, r.error_message) for r in runs.collect())
    assert got == [(7, "COMPLETED", "", 5, 4, None), (8, "RUNNING", "d", 6, 0, None)]
    for df in (jobs, runs):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Stage Infos") + plan.count("physicalPlanDescription") == 0
        assert plan.count("spark.sql.execution.id,StringType") + plan.count("StructField(description") == 1
