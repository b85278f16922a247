"""Event-log tables kept up piece by piece, against one read of the whole logs."""

import json

from pyspark.sql import functions as F

from cinderview.sources import eventlog as el
from cinderview.sources.events import events_of
from cinderview.streaming.event_tables import EVENTS, EventTables, start_event_tables
from test_sources import event_logs  # noqa: F401


def _rows(df):
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("map", "struct", "array")) else F.col(c) for c, t in df.dtypes])
    return sorted(map(repr, flat.select(*sorted(flat.columns)).collect()))


def _same(got, want, names=None):
    for name in names or want:
        assert _rows(got[name]) == _rows(want[name]), name


def test_pieces_in_any_order_equal_one_read(spark, event_logs, tmp_path):  # noqa: F811
    events = el.land_events(el.read_events(spark, event_logs), str(tmp_path / "landed"))
    store = EventTables(spark, str(tmp_path / "store"), buckets=2)
    piece = F.pmod(F.xxhash64("value"), F.lit(3))
    for number in range(3):
        store.add(events.where(piece == number), number)
    # A piece that is added again after a failure does not count twice.
    store.add(events.where(piece == 2), 2)
    want = el.tables_of(events)
    assert want["rdds"].count() == 1 and want["progress"].count() > 0
    _same(store.tables(), want)


def _task(kind, task, executor, **more):
    return {"Event": f"SparkListenerTask{kind}", "Stage ID": 1, "Stage Attempt ID": 0, "Task Info": {"Task ID": task, "Executor ID": executor, **more}}


def test_logs_that_grow(spark, tmp_path):
    folder = tmp_path / "logs" / "eventlog_v2_app-5"
    folder.mkdir(parents=True)
    path, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def follow():
        query = start_event_tables(spark, str(tmp_path / "logs"), path, checkpoint, buckets=2)
        query.awaitTermination()
        return EventTables(spark, path, 2).tables()

    def append(number, *events, text=""):
        with open(folder / f"events_{number}_app-5", "a") as f:
            f.write(text + "".join(json.dumps(e) + "\n" for e in events))

    submitted = {"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": 1, "Stage Attempt ID": 0, "Stage Name": "s", "Number of Tasks": 3}}
    added = {"Event": "SparkListenerExecutorAdded", "Timestamp": 5, "Executor ID": "1", "Executor Info": {"Host": "h", "Total Cores": 2}}
    end = lambda task, gc: {**_task("End", task, "1", **{"Launch Time": 1, "Finish Time": 11}), "Task End Reason": {"Reason": "Success"},
                            "Task Metrics": {"JVM GC Time": gc, "Executor Run Time": 9}}
    append(1, submitted, added, _task("Start", 1, "1"), _task("Start", 2, "1"), end(1, 4))
    append(1, text=json.dumps(end(2, 3))[:40])
    t = follow()
    assert [(r.status, r.num_complete_tasks, r.jvm_gc_time) for r in t["stages"].collect()] == [("ACTIVE", 1, 4)]
    assert [(r.active_tasks, r.completed_tasks) for r in t["executors"].collect()] == [(1, 1)]
    # The unfinished line is completed, and the log goes on in its next file.
    append(1, text=json.dumps(end(2, 3))[40:] + "\n")
    append(2, _task("Start", 3, "1"), end(3, 2), {**submitted, "Event": "SparkListenerStageCompleted"})
    t = follow()
    assert [(r.status, r.num_complete_tasks, r.jvm_gc_time) for r in t["stages"].collect()] == [("COMPLETE", 3, 9)]
    assert [(r.active_tasks, r.completed_tasks) for r in t["executors"].collect()] == [(0, 3)]
    _same(t, el.read_event_logs(spark, str(tmp_path / "logs")))


def test_without_events(spark, tmp_path):
    store = EventTables(spark, str(tmp_path / "store"), buckets=2)
    assert all(store.tables()[name].count() == 0 for name in ("tasks", "progress", "executors", "rdds"))
    store.add(spark.createDataFrame([], EVENTS), 0)
    assert store.tables()["stages"].count() == 0
    odd = events_of(spark.createDataFrame([("a", "no event"), ("a", '{"Event":"Unknown"}'), (None, None)], "app_id string, value string"))
    store.add(odd, 1)
    assert all(store.tables()[name].count() == 0 for name in ("applications", "tasks", "stages"))


def test_tables_of_a_store_read_their_own_kinds(spark, tmp_path):
    line = '{"Event":"SparkListenerApplicationStart","App Name":"x","App ID":"a","Timestamp":1,"User":"u"}'
    store = EventTables(spark, str(tmp_path / "store"), buckets=2)
    store.add(spark.createDataFrame([("a", "SparkListenerApplicationStart", line, (0, 0, 0))], EVENTS), 0)
    found = store.tables()["applications"]
    assert found.first().name == "x"
    assert all("/event=" in f for f in found.inputFiles())


def test_landed_logs_parse_their_tasks_once(spark, tmp_path):
    from cinderview.sources import eventlog

    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "app").write_text(
        '{"Event":"SparkListenerTaskEnd","Stage ID":1,"Stage Attempt ID":0,"Task End Reason":{"Reason":"Success"},'
        '"Task Info":{"Task ID":5,"Executor ID":"1","Launch Time":1,"Finish Time":8},"Task Metrics":{"Executor Run Time":6}}\n'
        '{"Event":"SparkListenerJobStart","Job ID":2,"Stage Infos":[{"Stage ID":1,"Stage Attempt ID":0,"Stage Name":"s","Number of Tasks":1}],"Stage IDs":[1]}\n'
    )
    tables = eventlog.read_event_logs(spark, str(tmp_path / "logs"), str(tmp_path / "landed"))
    assert [(r.job_id, r.num_completed_tasks) for r in tables["jobs"].collect()] == [(2, 1)]
    for name in ("tasks", "stages", "jobs", "executors"):
        assert "SparkListenerTaskEnd" not in tables[name]._jdf.queryExecution().optimizedPlan().toString()
