"""Streams run to the end of their input and compared with the batch operators."""

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cinderview.operators import failures as fl
from cinderview.sources import growing
from cinderview.streaming import live, orders
from cinderview.streaming.keyed import KeyedTable

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def write_steps(spark, path, schema, steps):
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, tmp_path, mode="append"):
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ckpt).trigger(
        availableNow=True
    ).start().awaitTermination()
    return df.sparkSession.read.parquet(out)


def _event(i, second):
    return (i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second), i % 2, "x", 1.25, "{}")


def test_late_rows_are_dropped_and_open_windows_wait(spark, tmp_path):
    steps = [[_event(1, 0), _event(2, 10), _event(3, 200)], [_event(5, 210)], [_event(4, 5), _event(6, 400)]]
    write_steps(spark, str(tmp_path / "in"), EVENTS, steps)
    stream = orders.orders_stream(spark, str(tmp_path / "in"), files_per_trigger=1)
    q = orders.start_revenue(orders.windowed_revenue(stream), str(tmp_path / "out"), str(tmp_path / "ckpt"), None)
    q.awaitTermination()
    got = sorted((str(r.window_start)[11:16], r.customer_id, float(r.revenue), r.orders) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # Order 4 came a batch after its window was closed; order 6's window stays open.
    assert got == [("00:00", 0, 1.25, 1), ("00:00", 1, 1.25, 1), ("00:03", 1, 2.5, 2)]


def test_poison_stops_the_query(spark, tmp_path):
    write_steps(spark, str(tmp_path / "in"), EVENTS, [[_event(i, i) for i in range(10)]])
    stream = orders.poison_guard(orders.orders_stream(spark, str(tmp_path / "in")), 4)
    q = orders.start_raw(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), None)
    with pytest.raises(StreamingQueryException, match="poison order"):
        q.awaitTermination()


SIGHTING = "app_id string, poll long, key string, kind string, kind_order int, place long, sub int, title string, detail string, stage_id long, attempt_id long, executor_id string"


def _seen(poll, key, detail, title="t"):
    return ("a", poll, key, "stage", 0, 4, 0, title, detail, 4, 0, None)


STEPS = [
    [_seen(1, "stage:4.0", None), _seen(1, "stage:5.0", "why")],
    [_seen(2, "stage:4.0", "late", "other title"), _seen(2, "stage:5.0", "changed")],
    [_seen(3, "stage:4.0", "later"), _seen(3, "stage:6.0", None)],
]


def test_failure_events_once_and_again_for_a_late_detail(spark, tmp_path):
    stream = write_steps(spark, str(tmp_path / "in"), SIGHTING, [*STEPS, STEPS[0], STEPS[2]])
    live.start_failure_events(stream, str(tmp_path / "f"), str(tmp_path / "ckpt")).awaitTermination()
    got = sorted((r.key, r.event, r.title, r.detail) for r in spark.read.parquet(str(tmp_path / "f/events")).collect())
    assert got == [
        ("stage:4.0", "detail", "t", "late"), ("stage:4.0", "new", "t", None), ("stage:5.0", "new", "t", "why"), ("stage:6.0", "new", "t", None)
    ]
    # One narrow row per failure.
    assert KeyedTable(spark, str(tmp_path / "f/state"), ["app_id", "key"], live._told).read().count() == 3


def test_failure_events_forget_old_failures_when_told_to(spark, tmp_path):
    steps = [[_seen(1, "stage:1.0", "a")], [], [_seen(9, "stage:2.0", "b")], [_seen(10, "stage:1.0", "a")]]
    stream = write_steps(spark, str(tmp_path / "in"), SIGHTING, steps)
    live.start_failure_events(stream, str(tmp_path / "f"), str(tmp_path / "ckpt"), keep_polls=5).awaitTermination()
    got = sorted((r.key, r.first_poll) for r in spark.read.parquet(str(tmp_path / "f/events")).collect())
    assert got == [("stage:1.0", 1), ("stage:1.0", 10), ("stage:2.0", 9)]


def test_streamed_failure_log_equals_batch(spark, tmp_path):
    stream = write_steps(spark, str(tmp_path / "in"), SIGHTING, STEPS)
    live.start_failures(stream, str(tmp_path / "log"), str(tmp_path / "ckpt")).awaitTermination()
    cols = ["app_id", "key", "first_poll", "title", "detail"]
    got = live.failures_so_far(spark, str(tmp_path / "log")).select(*cols).orderBy("key").collect()
    want = fl.dedup_failures(spark.read.schema(SIGHTING).parquet(str(tmp_path / "in"))).select(*cols).orderBy("key").collect()
    assert got == want


PROGRESS = "app_id string, name string, query_id string, run_id string, batch_id long, arrival long, num_input_rows long, input_rps double, processed_rps double"


def _batch(run, batch, arrival, processed, query="q", rows=100):
    return ("a", "orders", query, run, batch, arrival, rows, 100.0, processed)


def test_behind_state_follows_restarts(spark, tmp_path):
    live.use_state_store(spark)
    steps = [
        [_batch("r1", b, b, 80.0) for b in range(6)],
        [_batch("r1", 6, 6, 80.0), _batch("r2", 0, 7, 120.0), _batch("r1", 7, 8, 80.0)],
        [_batch("r1", 8, 9, 80.0), _batch("r3", 0, 10, 50.0, "q2"), _batch("r3", 1, 11, 50.0, "q2")],
        [_batch("r3", 2, 12, 50.0, "q2"), _batch("r2", 1, 13, 120.0)],
    ]
    stream = write_steps(spark, str(tmp_path / "in"), PROGRESS, steps)
    got = {(r.query_id, r.run_id, r.last_batch): (r.with_input, r.slow, r.behind) for r in drain(live.stream_behind(stream), tmp_path).collect()}
    assert got == {("q", "r1", 5): (5, 5, True), ("q", "r2", 0): (1, 0, False), ("q2", "r3", 1): (2, 2, False), ("q2", "r3", 2): (3, 3, True)}


def test_behind_state_forgets_old_runs(spark):
    day = 24 * 3600 * 1000
    live_rows = lambda run, batch, at: pd.DataFrame([{"batch_id": batch, "arrival": at, "num_input_rows": 1, "input_rps": 1.0, "processed_rps": 2.0}])

    class Kept:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    state = live._BehindState()
    state.live = Kept()
    told = lambda run, batch, at: next(state.handleInputRows(("a", "q"), [live_rows(run, batch, at).assign(query_id="q", run_id=run)], None))
    # A run a day for a year, each reporting its predecessor once more.
    for i in range(365):
        assert told(f"r{i}", 0, i * day).run_id[0] == f"r{i}"
        if i:
            assert told(f"r{i - 1}", 1, i * day + 5).run_id[0] == f"r{i}"
    assert len(json.loads(state.live.value[0])["past"]) <= 9
    # A row of a forgotten run comes too late to count; the live run may be silent for long.
    assert told("r3", 2, 4 * day).run_id[0] == "r364"
    assert told("r364", 1, 365 * day).last_batch[0] == 1


POLLS = "app_id string, key string, poll_s long, value double"


def test_streamed_rates_are_corrected_by_late_polls(spark, tmp_path):
    steps = [
        [("a", "k", 0, 1.0), ("a", "k", 20, 41.0), ("a", "k", 40, 71.0)],
        [],
        [("a", "k", 10, 21.0), ("a", "k", 30, 61.0), ("a", "z", 20, 5.0)],  # polls that come late
        [("a", "k", 50, 81.0), ("a", "k", 50, 81.0), ("a", "z", 24, 1.0)],
        [("a", "k", -5, 0.0)],
    ]
    stream = write_steps(spark, str(tmp_path / "in"), POLLS, steps)
    live.start_rates(stream, str(tmp_path / "r"), str(tmp_path / "ckpt")).awaitTermination()
    got = sorted((r.key, r.ts, r.rate) for r in live.rates_so_far(spark, str(tmp_path / "r")).collect())
    assert got == [("k", -5, None), ("k", 0, 0.2), ("k", 10, 2.0), ("k", 20, 2.0), ("k", 30, 2.0), ("k", 40, 1.0), ("k", 50, 1.0),
                   ("z", 20, None), ("z", 24, -1.0)]


def test_bounded_state_of_rates_leaves_older_polls_out(spark, tmp_path):
    steps = [[("a", "k", t, float(t)) for t in range(0, 100, 10)], [("a", "k", 75, 90.0)], [("a", "k", 20, 7.0), ("a", "k", 100, 100.0)]]
    stream = write_steps(spark, str(tmp_path / "in"), POLLS, steps)
    live.start_rates(stream, str(tmp_path / "r"), str(tmp_path / "ckpt"), late_s=30).awaitTermination()
    got = {r.ts: r.rate for r in live.rates_so_far(spark, str(tmp_path / "r")).collect()}
    assert got == {**{t: 1.0 for t in range(10, 110, 10)}, 0: None, 75: 4.0, 80: -2.0}
    kept = KeyedTable(spark, str(tmp_path / "r/state"), ["app_id", "key"], live._polls(30)).read()
    assert sorted(r.ts for r in kept.collect()) == [70, 75, 80, 90, 100]


def _size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_keyed_table_stays_near_the_size_of_its_rows(spark, tmp_path):
    merge = lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"), F.max("text").alias("text"))
    rng = random.Random(2)
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], merge, buckets=4)
    want = {}
    for epoch in range(25):
        rows = [(rng.randrange(2000), epoch * 10 + i % 7, "%0200x" % rng.getrandbits(800)) for i in range(400)]
        for k, v, text in rows:
            old = want.get(k, (0, ""))
            want[k] = (max(v, old[0]), max(text, old[1]))
        df = spark.createDataFrame(rows, "k long, v long, text string").coalesce(1)
        table.add(df, epoch)
        if epoch % 8 == 3:
            # An epoch that is run again finds what it found before, and changes nothing.
            seen = sorted(table.read(before=epoch).collect())
            table.add(df, epoch)
            assert sorted(table.read(before=epoch).collect()) == seen
    assert {r.k: (r.v, r.text) for r in table.read().collect()} == want
    one = table.touched(spark.createDataFrame([(5,)], "k long"))
    assert {r.k for r in table.read(one).collect()} < set(want) and len(one) == 1
    table.read().coalesce(4).write.parquet(str(tmp_path / "live"))
    assert _size(tmp_path / "t") < 2 * _size(tmp_path / "live")


def test_log_counts_follow_growing_and_rotated_files(spark, tmp_path):
    folder = tmp_path / "in" / "app-9"
    folder.mkdir(parents=True)
    log = folder / "stderr"

    def step():
        raw = growing.stream_growing_logs(spark, str(tmp_path / "in"))
        live.start_log_counts(raw, str(tmp_path / "c"), str(tmp_path / "ckpt")).awaitTermination()
        rows = live.log_counts(spark, str(tmp_path / "c")).collect()
        return sorted((r.file.rpartition("/")[2], r.minute.minute, r.severity, r.lines, r.failures) for r in rows)

    log.write_bytes(b"31/03/04 05:06:07 ERROR a failed\n  at x\r\n  at")
    first = [("stderr", 6, "ERROR", 1, 1), ("stderr", 6, "PLAIN", 1, 0)]
    assert step() == first
    # The line that was cut is counted whole, at the time of the dated line of the epoch before.
    with log.open("ab") as f:
        f.write(" y failed\n31/03/04 05:07:00 INFO b\nö".encode())
    second = [first[0], ("stderr", 6, "PLAIN", 2, 1), ("stderr", 7, "PLAIN", 1, 0)]
    assert step() == second
    assert step() == second
    # Renamed with more to come, and a new file under the old name.
    with log.open("ab") as f:
        f.write(b" c\n")
    log.rename(folder / "stderr.1")
    log.write_bytes(b"31/03/04 05:09:00 WARN d\n" + b"  more\n" * 50)
    want = sorted([*second, ("stderr.1", 7, "PLAIN", 1, 0), ("stderr", 9, "PLAIN", 50, 0)])
    # Lines like " WARN " have a severity of their own.
    assert step() == sorted([*want, ("stderr", 9, "WARN", 1, 0)])


def test_pieces_of_a_growing_file_are_its_lines_once(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "PIECE", 7)
    monkeypatch.setattr(growing, "LOOK_BACK", 3)
    rng = random.Random(4)
    text = "".join(rng.choice(["a", "bb", "\n", "ü", "\r\n", "long " * 5]) for _ in range(300)).encode()
    path = tmp_path / "log"
    offsets, reader = [{}], growing.GrowingReader({"path": str(tmp_path)})
    got = []
    for size in (1, 40, 41, 200, len(text)):
        path.write_bytes(text[:size])
        reader = growing.GrowingReader({"path": str(tmp_path)})
        offsets.append(reader.latestOffset())
        for piece in reader.partitions(offsets[-2], offsets[-1]):
            for batch in reader.read(piece) or ():
                got += batch.to_pylist()
    want = text.split(b"\n")[:-1]
    assert [r["line"] for r in got] == [w.removesuffix(b"\r").decode() for w in want]
    assert len({r["at"] for r in got}) == len(got) and len({r["log"] for r in got}) == 1


def test_status_of_running_queries(spark, tmp_path):
    write_steps(spark, str(tmp_path / "in"), EVENTS, [[_event(i, i) for i in range(10)]])
    q = orders.start_raw(orders.orders_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ckpt"), None)
    q.awaitTermination()
    report = live.active_report(spark, "a", [q]).first()
    assert report.has_progress and report.stopped and report.num_input_rows == 10
    assert report.name == "orders-raw"


def test_rewritten_epochs_do_not_double(spark, tmp_path):
    facts = "app_id string, query_id string, run_id string, name string, batch_id long, fact string, execution_id long, status string, submitted_ms long, duration_ms long, arrival long, started_ms long, trigger_ms long, num_input_rows long, input_rps double, processed_rps double"
    row = lambda b, fact, i: ("a", "q", "r", "n", b, fact, i, "COMPLETED", 10, 5, i, 10, 7, 1, 1.0, 1.0)
    stream = write_steps(spark, str(tmp_path / "in"), facts, [[row(1, "sql", 1), row(1, "progress", 2)], [row(1, "sql", 1), row(2, "sql", 3)]])
    live.start_batches(stream, str(tmp_path / "facts"), str(tmp_path / "ckpt")).awaitTermination()
    p = ["app_id", "query_id", "run_id", "name", "batch_id", "arrival", "started_ms", "trigger_ms", "num_input_rows", "input_rps", "processed_rps"]
    s = ["app_id", "query_id", "run_id", "name", "batch_id", "execution_id", "status", "submitted_ms", "duration_ms"]
    got = sorted((r.batch_id, r.duration_ms, r.has_progress) for r in live.stream_batches(spark, str(tmp_path / "facts"), p, s).collect())
    assert got == [(1, 7, True), (2, 5, False)]
    # One row per fact is left, and a second run of the last epoch changes nothing.
    table = live.batch_table(spark, str(tmp_path / "facts"))
    assert table.count() == 3
    assert live.compacted(table.unionByName(table)).exceptAll(table.select(*live.compacted(table).columns)).count() == 0


def test_compacting_step_by_step_equals_compacting_at_once(spark):
    schema = "app_id string, query_id string, run_id string, batch_id long, fact string, arrival long, started_ms long, execution_id long, status string, submitted_ms long, duration_ms long"
    sql = [("a", "q", "r", 1, "sql", None, None, i, "S", at, 5) for i, at in ((1, 40), (2, 30), (3, 70), (4, None), (5, None), (6, 50))]
    progress = [("a", "q", "r", 1, "progress", i, 100 - i, None, None, None, None) for i in (3, 1, 2)]
    rows = [sql[3], progress[0], sql[0], sql[5], progress[1], sql[4], sql[2], sql[1], progress[2]]
    df = lambda part: spark.createDataFrame(part, schema)
    once = live.compacted(df(rows))
    step = live.compacted(df(rows[:3]))
    for k in range(3, len(rows), 2):
        step = live.compacted(step.unionByName(df(rows[k : k + 2] + rows[:1])))
    key = lambda r: str(tuple(r))
    assert sorted(step.collect(), key=key) == sorted(once.collect(), key=key)
    assert sorted((r.fact, r.arrival, r.execution_id) for r in once.collect() if r.fact == "progress") == [("progress", 1, None)]
    assert sorted(r.execution_id for r in once.collect() if r.fact == "sql") == [2, 6]


def test_a_table_fed_in_steps_is_computed_once(spark, tmp_path):
    from types import SimpleNamespace

    from cinderview.plans.stream_queries import fed

    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, 1 + i % 3) for i in range(30)], "id long, part long").mapInArrow(counted, "id long, part long")
    read = []
    ended = SimpleNamespace(awaitTermination=lambda: None)
    fed(SimpleNamespace(spark=spark), df, "steps", "part", [1, 2, 3], lambda stream: read.append(stream.isStreaming) or ended)
    assert rows.value == 30 and read == [True] * 3


def test_lines_of_an_epoch_are_read_once(spark, tmp_path):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    schema = "file string, log string, at long, file_ms long, line string"
    lines = [("/x/app-1/driver.log", "x#1", 10 * i, 0, f"24/01/01 00:0{i}:00 ERROR fail" if i % 2 == 0 else "  at x") for i in range(8)]
    spark.createDataFrame(lines, schema).write.parquet(f"{tmp_path}/in")
    raw = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").mapInArrow(counted, schema)
    live.start_log_counts(raw, f"{tmp_path}/out", f"{tmp_path}/checkpoint", F.lit("a")).awaitTermination()
    counts = live.log_counts(spark, f"{tmp_path}/out").collect()
    assert rows.value == 8 and sum(r.lines for r in counts) == 8 and len({r.minute for r in counts}) == 4
