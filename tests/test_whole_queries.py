"""What single queries must hold, on rows built here."""

from types import SimpleNamespace

from cinderview.operators import stats
from cinderview.plans import report_queries, stage_queries


def test_task_quantiles_tell_all_ten_metrics(spark):
    columns = ", ".join(f"CAST({i} AS BIGINT) AS {c}" for i, c in enumerate(stage_queries.ALL_COLUMNS.values()))
    tasks = spark.sql(f"SELECT 'a' AS app_id, CAST(1 AS BIGINT) AS stage_id, CAST(0 AS BIGINT) AS attempt_id, 'SUCCESS' AS status, {columns}")
    rows = stage_queries.task_quantiles(SimpleNamespace(fx_tasks=tasks)).collect()
    assert {r.metric: r.max for r in rows} == {m: float(i) for i, (m, _) in enumerate(stats.TASK_METRICS)}


def test_summary_markdown_is_every_line_in_reading_order(spark, monkeypatch):
    measured = []
    lines = [("a", 4, "Executors", 1, "2", "y"), ("a", 4, "Executors", 1, "1", "x"), ("a", 1, "Application", 0, "", "app")]
    df = spark.createDataFrame(lines, "app_id string, section_no int, section string, ord int, sub string, line string")
    monkeypatch.setattr(report_queries, "summary", lambda v, failures=None, measures=(): measured.extend(measures) or df)
    rows = report_queries.summary_markdown(SimpleNamespace(spark=spark)).collect()
    text = [r.text for r in rows]
    assert text == ["# Application summary", "", "## Application", "", "- app", "", "## Executors", "", "- x", "- y", ""]
    assert {(r.lines, r.chars, r.sections) for r in rows} == {(3, sum(len(t) + 1 for t in text), "Application, Executors")}
    assert measured == [m for m, _ in stats.TASK_METRICS]
