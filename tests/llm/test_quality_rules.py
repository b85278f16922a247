import re
from collections import Counter

import numpy as np
import pytest

from cinderview.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, repeated = len(words), len(covered)
    return (
        n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        sum(line in lines[:i] for i, line in enumerate(lines)), repeated, n < 50 or 100 * repeated > 50 * n,
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality AS label")


def values(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_counts_against_brute_force(spark, docs, fixture_rows, odd_rows):
    made = ["a b c a b c d", "x\n\nx\n x\nx ", "a b a b a b", "the same\r\nthe same\r\n", "w " * 49, "w%d " * 50, " ".join(f"w{i}" for i in range(50))]
    rows = fixture_rows + [(1000 + i, t) for i, t in odd_rows] + [(2000 + i, t) for i, t in enumerate(made)]
    empty = spark.createDataFrame([], "doc_id long, label int")
    got = {r.doc_id: r for r in q.judge(spark, docs(rows), empty).collect()}
    for i, text in rows:
        assert values(got[i]) == brute(text), text
        # No labels: only the base rules drop.
        assert got[i].kept == (not got[i].base_failed)


def test_poor_documents_go_and_clean_ones_stay(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").selectExpr("doc_id", "quality AS label")
    got = q.judge(spark, docs, labels).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert got[got.label == 1].kept.mean() > 0.99
    assert got[got.label == 0].kept.mean() < 0.1


def test_contradicting_labels_null_labels_and_repeated_rows(spark, docs, fixture_rows):
    labels = spark.createDataFrame([(0, 1), (0, 0), (0, 0), (1, None), (None, 1), (2, 1), (2, 1)], "doc_id long, label int")
    rows = fixture_rows + fixture_rows[:5] + [(None, "text without an id")]
    assert q.judge(spark, docs(rows), labels).count() == len(rows)


def test_score_is_the_mean_path_of_a_plain_walk():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(300, 3))
    forest = q.grow_forest(points, trees=10, tree_rows=64)
    probe = np.concatenate([points[:20], [[9.0, 9.0, 9.0], [0.0, 0.0, 0.0]]])

    def walk(tree, point):
        feature, cut, child, path = tree
        at = 0
        while child[at] != at:
            at = child[at] + (point[feature[at]] > cut[at])
        return path[at]

    want = [2 ** (-np.mean([walk(t, p) for t in forest]) / float(q.usual_path(64))) for p in probe]
    got = q.anomaly(probe, forest, 64)
    assert np.allclose(got, want)
    assert got[-2] > got[:20].mean() > 0


def test_threshold_loses_few_clean_rows(spark):
    rows = [(0.3 + 0.0002 * i, 1) for i in range(1000)] + [(0.45 + 0.0004 * i, 0) for i in range(500)]
    cut = q.threshold(spark.createDataFrame(rows, "score double, label int"), clean_loss=0.01)
    assert sum(s >= cut for s, label in rows if label == 1) <= 10
    assert sum(s >= cut for s, label in rows if label == 0) >= 350
    assert q.threshold(spark.createDataFrame(rows[:10], "score double, label int")) == 1.0


def test_empty_table(spark, docs, labels):
    assert q.judge(spark, docs([]), labels).collect() == []
