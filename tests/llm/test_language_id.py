import math

import numpy as np
import pytest

from cinderview.llm import language_id as l
from cinderview.llm.common import id_remainder

SF = "/root/testdata/sf0.1/documents.parquet"


def grams(text):
    """Distinct n-grams of the folded text, one by one."""
    data = bytes(b if 97 <= b < 123 or b >= 128 else 32 for b in text.lower().encode())
    return {data[i : i + n] for n in l.GRAMS for i in range(len(data) - n + 1)}


def test_presence_and_kernel_against_plain_sets(fixture_rows, odd_rows):
    texts = [t or "" for _, t in fixture_rows[:30] + odd_rows]
    present = l.presence(texts, bits=20)
    for text, row in zip(texts, present):
        own = grams(text)
        assert len(own) * 0.97 - 1 <= row.sum() <= len(own)
    marks = present[:5] / np.sqrt(np.maximum(present[:5].sum(axis=1, keepdims=True), 1))
    got = l.kernel(present, marks)
    for i, a in enumerate(texts[:30]):
        for j, b in enumerate(texts[:5]):
            a_set, b_set = grams(a), grams(b)
            want = len(a_set & b_set) / math.sqrt(max(len(a_set), 1) * max(len(b_set), 1))
            assert abs(got[i, j] - want) < 0.03


def test_fit_separates_and_ignores_order():
    rng = np.random.default_rng(0)
    marks = np.eye(4, dtype=np.float32)
    place = np.arange(60) % 2
    kernel = rng.uniform(0, 0.2, size=(60, 4))
    kernel[place == 0, :2] += 0.7
    kernel[place == 1, 2:] += 0.7
    w = l.fit(marks, kernel, place, 2)
    assert ((kernel @ w).argmax(axis=1) == place).all()
    flip = np.arange(60)[::-1]
    assert np.allclose(l.fit(marks, kernel[flip], place[flip], 2), w)


@pytest.fixture(scope="module")
def model(spark):
    return l.learn(spark, spark.read.parquet(SF).where(id_remainder(4) != 2))


def test_held_out_accuracy(spark, model):
    held = spark.read.parquet(SF).where(id_remainder(4) == 2)
    got = l.identify(spark, held, model).join(held.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98
    assert got.score.between(0, 1).all()
    assert model[0] == sorted(set(got.lang))


def test_texts_without_letters(spark, docs, odd_rows, model):
    got = {r.doc_id: r for r in l.identify(spark, docs(odd_rows), model).collect()}
    for i, text in odd_rows:
        known = any(c.isalpha() for c in text or "")
        assert (got[i].lang_pred == "und") == (not known), text
        assert known or got[i].score == 0


def test_nothing_to_learn_from(spark, docs):
    empty = l.learn(spark, docs([(1, "text without a language"), (2, None)]))
    assert [(r.lang_pred, r.score) for r in l.identify(spark, docs([(1, "some text")]), empty).collect()] == [("und", 0.0)]
    assert l.identify(spark, docs([]), empty).collect() == []


def test_null_languages_ids_and_repeated_rows(spark, docs):
    rows = [(i, "the and of the house " * 5, "en") for i in range(5)] + [(5 + i, "der und das haus die " * 5, "de") for i in range(5)]
    rows += [(None, "text", "en"), (1, "the and of", "en"), (20, None, "fr"), (21, "123", "xx"), (22, "no language", None)]
    model = l.learn(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model[0] == ["de", "en"]
    got = {r.doc_id: r.lang_pred for r in l.identify(spark, docs([(1, "the house and"), (2, "das haus und")]), model).collect()}
    assert got == {1: "en", 2: "de"}
