import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cinderview.llm import quality_classifier as q
from cinderview.llm.common import id_remainder

SF = "/root/testdata/sf0.1"


def plain_tokens(text):
    """Tokens one by one, as the docstring states them."""
    kinds = lambda b: 0 if b in (9, 11, 12, 13, 32) else 4 if b == 10 else 2 if 48 <= b < 58 else 1 if 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 3
    out = []
    last = 0
    for b in text.encode():
        kind = kinds(b)
        b = 48 if kind == 2 else b
        if kind and kind == last:
            out[-1] += bytes([b])
        elif kind:
            out.append(bytes([b]))
        last = kind
    return out


def test_features_against_a_plain_count(odd_rows, fixture_rows):
    for _, text in odd_rows + fixture_rows[:40]:
        text = text or ""
        data = np.frombuffer(text.encode(), np.uint8)
        rows, places, values = q.features(data, np.array([0]), np.array([len(data)]), bits=50)
        tokens = plain_tokens(text)
        n, pairs = len(tokens), max(len(tokens) - 1, 0)
        again = sum(a == b for a, b in zip(tokens, tokens[1:]))
        around = sum(a == b for a, b in zip(tokens, tokens[2:]))
        assert len(places) == n + pairs + again + around + 1
        assert np.allclose(values[:-1], 1 / math.sqrt(len(places)))
        # As many equal places as equal tokens, and as equal pairs.
        assert sorted(Counter(places[:n].tolist()).values()) == sorted(Counter(tokens).values())
        assert sorted(Counter(places[n : n + pairs].tolist()).values()) == sorted(Counter(zip(tokens, tokens[1:])).values())


def test_rows_of_a_batch_do_not_mix():
    texts = ["one two", "", "two three", "three", "one two"]
    column = pa.array(texts)
    vector = np.random.default_rng(0).normal(size=1 << q.BITS)
    together = q.batch_scores(pa.RecordBatch.from_arrays([column], names=["text"]), vector)
    alone = [q.batch_scores(pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]), vector)[0] for t in texts]
    assert np.allclose(together, alone)


def test_training_is_the_plain_coordinate_rule():
    rng = np.random.default_rng(1)
    found = [(np.unique(rng.integers(0, 16, 5)), None, float(i % 2)) for i in range(40)]
    found = [(p, rng.normal(size=len(p)), y) for p, _, y in found]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.01, 0.1
    z, n = [0.0] * 16, [0.0] * 16
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(2):
        for places, values, y in found:
            w = {int(i): weight(i) for i in places}
            p = 1 / (1 + math.exp(-sum(w[int(i)] * v for i, v in zip(places, values))))
            for i, v in zip(map(int, places), values):
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    assert np.allclose(q.train(found, 4, 2, alpha, beta, l1, l2), [weight(i) for i in range(16)])


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return q.learn(spark, docs, labels.where(id_remainder(5) != 0))


def test_held_out_accuracy(spark, learned):
    got = {r.doc_id: r.score for r in q.scores(spark, spark.read.parquet(f"{SF}/documents.parquet"), learned).collect()}
    held = [(got[i], y) for i, y in duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.98
    assert np.mean([s >= 0.3 for s, y in held if y]) > 0.995
    assert all(0 <= s <= 1 for s in got.values())


def test_odd_texts_and_acceptance(spark, docs, odd_rows, learned):
    rows = odd_rows + odd_rows[:3] + [(None, "no id")]
    df = docs(rows)
    got = q.scores(spark, df, learned).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    null, empty = ([r.score for r in got if r.doc_id == i][0] for i in (0, 1))
    assert null == empty
    kept = q.accepted(spark, df, learned, 0.3)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.score >= 0.3 for r in got)


def test_no_labels_and_empty_tables(spark, docs):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    vector = q.learn(spark, docs([(1, "a b"), (2, "c")]), none)
    assert not vector.any()
    assert {r.score for r in q.scores(spark, docs([(1, "a b"), (2, None)]), vector).collect()} == {0.5}
    assert q.scores(spark, docs([]), vector).collect() == []
