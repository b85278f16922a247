import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderview.llm import mixture as m
from cinderview.llm.common import batches

SCHEMA = "doc_id long, text string, source string, size string, shard string, target string"


def table(spark, rows, partitions=3):
    """Documents of ``[(doc_id, text, source)]`` with columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA).repartition(partitions)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """The rule step by step: share, cut at the bound, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), share * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        over = {s for s in open_ if target[s] > most * sizes[s]}
        left = sum(target[s] - most * sizes[s] for s in over)
        for s in over:
            target[s] = most * sizes[s]
        open_ -= over
    return target


def check(rows, got, most=2, near=None):
    sizes, taken, longest = Counter(), Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += words(text)
        longest[source] = max(longest[source], words(text))
    want = plain_targets(sizes, most=most)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), words(t)) for i, t, _ in rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert len(r.shards) <= most and (r.size > 0 or not r.shards)
        taken[r.source] += r.size * len(r.shards)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= (longest[source] / 2 + 1e-6 if near is None else near), source


def corpus(seed=0, n=900, sources=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = None if rng.random() < 0.05 else f"s{rng.randrange(sources) if rng.random() < 0.6 else 0}"
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 40, 200])), source))
    return rows


def test_targets_and_taken_words(spark):
    rows = corpus() + [(5000, "a b c", "\U0001F600"), (5001, None, "zero"), (5002, " \n", "zero"), (7, "again", "s1"), (7, "again", "s1"), (None, "x y", "é")]
    got = m.mix(batches(spark), table(spark, rows), block_words=300, shard_blocks=8).collect()
    check(rows, got)
    # The remainder is met by small documents: far nearer than half of the longest (200).
    check([r for r in rows if r[2] == "s0"], m.mix(spark, table(spark, [r for r in rows if r[2] == "s0"]), block_words=300).collect(), near=20)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = corpus(1)
    first = m.mix(spark, table(spark, rows, 3), block_words=200, shard_blocks=4).collect()
    again = m.mix(spark, table(spark, rows[::-1], 7), block_words=200, shard_blocks=4).collect()
    key = lambda out: sorted((r.doc_id, r.shards) for r in out)
    assert key(first) == key(again)


def test_shards_hold_disjoint_blocks_and_their_share(spark):
    rows = corpus(2, n=1500)
    mixed = m.mix(spark, table(spark, rows), block_words=100, shard_blocks=10, keep=("text",))
    copies = m.shards_of(mixed).select("doc_id", "source", "text", "shard", "copy", F.spark_partition_id().alias("part")).collect()
    assert Counter(r.doc_id for r in copies) == Counter({r.doc_id: len(r.shards) for r in mixed.collect() if r.shards})
    text = {i: t for i, t, _ in rows}
    parts = defaultdict(set)
    for r in copies:
        assert r.text == text[r.doc_id]
        parts[r.shard].add(r.part)
    assert all(len(p) == 1 for p in parts.values()) and set(parts) == set(range(len(parts)))
    sizes = Counter()
    for r in copies:
        sizes[r.shard] += words(r.text)
    mean = np.mean(list(sizes.values()))
    assert max(sizes.values()) < 2 * mean
    # Nearly every shard of ten blocks has some of the largest source.
    assert len({r.shard for r in copies if r.source == "s0"}) > 0.9 * len(parts)


def test_tree_gives_exact_quotas(spark, monkeypatch):
    monkeypatch.setattr(m, "LEVELS", 2)
    quotas = {0: 120, 3: 7, 4: 1, 9: 55}
    for shards in (1, 2, 13):
        df = spark.createDataFrame(list(quotas.items()), "place long, quota long")
        leaves = m.shard_quotas(spark, df, shards, sum(quotas.values())).collect()
        by_source, by_shard = Counter(), Counter()
        for r in leaves:
            by_source[r.place] += r.quota
            by_shard[r.shard] += r.quota
        assert by_source == quotas
        assert set(by_shard) == set(range(shards)) and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_splits_are_hypergeometric():
    # Variance of a half's share of 40 blocks among 100: n K (N-K) (N-n) / N^2 (N-1) with n = 50.
    drawn = []
    for seed in range(3000):
        out = m.split(np.array([40, 60]), 0, 2, lambda a, b: 50 * (b - a), 1, np.random.default_rng(seed))
        assert [own.sum() for _, _, own in out] == [50, 50]
        drawn.append(out[0][2][0])
    assert abs(np.mean(drawn) - 20) < 0.2
    assert abs(np.var(drawn) - 50 * 0.4 * 0.6 * 50 / 99) < 0.5


def test_fitting():
    assert m.fitting(np.array([5, 9, 2, 0]), 8.0).tolist() == [True, False, True, False]
    assert m.fitting(np.array([100]), 66.0).tolist() == [True]
    assert m.fitting(np.array([100]), 40.0).tolist() == [False]
    assert m.fitting(np.array([], np.int64), 4.0).tolist() == []


def test_all_sources_at_their_bound(spark):
    rows = [(i, "a b c", f"s{i % 3}") for i in range(30)]
    got = m.mix(spark, table(spark, rows), share=2, most=2).collect()
    assert all(len(r.shards) == 2 and r.target == 60 for r in got)
    got = m.mix(spark, table(spark, rows), share=9, most=1).collect()
    assert all(len(r.shards) == 1 and r.target == 30 for r in got)


def test_one_source_and_empty_tables(spark, docs):
    rows = [(1, "a b", None), (2, None, None), (3, "", None)]
    assert sorted((r.doc_id, r.size, r.target, len(r.shards)) for r in m.mix(spark, table(spark, rows)).collect())[0] == (1, 2, 3.0, 1)
    assert m.mix(spark, table(spark, [])).collect() == []
    assert m.shards_of(m.mix(spark, table(spark, [(1, None, "s")]))).collect() == []


def test_odd_texts(spark, docs, odd_rows):
    got = {r.doc_id: r.size for r in m.mix(spark, docs(odd_rows)).collect()}
    assert got == {i: words(t) for i, t in odd_rows}
