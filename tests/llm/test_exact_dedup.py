import hashlib
from collections import defaultdict

import pytest

from cinderview.llm.exact_dedup import exact_duplicates


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = max if keep == "largest" else min
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep_id = best(named) if named else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        stays = True
        for i in sorted(ids, key=lambda i: i is None):
            out.append((i, keep_id, len(ids), stays and i == keep_id, digest))
            stays = stays and i != keep_id
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_against_brute_force(spark, docs, fixture_rows, odd_rows, keep):
    rows = fixture_rows + [(1000 + i, t) for i, t in odd_rows]
    assert result(exact_duplicates(spark, docs(rows), keep)) == brute(rows, keep)


def test_hot_text_is_spread_and_meets_again(spark, docs):
    rows = [(i, "the same text " * 50) for i in range(900)] + [(1000 + i, f"text {i % 40}") for i in range(60)]
    assert result(exact_duplicates(spark, docs(rows), "largest")) == brute(rows, "largest")


def test_repeated_rows_and_missing_ids(spark, docs):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "b"), (None, "c"), (None, "c"), (2, None), (3, "")] * 3
    assert result(exact_duplicates(spark, docs(rows), "smallest")) == brute(rows, "smallest")
    hot = [(None if i % 2 else 5, "z") for i in range(400)] + [(None, "n")] * 300
    assert result(exact_duplicates(spark, docs(hot), "largest")) == brute(hot, "largest")


def test_empty_table(spark, docs):
    assert exact_duplicates(spark, docs([])).collect() == []
