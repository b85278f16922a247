import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cinderview.llm import near_dedup as n
from cinderview.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute(rows, width, percent):
    """All pairs, then the smallest id of every component."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    by_shingle = defaultdict(set)
    for at, (_, s) in enumerate(sets):
        for x in s:
            by_shingle[x].add(at)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for at, (i, s) in enumerate(sets):
        for other in {o for x in s for o in by_shingle[x] if o > at}:
            t = sets[other][1]
            same = len(s & t)
            if i is not None and sets[other][0] is not None and 100 * same >= percent * (len(s) + len(t) - same):
                root[find(at)] = find(other)
    named = defaultdict(list)
    for at, (i, _) in enumerate(sets):
        if i is not None:
            named[find(at)].append(i)
    out = []
    for at, (i, s) in enumerate(sets):
        component = None if i is None else min(named[find(at)])
        out.append((i, len(s), component, i is None or i == component))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def variants(seed, count, words=120, edits=12):
    """A text, and copies with a growing number of changed words: some within the threshold, many just beyond."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for k in range(count):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"v{rng.randrange(30)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, docs, fixture_rows, odd_rows, width, percent):
    rows = fixture_rows + [(1000 + i, t) for i, t in odd_rows]
    assert result(n.near_duplicates(spark, docs(rows), width, percent)) == brute(rows, width, percent)


@pytest.mark.parametrize("seed", [1, 2])
def test_no_link_is_lost_to_the_star(spark, docs, monkeypatch, seed):
    # Many copies of one base, most of them unlike each other; copies of copies at the edge.
    monkeypatch.setattr(n, "SLOT_MEMBERS", 16)
    texts = variants(seed, 150)
    rng = random.Random(seed)
    for text in texts[:60]:
        words = text.split()
        words[rng.randrange(len(words))] = "x"
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert result(n.near_duplicates(spark, docs(rows), 3, 85)) == brute(rows, 3, 85)


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_links_of_unlinked_members_to_linked_ones(spark, docs, width, percent):
    # c is the centre; x is just beyond the threshold from it, and linked to y that is all but c.
    rng = random.Random(6)
    texts = []
    for base in range(24):
        n_own = 200 + 11 * base
        words = [f"b{base}w{i}" for i in range(2 * n_own)]
        cut = -(-percent * n_own // 100) - 1
        longer = 100 * n_own // percent + 1
        for size in (n_own, *((n_own - 1, n_own - 2, cut) if base % 2 else (n_own + 1, n_own + 2, longer))):
            texts.append(" ".join(words[: size + width - 1]))
        # One changed word each, so that c has most partners.
        for at in (5, n_own // 2):
            texts.append(" ".join([*words[:at], "x", *words[at + 1 : n_own + width - 1]]))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(n.near_duplicates(spark, docs(rows), width, percent)) == brute(rows, width, percent)


def test_missed_pairs_are_found_in_the_differences(spark):
    # c is the centre; x and y are linked to each other but not to c.
    verified = [(1, 9, False, 100, 40, [5, 6, 7]), (2, 9, False, 100, 40, [6, 8]), (3, 9, True, 100, 6, [50]), (4, 8, False, 100, 40, [6])]
    df = spark.createDataFrame(verified, n.VERIFIED).selectExpr("*", "b AS path", "IF(linked, b, a) AS label")
    met = n.meetings(df, 85)
    small = met.join(n.meeting_sizes(met), "meeting", "left_semi")
    assert [(r.a, r.b) for r in n.pairs_of_small(small, 85).collect()] == [(2, 1)]


def test_what_all_members_lack_brings_none_together(spark):
    # All thirty lack the same forty elements of the centre; only 1 and 2 also share what no other has.
    rows = []
    for a in range(1, 31):
        rare = list(range(2000, 2030)) if a < 3 else []
        rows.append((a, 99, False, 100, 75, [*range(1000, 1040), *rare, *range(100 * a + 10000, 100 * a + 10035 - len(rare))]))
    df = spark.createDataFrame(rows, n.VERIFIED).selectExpr("*", "b AS path", "a AS label")
    met = n.meetings(df, 85)
    small = met.join(n.meeting_sizes(met), "meeting", "left_semi")
    assert [(r.a, r.b) for r in n.pairs_of_small(small, 85).collect()] == [(2, 1)]


def versions(rng, count, words=160, shared=0.8, edits=4):
    """Two versions of a template, unlike each other, and lightly edited copies of both."""
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    other = list(base)
    for at in range(0, words, round(1 / (1 - shared))):
        other[at] = f"o{at}"
    out = []
    for i in range(count):
        own = list(base if i % 2 else other)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_pairs_grow_with_members(spark, docs, monkeypatch):
    verified, plain = [], n.verify

    def counted(spark, pairs, *rest):
        verified[-1] += pairs.count()
        return plain(spark, pairs, *rest)

    monkeypatch.setattr(n, "verify", counted)
    monkeypatch.setattr(n, "SMALL_GROUP", 16)
    for count in (200, 800):
        # A tenth of the words differ, so about 0.57 of the shingles are the same.
        rows = list(enumerate(versions(random.Random(3), count, shared=0.9)))
        verified.append(0)
        assert result(n.near_duplicates(spark, docs(rows), 3, 85)) == brute(rows, 3, 85)
        assert verified[-1] <= 4 * count


@pytest.mark.parametrize("seed, percent", [(1, 85), (2, 80)])
def test_large_groups_take_further_centres(spark, docs, monkeypatch, seed, percent):
    # Groups count as large from three members on; versions of versions, so that several rounds are needed.
    monkeypatch.setattr(n, "SMALL_GROUP", 2)
    rng = random.Random(seed)
    texts = versions(rng, 40, words=90, shared=0.9) + variants(seed, 60, words=90, edits=9)
    for text in list(texts[:30]):
        words = text.split()
        for at in range(40, 40 + rng.randrange(14)):
            words[at] = f"late{at}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(n.near_duplicates(spark, docs(rows), 3, percent)) == brute(rows, 3, percent)


def test_repeated_rows_missing_ids_and_short_texts(spark, docs):
    rows = [(5, "A b"), (3, "a B"), (3, "a B"), (None, "a b"), (None, None), (7, "a"), (8, "a b c"), (9, " "), (10, None)]
    assert result(n.near_duplicates(spark, docs(rows), 3, 85)) == brute(rows, 3, 85)


def test_rows_that_stay(spark, docs):
    rows = [(5, "one two three four five six"), (3, "one two three four five six"), (None, "one two three four five six"), (6, None), (7, "")]
    df = docs(rows)
    out = n.without_near_duplicates(spark, df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.where("doc_id IS NOT NULL").collect()) == [(3, rows[0][1]), (6, None), (7, "")]
    assert out.where("doc_id IS NULL").count() == 1


def test_empty_table(spark, docs):
    assert n.near_duplicates(spark, docs([])).collect() == []


def test_sketch_is_the_plain_rule_and_fills_every_bin():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (1, 2, 5, 40, 700)]
    size = 25
    got = n.sketches(sets, size)
    assert (got != n.EMPTY).all()
    for own, row in zip(sets, got):
        bins = [None] * size
        for turn in range(2 * size):
            for x in own:
                h = int(n.mixed(np.array([(int(x) + (turn + 1) * int(n.STEP)) % 2**64], np.uint64))[0])
                at = (h >> 32) * size >> 32 if turn < size else turn - size
                value = (turn << 40) | (h & ((1 << 40) - 1))
                bins[at] = value if bins[at] is None else min(bins[at], value)
            if None not in bins:
                break
        assert row.tolist() == bins


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        b = a.copy()
        b[int(len(a) * 2 * share / (1 + share)) :] += np.uint64(7)
        sketch = n.sketches([np.unique(a), np.unique(b)], 400)
        assert abs((sketch[0] == sketch[1]).mean() - share) < 0.08


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 7), (500, 3), (3, 500), (3, 501)] + [(900, 900 + i) for i in range(1, 80)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if find(x) != x}
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: c for x, c in got.items() if x != c} == want
    assert components(spark, spark.createDataFrame([], "a long, b long")).collect() == []
