import random
import re
import zlib
from collections import Counter

import pytest

from cinderview.llm import spelling as s
from cinderview.llm.common import batches

ASCII = {c: c + 32 for c in range(65, 91)}


def counts(rows, least_length=6, least_count=5, slip=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(ASCII)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n, ratio=5):
    """All pairs of words."""
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= ratio * n[w] else None for w, v in form.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_against_all_pairs(spark, docs):
    rng = random.Random(3)
    texts, words = [], ["".join(rng.choices("abcé", k=rng.randint(4, 8))) for _ in range(60)]
    for i in range(400):
        out = []
        for _ in range(rng.randrange(60)):
            w = list(words[min(int(rng.expovariate(0.1)), 59)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice(["", "a", "ba", "À", w[at] * 2])
            out.append("".join(w).upper() if rng.random() < 0.2 else "".join(w))
        texts.append((i, rng.choice(" ,\n1-").join(out)))
    texts += [(7, "repeat " * 9), (7, "repeat " * 9), (None, "Repeat repeats " * 4), (8, None), (9, "")]
    want = brute(counts(texts))
    assert sum(row[1] is not None for row in want) > 10
    assert result(s.spelling_variants(spark, docs(texts))) == want


def test_runs_of_equal_letters_and_chains(spark, docs):
    # Deleting any letter of a run gives one word; forms follow each other to the last.
    n = {"aaaaaa": 700, "aaaaaaa": 130, "aaaaaaaa": 20, "aaaaaab": 4, "aabaaa": 3, "zzzzzz": 9, "zzzzzy": 9, "zzzzyz": 2, "zzzzzÿ": 45}
    rows = [(i, " ".join([w] * k)) for i, (w, k) in enumerate(n.items())]
    got = result(s.spelling_variants(spark, docs(rows), least_count=2, slip=None))
    assert got == brute(n)
    assert dict((r[0], r[2]) for r in got)["aaaaaaaa"] == "aaaaaa"


def test_a_letter_is_lost_where_the_hash_says_so(spark, docs):
    rows = [(i, "Übermut Wandern wandern") for i in range(2000)]
    got = {(r.word, r.n) for r in s.word_counts(docs(rows), least_length=1, least_count=1).collect()}
    want = counts(rows, 1, 1)
    assert got == set(want.items()) and len(want) > 4


@pytest.mark.parametrize("least", [(6, 5), (1, 1)])
def test_odd_texts_are_cut_whole(spark, docs, odd_rows, fixture_rows, least):
    rows = odd_rows + fixture_rows
    got = {(r.word, r.n) for r in s.word_counts(docs(rows), *least).collect()}
    assert got == set(counts(rows, *least).items())


def test_a_key_has_few_rows(spark, docs):
    # As many words as one place can have letters: the scan is over at most one row for each letter, and the shorter word.
    letters = [c for c in map(chr, [*range(97, 123), *range(0xC0, 0x100)])]
    rows = [(1, " ".join(["kernel", *(f"ker{c}nel" for c in letters)]))]
    words = s.word_counts(docs(rows), least_count=1, slip=None)
    widest = s.rotations(words).groupBy("key").count().agg({"count": "max"}).first()[0]
    assert widest == s.LETTERS + 1
    got = {r[0]: r[4] for r in result(s.spelling_variants(spark, docs(rows), least_count=1, slip=None))}
    assert got["kernel"] == 90 and got["kerønel"] == 90


def test_empty_table(spark, docs):
    assert s.spelling_variants(batches(spark), docs([])).collect() == []
