import itertools
import random
import re
import time

import numpy as np
import pytest

from cinderview.llm import pii


def brute(text):
    """The four rules as they are stated."""
    text, out = text or "", []
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    for place, (kind, pattern) in enumerate(zip(pii.KINDS, patterns)):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), place, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_patterns_against_the_rules(fixture_rows, odd_rows):
    for _, text in fixture_rows + odd_rows:
        assert pii.certain_spans(text or "") == brute(text), text


def test_random_texts_against_the_rules():
    random.seed(2)
    parts = ["a", "b.c", "@", "x@y.de", ".", "1", "12", "255", "256", "007", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "+1 (555) 123-4567", "10.0.0.1", "\n", "é", "%", "%_"]
    for _ in range(6000):
        text = "".join(random.choices(parts, k=random.randint(1, 12)))
        assert pii.certain_spans(text) == brute(text), text


def some_island():
    return pii.Island("pay 4111.1111 now", 4, 13)


def random_weights(seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(pii.N_FEATURES, len(pii.TYPES))), rng.normal(size=(len(pii.TYPES), len(pii.TYPES)))


def every_segmentation(scores, moves):
    """Score of every way to cut an island into typed segments ``(end, length, type)``."""
    n, longest, _ = scores.shape

    def go(at, last):
        if at == n:
            yield 0.0, []
        for length in range(1, min(longest, n - at) + 1):
            for t in range(len(pii.TYPES)):
                own = scores[at + length - 1, length - 1, t]
                if np.isfinite(own):
                    for rest, path in go(at + length, t):
                        yield own + moves[last, t] + rest, [(at + length, length, t), *path]

    return list(go(0, 0))


@pytest.mark.parametrize("step", [pii.STEP, 2])
def test_dynamic_program_against_all_segmentations(monkeypatch, step):
    monkeypatch.setattr(pii, "STEP", step)
    for island in (some_island(), pii.Island("(at) 7@x.y-z", 0, 12, longest=3)):
        for seed in range(5):
            weights, moves = random_weights(seed)
            scores = island.scores(weights)
            found = every_segmentation(scores, moves)
            top = max(found, key=lambda x: x[0])
            want = [(pii.TYPES[t], island.starts[j - size], island.ends[j - 1]) for j, size, t in top[1] if t]
            assert pii.best_segments(island, weights, moves) == want
            total = pii.log_sum(pii.forward(scores, moves)[0][-1])
            assert np.isclose(total, np.log(sum(np.exp(x) for x, _ in found)))


def plain_features(text, start, end, a, b):
    """Features of the segment ``text[a:b]`` of an island, from its characters."""
    body, near = text[a:b], text[max(0, start - 24) : start].lower()
    atoms = pii.ATOM.findall(text, a, b)
    before, after = text[a - 1 : a] if a else "", text[b : b + 1]
    digits = re.findall("[0-9]+", body)
    figures, letters = "".join(digits), sum(c.isalpha() for c in body)
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(c) for c in reversed(figures)))
    label = re.search(r"(?<![^\W\d_])[^\W\d_]{2,6}$", body)
    octets = len(digits) == 4 and not letters and all(len(d) <= 3 and int(d) <= 255 for d in digits)
    card = 12 <= len(figures) <= 19 and not letters
    rules = {
        0: True, 1: len(atoms) > 1, 2: not ((body[0].isalnum() or body[0] in "+(") and body[-1].isalnum()),
        3: not before or before.isspace(), 4: before.isalnum(), 6: not after or after.isspace(), 7: after.isalnum(),
        20: body.count("@") == 1 and letters > 0, 21: "@" in body and not (body.count("@") == 1 and letters > 0),
        22: any(x in body.lower() for x in ("(at)", "[at]")), 23: "." in body and label is not None,
        24: octets and body.count(".") == 3, 25: octets and body.count(".") != 3, 26: card and total % 10 == 0, 27: card and total % 10 > 0,
        28: card and len(digits) > 1 and len({len(d) for d in digits}) == 1, 29: body[0] == "+", 30: "(" in body and ")" in body,
        31: [len(d) for d in digits[-2:]] == [3, 4], 32: len(digits) > 2, 33: letters > 0,
        34: len({x for x in atoms if not x[0].isalnum()}) > 3, 35: 7 <= len(figures) <= 15 and not letters,
    }
    rules |= {5: not rules[3] and not rules[4], 8: not rules[6] and not rules[7], 9 + min(len(figures), 20) // 2: True}
    rules |= {36 + k: any(w in near for w in pii.NEAR[kind]) for k, kind in enumerate(pii.KINDS)}
    return {k for k, holds in rules.items() if holds}


def test_features_against_the_rules():
    rng = random.Random(8)
    parts = ["1", "12", "256", "1234", ".", "-", "@", "(", ")", "[at]", "(at)", "ab", "b.c", "com", "é", "+", "/", " ", "_", "4111111111111111", "٣", "😀"]
    for _ in range(300):
        text = "call mail " + "".join(rng.choices(parts, k=rng.randint(1, 22))) + rng.choice(["", " x", "y"])
        start, end = 10, len(text) - rng.choice([0, 1])
        if end <= start:
            continue
        island = pii.Island(text, start, end)
        found, there = island.features(0, island.n)
        for j in range(1, island.n + 1):
            for size in range(1, min(j, island.longest) + 1):
                a, b = int(island.starts[j - size]), int(island.ends[j - 1])
                assert there[j - 1, size - 1] == (size == 1 or not (text[a].isspace() or text[b - 1].isspace()))
                assert set(np.flatnonzero(found[j - 1, size - 1]).tolist()) == plain_features(text, start, end, a, b), text[a:b]
        assert not any(there[j, j + 1 :].any() for j in range(min(island.n, island.longest)))


def test_gradient_against_differences():
    island = some_island()
    weights, moves = random_weights(3)
    gold = pii.gold_segments(island, [("card", 4, 13)])
    assert gold == [(3, 3, pii.TYPES.index("card"))]

    def value(w, m):
        last, own, scores = 0, 0.0, island.scores(w)
        for j, size, t in gold:
            own += scores[j - 1, size - 1, t] + m[last, t]
            last = t
        return own - pii.log_sum(pii.forward(scores, m)[0][-1])

    grad, grad_moves = pii.gradient(island, gold, weights, moves)
    for array, found in ((weights, grad), (moves, grad_moves)):
        for at in itertools.islice(np.ndindex(array.shape), 0, None, 7):
            array[at] += 1e-5
            up = value(weights, moves)
            array[at] -= 2e-5
            down = value(weights, moves)
            array[at] += 1e-5
            assert abs((up - down) / 2e-5 - found[at]) < 1e-4


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(spark, spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_the_model_finds_what_the_patterns_find(model):
    import duckdb

    texts = [t for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    hit = total = extra = 0
    for text in texts:
        base, spans = pii.all_spans(text, model)
        assert set(base) <= set(spans)
        extra += len(spans) - len(base)
        own = set(pii.model_spans(text, model, {}))
        hit += sum(s in own for s in base)
        total += len(base)
    assert hit / total > 0.9 and extra < 0.1 * total


def test_the_model_adds_weaker_spellings_and_leaves_ordinary_figures(model):
    found = lambda text: [(k, text[a:b]) for k, a, b in pii.all_spans(text, model)[1]]
    assert found("call (017) 555-7713 now") == [("phone", "(017) 555-7713")]
    assert found("mail bob (at) example.com ok") == [("email", "bob (at) example.com")]
    assert found("in 1999 there were 25 items") == []
    assert found("no figures at all here") == []


def test_rows(spark, docs, odd_rows, model):
    rows = odd_rows + [(100, "a@b.co 10.0.0.1"), (100, "a@b.co 10.0.0.1"), (None, "x@y.de")]
    got = pii.find_personal_data(spark, docs(rows), model).collect()
    assert len(got) == len(rows)
    assert [(r.n_email, r.n_ip, r.base_spans) for r in got if r.doc_id == 100] == [(1, 1, "email:0:6,ip:7:15")] * 2
    for r in got:
        text = dict(rows)[r.doc_id]
        assert r.base_spans == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(text))
    assert [r.spans for r in got if r.doc_id == 0] == [""]


def test_nothing_to_learn_from_and_empty_table(spark, docs):
    model = pii.learn(spark, docs([(1, "no figures"), (2, None)]))
    assert pii.all_spans("a@b.co", model)[0] == [("email", 0, 6)]
    assert pii.find_personal_data(spark, docs([]), model).collect() == []


def test_long_texts_take_linear_time(model):
    start = time.time()
    for text in ("a" * 200_000, "7" * 200_000, "1." * 50_000, "a@" * 50_000, "+1 " * 30_000, "x" * 100_000 + "@" + "y." * 50_000):
        pii.all_spans(text, model)
    assert time.time() - start < 60


def test_memory_and_time_of_one_long_island(model):
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    rng = random.Random(1)
    for text in ("1." * 500_000, "".join(rng.choices("0123456789.", k=1_000_000))):
        start = time.process_time()
        pii.all_spans(text, model)
        assert time.process_time() - start < 30
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_long_names_are_one_entity(model):
    text = "write to first.last-name (at) mail.dept.example.co.uk today"
    start, end = text.index("first"), text.index(" today")
    island = pii.Island(text, start, end)
    assert pii.gold_segments(island, [("email", start, end)]) == [(island.n, island.n, pii.TYPES.index("email"))]
    assert [text[a:b] for _, a, b in pii.all_spans(text, model)[1]] == ["first.last-name (at) mail.dept.example.co.uk"]


def test_all_islands_may_train():
    text = "x@y.zz " + "12 " * 400 + "7" * 700 + " +4 last"
    (start, end), *_ = pii.islands(text)
    parts = list(pii.parts_of(text, start, end))
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and (parts[0][0], parts[-1][1]) == (start, end)
    assert all(b - a <= pii.PART_CHARS for a, b in parts)
