import hashlib
import random

import numpy as np
import pytest

from cinderview.llm import suffix_dedup as s


def brute(rows, length=100):
    """Every string of every document, in order."""
    seen, out = set(), []
    done = {}
    for i, text in sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if i is None or i in done:
            spans = [] if i is None else done[i]
        else:
            spans = []
            for p in range(len(text) - length + 1):
                piece = text[p : p + length]
                if piece not in seen:
                    seen.add(piece)
                elif spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
            done[i] = spans
        at, kept = 0, b""
        for a, b in spans:
            kept += text[at:a]
            at = b
        kept += text[at:]
        out.append((i, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def shared_passages(seed, count=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgé", k=rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 80))) for _ in range(6)]
    out = []
    for i in range(count):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(4)]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            cut = rng.randrange(len(passage) // 2)
            parts.insert(rng.randrange(len(parts)), passage[cut : cut + rng.randint(80, 400)])
        out.append((i, " ".join(parts)))
    return out


@pytest.mark.parametrize("hot", [512, 2])
def test_against_all_strings(spark, docs, fixture_rows, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(s, "HOT_RUNS", hot)
    rows = fixture_rows + [(1000 + i, t) for i, t in odd_rows]
    assert result(s.repeat_digests(spark, docs(rows))) == brute(rows)


@pytest.mark.parametrize("seed, hot, block", [(1, 512, 1 << 20), (2, 3, 1 << 20), (3, 3, 200)])
def test_passages_at_any_place(spark, docs, monkeypatch, seed, hot, block):
    monkeypatch.setattr(s, "HOT_RUNS", hot)
    monkeypatch.setattr(s, "BLOCK_RUNS", block)
    rows = shared_passages(seed)
    random.Random(seed).shuffle(rows)
    assert result(s.repeat_digests(spark, docs(rows, partitions=5))) == brute(rows)


def test_periodic_and_overlapping_texts(spark, docs):
    rows = [(1, "a" * 250), (2, "ab" * 120), (3, "a" * 99), (4, "a" * 100), (5, "abc" * 80 + "x" + "abc" * 80), (6, "b" + "ab" * 60), (7, "é" * 90)]
    assert result(s.repeat_digests(spark, docs(rows))) == brute(rows)


def test_another_length(spark, docs):
    rows = [(1, "the quick brown fox jumps over"), (2, "a quick brown fox jumped"), (3, "quick brown fox jumps quick brown fox jumps")]
    assert result(s.repeat_digests(spark, docs(rows), length=16, gram=6)) == brute(rows, 16)
    with pytest.raises(ValueError):
        s.repeated_spans(spark, docs(rows), length=10, gram=10)


def test_repeated_rows_and_missing_ids(spark, docs):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(2, text), (2, text), (1, "x " + text[50:300]), (None, text), (None, text), (3, None), (4, "")]
    assert result(s.repeat_digests(spark, docs(rows))) == brute(rows)


def test_kept_bytes_and_spans(spark, docs):
    text = " ".join(f"word{i}" for i in range(40))
    got = {r.doc_id: r for r in s.remove_repeats(spark, docs([(1, text), (2, "head " + text + " tail")])).collect()}
    assert bytes(got[1].kept).decode() == text and got[1].spans == []
    assert bytes(got[2].kept) == b"head  tail" and got[2].spans == [5, 5 + len(text)]


def test_every_string_has_its_sample_at_the_same_offset():
    rng = np.random.default_rng(0)
    passage = rng.integers(97, 110, 300).astype(np.uint8)
    found = []
    for lead in (0, 1, 37, 512):
        data = np.concatenate([rng.integers(97, 110, lead).astype(np.uint8), passage, rng.integers(97, 110, 50).astype(np.uint8)])
        bucket, _, _, place = s.cover_runs(data, np.array([0]), np.array([len(data)]))
        start, more, offset = s.unpacked(place)
        samples = {}
        for b, a, m, o in zip(bucket, start, more, offset):
            samples.update({int(a + k) - lead: (int(b), int(a + o) - lead) for k in range(m + 1)})
        assert set(samples) == set(range(-lead, len(data) - 99 - lead))
        found.append([samples[k] for k in range(201)])
    assert all(f == found[0] for f in found)


def test_minima_of_windows():
    values = np.random.default_rng(2).integers(0, 1000, 103).astype(np.uint64)
    for width in (1, 2, 7, 50, 103):
        assert s.window_minima(values, width).tolist() == [values[i : i + width].min() for i in range(104 - width)]


def test_empty_table(spark, docs):
    assert s.repeat_digests(spark, docs([])).collect() == []
