import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cinderview.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_places(rows, capacity):
    """Sequences are filled without gap or overlap, and none is over capacity."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_pieces_match_the_library(spark, docs, fixture_rows, odd_rows):
    rows = fixture_rows + [(1000 + i, t) for i, t in odd_rows]
    got = packing.pack(spark, docs(rows), PATH).collect()
    tokenizer, want = Tokenizer.from_file(PATH), []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, piece, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    n = check_places(got, 2048)
    least = -(-sum(r.length for r in got) // 2048)
    assert n <= least * 1.02 + 2


def packed(lengths, capacity):
    histogram = Counter(lengths)
    slots = packing.plan(list(histogram), list(histogram.values()), capacity)
    used, rows = Counter(), defaultdict(list)
    for length, first, times, sequence, offset in sorted(slots):
        assert used[length] == first
        used[length] += times
        for k in range(times):
            rows[sequence + k].append((offset, length))
    assert used == histogram
    for members in rows.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(rows)


def best_fit(lengths, capacity):
    """Best-fit decreasing, piece by piece."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def test_plan_fills_about_as_well_as_best_fit():
    random.seed(1)
    for capacity, spread in ((50, 50), (100, 30), (2048, 600), (64, 64)):
        lengths = [min(capacity, max(1, int(random.expovariate(1 / spread)))) for _ in range(1500)]
        assert packed(lengths, capacity) <= best_fit(lengths, capacity) * 1.03 + 2


def test_plan_of_few_lengths():
    assert packed([5] * 7, 10) == 4
    assert packed([10] * 3, 10) == 3
    assert packed([6, 4] * 50, 10) == 50
    assert packed([1], 10) == 1
    assert packing.plan([], [], 10) == []


def test_fit_is_non_negative_and_reaches_the_histogram():
    x = packing.nonnegative_fit([(0, 2), (1,), (0, 0)], np.array([30.0, 7.0, 10.0]))
    assert (x >= 0).all()
    assert np.allclose([x[0] + 2 * x[2], x[1], x[0]], [30, 7, 10], atol=0.5)


def test_one_length_for_most_rows(spark, docs):
    rows = [(i, "same words here") for i in range(500)] + [(1000, None), (1000, None), (None, "x")]
    got = packing.pack(spark, docs(rows), PATH, capacity=32).collect()
    assert len(got) == len(rows)
    check_places(got, 32)


def test_empty_table(spark, docs):
    assert packing.pack(spark, docs([]), PATH).collect() == []
