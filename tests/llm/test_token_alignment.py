import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cinderview.llm import token_alignment as t
from cinderview.llm.common import batches

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of_letter():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def both(text, libraries):
    """``[(id, bytes)]`` of both tokenizers, straight from the libraries."""
    a, b = libraries
    letters = byte_of_letter()
    a_tokens = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    b_tokens = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        b_tokens.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    same = b"".join(x for _, x in a_tokens) == whole == b"".join(x for _, x in b_tokens)
    return (a_tokens, b_tokens) if text and same else ([], [])


def plain(text, libraries):
    """``(n_a, n_b, groups, links)`` by the byte ranges of whole texts."""
    a_tokens, b_tokens = both(text or "", libraries)
    spans, ends = [], []
    for tokens in (a_tokens, b_tokens):
        at, own = 0, []
        for i, x in tokens:
            own.append((i, at, at + len(x)))
            at += len(x)
        spans.append(own)
        ends.append({e for _, _, e in own})
    links = [(i, j) for i, s, e in spans[0] for j, s2, e2 in spans[1] if s < e2 and s2 < e]
    groups, last = [], 0
    for end in sorted(ends[0] & ends[1]):
        part = [",".join(str(i) for i, s, e in own if last <= s and e <= end) for own in spans]
        groups.append("|".join(part))
        last = end
    return len(a_tokens), len(b_tokens), groups, links


def brute(rows, libraries):
    found = [(i, *plain(text, libraries)) for i, text in rows]
    n, top = Counter(), defaultdict(int)
    for *_, links in found:
        n.update(set(links))
    for (a, _), k in n.items():
        top[a] = max(top[a], k)
    out = []
    for i, n_a, n_b, groups, links in found:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        best = sum(n[x] == top[x[0]] for x in links)
        out.append((i, n_a, n_b, len(groups), len(links), best, sum(n[x] for x in links), digest))
    return sorted(out, key=str)


def result(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def small(rows):
    return [(i, t if t is None else t[:3000]) for i, t in rows]


@pytest.mark.parametrize("heavy", [t.HEAVY, 50])
def test_against_byte_ranges(spark, docs, fixture_rows, odd_rows, libraries, monkeypatch, heavy):
    # With few heavy pairs most counts come back by the join.
    monkeypatch.setattr(t, "HEAVY", heavy)
    rows = small(fixture_rows[::2]) + [(1000 + i, x) for i, x in small(odd_rows)]
    rows += [(2000, "▁ x"), (2001, "  two  spaces "), (2002, "\n"), (7, "again again"), (7, "again again"), (None, "no id")]
    assert result(t.alignment_digests(batches(spark), docs(rows), A, B)) == brute(rows, libraries)


def test_windows_and_whole_texts_agree(libraries):
    rng = random.Random(5)
    own = t.Aligner(A, B)
    parts = ["the", " the", " ", "  ", "\n", "\t", "naïve", "Ünlü", "日本語", "😀", "1234", "<s>", "</s>", "<0x41>", "<|endoftext|>", "'s", "x" * 30, "\x00", "é", " ", "."]
    for _ in range(500):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        n_a, n_b, groups, links = plain(text, libraries)
        got = own.align(text)
        assert (got[0], got[1], got[2], got[3]) == (n_a, n_b, ";".join(groups), len(groups)), text
        assert Counter(divmod(x, own.n_b) for x in got[4]) == Counter(links)


def test_memory_of_windows_is_bounded(monkeypatch, libraries):
    monkeypatch.setattr(t, "MEMO_WINDOWS", 5)
    monkeypatch.setattr(t, "LONG_WINDOW", 3)
    own = t.Aligner(A, B)
    text = "several different words, and supercalifragilisticexpialidocious ones: " * 3
    n_a, n_b, groups, links = plain(text, libraries)
    assert own.align(text)[:4] == (n_a, n_b, ";".join(groups), len(groups)) and len(own.known) <= 5


def test_groups(spark, docs, libraries):
    rows = [(1, "unbelievable things"), (2, None), (3, "")]
    got = {r.doc_id: r.groups for r in t.aligned_groups(docs(rows), A, B).collect()}
    assert got == {1: ";".join(plain(rows[0][1], libraries)[2]), 2: "", 3: ""}


def test_empty_table(spark, docs):
    assert t.alignment_digests(spark, docs([]), A, B).collect() == []
