import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from cinderview.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((i, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    return sorted(out)


def test_digests_match_the_library(docs, fixture_rows, odd_rows):
    rows = fixture_rows + [(1000 + i, t) for i, t in odd_rows]
    got = bpe.encoding_digests(docs(rows), PATH).collect()
    assert sorted(map(tuple, got)) == library(rows)


def test_random_words_match_the_library():
    random.seed(7)
    letters = "abcdefghijklmnopqrstuvwxyzéüñßøæœ漢字абв1234567890!?.-_'"
    words = ["".join(random.choices(letters, k=random.randint(1, 14))) for _ in range(4000)]
    words += ["a" * n for n in range(1, 60)] + ["ab" * n for n in range(1, 30)] + ["the" * n for n in range(1, 20)]
    words += ["!" * n for n in range(1, 40)] + ["=" * n for n in range(1, 70)] + ["-" * n for n in range(1, 70)]
    tokenizer = Tokenizer.from_file(PATH)
    for (ids, decoded), word in zip(bpe.word_table(PATH).encode_texts(words), words):
        want = tokenizer.encode(word, add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want, word
        assert decoded == tokenizer.decode(want, skip_special_tokens=False) == bpe.decode(want, PATH)


def test_forgetting_words_changes_nothing(monkeypatch):
    table = bpe.WordTable(PATH)
    texts = ["one two three", "four five six", "one six nine"]
    before = [table.encode_texts([t]) for t in texts]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 1)
    assert [table.encode_texts([t]) for t in texts] == before


def test_ids_and_text_of_rows(docs):
    got = {r.doc_id: r for r in bpe.encode(docs([(1, "Hello  WORLD"), (2, None), (None, "x"), (1, "again")]), PATH).collect() if r.doc_id != 1}
    assert got[2].ids == [] and got[2].decoded == ""
    assert got[None].decoded == "x</w>"


def test_empty_table(docs):
    assert bpe.encoding_digests(docs([]), PATH).collect() == []
