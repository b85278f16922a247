"""BPE encoding and decoding of whole texts by a trie of distinct words.

BPE has this property: the encoding of a text ends in exactly one token whose
boundary to the token before it no merge would cross, and cutting that token off
leaves the encoding of the shorter text. So for each prefix of a word one state, its
last token, holds the whole encoding: stepping back token by token reads it out.

Distinct words of a batch are sorted, which is the depth-first order of their trie.
The walk keeps the states of the current path; a word reuses the states of the
prefix it shares with the word before it and adds only its own. The last letter of a
word carries the word end and is a state of its own.

Words seen by a Python worker are kept across batches, up to ``CACHE_WORDS``; then
the table starts anew, which changes no result.
"""

import json
import re
import unicodedata
from itertools import chain

import regex

from .common import map_texts, sha256_hex, texts
from .packing import byte_letters

CACHE_WORDS = 600_000

# White space and words as the vocabulary file's tokenizer splits them.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
# The same for texts of the letters below U+0250 without their odd digits and controls, where ``re`` is faster.
SIMPLE_WORDS = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
NOT_SIMPLE = re.compile("[\x1c-\x1f²³¹¼½¾ɐ-\U0010ffff]")


class WordTable:
    """Vocabulary, merges and the encodings of the words seen so far.

    The vocabulary is held by bytes, one character (U+0000 to U+00FF) each. A token
    that ends a word is the same string plus the end mark.
    """

    END = "Ā"  # past all bytes

    def __init__(self, path):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        to_byte = {letter: chr(b) for b, letter in byte_letters().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

        def own(token):
            ends = token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            return "".join(to_byte[c] for c in body) + (self.END if ends else "")

        self.ids, self.written = {}, {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                self.ids[own(token)] = str(i)
                self.written[own(token)] = token
        self.rank, self.parts = {}, {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (own(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            self.rank[left, right] = rank
            self.parts.setdefault(left + right, (rank, left, right))
        self.longest = max(map(len, self.ids))
        self.allowed = {}
        self.forget()

    def forget(self):
        self.word_ids, self.word_tokens = {}, {}

    def may_stand(self, left, right):
        """Whether BPE leaves the boundary between two tokens uncrossed.

        Undoing the later of the two tokens' last merges, step by step, gives every
        pair that met at the boundary while merging ran. The boundary is crossed if
        such a pair had a merge that came before the one just undone; of merges of
        one rank the left one comes first.
        """
        if len(self.allowed) > 4 * CACHE_WORDS:
            self.allowed.clear()
        known = self.allowed[left, right] = self.uncrossed(left, right)
        return known

    def uncrossed(self, left, right):
        rank, parts = self.rank, self.parts
        before = (float("inf"), 0)
        while True:
            crossing = rank.get((left, right))
            # A crossing merge stands to the right of a merge within ``left`` and to the left of one within ``right``.
            if crossing is not None and (crossing, 1) < before:
                return False
            in_left, in_right = parts.get(left), parts.get(right)
            if in_left is None and in_right is None:
                return True
            if in_right is None or (in_left is not None and in_left[0] > in_right[0]):
                before, left = (in_left[0], 0), in_left[2]
            else:
                before, right = (in_right[0], 2), in_right[1]

    def learn(self, words):
        """Walk the trie of new words depth-first and note their encodings."""
        ids, written, allowed, longest = self.ids, self.written, self.allowed, self.longest
        path, states = "", []
        for word, letters in sorted((w if w.isascii() else w.encode().decode("latin-1"), w) for w in words):
            body, size = word[:-1], len(word) - 1
            shared, most = 0, min(len(path), size)
            while shared < most and path[shared] == body[shared]:
                shared += 1
            del states[shared:]
            path = body
            ended = word + self.END
            # The states of the prefixes that are new, and last that of the whole word with its end.
            for end in range(shared + 1, size + 2):
                text = body if end <= size else ended
                stop = end if end <= size else end + 1
                for start in range(max(0, stop - longest), end):
                    token = text[start:stop]
                    if token in ids:
                        if not start:
                            break
                        pair = (states[start - 1], token)
                        known = allowed.get(pair)
                        if known or (known is None and self.may_stand(*pair)):
                            break
                else:
                    raise ValueError(f"the vocabulary has no token for {text[:stop]!r}")
                if end <= size:
                    states.append(token)
            tokens, at = [token], start
            while at:
                token = states[at - 1]
                tokens.append(token)
                at -= len(token)
            tokens.reverse()
            self.word_ids[letters] = " ".join([ids[t] for t in tokens])
            self.word_tokens[letters] = " ".join([written[t] for t in tokens])

    def words(self, text):
        """A text's words after normalisation: composed letters, lower case by letter, white space dropped."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        return (WORDS if NOT_SIMPLE.search(text) else SIMPLE_WORDS).findall(text)

    def split(self, text):
        """Words of a text, with special tokens written in it as one-item tuples."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.words(text)
        parts = self.split_special.split(text)
        return list(chain.from_iterable([(p,)] if i % 2 else self.words(p) for i, p in enumerate(parts)))

    def encode_texts(self, values):
        """``(ids joined by one space, tokens joined by one space)`` of every text."""
        split = [self.split(text) for text in values]
        if len(self.word_ids) > CACHE_WORDS:
            self.forget()
        new = set().union(*split).difference(self.word_ids)
        for special in [w for w in new if isinstance(w, tuple)]:
            self.word_ids[special], self.word_tokens[special] = str(self.special[special[0]]), special[0]
            new.discard(special)
        self.learn(new)
        ids, tokens = self.word_ids.__getitem__, self.word_tokens.__getitem__
        return [(" ".join(map(ids, words)), " ".join(map(tokens, words))) for words in split]


_tables = {}


def word_table(path):
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def decode(ids, path):
    """Text of a sequence of ids: the vocabulary's tokens joined by one space, special ones included."""
    table = word_table(path)
    names = {int(i): table.written[t] for t, i in table.ids.items()} | {i: s for s, i in table.special.items()}
    return " ".join(names[i] for i in ids)


def encode(docs, tokenizer, id_column="doc_id", text_column="text"):
    """``doc_id, ids, decoded`` of every row: ids as an array, and the text they decode to.

    Null text counts as empty and has no ids. Repeated rows are encoded each; other
    columns are not read.
    """

    def run(doc_ids, values):
        found = word_table(tokenizer).encode_texts(values)
        return {"ids": [[int(i) for i in ids.split()] for ids, _ in found], "decoded": [d for _, d in found]}

    return map_texts(texts(docs, id_column, text_column), run, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs, tokenizer, id_column="doc_id", text_column="text"):
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ``encode`` reduced to digests in the same pass.

    The ids are hashed as decimal numbers joined by one space.
    """

    def run(doc_ids, values):
        found = word_table(tokenizer).encode_texts(values)
        return {
            "n_tokens": [ids.count(" ") + 1 if ids else 0 for ids, _ in found],
            "ids_sha256": [sha256_hex(ids) for ids, _ in found],
            "decoded_sha256": [sha256_hex(tokens) for _, tokens in found],
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(texts(docs, id_column, text_column), run, schema)
