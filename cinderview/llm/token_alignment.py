"""Alignment of two tokenizers' tokens over the same texts, by white-space anchors.

Both tokenizers encode a whole text (a space in front of it, as the second adds one). An
anchor is a byte where tokens of both end and the next tokens begin with a space; the
check that both token sequences spell the same bytes makes shared ends exact. Anchors
cut a text into windows of a few ids. A window's alignment, its groups of ids between
shared ends, depends on its ids alone and is remembered by them: ``MEMO_WINDOWS`` at most,
so that the frequent words stay near; windows of more than ``LONG_WINDOW`` ids are
aligned each time.

Links are the pairs of tokens whose bytes overlap. How many documents hold a pair of ids linked is counted over the corpus. Sums of
these counts go back to documents two ways that always run together: at most ``HEAVY``
pairs can make up 1 / ``HEAVY`` of all rows each, and these are broadcast; all other pairs
are joined, none of which has more rows than that.
"""

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import map_texts, texts, written
from .packing import byte_letters

LONG_WINDOW = 64
MEMO_WINDOWS = 1 << 15
HEAVY = 1 << 16

_aligners = {}


class Aligner:
    """The two tokenizers, the bytes of their tokens, and the windows aligned so far."""

    def __init__(self, a_path, b_path):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        to_byte = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        # Fixed value: how byte-level tokenizers of this kind split a text into words.
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.a = tiktoken.Encoding("a", pat_str=words, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.n_b = len(self.b_bytes)
        self.a_length = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_length = np.array([len(t) for t in self.b_bytes], np.int64)
        self.a_spaced = np.array([t.startswith(b" ") for t in self.a_bytes])
        # Ids as text behind the mark that stands in front of them: first of a group, or not.
        self.a_first, self.a_next = ([f"{mark}{i}" for i in range(len(self.a_bytes))] for mark in ";,")
        self.b_first, self.b_next = ([f"{mark}{i}" for i in range(self.n_b)] for mark in "|,")
        self.a_first, self.a_next, self.b_first, self.b_next = (np.array(x, object) for x in (self.a_first, self.a_next, self.b_first, self.b_next))
        self.known = {}

    def piece_bytes(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, text):
        """Ids of both tokenizers, or none where they do not spell the text."""
        if not text:
            return [], []
        spaced = " " + text
        a, b = self.a.encode_to_numpy(spaced, disallowed_special=()), self.b.encode(text)
        whole = spaced.encode()
        # Tokens of the first are cut from the text's own bytes; pieces of the second may be normalised ones.
        if self.a_length[a].sum() != len(whole) or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return [], []
        return a, b

    def align(self, text):
        """``(n_a, n_b, groups as text, number of groups, link keys)`` of a whole text."""
        a_ids, b = self.tokens(text)
        if not len(b):
            return 0, 0, "", 0, np.zeros(0, np.int64)
        b_ids = np.array(b)
        a_ends, b_ends = np.cumsum(self.a_length[a_ids]), np.cumsum(self.b_length[b_ids])
        a_shared = np.searchsorted(a_ends, b_ends)
        b_shared = np.flatnonzero(a_ends[a_shared] == b_ends)
        a_shared = a_shared[b_shared]
        # Windows end at anchors: shared ends with a space behind them, and the text's end.
        anchors = np.append(np.flatnonzero(self.a_spaced[a_ids[a_shared[:-1] + 1]]), len(a_shared) - 1)
        keys = window_keys(a_ids, b_ids, a_shared[anchors] + 1, b_shared[anchors] + 1)
        found = list(map(self.known.get, keys))
        missed = [w for w, x in enumerate(found) if x is None]
        if missed:
            a_to, b_to = np.append(0, a_shared + 1), np.append(0, b_shared + 1)
            names = self.names(a_ids, b_ids, a_to, b_to)
            cuts = [0, *(a_to + b_to)[anchors + 1].tolist()]
            for w in missed:
                found[w] = "".join(names[cuts[w] : cuts[w + 1]])[1:]
            short = [w for w in missed if len(keys[w]) <= 4 * (LONG_WINDOW + 1)]
            if len(self.known) + len(short) > MEMO_WINDOWS:
                self.known.clear()
            self.known.update((keys[w], found[w]) for w in short[:MEMO_WINDOWS])
        return len(a_ids), len(b), ";".join(found), len(a_shared), linked(a_ids.astype(np.int64) * self.n_b, b_ids, a_ends, b_ends)

    def names(self, a_ids, b_ids, a_to, b_to):
        """Names of all ids in the order of the groups' text, each with the mark in front of it."""
        first_a, first_b = a_to[:-1], b_to[:-1]
        a_names, b_names = self.a_next[a_ids], self.b_next[b_ids]
        a_names[first_a], b_names[first_b] = self.a_first[a_ids[first_a]], self.b_first[b_ids[first_b]]
        out = np.empty(len(a_ids) + len(b_ids), object)
        out[np.arange(len(a_ids)) + np.repeat(first_b, np.diff(a_to))] = a_names
        out[np.arange(len(b_ids)) + np.repeat(a_to[1:], np.diff(b_to))] = b_names
        return out.tolist()


def linked(a_keys, b_ids, a_ends, b_ends):
    """Keys of the overlapping pairs, in order.

    Between any two ends that follow each other, one token of each covers the bytes.
    """
    ends = np.concatenate([a_ends, b_ends])
    ends.sort(kind="stable")
    ends = ends[np.append(True, ends[1:] != ends[:-1])]
    return a_keys[np.searchsorted(a_ends, ends)] + b_ids[np.searchsorted(b_ends, ends)]


def window_keys(a_ids, b_ids, a_cuts, b_cuts):
    """Ids of both tokenizers in each window, as bytes; ``a_cuts`` and ``b_cuts`` are the windows' ends."""
    n = np.arange(len(a_cuts))
    a_from, b_from = np.append(0, a_cuts[:-1]), np.append(0, b_cuts[:-1])
    mixed = np.full(len(a_ids) + len(b_ids) + len(n), 0xFFFFFFFF, "<u4")
    mixed[np.arange(len(a_ids)) + np.repeat(n + b_from, a_cuts - a_from)] = a_ids
    mixed[np.arange(len(b_ids)) + np.repeat(n + 1 + a_cuts, b_cuts - b_from)] = b_ids
    ends = (4 * (a_cuts + b_cuts + n + 1)).tolist()
    packed = mixed.tobytes()
    return [packed[i:j] for i, j in zip([0, *ends], ends)]


def aligner(a_path, b_path):
    """One aligner for each Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def aligned_groups(docs, a_path, b_path, id_column="doc_id", text_column="text"):
    """``doc_id, groups`` of every row: ``a1,a2|b1;a3|b2,b3``, ids of both tokenizers between shared ends.

    Empty for a text that is null, empty, or not spelled alike by both.
    """

    def run(ids, values):
        shared = aligner(a_path, b_path)
        return {"groups": [shared.align(text)[2] for text in values]}

    return map_texts(texts(docs, id_column, text_column), run, "doc_id long, groups string")


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def alignments(docs, a_path, b_path, id_column="doc_id", text_column="text"):
    """Sizes and digest of every row's alignment, and its linked pairs of ids with how often each occurs in it."""

    def run(stream):
        shared, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in stream:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                n_a, n_b, groups, n, links = shared.align(text)
                digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                pairs, times = np.unique(links, return_counts=True)
                out.append((row, doc_id, n_a, n_b, n, len(links), digest, pairs, times.astype(np.int32)))
                row += 1
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    names = [field.split()[0] for field in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return texts(docs, id_column, text_column).mapInArrow(run, ALIGNED)


def pair_counts(rows, n_b):
    """``pair, n, best``: documents that hold a pair linked, and whether no pair of its first id is in more."""
    counted = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    # An id of the first tokenizer meets at most all ids of the second.
    of_id = Window.partitionBy(F.floor(F.col("pair") / n_b))
    return counted.withColumn("best", F.col("n") == F.max("n").over(of_id))


def summed(rows, heavy):
    """Rows with ``count_sum, n_best`` over the heavy pairs, and the other pairs left over."""
    keys, counts, best = heavy

    def run(stream):
        for batch in stream:
            pairs, times = batch.column("pairs"), batch.column("times")
            sizes = np.diff(pairs.offsets.to_numpy())
            flat, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            total, top = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(total, row[hit], often[hit] * counts[at[hit]])
            np.add.at(top, row[hit], often[hit] * best[at[hit]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(sizes)))]), pa.int32())
            left = [pa.ListArray.from_arrays(offsets, pa.array(v[~hit], k)) for v, k in ((flat, pa.int64()), (often, pa.int32()))]
            kept = [batch.column(name) for name in names[:7]]
            yield pa.RecordBatch.from_arrays([*kept, *left, pa.array(total), pa.array(top)], names=names)

    names = [field.split()[0] for field in ALIGNED.split(", ")] + ["count_sum", "n_best"]
    return rows.mapInArrow(run, ALIGNED + ", count_sum long, n_best long")


def alignment_digests(spark, docs, a_path, b_path, id_column="doc_id", text_column="text"):
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``a_path`` names a byte-level tokenizer file and ``b_path`` a sentencepiece model;
    special tokens in a text are plain text. Texts that are null, empty, or not spelled
    alike by both have no tokens: zeros and an empty digest. Very long texts are one
    document like others, a long stretch without white space is one window. Repeated
    rows count as documents of their own; ties for an id's highest count are all best.
    An empty table gives no rows. Other columns are not read.
    """
    rows = written(spark, alignments(docs, a_path, b_path, id_column, text_column), "alignments")
    counts = written(spark, pair_counts(rows, aligner(a_path, b_path).n_b), "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # At most HEAVY rows, as their shares cannot sum to more than one.
    heavy = counts.where(F.col("n") * HEAVY >= total).orderBy("pair").collect()
    heavy = tuple(np.array([r[c] for r in heavy], np.int64) for c in ("pair", "n", "best"))
    parts = summed(rows, heavy)
    entry = F.explode(F.arrays_zip("pairs", "times")).alias("e")
    light = parts.select("row", entry).select("row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    light = (
        light.join(counts.where(F.col("n") * HEAVY < total).hint("merge"), "pair")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("best").cast("int")).alias("more_best"))
    )
    more = lambda own, other: (F.col(own) + F.coalesce(F.col(other), F.lit(0))).alias(own)
    return parts.join(light, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", more("n_best", "more_best"), more("count_sum", "more_sum"), "groups_sha256"
    )
