"""Packing of tokenised documents into sequences by length patterns.

1. Tokens (Arrow batches): every document's ids plus the end id, cut into pieces.
   Only a document longer than a sequence is cut, its first piece taking the rest.
2. Histogram of piece lengths: at most ``capacity`` rows, whatever the corpus.
3. Plan (driver, on the histogram alone): patterns of few lengths that fill a
   sequence, repeat counts by non-negative least squares, rounded down to what the
   histogram holds; what is left is packed best-fit decreasing, again by length, into
   patterns with repeat counts. The plan's size depends on the number of lengths.
4. Places: the pieces of a length are numbered (chunk counts first, so a length that
   a third of all pieces have is many tasks), and a piece's number picks its pattern,
   repetition and offset.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import scratch_path, texts

CAPACITY = 2048
END_ID = 0
CHUNKS = 64
# Patterns that the fit may choose from, for each number of lengths in a pattern.
PATTERN_PAIRS = 2048
PATTERN_TRIPLES = 6000
FIT_ROUNDS = 200

_encoders = {}


def bpe_encoder(path):
    """Text to ids as a numpy array, exactly as the vocabulary file's tokenizer gives them."""
    if path not in _encoders:
        _encoders[path] = build_encoder(path)
    return _encoders[path]


def build_encoder(path):
    """The byte-level vocabulary of a tokenizer file, run by its merge ranks."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    to_byte = {c: b for b, c in byte_letters().items()}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    # Fixed value: how byte-level tokenizers of this kind split a text into words.
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("file", pat_str=words, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def byte_letters():
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for place, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + place)
    return letters


def pieces(docs, tokenizer, capacity=CAPACITY, end_id=END_ID, id_column="doc_id", text_column="text"):
    """``doc_id, piece, start, length, ids_crc32`` of every document's pieces; null text counts as empty."""

    def run(stream):
        encode = bpe_encoder(tokenizer)
        for batch in stream:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text)
                whole = np.empty(len(ids) + 1, "<u4")
                whole[:-1] = ids
                whole[-1] = end_id
                first = len(whole) % capacity or capacity
                bounds = [0, *range(min(first, len(whole)), len(whole) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(whole[a:b])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return texts(docs, id_column, text_column).mapInArrow(run, schema)


def nonnegative_fit(matrix_rows, target, rounds=FIT_ROUNDS):
    """Non-negative least squares for a sparse 0/1.. matrix by accelerated projected gradient.

    ``matrix_rows`` lists, for each pattern, the histogram places of its lengths
    (repeated for a length used twice).
    """
    n = len(matrix_rows)
    if not n:
        return np.zeros(0)
    width = max(map(len, matrix_rows))
    places = np.array([list(r) + [len(target)] * (width - len(r)) for r in matrix_rows])
    weights = places < len(target)

    def forward(x):
        out = np.zeros(len(target) + 1)
        for k in range(width):
            np.add.at(out, places[:, k], x * weights[:, k])
        return out[:-1]

    def backward(y):
        return np.append(y, 0.0)[places].sum(axis=1)

    # Largest eigenvalue by power iteration, for the step.
    v = np.ones(n)
    for _ in range(20):
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.05 * norm)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * backward(forward(y) - target), 0.0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def length_patterns(lengths, counts, capacity):
    """Patterns of one to three lengths that fill a sequence exactly: the candidates of the fit.

    Lengths are taken by how many pieces have them; every length gets its exact
    partner, triples combine the commonest lengths.
    """
    place = {int(length): i for i, length in enumerate(lengths)}
    found = []
    for length in lengths:
        length = int(length)
        other = capacity - length
        if length == capacity:
            found.append((place[length],))
        elif other in place and length >= other:
            found.append((place[length], place[other]))
    found = found[:PATTERN_PAIRS]
    common = [int(lengths[i]) for i in np.argsort(-counts, kind="stable")[:120]]
    triples = set()
    for i, a in enumerate(common):
        for b in common[i:]:
            rest = capacity - a - b
            if rest > 0 and rest in place:
                triples.add(tuple(sorted((a, b, rest), reverse=True)))
    chosen = sorted(triples, key=lambda t: (-min(counts[place[x]] for x in t), t))[:PATTERN_TRIPLES]
    return found + [tuple(place[x] for x in t) for t in chosen]


def best_fit_patterns(left, lengths, capacity):
    """Best-fit decreasing on counts: ``[(lengths of a sequence, repeats)]`` until nothing is left.

    Each sequence starts with the longest length left and takes, again and again, the
    longest that still fits; the same filling is repeated as often as the counts
    allow, so the work depends on the number of lengths, not of pieces.
    """
    left = left.astype(np.int64).copy()
    out = []
    top = len(lengths) - 1
    while True:
        while top >= 0 and left[top] == 0:
            top -= 1
        if top < 0:
            return out
        used, room = {}, capacity
        place = top
        while place >= 0:
            if left[place] - used.get(place, 0) > 0 and lengths[place] <= room:
                take = int(min(left[place] - used.get(place, 0), room // lengths[place]))
                used[place] = used.get(place, 0) + take
                room -= take * int(lengths[place])
            if room < lengths[0]:
                break
            place = min(place - 1, int(np.searchsorted(lengths, room, side="right")) - 1)
        repeats = min(int(left[p]) // n for p, n in used.items())
        for p, n in used.items():
            left[p] -= n * repeats
        out.append(([p for p, n in used.items() for _ in range(n)], repeats))


def plan(lengths, counts, capacity=CAPACITY):
    """``[(length, first number, repeats, first sequence, stride, offset)]`` for every slot of every pattern.

    Pieces of ``length`` numbered from ``first number`` fill this slot in ``repeats``
    sequences, the k-th in sequence ``first sequence + k``.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    order = np.argsort(lengths)
    lengths, counts = lengths[order], counts[order]
    patterns = length_patterns(lengths, counts, capacity)
    repeats = np.floor(nonnegative_fit(patterns, counts.astype(float)) + 1e-9).astype(np.int64)
    left = counts.copy()
    chosen = []
    for i in np.argsort(-repeats, kind="stable"):
        uses = {p: patterns[i].count(p) for p in patterns[i]}
        times = min([int(repeats[i]), *(int(left[p]) // n for p, n in uses.items())])
        if times > 0:
            for p, n in uses.items():
                left[p] -= n * times
            chosen.append((list(patterns[i]), times))
    chosen += best_fit_patterns(left, lengths, capacity)
    numbered = np.zeros(len(lengths), np.int64)
    slots, sequence = [], 0
    for members, times in chosen:
        offset = 0
        for p in members:
            slots.append((int(lengths[p]), int(numbered[p]), times, sequence, offset))
            numbered[p] += times
            offset += int(lengths[p])
        sequence += times
    return slots


def pack(spark, docs, tokenizer, capacity=CAPACITY, end_id=END_ID, id_column="doc_id", text_column="text"):
    """Every piece's place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece holding the end id alone. Repeated rows are
    packed each. Sequences are gapless from offset 0; an empty table gives no rows.
    """
    path = scratch_path(spark, "pieces")
    pieces(docs, tokenizer, capacity, end_id, id_column, text_column).withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(CHUNKS)).cast("int")
    ).write.parquet(path)
    cut = spark.read.parquet(path)

    chunks = cut.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # At most ``capacity`` rows.
    histogram = chunks.groupBy("length").agg(F.sum("n").alias("n")).collect()
    slots = plan([r["length"] for r in histogram], [r["n"] for r in histogram], capacity)
    slots.sort()
    bounds = {}
    for length, first, times, sequence, offset in slots:
        bounds.setdefault(length, ([], [], []))
        for column, value in zip(bounds[length], (first, sequence, offset)):
            column.append(value)
    bounds = {length: tuple(np.array(c, np.int64) for c in columns) for length, columns in bounds.items()}
    bounds = spark.sparkContext.broadcast(bounds)

    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        cut.withColumn("place", F.row_number().over(within) - 1)
        .join(chunks.select("length", "chunk", "before"), ["length", "chunk"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("before")).alias("number"))
    )

    def place(stream):
        table = bounds.value
        for batch in stream:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                rows = np.flatnonzero(length == value)
                first, sequences, offsets = table[int(value)]
                slot = np.searchsorted(first, number[rows], side="right") - 1
                sequence[rows] = sequences[slot] + number[rows] - first[slot]
                offset[rows] = offsets[slot]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)
