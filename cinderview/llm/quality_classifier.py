"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL.

A token is a run of letters, of digits, of other signs, or a line end; features are
single tokens and pairs, hashed to ``2 ** BITS`` places, weighted by the square
root of their number, plus a constant. Training is follow-the-regularised-
leader per coordinate, in ``SHARDS`` tasks on a bounded sample of labelled rows;
their weights are averaged. A score is one sparse dot product.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .bytehash import mixed, prefix_sums, row_sums, runs, span_hashes
from .common import byte_chunks, byte_view, drawn, texts

BITS = 18
SHARDS = 8
# About so many labelled rows are learned from, those of the smallest id hashes.
TRAIN_ROWS = 24_000
ROUNDS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.05

TOKEN = np.full(256, 3, np.uint8)
TOKEN[[9, 11, 12, 13, 32]] = 0
TOKEN[10] = 4
TOKEN[48:58] = 2
TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = 1
# All digits count as one.
SAME = np.arange(256, dtype=np.uint8)
SAME[48:58] = 48


def features(data, starts, ends, bits=BITS):
    """``(row, place, value)`` of every occurrence of a feature; each row has the constant at place 0."""
    n = len(starts)
    data = SAME[data]
    first, last = runs(TOKEN[data], starts, ends)
    rows = np.searchsorted(ends, first, side="right")
    one = span_hashes(prefix_sums(data), first, last)
    pair = rows[1:] == rows[:-1]
    two = mixed(one[:-1][pair] * np.uint64(3) + one[1:][pair])
    # Pairs of one token with itself, next to each other or around another one, are also
    # counted as such, since a token that is repeated may never be seen elsewhere.
    again = rows[1:][(one[1:] == one[:-1]) & pair]
    around = rows[2:][(one[2:] == one[:-2]) & (rows[2:] == rows[:-2])]
    places = (np.concatenate([one, two]) >> np.uint64(64 - bits)).astype(np.int64)
    places = np.concatenate([places, np.full(len(again), 1), np.full(len(around), 2), np.zeros(n, np.int64)])
    rows = np.concatenate([rows, rows[1:][pair], again, around, np.arange(n)])
    size = np.bincount(rows, minlength=n)
    values = 1.0 / np.sqrt(size)[rows]
    values[len(values) - n :] = 1.0
    return rows, places, values


def train(examples, bits=BITS, rounds=ROUNDS, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
    """FTRL-proximal over ``[(places, values, label)]`` with distinct places each; the weight vector."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(places):
        zi = z[places]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[places])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(rounds):
        for places, values, label in examples:
            w = weights(places)
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -30, 30)))
            g = (p - label) * values
            grown = n[places] + g * g
            z[places] += g - (np.sqrt(grown) - np.sqrt(n[places])) / alpha * w
            n[places] = grown
    return weights(np.arange(1 << bits))


def examples(column, labels, bits):
    data, starts, ends = byte_view(column)
    for i in range(len(starts)):
        a, b = starts[i], ends[i]
        _, places, values = features(data[a:b], np.zeros(1, np.int64), np.array([b - a]), bits)
        places, at = np.unique(places, return_inverse=True)
        yield places, np.bincount(at, weights=values), labels[i]


def labelled_sample(labels, target, rows, id_column="doc_id"):
    """``doc_id, label, hash``: about ``rows`` labelled ids, of the smallest hashes; contradictions count by majority."""
    voted = (
        labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(target).cast("double").alias("label"))
        .where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("label").alias("label"))
        .select("doc_id", (F.col("label") >= 0.5).cast("double").alias("label"), F.xxhash64("doc_id").alias("hash"))
    )
    return drawn(voted, rows, voted.count())


def learn(spark, docs, labels, target="quality", rows=TRAIN_ROWS, bits=BITS, id_column="doc_id", text_column="text"):
    """The averaged weight vector. ``labels`` has only the rows that may be learned from.

    Without a single usable label all weights are 0, and every score is a half.
    """
    sample = labelled_sample(labels, target, rows, id_column)
    examples_of = texts(docs, id_column, text_column).join(F.broadcast(sample), "doc_id")

    def shard(table):
        table = table.sort_by([("hash", "ascending"), ("doc_id", "ascending")]).combine_chunks()
        found = list(examples(table.column("text"), table.column("label").to_pylist(), bits))
        w = train(found, bits)
        places = np.flatnonzero(w)
        # The last row counts the shard's examples.
        return pa.table({
            "place": pa.array(np.append(places, -1), pa.int64()),
            "weight": pa.array(np.append(w[places], 1.0) * table.num_rows),
        })

    learned = (
        examples_of.withColumn("shard", F.pmod("hash", F.lit(SHARDS)).cast("int"))
        .groupBy("shard")
        .applyInArrow(shard, "place long, weight double")
        .groupBy("place")
        .agg(F.sum("weight").alias("weight"))
    )
    # At most 2 ** bits + 1 rows.
    learned = learned.toPandas()
    vector, place = np.zeros(1 << bits), learned["place"].to_numpy()
    vector[place[place >= 0]] = learned["weight"].to_numpy()[place >= 0]
    return vector / max(learned["weight"].to_numpy()[place < 0].sum(), 1.0)


def batch_scores(batch, vector):
    """Score of every text of an Arrow batch; null counts as empty."""
    data, starts, ends = byte_view(batch.column("text"))
    bits = int(np.log2(len(vector)))
    out = np.zeros(len(starts))
    for a, b in byte_chunks(batch):
        lo = starts[a]
        rows, places, values = features(data[lo : ends[b - 1]], starts[a:b] - lo, ends[a:b] - lo, bits)
        out[a:b] = row_sums(vector[places] * values, rows, b - a)
    return 1.0 / (1.0 + np.exp(-np.clip(out, -30, 30)))


def scores(spark, docs, vector, id_column="doc_id", text_column="text"):
    """``doc_id, score`` of every whole text, 0 to 1.

    Null and empty texts have the constant's score. Repeated rows are scored each;
    columns other than id and text are not read.
    """
    weights = spark.sparkContext.broadcast(vector)

    def run(stream):
        for batch in stream:
            score = batch_scores(batch, weights.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, score double")


def accepted(spark, docs, vector, least):
    """The rows of ``docs``, all columns as they are, whose ``text`` scores ``least`` or more."""
    weights = spark.sparkContext.broadcast(vector)

    def run(stream):
        for batch in stream:
            yield batch.filter(pa.array(batch_scores(batch, weights.value) >= least))

    return docs.mapInArrow(run, docs.schema)
