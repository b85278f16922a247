"""Quality rules: statistics of every text, judged by an isolation forest.

Two base rules fail a document outright. The rest is judged by how unlike clean
documents its statistics are: trees of random splits are grown on a bounded sample of
labelled clean rows, and a document's score is its expected path length in the usual
form ``2 ** -(path / c)``. The threshold on the score is calibrated on all labelled
rows, by histogram: it may lose at most ``CLEAN_LOSS`` of the clean ones, and of the
thresholds that allow it takes the one with the best balance.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .bytehash import SPACE
from .common import arrow_fields, byte_view, drawn, scratch_path, texts

# Fixed values of the base rules.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

TREES = 100
TREE_ROWS = 256
DEPTH = 10
EDGE_POINTS = 8
BINS = 2000
CLEAN_LOSS = 0.005

STATISTICS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_chars long, n_upper long, n_digits long, n_signs long, n_same_words long"

CLASSES = np.zeros(256, np.uint8)
CLASSES[65:91] = 1
CLASSES[48:58] = 2
CLASSES[[33, 34, *range(39, 48), *range(58, 60), 61, *range(63, 65), *range(91, 97), *range(123, 127)]] = 3
CLASSES[list(SYMBOLS)] = 4


def repeated_words(words):
    """Words that lie in a window of three words found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    n, reach = 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            n += i + 3 - max(reach, i)
            reach = i + 3
    return n


def duplicate_lines(data):
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def statistics(docs, id_column="doc_id", text_column="text"):
    """One row of counts per row of ``docs``; null text counts as empty, with all counts 0 but one line."""

    def run(stream):
        for batch in stream:
            data, starts, ends = byte_view(batch.column("text"))
            values = batch.column("text").to_pylist()
            n = len(values)
            out = {name: np.zeros(n, np.int64) for name, _ in fields[1:]}
            white = np.concatenate([[0], np.cumsum(SPACE[data])])
            counts = {}
            for kind, name in enumerate(("n_upper", "n_digits", "n_signs", "n_symbols"), 1):
                sums = np.concatenate([[0], np.cumsum(CLASSES[data] == kind)])
                counts[name] = sums[ends] - sums[starts]
            out.update(counts)
            out["n_chars"] = np.array([len(t) for t in values], np.int64)
            out["word_chars"] = out["n_chars"] - (white[ends] - white[starts])
            buffer = data.tobytes()
            for i in range(n):
                text = buffer[starts[i] : ends[i]]
                # Bytes split at exactly the six ASCII white space characters.
                words = text.split()
                out["n_words"][i] = len(words)
                out["n_repeat_words"][i] = repeated_words(words)
                out["n_dup_lines"][i] = duplicate_lines(text)
                out["n_lines"][i] = text.count(b"\n") + 1
                out["n_same_words"][i] = sum(map(bytes.__eq__, words, words[1:]))
            arrays = [batch.column("doc_id"), *[pa.array(out[name], kind) for name, kind in fields[1:]]]
            yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])

    fields = arrow_fields(STATISTICS)
    return texts(docs, id_column, text_column).mapInArrow(run, STATISTICS)


def rates(c):
    """The forest's features from columns of counts.

    Roots of shares, so that the long tails of clean documents weigh less. Digits are
    counted but left out: dates or personal data do not make a text poor.
    """
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "n_chars", "n_lines"))
    shares = np.stack(
        [
            c["n_symbols"] / chars,
            c["n_dup_lines"] / lines,
            c["n_repeat_words"] / words,
            c["n_same_words"] / words,
            c["word_chars"] / words,
            c["n_upper"] / chars,
            c["n_signs"] / chars,
            np.log2(1.0 + words / lines),
        ],
        axis=1,
    )
    return np.sqrt(shares)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def usual_path(n):
    """Mean path length of an unsuccessful search in a tree of ``n`` points."""
    n = np.maximum(np.asarray(n, float), 1.0)
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / n, np.where(n > 1, 1.0, 0.0))


def grow(points, rng, depth=DEPTH):
    """One tree as arrays ``feature, cut, left child, path``; a leaf is its own child, the right child follows the left."""
    feature, cut, child, path = [], [], [], []

    def node():
        for column, value in ((feature, 0), (cut, 0.0), (child, len(feature)), (path, 0.0)):
            column.append(value)
        return len(feature) - 1

    todo = [(node(), points, 0)]
    while todo:
        at, own, level = todo.pop()
        low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(0), np.zeros(0))
        split = np.flatnonzero(high > low)
        if level == depth or len(own) < 2 or not len(split):
            child[at], path[at] = at, level + float(usual_path(len(own)))
            continue
        feature[at] = int(rng.choice(split))
        cut[at] = float(rng.uniform(low[feature[at]], high[feature[at]]))
        goes_left = own[:, feature[at]] <= cut[at]
        child[at] = node()
        right = node()
        todo += [(child[at], own[goes_left], level + 1), (right, own[~goes_left], level + 1)]
    return np.array(feature), np.array(cut), np.array(child), np.array(path)


def grow_forest(points, trees=TREES, tree_rows=TREE_ROWS, seed=11):
    """Trees on random subsets of the sample; each feature's range is widened by its spread.

    The widening lets a split fall outside the sample, so values beyond all clean ones
    are isolated early even where clean documents all share one value.
    """
    rng = np.random.default_rng(seed)
    spread = np.maximum(points.std(axis=0), 1e-3)
    forest = []
    for _ in range(trees):
        own = points[rng.choice(len(points), min(tree_rows, len(points)), replace=False)]
        forest.append(grow(np.concatenate([own, edges(own, spread, rng)]), rng))
    return forest


def edges(own, spread, rng, each=EDGE_POINTS):
    """For each feature a few points like drawn rows but some spreads past the largest value."""
    features = np.tile(np.arange(own.shape[1]), each)
    out = own[rng.integers(len(own), size=len(features))].copy()
    out[np.arange(len(features)), features] = own.max(axis=0)[features] + 4 * spread[features] * rng.uniform(0.5, 1.5, len(features))
    return out


def anomaly(points, forest, tree_rows=TREE_ROWS):
    """Score from 0 to 1 for each point, larger for points that few splits isolate."""
    total = np.zeros(len(points))
    rows = np.arange(len(points))
    for feature, cut, child, path in forest:
        at = np.zeros(len(points), np.int64)
        for _ in range(DEPTH):
            leaf = child[at] == at
            at = np.where(leaf, at, child[at] + (points[rows, feature[at]] > cut[at]))
        total += path[at]
    return 2.0 ** (-total / max(len(forest), 1) / float(usual_path(tree_rows)))


def clean_sample(labelled, rows):
    """Counts of about ``rows`` clean labelled documents, those of the smallest id hashes."""
    picked = labelled.where(F.col("label") == 1).where(~base_failed())
    return drawn(picked, rows, picked.count()).toPandas().sort_values("doc_id", kind="stable")


def threshold(scored, clean_loss=CLEAN_LOSS, bins=BINS):
    """Score above which a document goes, from ``score, label`` rows counted by score bin (at most ``bins`` rows)."""
    counted = (
        scored.select(F.floor(F.col("score") * bins).cast("int").alias("bin"), "label")
        .groupBy("bin")
        .agg(F.sum("label").alias("clean"), F.sum(1 - F.col("label")).alias("poor"))
        .toPandas()
    )
    clean, poor = np.zeros(bins + 1), np.zeros(bins + 1)
    clean[counted["bin"]], poor[counted["bin"]] = counted["clean"], counted["poor"]
    if not clean.sum() or not poor.sum():
        return 1.0
    # Share above the lower edge of each bin.
    lost = np.cumsum(clean[::-1])[::-1] / clean.sum()
    caught = np.cumsum(poor[::-1])[::-1] / poor.sum()
    gain = np.where(lost <= clean_loss, caught - lost, -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    # The middle of equally good edges keeps the same distance to both sides.
    return float(best[len(best) // 2]) / bins


def judge(spark, docs, labels, clean_loss=CLEAN_LOSS, trees=TREES, tree_rows=TREE_ROWS, id_column="doc_id", text_column="text"):
    """Counts of every row with ``base_failed``, ``score`` and ``kept``.

    ``labels`` has ``doc_id, label`` (1 clean, 0 poor, contradictions by majority;
    null labels and ids are left out). Without clean labels the forest is grown on any
    documents, and without labels of both kinds only the base rules drop. Null and
    empty texts have no words and fail the base rules; repeated rows are judged each.
    """
    path = scratch_path(spark, "rule-statistics")
    statistics(docs, id_column, text_column).write.parquet(path)
    counts = spark.read.parquet(path)
    voted = (
        labels.where("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    )
    labelled = counts.join(voted, "doc_id")
    sample = clean_sample(labelled, trees * tree_rows)
    if sample.empty:
        sample = clean_sample(counts.withColumn("label", F.lit(1)), trees * tree_rows)
    forest = grow_forest(rates({c: sample[c].to_numpy() for c in sample.columns}), trees, tree_rows) if len(sample) else []
    forest = spark.sparkContext.broadcast(forest)

    def score(stream):
        for batch in stream:
            columns = {name: batch.column(name).to_numpy() for name in batch.schema.names[1:]}
            found = anomaly(rates(columns), forest.value, tree_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "score"])

    def scored(df):
        return df.mapInArrow(score, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + ", score double")

    cut = threshold(scored(labelled).where(~base_failed()).select("score", "label"), clean_loss)
    return scored(counts).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("score") < cut))
