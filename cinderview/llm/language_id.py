"""Language of a text by a string kernel.

The kernel of two texts is the share of n-grams (2 to 4 bytes of the lower-cased
text, digits and ASCII signs as blanks, hashed to ``2 ** BITS`` places) present in
both: ``|A & B| / sqrt(|A| |B|)``. Nystroem landmarks, a few texts of each language,
map a text to its kernel values with them, whitened by the landmarks' own kernel. On
that map one ridge regression per language (one versus rest) is fitted. Scoring is
two matrix products per block of texts: presences times landmarks, and the result
times the regression.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import byte_view, share_of, texts

BITS = 14
GRAMS = (2, 3, 4)
LANDMARKS = 24
TRAIN_ROWS = 400
RIDGE = 1e-2
BLOCK_ROWS = 64
UNKNOWN = "und"

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[[c for c in range(128) if not (65 <= c < 91 or 97 <= c < 123)]] = 32
ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text):
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def presence(values, bits=BITS):
    """One row of 0 and 1 (float32) per text: which n-gram places it has."""
    column = pa.array([t.lower() for t in values], pa.large_string())
    data, starts, ends = byte_view(column)
    out = np.zeros((len(values), 1 << bits), np.float32)
    for i in range(len(values)):
        own = FOLD[data[starts[i] : ends[i]]].astype(np.uint32)
        code = own
        for n in range(2, max(GRAMS) + 1):
            if len(own) < n:
                break
            code = (code[:-1] << np.uint32(8)) | own[n - 1 :]
            if n in GRAMS:
                out[i, (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits)] = 1.0
    return out


def kernel(present, marks):
    """Kernel values with the landmarks; ``marks`` are presences divided by the root of their size."""
    size = np.sqrt(np.maximum(present.sum(axis=1), 1.0))
    return (present @ marks.T) / size[:, None]


def blocks(values):
    for at in range(0, len(values), BLOCK_ROWS):
        yield at, values[at : at + BLOCK_ROWS]


def fit(marks, train_kernel, train_place, n_languages, ridge=RIDGE):
    """Matrix from kernel values to one regression value per language."""
    own = marks @ marks.T
    values, vectors = np.linalg.eigh(own.astype(float))
    kept = values > values.max() * 1e-6
    whiten = vectors[:, kept] / np.sqrt(values[kept])
    mapped = train_kernel @ whiten
    target = np.eye(n_languages)[train_place]
    # Every language weighs the same, however many rows it has.
    weight = 1.0 / np.bincount(train_place, minlength=n_languages)[train_place]
    weight = weight / weight.mean()
    inner = mapped.T @ (mapped * weight[:, None]) + ridge * len(mapped) / max(mapped.shape[1], 1) * np.eye(mapped.shape[1])
    return whiten @ np.linalg.solve(inner, mapped.T @ (target * weight[:, None]))


def learn(spark, docs, landmarks=LANDMARKS, train_rows=TRAIN_ROWS, id_column="doc_id", text_column="text", lang_column="lang"):
    """``(languages, landmark presences, regression)`` from the labelled rows of ``docs``.

    From each language at most ``train_rows`` ids are learned from, those of the
    smallest hashes, the first ``landmarks`` of them being landmarks. Rows without language, letters
    or text teach nothing.
    """
    labelled = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.col(f"`{text_column}`").alias("text"),
        F.col(f"`{lang_column}`").alias("lang"),
    ).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    named = labelled.where("doc_id IS NOT NULL").select("doc_id", "lang")
    # One row per language. About twice the wanted rows are left of each before they are ranked.
    counted = named.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    few = named.join(F.broadcast(counted), "lang").where(share_of("doc_id") * F.col("rows") < 2.0 * train_rows).distinct()
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = few.select("doc_id", "lang", F.row_number().over(first).alias("place")).where(F.col("place") <= train_rows)
    drawn = labelled.join(F.broadcast(picked), ["doc_id", "lang"])

    def packed(stream):
        for batch in stream:
            values = batch.column("text").to_pylist()
            bits = np.packbits(presence(values).astype(bool), axis=1)
            bits = [row.tobytes() if has_letter(t) else None for row, t in zip(bits, values)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("place"), batch.column("doc_id"), pa.array(bits, pa.binary())],
                names=["lang", "place", "doc_id", "bits"],
            )

    schema = "lang string, place int, doc_id long, bits binary"
    marked = drawn.where(F.col("place") <= landmarks).mapInArrow(packed, schema).where("bits IS NOT NULL").toPandas()
    marked = marked.sort_values(["lang", "place", "doc_id"])
    if marked.empty:
        return [], np.zeros((0, 1 << BITS), np.float32), np.zeros((0, 0))
    marks = np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in marked["bits"]]), axis=1).astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1.0))
    shared = spark.sparkContext.broadcast(marks)

    def kernels(stream):
        for batch in stream:
            values = batch.column("text").to_pylist()
            rows = [k for _, block in blocks(values) for k in kernel(presence(block), shared.value).astype(float)]
            rows = [k.tolist() if has_letter(t) else None for k, t in zip(rows, values)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["lang", "doc_id", "row"]
            )

    # A bounded number of rows for each language.
    rows = drawn.mapInArrow(kernels, "lang string, doc_id long, row array<double>").where("row IS NOT NULL").toPandas()
    rows = rows.sort_values(["lang", "doc_id"])
    languages = sorted(set(rows["lang"]))
    place = rows["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
    return languages, marks, fit(marks, np.stack(rows["row"].to_numpy()), place, len(languages))


def identify(spark, docs, model, id_column="doc_id", text_column="text"):
    """``doc_id, lang_pred, score`` of every row.

    Null text, and text without a letter, is ``und`` with score 0, as is everything
    where no language was learned. Ties go to the first language in order.
    """
    languages, marks, regression = model
    shared = spark.sparkContext.broadcast((marks, regression.astype(np.float32)))

    def run(stream):
        marks, regression = shared.value
        for batch in stream:
            found, scores = [], []
            for _, block in blocks(batch.column("text").to_pylist()):
                if not languages:
                    found += [UNKNOWN] * len(block)
                    scores += [0.0] * len(block)
                    continue
                values = kernel(presence(block), marks) @ regression
                for text, row in zip(block, values):
                    known = has_letter(text)
                    best = int(row.argmax())
                    found.append(languages[best] if known else UNKNOWN)
                    scores.append(float(min(max(row[best], 0.0), 1.0)) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return texts(docs, id_column, text_column).mapInArrow(run, "doc_id long, lang_pred string, score double")
