"""What the operators share: their input columns, batches, spans and scratch tables."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import scratch_path, written  # noqa: F401  (operators take them from here)

# Rows and bytes of one Arrow batch, so that a Python worker holds little text at a time.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def batches(spark):
    """Bound the Arrow batches of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def texts(docs, id_column="doc_id", text_column="text"):
    """``(doc_id, text)`` of any documents table, whatever else it carries; null text becomes empty."""
    return docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )


def id_remainder(modulus, id_column="doc_id"):
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def share_of(column):
    """A number from 0 to 1 that hashing gives a value, alike in every run."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 52)) / float(1 << 52)


def drawn(df, rows, total, on="doc_id"):
    """About ``rows`` of the ``total`` rows, those of the smallest hashed ids.

    A filter, not a sorted limit: with a limit every task would send as many rows.
    """
    return df if rows >= total else df.where(share_of(on) < rows / total)


def sha256_hex(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def byte_view(column):
    """Bytes, starts and ends of an Arrow string column, without copying."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = int(offsets[0]) if len(offsets) else 0
    return data[first : int(offsets[-1])], offsets[:-1] - first, offsets[1:] - first


def byte_chunks(batch, limit=2 << 20):
    """Runs of rows of a batch with at most ``limit`` bytes of text (one row may be longer): ``(from, to)``."""
    _, starts, ends = byte_view(batch.column("text"))
    first = 0
    while first < len(starts):
        last = int(np.searchsorted(ends, starts[first] + limit, side="right"))
        last = max(last, first + 1)
        yield first, last
        first = last


def span_order(kinds):
    """Sort key of spans: by start, then by the listed order of their kinds, then by end."""
    place = {kind: i for i, kind in enumerate(kinds)}
    return lambda span: (span[1], place[span[0]], span[2])


def span_text(spans):
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def map_texts(docs, fn, schema):
    """Run ``fn(list of ids, list of texts) -> dict of columns`` over whole texts, batch by batch."""

    def run(stream):
        for batch in stream:
            ids = batch.column("doc_id")
            out = fn(ids.to_pylist(), batch.column("text").to_pylist())
            arrays = [ids if name == "doc_id" else pa.array(out[name], kind) for name, kind in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])

    fields = arrow_fields(schema)
    return docs.mapInArrow(run, schema)


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
         "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
         "array<int>": pa.list_(pa.int32())}


def arrow_fields(schema):
    """``[(name, Arrow type)]`` of a flat ``"name type, ..."`` schema text."""
    return [(name, ARROW[kind]) for name, kind in (field.split() for field in schema.split(","))]
