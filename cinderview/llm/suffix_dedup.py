"""Removal of repeated passages, exactly: every byte covered by a string that starts earlier too.

All suffixes of the corpus, cut to ``length`` bytes, are sorted by blocks: a suffix
belongs to the bucket of its cover sample, buckets are sorted one at a time, and ties
are settled by the samples' ranks instead of by long comparisons, so a task needs
memory for one bucket only.

The cover sample is chosen by content. In every string of ``length`` bytes the n-gram of
least hash is its sample, so two equal strings have their sample at the same offset,
which is what a difference cover gives for a pair of positions. (A cover by residues
needs 9 of 73 residues, 12.3 % of all positions, and puts a string into 9 buckets;
this one takes under 3 % and one bucket. See the README.)

1. Cover (Arrow batches): each sample with the run of strings it stands for, the hash
   of its n-gram (its bucket) and of the whole run with its surroundings (its rank).
   Within a block of documents equal ranks are combined, so a bucket gets few rows from
   a block however many copies there are.
2. Ranks: in a bucket with one rank every run but the first is a repeat as a whole. Only
   buckets with several ranks, at the edges of passages, are looked into.
3. Buckets: the runs' bytes come in, one bucket after the other in bucket order, and the
   strings of a bucket are sorted by offset, content and place; all but the first of
   equal ones repeat. Buckets with more than ``HOT_RUNS`` runs are dealt out by string,
   combined by block first.
4. Repeats are gathered for each document and cut out of its text.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F

from .bytehash import mixed, prefix_sums, span_hashes
from .common import arrow_fields, byte_chunks, byte_view, texts, written

LENGTH = 100
GRAM = 24
HOT_RUNS = 512
# Rows combined at a time, and bytes of text looked at at a time: what a task holds in memory.
BLOCK_RUNS = 1 << 19
CHUNK_BYTES = 1 << 18

# What a row of the cover is.
ALONE, RUN, REPEAT, MARK = range(4)


def packed_place(start, run, offset):
    """First string, number of further strings and offset of the sample, in one number."""
    return (start << 20) | (run << 10) | offset


def unpacked(place):
    return place >> 20, (place >> 10) & 1023, place & 1023


def window_minima(values, width):
    """Minimum of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(values) - width + 1
    full = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def cover_runs(data, starts, ends, length=LENGTH, gram=GRAM):
    """Runs of neighbouring strings with one sample: ``(bucket, rank, row, place)``, in the order of the text."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.view(np.uint64), none.view(np.uint64), none, none
    sums = prefix_sums(data)
    at = np.arange(n - gram + 1)
    hashes = span_hashes(sums, at, at + gram)
    # The leftmost n-gram of least hash (its upper half): the place is the low part of the key.
    low = np.uint64(0xFFFFFFFF)
    sample = (window_minima((hashes & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)
    long = ends - starts >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    inside = np.cumsum(inside)[: len(sample)] > 0
    change = np.ones(len(sample) + 1, bool)
    change[1:-1] = (sample[1:] != sample[:-1]) | (inside[1:] != inside[:-1])
    bounds = np.flatnonzero(change)
    first, last = bounds[:-1], bounds[1:] - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    own = sample[first]
    offset = own - first
    rank = mixed(span_hashes(sums, first, last + length) + (offset * 1024 + last - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row = np.searchsorted(ends, first, side="right")
    return hashes[own], rank, row, packed_place(first - starts[row], last - first, offset)


def new_values(*columns):
    """Where a row of sorted columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def combined(bucket, rank, doc, place):
    """Rows for the shuffle: one for each bucket with one rank, all ranks and a mark where there are more."""
    order = np.lexsort((place, doc, rank, bucket))
    bucket, rank, doc, place = bucket[order], rank[order], doc[order], place[order]
    once = new_values(bucket, rank, doc, place)
    bucket, rank, doc, place = bucket[once], rank[once], doc[once], place[once]
    fresh, new_rank = new_values(bucket), new_values(bucket, rank)
    ranks = np.bincount(np.cumsum(fresh) - 1, weights=new_rank)[np.cumsum(fresh) - 1] if len(fresh) else np.zeros(0)
    kind = np.where(~new_rank, REPEAT, np.where(ranks > 1, RUN, ALONE)).astype(np.int32)
    # Rows that are settled here get a key of their own, so they fill no bucket.
    settled = (kind == RUN) | (kind == REPEAT)
    key = np.where(settled, mixed(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.view(np.uint64)), bucket)
    value = np.where(settled, bucket, rank)
    marks = np.flatnonzero(fresh & (ranks > 1))
    return (
        np.concatenate([key, bucket[marks]]).view(np.int64),
        np.concatenate([value, rank[marks]]).view(np.int64),
        np.concatenate([doc, doc[marks]]),
        np.concatenate([place, place[marks]]),
        np.concatenate([kind, np.full(len(marks), MARK, np.int32)]),
    )


def cover(rows, length, gram):
    def run(stream):
        held, count = [], 0

        def flush():
            columns = combined(*map(np.concatenate, zip(*held)))
            for a in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[a : a + (1 << 16)]) for c in columns], names=["key", "value", "doc_id", "place", "kind"]
                )

        for batch in stream:
            ids = batch.column("doc_id").to_numpy()
            data, starts, ends = byte_view(batch.column("text"))
            for a, b in byte_chunks(batch, CHUNK_BYTES):
                lo = starts[a]
                bucket, rank, row, place = cover_runs(data[lo : ends[b - 1]], starts[a:b] - lo, ends[a:b] - lo, length, gram)
                held.append((bucket, rank, ids[a:b][row], place))
                count += len(row)
                if count > BLOCK_RUNS:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, "key long, value long, doc_id long, place long, kind int")


def ranked(covered):
    """``doc_id, place, bucket``: repeats as a whole (bucket null), and runs of buckets with several ranks."""
    own = Window.partitionBy("key")
    alone = F.col("kind") == ALONE
    first = F.min(F.when(alone, F.struct("doc_id", "place"))).over(own)
    rank = F.when(alone, F.col("value"))
    several = (F.max(F.col("kind") == MARK).over(own)) | (F.min(rank).over(own) != F.max(rank).over(own))
    judged = covered.select("*", first.alias("first"), several.alias("several"))
    repeat = (F.col("kind") == REPEAT) | (alone & ~F.col("several") & (F.struct("doc_id", "place") != F.col("first")))
    open_run = (F.col("kind") == RUN) | (alone & F.col("several"))
    return judged.where(repeat | open_run).select(
        "doc_id", "place", F.when(open_run, F.when(F.col("kind") == RUN, F.col("value")).otherwise(F.col("key"))).alias("bucket")
    )


def compressed(rows):
    """Texts as zstd frames, for the joins."""

    def run(stream):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in stream:
            data, starts, ends = byte_view(batch.column("text"))
            frames = [pack(data[a:b].tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(frames, pa.binary())], names=["doc_id", "frame"])

    return rows.mapInArrow(run, "doc_id long, frame binary")


def spans_of(places, flags, length):
    """Byte ranges ``(start, end)`` of the flagged strings, neighbours joined."""
    found = places[flags]
    if not len(found):
        return []
    cut = np.flatnonzero(np.diff(found) > 1)
    return list(zip(found[np.append(0, cut + 1)].tolist(), (found[np.append(cut, len(found) - 1)] + length).tolist()))


def run_bytes(joined, length):
    """The bytes of every open run; of hot buckets, instead, each string's hash, combined by block.

    Rows are ``bucket, doc_id, place, body`` for runs, ``bucket`` (the string's hash),
    ``doc_id, place`` (its start) for strings of hot buckets, and ``doc_id, place`` (its
    start) for strings that repeat within the block.
    """

    def run(stream):
        unpack = zstandard.ZstdDecompressor().decompress
        strings, held = [], 0

        def flush():
            hashes, docs, starts = map(np.concatenate, zip(*strings))
            order = np.lexsort((starts, docs, hashes))
            hashes, docs, starts = hashes[order], docs[order], starts[order]
            once = new_values(hashes, docs, starts)
            hashes, docs, starts = hashes[once], docs[once], starts[once]
            fresh = new_values(hashes)
            n = len(hashes)
            for a in range(0, n, 1 << 16):
                part = slice(a, min(a + (1 << 16), n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(hashes[part].view(np.int64), mask=~fresh[part]),
                        pa.array(docs[part]),
                        pa.array(starts[part]),
                        pa.nulls(part.stop - a, pa.binary()),
                    ],
                    names=["bucket", "doc_id", "place", "body"],
                )

        for batch in stream:
            out = []
            for doc, frame, runs in zip(batch.column("doc_id").to_pylist(), batch.column("frame").to_pylist(), batch.column("runs").to_pylist()):
                text = unpack(frame)
                for r in runs:
                    start, more, offset = unpacked(r["place"])
                    body = text[start : start + more + length]
                    if not r["hot"]:
                        out.append((r["bucket"], doc, r["place"], body))
                        continue
                    at = np.arange(len(body) - length + 1)
                    if not len(at):
                        continue
                    hashes = span_hashes(prefix_sums(np.frombuffer(body, np.uint8)), at, at + length)
                    strings.append((hashes, np.full(len(at), doc, np.int64), start + at))
                    held += len(at)
            if out:
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["bucket", "doc_id", "place", "body"])
            if held > BLOCK_RUNS:
                yield from flush()
                strings, held = [], 0
        if strings:
            yield from flush()

    return joined.mapInArrow(run, "bucket long, doc_id long, place long, body binary")


def sorted_buckets(runs, length):
    """``doc_id, start, end`` of the repeats in the buckets, each bucket sorted whole in one task."""

    def resolve(bucket, doc, place, bodies):
        start, _, offset = unpacked(place)
        sizes = np.array([len(b) for b in bodies])
        data = np.frombuffer(b"".join(bodies), np.uint8)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        number = np.maximum(sizes - length + 1, 0)
        run = np.repeat(np.arange(len(bodies)), number)
        nth = np.arange(len(run)) - np.repeat(np.cumsum(number) - number, number)
        at = begin[run] + nth
        hashes = span_hashes(prefix_sums(data), at, at + length)
        where, docs = start[run] + nth, doc[run]
        order = np.lexsort((where, docs, hashes, offset[run] - nth, bucket[run]))
        same = ~new_values(bucket[run][order], (offset[run] - nth)[order], hashes[order])
        # A row that occurs twice repeats nothing by itself: the same place is the same string.
        firsts = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        same &= (docs[order] != docs[order][firsts]) | (where[order] != where[order][firsts])
        flags = np.zeros(len(run), bool)
        flags[order] = same
        out = []
        edges = np.cumsum(number) - number
        for i in np.unique(run[flags]):
            own = slice(edges[i], edges[i] + number[i])
            out += [(int(doc[i]), s, e) for s, e in spans_of(where[own], flags[own], length)]
        return out

    def run(stream):
        held, size = [], 0
        for batch in stream:
            held.append(batch)
            size += batch.nbytes
            if size < 4 * CHUNK_BYTES:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            buckets = rows.column("bucket").to_numpy()
            # The last bucket may go on in the next batch.
            whole = int(np.flatnonzero(new_values(buckets))[-1])
            yield from resolved(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
            size = sum(b.nbytes for b in held)
        if held:
            yield from resolved(pa.Table.from_batches(held))

    def resolved(rows):
        if not rows.num_rows:
            return
        found = resolve(*(rows.column(c).to_numpy() for c in ("bucket", "doc_id", "place")), rows.column("body").to_pylist())
        if found:
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "end"])

    return (
        runs.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "place").mapInArrow(run, "doc_id long, start long, end long")
    )


def hot_strings(strings, length):
    """``doc_id, start, end`` of the repeats among strings of hot buckets."""
    first = F.min(F.struct("doc_id", "place")).over(Window.partitionBy("bucket"))
    late = strings.where("bucket IS NOT NULL").select("doc_id", "place", first.alias("first")).where(F.struct("doc_id", "place") != F.col("first"))
    local = strings.where("bucket IS NULL")
    return late.select("doc_id", "place").unionAll(local.select("doc_id", "place")).select(
        "doc_id", F.col("place").alias("start"), (F.col("place") + length).alias("end")
    )


def merged(spans):
    """Sorted ranges with overlapping and touching ones joined."""
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def repeated_spans(spark, rows, length=LENGTH, gram=GRAM):
    """``doc_id, spans``: for each document with a repeat, its byte ranges as ``start * 2**20 + size`` (not yet merged)."""
    if not gram < length <= 1000:
        raise ValueError("gram < length <= 1000 is needed")
    named = rows.where("doc_id IS NOT NULL")
    found = written(spark, ranked(cover(named, length, gram)), "cover")
    runs = found.where("bucket IS NOT NULL")
    # Few rows, so that the join below is planned by their size and a hot bucket can be split.
    hot = written(spark, runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_RUNS), "hot-buckets")
    runs = runs.join(hot.select("bucket", F.lit(True).alias("hot")), "bucket", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    runs = runs.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "place", "hot")).alias("runs"))
    opened = written(spark, run_bytes(compressed(named).join(runs, "doc_id"), length), "runs")
    whole = found.where("bucket IS NULL").select(
        "doc_id",
        F.shiftright("place", 20).alias("start"),
        (F.shiftright("place", 20) + F.shiftright("place", 10).bitwiseAND(1023) + length).alias("end"),
    )
    repeats = whole.unionAll(sorted_buckets(opened.where("body IS NOT NULL"), length)).unionAll(hot_strings(opened.where("body IS NULL"), length))
    packed = (F.shiftleft("start", 20) + F.col("end") - F.col("start")).alias("span")
    return repeats.select("doc_id", packed).groupBy("doc_id").agg(F.collect_set("span").alias("spans"))


def remove_repeats(spark, docs, length=LENGTH, gram=GRAM, id_column="doc_id", text_column="text"):
    """``doc_id, n_bytes, spans, kept`` of every row: the removed byte ranges and the bytes that stay.

    Strings never cross documents and are judged on the input. Order is by id, then
    place. Null text counts as empty; texts shorter than ``length`` stay whole. Rows
    without an id stay whole and make nothing a repeat. Rows of one id are one document:
    repeated rows are judged once and cut alike; if their texts differ, what is cut from
    one is cut from all at the same places.
    """
    return cut_out(spark, docs, length, gram, id_column, text_column, "doc_id long, n_bytes long, spans array<long>, kept binary", whole_row)


def whole_row(text, spans, kept):
    return [x for span in spans for x in span], kept


def digest_row(text, spans, kept):
    return sum(end - start for start, end in spans), len(spans), hashlib.sha256(kept).hexdigest()


def repeat_digests(spark, docs, length=LENGTH, gram=GRAM, id_column="doc_id", text_column="text"):
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: ``remove_repeats`` reduced to digests in the same pass."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return cut_out(spark, docs, length, gram, id_column, text_column, schema, digest_row)


def cut_out(spark, docs, length, gram, id_column, text_column, schema, row):
    rows = texts(docs, id_column, text_column)
    joined = compressed(rows).join(repeated_spans(spark, rows, length, gram), "doc_id", "left")
    fields = arrow_fields(schema)

    def run(stream):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in stream:
            out = []
            for doc, frame, spans in zip(batch.column("doc_id").to_pylist(), batch.column("frame").to_pylist(), batch.column("spans").to_pylist()):
                text = unpack(frame)
                spans = merged((s >> 20, min((s >> 20) + (s & 0xFFFFF), len(text))) for s in spans or ())
                spans = [(a, b) for a, b in spans if a < b]
                at, parts = 0, []
                for start, end in spans:
                    parts.append(text[at:start])
                    at = end
                parts.append(text[at:])
                out.append((doc, len(text), *row(text, spans, b"".join(parts))))
            columns = list(zip(*out)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])

    return joined.mapInArrow(run, schema)
