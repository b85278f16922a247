"""Near-duplicates: fast similarity sketches, banding, exact verification.

Sketch. A set is thrown into ``SIZE`` bins in rounds: in round i every element gets a
bin and a value in [i, i + 1) by a hash, and a bin keeps its least value. Rounds end
when every bin is filled; from round ``SIZE`` on, all elements go to one fixed bin each
round, so filling is certain. Estimates from it are as concentrated as with
independent minima, at a cost near one hash per element.

Candidates. Documents with the same set are one class, joined by their set's id. Band
keys of the classes are counted; in each bucket with two or more classes all members
are paired with one centre only, the member with most partners over all its buckets,
so a bucket of n classes gives n - 1 pairs.

Verification. Members and centres meet in one sorted shuffle, a centre before its
members; members of a large centre are spread over slots, each with its own copy of the
centre. Full sets are compared.

No component is lost to the star. If x is not linked to centre c, but to y in the same
bucket, then the differences Dx and Dy from c share more than a part ``(1 - k) / 2`` of
Dy, with ``k = (1 - t) / (1 + t)``, and at least |Dx| less what x and y may differ by.
The part holds for Dx too only if y is not linked to c either: an unlinked member has
the longer prefix to meet linked ones, and the shorter one to meet other unlinked ones.
Prefixes of these lengths, in an order that all members of a centre share, must meet, so
x and y are together in the group of a centre and an element. The order puts elements
first that no pair can meet in, then those of few members: what many copies have or lack
alike comes last, mostly past the prefixes, so groups stay small however many copies
there are. Groups of ``SMALL_GROUP`` members or fewer are paired, filtered by position and verified. A larger
group is a bucket again: its members are paired with one more centre, an unlinked member
that most of the centre's groups share, and what is not linked to that one meets in the
differences from it, round after round, until no group is large. A centre leaves its
group, so rounds end; members known to be connected need not meet. A member is verified
with ``SMALL_GROUP`` others at most for each element of its prefix.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window, functions as F

from ..functions.ordered import union_all
from .bytehash import LOWER, mixed, prefix_sums, span_hashes, words
from .common import byte_chunks, byte_view, texts, written
from .components import components

BAND_ROWS = 5
MISS = 1e-5
SLOT_MEMBERS = 256
SMALL_GROUP = 256
# Elements of differences in one Arrow batch (more if those of one member are), so that a Python worker holds few at a time.
BATCH_ELEMENTS = 1 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(threshold, rows=BAND_ROWS, miss=MISS):
    """Bands needed so that a pair of exactly this similarity is missed with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_hashes(data, starts, ends, width):
    """One sorted array of distinct shingle hashes for each row; fewer words than ``width`` are one shingle."""
    n = len(starts)
    data = LOWER[data]
    first, last, rows = words(data, starts, ends)
    own = span_hashes(prefix_sums(data), first, last)
    bounds = np.searchsorted(rows, np.arange(n + 1))
    out = []
    if len(own) >= width:
        joined = np.full(len(own) - width + 1, np.uint64(width))
        for k in range(width):
            joined = mixed(joined * STEP + own[k : len(own) - width + 1 + k])
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mixed(whole * STEP + own[k : k + 1])
            out.append(whole)
        else:
            out.append(own[:0])
    return out


def sketches(sets, size):
    """Fast similarity sketch of every set, one row each; empty sets have no use for theirs."""
    n = len(sets)
    flat = np.full(n * size, EMPTY)
    elements = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    for turn in range(2 * size):
        if not len(elements):
            break
        x = mixed(elements + np.uint64((turn + 1) * int(STEP) % (1 << 64)))
        if turn < size:
            bins = ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        else:
            bins = np.full(len(x), turn - size, np.int64)
        value = (np.uint64(turn) << np.uint64(40)) | (x & np.uint64((1 << 40) - 1))
        np.minimum.at(flat, rows * size + bins, value)
        unfilled = (flat.reshape(n, size) == EMPTY).any(axis=1)
        keep = unfilled[rows]
        elements, rows = elements[keep], rows[keep]
    return flat.reshape(n, size)


def band_keys(sketch, bands):
    """One hash for each band of a sketch's coordinates."""
    n, size = sketch.shape
    parts = sketch.reshape(n, bands, size // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for k in range(parts.shape[2]):
        key = mixed(key * STEP + parts[:, :, k])
    return key


SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"


def signatures(rows, width, bands):
    """Set size, set id (128 bits) and band keys of every text."""

    def run(stream):
        for batch in stream:
            data, starts, ends = byte_view(batch.column("text"))
            sizes, ids, keys = [], [], []
            for a, b in byte_chunks(batch):
                lo = starts[a]
                sets = shingle_hashes(data[lo : ends[b - 1]], starts[a:b] - lo, ends[a:b] - lo, width)
                sizes += [len(s) for s in sets]
                ids += [(s.sum(dtype=np.uint64), mixed(s ^ STEP).sum(dtype=np.uint64)) for s in sets]
                found = band_keys(sketches(sets, bands * BAND_ROWS), bands).view(np.int64)
                keys += [k if len(s) else k[:0] for k, s in zip(found, sets)]
            ids = np.array(ids, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "keys"],
            )

    return rows.mapInArrow(run, SIGNATURE)


def buckets(spark, classes):
    """``key, member, n``: the members of every bucket with two classes or more.

    Counts are written before they are joined, here and for the centres: both sides of
    the join are then plain shuffles, of which a hot key can be split.
    """
    postings = classes.select(F.col("rep").alias("member"), F.explode("keys").alias("key"))
    counted = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return postings.join(written(spark, counted, "bucket-sizes").hint("merge"), "key")


def chosen_centres(spark, shared):
    """``member, centre, others``: each member with the centre of its bucket; others: whether a third class is there.

    The centre is the member with most partners over all its buckets, of equal ones the smaller id.
    """
    degree = shared.groupBy("member").agg(F.sum("n").alias("degree"))
    ranked = shared.join(degree, "member")
    centre = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("member")).alias("minus"))).alias("best"))
    return (
        shared.join(written(spark, centre, "centres").hint("merge"), "key")
        .select("member", (-F.col("best.minus")).alias("centre"), (F.col("n") > 2).alias("others"))
        .groupBy("member", "centre")
        .agg(F.max("others").alias("others"))
        .where("member <> centre")
    )


VERIFIED = "a long, b long, linked boolean, size long, differ long, difference array<long>"


def verify(spark, pairs, source, width, percent):
    """Compare full sets: ``a, b, linked`` and, where ``others`` is set, a's difference from b.

    ``pairs`` has ``a, b, others``; rows of one ``b`` share a copy of its text for each
    ``SLOT_MEMBERS`` of them.
    """
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SLOT_MEMBERS).cast("int").alias("slots"))
    sizes = written(spark, sizes, "centre-sizes")
    members = pairs.join(sizes, "b").select("b", F.pmod(F.xxhash64("a"), F.col("slots")).cast("int").alias("slot"), "a", "others")
    heads = sizes.select("b", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("b").alias("a"), F.lit(False).alias("others"))
    rows = (
        members.unionByName(heads)
        .join(source.select(F.col("doc_id").alias("a"), "text").hint("merge"), "a")
        .select("b", "slot", (F.col("a") != F.col("b")).alias("is_member"), "a", "others", "text")
        .repartition("b", "slot")
        .sortWithinPartitions("b", "slot", "is_member")
    )

    def packed(out):
        columns = list(zip(*out)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        names = ["a", "b", "linked", "size", "differ", "difference"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    def run(stream):
        centre_id, centre = None, None
        for batch in stream:
            data, starts, ends = byte_view(batch.column("text"))
            ids, centres = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            member, others = batch.column("is_member").to_pylist(), batch.column("others").to_pylist()
            out, held = [], 0
            for a, b in byte_chunks(batch):
                lo = starts[a]
                sets = shingle_hashes(data[lo : ends[b - 1]], starts[a:b] - lo, ends[a:b] - lo, width)
                for i, own in zip(range(a, b), sets):
                    if not member[i]:
                        centre_id, centre = centres[i], own
                        continue
                    if centre_id != centres[i]:
                        raise ValueError("a member came before its centre")
                    at = np.searchsorted(centre, own)
                    known = centre[np.minimum(at, len(centre) - 1)] == own
                    common = int(known.sum())
                    linked = 100 * common >= percent * (len(own) + len(centre) - common)
                    difference = []
                    if others[i]:
                        lost = np.ones(len(centre), bool)
                        lost[at[known]] = False
                        difference = np.concatenate([own[~known], centre[lost]]).view(np.int64)
                    out.append((ids[i], centres[i], linked, len(own), len(own) + len(centre) - 2 * common, difference))
                    held += len(difference)
                    if held >= BATCH_ELEMENTS:
                        yield packed(out)
                        out, held = [], 0
            yield packed(out)

    return rows.mapInArrow(run, VERIFIED)


def meetings(checked, percent):
    """``meeting, path, a, ...``: members that a group of a centre and an element brings together.

    ``checked`` has ``path, label`` beside the columns of ``verify``: the members of a
    path share a centre, those of one label are known to be connected. Only elements that
    may bring a new link are listed, at their ``place`` in the member's whole difference.
    """
    k = (100 - percent) / (100 + percent)
    listed = checked.where("size(difference) > 0").select(
        "path", "a", "label", "linked", F.col("size").alias("own"), "differ", F.size("difference").alias("listed"), F.explode("difference").alias("element")
    ).withColumn("key", F.xxhash64("path", "element"))
    sizes = listed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("linked")).alias("unlinked"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    # What one member has, or only linked or connected ones, brings no link and is in front of the rest; of that the rare comes first.
    meant = sizes.where("n > 1 AND unlinked > 0 AND low <> high").select("key", (F.col("n") * F.col("unlinked")).alias("pairs"))
    member = Window.partitionBy("path", "a")
    before = F.col("listed") - F.count(F.lit(1)).over(member)
    places = listed.drop("element").join(written(checked.sparkSession, meant, "shared-elements").hint("merge"), "key").withColumn(
        "place", before + F.row_number().over(member.orderBy("pairs", "key")) - 1
    )
    # Other unlinked members are met by the shorter prefix; ``meets``: whether a linked one is met.
    most = F.floor(F.lit(100 - percent) * F.col("own") / F.lit(percent)) + 1
    part = F.col("place") < F.col("differ") - F.floor(F.col("differ") * (1 - k) / 2 - 1e-9)
    both = F.when(F.col("linked"), F.array(F.lit(True))).when(part, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    return (
        places.where((F.col("place") < most) & (~F.col("linked") | part))
        .withColumn("meets", F.explode(both))
        .withColumn("meeting", F.xxhash64("key", "meets"))
        .drop("key", "pairs", "listed")
    )


def meeting_sizes(met):
    """``meeting, n`` of the groups that may hold a link between members not known to be connected."""
    sizes = met.groupBy("meeting", "meets").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("linked")).alias("unlinked"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    return sizes.where("unlinked > 0 AND low <> high AND (unlinked < n OR NOT meets)").select("meeting", "n")


def pairs_of_small(met, percent):
    """Pairs of one group that may be linked though one of them is not linked to the centre."""
    k = (100 - percent) / (100 + percent)
    x, y = met.where("NOT linked").alias("x"), met.where("linked OR NOT meets").alias("y")
    shared = F.ceil((F.col("x.differ") + F.col("y.differ") - k * (F.col("x.own") + F.col("y.own"))) / 2 - 1e-9)
    reach = F.least(F.col("x.differ") - F.col("x.place"), F.col("y.differ") - F.col("y.place"))
    return (
        x.join(y, "meeting")
        .where((F.col("x.label") != F.col("y.label")) & (F.col("y.linked") | (F.col("x.a") < F.col("y.a"))))
        .where((100 * F.col("x.own") >= percent * F.col("y.own")) & (100 * F.col("y.own") >= percent * F.col("x.own")))
        .where(reach >= shared)
        .select(F.greatest("x.a", "y.a").alias("a"), F.least("x.a", "y.a").alias("b"))
        .distinct()
        .withColumn("others", F.lit(False))
    )


def next_stars(spark, met):
    """``path, a, b, label``: members of large groups, each with the next centre of its group."""
    free = F.when(~F.col("linked"), F.struct("degree", (-F.col("a")).alias("minus")))
    degree = written(spark, met.groupBy("path", "a").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    ranked = met.join(degree.hint("merge"), ["path", "a"])
    centre = ranked.groupBy("meeting").agg((-F.max(free)["minus"]).alias("b"))
    return (
        met.join(written(spark, centre, "next-centres").hint("merge"), "meeting")
        .where("a <> b")
        .groupBy(F.xxhash64("path", "b").alias("path"), "a", "b")
        .agg(F.min("label").alias("label"))
    )


def missed_links(spark, checked, source, width, percent):
    """Links that connect what the stars of ``checked`` (``path, label`` and the columns of ``verify``) leave apart."""
    links = []
    while True:
        met = written(spark, meetings(checked, percent), "meetings")
        sizes = written(spark, meeting_sizes(met), "meeting-sizes")
        small = met.join(sizes.where(F.col("n") <= SMALL_GROUP).hint("merge"), "meeting", "left_semi")
        links.append(written(spark, verify(spark, pairs_of_small(small, percent), source, width, percent), "verified").where("linked").select("a", "b"))
        large = sizes.where(F.col("n") > SMALL_GROUP)
        if large.isEmpty():
            return links
        stars = written(spark, next_stars(spark, met.join(large.hint("merge"), "meeting", "left_semi")), "stars")
        pairs = stars.select("a", "b", F.lit(True).alias("others")).distinct()
        found = written(spark, verify(spark, pairs, source, width, percent), "verified")
        links.append(found.where("linked").select("a", "b"))
        label = F.when(F.col("linked") & (F.col("label") == F.col("a")), F.col("b")).otherwise(F.col("label"))
        checked = stars.join(found.hint("merge"), ["a", "b"]).withColumn("label", label)
        # A path whose members are all linked to the centre is done.
        apart = written(spark, checked.where("NOT linked").select("path").distinct(), "paths")
        checked = checked.join(apart.hint("merge"), "path", "left_semi")


def near_duplicates(spark, docs, width=5, percent=80, id_column="doc_id", text_column="text"):
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Links join documents whose sets of ``width``-word shingles (ASCII letters in lower
    case, words between ASCII white space) have a similarity of ``percent`` or more. A
    component is named by its smallest id; the row with that id is kept. Null and empty
    texts have an empty set, are linked with nothing and kept. Rows without an id have
    no component and are kept. Repeated rows, and rows of one id, share a component.
    """
    rows = texts(docs, id_column, text_column)
    bands = bands_for(percent / 100)
    signed = written(spark, signatures(rows, width, bands), "signatures")
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    shared = written(spark, buckets(spark, classes), "buckets")
    star = chosen_centres(spark, shared).select(F.col("member").alias("a"), F.col("centre").alias("b"), "others")
    star = written(spark, star, "stars")
    # Texts of the classes in any pair, kept for both rounds.
    involved = star.select("a").unionAll(star.select("b")).distinct().withColumnRenamed("a", "doc_id")
    source = written(spark, rows.join(involved.hint("merge"), "doc_id", "left_semi"), "candidates")
    checked = written(spark, verify(spark, star, source, width, percent), "verified")
    first = checked.withColumn("path", F.col("b")).withColumn("label", F.when(F.col("linked"), F.col("b")).otherwise(F.col("a")))
    links = union_all([checked.where("linked").select("a", "b"), *missed_links(spark, first, source, width, percent)])
    joined = components(spark, links)
    named = (
        classes.select("set_a", "set_b", "rep")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    )
    # Written, so that a set that many documents have can be split in the join.
    named = written(spark, named, "components")
    return (
        signed.drop("keys")
        .join(named, ["set_a", "set_b"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    )


def without_near_duplicates(spark, docs, width=5, percent=80):
    """The rows of ``docs``, all columns as they are, with the smallest id of every component; see ``near_duplicates``."""
    gone = near_duplicates(spark, docs, width, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
