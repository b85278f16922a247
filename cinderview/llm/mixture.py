"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets. Sources share ``share`` times all words by weight; a target stops at ``most``
   times its source's words, and what is over is shared again by weight until none is
   above. That is one level for all open sources, found by a few aggregates.
2. Blocks. A source's documents fall into blocks of about ``block_words`` words by a
   hash, and the blocks into a hashed order. The mix takes as many whole passes over
   them as the target holds, then the first blocks of one more pass; of the block that
   the target ends in, documents are taken one by one while they fit, longest first.
3. Splitting tree. The quotas, blocks of each source, are split among the output shards:
   a node halves its shards and draws the left half's blocks of each source from the
   multivariate hypergeometric distribution, so that every shard has its exact number of
   blocks and each source is spread as by drawing without replacement. A round splits
   every node ``LEVELS`` times in a task of its own that holds one number per source.
4. A shard takes its quota of a source as the next blocks in their order, so blocks of
   shards are disjoint within a pass. ``shards_of`` deals the documents out and orders
   each shard by a hash.

Documents are read once; what is shuffled afterwards is one narrow row for each. Running
sums over the blocks and shards of a source go in chunks, so a hot source is many tasks.
Every draw is seeded by its place in the tree and every order is a hash, so reruns agree.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.ordered import carried, spread_join
from .common import written

SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 1 << 16
BLOCK_ROWS = 1 << 16
SHARD_BLOCKS = 64
LEVELS = 6
CHUNK = 4096
SEED = 11
WORD = r"[^\x20\x09-\x0D]+"

SOURCE = ["no_source", "source_name"]


def sized(docs, id_column="doc_id", text_column="text", source_column="source", keep=()):
    """``doc_id, size, key`` and the source of every row, null sources apart; ``keep``: further columns carried along."""
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    source = F.col(f"`{source_column}`").cast("string")
    doc_id = F.col(f"`{id_column}`").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        source.isNull().alias("no_source"),
        F.coalesce(source, F.lit("")).alias("source_name"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(doc_id, text).alias("key"),
        F.struct(F.lit(None).alias("none"), *[F.col(f"`{c}`") for c in keep]).alias("carry"),
    )


def numbered(spark, sources):
    """Sources with ``place``, their number from 0 in code-point order, null last.

    Sorted by range; a part's numbers start behind those of the parts before it.
    """
    parts = sources.repartitionByRange(*SOURCE).withColumn("part", F.spark_partition_id())
    parts = written(spark, parts, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the shuffle.
    starts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy(*SOURCE)
    return parts.withColumn("at", F.row_number().over(within) - 1).join(starts, "part").withColumn("place", F.col("start") + F.col("at")).drop("part", "at", "start")


def cycled(weights):
    """Weight of a source by its number, the weights repeating."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)


def targets(sources, share=SHARE, most=MOST):
    """``sources`` (``words, weight``) with ``target``, the words the mix is to take of each."""
    total = share * (sources.agg(F.sum("words")).first()[0] or 0)
    cap = most * F.col("words")
    level = 0.0
    while True:
        open_ = F.when(cap >= F.col("weight") * level, F.col("weight"))
        closed, weight = sources.agg(F.coalesce(F.sum(F.when(open_.isNull(), cap)), F.lit(0.0)), F.sum(open_)).first()
        if not weight or (total - closed) / weight <= level * (1 + 1e-12):
            break
        level = (total - closed) / weight
    wanted = F.least(cap, F.col("weight") * level) if weight else cap
    return sources.withColumn("target", wanted.cast("double"))


def block_draws(spark, placed):
    """``place, block, passes, cut, number, blocks``: how often each block is drawn whole, and the words drawn of a cut one.

    ``number`` is the block's place in its source's order and ``blocks`` the source's
    number of blocks.
    """
    sums = placed.groupBy("place", "block", "source_size", "target").agg(F.sum("size").alias("words")).where("words > 0")
    sums = sums.withColumn("order", F.xxhash64(F.lit(SEED), "place", "block"))
    sums = written(spark, sums, "blocks")
    counted = sums.groupBy("place").agg(F.count(F.lit(1)).alias("blocks"))
    sums = spread_join(sums, counted, ["place"], ["block"])
    sums = sums.withColumn("chunk", F.pmod("order", F.ceil(F.col("blocks") / CHUNK)))
    run = carried(sums, ["place"], ["chunk"], ["chunk", "order", "block"], total={"upto": F.col("words"), "seen": F.lit(1)})
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - whole * F.col("source_size")
    start = F.col("upto") - F.col("words")
    inside = F.col("upto") <= rest
    return run.select(
        "place",
        "block",
        "blocks",
        (F.col("seen") - 1).alias("number"),
        (whole + inside.cast("long")).alias("passes"),
        F.when(~inside & (start < rest), rest - start).alias("cut"),
    )


def split(counts, low, high, capacity, levels, rng):
    """``[(low, high, counts)]``: shards halved ``levels`` times, blocks of each source drawn for the left half."""
    if high - low == 1 or not levels:
        return [(low, high, counts)]
    middle = (low + high) // 2
    left = rng.multivariate_hypergeometric(counts, capacity(low, middle), method="marginals")
    return split(left, low, middle, capacity, levels - 1, rng) + split(counts - left, middle, high, capacity, levels - 1, rng)


def shard_quotas(spark, quotas, shards, total, seed=SEED):
    """``place, shard, quota``: blocks of each source in each shard, from ``quotas`` (``place, quota``) of ``total`` blocks."""
    base, extra = divmod(total, shards)

    def capacity(low, high):
        return (high - low) * base + min(high, extra) - min(low, extra)

    def round_of(nodes):
        nodes = nodes.sort_values("place")
        low, high = int(nodes["low"].iloc[0]), int(nodes["high"].iloc[0])
        rng = np.random.default_rng([seed, low, high])
        places, out = nodes["place"].to_numpy(), []
        for a, b, own in split(nodes["quota"].to_numpy(np.int64), low, high, capacity, LEVELS, rng):
            has = np.flatnonzero(own)
            out.append(pd.DataFrame({"low": a, "high": b, "place": places[has], "quota": own[has]}))
        return pd.concat(out)

    nodes = quotas.select(F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), "place", F.col("quota").cast("long"))
    for _ in range(math.ceil(math.ceil(math.log2(max(shards, 1))) / LEVELS)):
        nodes = nodes.groupBy("low", "high").applyInPandas(round_of, "low long, high long, place long, quota long")
        nodes = written(spark, nodes, "tree")
    return nodes.select("place", F.col("low").alias("shard"), "quota")


def block_shards(spark, draws, shard_blocks=SHARD_BLOCKS):
    """``place, block, cut, whole_shards, cut_shard``: the shard of every drawing of a block, passes in order."""
    quotas = draws.groupBy("place").agg(F.sum(F.col("passes") + F.col("cut").isNotNull().cast("long")).alias("quota")).where("quota > 0")
    quotas = written(spark, quotas, "quotas")
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    leaves = shard_quotas(spark, quotas, max(1, math.ceil(total / shard_blocks)), total)
    leaves = leaves.withColumn("chunk", F.floor(F.col("shard") / CHUNK))
    leaves = carried(leaves, ["place"], ["chunk"], ["shard"], total={"upto": F.col("quota")})
    drawing = F.explode(F.sequence(F.col("upto") - F.col("quota"), F.col("upto") - 1)).alias("drawing")
    leaves = leaves.select("place", "shard", drawing)
    # The n-th drawing of a source is its block n, counted on over all passes.
    blocks = draws.select("place", "block", "cut", "passes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("turn"), "number", "blocks")
    blocks = blocks.where((F.col("turn") < F.col("passes")) | F.col("cut").isNotNull())
    blocks = blocks.withColumn("drawing", F.col("turn") * F.col("blocks") + F.col("number"))
    dealt = blocks.join(leaves, ["place", "drawing"])
    last = F.col("turn") == F.col("passes")
    return dealt.groupBy("place", "block").agg(
        F.max("cut").alias("cut"),
        F.transform(F.array_sort(F.collect_list(F.when(~last, F.struct("turn", "shard")))), lambda x: x["shard"]).alias("whole_shards"),
        F.max(F.when(last, F.col("shard"))).alias("cut_shard"),
    )


def fitting(sizes, room):
    """Which of the sizes are taken: each in turn while it fits, and the least left out if that comes nearer to ``room``."""
    taken = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes):
        if 0 < size <= room:
            taken[i] = True
            room -= size
    left = np.where(taken | (sizes <= 0), np.inf, sizes)
    if len(sizes) and left.min() < 2 * room:
        taken[left.argmin()] = True
    return taken


def mix(
    spark, docs, weights=(3, 1, 2), share=SHARE, most=MOST, block_words=BLOCK_WORDS, shard_blocks=SHARD_BLOCKS,
    id_column="doc_id", text_column="text", source_column="source", keep=(),
):
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, shards`` and the columns of ``keep``.

    ``size`` counts words (null text: none), ``source_size`` and ``target`` are its
    source's, ``shards`` lists the output shard of every copy the mix takes: none, one
    or more, never beyond ``most`` rounded up. Sources are weighed by ``weights`` in turn,
    by code point, null last. A source whose documents are few and long may miss its
    target by half of a document. Documents without words are never taken. Repeated rows are documents of their own and share
    a block; long texts count whole. An empty table gives no rows.
    """
    rows = written(spark, sized(docs, id_column, text_column, source_column, keep), "sized")
    sources = rows.groupBy(*SOURCE).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    sources = numbered(spark, sources).withColumn("weight", cycled(weights))
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("words") / block_words), F.ceil(F.col("rows") / BLOCK_ROWS))
    sources = targets(written(spark, sources.withColumn("parts", parts), "numbered"), share, most)
    sources = sources.select(*SOURCE, "place", "parts", F.col("words").alias("source_size"), "target")
    placed = spread_join(rows, sources, SOURCE, ["key"])
    placed = written(spark, placed.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "key"), F.col("parts"))), "placed")
    draws = written(spark, block_draws(spark, placed), "draws")
    dealt = written(spark, block_shards(spark, draws, shard_blocks), "dealt")
    drawn = placed.join(dealt, ["place", "block"], "left")
    drawn = written(spark, drawn.select("place", "doc_id", *SOURCE, "size", "key", "carry", "source_size", "target", "cut", "whole_shards", "cut_shard"), "drawn")

    def choose(part):
        part = part.sort_values(["size", "key", "doc_id"], ascending=False, kind="stable")
        part["chosen"] = fitting(part["size"].to_numpy(), float(part["cut"].iloc[0]))
        return part[["doc_id", *SOURCE, "size", "key", "carry", "source_size", "target", "whole_shards", "cut_shard", "chosen"]]

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in drawn.schema.fields if f.name not in ("place", "cut")]
    # A source has one cut block, of ``block_words`` words and a document at most.
    cut = drawn.where("cut IS NOT NULL").groupBy("place").applyInPandas(choose, ", ".join([*fields, "chosen boolean"]))
    whole = drawn.where("cut IS NULL").drop("place", "cut").withColumn("chosen", F.lit(False))
    none = F.array().cast("array<bigint>")
    shards = F.coalesce("whole_shards", none)
    shards = F.when(F.col("size") == 0, none).when(F.col("chosen"), F.concat(shards, F.array("cut_shard"))).otherwise(shards)
    return whole.unionByName(cut).select(
        "doc_id", F.when(~F.col("no_source"), F.col("source_name")).alias("source"), "size", "source_size", "target",
        shards.alias("shards"), "key", *[F.col(f"carry.`{c}`").alias(c) for c in keep],
    )


def shards_of(mixed):
    """The mix itself, one row per copy: partitioned by ``shard``, each shard in a hashed order."""
    copies = mixed.select("*", F.posexplode("shards").alias("copy", "shard")).drop("shards")
    order = F.xxhash64(F.lit(SEED), "shard", "copy", "key", "doc_id")
    return copies.repartition("shard").withColumn("order", order).sortWithinPartitions("shard", "order").drop("order", "key")
