"""Exact dedup by content sort, with DataFrame operations only.

Sampled splitters (Spark's range partitioner) deal the texts out by leading
characters, content hash and slot; each partition is sorted by them and by the
whole text, so equal texts are neighbours, and the window operator compares
neighbouring whole texts to end a group. Splitters stay small: the range key
holds ``HEAD`` characters and two numbers, the whole text only takes part in the
sort within a partition.

A text with many copies would fill one partition. Contents are therefore counted
first (numbers only, combined before the shuffle), and those with more than
``1 / HOT_PARTS`` of an average partition are spread over as many slots as they
need. There are at most ``HOT_PARTS`` times as many such contents as partitions, so
their list is broadcast. Slots of the same content meet again as one row each, by
another comparison of whole texts.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import scratch_path, texts

HEAD = 16
HOT_PARTS = 4


def exact_duplicates(spark, docs, keep="smallest", id_column="doc_id", text_column="text"):
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep`` names which id of equal texts stays: ``smallest`` or ``largest``. Null
    and empty texts are equal. Repeated rows count as copies, exactly one of them is
    kept. A row without an id stays only where no copy has one. Other columns of
    ``docs`` are not read; an empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep}")
    best = F.min if keep == "smallest" else F.max
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    rows = texts(docs, id_column, text_column).withColumn("content", F.xxhash64("text"))
    limit = max(docs.count() / (HOT_PARTS * parts), 1.0)
    hot = (
        rows.groupBy("content")
        .agg(F.count(F.lit(1)).alias("copies"))
        .select("content", F.ceil(F.col("copies") / limit).cast("int").alias("slots"))
        .where("slots > 1")
    )

    dealt = (
        rows.join(F.broadcast(hot), "content", "left")
        .withColumn("slots", F.coalesce("slots", F.lit(1)))
        .withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.col("slots")).cast("int"))
        .withColumn("head", F.substring("text", 1, HEAD))
        .repartitionByRange("head", "content", "slot")
    )
    equal = Window.partitionBy("head", "content", "slot", "text")
    runs = dealt.select(
        "doc_id",
        "content",
        "slots",
        "text",
        best("doc_id").over(equal).alias("slot_keep"),
        F.count(F.lit(1)).over(equal).alias("slot_size"),
        F.row_number().over(equal.orderBy(order)).alias("place"),
    ).select(
        "doc_id",
        "content",
        "slots",
        "slot_keep",
        "slot_size",
        "place",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        # Only the first row of a slot of a spread content carries its text on.
        F.when((F.col("slots") > 1) & (F.col("place") == 1), F.col("text")).alias("text"),
    )
    path = scratch_path(spark, "exact-runs")
    runs.write.parquet(path)
    runs = spark.read.parquet(path)

    whole = runs.where("slots = 1").select(
        "doc_id",
        F.col("slot_keep").alias("keep_id"),
        F.col("slot_size").alias("group_size"),
        (F.col("place") == 1).alias("kept"),
        "text_sha256",
    )
    firsts = runs.where("slots > 1 and place = 1").select("content", "text", "slot_keep", "slot_size")
    groups = firsts.groupBy("content", "text").agg(
        best("slot_keep").alias("keep_id"),
        F.sum("slot_size").alias("group_size"),
        F.collect_set("slot_keep").alias("slot_keeps"),
        F.max(F.col("slot_keep").isNull()).alias("nameless"),
    )
    # One row per slot again; at most one slot of a text has no id at all (its rows share a hash).
    named = groups.select(
        "content", "keep_id", "group_size", F.explode(F.when(F.col("nameless"), F.array_append("slot_keeps", F.lit(None))).otherwise(F.col("slot_keeps"))).alias("slot_keep")
    )
    spread = (
        runs.where("slots > 1").drop("text").alias("r")
        .join(named.alias("g"), (F.col("r.content") == F.col("g.content")) & F.col("r.slot_keep").eqNullSafe(F.col("g.slot_keep")))
        .select(
            "r.doc_id",
            "g.keep_id",
            "g.group_size",
            ((F.col("r.place") == 1) & F.col("r.slot_keep").eqNullSafe(F.col("g.keep_id"))).alias("kept"),
            "r.text_sha256",
        )
    )
    return whole.unionByName(spread)


def without_exact_duplicates(spark, docs, keep="smallest"):
    """The rows of ``docs``, all columns as they are, with one row of every group of equal texts.

    Which one stays, and what null texts, repeated rows and rows without an id come to,
    is as in ``exact_duplicates``.
    """
    found = exact_duplicates(spark, docs, keep).where("kept")
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    kept = found.select(own_id.alias("_id"), F.col("text_sha256").alias("_content"))
    content = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    rows = docs.withColumns({"_id": own_id, "_content": content}).join(kept, ["_id", "_content"], "left_semi")
    # Repeated rows stand together already.
    return rows.dropDuplicates(["_id", "_content"]).drop("_id", "_content")
