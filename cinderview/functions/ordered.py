"""Ordered operators that stay parallel when one key holds most of the rows.

A window partitioned by a key alone puts the whole key into one task. Every
helper here adds a second partitioning column (a chunk of the order, a value
bucket or a salt), works inside those pieces, and joins back one small
summary row per piece.
"""

from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 64
# Spark cuts a window to its first rows before the shuffle up to this many (spark.sql.window.group.limit.threshold).
GROUP_LIMIT = 1000
JOIN_SALTS = 16
# Value buckets keep this many bits of a number after its first, their parts as many more; a part has at most 2**20 values.
LEADING_BITS = 12
REFINED_BITS = 20
# Keys of more rows are counted by value; those of a task's hash table (128 keys) take some 100 MB at ten measures.
SMALL_KEY = 4096


def _cols(names):
    return [F.col(n) for n in names]


def top_n(df, keys, order, n, salt_on, rank="rank", salts=SALTS):
    """The first ``n`` rows per ``keys`` in ``order`` (a list of sort Columns).

    Up to ``GROUP_LIMIT`` rows each task cuts its rows to ``n`` a key before the
    one shuffle. For more there are two passes: per (keys, salt), then per keys
    over at most ``salts * n`` rows. ``order`` must be total for a
    deterministic result.
    """
    outer = Window.partitionBy(*keys).orderBy(*order)
    if n <= GROUP_LIMIT:
        first = df.withColumn(rank, F.row_number().over(outer)).where(F.col(rank) <= n)
        return first.withColumn(rank, F.col(rank).cast("long"))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    first = (
        df.withColumn("_salt", F.pmod(F.xxhash64(*_cols(salt_on)), F.lit(salts)))
        .withColumn("_r", F.row_number().over(inner))
        .where(F.col("_r") <= n)
        .drop("_salt", "_r")
    )
    return first.withColumn(rank, F.row_number().over(outer).cast("long")).where(F.col(rank) <= n)


def carried(df, keys, chunks, order, fill=None, lag=None, total=None):
    """Running columns along ``order`` within ``keys``, chunk by chunk.

    ``chunks`` names columns that form a prefix of the order, so a chunk is a
    contiguous run of rows. Each argument maps a new column name to a Column:

    - ``fill``: last non-null value at or before the row
    - ``lag``: value of the previous row (null on the first row)
    - ``total``: running sum up to and including the row
    """
    fill, lag, total = fill or {}, lag or {}, total or {}
    seq = F.struct(*_cols(order))
    src = df
    for name, expr in {**fill, **lag, **total}.items():
        src = src.withColumn(f"_v_{name}", expr)

    aggs = []
    for name in fill:
        v = F.col(f"_v_{name}")
        aggs.append(F.max_by(v, F.when(v.isNotNull(), seq)).alias(f"_c_{name}"))
    for name in lag:
        aggs.append(F.max_by(F.struct(F.col(f"_v_{name}").alias("v")), seq).alias(f"_c_{name}"))
    for name in total:
        aggs.append(F.sum(f"_v_{name}").alias(f"_c_{name}"))
    summary = src.groupBy(*keys, *chunks).agg(*aggs)

    across = Window.partitionBy(*keys).orderBy(*_cols(chunks))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    for name in fill:
        summary = summary.withColumn(f"_c_{name}", F.last(f"_c_{name}", ignorenulls=True).over(before))
    for name in lag:
        summary = summary.withColumn(f"_c_{name}", F.lag(f"_c_{name}").over(across))
    for name in total:
        summary = summary.withColumn(f"_c_{name}", F.sum(f"_c_{name}").over(before))

    inside = Window.partitionBy(*keys, *chunks).orderBy(*_cols(order))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = src
    for name in fill:
        out = out.withColumn(f"_w_{name}", F.last(f"_v_{name}", ignorenulls=True).over(upto))
    for name in lag:
        out = out.withColumn(f"_w_{name}", F.lag(F.struct(F.col(f"_v_{name}").alias("v"))).over(inside))
    for name in total:
        out = out.withColumn(f"_w_{name}", F.sum(f"_v_{name}").over(upto))

    out = out.join(summary, [*keys, *chunks], "left")
    for name in fill:
        out = out.withColumn(name, F.coalesce(f"_w_{name}", f"_c_{name}"))
    for name in lag:
        out = out.withColumn(name, F.coalesce(f"_w_{name}", f"_c_{name}").getField("v"))
    for name in total:
        out = out.withColumn(
            name, F.coalesce(F.col(f"_w_{name}"), F.lit(0)) + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        )
    dropped = [f"_{p}_{n}" for n in {**fill, **lag, **total} for p in "vwc"]
    return out.drop(*dropped)


def _scaled(value):
    """Exponent of the power of two at or below a value, and how often that power goes into it (1 to 2).

    0, NaN and infinity, which have buckets of their own, count as 1 here.
    """
    size = F.abs(value)
    size = F.when((size > 0) & (size < float("inf")), size).otherwise(F.lit(1.0))
    power = F.floor(F.log2(size)).cast("int")
    times = lambda p: size / F.pow(F.lit(2.0), p.cast("double"))
    # The logarithm may be rounded to the power above or below.
    power = power + F.when(times(power) >= 2, F.lit(1)).when(times(power) < 1, F.lit(-1)).otherwise(F.lit(0))
    return power, times(power)


def value_bucket(value):
    """A bucket number that grows with the value: its sign, power of two and leading bits.

    Shares and other fractions are told apart like large numbers. Infinity is
    past all numbers, NaN past infinity.
    """
    power, part = _scaled(value)
    bits = F.lit(1 << LEADING_BITS)
    # Powers start at -1074.
    number = (power.cast("long") + F.lit(1100)) * bits + F.floor((part - F.lit(1.0)) * bits)
    size = F.when(value == 0, F.lit(0)).when(F.abs(value) == F.lit(float("inf")), F.lit(2**62)).otherwise(number)
    return F.when(F.isnan(value), F.lit(2**63 - 1)).when(value < 0, -size).otherwise(size)


def value_part(value):
    """A number that grows with the values of one bucket: the ``REFINED_BITS`` after its leading ones."""
    _, part = _scaled(value)
    fine = F.floor((part - F.lit(1.0)) * F.lit(1 << (LEADING_BITS + REFINED_BITS)))
    size = F.when((value == 0) | F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(0)).otherwise(fine)
    return F.when(value < 0, -size).otherwise(size)


def order_statistics(df, keys, measures, ranks):
    """Exact order statistics of several measures per key, alike for keys of any size.

    ``measures`` maps a name to a numeric column name; ``ranks`` maps a label
    to a function from the group size (Column) to a 0-based rank (Column).
    Returns ``keys, metric, n`` and one double column per label. Nulls are not
    counted, NaN is larger than any number; a key without values of a measure
    has no row for it. A null in a key is a value like others.

    Keys of up to ``SMALL_KEY`` rows are one sorted array a measure, after one
    shuffle of the rows. The larger ones, at most one in ``SMALL_KEY`` rows, are
    counted by value (:func:`_statistics_of_large_keys`).
    """
    rows = df.select(*keys, *[(F.col(c).cast("double") + F.lit(0.0)).alias(f"_m{i}") for i, c in enumerate(measures.values())])
    # A broadcast of at most one key in SMALL_KEY rows.
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > SMALL_KEY)
    large = F.broadcast(sizes.select(*[F.col(k).alias(f"_large_{k}") for k in keys]))
    is_large = all_of([F.col(k).eqNullSafe(F.col(f"_large_{k}")) for k in keys])
    found = [
        _statistics_of_small_keys(rows.join(large, is_large, "left_anti"), keys, measures, ranks),
        _statistics_of_large_keys(rows.join(large, is_large, "left_semi"), keys, measures, ranks),
    ]
    return union_all(found)


def _statistics_of_small_keys(rows, keys, measures, ranks):
    """Order statistics of keys whose values fit an array; columns ``_m0, _m1, ...`` are the measures."""
    # Rows are shuffled as they are: there are few of a key in one task, and lists of one value are several times a row's size.
    lists = rows.repartition(*keys).groupBy(*keys).agg(*[F.collect_list(f"_m{i}").alias(f"_m{i}") for i in range(len(measures))])
    lists = lists.select(*keys, *[F.sort_array(f"_m{i}").alias(f"_m{i}") for i in range(len(measures))])
    n = lambda i: F.size(f"_m{i}").cast("long")
    entries = F.array(*[
        F.struct(
            F.lit(m).alias("metric"), n(i).alias("n"),
            *[F.get(f"_m{i}", f(n(i)).cast("int")).alias(label) for label, f in ranks.items()],
        )
        for i, m in enumerate(measures)
    ])
    return lists.select(*keys, F.inline(entries)).where(F.col("n") > 0)


def _statistics_of_large_keys(rows, keys, measures, ranks):
    """Order statistics of keys with more values than a task should hold.

    Equal values are counted before the first shuffle. The rank is then found
    in steps: first the value bucket that holds it (from bucket totals), then
    the part of that bucket, then the value inside the part, so no task sees
    all values of a key, however close together they are.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("metric"), F.col(f"_m{i}").alias("value")) for i in range(len(measures))])
    counts = (
        # One struct, so that keys with nulls meet in the joins.
        rows.select(F.struct(*keys).alias("_key"), F.explode(pairs).alias("_p"))
        .select("_key", "_p.metric", "_p.value")
        .where(F.col("value").isNotNull())
        .groupBy("_key", "metric", "value")
        .agg(F.count(F.lit(1)).alias("_cnt"))
        # Never null, so that both uses of the counts below are one plan and one shuffle.
        .withColumn("_bucket", F.coalesce(value_bucket(F.col("value")), F.lit(0)))
    )
    group = ["_key", "metric"]
    across = Window.partitionBy(*group)
    running = across.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        counts.groupBy(*group, "_bucket")
        .agg(F.sum("_cnt").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(running), F.lit(0)))
        .withColumn("n", F.sum("_size").over(across))
    )
    wanted = F.array(
        *[
            F.struct(F.lit(label).alias("label"), (f(F.col("n")).cast("long") - F.col("_before")).alias("rank"))
            for label, f in ranks.items()
        ]
    )
    # Buckets that hold a wanted rank, with those ranks counted from the bucket's start.
    targets = totals.select(
        *group, "_bucket", "n", F.filter(wanted, lambda t: (t["rank"] >= 0) & (t["rank"] < F.col("_size"))).alias("_wanted")
    ).where(F.size("_wanted") > 0)
    hits = F.filter(
        "_wanted", lambda t: (t["rank"] < F.col("_upto")) & (t["rank"] >= F.col("_upto") - F.col("_cnt"))
    )
    inside = counts.join(targets, [*group, "_bucket"]).withColumn("_part", F.coalesce(value_part(F.col("value")), F.lit(0)))
    found = (
        carried(inside, [*group, "_bucket"], ["_part"], ["value"], total={"_upto": F.col("_cnt")})
        .select(*group, "n", "value", F.explode(hits).alias("_hit"))
    )
    name = F.element_at(F.array(*[F.lit(m) for m in measures]), F.col("metric") + 1)
    return (
        found.groupBy(*group)
        .agg(
            F.max("n").alias("n"),
            *[F.max(F.when(F.col("_hit.label") == label, F.col("value"))).alias(label) for label in ranks],
        )
        .withColumn("metric", name)
        .select("_key.*", "metric", "n", *ranks)
    )


def spread_join(many, few, keys, salt_on, how="inner", salts=JOIN_SALTS):
    """Join a table with one row per key, spreading the rows of busy keys over tasks.

    ``few`` must be small next to ``many`` (one row per app, file, run, ...): it
    is repeated once per salt. Larger sides are left to adaptive execution,
    which splits skewed partitions at run time.
    """
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*_cols(salt_on)), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def tail_by_number(df, keys, number, n):
    """Rows whose gap-free ``number`` is among the last ``n`` of the key; no sort."""
    last = df.groupBy(*keys).agg(F.max(number).alias("_last"))
    return spread_join(df, last, keys, [number]).where(F.col(number) > F.col("_last") - n).drop("_last")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def union_all(frames) -> DataFrame:
    """Union by name, pair by pair: the plan stays flat however many parts there are."""
    frames = list(frames)
    while len(frames) > 1:
        pairs = zip_longest(frames[::2], frames[1::2])
        frames = [a if b is None else a.unionByName(b, allowMissingColumns=True) for a, b in pairs]
    return frames[0]
