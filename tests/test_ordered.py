"""The skew-safe helpers against plain windows and brute force."""

import math
import random

from pyspark.sql import Window, functions as F

from cinderview.functions import ordered
from cinderview.operators import stats


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_order_statistics_agree_with_brute_force(spark):
    rng = random.Random(7)
    data = []
    for key, n in (("hot", 4000), ("mid", 101), ("one", 1), ("dup", 50)):
        for _ in range(n):
            v = 5 if key == "dup" else rng.choice([0, 1, 7, rng.randrange(10**4), rng.randrange(10**12)])
            data.append((key, v, None if rng.random() < 0.1 else v // 3))
    df = spark.createDataFrame(data, "k string, a long, b long").repartition(7)
    want = {}
    for key in {d[0] for d in data}:
        for metric, i in (("a", 1), ("b", 2)):
            vs = sorted(d[i] for d in data if d[0] == key and d[i] is not None)
            if vs:
                n = len(vs)
                want[key, metric] = (n, *[float(vs[min(int(q * n), n - 1)]) for q in stats.QUANTILES.values()])
    ranks = {label: stats.nearest_rank(q) for label, q in stats.QUANTILES.items()}
    got = ordered.order_statistics(df, ["k"], {"a": "a", "b": "b"}, ranks).collect()
    assert {(r.k, r.metric): (r.n, *[r[q] for q in stats.QUANTILES]) for r in got} == want


def test_nan_is_larger_than_any_number(spark):
    values = [1.0, 2.0, 3.0, 500.0, float("nan"), float("inf"), float("-inf"), -7.5]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    ranks = {f"r{i}": (lambda n, i=i: F.lit(i)) for i in range(len(values))}
    got = ordered.order_statistics(df, ["k"], {"v": "v"}, ranks).first()
    assert [got[f"r{i}"] for i in range(7)] == [float("-inf"), -7.5, 1.0, 2.0, 3.0, 500.0, float("inf")]
    assert got.r7 != got.r7 and got.n == 8


def test_value_bucket_grows_with_the_value(spark):
    values = sorted({0, 1, 2, 4095, 4096, 4097} | {2**e + d for e in range(3, 60) for d in (-1, 0, 1)})
    values = [-v for v in reversed(values) if v] + values
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r[0] for r in df.select(ordered.value_bucket(F.col("v"))).collect()]
    assert all(a <= b for a, b in zip(got, got[1:]))


def test_fractions_spread_over_buckets_and_their_parts(spark):
    rng = random.Random(5)
    inf = float("inf")
    edges = [0.0, 5e-324, 2.2e-308, 1e-9, 0.1, 0.5, 1 - 2**-53, 1.0, 1 + 2**-52, 1.5, 2 - 2**-52, 2.0, 1.7976931348623157e308, inf]
    values = sorted({s * v for v in edges for s in (1, -1)} | {rng.uniform(-1, 1) for _ in range(4000)} | {1 + rng.random() / 4096 for _ in range(4000)})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = df.select("i", ordered.value_bucket(F.col("v")).alias("b"), ordered.value_part(F.col("v")).alias("p")).orderBy("i").collect()
    keys = [(r.b, r.p) for r in got]
    assert keys == sorted(keys)
    # One bucket holds the values next to 1, and its parts tell them apart.
    buckets, parts = {}, {}
    for r in got:
        buckets[r.b] = buckets.get(r.b, 0) + 1
        parts[r.b, r.p] = parts.get((r.b, r.p), 0) + 1
    assert max(buckets.values()) >= 4000 and max(parts.values()) <= 4
    assert sum(n for b, n in buckets.items() if n > 100) < 4200

    many = df.select(F.lit("k").alias("k"), "v")
    ranks = {f"r{i}": (lambda n, i=i: F.lit(i)) for i in (0, 1, 17, 2000, 4001, 5000, 8000, len(values) - 1)}
    row = ordered.order_statistics(many, ["k"], {"v": "v"}, ranks).first()
    assert [row[r] for r in ranks] == [values[int(r[1:])] for r in ranks]


def test_carried_equals_whole_key_window(spark):
    rng = random.Random(3)
    data = [
        (k, i * 3, rng.choice([None, i]), rng.randrange(9)) for k in ("a", "b") for i in range(500) if rng.random() < 0.8
    ]
    df = spark.createDataFrame(data, "k string, t long, v long, n long").withColumn("chunk", F.floor(F.col("t") / 100))
    w = Window.partitionBy("k").orderBy("t")
    want = df.select(
        "k", "t", F.last("v", True).over(w).alias("f"), F.lag("v").over(w).alias("l"), F.sum("n").over(w).alias("s")
    )
    got = ordered.carried(
        df, ["k"], ["chunk"], ["t"], fill={"f": F.col("v")}, lag={"l": F.col("v")}, total={"s": F.col("n")}
    ).select("k", "t", "f", "l", "s")
    assert rows(got, "k", "t") == rows(want, "k", "t")


def test_top_n_keeps_exactly_the_first_rows(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 37 % 1000).alias("v"))
    got = ordered.top_n(df, ["k"], [F.desc("v"), F.asc("id")], 5, ["id"]).orderBy("k", "rank").collect()
    data = [(i % 2, i, i * 37 % 1000) for i in range(5000)]
    for k in (0, 1):
        want = sorted((d for d in data if d[0] == k), key=lambda d: (-d[2], d[1]))[:5]
        assert [(r.id, r.rank) for r in got if r.k == k] == [(d[1], i + 1) for i, d in enumerate(want)]


def test_top_n_cuts_rows_before_its_one_shuffle(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), "id")
    plan = ordered.top_n(df, ["k"], [F.desc("id")], 5, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("WindowGroupLimit") == 2
    # More rows than Spark's limit on windows takes: by salts.
    many = ordered.top_n(df, ["k"], [F.desc("id")], 1200, ["id"]).where("k = 1").orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in many] == [(2999 - 2 * i, i + 1) for i in range(1200)]


def test_small_keys_are_shuffled_as_rows_not_as_lists(spark):
    df = spark.range(900).select((F.col("id") % 300).alias("k"), (F.col("id") * 7).alias("v"))
    found = ordered.order_statistics(df, ["k"], {"m": "v"}, {"last": lambda n: n - 1})
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert not [line for line in shuffles if "collect_list" in line]
    assert {(r.k, r.n, r["last"]) for r in found.collect()} == {(k, 3, (k + 600) * 7.0) for k in range(300)}


def test_tail_by_number(spark):
    df = spark.range(100).select(F.lit("f").alias("f"), F.col("id").alias("n"))
    assert [r.n for r in ordered.tail_by_number(df, ["f"], "n", 3).orderBy("n").collect()] == [97, 98, 99]


def test_approximate_quantiles_stay_within_their_error(spark):
    df = spark.range(10000).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    got = stats.approx_quantiles(df, ["k"], {"m": "v"}).first()
    for label, q in stats.QUANTILES.items():
        assert abs(got[label] - q * 10000) <= 10


def test_spread_join_equals_join(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    few = spark.createDataFrame([("hot", 1), ("950", 2), ("none", 3)], "k string, x int")
    for how in ("inner", "left", "left_semi"):
        got = ordered.spread_join(many, few, ["k"], ["id"], how)
        assert rows(got, "id") == rows(many.join(few, ["k"], how), "id")


def test_order_statistics_of_keys_with_nulls_and_of_any_size(spark):
    rng = random.Random(11)
    data = []
    for key, sub, n in (("large", 1, 6000), (None, 2, 5000), ("large", None, 4097), ("edge", 1, 4096), (None, None, 30), ("empty", 1, 3)):
        for _ in range(n):
            v = None if key == "empty" or rng.random() < 0.1 else rng.choice([-0.0, 0.0, 2.0**29, 2.0**29 + 1, rng.uniform(-9, 9), float(rng.randrange(10**6))])
            data.append((key, sub, v))
    df = spark.createDataFrame(data, "k string, s int, v double").repartition(5)
    ranks = {label: stats.nearest_rank(q) for label, q in stats.QUANTILES.items()}
    want = {}
    for k, s in {d[:2] for d in data}:
        vs = sorted(v for a, b, v in data if (a, b) == (k, s) and v is not None)
        if vs:
            want[k, s] = (len(vs), *[vs[min(int(q * len(vs)), len(vs) - 1)] for q in stats.QUANTILES.values()])
    got = ordered.order_statistics(df, ["k", "s"], {"v": "v"}, ranks).collect()
    assert {(r.k, r.s): (r.n, *[r[q] for q in stats.QUANTILES]) for r in got} == want and len(got) == 5


def test_small_keys_are_shuffled_once_without_a_row_per_measure(spark):
    df = spark.range(1000).selectExpr("id % 100 AS k", "id AS a", "id + 1 AS b")
    got = ordered.order_statistics(df, ["k"], {"a": "a", "b": "b"}, {"max": lambda n: n - 1})
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # The sizes, the rows; keys of more rows there are none, so their part is gone.
    assert final.count("Exchange hashpartitioning") <= 2 and "explode" not in final


def test_parts_grow_with_the_value_at_every_power_of_two(spark):
    around = [v for e in range(-1073, 1023) for v in (math.nextafter(2.0**e, 0), 2.0**e, math.nextafter(2.0**e, math.inf), 2.0**e * (1 + 2**-20))]
    values = sorted({s * v for v in around for s in (1, -1)})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = df.select("i", ordered.value_bucket(F.col("v")).alias("b"), ordered.value_part(F.col("v")).alias("p")).orderBy("i").collect()
    keys = [(r.b, r.p) for r in got]
    assert keys == sorted(keys)
