import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from exposure.operators.ordered import carry_last, sorted_ranges

T0 = datetime(2026, 1, 1)
SCHEMA = "k string, ts timestamp, seq long, a int, b struct<x:string,y:array<int>>"


def burst(n):
    """A third of all rows in one hour of one key, many of them at one instant; keys without rows before them, a null key, nulls."""
    r = random.Random(n)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        k = "hot" if hot else r.choice([None, "", *(f"k{j}" for j in range(n // 20))])
        ts = T0 + timedelta(seconds=(i % 2) * r.randint(0, 3599) if hot else r.randint(0, 10**6))
        rows.append((k, ts, i, r.choice([None, None, i]), (str(i), [i]) if r.random() < 0.1 else None))
    return rows


def by_hand(rows, inclusive):
    out, last = {}, {}
    for k, ts, seq, a, b in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        before = last.get(k, (None, None))
        now = (a if a is not None else before[0], b if b is not None else before[1])
        out[seq] = now if inclusive else before
        last[k] = now
    return out


@pytest.mark.parametrize("partitions", [None, 1, 4, 17])
@pytest.mark.parametrize("inclusive", [False, True])
def test_carry_against_one_pass(spark, partitions, inclusive):
    rows = burst(1500)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = carry_last(df, ("k",), ("ts", "seq"), {"last_a": F.col("a"), "last_b": F.col("b")}, inclusive, partitions)
    assert out.columns == [*df.columns, "last_a", "last_b"]
    got = {r.seq: (r.last_a, (r.last_b.x, list(r.last_b.y)) if r.last_b else None) for r in out.collect()}
    assert got == by_hand(rows, inclusive)


def test_small_batches_and_empty_tables(spark):
    rows = burst(300)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = carry_last(spark.createDataFrame(rows, SCHEMA), ("k",), ("ts", "seq"), {"c": F.col("a")}, False, 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.seq: r.c for r in out} == {k: v[0] for k, v in by_hand(rows, False).items()}
    assert carry_last(spark.createDataFrame([], SCHEMA), ("k",), ("ts", "seq"), {"c": F.col("a")}).collect() == []


def test_a_burst_of_one_key_is_many_tasks(spark):
    """A third of the rows in one hour of one key: the largest task has at most four times the rows of the median one."""
    n = 60_000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(T0)).otherwise(F.lit(T0) + F.expr("make_interval(0, 0, 0, 0, 0, id)")).alias("ts"), F.col("id").alias("seq"))
    sizes = sorted(r["count"] for r in sorted_ranges(df, ["k", "ts", "seq"], 24).groupBy("__range").count().collect())
    assert len(sizes) == 24 and sizes[-1] <= 4 * sizes[12]
    out = carry_last(df, ("k",), ("ts", "seq"), {"before": F.col("seq")}, partitions=24)
    hot = out.where("k = 'hot'").agg(F.count("*").alias("n"), F.count(F.when(F.col("seq") - F.col("before") == 3, 1)).alias("good")).first()
    assert (hot.n, hot.good) == (20_000, 19_999)
