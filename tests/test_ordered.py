import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from adatlas.functions.ordered import in_order


@pytest.mark.parametrize("key", ["most of them", "all of them"])
def test_equals_windows_on_hot_keys(spark, key):
    """Many parts, ties that go on from part to part, null keys and null order."""
    rng = random.Random(key)
    keys = ["a"] * 8 + ["b", "c", None] if key == "most of them" else ["a"]
    df = spark.createDataFrame([(rng.choice(keys), rng.choice([None, 1, 2, 2, 2, 3]), k, "x") for k in range(400)], "k string, o int, v int, n string")
    before = {c: spark.conf.get(c, None) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 13)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        got = in_order(df, ["k"], [(F.col("o"), False)], [(F.col("v"), True)], number="n", rank="r", lag={"p": "v"}, lead={"q": "v"}, most={"m": "v"}).select("k", "o", "v", "n", "r", "p", "q", "m").collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v) if v is not None else spark.conf.unset(c)
    w = W.partitionBy("k").orderBy("o", F.desc("v"))
    want = df.select("k", "o", "v", F.row_number().over(w), F.rank().over(W.partitionBy("k").orderBy("o")), F.lag("v").over(w), F.lead("v").over(w), F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert in_order(df.limit(0), ["k"], [(F.col("o"), False)], number="m", rank="r").count() == 0
