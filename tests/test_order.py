import random

from pyspark.sql import functions as F

from millrace.operators.order import numbered


def test_numbers_follow_the_order(spark):
    values = random.Random(0).sample(range(10_000), 500)
    df = spark.createDataFrame([(v, v % 7) for v in values], "v long, k long")
    got = numbered(df, [F.desc("k"), F.asc("v")], "at").collect()
    want = sorted(values, key=lambda v: (-(v % 7), v))
    assert [r.v for r in sorted(got, key=lambda r: r["at"])] == want and sorted(r["at"] for r in got) == list(range(500))
    assert numbered(df.limit(0), [F.asc("v")], "at").count() == 0
