"""Places in a global order against a plain sort."""
from pyspark.sql import functions as F

from linkloom.operators.ordinals import with_place


def test_places_with_and_without_groups(spark):
    rows = [(None if i % 11 == 0 else i % 5, (i * 7919) % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g INT, v INT, i INT").repartition(6)
    got = [r.i for r in with_place(df, ["v", "i"]).orderBy("place").collect()]
    assert got == [i for _, v, i in sorted(rows, key=lambda r: (r[1], r[2]))]
    for r in with_place(df, ["v", "i"], ["g"]).groupBy("g").agg(
            F.sort_array(F.collect_list(F.struct("place", "i"))).alias("x")).collect():
        want = [i for g, v, i in sorted((x for x in rows if x[0] == r.g), key=lambda x: (x[1], x[2]))]
        assert [x.place for x in r.x] == list(range(len(want))) and [x.i for x in r.x] == want


def test_equal_rows_and_empty_tables(spark):
    df = spark.range(500).select(F.lit(1).alias("v"), F.lit("x").alias("g"))
    assert sorted(r.place for r in with_place(df, ["v"], ["g"]).collect()) == list(range(500))
    assert with_place(df.where("v = 2"), ["v"]).count() == 0
