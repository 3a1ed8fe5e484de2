import pytest

from pyspark.sql import functions as F

from relinfer.operators import skew
from relinfer.operators.keyed import duplicate_keys, insert_missing, unique

SCHEMA = "seq_id bigint, pos bigint, token int"


def test_rows_are_never_replaced(spark):
    stored = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (None, 0, 7)], SCHEMA)
    new = spark.createDataFrame([(1, 1, 99), (1, 2, 8), (1, 2, 3), (None, 0, 1), (2, 0, 4), (2, 0, 4)], SCHEMA)
    grown = insert_missing(stored, new, ["seq_id", "pos"])
    want = [(1, 0, 5), (1, 1, 6), (None, 0, 7), (1, 2, 3), (2, 0, 4)]
    assert sorted(map(tuple, grown.collect()), key=str) == sorted(want, key=str)
    again = insert_missing(grown, new, ["seq_id", "pos"])
    assert sorted(map(tuple, again.collect()), key=str) == sorted(want, key=str)


def test_repeated_keys_are_found_and_refused(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 0, 6), (2, 0, 7), (None, 1, 1), (None, 1, 2)], SCHEMA)
    assert sorted(map(tuple, duplicate_keys(df, ["seq_id", "pos"]).collect()), key=str) == [(1, 0, 2), (None, 1, 2)]
    with pytest.raises(Exception, match="more than once"):
        unique(df, ["seq_id", "pos"]).collect()
    assert unique(df, ["seq_id", "pos", "token"]).count() == 5
    assert unique(df.where("false"), "seq_id").count() == 0


def test_served_rows_are_spread_in_runs(spark, monkeypatch):
    """Rows that the broadcast of hot keys serves stay together in the shuffle, without their key; the others find theirs."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        monkeypatch.setattr(skew, "HOT_KEYS", 1)
        rows = spark.range(0, 4096, 1, 1).select("id", F.when(F.col("id") >= 4090, F.lit("b")).otherwise(F.lit("a")).alias("word"))
        rows = rows.unionByName(spark.createDataFrame([(5000, None), (5001, "c")], "id bigint, word string"))
        table = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "word string, token int")
        found = skew.lookup_join(rows, table, "word", "left")
        parts = [[r for r in p if r.token == 1] for p in found.rdd.glom().collect()]
        assert sum(map(len, parts)) == 4090 and sum(map(bool, parts)) == 1
        rest = [(r.id, r.word, r.token) for r in found.where("id >= 4090").collect()]
        assert sorted(rest) == [*((i, "b", 2) for i in range(4090, 4096)), (5000, None, 3), (5001, "c", None)]
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
