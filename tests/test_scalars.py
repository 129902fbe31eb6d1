from pyspark.sql import functions as F

from conftest import ts
from storytrack.functions import scalars as X


def test_hotness_known_values(spark):
    rows = [(-25, ts("2015-07-02 00:00:00")), (0, ts("2015-07-02 00:00:00")), (1234, ts("2015-07-02 00:00:00"))]
    df = spark.createDataFrame(rows, "score int, created timestamp")
    got = [round(r[0], 7) for r in df.select(X.hotness("score", "created")).collect()]
    assert got == [6704.5397711, 6705.9377111, 6709.0290263]


def test_show_thumbnail_and_ids(spark):
    df = spark.createDataFrame([(None,), ("",), ("default",), ("self",), ("nsfw",), ("http://x",)], "t string")
    got = [r[0] for r in df.select(X.show_thumbnail("t")).collect()]
    assert got == [False, False, False, False, False, True]
    one = spark.createDataFrame([("abc",)], "s string").select(X.full_id("t3", "s")).first()[0]
    assert one == "t3_abc"


def test_display_time_and_offsets(spark):
    df = spark.createDataFrame([(ts("2015-07-02 17:05:00"), ts("2015-07-02 17:00:00"))], "a timestamp, b timestamp")
    r = df.select(X.display_time("a"), X.seconds_between("a", "b"), X.utc_day("a"),
                  X.plus_seconds("b", 61)).first()
    assert r[0] == "7/2/15 12:05 PM"
    assert r[1] == 300.0
    assert r[2] == "2015-07-02"
    assert r[3] == ts("2015-07-02 17:01:01")


def test_epoch_seconds_truncates_fraction(spark):
    df = spark.createDataFrame([(1435795200.9,)], "e double")
    assert df.select(X.epoch_seconds_to_ts("e")).first()[0] == ts("2015-07-02 00:00:00")
