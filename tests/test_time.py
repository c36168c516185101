import datetime as dt

from pyspark.sql import functions as F

from cohortlens.functions import age_years, seconds_between, ts_ntz


def test_time_arithmetic_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 1, 0), dt.datetime(2024, 3, 10, 3, 0))],
                                   "a timestamp_ntz, b timestamp_ntz")
        row = df.select(seconds_between(F.col("a"), F.col("b")).alias("s"),
                        seconds_between(F.col("a"), ts_ntz("2024-03-10 03:00:00")).alias("t"),
                        age_years("a", "2025-03-10 00:59:59").alias("age")).first()
        assert row.s == 7200.0 and row.t == 7200.0
        assert row.age == 364 / 365          # whole elapsed days, floored
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
