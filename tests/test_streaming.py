import pytest
from pyspark.sql import functions as F

from cadenza.plans.stream_queries import stream_sessions, stream_sliding_rms
from cadenza.streaming import events

HOUR = 3600


@pytest.fixture(params=["file", "parts"])
def folder(spark, tmp_path, request):
    """events.parquet as one file, or as a directory of part files whose times run backwards, hours apart."""
    rows = [(i % 3, 1_700_000_000 + (4 - part) * 5 * HOUR + i * 60, float(i)) for part in range(4) for i in range(6)]
    df = spark.createDataFrame(rows, "user_id bigint, s bigint, value double").select("user_id", F.timestamp_seconds("s").alias("ts"), "value")
    whole = tmp_path / "events.parquet"
    if request.param == "file":
        df.coalesce(1).write.parquet(str(tmp_path / "once"))
        next((tmp_path / "once").glob("part-*.parquet")).rename(whole)
    else:
        for part in range(4):
            df.where(F.col("ts") >= F.timestamp_seconds(F.lit(1_700_000_000 + (4 - part) * 5 * HOUR))).where(
                F.col("ts") < F.timestamp_seconds(F.lit(1_700_000_000 + (5 - part) * 5 * HOUR))
            ).coalesce(1).write.mode("append").parquet(str(whole))
    return str(tmp_path), df


def test_sessions_hold_every_row(spark, folder):
    d, df = folder
    got = sorted(tuple(r) for r in stream_sessions(spark, d).select("user_id", "start", "end", "n").collect())
    w = df.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    assert got == sorted(tuple(r) for r in w.select("user_id", "w.start", "w.end", "n").collect())
    assert sum(r[3] for r in got) == df.count() == 24


def test_sliding_windows_hold_every_row(spark, folder):
    d, df = folder
    got = sorted((r["start"], r["n"], round(r["rms"], 9)) for r in stream_sliding_rms(spark, d).collect())
    w = df.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    assert got == sorted((r["start"], r["n"], round(r["rms"], 9)) for r in w.select("w.start", "n", "rms").collect())
    assert sum(r[1] for r in got) == 4 * df.count()


def test_files_in_several_triggers_lose_nothing(spark, folder):
    d, df = folder
    got = events.run_to_table(events.sessions(events.table_stream(spark, d, "events", 1), "user_id", "ts", late=None), "sessions", "complete")
    assert got.agg(F.sum("n")).first()[0] == df.count()
