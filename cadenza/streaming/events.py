"""Structured Streaming counterparts: sessions, sliding windows, interval join, tail of a log. These are extensions of ours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.shared import own_folder


def table_stream(spark: SparkSession, folder: str, name: str, per_trigger: int | None = None) -> DataFrame:
    """A parquet table of a folder, one file or a directory of part files, as a stream of its files; all in one trigger unless ``per_trigger`` is given."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path = f"{folder}/{name}.parque[t]"  # a stream takes a single file only by a pattern
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def timed(events: DataFrame, at: str, late: str | None) -> DataFrame:
    """Rows with their event time ``_at``; without ``late`` there is no watermark, so no row is ever too late (for bounded runs in complete mode)."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp"))
    return rows.withWatermark("_at", late) if late else rows


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """Sessions per key, closed once the watermark has passed their end; later rows are dropped by the watermark."""
    rows = timed(events, at, late)
    return rows.groupBy(key, F.session_window("_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding(events: DataFrame, at: str, value: str, width: str = "1 hour", step: str = "15 minutes", late: str | None = "1 hour") -> DataFrame:
    rows = timed(events, at, late)
    return rows.groupBy(F.window("_at", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms")).select(F.col("w.start").alias("start"), "n", "rms")


def overlapping(left: DataFrame, right: DataFrame, key: str, late: str = "1 hour", longest: str = "1 hour") -> DataFrame:
    """Stream-stream join of intervals (l_start, l_end) and (r_start, r_end) of one key that overlap; state is kept for ``longest``."""
    a, b = left.withWatermark("l_start", late), right.withColumnRenamed(key, "r_key").withWatermark("r_start", late)
    near = F.expr(f"{key} = r_key and r_start >= l_start - interval {longest} and r_start <= l_start + interval {longest}")
    return a.join(b, near & (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))


def run_to_table(stream: DataFrame, name: str, mode: str = "append", each: Callable | None = None) -> DataFrame:
    """Run a stream over all that is there now, into a table in the shared folder with its checkpoint beside it.

    Append mode gives only windows that the watermark has closed; ``complete`` gives those still open at the end too.
    """
    spark = stream.sparkSession
    import uuid

    base = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{base}-state")
    if each or mode != "append":
        writer = writer.foreachBatch(each or (lambda df, _: df.write.mode("overwrite").parquet(base)))
    else:
        writer = writer.format("parquet").option("path", base)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(base)


def tail_log(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New records of a growing folder of JSON lines; malformed ones are skipped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)
