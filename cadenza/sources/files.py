"""Scans of the project's own files: WAV, JSON and JSONL, glossaries, directory trees. Sinks beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = "id string, start double, end double, speaker string, text string"
HISTORY = "iteration int, score double, parameters map<string,string>, metrics map<string,double>, status string, error string, from_stage string, duration_s double, timestamp string"


def read_json_list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold an array of objects; extra fields are dropped, a corrupt file fails the read."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per file: path and ``value``, null where the file is corrupt."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.from_json(F.decode("content", "UTF-8"), schema, {"mode": "PERMISSIVE"}).alias("value"))


def read_jsonl(spark: SparkSession, path: str, schema: str = HISTORY) -> DataFrame:
    """Lines that parse; blank and malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a log of JSON lines; a log that is not there yet is empty."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return read_jsonl(spark, path, schema) if there else spark.createDataFrame([], schema)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def best_record(history: DataFrame) -> DataFrame:
    """The record with the best score, the earliest on ties; an aggregate over the log, so no best file can go stale."""
    rec = F.struct(*history.columns)
    return history.where("score is not null").agg(F.max_by(rec, F.struct("score", -F.col("iteration"))).alias("r")).where("r is not null").select("r.*")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, action, replacement from a map of terms or a list under ``entities``; invalid entries are skipped, the last of a
    term wins, a corrupt file holds none. Only ``replace`` keeps a replacement."""
    files = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("c"))
    entry = "struct<action:string,replacement:string>"
    mapped = files.select(F.posexplode(F.from_json("c", f"map<string,{entry}>")).alias("pos", "term", "e")).where("term <> 'entities'")
    listed = files.select(F.from_json("c", "entities array<struct<original:string,replacement:string,action:string>>")["entities"].alias("a"))
    listed = listed.select(F.posexplode("a").alias("pos", "e")).select("pos", F.col("e.original").alias("term"), F.struct("e.action", "e.replacement").alias("e"))
    rows = mapped.select("pos", "term", "e").unionByName(listed).where("term is not null and e.action in ('preserve', 'replace')")
    kept = F.when(F.col("e.action") == "replace", F.col("e.replacement"))
    return rows.groupBy("term").agg(F.max_by(F.struct(F.col("e.action").alias("action"), kept.alias("replacement")), "pos").alias("v")).select("term", "v.*")


def read_profiles(spark: SparkSession, root: str) -> DataFrame:
    """speaker, profile and metadata of a tree ``speaker/profile/metadata.json``; the canonical ``reference.wav`` beside it is
    preferred to the recorded path; profiles without readable metadata are left out."""
    tree = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    at = lambda k: F.element_at(F.split("path", "/"), k)
    meta = tree("metadata.json").select(at(-3).alias("speaker"), at(-2).alias("profile"), F.from_json(F.decode("content", "UTF-8"), "score double, reference_duration_s double, reference string").alias("m"))
    waves = tree("reference.wav").drop("content").select(at(-3).alias("speaker"), at(-2).alias("profile"), F.col("path").alias("wave"))
    rows = meta.where("m is not null and (m.score is not null or m.reference_duration_s is not null or m.reference is not null)").join(waves, ["speaker", "profile"], "left")
    return rows.select("speaker", "profile", "m.score", "m.reference_duration_s", F.coalesce("wave", "m.reference").alias("reference"))


def decode_wave(content: bytes | None) -> tuple[int, list[list[float]]] | None:
    """(rate, channels of floats in [-1, 1]) of PCM WAV bytes; None if they can't be read."""
    import io
    import wave

    import numpy as np

    try:
        with wave.open(io.BytesIO(content)) as w:
            width, n, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
            raw = w.readframes(w.getnframes())
    except Exception:  # noqa: BLE001 - any damage means the same
        return None
    kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}.get(width)
    if kind is None:
        return None
    x = np.frombuffer(raw, dtype=kind).astype(np.float32)
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return rate, [x[c::n].tolist() for c in range(n)]


def read_waves(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, channels (array of float arrays) and mono mean of WAV files; nulls where a file can't be read."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            out = []
            for p, content in zip(b["path"], b["content"], strict=True):
                got = decode_wave(content)
                mono = np.mean(np.array(got[1], dtype=np.float32), axis=0).tolist() if got and got[1] else None
                out.append((p, got[0] if got else None, got[1] if got else None, mono))
            yield pd.DataFrame(out, columns=["path", "rate", "channels", "mono"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, channels array<array<float>>, mono array<float>")


def write_waves(df: DataFrame, folder: str, name: str = "name", samples: str = "samples", rate: str = "rate") -> None:
    """One 16-bit mono WAV per row in a folder that all executors share; samples are clipped to [-1, 1]. Each file is moved
    into place when it is whole, so a task that runs twice leaves the same files."""

    def run(rows) -> None:
        import os
        import uuid
        import wave

        import numpy as np

        os.makedirs(folder, exist_ok=True)
        for r in rows:
            part = f"{folder}/.{uuid.uuid4().hex}"
            with wave.open(part, "wb") as w:
                w.setnchannels(1)
                w.setsampwidth(2)
                w.setframerate(int(r[rate]))
                w.writeframes((np.clip(np.array(r[samples], dtype=np.float64), -1, 1) * 32767).round().astype("<i2").tobytes())
            os.replace(part, f"{folder}/{r[name]}.wav")

    df.select(name, samples, rate).foreachPartition(run)


def tree_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Entry (first folder below the root), files, bytes and last change, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    base = root.rstrip("/").split("/")[-1]
    entry = F.regexp_extract("path", rf"/{base}/([^/]+)", 1)
    return files.groupBy(entry.alias("entry")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("updated_at")).orderBy(F.desc("updated_at"), "entry")


def write_categories(events: DataFrame, path: str) -> None:
    """Typed events as one JSON object of arrays per category folder."""
    events.write.mode("overwrite").partitionBy("category").json(path)


def rewrite_paths(df: DataFrame, old: str, new: str) -> DataFrame:
    """Replace a path prefix in every string of a table, however nested."""

    def fix(c, kind: T.DataType):
        if isinstance(kind, T.StringType):
            return F.when(c.startswith(old), F.concat(F.lit(new), F.substr(c, F.lit(len(old) + 1)))).otherwise(c)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: fix(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda k, v: fix(v, kind.valueType))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[fix(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[fix(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
