"""Lineage of staged work: diffs, reuse, stale sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the stages in order.
STAGES = ["extract", "separate", "diarize", "samples", "transcribe", "translate", "generate", "align", "reconstruct", "mix", "video"]


def reuse(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Current rows with ``reused``: their key exists before. A null key is never reused."""
    known = previous.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct()
    return current.join(known, F.col(key) == F.col("_k"), "left").withColumn("reused", F.col("_k").isNotNull()).drop("_k")


def config_diff(recorded: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Key-wise comparison; a null current value is no override. ``effective`` is the current value, else the recorded one."""
    both = recorded.join(current, keys, "full_outer")
    changed = F.col("current").isNotNull() & ~F.col("recorded").eqNullSafe(F.col("current"))
    return both.select(*keys, "recorded", "current", changed.alias("changed"), F.coalesce("current", "recorded").alias("effective"))


def closure(edges: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """All (stage, stage reached from it or itself) of a graph of stages; self-loops and cycles do no harm."""
    nodes = sorted({x for e in edges for x in e})
    after: dict[str, set[str]] = {n: {b for a, b in edges if a == n} for n in nodes}
    out = []
    for n in nodes:
        seen, todo = {n}, [n]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out += [(n, b) for b in sorted(seen)]
    return out


def stale_stages(seeds: DataFrame, edges: list[tuple[str, str]], key: str = "workspace_id", only_from: str | None = None, only_to: str | None = None) -> DataFrame:
    """Stages to run again per key: the seeds (key, stage_name) and all that follows from them, within the given ends.

    The graph of stages is a constant of the program, so its closure is joined, not iterated.
    """
    pairs = [(a, b) for a, b in closure(edges) if (only_from is None or STAGES.index(b) >= STAGES.index(only_from)) and (only_to is None or STAGES.index(b) <= STAGES.index(only_to))]
    reach = seeds.sparkSession.createDataFrame(pairs, "stage_name string, stale string")
    return seeds.join(F.broadcast(reach), "stage_name").select(key, F.col("stale").alias("stage_name")).distinct()


def changed_inputs(refs: DataFrame, disk: DataFrame) -> DataFrame:
    """(stage, path) of recorded inputs whose digest differs on disk or that are gone; a placeholder '' matches nothing."""
    now = disk.select("path", F.col("sha256").alias("_now"))
    return refs.where("io = 'input'").join(now, "path", "left").where(~F.coalesce(F.col("sha256") == F.col("_now"), F.lit(False))).select("stage", "path")


def producers(refs: DataFrame) -> DataFrame:
    """First stage in order that wrote each path."""
    return refs.where("io = 'output'").groupBy("path").agg(F.min_by("stage", "stage_pos").alias("producer"))


def seeds_of_changes(refs: DataFrame, disk: DataFrame, editable: str) -> DataFrame:
    """Stages a change of files makes stale at first: the consumer, and the producer too unless the path is editable (regex)."""
    changed = changed_inputs(refs, disk).join(producers(refs), "path", "left")
    both = F.when(F.col("path").rlike(editable), F.array("stage")).otherwise(F.array_compact(F.array("stage", "producer")))
    return changed.select(F.explode(both).alias("stage_name")).distinct()


def glob_pattern(glob: str) -> str:
    """Regular expression of a path pattern in which ``*`` crosses directories."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def earliest_stage(rows: DataFrame, key: str, name: str) -> DataFrame:
    position = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage_name"))
    return rows.where(position > 0).groupBy(key).agg(F.min_by("stage_name", position).alias(name))
