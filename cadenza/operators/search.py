"""Search over parameters as tables: dimensions describe the space, trials are a log, proposals are computed from both.

Chance comes from hashes of (seed, trial, dimension), so a search is resumed from its log alone: there is no generator whose
state would have to be kept, and a batch of proposals can be made, and tried, in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = "name string, kind string, default double, low double, high double, step double"  # kind: float, int or flag
TRIALS = "trial bigint, source string, point map<string,double>, score double, error string"


def chance(seed: int, trial: Column, *what: str) -> Column:
    """Number in [0, 1) that depends on nothing but its arguments."""
    return F.pmod(F.xxhash64(F.lit(seed), trial, *map(F.lit, what)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def fitted(value: Column, d: dict) -> Column:
    """A value of a dimension: inside its bounds; whole for int, 0 or 1 for flag, else to four places."""
    if d["kind"] == "flag":
        return (value >= 0.5).cast("double")
    inside = F.greatest(F.lit(d["low"]), F.least(F.lit(d["high"]), value))
    return F.round(inside, 0 if d["kind"] == "int" else 4)


def drawn(seed: int, trial: Column, d: dict) -> Column:
    """Any point of the dimension's grid, all equally likely."""
    u = chance(seed, trial, d["name"], "draw")
    if d["kind"] == "flag":
        return (u < 0.5).cast("double")
    cells = int(round((d["high"] - d["low"]) / d["step"])) + 1
    return fitted(d["low"] + d["step"] * F.floor(u * cells), d)


def moved(seed: int, trial: Column, d: dict, now: Column) -> Column:
    """A step up or down, two in a quarter of the cases; a step over an edge goes the other way; a flag flips."""
    if d["kind"] == "flag":
        return 1 - now
    far = F.when(chance(seed, trial, d["name"], "far") < 0.25, 2 * d["step"]).otherwise(d["step"])
    step = F.when(chance(seed, trial, d["name"], "way") < 0.5, -far).otherwise(far)
    return fitted(F.when((now + step).between(d["low"], d["high"]), now + step).otherwise(now - step), d)


def standing(trials: DataFrame) -> DataFrame:
    """One row: trials so far, the best point (the earlier on ties; null while nothing has a score), trials since."""
    scored = F.when(F.col("score").isNotNull(), F.struct("score", -F.col("trial")))
    told = trials.agg(F.coalesce(F.max("trial") + 1, F.lit(0)).alias("n"), F.max_by("point", scored).alias("best"), F.max_by("trial", scored).alias("at"))
    return told.select("n", "best", (F.col("n") - 1 - F.col("at")).alias("stale"))


def proposals(dimensions: DataFrame, trials: DataFrame, count: int = 1, seed: int = 1234, epsilon: float = 0.2, patience: int = 8, moves: int = 1, at_most: dict[str, str] | None = None) -> DataFrame:
    """The next ``count`` points to try: trial, source, point.

    Trial 0 has the defaults (``baseline``). Then ``moves`` dimensions of the best point change (``neighbour``), unless
    chance (``epsilon``), ``patience`` trials without a better one or the lack of any score ask for a ``random`` point.
    ``at_most`` names dimensions that may not exceed another one. Dimensions are read on the driver: they are a program's
    parameters. No dimensions give empty points.
    """
    dims = [r.asDict() for r in dimensions.orderBy("name").collect()]
    trial = F.col("trial")
    rows = trials.sparkSession.range(count).withColumnRenamed("id", "_i").join(F.broadcast(standing(trials)))  # one row beside each
    rows = rows.select((F.col("n") + F.col("_i")).alias("trial"), "best", "stale")
    wild = F.col("best").isNull() | (F.col("stale") >= patience) | (chance(seed, trial, "", "wild") < epsilon)
    rows = rows.withColumn("source", F.when(trial == 0, "baseline").when(wild, "random").otherwise("neighbour"))
    order = F.array_sort(F.array(*[F.struct(chance(seed, trial, d["name"], "pick").alias("u"), F.lit(d["name"]).alias("name")) for d in dims]))
    rows = rows.withColumn("picked", F.transform(F.slice(order, 1, moves), lambda x: x["name"]) if dims else F.lit(None).cast("array<string>"))
    value = {}
    for d in dims:
        now = F.coalesce(F.try_element_at("best", F.lit(d["name"])), F.lit(d["default"]))
        near = F.when(F.array_contains("picked", d["name"]), moved(seed, trial, d, now)).otherwise(fitted(now, d))
        value[d["name"]] = F.when(F.col("source") == "baseline", fitted(F.lit(d["default"]), d)).when(F.col("source") == "random", drawn(seed, trial, d)).otherwise(near)
    for small, large in (at_most or {}).items():
        value[small] = F.least(value[small], value[large])
    point = F.create_map(*[c for name, v in value.items() for c in (F.lit(name), v)]) if dims else F.lit(None)
    return rows.select("trial", "source", point.cast("map<string,double>").alias("point"))


def tried(points: Iterable[tuple[int, str, dict]], evaluate: Callable[[dict], float]) -> list[tuple]:
    """Rows of ``TRIALS``. A failing trial has a null score and its error; one out of memory is tried once more."""
    out = []
    for trial, source, point in points:
        score, error = None, None
        for again in (True, False):
            try:
                score, error = float(evaluate(dict(point or {}))), None
            except Exception as e:  # noqa: BLE001 - a trial never ends the search
                error = f"{type(e).__name__}: {e}"
                if again and "out of memory" in error.lower():
                    continue
            break
        out.append((trial, source, point, score, error))
    return out


def search(spark: SparkSession, dimensions: DataFrame, evaluate: Callable[[dict], float], rounds: int, log: str, batch: int = 1, stop_at: float | None = None, **options) -> DataFrame:
    """Go on with the search whose trials are in the folder ``log`` (JSON lines) for ``rounds`` batches; returns all trials.

    Trials are written as soon as their batch is over, so a search that was broken off loses one batch at most.
    """
    from cadenza.sources.files import append_jsonl, read_log

    for _ in range(rounds):
        trials = read_log(spark, log, TRIALS)
        best = trials.agg(F.max("score")).first()[0]
        if stop_at is not None and best is not None and best >= stop_at:
            break
        points = [tuple(r) for r in proposals(dimensions, trials, batch, **options).orderBy("trial").collect()]  # a batch
        append_jsonl(spark.createDataFrame(tried(points, evaluate), TRIALS), log)
    return read_log(spark, log, TRIALS)


def nearness(point: Column, optimum: dict[str, float], scale: dict[str, float]) -> Column:
    """A made-up objective with a known optimum, where it is 1: falls with the mean squared distance in units of ``scale``."""
    off = [F.pow((F.try_element_at(point, F.lit(k)) - v) / scale[k], 2) for k, v in optimum.items()]
    return 1 / (1 + sum(off[1:], off[0]) / len(off))
