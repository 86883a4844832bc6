"""Ordered-sequence operators that stay distributed inside one hot key.

A plain ``Window.partitionBy(key)`` pulls the whole key into one task. Everything here cuts a key into time buckets
first, runs the ordered logic inside a bucket, and hands state from bucket to bucket through a summary with one row per
(key, bucket). Only that summary is ordered per key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNSPLIT = -(2**62)


ROWS_WITHOUT = 10_000  # width of buckets, in the second order column, of rows without a first


def bucket_of(order: Column, width: int, then: Column | None = None) -> Column:
    """Bucket number of an integral order value; null order values come in buckets before all others, cut by ``then`` if given."""
    rest = F.lit(UNSPLIT) if then is None else F.lit(UNSPLIT) + F.coalesce(F.floor(then / F.lit(ROWS_WITHOUT)).cast("bigint"), F.lit(-(2**60)))
    return F.coalesce(F.floor(order / F.lit(width)).cast("bigint"), rest)


def second(order: list[str]) -> Column | None:
    return F.col(order[1]) if len(order) > 1 else None


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"r_{k}"])
    return cond


def continuous_periods(df: DataFrame, keys: list[str], start: str, end: str, width: int = 900_000) -> DataFrame:
    """Merge the half-open intervals [start, end) (integral, end > start) of each key into maximal periods.

    Output: keys, ``start``, ``end``, ``n`` (intervals in the period), ``prev_end`` (end of the period before, or null).
    Touching intervals are continuous; repeated rows count as often as they occur; null keys form a key of their own;
    rows with a null bound or ``end <= start`` belong to no period. An empty input gives an empty result.

    Inside a (key, bucket) ``session_window`` with the row's own length as its gap merges overlaps. A bucket then needs
    only the greatest end and the start of the last open period of the buckets before it.
    """
    rows = df.where(F.col(end) > F.col(start)).select(*keys, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
    rows = rows.withColumn("_b", bucket_of(F.col("_s"), width)).repartition(*keys, "_b")
    length = F.make_interval(secs=((F.col("_e") - F.col("_s")) / F.lit(1000).cast("decimal(18,6)")).cast("decimal(18,6)"))
    local = (
        rows.groupBy(*keys, "_b", F.session_window(F.timestamp_millis("_s"), length).alias("_w"))
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"))
        .drop("_w")
    )
    by_key = Window.partitionBy(*keys).orderBy("_b")
    before = by_key.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        local.groupBy(*keys, "_b")
        .agg(F.max("_e").alias("_top"), F.max("_s").alias("_last"))
        .withColumn("_carry_end", F.max("_top").over(before))
        .withColumn("_open", F.when(F.col("_carry_end").isNull() | (F.col("_last") > F.col("_carry_end")), F.col("_last")))
        .withColumn("_carry_open", F.max("_open").over(before))
        .select(*[F.col(k).alias(f"r_{k}") for k in [*keys, "_b"]], "_carry_end", "_carry_open")
    )
    joined = local.join(carry, null_safe(local, carry, [*keys, "_b"])).drop(*[f"r_{k}" for k in [*keys, "_b"]])
    inside = Window.partitionBy(*keys, "_b").orderBy("_s")
    flagged = joined.withColumn("_prev", F.greatest(F.lag("_e").over(inside), F.col("_carry_end"))).withColumn(
        "_new", F.col("_prev").isNull() | (F.col("_s") > F.col("_prev"))
    )
    opened = F.max(F.when(F.col("_new"), F.col("_s"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        flagged.withColumn("_from", F.coalesce(opened, F.col("_carry_open")))
        .groupBy(*keys, "_from")
        .agg(F.max("_e").alias("end"), F.sum("_n").alias("n"), F.max(F.when(F.col("_new"), F.col("_prev"))).alias("prev_end"))
        .select(*keys, F.col("_from").alias("start"), "end", "n", "prev_end")
    )


def chunked_runs(
    df: DataFrame, keys: list[str], order: list[str], payload: list[str], same: Callable[[Column, Column], Column], width: int = 900_000
) -> DataFrame:
    """Give each row the order key of the first row of its run, as ``run`` (a struct of the ``order`` columns).

    ``order[0]`` must be integral and is what buckets are cut by, ``order[1]`` numeric and what rows without it are cut by; all ``order`` columns together should be unique within a
    key (equal rows fall next to each other and share their run's fate). ``same(prev, cur)`` gets structs of
    ``order + payload`` and says whether ``cur`` continues the run of ``prev``; null counts as no.
    """
    cols = [*order, *payload]
    rows = df.withColumn("_b", bucket_of(F.col(order[0]), width, second(order))).withColumn("_row", F.struct(*cols)).repartition(*keys, "_b")
    inside = Window.partitionBy(*keys, "_b").orderBy("_row")
    here = F.struct(*order)
    rows = rows.withColumn("_prev", F.lag("_row").over(inside))
    rows = rows.withColumn("_starts", F.when(F.col("_prev").isNotNull(), ~F.coalesce(same(F.col("_prev"), F.col("_row")), F.lit(False))))
    by_key = Window.partitionBy(*keys).orderBy("_b")
    carry = (
        rows.groupBy(*keys, "_b")
        .agg(F.min("_row").alias("_first"), F.max("_row").alias("_last"), F.max(F.when(F.col("_starts"), here)).alias("_inner"))
        .withColumn("_before", F.lag("_last").over(by_key))
        .withColumn("_first_starts", F.col("_before").isNull() | ~F.coalesce(same(F.col("_before"), F.col("_first")), F.lit(False)))
        .withColumn("_opened", F.coalesce("_inner", F.when(F.col("_first_starts"), F.struct(*[F.col("_first")[c].alias(c) for c in order]))))
        .withColumn("_carry", F.last("_opened", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
        .select(*[F.col(k).alias(f"r_{k}") for k in [*keys, "_b"]], "_first_starts", "_carry")
    )
    joined = rows.join(carry, null_safe(rows, carry, [*keys, "_b"])).drop(*[f"r_{k}" for k in [*keys, "_b"]])
    starts = F.coalesce(F.col("_starts"), F.col("_first_starts"))
    opened = F.last(F.when(starts, here), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("run", F.coalesce(opened, F.col("_carry"))).drop("_b", "_row", "_prev", "_starts", "_first_starts", "_carry")


def with_previous(df: DataFrame, keys: list[str], order: list[str], payload: list[str], width: int = 900_000) -> DataFrame:
    """Add ``previous``, the struct of ``order + payload`` of the row before within the key (null for its first row)."""
    rows = df.withColumn("_b", bucket_of(F.col(order[0]), width, second(order))).withColumn("_row", F.struct(*order, *payload)).repartition(*keys, "_b")
    carry = (
        rows.groupBy(*keys, "_b")
        .agg(F.max_by("_row", F.struct(*order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
        .select(*[F.col(k).alias(f"r_{k}") for k in [*keys, "_b"]], "_carry")
    )
    joined = rows.join(carry, null_safe(rows, carry, [*keys, "_b"])).drop(*[f"r_{k}" for k in [*keys, "_b"]])
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return joined.withColumn("previous", F.coalesce(F.lag("_row").over(inside), F.col("_carry"))).drop("_b", "_row", "_carry")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, width: int, included: bool = True) -> DataFrame:
    """Add ``name``, the greatest ``value`` of the rows before in the key (and of the row itself if ``included``); nulls count for nothing."""
    rows = df.withColumn("_b", bucket_of(F.col(order[0]), width, second(order))).withColumn("_x", value).repartition(*keys, "_b")
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(*keys, "_b").agg(F.max("_x").alias("_top")).withColumn("_carry", F.max("_top").over(before))
    carry = carry.select(*[F.col(k).alias(f"r_{k}") for k in [*keys, "_b"]], "_carry")
    joined = rows.join(carry, null_safe(rows, carry, [*keys, "_b"])).drop(*[f"r_{k}" for k in [*keys, "_b"]])
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if included else -1)
    return joined.withColumn(name, F.greatest(F.max("_x").over(inside), F.col("_carry"))).drop("_b", "_x", "_carry")


def ordered_rank(df: DataFrame, keys: list[str], order: list[str], width: int, name: str = "rank", count: str | None = None) -> DataFrame:
    """Position (0, 1, ...) of each row within its key by ``order``, counted bucket by bucket; ``count`` adds the key's size."""
    rows = df.withColumn("_b", bucket_of(F.col(order[0]), width, second(order))).repartition(*keys, "_b")
    by_key = Window.partitionBy(*keys).orderBy("_b")
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    carry = sizes.select(*[F.col(k).alias(f"r_{k}") for k in [*keys, "_b"]], "_before", "_all")
    joined = rows.join(carry, null_safe(rows, carry, [*keys, "_b"])).drop(*[f"r_{k}" for k in [*keys, "_b"]])
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    out = joined.withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
    return (out.withColumn(count, F.col("_all")) if count else out).drop("_b", "_before", "_all")


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], per_key: int, width: int) -> DataFrame:
    """``per_key`` rows of each key, evenly spaced over its order, first and last included; all rows of smaller keys."""
    ranked = ordered_rank(df, keys, order, width, "_r", "_c")
    k, r, n = F.lit(per_key), F.col("_r"), F.col("_c")
    step = F.ceil(r * (k - 1) / F.greatest(n - 1, F.lit(1)))
    hit = F.floor(step * (n - 1) / F.greatest(k - 1, F.lit(1))) == r
    return ranked.where((n <= k) | (hit & (step < k))).drop("_r", "_c")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], width: float) -> DataFrame:
    """Exact quantiles (linear between neighbours) per key, one column per name in ``shares``.

    An exact percentile aggregate holds a group's distinct values in one buffer. Here values are ranked inside buckets of
    ``width`` and only the bucket sizes are ordered per key. Nulls and NaN are left out; keys without values give no row.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_o", F.floor(F.col("_v") / width).cast("bigint"))
    if not keys:
        rows = rows.withColumn("_k", F.lit(0))
    ranked = ordered_rank(rows, keys or ["_k"], ["_o", "_v"], 1, "_r", "_c")
    out = []
    for name, p in shares.items():
        at = F.lit(p) * (F.col("_c") - 1)
        low, high = (F.max(F.when(F.col("_r") == f(at), F.col("_v"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*(keys or ["_k"])).agg(*out).select(*keys, *shares)
