"""Joins over time intervals, rewritten as equi-joins on time bins.

A join condition on overlap alone is planned as a nested loop. Here each interval is listed under every bin it touches and
only equal (key, bin) pairs meet; a pair is kept in the bin of the later start, so it comes out once. Intervals much longer
than a bin would be listed very often: they are cut at ``max_bins`` bins by a coarser second level, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _binned(df: DataFrame, start: str, end: str, width: int, coarse: int, max_bins: int, level: str) -> DataFrame:
    """Rows under (``_lvl``, ``_bin``): short intervals under fine bins, long ones under coarse bins; both sides list every level that the other may use."""
    span = F.floor(F.col(end) / width) - F.floor(F.col(start) / width)
    long_ = span >= max_bins
    fine = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    rough = F.sequence(F.floor(F.col(start) / coarse), F.floor(F.col(end) / coarse))
    as_bins = lambda kind, bins: F.transform(bins, lambda b: F.struct(F.lit(kind).alias("_lvl"), b.alias("_bin")))
    if level == "left":
        own = F.when(long_, as_bins("ll", rough)).otherwise(as_bins("ss", fine))
        other = F.when(long_, as_bins("ls", rough)).otherwise(as_bins("sl", rough))
    else:
        own = F.when(long_, as_bins("ll", rough)).otherwise(as_bins("ss", fine))
        other = F.when(long_, as_bins("sl", rough)).otherwise(as_bins("ls", rough))
    return df.select("*", F.explode(F.concat(own, other)).alias("_b")).select("*", "_b._lvl", "_b._bin").drop("_b")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], width: int = 10_000, max_bins: int = 64, closed: bool = False) -> DataFrame:
    """All pairs of equal keys whose [l_start, l_end) and [r_start, r_end) overlap, each once; ``closed`` lets touching ones meet.

    ``left`` has l_start and l_end, ``right`` r_start and r_end (integral, no other common names than the keys). Null keys
    and bounds match nothing.
    """
    coarse = width * max_bins
    grow = 1 if closed else 0
    a = _binned(left.where("l_start is not null and l_end >= l_start"), "l_start", "l_end", width, coarse, max_bins, "left")
    b = _binned(right.where("r_start is not null and r_end >= r_start"), "r_start", "r_end", width, coarse, max_bins, "right")
    later = F.greatest("l_start", "r_start")
    bin_of = F.when(F.col("_lvl") == "ss", F.floor(later / width)).otherwise(F.floor(later / coarse))
    meets = (F.col("l_start") < F.col("r_end") + grow) & (F.col("r_start") < F.col("l_end") + grow)
    return a.join(b, [*keys, "_lvl", "_bin"]).where(meets & (F.col("_bin") == bin_of)).drop("_lvl", "_bin")


def overlap() -> Column:
    return F.least("l_end", "r_end") - F.greatest("l_start", "r_start")


def max_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, label: str, order: str, width: int = 10_000, unknown: str | None = "speaker_unknown") -> DataFrame:
    """Each left interval with the label of the right one that overlaps it most (first in ``order`` on ties): left_id, label, overlap.

    The choice is an aggregate, so no left interval's partners have to sit together. Without overlap the label is ``unknown``.
    """
    pairs = overlap_pairs(left.select(*keys, left_id, "l_start", "l_end"), right.select(*keys, label, order, "r_start", "r_end"), keys, width)
    best = pairs.where(overlap() > 0).groupBy(left_id).agg(F.max_by(F.struct(label, overlap().alias("ov")), F.struct(overlap(), -F.col(order))).alias("m"))
    joined = left.select(left_id).join(best, left_id, "left")
    return joined.select(left_id, F.coalesce(F.col("m")[label], F.lit(unknown)).alias(label), F.coalesce(F.col("m.ov"), F.lit(0)).alias("overlap"))


def nearest_neighbours(points: DataFrame, turns: DataFrame, keys: list[str], point_id: str, at: str, label: str, order: str, width: int = 900_000) -> DataFrame:
    """The last turn that ends at or before a point and the first that starts at or after it: point_id, before, after (structs of distance, order, label).

    Points and turn bounds are put in one sequence and filled from both sides, in time buckets with carried state, so a hot
    key is no single task.
    """
    k = [F.col(c) for c in keys]
    none = F.lit(None).cast("struct<t:bigint,o:bigint,l:string>")
    mark = lambda t: F.struct(F.col(t).alias("t"), (-F.col(order) if t == "r_end" else F.col(order)).cast("bigint").alias("o"), F.col(label).cast("string").alias("l"))
    ends = turns.select(*k, F.col("r_end").alias("t"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("pid"), mark("r_end").alias("e"), none.alias("s"))
    starts = turns.select(*k, F.col("r_start").alias("t"), F.lit(2).alias("kind"), F.lit(None).cast("bigint").alias("pid"), none.alias("e"), mark("r_start").alias("s"))
    asked = points.select(*k, F.col(at).alias("t"), F.lit(1).alias("kind"), F.col(point_id).cast("bigint").alias("pid"), none.alias("e"), none.alias("s"))
    rows = ends.unionByName(starts).unionByName(asked).withColumn("_b", F.floor(F.col("t") / width)).repartition(*keys, "_b")
    by_key = Window.partitionBy(*keys).orderBy("_b")
    carry = (
        rows.groupBy(*keys, "_b").agg(F.max("e").alias("me"), F.min("s").alias("ms"))
        .withColumn("ce", F.max("me").over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("cs", F.min("ms").over(by_key.rowsBetween(1, Window.unboundedFollowing)))
        .drop("me", "ms")
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("t", "kind")
    filled = (
        rows.join(carry, [*keys, "_b"])
        .withColumn("be", F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("as", F.min("s").over(inside.rowsBetween(0, Window.unboundedFollowing)))
    )
    return filled.where("kind = 1").select(F.col("pid").alias(point_id), F.coalesce("be", "ce").alias("before"), F.coalesce("as", "cs").alias("after"), F.col("t").alias("_at"))


def overlap_else_nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, label: str, order: str, width: int = 10_000) -> DataFrame:
    """``max_overlap``; where nothing overlaps, the turn whose bounds are nearest to the midpoint (doubled to stay integral)."""
    direct = max_overlap(left, right, keys, left_id, label, order, width, unknown=None)
    rest = direct.where(F.col(label).isNull()).select(left_id)
    mids = left.join(rest, left_id, "left_semi").withColumn("_m", F.floor((F.col("l_start") + F.col("l_end")) / 2).cast("bigint"))
    near = nearest_neighbours(mids, right, keys, left_id, "_m", label, order)
    d_before, d_after = F.col("_at") - F.col("before.t"), F.col("after.t") - F.col("_at")
    pick = (
        F.when(F.col("before").isNull(), F.col("after.l")).when(F.col("after").isNull(), F.col("before.l"))
        .when(d_before < d_after, F.col("before.l")).when(d_after < d_before, F.col("after.l"))
        .otherwise(F.when(-F.col("before.o") <= F.col("after.o"), F.col("before.l")).otherwise(F.col("after.l")))
    )
    chosen = near.select(left_id, pick.alias("_near"))
    return direct.join(chosen, left_id, "left").select(left_id, F.coalesce(F.col(label), F.col("_near"), F.lit("speaker_unknown")).alias(label), (F.col(label).isNotNull()).alias("direct"))


def containing(points: DataFrame, turns: DataFrame, keys: list[str], point_id: str, at: str, label: str, order: str, width: int = 10_000) -> DataFrame:
    """First turn (by ``order``) that contains each point, ends included; -1 is for none: point_id, label."""
    left = points.select(*keys, point_id, F.col(at).alias("l_start"), F.col(at).alias("l_end"))
    pairs = overlap_pairs(left, turns.select(*keys, label, order, "r_start", "r_end"), keys, width, closed=True)
    best = pairs.groupBy(point_id).agg(F.min_by(label, order).alias(label))
    return points.select(point_id).join(best, point_id, "left").select(point_id, F.coalesce(F.col(label).cast("string"), F.lit("-1")).alias(label))


def midpoint_vote(segments: DataFrame, chunks: DataFrame, keys: list[str], segment_id: str, label: str, width: int = 10_000) -> DataFrame:
    """Majority label of the chunks whose midpoint lies in each segment, with its share: segment_id, label, confidence, votes. Ties go to the smaller label."""
    mids = chunks.select(*keys, label, F.floor((F.col("r_start") + F.col("r_end")) / 2).cast("bigint").alias("_m")).select(*keys, label, F.col("_m").alias("r_start"), (F.col("_m") + 1).alias("r_end"))
    pairs = overlap_pairs(segments.select(*keys, segment_id, "l_start", "l_end"), mids, keys, width).where("r_start >= l_start and r_start < l_end")
    counts = pairs.groupBy(segment_id, label).agg(F.count(F.lit(1)).alias("n"))
    votes = counts.groupBy(segment_id).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("winner"), F.max("n").alias("top"), F.sum("n").alias("votes"))
    return segments.select(segment_id).join(votes, segment_id, "left").select(
        segment_id, F.coalesce("winner", F.lit("UNK")).alias(label), F.coalesce(F.col("top") / F.col("votes"), F.lit(0.0)).alias("confidence"), F.coalesce("votes", F.lit(0)).alias("votes")
    )


def frames_outside(frames: DataFrame, spans: DataFrame, keys: list[str], at: str = "t", width: int = 10_000) -> DataFrame:
    """Frames whose time lies in none of the half-open spans (anti range join)."""
    hit = overlap_pairs(frames.select(*keys, F.col(at).alias("l_start"), (F.col(at) + 1).alias("l_end")).distinct(), spans.select(*keys, "r_start", "r_end"), keys, width)
    inside = hit.select(*keys, F.col("l_start").alias(at)).distinct()
    return frames.join(inside, [*keys, at], "left_anti")
