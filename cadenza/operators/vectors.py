"""Aggregates and merges over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import arrays
from cadenza.sources.shared import written


def _sums(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Element sums per (label, position). Each task adds up its own rows first, so of a hot label one row a task and position is shuffled."""
    parts = df.select(label, F.posexplode(vector).alias("_i", "_x"))
    return parts.groupBy(label, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_s"))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label: label, centroid, n. Null labels form one label; null vectors are left out; partial sums are taken before the shuffle."""
    rows = df.where(F.col(vector).isNotNull())
    counts = rows.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("n"))
    sums = _sums(rows, label, vector).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_s"))), lambda p: p["_s"]).alias("_v"))
    return sums.join(counts, F.col(label).eqNullSafe(F.col("_l"))).select(label, F.transform("_v", lambda v: v / F.col("n")).alias("centroid"), "n")


def mean_pair_cosine(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean cosine over all pairs of each label, from the length of the sum of unit vectors: no pair is formed.

    Zero vectors count as pairs of cosine 0. Labels with fewer than two vectors are left out.
    """
    units = df.select(label, arrays.unit(F.col(vector)).alias("_u"), (arrays.norm(F.col(vector)) >= 1e-9).alias("_solid"))
    counts = units.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_solid").alias("m"))
    size = _sums(units, label, "_u").groupBy(label).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    joined = size.join(counts, F.col(label).eqNullSafe(F.col("_l"))).where("n >= 2")
    pairs = F.col("n") * (F.col("n") - 1)
    return joined.select(label, (pairs / 2).cast("bigint").alias("pairs"), ((F.col("_q") - F.col("m")) / pairs).alias("cohesion"))


def gated_merge(df: DataFrame, label: str, vector: str, least: int, limit: float, most: int = 2000) -> DataFrame:
    """Small labels (fewer than ``least`` vectors) go to the nearest other label if the cosine distance is under ``limit``.

    Labels are few and their number is checked before the centroids are collected; the greedy order (label by label, a
    merged label is no target any more) needs one pass over them. Output: label, target, distance.
    """
    import numpy as np

    rows = centroids(df, label, vector).orderBy(label).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels")
    names = [r[label] for r in rows]
    m = np.array([r["centroid"] for r in rows], dtype=float)
    out, gone = [], {}
    if rows:
        u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
        far = 1 - u @ u.T
        for i, r in enumerate(rows):
            free = [j for j in range(len(rows)) if j != i and j not in gone]
            j = min(free, key=lambda j: (far[i, j], j), default=None)
            if r["n"] < least and j is not None and far[i, j] < limit:
                gone[i] = j
            out.append((names[i], names[gone.get(i, i)], float(far[i, j]) if j is not None else None))
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"{label} {kind}, target {kind}, distance double")


def select_k(df: DataFrame, vector: str, ks: range, margin: float = 0.15, sample: int = 20_000) -> DataFrame:
    """Clusterings for each k scored by 0.5 silhouette + 0.3 / (1 + Davies-Bouldin) + 0.2 Calinski-Harabasz / (that + 100).

    The k with the best score is chosen, the smallest k unless the best leads by ``margin``: k, composite, chosen. Models
    are fitted on ``sample`` vectors at most, those of the least hashes, whatever the order of the files; every vector is then
    assigned, and all indices are computed over all vectors, from the means of their clusters.
    """
    import numpy as np
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    data = df.select(F.transform(vector, lambda x: x.cast("double")).alias("v")).withColumn("features", array_to_vector("v"))
    fitted = written(data.select("v").orderBy(F.xxhash64("v")).limit(sample), "k-sample").select(array_to_vector("v").alias("features"))
    rows = []
    for k in ks:
        told = KMeans(k=k, seed=7, maxIter=10).fit(fitted).transform(data)
        shape = told.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("features")).alias("c")).collect()
        n, c = {r["prediction"]: r["n"] for r in shape}, {r["prediction"]: r["c"].toArray() for r in shape}
        mean = sum(c[i] * n[i] for i in n) / max(sum(n.values()), 1)
        lit = F.array(*[F.array(*[F.lit(float(x)) for x in c.get(i, [])]).cast("array<double>") for i in range(k)])
        off = arrays.energy(F.zip_with("v", F.get(lit, F.col("prediction")), lambda a, b: a - b))
        spread = {r["prediction"]: (r["d"], r["w"]) for r in told.groupBy("prediction").agg(F.avg(F.sqrt(off)).alias("d"), F.sum(off).alias("w")).collect()}
        total, within = sum(n.values()), sum(w for _, w in spread.values())
        between = sum(n[i] * float(((c[i] - mean) ** 2).sum()) for i in n)
        ch = (between / (k - 1)) / max(within / max(total - k, 1), 1e-12)
        dbi = float(np.mean([max((spread[i][0] + spread[j][0]) / max(np.linalg.norm(c[i] - c[j]), 1e-12) for j in n if j != i) for i in n])) if len(n) > 1 else 0.0
        sil = ClusteringEvaluator().evaluate(told) if len(n) > 1 else 0.0
        rows.append((k, 0.5 * sil + 0.3 / (1 + dbi) + 0.2 * ch / (ch + 100)))
    return df.sparkSession.createDataFrame([(k, s, k == choose_k(rows, margin)) for k, s in rows], "k int, composite double, chosen boolean")


def choose_k(scores: list[tuple[int, float]], margin: float = 0.15) -> int:
    """First best k; the smallest one stays unless the lead is ``margin`` or more."""
    base = min(scores)
    best = max(scores, key=lambda x: (x[1], -x[0]))
    return best[0] if best[1] - base[1] >= margin else base[0]


def knee_k(heights: list[float], low: int, high: int, share: float = 0.05) -> int:
    """Clusters by the gaps between merge heights of a dendrogram: the largest k in [low, high] whose gap is at least ``share`` of the greatest."""
    up = sorted(heights)
    n = len(up) + 1
    gaps = {k: up[n - k] - up[n - k - 1] for k in range(max(low, 2), min(high, n - 1) + 1)}
    top = max(gaps.values(), default=0.0)
    return max((k for k, g in gaps.items() if top > 0 and g >= share * top), default=low)
