import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import vectors
from cadenza.plans import join_queries


def composite(x, label):
    """The score over all rows, by its definition (silhouette of squared distances)."""
    ks = np.unique(label)
    c = np.array([x[label == i].mean(axis=0) for i in ks])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    a = np.array([d[i][label == label[i]].sum() / max((label == label[i]).sum() - 1, 1) for i in range(len(x))])
    b = np.array([min(d[i][label == j].mean() for j in ks if j != label[i]) for i in range(len(x))])
    spread = [np.sqrt(((x[label == i] - c[i]) ** 2).sum(axis=1)).mean() for i in ks]
    dbi = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(c[i] - c[j]) for j in range(len(ks)) if j != i) for i in range(len(ks))])
    within = sum(((x[label == i] - c[i]) ** 2).sum() for i in ks)
    between = sum((label == i).sum() * ((c[i] - x.mean(axis=0)) ** 2).sum() for i in ks)
    ch = (between / (len(ks) - 1)) / (within / (len(x) - len(ks)))
    return 0.5 * ((b - a) / np.maximum(a, b)).mean() + 0.3 / (1 + dbi) + 0.2 * ch / (ch + 100)


def test_indices_cover_all_vectors_whatever_the_sample_and_the_order(spark):
    rng = np.random.default_rng(3)
    label = np.repeat([0, 1, 2], 40)
    x = np.array([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]])[label] + rng.normal(size=(120, 2))
    want = composite(x, label)
    for rows in (x, x[::-1]):
        df = spark.createDataFrame([(r.tolist(),) for r in rows], "v array<double>")
        got = {r["k"]: r["composite"] for r in vectors.select_k(df, "v", range(3, 4), sample=50).collect()}
        assert got[3] == pytest.approx(want, abs=1e-6)


def test_query_tries_two_to_eight(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(rng.normal(size=3).tolist(),) for _ in range(60)]
    spark.createDataFrame(rows, "embedding array<double>").select(F.col("embedding").cast("array<float>")).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(r["k"] for r in join_queries.clu_select_k(spark, str(tmp_path)).collect()) == list(range(2, 9))
