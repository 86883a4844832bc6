import random
from collections import defaultdict

from pyspark.sql import functions as F

from cadenza.operators.sequences import chunked_runs, continuous_periods, evenly_spaced, exact_quantiles, ordered_rank, with_previous
from cadenza.operators.timelines import periods_and_gaps


def brute(rows):
    groups = defaultdict(list)
    for k, a, b in rows:
        if a is not None and b is not None and b > a:
            groups[k].append((a, b))
    out = []
    for k, spans in groups.items():
        spans.sort()
        start, end, n, before = *spans[0], 1, None
        for a, b in spans[1:]:
            if a <= end:
                end, n = max(end, b), n + 1
            else:
                out.append((k, start, end, n, before))
                start, before, end, n = a, end, b, 1
        out.append((k, start, end, n, before))
    return sorted(out, key=str)


def test_periods_match_brute_force_over_bucket_borders(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(700):
        a = rng.randrange(0, 40_000)
        rows.append((rng.choice(["a", "b", None]), a, a + rng.choice([0, -5, 1, 40, 300, 9_000])))
    rows += [("a", None, 5), ("a", 5, None), ("a", 100, 200), ("a", 100, 200)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint").withColumn("start", F.lit("clash")).withColumn("_b", F.lit(1))
    for width in (500, 7_000, 10**9):
        got = [tuple(r) for r in continuous_periods(df, ["k"], "s", "e", width).select("k", "start", "end", "n", "prev_end").collect()]
        assert sorted(got, key=str) == brute(rows)


def test_found_rows(segments):
    rows = [
        dict(seg_uid=1, workspace_id="w", idx=0, speaker="speaker_01", start_s=0.0, end_s=1.0), dict(seg_uid=2, workspace_id="w", idx=1, speaker=" Speaker 1 ", start_s=1.0, end_s=2.5),
        dict(seg_uid=2, workspace_id="w", idx=1, speaker=" Speaker 1 ", start_s=1.0, end_s=2.5), dict(seg_uid=3, workspace_id="w", idx=2, speaker="SPEAKER-01", start_s=4.0, end_s=5.0),
        dict(seg_uid=4, workspace_id="w", idx=3, speaker="  ", start_s=2.0, end_s=9.0), dict(seg_uid=5, workspace_id="w", idx=4, speaker="speaker_01", start_s=3.0, end_s=3.0),
        dict(seg_uid=6, workspace_id="w", idx=5, speaker="speaker_01", start_s=None, end_s=3.0), dict(seg_uid=7, workspace_id="w", idx=6, speaker="speaker_02", start_s=float("nan"), end_s=3.0),
        dict(seg_uid=8, workspace_id=None, idx=None, speaker="speaker_03", start_s=1.0, end_s=2.0), dict(),
    ]
    got = {tuple(r) for r in periods_and_gaps(segments(rows)).collect()}
    assert got == {("w", "speaker_01", "merged", 0, 2500), ("w", "speaker_01", "gap", 2500, 4000)}


def test_empty(segments):
    assert periods_and_gaps(segments([])).collect() == []


def test_runs_previous_and_ranks_do_not_depend_on_buckets(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), rng.randrange(0, 900), i, rng.choice([1, 1, 2])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t bigint, i bigint, v int")
    want_prev, want_run, rank = {}, {}, {}
    for k in "xy":
        last, run = None, None
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))):
            want_prev[r[2]] = last[2] if last else None
            run = run if last and last[3] == r[3] else r[2]
            want_run[r[2]], rank[r[2]], last = run, n, r
    for width in (10, 137, 10**6):
        assert {r.i: r.p for r in with_previous(df, ["k"], ["t", "i"], ["v"], width).select("i", F.col("previous.i").alias("p")).collect()} == want_prev
        assert {r.i: r.p for r in chunked_runs(df, ["k"], ["t", "i"], ["v"], lambda p, c: p["v"] == c["v"], width).select("i", F.col("run.i").alias("p")).collect()} == want_run
        assert {r.i: r.rank for r in ordered_rank(df, ["k"], ["t", "i"], width).collect()} == rank
    picked = evenly_spaced(df, ["k"], ["t", "i"], 5, 100).collect()
    assert sum(r.k == "x" for r in picked) == 5 and sum(r.k == "y" for r in picked) == 5


def test_exact_quantiles(spark):
    import numpy as np

    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([rng.random() * 10, -3.0, 4.5])) for _ in range(301)]
    df = spark.createDataFrame([*rows, ("a", None), ("a", float("nan")), ("c", None)], "k string, v double")
    for width in (0.1, 100.0):
        got = {r.k: (r.lo, r.mid) for r in exact_quantiles(df, ["k"], "v", {"lo": 0.05, "mid": 0.5}, width).collect()}
        for k in "ab":
            assert np.allclose(got[k], np.quantile([v for x, v in rows if x == k], [0.05, 0.5]))
        assert set(got) == {"a", "b"}
    assert exact_quantiles(df.limit(0), [], "v", {"p": 0.5}, 1.0).collect() == []
