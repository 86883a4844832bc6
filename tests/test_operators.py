import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from cadenza.operators import intervals, lineage, quality, search, utterances, vectors
from cadenza.operators.plugins import CopyTranslator, translate


def spans(spark, rng, n, names):
    rows = []
    for i in range(n):
        a = rng.randrange(0, 5000)
        rows.append((rng.choice(["k", "l"]), i, a, a + rng.choice([1, 30, 400, 3000])))
    return rows, spark.createDataFrame([*rows, (None, n, 1, 2), ("k", n + 1, None, 3)], f"key string, {names[0]} bigint, {names[1]} bigint, {names[2]} bigint")


def test_overlap_pairs_once_each_for_any_bin_width(spark):
    rng = random.Random(1)
    left, ldf = spans(spark, rng, 60, ("lid", "l_start", "l_end"))
    right, rdf = spans(spark, rng, 60, ("rid", "r_start", "r_end"))
    for closed in (False, True):
        want = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and (a[2] <= b[3] and b[2] <= a[3] if closed else a[2] < b[3] and b[2] < a[3]))
        for width, bins in ((10, 4), (100, 8), (1000, 64)):
            got = sorted((r.lid, r.rid) for r in intervals.overlap_pairs(ldf, rdf, ["key"], width, bins, closed).collect())
            assert got == want


def test_word_speakers(spark):
    turns = spark.createDataFrame([("m", "speaker_01", 0, 28212, 33511), ("m", "speaker_03", 1, 35941, 37493)], "key string, speaker string, turn bigint, r_start bigint, r_end bigint")
    words = spark.createDataFrame([("m", 0, 32200, 32600), ("m", 1, 36000, 36400), ("m", 2, 34400, 34600), ("m", 3, 35000, 35200), ("n", 4, 1, 2)], "key string, word bigint, l_start bigint, l_end bigint")
    got = {r.word: r.speaker for r in intervals.overlap_else_nearest(words, turns, ["key"], "word", "speaker", "turn").collect()}
    assert got == {0: "speaker_01", 1: "speaker_03", 2: "speaker_01", 3: "speaker_03", 4: "speaker_unknown"}
    inside = {r.word: r.speaker for r in intervals.containing(words.withColumn("at", F.col("l_start")), turns, ["key"], "word", "at", "speaker", "turn").collect()}
    assert inside == {0: "speaker_01", 1: "speaker_03", 2: "-1", 3: "-1", 4: "-1"}


def test_utterance_rules():
    word = lambda i, a, b, w="x": (w, a, b, i)
    assert [len(u) for u in utterances.flushed(iter([word(0, 0, 400), word(1, 500, 900), word(2, 1800, 2000)]))] == [2, 1]
    long_ = [word(i, i * 1000, i * 1000 + 900, "end." if i == 11 else "x") for i in range(20)]
    assert [len(u) for u in utterances.flushed(iter(long_))] == [12, 8]
    assert [len(p) for p in utterances.split_long([word(0, 0, 99_000)])] == [1]
    parts = utterances.split_long([word(i, i * 2000, i * 2000 + 1900, "yes," if i == 4 else "x") for i in range(10)])
    assert [len(p) for p in parts] == [5, 5] and [w[3] for p in parts for w in p] == list(range(10))


def test_smoothing_joins_short_runs_to_the_nearer_side():
    spans_ = [(0, 400), (500, 900), (950, 1100), (1600, 2000), (2100, 2500), (2600, 3000)]
    assert utterances.smoothed(["a", "a", "b", "c", "c", "c"], spans_) == ["a", "a", "a", "c", "c", "c"]
    assert utterances.smoothed(["a"], [(0, 10)]) == ["a"] and utterances.smoothed([], []) == []


def test_utterances_stream_through(spark):
    rows = [("w", i, i * 1000, i * 1000 + 900, "x.") for i in range(30)] + [("w", 99, None, 1, "x"), ("w", 98, 60_000, 60_100, None)]
    df = spark.createDataFrame(rows, "workspace_id string, row_id bigint, start bigint, end bigint, text string")
    got = sorted((r.first_id, r.last_id, r.n) for r in utterances.utterances(df, "workspace_id").collect())
    assert got == [(0, 10, 11), (11, 21, 11), (22, 29, 8)]


def test_vector_merge_and_choice(spark):
    rows = [("speaker_01", [1.0, 0.0])] * 3 + [("speaker_02", [1.0, 0.01])] + [("speaker_03", [-1.0, 0.0])]
    df = spark.createDataFrame([*rows, ("speaker_03", None)], "label string, v array<double>")
    got = {r.label: r.target for r in vectors.gated_merge(df, "label", "v", least=2, limit=0.3).collect()}
    assert got == {"speaker_01": "speaker_01", "speaker_02": "speaker_01", "speaker_03": "speaker_03"}
    assert vectors.choose_k([(2, 0.259), (3, 0.341), (4, 0.321)]) == 2 and vectors.choose_k([(2, 0.66), (3, 0.899), (4, 0.61)]) == 3 and vectors.choose_k([(3, 0.5), (4, 0.52)]) == 3
    pairs = {r.label: (r.pairs, round(r.cohesion, 6)) for r in vectors.mean_pair_cosine(spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 2.0]), ("a", [0.0, 0.0]), ("b", [1.0])], "label string, v array<double>"), "label", "v").collect()}
    assert pairs == {"a": (3, 0.0)}


def test_lineage(spark):
    chain = list(itertools.pairwise(lineage.STAGES)) + [("translate", "translate")]
    seeds = spark.createDataFrame([("w", "generate")], "workspace_id string, stage_name string")
    assert {r.stage_name for r in lineage.stale_stages(seeds, chain).collect()} == {"generate", "align", "reconstruct", "mix", "video"}
    assert {r.stage_name for r in lineage.stale_stages(seeds, chain, only_to="align").collect()} == {"generate", "align"}
    refs = spark.createDataFrame([("translate", 5, "output", "t.json", "a"), ("generate", 6, "input", "t.json", "a"), ("generate", 6, "input", "g.json", "")], "stage string, stage_pos int, io string, path string, sha256 string")
    disk = spark.createDataFrame([("t.json", "b"), ("g.json", "x")], "path string, sha256 string")
    assert {r.stage_name for r in lineage.seeds_of_changes(refs, disk, lineage.glob_pattern("g.*")).collect()} == {"generate", "translate"}
    assert {r.stage_name for r in lineage.seeds_of_changes(refs, disk, lineage.glob_pattern("*.json")).collect()} == {"generate"}
    old = spark.createDataFrame([("a",), (None,)], "render_key string")
    assert [(r.render_key, r.reused) for r in lineage.reuse(spark.createDataFrame([("a",), ("b",), (None,)], "render_key string"), old, "render_key").orderBy("render_key").collect()] == [(None, False), ("a", True), ("b", False)]


def test_quality_of_documents(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": None})), (2, "[]"), (3, json.dumps({"a": 1, "b": 2})), (4, None)], "id bigint, payload string")
    got = {(r.id, r.path) for r in quality.key_issues(df, ["id"], "payload", ["a", "b"]).collect()}
    assert got == {(1, "$.b"), (2, "$"), (4, "$")}


def test_search_resumes_and_survives_failures(spark, tmp_path):
    dims = spark.createDataFrame([("a", "float", 0.5, 0.0, 1.0, 0.1), ("b", "int", 3.0, 1.0, 9.0, 1.0), ("c", "flag", 1.0, 0.0, 1.0, 1.0)], search.DIMENSIONS)
    goal = lambda p: 1 - abs(p["a"] - 0.9) - abs(p["b"] - 7) / 10 - (p["c"] != 0)
    log = str(tmp_path / "log")
    rows = sorted(search.search(spark, dims, goal, 3, log, batch=12).collect(), key=lambda r: r.trial)
    assert [r.trial for r in rows] == list(range(36)) and rows[0].source == "baseline" and rows[0].point == {"a": 0.5, "b": 3.0, "c": 1.0}
    assert max(r.score for r in rows) > rows[0].score
    assert all(0 <= r.point["a"] <= 1 and 1 <= r.point["b"] <= 9 and r.point["b"] % 1 == 0 and r.point["c"] in (0, 1) for r in rows)
    trials = spark.createDataFrame(rows, search.TRIALS)
    again = search.proposals(dims, trials, 40, patience=1000).collect()
    assert again == search.proposals(dims, trials.orderBy(F.rand()), 40, patience=1000).collect() and {r.source for r in again} == {"random", "neighbour"}
    assert {r.source for r in search.proposals(dims, trials, 5, patience=0).collect()} == {"random"}
    best = max(rows, key=lambda r: (r.score, -r.trial)).point
    assert all(sum(r.point[k] != best[k] for k in best) == 1 for r in again if r.source == "neighbour")
    capped = search.proposals(dims.where("name <> 'c'"), trials, 40, epsilon=1.0, at_most={"b": "a"}).collect()
    assert all(r.point["b"] <= r.point["a"] for r in capped)

    def bad(point, calls=[]):  # noqa: B006
        calls.append(1)
        raise RuntimeError("CUDA out of memory" if len(calls) == 1 else "broken")

    failed = search.tried([(0, "baseline", {}), (1, "random", {})], bad)
    assert [r[3] for r in failed] == [None, None] and "broken" in failed[0][4]
    assert search.standing(spark.createDataFrame(failed, search.TRIALS)).first() == (2, None, None)
    assert trials.select(search.nearness(F.col("point"), {"a": 0.5, "b": 3.0}, {"a": 1.0, "b": 8.0}).alias("x")).where("x = 1").count() >= 1



def test_translation_pipeline(spark):
    df = spark.createDataFrame([(1, "Você viu Peter Parker", 0.8), (2, "", 1.0)], "seg_uid bigint, source_text string, slot double")
    got = {r.seg_uid: (r.text, r.backend) for r in translate(df, CopyTranslator, "en", "pt", ["Peter Parker"]).collect()}
    assert got[1] == ("Viu Peter Parker", "copy+short") and got[2] == ("", "copy")

    class Broken:
        def candidates(self, *_):
            raise ValueError

    assert {r.backend for r in translate(df, Broken, "en", "fr", []).collect()} == {"passthrough"}


@pytest.mark.parametrize("module", ["cadenza.plans.catalog", "cadenza.streaming.events", "cadenza.sources.files"])
def test_core_does_not_import_the_language_part(module):
    import subprocess
    import sys
    from pathlib import Path

    code = f"import sys, {module}; sys.exit(any(m.startswith('cadenza.llm') for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0


def test_knee_and_wave_rules(spark):
    assert vectors.knee_k([0.1, 0.1, 0.2, 5.0, 9.0], 2, 5) == 3 and vectors.knee_k([], 2, 5) == 2
    df = spark.createDataFrame([(1, None, None, None), (2, 16000, [[0.0]], [0.0] * 16000), (3, 8000, [[0.0], [0.0]], [0.0] * 40000), (4, 16000, [[0.0]], [0.0] * 16000 * 16)], "id int, rate int, channels array<array<double>>, mono array<double>")
    got = sorted((r.id, r.severity, r.path) for r in quality.issues(df, ["id"], quality.wave_rules()).collect())
    assert got == [(1, "error", "$.file"), (2, "error", "$.duration"), (3, "error", "$.channels"), (3, "error", "$.rate"), (4, "warning", "$.duration")]
