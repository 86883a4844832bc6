import random

from pyspark.sql import functions as F

from cadenza.llm.runs import event_runs, repeated_runs
from cadenza.llm.transcripts import clean_turns, pieces, spoken, turn_bounds

LINES = "row_id bigint, workspace_id string, idx bigint, speaker string, start_s double, end_s double, source_text string, avg_logprob double"
PROFILES = "workspace_id string, speaker string, profile_id string, display_name string"
NAMES = {"peylune lomovar": "speaker_02", "peylune": "speaker_02", "ulvsto": "speaker_01"}


def test_runs_match_brute_force(segments):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a = rng.randrange(0, 60) * 100
        rows.append(dict(seg_uid=i, workspace_id=rng.choice("vw"), idx=i, speaker=rng.choice(["speaker_01", "Speaker 1", "speaker_02"]), start_s=a / 1000, end_s=(a + rng.choice([200, 230, 260, 900])) / 1000))
    rows += rows[:40] + [dict(seg_uid=900), dict(seg_uid=901, workspace_id="v", idx=1, speaker="?", start_s=2.0, end_s=1.0)]
    want = set()
    for w in "vw":
        seen = sorted({(round(r["start_s"] * 1000), r["idx"], round(r["end_s"] * 1000), r["speaker"][-1]) for r in rows[:300] if r["workspace_id"] == w})
        run = []
        for e in [*seen, (10**9, 0, 0, "")]:
            if run and e[3] == run[-1][3] and abs((e[2] - e[0]) - (run[-1][2] - run[-1][0])) <= 50 and e[0] - run[-1][2] <= 250:
                run.append(e)
            else:
                if len(run) > 1:
                    want.add((w, run[0][1], run[-1][1], len(run), run[0][0], max(x[2] for x in run)))
                run = [e]
    df = segments(rows).withColumn("run", F.lit("clash")).withColumn("n", F.lit(0))
    for width in (300, 10**6):
        got = {(r.workspace_id, r.first_idx, r.last_idx, r.n, r.start_ms, r.end_ms) for r in repeated_runs(df, bucket_ms=width).collect()}
        assert got == want
    assert event_runs(segments([])).collect() == []


def test_pieces():
    get = lambda t, label=None: pieces(t, label, NAMES)
    assert get("uh, uh, Have you heard it? <noise> Peylune Lomovar: They want it.", "spk1")[1] == [("speaker_01", "Have you heard it?"), ("speaker_02", "They want it.")]
    assert get("Thanks.\n- Ulvsto: Tomorrow hmm, we start.", "SPEAKER_05")[1] == [("speaker_05", "Thanks."), ("speaker_01", "Tomorrow we start.")]
    assert get("SPEAKER 4: Listen to me: it runs late", "?")[1] == [("speaker_04", "Listen to me: it runs late")]
    assert get("00:02:03,852 --> Hello", "ulvsto") == (123852, [("speaker_01", "Hello")])
    assert get("(00:01:59.456) Hello", "Lomovar, Peylune") == (119456, [("speaker_02", "Hello")])
    assert get("[Peylune Lomovar]: Hi", "unknown")[1] == [("speaker_02", "Hi")]
    assert get("(coughs) Er...", "S3")[1] == [] and get(None, "S3") == (None, []) and get("  ", None) == (None, [])
    assert get("word " * 20000, "S3")[1][0][1].count("word") == 20000
    assert spoken("Havia um texto em casa para mim") == "Havia um texto em casa para mim" and spoken("I um think so") == "I think so"


def lines(spark, rows):
    return spark.createDataFrame([(i, *r, -0.1) for i, r in enumerate(rows)], LINES)


def test_turns(spark):
    profiles = spark.createDataFrame([("w", "speaker_01", "p", "Ulvsto Dunn"), ("w", "speaker_02", "p", "Peylune Lomovar"), ("w", "speaker_02", "q", "Peylune Lomovar"), (None, None, None, None)], PROFILES)
    rows = [
        ("w", 0, "speaker_01", 0.0, 1.0, "One two three four five six."), ("w", 1, "ULVSTO", 1.0, 2.0, "three four five six seven."), ("w", 1, "ULVSTO", 1.0, 2.0, "three four five six seven."),
        ("w", 2, "speaker_02", 2.0, 3.0, "[applause]"), ("w", 3, "S1", 3.0, 4.0, "More. Peylune: Answer."), ("w", 5, None, 6.0, 7.0, "Hmm"), ("w", 4, "spk2", None, 6.0, "(00:05) Late start"),
        ("w", 6, "?", 8.0, 9.0, "Who says this"), ("w", 7, "speaker_02", 9.0, None, "Me again"), ("w", 8, "speaker_02", float("nan"), 10.0, None), ("x", None, "speaker_09", None, None, "alone"),
        (None, 1, "Speaker #7", 1.0, 2.0, "no workspace"),
    ]
    got = {tuple(r) for r in turn_bounds(lines(spark, rows).withColumn("piece", F.lit("clash")), profiles).collect()}
    assert got == {("w", "speaker_01", 0, 3), ("w", "speaker_02", 3, 4), ("w", "speaker_02", 7, 7), ("x", "speaker_09", None, None), (None, "speaker_07", 1, 1)}
    text = {(r.workspace_id, r.first_idx): r.text for r in clean_turns(lines(spark, rows), profiles).collect()}
    assert text[("w", 6)] == "Who says this" and text[("w", 0)].startswith("One two three four five six.")


def test_rolling_captions_lose_their_overlap(spark):
    rows = [("w", 0, "S1", 0.0, 1.0, "we start with the old red box"), ("w", 1, "S1", 1.0, 2.0, "with the old red box and then go"), ("w", 2, "S1", 2.0, 3.0, "with the old red box and then go")]
    profiles = spark.createDataFrame([], PROFILES)
    turn = clean_turns(lines(spark, rows), profiles).collect()
    assert [(r.text, r.first_idx, r.last_idx) for r in turn] == [("we start with the old red box and then go", 0, 1)]
    assert turn_bounds(lines(spark, []), profiles).collect() == []
