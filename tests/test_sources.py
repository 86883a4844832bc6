import json
import math

from pyspark.sql import functions as F

from cadenza.sources import files


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_json_scans(spark, tmp_path):
    put(tmp_path / "a" / "t.json", [{"id": "1", "start": 0.0, "end": 1.0, "speaker": "s", "text": "x", "more": 1}])
    assert files.read_json_list(spark, str(tmp_path / "a"), files.SEGMENT).columns == ["id", "start", "end", "speaker", "text"]
    put(tmp_path / "b" / "good.json", {"score": 1.5})
    put(tmp_path / "b" / "bad.json", "{nope")
    got = {r.path.rsplit("/", 1)[1]: r.value and r.value.score for r in files.read_json_tolerant(spark, str(tmp_path / "b"), "score double").collect()}
    assert got == {"good.json": 1.5, "bad.json": None}


def test_history_log(spark, tmp_path):
    put(tmp_path / "h" / "h.jsonl", '{"iteration": 0, "score": 0.5}\n\n{oops\n{"iteration": 1, "score": 0.9}\n{"iteration": 2, "score": null}\n')
    log = files.read_jsonl(spark, str(tmp_path / "h"))
    assert log.where("iteration is not null").count() == 3 and files.best_record(log).first().iteration == 1
    files.append_jsonl(log.where("iteration = 1"), str(tmp_path / "out"))
    files.append_jsonl(log.where("iteration = 0"), str(tmp_path / "out"))
    assert files.read_jsonl(spark, str(tmp_path / "out")).count() == 2
    assert files.best_record(log.where("score is null")).collect() == []


def test_glossary_shapes(spark, tmp_path):
    put(tmp_path / "g" / "1.json", {"Marla Quint": {"action": "preserve", "replacement": "x"}, "bad": {"action": "delete"}})
    put(tmp_path / "g" / "2.json", {"entities": [{"original": "Mars", "replacement": "Marte", "action": "replace"}, {"original": "Mars", "replacement": "M", "action": "replace"}]})
    put(tmp_path / "g" / "3.json", "broken")
    got = {r.term: (r.action, r.replacement) for r in files.read_glossary(spark, str(tmp_path / "g")).collect()}
    assert got == {"Marla Quint": ("preserve", None), "Mars": ("replace", "M")}


def test_profiles_and_sizes(spark, tmp_path):
    put(tmp_path / "s" / "speaker_01" / "primary" / "metadata.json", {"score": 0.5, "reference": "old.wav"})
    put(tmp_path / "s" / "speaker_01" / "primary" / "reference.wav", "x")
    put(tmp_path / "s" / "speaker_02" / "alt" / "metadata.json", {"score": 0.7, "reference": "old.wav"})
    put(tmp_path / "s" / "speaker_03" / "alt" / "metadata.json", "garbage")
    got = {r.speaker: r.reference for r in files.read_profiles(spark, str(tmp_path / "s")).collect()}
    assert set(got) == {"speaker_01", "speaker_02"} and got["speaker_01"].endswith("primary/reference.wav") and got["speaker_02"] == "old.wav"
    assert {r.entry: r.files for r in files.tree_sizes(spark, str(tmp_path / "s")).collect()} == {"speaker_01": 2, "speaker_02": 1, "speaker_03": 1}


def test_wave_round_trip(spark, tmp_path):
    tone = [0.5 * math.sin(i / 5) for i in range(200)] + [2.0]
    files.write_waves(spark.createDataFrame([("a", tone, 16000)], "name string, samples array<double>, rate int"), str(tmp_path / "w"))
    put(tmp_path / "w" / "b.wav", "not audio")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_waves(spark, str(tmp_path / "w")).collect()}
    assert got["b.wav"].rate is None and got["a.wav"].rate == 16000
    assert max(abs(a - b) for a, b in zip(got["a.wav"].mono, [*tone[:-1], 1.0], strict=True)) < 1e-4


def test_rewrite_paths_through_nesting(spark):
    df = spark.createDataFrame([("/tmp/a", ["/tmp/b", "x"], {"k": "/tmp/c"}, ("/tmp/d", 1))], "p string, a array<string>, m map<string,string>, s struct<q:string,n:int>")
    r = files.rewrite_paths(df, "/tmp", "/data").first()
    assert (r.p, r.a, r.m, r.s.q, r.s.n) == ("/data/a", ["/data/b", "x"], {"k": "/data/c"}, "/data/d", 1)


def test_events_by_category(spark, tmp_path):
    files.write_categories(spark.createDataFrame([("laughter", 1.0), ("applause", 2.0)], "category string, start double"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).groupBy("category").agg(F.sum("start")).count() == 2
