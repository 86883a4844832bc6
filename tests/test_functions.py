import time

import pytest
from pyspark.sql import functions as F

from cadenza.functions import arrays, scores, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("said", "lang", "n"),
    [("hello world", "en", 3), ("make", "en", 1), ("table", "en", 2), ("你好世界", "zh", 4), ("  ", "en", 0), (None, "en", 0), ("olá mundo", "pt-BR", 4), ("ニ a", "ja", 2)],
)
def test_syllables(spark, said, lang, n):
    assert one(spark, text.syllables(F.lit(said).cast("string"), F.lit(lang))) == n


def test_duration_of_blank_and_rate(spark):
    assert one(spark, text.duration(F.lit(" "), F.lit("en"))) == 0.0
    assert one(spark, text.duration(F.lit("hello world"), F.lit("en"), F.lit(3.0))) == pytest.approx(1.0)
    assert one(spark, text.duration(F.lit("hello."), F.lit("xx"))) == pytest.approx(2 / (4.6 * 1.25) * 1.3)  # the pause is capped


@pytest.mark.parametrize(
    ("said", "want"),
    [("initially initially initially", "initially"), ("that that", "that that"), ("a  b\tc", "a b c"), ("No no NO yes yes", "No yes yes"), ("It's very in Auf �ative. Oh, that's true", "It's very in Oh, that's true")],
)
def test_clean_transcript(spark, said, want):
    assert one(spark, text.clean_transcript(F.lit(said))) == want


def test_clean_transcript_of_a_long_text(spark):
    """In proportion to the tokens: four hundred of them took a minute while each token split the text again."""
    said, want = "one two Two TWO x� �y four " * 60, "one two four " * 60
    df = spark.createDataFrame([(said,)], "t string")  # parts of a literal would be computed beforehand
    began = time.monotonic()
    assert df.select(text.clean_transcript(F.col("t"))).first()[0] == want.strip()
    assert time.monotonic() - began < 15


@pytest.mark.parametrize(("said", "lang", "want"), [("Você está aqui", "pt", "Está aqui"), ("Bem, estou aqui", "pt", "Estou aqui"), ("Bem, olha, eu sei", "pt-BR", "Sei"), ("Aqueça Marte.", "pt", None), ("I am", "en", None)])
def test_condense(spark, said, lang, want):
    assert one(spark, text.condense(F.lit(said), F.lit(lang))) == want


def test_protect_longest_first_and_restore(spark):
    terms = ["Parker", "Peter Parker"]
    guarded = text.protect(F.lit("peter parker met Parker"), terms)
    assert one(spark, guarded) == "__ENT_1__ met __ENT_0__"
    assert one(spark, text.restore(guarded, terms)) == "Peter Parker met Parker"


def test_names_and_clock(spark):
    assert one(spark, text.slug(F.lit("--My Clip (1).mp4"))) == "my-clip-1-mp4"
    assert one(spark, text.clock(F.lit(3723.456))) == "01:02:03.46"
    assert one(spark, text.is_vocal_event(F.lit("[Sigh]"))) and not one(spark, text.is_vocal_event(F.lit("a sigh")))


@pytest.mark.parametrize(("now", "target", "want"), [(0.78, 0.70, False), (7.5, 6.0, True), (30.2, 30.0, False), (1.11, 1.0, False), (1.20, 1.0, True), (5.20, 6.28, False), (1.0, 4.0, True), (4.6, 4.0, True), (1.0, 0.0, False)])
def test_needs_correction(spark, now, target, want):
    assert one(spark, scores.needs_correction(F.lit(now), F.lit(target))) is want


@pytest.mark.parametrize(("m", "slot", "now", "low", "high"), [(4.0, 4.5, 1.0, None, None), (6.0, 4.5, 1.0, 1.30, 1.35), (12.0, 4.0, 1.0, 1.35, 1.35), (6.0, 4.0, 1.35, None, None), (6.0, 0.0, 1.0, None, None)])
def test_next_speed(spark, m, slot, now, low, high):
    got = one(spark, scores.next_speed(F.lit(m), F.lit(slot), F.lit(now)))
    assert got is None if low is None else low <= got <= high


def test_relative_and_nulls(spark):
    null = F.lit(None).cast("double")
    assert one(spark, scores.relative(null, F.lit(4.0), 0.85, 1.15)) == 1.0
    assert one(spark, scores.relative(F.lit(8.0), F.lit(4.0), 0.85, 1.15)) == 1.15
    assert one(spark, scores.relative(F.lit(1.0), F.lit(0.1), 0.70, 1.40)) == 1.40
    assert one(spark, scores.clamp(null)) is None and one(spark, scores.low_confidence(null)) is False
    assert one(spark, scores.falsy(F.lit(0.0), null, F.lit(2.0))) == 2.0
    assert one(spark, scores.fit_speed(F.lit(6.0), F.lit(4.0))) == 1.35


def test_arrays(spark):
    a = F.array(*[F.lit(x) for x in (3.0, 4.0)])
    zero = F.array(F.lit(0.0), F.lit(0.0))
    none = F.array().cast("array<double>")
    assert one(spark, arrays.norm(a)) == 5.0 and one(spark, arrays.cosine(a, zero)) == 0.0 and one(spark, arrays.rms(none)) == 0.0
    assert one(spark, arrays.unit(a)) == [0.6, 0.8] and one(spark, arrays.unit(zero)) == [0.0, 0.0]
    assert one(spark, arrays.stretched(F.array(F.lit(0.0), F.lit(1.0)), 3)) == [0.0, 0.5, 1.0]
    assert one(spark, arrays.padded(a, 3)) == [3.0, 4.0, 0.0] and one(spark, arrays.padded(a, 1)) == [3.0]
    ones, zeros = (F.array_repeat(F.lit(x), 4) for x in (1.0, 0.0))
    assert one(spark, arrays.crossfaded(ones, zeros, 3)) == [1.0, 1.0, 0.5, 0.0, 0.0]
    assert one(spark, arrays.snr(a)) == 0.0 and one(spark, arrays.snr(F.array(*[F.lit(float(x)) for x in (0, 0, 1, 1, 1)]))) == 60.0


def test_composite_skips_nulls(spark):
    df = spark.createDataFrame([(1, 1.0, None, 0.0), (2, None, None, None)], "id int, a double, b double, c double")
    got = {r.id: r.x for r in df.select("id", scores.weighted_mean({"a": 0.5, "b": 0.3, "c": 0.5}).alias("x")).collect()}
    assert got == {1: 0.5, 2: None}
    assert one(spark, scores.duration_ratio(F.lit(2.0), F.lit(4.0))) == 0.5 and one(spark, scores.duration_ratio(F.lit(0.0), F.lit(4.0))) is None
