import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm.encodings import Dictionaries, repair, repaired_documents, table

SAMPLES = {
    "pt": ["É estranho, mas a gravação não combina com a imagem. A tradução pertence ao próximo episódio – “não mexa nisso”.", "Ninguém nos explicou por que o capítulo esconde a respiração do ator. Eles querem a música com 12 segundos a menos."] * 20,
    "de": ["Vielleicht müssen wir die Übersetzung wiederholen, denn das Gespräch gehört in die nächste Folge. Über das Mikrofon – “schön”."] * 20,
    "es": ["¿Ya escuchaste la canción mañana? El micrófono todavía necesita una segunda revisión – “así”. Nadie lo notó después."] * 20,
    "fr": ["C’est étrange, mais l’écho rappelle à tous la première saison. Personne ne nous a expliqué où ça dépasse – “voilà”."] * 20,
    "en": ["The translation matters more than the music – “and that will not change”. Nobody told us why Nañtavel and Bröisk left."] * 20,
    "ru": ["Моя сестра всегда смеётся, когда обсуждает отрывок. Никто не объяснил нам, почему перевод ещё требует второй проверки. Это не изменится – “да”."] * 20,
}
DICTS = Dictionaries(SAMPLES)


def misread(text, true, wrong):
    t = table(wrong)
    return "".join(t[b] for b in text.encode(true, "replace"))


@pytest.mark.parametrize(
    ("lang", "true", "wrong"),
    [(x, "utf-8", w) for x in ("pt", "de", "es", "fr", "ru") for w in ("cp1252", "cp437", "cp850", "mac_roman")]
    + [("ru", "utf-8", "cp1251"), ("ru", "cp1251", "cp1252"), ("ru", "cp1251", "koi8_r"), ("ru", "koi8_r", "cp1251"), ("pt", "cp1252", "mac_roman"), ("de", "cp1252", "mac_roman"), ("es", "cp1252", "cp1251"), ("pt", "cp1252", "cp1251")],
)
def test_round_trip(lang, true, wrong):
    text = SAMPLES[lang][0].split(" – ")[0]
    damaged = misread(text, true, wrong)
    fixed, chains, gained, found = repair(damaged, lang, DICTS)
    assert found and chains and gained >= 0
    assert fixed == text


@pytest.mark.parametrize("wrong", ["gbk", "cp949", "cp1257", "iso8859_2", "cp1254"])
def test_other_encodings_in_which_utf8_was_read(wrong):
    text = "Die Übersetzung gehört zum Gespräch."
    raw = text.encode("utf-8")
    damaged = raw.decode(wrong) if wrong in ("gbk", "cp949") else misread(text, "utf-8", wrong)
    assert repair(damaged, "de", DICTS)[0] == text


def test_only_a_gain_repairs_and_it_is_reported():
    fixed, chain, gained, damaged = repair("Niemand mag die Ãœbersetzung.", "de", DICTS)
    assert fixed == "Niemand mag die Übersetzung." and chain and gained > 0 and damaged
    assert repair("ZZ÷ZZ", "de", DICTS) == ("ZZ÷ZZ", [], 0, False)


def test_twice_damaged_and_partly_damaged():
    text = "A gravação não combina com a imagem."
    twice = misread(misread(text, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert repair(twice, "pt", DICTS)[0] == text
    doc = text + "\n" + misread("Ninguém nos explicou por que.", "utf-8", "cp850") + "\n" + text
    assert repair(doc, "pt", DICTS)[0] == text + "\nNinguém nos explicou por que.\n" + text
    assert repair(doc, None, DICTS)[3] and repair(doc, "xx", DICTS)[3]
    assert repair("Nota de revis�o", "pt", DICTS)[3]


@pytest.mark.parametrize(
    "fine",
    ["O arquivo mostrava “Ã£” no lugar de “ã”, e isso foi corrigido.", "naïve façade, coöperate, Ångmark", "Łotvar Škelin, Ďurmek Ţelva", "≈ 3 dB ± 0,5 · ½ s → 24 kHz √", "¬ done · † cut · ‡ hold · § 4 · ¶ 2",
     "θ = 0.3, λ ≤ 2, Δ ≈ π", "🎬🎙️ take ✓ ✗", "ПРИМЕЧАНИЕ: дубль", "ATENÇÃO – REVISÃO FINAL – NÃO ALTERAR", "ÂNCORA / MAÇÃ / SÃO", "├── media\n│   └── speech.wav", "", None, "plain", " \n"],
)
def test_fine_texts_stay(fine):
    for lang in ("pt", "en", "de", "ru", None):
        got = repair(fine, lang, DICTS)
        assert got[0] == fine and not got[3]


def test_table(spark):
    bad = misread(SAMPLES["pt"][1], "utf-8", "cp1252")
    rng = random.Random(1)
    rows = [(i, rng.choice(SAMPLES[lang]), lang) for i, lang in enumerate(SAMPLES)] + [(50, bad, "pt"), (50, bad, "pt"), (51, bad * 400, None), (52, None, "pt"), (53, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("restored", F.lit("clash"))
    got = {r.doc_id: r for r in repaired_documents(docs, SAMPLES).collect()}
    assert set(got) == {50, 51} and got[50].restored == SAMPLES["pt"][1] and not got[50].lost and got[51].restored == SAMPLES["pt"][1] * 400
    assert repaired_documents(docs.limit(0)).collect() == []
