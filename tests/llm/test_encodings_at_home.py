from cadenza.llm.encodings import Dictionaries, repair

PT = "Memorando do glossário 229 – última revisão. A pronúncia do capítulo está no glossário – “não mexa nisso”. A manhã não começa."
DICTS = Dictionaries({"pt": [PT] * 20})


def test_middle_dot_next_to_a_letter_is_no_sign_of_health():
    damaged = "Memorando do gloss·rio 229"
    assert repair(damaged, "pt", DICTS)[0] == "Memorando do glossário 229"


def test_calm_segment_of_a_damaged_text():
    text = "Memorando do glossário – última revisão.\nMemorando 229 – manhã"
    damaged = "".join(bytes([b]).decode("mac_roman") for b in text.encode("cp1252"))
    assert repair(damaged, "pt", DICTS)[0] == text


def test_rightful_middle_dots_stay():
    for text in ("glossário · revisão · 229", "manhã · última"):
        assert repair(text, "pt", DICTS) == (text, [], 0, False)
