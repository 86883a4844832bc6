"""Text and spoken-duration functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speaking rates (syllables a second), tempo factor, pauses, vowels, CJK ranges, fillers and pronouns.
RATES = {"en": 4.4, "es": 5.4, "pt": 4.9, "fr": 5.0, "it": 5.0, "de": 4.3, "nl": 4.4, "ru": 4.6, "ja": 5.7, "ko": 5.0, "zh": 5.0}
DEFAULT_RATE = 4.6
TEMPO = 1.25
SENTENCE_MARKS, SENTENCE_PAUSE = ".?!…。！？", 0.25
CLAUSE_MARKS, CLAUSE_PAUSE = ",;:、；：", 0.12
PAUSE_SHARE = 0.30
VOWELS = "aeiouyàáâãäåèéêëìíîïòóôõöùúûüýÿæœ"
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}"
PT_FILLERS = ["bem", "quero dizer", "quer dizer", "olha", "veja", "sabe", "então", "entao", "na verdade", "tipo", "ok", "tudo bem", "ah", "é", "eh", "digo"]
PT_PRONOUNS = ["eu", "você", "voce", "ele", "ela", "nós", "nos", "eles", "elas", "vocês", "voces"]
VOCAL_EVENTS = ["laughter", "chuckle", "sigh", "breath", "breathing", "cough", "gasp", "humming"]
BLANKS = " \t\n\x0b\f\r"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return text.isNull() | (stripped(text) == "")


def base_language(code: Column) -> Column:
    """Code before the first ``-`` or ``_``, lower-cased; null gives ''."""
    return F.split_part(F.split_part(F.lower(F.trim(F.coalesce(code, F.lit("")))), F.lit("-"), F.lit(1)), F.lit("_"), F.lit(1))


def translation_language(code: Column) -> Column:
    """The three main languages under their usual spellings; else the code before ``-``."""
    low = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    return (
        F.when(low.isin("pt", "pt-br", "pt-pt", "portuguese"), "pt").when(low.isin("en", "en-us", "en-gb", "english"), "en")
        .when(low.isin("es", "es-es", "es-mx", "spanish"), "es").otherwise(F.split_part(low, F.lit("-"), F.lit(1)))
    )


def count_matches(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    left = [F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]  # byte searches, several times faster than one translation
    return F.length(text) * len(chars) - sum(left[1:], left[0])


def cjk_count(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]", ""))


_V = f"[{VOWELS}]"
_C = rf"[\p{{L}}&&[^{VOWELS}]]"
#: Words without a vowel; English words with two vowel groups or more whose last one ends in an ``e`` that no ``l`` precedes.
_MUTE_WORD = rf"(?<!\p{{L}}){_C}+(?!\p{{L}})"
_SILENT_E = rf"(?<!\p{{L}})\p{{L}}*{_V}{_C}*(?:[\p{{L}}&&[^{VOWELS}l]]e|{_C}{_V}+e)(?!\p{{L}})"


def syllables(text: Column, lang: Column) -> Column:
    """Syllables of a text; blank gives 0. A word has its vowel groups, one at least; a silent English final ``e`` (not
    ``le``) is not counted. Chinese and Japanese count characters, Korean counts words and characters.

    Counted over the whole text by three patterns, so that no array of words is built.
    """
    text = F.coalesce(text, F.lit(""))
    code = base_language(lang)
    asian = code.isin("zh", "ja")
    low = F.when(asian, F.regexp_replace(F.lower(text), "[^a-z]+", " ")).otherwise(F.lower(text))
    silent = F.when(asian | (code == "en"), F.regexp_count(low, F.lit(_SILENT_E))).otherwise(0)
    cjk = F.when(asian | (code == "ko"), cjk_count(text)).otherwise(0)
    return F.regexp_count(low, F.lit(f"{_V}+")) + F.regexp_count(low, F.lit(_MUTE_WORD)) - silent + cjk


def speaking_rate(lang: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, base_language(lang)), F.lit(DEFAULT_RATE))


def pause_budget(text: Column, speech: Column) -> Column:
    raw = count_matches(text, SENTENCE_MARKS) * SENTENCE_PAUSE + count_matches(text, CLAUSE_MARKS) * CLAUSE_PAUSE
    return F.least(raw, F.when(speech > 0, speech * PAUSE_SHARE).otherwise(1.0))


def duration(text: Column, lang: Column, rate: Column | None = None, counted: Column | None = None) -> Column:
    """Spoken seconds, unrounded: syllables at the rate (times ``TEMPO`` unless given) plus pauses; blank gives 0.

    No branch hides the count of syllables, so that it is evaluated once however often it appears here.
    """
    text = F.coalesce(text, F.lit(""))
    per_second = speaking_rate(lang) * TEMPO if rate is None else F.when(rate > 0, rate).otherwise(speaking_rate(lang) * TEMPO)
    speech = (syllables(text, lang) if counted is None else counted) / per_second
    return speech + pause_budget(text, speech)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. A lambda that names a column expression computes it for every element."""
    return F.transform(F.array(value), body)[0]


def collapse_stutters(tokens: Column) -> Column:
    """Runs of three or more equal tokens (any case) become their first; pairs stay."""

    def kept(words: Column, low: Column) -> Column:
        at = lambda i: F.get(low, i)
        repeated = lambda i: (at(i) == at(i - 1)) & (F.coalesce(at(i) == at(i - 2), F.lit(False)) | F.coalesce(at(i) == at(i + 1), F.lit(False)))
        return F.filter(words, lambda t, i: ~F.coalesce((i > 0) & repeated(i), F.lit(False)))

    return once(tokens, lambda words: once(F.transform(words, lambda t: F.lower(t)), lambda low: kept(words, low)))


def drop_corrupt(tokens: Column) -> Column:
    """Without the tokens that hold U+FFFD, those before one that begins and those after one that ends with it."""
    bad = lambda t: F.contains(t, F.lit("�"))
    here = lambda i: F.coalesce(F.get(tokens, i), F.lit(""))
    return F.filter(tokens, lambda t, i: ~(bad(t) | F.startswith(here(i + 1), F.lit("�")) | ((i > 0) & F.endswith(here(i - 1), F.lit("�")))))


def clean_transcript(text: Column) -> Column:
    """Drop control characters, tokens with U+FFFD with the piece glued to them, stutters; collapse blanks.

    Time grows in proportion to the length of a text: arrays are built once for each text, not for each token.
    """
    plain = F.regexp_replace(text, r"[\x00-\x08\x0b-\x1f]", "")
    sound = lambda p: F.array_join(once(F.split(p, " "), drop_corrupt), " ")
    whole = once(plain, lambda p: F.when(F.contains(p, F.lit("�")), sound(p)).otherwise(p))
    words = F.filter(F.split(whole, r"\s+"), lambda w: w != "")
    return F.array_join(collapse_stutters(words), " ")


def condense(text: Column, lang: Column) -> Column:
    """Shorter Portuguese wording (leading fillers, then the subject pronoun, dropped) or null."""
    trimmed = stripped(text)
    fillers = "|".join(sorted(PT_FILLERS, key=len, reverse=True))
    capital = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000_000))
    cut = F.regexp_replace(trimmed, rf"(?iu)^(?:(?:{fillers})\s*,\s*(?=\S))+", "")
    cut = F.when(cut != trimmed, capital(cut)).otherwise(trimmed)
    bare = F.regexp_replace(cut, rf"(?iu)^(?:{'|'.join(PT_PRONOUNS)})\s+(?=[A-Za-zÀ-ÿ])", "")
    out = F.when(bare != cut, capital(bare)).otherwise(cut)
    out = stripped(F.regexp_replace(out, r"\s+", " "))
    return F.when((base_language(lang) == "pt") & (out != "") & (F.length(out) < F.length(trimmed)), out)


def is_vocal_event(text: Column) -> Column:
    bare = F.btrim(F.lower(text), F.lit("[]().,?!"))
    return bare.isin(VOCAL_EVENTS) | (text.startswith("[") & text.endswith("]")) | (text.startswith("(") & text.endswith(")"))


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def clock(seconds: Column) -> Column:
    """HH:MM:SS.ss, from whole centiseconds."""
    c = F.floor(seconds * 100 + 0.5).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%02d", F.floor(c / 360000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100)


def to_bool(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "y", "on", "t")


def word_count(text: Column) -> Column:
    return F.when(is_blank(text), 0).otherwise(F.size(F.split(stripped(text), r"\s+")))


def protect(text: Column, terms: list[str]) -> Column:
    """Replace glossary terms, longest first and in any case, by ``__ENT_i__`` (i: position in the given list)."""
    import re

    for term in sorted(terms, key=lambda t: (-len(t), terms.index(t))):
        text = F.regexp_replace(text, "(?iu)" + re.escape(term), f"__ENT_{terms.index(term)}__")
    return text


def restore(text: Column, values: list[str]) -> Column:
    for i, v in enumerate(values):
        text = F.replace(text, F.lit(f"__ENT_{i}__"), F.lit(v))
    return text


def missing_terms(text: Column, terms: Column) -> Column:
    return F.filter(terms, lambda t: ~F.contains(F.lower(text), F.lower(t)))
