"""Text that was decoded with a wrong character encoding: detection and repair by minimum description length (problem 9).

A step of a chain says which encoding text was wrongly read in and which one its bytes are in. Every candidate decoding of
every segment that shows a sign of damage is compressed with a zstandard dictionary of its language. For a text the step
that saves most over all its segments is taken, if it saves more bytes than naming it costs; then the next one is looked
for. Without a gain the text stays as it is.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["en", "pt", "es", "fr", "de", "ru"]
UTF8_READ_AS = ["cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8_r", "cp866", "cp1250", "cp1254", "cp1257", "iso8859_2"]
#: Encodings of two bytes a character in which UTF-8 may have been read too.
WIDE = ["shift_jis", "gbk", "big5", "cp949"]
#: (wrongly read as, really in) for bytes of one-byte encodings.
SWAPS = [
    ("mac_roman", "cp1252"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("cp1253", "cp1252"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "cp866"),
    ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "iso8859_5"), ("iso8859_5", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"),
]
USUAL = set("–—“”‘’…·«»•")
_SEGMENT = re.compile(r"[^\n.?!]*[\n.?!]*[\"”»’')\]]*\s*")
#: What stays as it is: a sequence cited between quotes, the lines of a drawn tree.
_CITED = re.compile(r"[“\"«‘'(\[„`][^\sA-Za-z]{1,6}[”\"»’')\]“`]|^(?:[ \t]*[│├└]─*[ \t]+)+", re.M)
_TOKEN = re.compile(r"[^\W\d_]+")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")
_OTHER_CYRILLIC = re.compile("[ЀЂ-Џѐђ-ӿ]")
_EAST = re.compile("[\u2e80-\u9fff\uac00-\ud7a3\uff61-\uff9f]")
_EAST_RUN = re.compile("[^\x00-\x7f]+")
_MIXED = re.compile("[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ]")
_INSIDE = re.compile("(?<=[A-Za-z])[…“”—–„⁄](?=[A-Za-z])")
_DOT = re.compile(r"(?<=[^\W\d_])·|·(?=[^\W\d_])")  # what á, ú become in some wrong readings
_FLIPPED = re.compile("[а-яёѐ-џ][А-ЯЁЀ-Џ]")
_FLIP = re.compile("[а-яё][А-ЯЁ]|[a-zß-öø-ÿ](?:[À-ÖØ-Þ](?![A-Z])|(?<=[ß-öø-ÿ])[A-Z])")
_SIGN = re.compile(r"(?<=[^\W\d_])[^\w\s\x00-\x7f’](?=[^\W\d_])")
_LONE = re.compile(r"(?<![^\W_])(?:[À-ÖØ-öø-ɏ]+|[^\W\d_\x00-\x7f])(?![^\W_])")
_SHOUTED = re.compile("(?:[А-ЯЁ]{2,}[^А-Яа-яЁё]+){2}[А-ЯЁ]{2,}")
_UNCLEAN = re.compile(
    "[а-яё][А-ЯЁ]|[a-zß-ÿ][À-ÖØ-Þ]|[A-Za-zÀ-ɏ][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-zÀ-ɏ]|[a-zß-ÿ][^\\w\\s\\x00-\\x7f–—“”’…·»«][a-zß-ÿ]|(?:[А-ЯЁ]{2,}[^А-Яа-яЁё]+){2}[А-ЯЁ]{2,}|[À-ÿ]{6}"
)
_HIGH = re.compile(r"[^\x00-\x7f]")
#: Bytes that a step costs. UTF-8 sequences prove themselves; a swap of one-byte encodings can turn any rare sign into a letter.
UTF8_COST, SWAP_COST = 1, 3


def memo(f):
    """Keep results. Unlike the library's cache it is pickled by value, so executors need no copy of this module."""
    kept: dict = {}

    def get(*args):
        if args not in kept:
            kept[args] = f(*args)
        return kept[args]

    return get


@memo
def table(encoding: str) -> list[str]:
    """Character of each byte; bytes that an encoding leaves undefined are read as the control of that number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@memo
def swap(wrong: str, true: str) -> dict[int, str]:
    w, t = table(wrong), table(true)
    return {ord(w[b]): t[b] for b in range(128, 256) if w[b] != t[b] and not ("\x80" <= t[b] <= "\x9f")}


@memo
def utf8_runs(encoding: str) -> tuple[re.Pattern, dict[str, int]]:
    """Pattern of UTF-8 sequences read in a one-byte encoding, and the bytes behind the characters."""
    t = table(encoding)
    some = lambda bs: "[" + "".join(re.escape(t[b]) + (re.escape(chr(b)) if b < 0xA0 else "") for b in bs) + "]"
    cont = some(range(0x80, 0xC0))
    pattern = f"{some(range(0xC2, 0xE0))}{cont}|{some(range(0xE0, 0xF0))}{cont}{{2}}|{some(range(0xF0, 0xF5))}{cont}{{3}}"
    code = {chr(b): b for b in range(0x80, 0xA0)} | {t[b]: b for b in range(0x80, 0x100)}
    return re.compile(f"(?:{pattern})+"), code


def from_utf8(text: str, encoding: str) -> str:
    pattern, code = utf8_runs(encoding)

    def back(m: re.Match) -> str:
        try:
            return bytes(code[c] for c in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return pattern.sub(back, text)


def from_wide(text: str, encoding: str) -> str:
    def back(m: re.Match) -> str:
        try:
            return m[0].encode(encoding).decode("utf-8")
        except UnicodeError:
            return m[0]

    return _EAST_RUN.sub(back, text)


@memo
def any_run(encodings: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(utf8_runs(e)[0].pattern for e in encodings))


_AROUND = re.compile(r"[A-Za-z]?[^\x00-\x7f]+[A-Za-z]?")


def clean_looking(text: str) -> bool:
    """Nothing lost, no UTF-8 read as a western encoding, no inverted case, words of two scripts or signs inside words."""
    if "\ufffd" in text:
        return False
    near = text if len(_CYRILLIC.findall(text)) * 8 > len(text) else " ".join(_AROUND.findall(text))  # signs stand next to other characters than ASCII
    return not _UNCLEAN.search(near) and not any_run(("cp1252", "cp437", "cp850", "mac_roman")).search(near)


class Code(dict):
    """Translation to one byte a character; what is not at home becomes an escape of three bytes, the last two spread so that
    neighbours in Unicode, such as box drawings, have nothing in common."""

    def __init__(self, home: list[str]):
        super().__init__({i: chr(i) for i in range(128)} | {ord(c): chr(128 + i) for i, c in enumerate(home)})

    def __missing__(self, c: int) -> str:
        h = c * 40503 & 0xFFFF
        self[c] = out = "\xff" + chr(h >> 8) + chr(h & 255)
        return out


class Dictionaries:
    """Per language a zstandard dictionary of raw text and its alphabet (the non-ASCII characters at home in it).

    For compression a text becomes one byte per character, so that no encoding's length is preferred: ASCII as it is, the
    alphabet of the language as the upper half, anything else as an escape of three bytes. ``alphabets`` has for each
    language its non-ASCII characters by falling frequency; without it the samples are counted.
    """

    def __init__(self, samples: dict[str, list[str]], alphabets: dict[str, list[str]] | None = None, level: int = 3, size: int = 96_000, common: float = 0.02):
        import zstandard as z

        self.alphabet: dict[str, set[str]] = {}
        self.code: dict[str, Code] = {}
        self.by: dict[str, z.ZstdCompressor] = {}
        for lang, texts in samples.items():
            home = (alphabets or {}).get(lang)
            if home is None:
                home = frequent(Counter(c for t in texts for c in set(_HIGH.findall(t))), len(texts), common)
            self.alphabet[lang] = set(home)
            capitals = [c.upper() for c in home if len(c.upper()) == 1 and c.upper() not in self.alphabet[lang]]
            self.code[lang] = Code([*home, *capitals][:126])
            raw = self.bytes_of("\n".join(texts), lang)[:size]
            if len(raw) >= 64:
                d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                self.by[lang] = z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = z.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)

    def bytes_of(self, text: str, lang: str) -> bytes:
        if text.isascii():
            return text.encode("ascii")
        return text.translate(self.code.get(lang) or self.code.setdefault(lang, Code([]))).encode("latin-1")

    def cost(self, text: str, lang: str) -> int:
        # what no dictionary says of short texts: a sign or a change of case inside a word costs a byte, a change of script,
        # a lone letter or a word of accented letters only two
        if text.isascii():
            return len(self.by.get(lang, self.plain).compress(text.encode("ascii")))
        odd = (2 * len(_MIXED.findall(text)) if _CYRILLIC.search(text) else 0) + len(_FLIP.findall(text)) + len(_SIGN.findall(text)) + 2 * len(_LONE.findall(text))
        return len(self.by.get(lang, self.plain).compress(self.bytes_of(text, lang))) + odd

    def least(self, text: str, langs: set[str], document: str = "") -> int:
        """Cost in the best of ``langs``; Russian is one where Cyrillic letters prevail or the document is Russian, else none."""
        langs = {*langs, "ru"} if russian(text) else langs if document == "ru" else langs - {"ru"}
        return min((self.cost(text, x) for x in langs), default=self.cost(text, ""))

    def language(self, text: str, label: str | None) -> str:
        if label in self.by:
            return label
        own = [x for x in self.by if x != "ru" or russian(text)] or list(self.by)
        return min(own, key=lambda x: (self.cost(text, x), x), default="")

    def strange(self, text: str, lang: str) -> int:
        """Signs of a wrong encoding: characters foreign to the language, words of two scripts, inverted case. They only say
        where to look, and settle ties."""
        if text.isascii():
            return 0
        home = self.alphabet.get(lang, set()) | USUAL
        odd = sum(1 for c in _HIGH.findall(text) if c not in home and not _CYRILLIC.match(c)) if not home.issuperset(_HIGH.findall(text)) else 0
        if odd:  # capitals are at home where their small letters are, in words all of capitals
            odd -= sum(1 for w in _TOKEN.findall(text) if len(w) > 1 and w.isupper() for c in w if c > "\x7f" and not _CYRILLIC.match(c) and c not in home and c.lower() in home)
        odd += len(_INSIDE.findall(text)) + len(_DOT.findall(text))
        if _CYRILLIC.search(text):
            odd += len(_MIXED.findall(text)) + len(_FLIPPED.findall(text)) + len(_OTHER_CYRILLIC.findall(text)) + len(_SHOUTED.findall(text))
        return odd


def frequent(counts: Counter, n: int, common: float) -> list[str]:
    """Characters that a share ``common`` of ``n`` texts holds, two texts at least, by falling frequency."""
    return [c for c, k in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if k >= max(2, common * n)]


def decoded(segment: str, step: str) -> str:
    """Text of a segment after one step."""
    true, _, wrong = step.partition(" read as ")
    return segment.translate(swap(wrong, true)) if true != "utf-8" else from_wide(segment, wrong) if wrong in WIDE else from_utf8(segment, wrong)


def decodings(segment: str) -> dict[str, str]:
    """Text of a segment after each step that changes it."""
    steps = [f"utf-8 read as {e}" for e in UTF8_READ_AS if utf8_runs(e)[0].search(segment)]
    steps += [f"utf-8 read as {e}" for e in WIDE if _EAST.search(segment)]
    steps += [f"{true} read as {wrong}" for wrong, true in SWAPS]
    return {step: t for step in steps if (t := decoded(segment, step)) != segment}


def russian(text: str) -> bool:
    return bool(_CYRILLIC.search(text)) and len(_CYRILLIC.findall(text)) > len(_LATIN.findall(text))


def segments_of(text: str) -> list[str]:
    return [m[0] for m in _SEGMENT.finditer(text) if m[0]]


def repair(text: str | None, label: str | None, dicts: Dictionaries, depth: int = 4) -> tuple[str | None, list[str], int, bool]:
    """(text with repaired segments, chain of steps, bytes gained, damaged).

    A sequence that is only cited between quotes stays. Lost characters (U+FFFD) are damage that can't be restored: any
    letter of the language in their place would be described in fewer bytes.
    """
    if not text or text.isascii() or not dicts.by:
        return text, [], 0, False
    lang = dicts.language(text, label)
    if "\ufffd" not in text and not dicts.strange(text, lang):
        return text, [], 0, False
    parts = segments_of(text)
    cited = {i: _CITED.findall(p) for i, p in enumerate(parts) if not p.isascii()}
    now = {i: _CITED.sub("\x00", parts[i]) if quotes else parts[i] for i, quotes in cited.items()}
    lost = sum(dicts.cost(t, lang) - dicts.cost(t.replace("\ufffd", "e"), lang) for t in now.values() if "\ufffd" in t)
    langs: dict[int, set[str]] = {}
    cost: dict[int, int] = {}
    chain: list[str] = []
    gained = 0

    def price(i: int) -> int:
        if i not in cost:
            langs[i] = {lang, dicts.language(now[i], None)}  # a passage may be in another language than its document
            cost[i] = dicts.least(now[i], langs[i], lang)
        return cost[i]

    def saves(i: int, t: str) -> int:
        return price(i) - dicts.least(t, langs[i], lang)

    def options(i: int) -> list[tuple[str, int, int]]:
        """(step, bytes saved, signs gone) of the decodings that save anything; none for a segment without signs."""
        signs = dicts.strange(now[i], lang)
        told: dict[str, tuple[int, int]] = {}
        out = []
        for step, got in decodings(now[i]).items() if signs else ():
            if got not in told:
                told[got] = (saves(i, got), signs - dicts.strange(got, lang))
            if told[got][0] > 0:
                out.append((step, *told[got]))
        return out

    open_ = {i: options(i) for i in now}
    while len(chain) < depth:
        total: Counter = Counter()
        left: Counter = Counter()
        for found in open_.values():
            for step, more, gone in found:
                total[step] += more
                left[step] -= gone
        net = {step: n - (UTF8_COST if step.startswith("utf-8") else SWAP_COST) for step, n in total.items()}
        step = min(net, key=lambda x: (-net[x], left[x], x), default=None)
        if step is None or net[step] <= 0:
            break
        chain.append(step)
        for i, t in now.items():  # also where no sign shows: wrong characters may all be at home in the language
            got = decoded(t, step)
            if got != t and (more := saves(i, got)) > 0:
                now[i] = got
                cost[i] -= more
                gained += more
                open_[i] = options(i)
    for i, t in now.items():
        for c in cited[i]:
            t = t.replace("\x00", c, 1)
        parts[i] = t
    return "".join(parts), list(dict.fromkeys(chain)), gained, lost > 0 or bool(chain)


def home_alphabets(documents: DataFrame, common: float = 0.02) -> dict[str, list[str]]:
    """Non-ASCII characters that a share ``common`` of a language's clean-looking documents hold, counted over all of them.

    What is collected has one row per language and character of Unicode at most.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            count: Counter = Counter()
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                high = "" if text.isascii() else set(_HIGH.findall(text))
                if not high or clean_looking(text):
                    count[lang, ""] += 1
                    count.update((lang, c) for c in high)
            rows = [(lang, c, n) for (lang, c), n in count.items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "c", "n"])

    rows = documents.select("text", F.lower("lang").alias("lang")).where(F.col("lang").isin(LANGUAGES) & F.col("text").isNotNull())
    found = rows.mapInArrow(run, "lang string, c string, n bigint").groupBy("lang", "c").agg(F.sum("n").alias("n")).collect()
    total = {r["lang"]: r["n"] for r in found if not r["c"]}
    return {lang: frequent(Counter({r["c"]: r["n"] for r in found if r["c"] and r["lang"] == lang}), n, common) for lang, n in total.items()}


def sample_texts(documents: DataFrame, per_language: int = 400, longest: int = 4000) -> dict[str, list[str]]:
    """Bounded sample for the dictionaries: ``per_language`` clean-looking texts at most, of each ``longest`` characters at most."""
    rows = documents.select("text", F.lower("lang").alias("lang")).where(F.col("lang").isin(LANGUAGES) & F.col("text").isNotNull())
    rows = rows.withColumn("h", F.xxhash64("text"))
    picked = rows.groupBy("lang", F.pmod("h", F.lit(per_language)).alias("slot")).agg(F.min("h").alias("h")).select("h").distinct()
    keys = [(r["h"],) for r in picked.collect()]  # per_language x languages longs
    if not keys:
        return {}
    wanted = rows.sparkSession.createDataFrame(keys, "h bigint")
    found = rows.join(F.broadcast(wanted), "h", "left_semi").groupBy("lang", "h").agg(F.min(F.left("text", F.lit(longest))).alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(found.collect(), key=lambda r: (r["lang"], r["h"])):
        if clean_looking(r["text"]):
            out.setdefault(r["lang"], []).append(r["text"])
    return out


def repaired_documents(documents: DataFrame, samples: dict[str, list[str]] | None = None, per_language: int = 400) -> DataFrame:
    """Damaged documents: doc_id, restored (text with every repairable segment repaired), chains, gained (bytes), lost.

    ``lost`` says that characters are gone for good (U+FFFD). Null, blank and ASCII texts, and texts that only cite a
    damaged sequence between quotes or rightly use rare characters, are left out; an unknown or null ``lang`` is guessed by
    compression; the dictionaries hold 96 kB a language, from ``per_language`` texts of 4,000 characters each at most; the
    alphabets are counted over all documents; a doc_id delivered twice with equal text gives one row; whole texts are read, whatever their length; an
    empty table gives an empty result; extra columns are ignored.
    """
    told = (sample_texts(documents, per_language), home_alphabets(documents)) if samples is None else (samples, None)
    shared = documents.sparkSession.sparkContext.broadcast(told)

    def run(batches):
        import pyarrow as pa

        dicts = Dictionaries(*shared.value)
        for b in batches:
            rows = []
            for doc, text, lang in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if text and not text.isascii():
                    fixed, chains, gained, damaged = repair(text, lang and lang.lower(), dicts)
                    if damaged:
                        rows.append((doc, fixed, chains, gained, "\ufffd" in fixed))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "restored", "chains", "gained", "lost"])

    found = documents.select("doc_id", "text", "lang").where("text is not null").mapInArrow(
        run, "doc_id bigint, restored string, chains array<string>, gained bigint, lost boolean"
    )
    return found.dropDuplicates(["doc_id", "restored"])
