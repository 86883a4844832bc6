"""Language of documents and of their mixed-language segments (problem 3).

Nearest-centroid classification: hashed character n-grams, TF-IDF weighted and length-normalised, are compared by cosine
with several centroids per language; a text too far from every centroid for its length, or written with letters that its
nearest language does not have, gets no language.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["en", "pt", "es", "fr", "de", "ru"]
# Names and three-letter codes of the languages that labels may spell out.
SPELLINGS = {
    "en": ["eng", "english", "inglês", "inglés", "anglais", "englisch"],
    "pt": ["por", "portuguese", "português", "portugués", "portugais", "portugiesisch"],
    "es": ["spa", "spanish", "español", "espanhol", "espagnol", "spanisch", "castellano"],
    "fr": ["fra", "fre", "french", "français", "francês", "francés", "französisch"],
    "de": ["deu", "ger", "german", "deutsch", "alemão", "alemán", "allemand"],
    "ru": ["rus", "russian", "русский", "russo", "ruso", "russe", "russisch"],
}
OTHER_CODES = ["it", "nl", "sv", "da", "no", "nb", "fi", "pl", "cs", "sk", "hu", "ro", "bg", "el", "tr", "uk", "sr", "hr", "ar", "he", "fa", "hi", "ja", "ko", "zh", "vi", "th", "id", "ca", "gl", "eu", "la"]

BITS = 15
WORD_CLASSES = [6, 9, 13]  # words from which on texts have a floor of their own
_SPLIT = re.compile(r"(?<=[.?!…])[\"”»’']*\s+|\s+[—–]\s+|[\n;]+")
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"]*\"")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_QUOTE = re.compile("[“«„\"]")
_DASHED = re.compile(r"[—–\n;]")
_STOPPED = re.compile(r"[.?!…][\"”»’')]*\s")  # with _DASHED: where nothing of this is, _SPLIT finds nothing
_WORD = re.compile(r"[^\W\d_]+")
_LONG = re.compile(r"[^\W\d_]{2,}")
_LOWER = re.compile(r"(?:^|[^\w'’])[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ]")


def label_language(label: Column) -> Column:
    """Two-letter code that a label names, whatever its notation; null if it names none."""
    bare = F.regexp_replace(F.lower(label), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    stem = F.regexp_extract(bare, r"^(\p{L}+)(?:[_\-\s(].*)?$", 1)
    pairs = [(c, c) for c in [*LANGUAGES, *OTHER_CODES]] + [(s, c) for c, spelt in SPELLINGS.items() for s in spelt]
    names = F.create_map(*[F.lit(x) for p in pairs for x in p])
    return F.try_element_at(names, stem)


def clauses(text: str) -> list[str]:
    """Clauses of a text. Quoted titles are left out, unless nothing else is there."""
    if _QUOTE.search(text):
        rest = _QUOTED.sub(" ", text)
        text = rest if _WORD.search(rest) else text
    parts = _SPLIT.split(text) if _STOPPED.search(text) or _DASHED.search(text) else [text]
    return [c for c in parts if c and _WORD.search(c)]


@cache
def _gaps() -> np.ndarray:
    """By code point: 1 for what is no part of a word, 2 for digits and ``_``, else 0. NUL and apostrophes stay."""
    every = "".join(map(chr, range(0x110000)))
    kinds = np.zeros(len(every), dtype=np.uint8)
    for kind, pattern in ((1, r"[^\w\x00'’]+"), (2, r"[\d_]+")):
        for m in re.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    return kinds


def _spaced(text: str) -> np.ndarray:
    """Code points of a text, each run of a kind of gap as one blank."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _gaps()[a]
    kept = kind == 0
    kept[1:] |= kind[1:] != kind[:-1]
    kept[:1] = True
    return np.where(kind == 0, a, np.uint32(32))[kept]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs and their counts for character n-grams of 1 to 4 letters, word ends marked."""
    joined = "\x00 " + " \x00 ".join(texts).lower() + " \x00"
    a = _spaced(joined)
    owner = np.cumsum(a == 0).astype(np.int64) - 1
    a = a.astype(np.uint64)
    end = a == 0
    out, h, ok = [], np.zeros_like(a), np.ones(len(a), dtype=bool)
    for n in range(1, 5):
        m = len(a) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(1000003) + a[n - 1 :]
        ok = ok[:m] & ~end[n - 1 :]
        if n == 1:
            continue  # single letters say little and cost as much
        mixed = (h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((owner[:m][ok] << BITS) | (mixed >> np.uint64(64 - BITS)).astype(np.int64))
    keys = np.sort(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)
    if not len(keys):
        return keys, keys, keys.astype(np.float32)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    damped = (1 + np.log(np.arange(1, counts.max() + 1))).astype(np.float32)
    return keys >> BITS, keys & ((1 << BITS) - 1), damped[counts - 1]


class LanguageModel:
    """Centroids by language, of unit length and multiplied by IDF: (buckets, centroids).

    ``reject`` is the least cosine of any text, ``floors`` the least score (cosine, raised by the lead over the second
    language) by number of words, ``letters`` those at home in each language.
    """

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, reject: float, floors: list[float] | None = None, letters: list[set[str]] | None = None):
        self.idf, self.centroids, self.owner, self.reject = idf, centroids, owner, reject
        self.floors, self.letters = floors or [0.0] * (len(WORD_CLASSES) + 1), letters
        self._strange: dict[int, re.Pattern] = {}

    def near(self, text: str, lang: int, words: int, cosine: float, lead: float) -> bool:
        """Whether a text is near enough to its nearest language. Short texts are held to the cosine only."""
        if cosine < self.reject or cosine * (1 + lead) < self.floors[bisect_right(WORD_CLASSES, words)]:
            return False
        if self.letters is None or words < WORD_CLASSES[0]:
            return True
        foreign = [c for c in self.strange(lang).findall(text.lower()) if c.isalpha()]
        return len(foreign) < 2 or len(foreign) * 33 < len(text)

    def strange(self, lang: int) -> re.Pattern:
        """Characters beyond ASCII that are not at home in a language."""
        if lang not in self._strange:
            self._strange[lang] = re.compile("[^\x00-\x7f" + "".join(map(re.escape, sorted(self.letters[lang]))) + "]")
        return self._strange[lang]

    @classmethod
    def fit(cls, labelled: list[tuple], per_language: int = 4, rounds: int = 6, reject: float | None = None, share: float = 0.2) -> LanguageModel:
        """Spherical k-means inside each language. ``labelled``: (language, text[, count]); unknown languages are ignored.

        A text under several labels keeps its most frequent one. Labels may be wrong: a text that is clearly nearer to the
        mean of another language leaves the sample before clustering. The first cluster of a language starts from its texts
        of five words or fewer, which lie far from whole sentences. A tenth of the texts is held out of the means to find
        how near texts of a length usually are: the floor is ``share`` of the median score.
        """
        label: dict[str, tuple[int, str]] = {}
        for lang, t, *count in labelled:
            if lang in LANGUAGES and t:
                label[t] = max(label.get(t, (0, "")), (count[0] if count else 1, lang))
        size = 1 << BITS
        if not label:
            return cls(np.ones(size, np.float32), np.zeros((size, 1), np.float32), np.zeros(1, dtype=int), 2.0)
        texts = sorted(label)
        n, k = len(texts), per_language
        code = np.array([LANGUAGES.index(label[t][1]) for t in texts])
        weight = np.sqrt([label[t][0] for t in texts])
        doc, bucket, tf = grams(texts)
        idf = (np.log((1 + n) / (1 + np.bincount(bucket, minlength=size))) + 1).astype(np.float32)
        w = tf * idf[bucket]
        norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=n)) + 1e-9
        w = (w / norm[doc]).astype(np.float32)

        def means(cluster: np.ndarray, many: int, use: np.ndarray) -> np.ndarray:
            on = use[doc]
            flat = np.bincount(bucket[on] * many + cluster[doc[on]], weights=w[on] * weight[doc[on]], minlength=size * many).reshape(size, many)
            return (flat / (np.sqrt((flat * flat).sum(axis=0)) + 1e-9)).astype(np.float32)

        every = np.ones(n, dtype=bool)
        held = np.arange(n) % 10 == 9  # of texts in order, kept aside to calibrate the floors
        plain = _project(doc, bucket, w, means(code, len(LANGUAGES), every), n)
        use = plain[np.arange(n), code] >= 0.75 * plain.max(axis=1)
        short = np.array([len(_WORD.findall(t)) <= 5 for t in texts])
        cluster = code * k + np.where(short | (k == 1), 0, np.random.default_rng(7).integers(min(1, k - 1), k, n))
        owner = np.repeat(np.arange(len(LANGUAGES)), k)
        for _ in range(rounds):
            sims = _project(doc, bucket, w, means(cluster, len(owner), use), n)
            sims[owner[None, :] != code[:, None]] = -1
            cluster = sims.argmax(axis=1)
        known = use & ~held if (use & ~held).any() else use
        sims = _project(doc, bucket, w, means(cluster, len(owner), known), n)
        by = np.stack([sims[:, owner == i].max(axis=1) for i in range(len(LANGUAGES))], axis=1)
        rest = by.copy()
        rest[np.arange(n), code] = -1
        score = by[np.arange(n), code] + np.maximum(by[np.arange(n), code] - rest.max(axis=1), 0)
        words = np.searchsorted(WORD_CLASSES, [len(_WORD.findall(t)) for t in texts], "right")
        floors = [0.0] * (len(WORD_CLASSES) + 1)
        for c in range(1, len(floors)):
            mine = score[use & held & (words == c)]
            floors[c] = share * float(np.median(mine)) if len(mine) >= 20 else floors[c - 1]
        letters = [Counter() for _ in LANGUAGES]
        for t, i, ok in zip(texts, code.tolist(), use.tolist(), strict=True):
            if ok:
                letters[i].update(c for c in t.lower() if c > "\x7f")
        home = [{c for c, k in x.items() if k >= 1e-4 * sum(x.values())} for x in letters]
        centroids = means(cluster, len(owner), use)
        own = _project(doc, bucket, w, centroids, n).max(axis=1)
        return cls(idf, centroids, owner, float(np.quantile(own[use], 0.001)) * 0.6 if reject is None else reject, floors, home)

    def similarities(self, texts: list[str]) -> np.ndarray:
        """Greatest cosine per language, (texts, languages)."""
        n = len(texts)
        best = np.zeros((n, len(LANGUAGES)), np.float32)
        doc, bucket, tf = grams(texts)
        if not len(doc):
            return best
        w = tf * self.idf[bucket]
        norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=n)) + 1e-9
        sims = _project(doc, bucket, w, self.centroids, n) / norm[:, None]
        for lang in set(self.owner.tolist()):
            best[:, lang] = sims[:, self.owner == lang].max(axis=1)
        best[[not _CYRILLIC.search(t) for t in texts], LANGUAGES.index("ru")] = 0  # what shares no script shares no language
        return best


def _project(doc: np.ndarray, bucket: np.ndarray, w: np.ndarray, centroids: np.ndarray, n: int, block: int = 8192) -> np.ndarray:
    """Dot product of each text (rows of sorted ``doc``) with each centroid, in blocks that fit the cache."""
    out = np.zeros((n, centroids.shape[1]), np.float32)
    w = w.astype(np.float32, copy=False)
    for at in range(0, len(doc), block):
        d, part, rows = doc[at : at + block], w[at : at + block], centroids.take(bucket[at : at + block], axis=0)
        first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        edges = [*first.tolist(), len(d)]
        out[d[first]] += np.array([part[i:j] @ rows[i:j] for i, j in zip(edges, edges[1:], strict=False)])
    return out


def segment_languages(model: LanguageModel, texts: list[str | None], min_words: int = 3, margin: float = 0.08, name_margin: float = 0.4) -> list[list[tuple[str, float, str]]]:
    """For each text its (language, confidence, clause) list, neighbours of one language joined.

    A clause of fewer than ``min_words`` words, or whose best language leads by less than ``margin`` (share of the best
    cosine), takes the language of the rest of its text. No entry: nothing near enough to any language. A text without any
    lower-case word may be only a name: it needs two words or more and, in title case, a lead of ``name_margin``.
    """
    parts = [clauses(t) if t else [] for t in texts]
    flat = [c for p in parts for c in p]
    if not flat:
        return [[] for _ in texts]
    sims = model.similarities(flat)
    every = np.arange(len(flat))
    first = sims.argmax(axis=1)
    best = sims[every, first]
    rest = sims.copy()
    rest[every, first] = -1
    second = rest.max(axis=1)
    lead = ((best - second) / np.maximum(best, 1e-9)).tolist()
    others = np.repeat(best[:, None], sims.shape[1], axis=1)  # the best of the other languages
    others[every, first] = second
    sure_of = np.clip(0.5 + (sims - others) / (2 * np.maximum(best, 1e-9))[:, None], 0.0, 1.0).tolist()
    first = first.tolist()
    lengths = [len(_WORD.findall(c)) for c in flat]
    near = [model.near(*x) for x in zip(flat, first, lengths, best.tolist(), lead, strict=True)]
    out: list[list[tuple[str, float, str]]] = []
    at = 0
    for t, p in zip(texts, parts, strict=True):
        i, at = at, at + len(p)
        if not any(near[i:at]):
            out.append([])
        elif not _LOWER.search(t) and (len(_LONG.findall(t)) < 2 or (not t.isupper() and max(lead[i:at]) < name_margin)):
            out.append([])
        elif len(p) == 1:
            out.append([(LANGUAGES[first[i]], 0.5 + lead[i] / 2, p[0])])
        else:
            main = int((sims[i:at].T @ np.array(lengths[i:at], dtype=np.float32)).argmax())
            found: list[tuple[str, float, str]] = []
            for k, c in enumerate(p, i):
                sure = lengths[k] >= min_words and lead[k] >= margin and near[k]
                lang = first[k] if sure else main
                conf = sure_of[k][lang]
                if found and found[-1][0] == LANGUAGES[lang]:
                    found[-1] = (found[-1][0], max(found[-1][1], conf), found[-1][2] + " " + c)
                else:
                    found.append((LANGUAGES[lang], conf, c))
            out.append(found)
    return out


def labelled_sample(rows: DataFrame, per_language: int = 2000) -> list[tuple[str, str, int]]:
    """At most ``per_language`` distinct texts of each label of (t, lang), the most frequent of each hash slot, as (language, text, rows).

    The bound holds for what is collected; the counts behind it cover all rows. Texts of one word are left out.
    """
    rows = rows.where(F.col("lang").isin(LANGUAGES) & F.col("t").rlike(r"\p{L}{2,}[\s,'’\-]+\p{L}{2,}"))
    low = (1 << 43) - 1
    rows = rows.withColumn("h", F.xxhash64("t").bitwiseAND(F.lit(low)))
    counts = rows.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.shiftleft(F.least(F.col("n"), F.lit((1 << 19) - 1)), 43).bitwiseOR(F.col("h"))  # plain longs keep the aggregate in hash tables
    picked = counts.groupBy("lang", F.pmod("h", F.lit(per_language)).alias("slot")).agg(F.max(ranked).alias("r"))
    keys = [(k,) for k in {r["r"] & low for r in picked.select("r").collect()}]  # per_language x languages longs
    if not keys:
        return []
    wanted = rows.sparkSession.createDataFrame(keys, "h bigint")
    counted = rows.join(F.broadcast(wanted), "h", "left_semi").groupBy("lang", "h").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n"))
    return [(r["lang"], r["t"], r["n"]) for r in counted.collect()]


def fit_languages(segments: DataFrame, per_language: int = 2000) -> LanguageModel:
    """Model from the segments' sources, whose language the pair states, and the targets whose label agrees with the pair.

    ``per_language`` bounds the texts that are collected; which are taken depends on all rows.
    """
    side = lambda i: base_code(F.get(F.split("language_pair", "->"), F.lit(i)))
    target = F.when(label_language(F.col("target_lang")) == side(1), side(1))
    rows = segments.select(F.explode(F.array(F.struct(F.col("source_text").alias("t"), side(0).alias("lang")), F.struct(F.col("target_text").alias("t"), target.alias("lang")))).alias("x"))
    return LanguageModel.fit(labelled_sample(rows.select("x.t", "x.lang"), per_language))


def base_code(code: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(code), r"^(\p{L}{2})(?:[_\-].*)?$", 1))


def with_languages(df: DataFrame, model: LanguageModel, text: str, batch_columns: list[str], with_segments: bool = False) -> DataFrame:
    """``batch_columns`` plus ``langs`` (codes of the text's segments, joined by commas, '' if none), ``confidence`` (least
    over segments) and, if asked for, ``segments`` (array of language, confidence, text)."""
    shared = df.sparkSession.sparkContext.broadcast((model.idf, model.centroids, model.owner, model.reject, model.floors, model.letters))
    kept = df.select(*batch_columns, F.col(text).alias("_t"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_t")

    def run(batches):
        import pyarrow as pa

        here = LanguageModel(*shared.value)
        for b in batches:
            found = segment_languages(here, b.column(len(batch_columns)).to_pylist())
            told = {
                "langs": pa.array([",".join(dict.fromkeys(x[0] for x in f)) for f in found], pa.string()),
                "confidence": pa.array([min((x[1] for x in f), default=0.0) for f in found], pa.float64()),
            }
            if with_segments:
                kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("text", pa.string())]))
                told["segments"] = pa.array([[{"lang": a, "confidence": c, "text": t} for a, c, t in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(batch_columns))] + list(told.values()), names=[*batch_columns, *told])

    segments = ", segments array<struct<lang: string, confidence: double, text: string>>" if with_segments else ""
    return kept.mapInArrow(run, f"{fields}, langs string, confidence double{segments}")


def speech_of(segments: DataFrame) -> DataFrame:
    return segments.where(~F.coalesce(F.col("is_non_speech"), F.lit(False)) & F.col("target_text").isNotNull())


def text_languages(segments: DataFrame, model: LanguageModel | None = None, per_language: int = 2000) -> DataFrame:
    """Language of every speech text and of each of its parts: seg_uid, part, lang, confidence, part_text.

    Neighbouring clauses of one language are one part (0, 1, ...). A text near no language has one row with a null ``lang``
    and confidence 0. Null texts and non-speech rows are left out; a text delivered again unchanged gives its parts once.
    """
    rows = speech_of(segments).select("seg_uid", "target_text", "language_pair", "target_lang", "source_text").dropDuplicates(["seg_uid", "target_text"])
    found = with_languages(rows, model or fit_languages(speech_of(segments), per_language), "target_text", ["seg_uid"], with_segments=True)
    parts = found.select("seg_uid", F.posexplode_outer("segments").alias("part", "s"))
    return parts.select("seg_uid", F.coalesce("part", F.lit(0)).alias("part"), "s.lang", F.coalesce("s.confidence", F.lit(0.0)).alias("confidence"), F.col("s.text").alias("part_text"))


def language_faults(segments: DataFrame, model: LanguageModel | None = None, per_language: int = 2000) -> DataFrame:
    """Speech rows whose label is missing or wrong or whose text mixes languages: seg_uid, kind, lang, confidence.

    Null, blank and name-only texts, and non-speech rows, are no case; a null ``is_non_speech`` counts as speech; repeated
    deliveries give one row; extra columns are ignored; an empty table gives an empty result. The model is fitted on
    ``per_language`` labelled rows per language unless one is given.
    """
    speech = speech_of(segments)
    model = model or fit_languages(speech, per_language)
    rows = speech.withColumn("named", label_language(F.col("target_lang")))
    found = with_languages(rows, model, "target_text", ["seg_uid", "named"])
    kind = (
        F.when(F.col("langs").contains(","), "mixed").when(F.col("named").isNull(), "missing").when(F.col("named") != F.col("langs"), "wrong")
    )
    return (
        found.where("langs <> ''")
        .withColumn("kind", kind)
        .where("kind is not null")
        .select("seg_uid", "kind", F.explode(F.split("langs", ",")).alias("lang"), "confidence")
        .groupBy("seg_uid", "kind", "lang")
        .agg(F.max("confidence").alias("confidence"))
    )
