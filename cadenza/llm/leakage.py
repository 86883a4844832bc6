"""Evaluation texts inside a training corpus, also where they were re-parameterised (problem 8).

Texts become word sequences; numbers, names and units become typed placeholders. Windows of template words are hashed and
joined with those of the evaluation items; what a document shares with one field of an item is then aligned word by word,
and the fillers of the slots decide: the same fillers make a copy, other fillers that stand consistently in the place of
the item's make a re-parameterised copy.

Nothing that grows with the items is broadcast. Documents are thinned out by three bit maps of fixed size (words that are
names in the items, other words of the items, window keys); a fuller map lets more through but loses nothing.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.shared import written

# Units of measure that may be swapped in a re-parameterised item, without diacritics.
UNITS = (
    "second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers "
    "kilometre kilometres mile miles foot feet inch inches gram grams kilogram kilograms pound pounds percent liter liters litre litres "
    "degree degrees dollar dollars euro euros segundo segundos minuto minutos hora horas dia dias semana semanas mes meses ano anos metro metros "
    "quilometro quilometros kilometro kilometros grado grados grau graus litro litros gramo gramos grama gramas"
).split()
LITERAL, NUMBER, NAME, UNIT = range(4)
WORD_BITS, KEY_BITS = 20, 22  # sizes of the bit maps: 128 kB and 512 kB
_MARK = re.compile(r"^[ \t]*(?:[\[(<]?\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?[\])>]?[ \t]*(?:-->[ \t]*)?)?(?:[-–—>]+[ \t]*)?(?:speaker[_ ]?\d+[ \t]*:)?", re.I | re.M)
_ACCENT = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff]+")
_WORD = re.compile(r"\w+")
_STOPS = ".?!:\n"
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C2
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of many texts at once: 64-bit hash, owner (number of the text), and whether each begins with a digit, with a
    capital, or with a capital inside its sentence. Case, diacritics, punctuation and line marks are gone."""

    def __init__(self, texts: list[str | None]):
        joined = "\n\x00\n".join(t.replace("\x00", " ") if t else "" for t in texts)
        joined = _MARK.sub(" ", joined)
        if not joined.isascii():
            joined = _ACCENT.sub("", unicodedata.normalize("NFKD", joined))
        low = joined.lower()
        if len(low) != len(joined):
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in joined)
        raw, a = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in (joined, low))
        seen = np.flatnonzero(np.bincount(raw))
        kinds = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, dtype=np.uint8)
        for c in seen.tolist():
            s = chr(c)
            kinds[c] = (1 if _WORD.match(s) else 0) | (2 if s.isdigit() else 0) | (4 if s.isupper() else 0) | (8 if s in _STOPS else 0)
        kind = kinds[raw]
        inside = (kind & 1).astype(bool)
        edges = np.diff(np.r_[False, inside, False].astype(np.int8))
        first, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        n = len(first)
        self.owner = (np.cumsum(raw == 0) if n else np.zeros(0, np.int64))[first] if n else np.zeros(0, np.int64)
        self.digit, self.upper = (kind[first] & 2).astype(bool), (kind[first] & 4).astype(bool)
        stops = np.cumsum((kind & 8) > 0)[first] if n else np.zeros(0, np.int64)
        begins = np.r_[True, (self.owner[1:] != self.owner[:-1]) | (stops[1:] != stops[:-1])] if n else np.zeros(0, bool)
        self.name = self.upper & ~begins
        if not n:
            self.hash = np.zeros(0, np.uint64)
            return
        length = end - first
        at = np.cumsum(np.r_[0, length[:-1]])
        power = np.ones(int(length.max()), np.uint64)
        power[1:] = _C1
        power = np.cumprod(power, dtype=np.uint64)
        place = np.arange(int(length.sum())) - np.repeat(at, length)
        self.hash = _mixed(np.add.reduceat((a[inside].astype(np.uint64) + np.uint64(1)) * power[place], at) + length.astype(np.uint64))


def word_hash(word: str) -> int:
    return int(Words([word]).hash[0])


_UNIT_HASHES = np.sort(Words([" ".join(UNITS)]).hash)


def bits(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - size)).astype(np.int64)


def bit_map(found: DataFrame, size: int) -> np.ndarray:
    """Bit map of a column ``bit``. Bits are gathered 64 to a row, so that what is collected is bounded by the map's size."""
    rows = found.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("m")).collect()
    out = np.zeros(1 << (size - 6), np.int64)
    for r in rows:
        out[r["at"]] = r["m"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


class Template:
    """Marks of words. A word of the items always gets the same mark, as a name if it is one anywhere in them, whatever its
    case in a document; a capital makes names of the others."""

    def __init__(self, names: np.ndarray, others: np.ndarray, width: int = 5):
        self.names, self.others, self.width = names, others, width

    def marks(self, w: Words) -> np.ndarray:
        at = bits(w.hash, WORD_BITS)
        unit = _UNIT_HASHES[np.minimum(np.searchsorted(_UNIT_HASHES, w.hash), len(_UNIT_HASHES) - 1)] == w.hash
        named = self.names[at] | (w.upper & ~self.others[at])
        return np.where(w.digit, NUMBER, np.where(named, NAME, np.where(unit, UNIT, LITERAL))).astype(np.uint8)

    def windows(self, w: Words, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, key, hash of the words as they are) of each window inside one text.

        The key is that of the template; windows with fewer than two literal words are all slot and keep their words.
        """
        n = len(w.hash) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        slot = np.where(marks == LITERAL, w.hash, marks.astype(np.uint64) * _C2)
        as_is, key = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        for k in range(self.width):
            as_is = as_is * _C1 + w.hash[k : k + n]
            key = key * _C1 + slot[k : k + n]
        literal = np.cumsum(np.r_[0, marks == LITERAL])
        as_is, key = _mixed(as_is), _mixed(key)
        key = np.where(literal[self.width :] - literal[: -self.width] >= 2, key, as_is ^ _C1)
        at = np.flatnonzero(w.owner[: n] == w.owner[self.width - 1 :])
        return at, key[at], as_is[at]


def _reach(doc: list, item: list, kinds: list, item_kinds: list, i: int, j: int, step: int, limit: int) -> list[int]:
    """Item words reached from (i, j) in direction ``step`` with 0, 1, ... ``limit`` edits (furthest-reaching diagonals)."""
    n, m = (len(doc) - i, len(item) - j) if step > 0 else (i + 1, j + 1)
    out: list[int] = []
    front = {0: 0}
    for _ in range(limit + 1):
        slid: dict[int, int] = {}
        for d, y in front.items():
            x = y + d
            while x < n and y < m and doc[i + step * x] == item[j + step * y]:
                x += 1
                y += 1
            slid[d] = y
        out.append(max(out[-1] if out else 0, max(slid.values(), default=0)))
        front = {}
        for d, y in slid.items():
            x = y + d
            steps = [(d - 1, y + 1), (d + 1, y)]  # dropped from the document, added to it
            if x < n and y < m:
                kind = kinds[i + step * x]
                if kind not in (NUMBER, NAME) or kind != item_kinds[j + step * y]:
                    steps.append((d, y + 1))
            for nd, ny in steps:
                if ny <= m and 0 <= ny + nd <= n and ny > front.get(nd, -1):
                    front[nd] = ny
    return out


def longest_stretch(doc: list, item: list, seeds: list[tuple[int, int]], kinds: list, item_kinds: list, per_edit: int = 8, least: int = 15) -> int:
    """Words of the longest stretch of ``item`` held by ``doc`` with at most one edit in ``per_edit`` words; 0 if under ``least``.

    ``seeds`` are (document, item) positions of windows of equal words. Every allowed stretch holds one, so each run of
    equal words is extended both ways, edit by edit, and the two sides are combined. A slot filled by another number or
    name is no single change: it takes two edits, a drop and an addition.
    """
    best = 0
    limit = len(item) // per_edit
    for i, j in seeds:
        if i and j and doc[i - 1] == item[j - 1]:
            continue
        after = _reach(doc, item, kinds, item_kinds, i, j, 1, limit)
        if j and after[-1] + j <= best:
            continue
        before = _reach(doc, item, kinds, item_kinds, i - 1, j - 1, -1, limit)
        for e, a in enumerate(after):
            for f, b in enumerate(before):
                if (e + f) * per_edit <= a + b:
                    best = max(best, a + b)
    return best if best >= least else 0


def least_windows(width: int, least: int, per_edit: int) -> int:
    """Windows that a stretch of ``least`` words or more keeps for certain: each edit spoils ``width`` of them at most."""
    return max(1, min(n - width + 1 - width * (n // per_edit) for n in range(least, least + 2 * per_edit)))


def template_run(seeds: list[tuple[int, int, bool]], width: int) -> tuple[int, list[tuple[int, int]]]:
    """(words, windows) of the longest stretch of which every word lies in a window shared at the same distance."""
    best, run = (0, []), []
    for i, j, _ in sorted(seeds, key=lambda x: (x[0] - x[1], x[0])):
        if run and (i - j != run[-1][0] - run[-1][1] or i - run[-1][0] > width):
            run = []
        run = [*run, (i, j)]
        if i - run[0][0] + width > best[0]:
            best = (i - run[0][0] + width, run)
    return best


def substitutions(doc: list, item: list, kinds: list, seeds: list[tuple[int, int]], width: int) -> tuple[int, bool]:
    """Slots of the item with another filler in the document, and whether equal fillers have equal ones throughout."""
    told: dict[int, set] = {}
    changed: set[int] = set()
    for i, j in seeds:
        for k in range(width):
            if kinds[j + k] != LITERAL:
                told.setdefault(item[j + k], set()).add(doc[i + k])
                if doc[i + k] != item[j + k]:
                    changed.add(j + k)
    return len(changed), all(len(x) == 1 for x in told.values())


def compare(doc: np.ndarray, marks: np.ndarray, item: np.ndarray, item_marks: np.ndarray, seeds: list[tuple[int, int, bool]], width: int, least: int, per_edit: int) -> tuple[int, int, int, bool]:
    """(words copied, words of the template in common, slots filled otherwise, these consistent) of a region and an item field."""
    d, i = doc.tolist(), item.tolist()
    ik = item_marks.tolist()
    if any(same for *_, same in seeds):
        copied = longest_stretch(d, i, [(x, y) for x, y, same in seeds if same], marks.tolist(), ik, per_edit, least)
        if copied:
            return copied, copied, 0, True
    n, run = template_run(seeds, width)
    return (0, n, *substitutions(d, i, ik, run, width)) if n >= least else (0, 0, 0, False)


def item_fields(items: DataFrame) -> DataFrame:
    """item_id, field, text of the fields that are compared; a field of an item delivered twice counts once."""
    fields = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(c).alias("text")) for i, c in enumerate(("passage", "question", "answer"))]))
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), fields.alias("f")).select("item_id", "f.field", "f.text").where("text is not null").distinct()


def item_template(fields: DataFrame, width: int) -> Template:
    """Marks of all words of the items, gathered into two bit maps."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            w = Words(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(bits(w.hash, WORD_BITS)), pa.array(w.name & ~w.digit)], names=["bit", "name"])

    told = written(fields.select("text").mapInArrow(run, "bit bigint, name boolean").groupBy("bit").agg(F.bool_or("name").alias("name")), "item-words")
    return Template(bit_map(told.where("name"), WORD_BITS), bit_map(told.where("not name"), WORD_BITS), width)


def _regions(at: np.ndarray, reach: int, width: int, n: int) -> list[tuple[int, int, int, int]]:
    """(first hit, end of hits, first word, end) of stretches of ``n`` words around hits; hits farther apart than two reaches part them."""
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > 2 * reach) + 1
    starts, ends = np.r_[0, cuts].tolist(), np.r_[cuts, len(at)].tolist()
    return [(s, e, max(0, int(at[s]) - reach), min(n, int(at[e - 1]) + width + reach)) for s, e in zip(starts, ends, strict=True)]


def document_regions(documents: DataFrame, template: Template, keys: np.ndarray, reach: int) -> DataFrame:
    """Stretches of documents around windows whose key may be an item's: rid, doc_id, words, marks, hits (key, position, as it is)."""
    shared = documents.sparkSession.sparkContext.broadcast((np.packbits(template.names), np.packbits(template.others), np.packbits(keys), template.width))

    def run(batches):
        import pyarrow as pa

        names, others, wanted = (np.unpackbits(x).view(bool) for x in shared.value[:3])
        here = Template(names, others, shared.value[3])
        hit = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("as_is", pa.int64())])
        for b in batches:
            docs, texts = b.column(0), b.column(1).to_pylist()
            for low in range(0, len(texts), 64):
                w = Words(texts[low : low + 64])
                marks = here.marks(w)
                at, key, as_is = here.windows(w, marks)
                on = np.flatnonzero(wanted[bits(key, KEY_BITS)])
                at, key, as_is = at[on], key[on].view(np.int64), as_is[on].view(np.int64)
                owner = w.owner[at]
                rows = []
                for t in np.unique(owner).tolist():
                    mine = slice(*np.searchsorted(owner, [t, t + 1]).tolist())
                    first, end = np.searchsorted(w.owner, [t, t + 1]).tolist()
                    pos, k, s = at[mine] - first, key[mine], as_is[mine]
                    for x, y, a, z in _regions(pos, reach, here.width, end - first):
                        hits = [{"key": p, "at": q, "as_is": r} for p, q, r in zip(k[x:y].tolist(), (pos[x:y] - a).tolist(), s[x:y].tolist(), strict=True)]
                        rows.append((docs[low + t].as_py(), w.hash[first + a : first + z].tobytes(), marks[first + a : first + z].tobytes(), hits, a))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(hit), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "words", "marks", "hits", "first"])

    found = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    found = found.mapInArrow(run, "doc_id bigint, words binary, marks binary, hits array<struct<key: bigint, at: int, as_is: bigint>>, first int")
    return found.select(F.xxhash64("doc_id", "words", "first").alias("rid"), "doc_id", "words", "marks", "hits")


def template_matches(documents: DataFrame, items: DataFrame, width: int = 5, least: int = 15, per_edit: int = 8) -> DataFrame:
    """What documents share with the passages, questions and answers of items: doc_id, item_id, copied, aligned, slots, consistent.

    Template windows of documents are hash-joined with those of the items. Regions with as many windows filled alike as any
    allowed stretch keeps are aligned: ``copied`` is the length of the longest stretch held word by word with at most one
    word in ``per_edit`` changed, dropped or added, 0 if under ``least``; a slot filled by another number or name counts as
    two edits. Without a copy ``aligned`` is the length of the longest stretch of the item's template in one piece, of
    ``least`` words or more, ``slots`` how many of its slots are filled otherwise, ``consistent`` whether equal fillers of
    the item have equal fillers throughout.

    Null and blank texts and null item fields hold nothing; equal documents each give their rows, a doc_id delivered twice
    gives them once; a null doc_id is kept as one; no items, or no documents, give an empty result; extra columns are
    ignored. Very long texts are read whole.
    """
    fields = written(item_fields(items), "item-fields")
    template = item_template(fields, width)
    maps = items.sparkSession.sparkContext.broadcast((np.packbits(template.names), np.packbits(template.others)))

    def index(batches):
        import pyarrow as pa

        here = Template(*(np.unpackbits(x).view(bool) for x in maps.value), width)
        kinds = {"item_id": pa.int64(), "field": pa.int32(), "item_words": pa.binary(), "item_marks": pa.binary(), "windows": pa.list_(pa.struct([("key", pa.int64()), ("item_at", pa.int32()), ("item_as_is", pa.int64())]))}
        for b in batches:
            for i, text in enumerate(b.column(2).to_pylist()):
                w = Words([text])
                marks = here.marks(w)
                found = [{"key": k, "item_at": p, "item_as_is": s} for p, k, s in zip(*(x.tolist() for x in (lambda a, k, s: (a, k.view(np.int64), s.view(np.int64)))(*here.windows(w, marks))), strict=True)]
                row = (b.column(0)[i].as_py(), b.column(1)[i].as_py(), w.hash.tobytes(), marks.tobytes(), found)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds.values(), strict=True)], names=list(kinds))

    table = "item_id bigint, field int, item_words binary, item_marks binary, windows array<struct<key: bigint, item_at: int, item_as_is: bigint>>"
    told = written(fields.mapInArrow(index, table), "item-index")
    places = told.select("item_id", "field", F.inline("windows"))
    keys = bit_map(places.select(F.shiftrightunsigned("key", 64 - KEY_BITS).alias("bit")), KEY_BITS)
    longest = told.agg(F.max(F.octet_length("item_words"))).first()[0]
    reach = (longest or 0) // 8
    reach += reach // per_edit + 1
    regions = written(document_regions(documents, template, keys, reach), "leak-regions")

    seed = F.struct((F.col("at") - F.col("item_at")).alias("d"), "at", "item_at", (F.col("as_is") == F.col("item_as_is")).alias("same"))
    seeds = regions.select("rid", F.inline("hits")).join(places, "key").groupBy("rid", "item_id", "field").agg(F.array_sort(F.collect_set(seed)).alias("seeds"))

    def longer(run, x):
        goes_on = (x["d"] == run["d"]) & (x["at"] - run["last"] <= width)
        start = F.when(goes_on, run["start"]).otherwise(x["at"])
        return F.struct(x["d"].alias("d"), start.alias("start"), x["at"].alias("last"), F.greatest(run["best"], x["at"] - start + width).alias("best"))

    none = F.struct(F.lit(None).cast("int").alias("d"), F.lit(0).alias("start"), F.lit(0).alias("last"), F.lit(0).alias("best"))
    alike = F.size(F.filter("seeds", lambda x: x["same"])) >= least_windows(width, least, per_edit)
    likely = seeds.where(alike | (F.aggregate("seeds", none, longer)["best"] >= least))
    pairs = likely.join(regions.select("rid", "doc_id", "words", "marks"), "rid").join(told.drop("windows"), ["item_id", "field"])

    def align(batches):
        import pyarrow as pa

        names = ["doc_id", "item_id", "copied", "aligned", "slots", "consistent"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        for b in batches:
            out = []
            for doc, item, words, marks, item_words, item_marks, hits in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                found = compare(
                    np.frombuffer(words, np.uint64), np.frombuffer(marks, np.uint8), np.frombuffer(item_words, np.uint64), np.frombuffer(item_marks, np.uint8),
                    sorted((h["at"], h["item_at"], h["same"]) for h in hits), width, least, per_edit,
                )
                if found[1]:
                    out.append((doc, item, *found))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    found = pairs.select("doc_id", "item_id", "words", "marks", "item_words", "item_marks", "seeds").mapInArrow(
        align, "doc_id bigint, item_id bigint, copied int, aligned int, slots int, consistent boolean"
    )
    best = F.max(F.struct("copied", F.col("consistent").cast("int").alias("c"), "aligned", (-F.col("slots")).alias("s"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.copied", "b.aligned", (-F.col("b.s")).alias("slots"), (F.col("b.c") == 1).alias("consistent"))


def leaked_items(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents that hold a long enough, faithful enough stretch of an item: doc_id, item_id, n_words."""
    return template_matches(documents, items, **options).where("copied > 0").select("doc_id", "item_id", F.col("copied").alias("n_words"))


def reparameterised_items(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Documents with the template of an item whose slots are filled otherwise, equal fillers by equal ones: doc_id, item_id, n_words, slots."""
    found = template_matches(documents, items, **options).where("copied = 0 and consistent and slots > 0")
    return found.select("doc_id", "item_id", F.col("aligned").alias("n_words"), "slots")
