import random
import re

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import leakage
from cadenza.llm.leakage import WORD_BITS, Template, Words, bits, compare, leaked_items, least_windows, reparameterised_items, template_matches

PASSAGE = "Every Tuesday Zanlune Mirrekko rewound the valve wheel by hand, counting 202 turns for harbor effects and 343 for the windowless prologue of the copper school."
QUESTION = "Which crooked shelf of Paskollo held the mirror console while Shotho Harunter counted 7 copies of market choruses for the winter of 2096?"
ITEMS = [(1, PASSAGE, QUESTION, "Shelf 151."), (2, None, "", None)]
WIDTH = 5


def template_of(texts):
    names, others = np.zeros(1 << WORD_BITS, bool), np.zeros(1 << WORD_BITS, bool)
    for t in texts:
        w = Words([t])
        names[bits(w.hash[w.name & ~w.digit], WORD_BITS)] = True
        others[bits(w.hash[~w.name | w.digit], WORD_BITS)] = True
    return Template(names, others, WIDTH)


def matches(doc, item, template=None):
    """What the operator finds in a document, without the tables."""
    template = template or template_of([PASSAGE, QUESTION])
    d, i = Words([doc]), Words([item])
    dm, im = template.marks(d), template.marks(i)
    at = {}
    for p, k, s in zip(*template.windows(i, im), strict=True):
        at.setdefault(k, []).append((int(p), s))
    seeds = [(int(p), q, bool(s == z)) for p, k, s in zip(*template.windows(d, dm), strict=True) for q, z in at.get(k, [])]
    return compare(d.hash, dm, i.hash, im, seeds, WIDTH, 15, 8)


def leaks(doc):
    return any(matches(doc, t)[0] for t in (PASSAGE, QUESTION))


def edit(text, rng, kinds):
    tokens = text.split()
    for kind, at in kinds:
        if kind == "drop":
            tokens[at] = ""
        elif kind == "add":
            tokens[at] += " thing"
        else:
            tokens[at] = "thing"
    return " ".join(t for t in tokens if t)


def brute(doc, item, per_edit=8, least=15):
    """Longest stretch of the item within the allowance, over all pairs of spans (unit edits, slots not treated apart)."""
    d, i = (re.findall(r'\w+', t.lower()) for t in (doc, item))
    best = 0
    for a in range(len(i)):
        for s in range(len(d)):
            if d[s] != i[a]:
                continue
            row = {0: 0}
            width = len(i) - a
            dist = list(range(width + 1))
            for n, w in enumerate(d[s : s + width + 6], 1):
                new = [n]
                for m in range(1, width + 1):
                    new.append(min(dist[m] + 1, new[m - 1] + 1, dist[m - 1] + (w != i[a + m - 1])))
                dist = new
                best = max([best] + [m for m in range(least, width + 1) if dist[m] * per_edit <= m])
            del row
    return best if best >= least else 0


def test_whole_partial_edited_and_damaged_copies():
    rng = random.Random(1)
    noise = "We recorded the track 5 times. "
    assert leaks(noise + PASSAGE + " " + noise)
    assert leaks(noise + " ".join(QUESTION.split()[2:20]) + ". " + noise)
    assert not leaks(noise + " ".join(QUESTION.split()[:12]) + ". " + noise)
    assert leaks(PASSAGE.upper().replace(",", "")) and leaks(PASSAGE.lower()) and leaks(PASSAGE.replace("e", "é"))
    assert leaks("\n".join(f"[00:01:{i:02d}] speaker_02: " + " ".join(PASSAGE.split()[i * 6 : i * 6 + 6]) for i in range(5)))
    assert leaks(edit(PASSAGE, rng, [("drop", 9), ("change", 17), ("add", 22)]))
    assert not leaks(edit(PASSAGE, rng, [("change", i) for i in (2, 6, 10, 14, 18, 22)]))


OTHER = QUESTION.replace("Paskollo", "Vintarn").replace("Shotho Harunter", "Velrin Oskunter").replace(" 7 ", " 19 ").replace("2096", "2051")


def test_windows_a_stretch_keeps():
    assert least_windows(5, 15, 8) == 2 and least_windows(5, 8, 8) == 1


def test_slots_filled_otherwise_are_reparameterised_not_copied():
    copied, aligned, slots, consistent = matches(OTHER, QUESTION)
    assert copied == 0 and aligned >= 15 and slots == 5 and consistent
    thrice = "It took 12 takes on the first day and then 12 takes on the second day for 12 people who left."
    template = template_of([thrice])
    assert matches(thrice.replace("12", "30"), thrice, template)[::2] == (0, 3) and matches(thrice.replace("12", "30"), thrice, template)[3]
    assert matches(thrice.replace("12", "30").replace("then 30", "then 31"), thrice, template)[3] is False


def test_template_windows_find_what_plain_windows_miss():
    d, i = Words([OTHER]), Words([QUESTION])
    template = template_of([PASSAGE, QUESTION])
    _, keys, as_is = template.windows(d, template.marks(d))
    _, item_keys, item_as_is = template.windows(i, template.marks(i))
    assert len(set(keys.tolist()) & set(item_keys.tolist())) > len(set(as_is.tolist()) & set(item_as_is.tolist()))


def test_against_brute_force():
    rng = random.Random(8)
    for _ in range(25):
        kinds = [(rng.choice(["drop", "add", "change"]), at) for at in rng.sample(range(1, 22), rng.choice([0, 1, 2, 3, 5]))]
        doc = "So we begin here. " + edit(QUESTION, rng, kinds) + " And so it ends."
        want = brute(doc, QUESTION)
        got = matches(doc, QUESTION)[0]
        assert bool(got) == bool(want), (kinds, got, want)


def test_many_texts_at_once_are_read_as_each_alone():
    texts = [PASSAGE, None, "", "İstanbul’da 3 Katzen\x00x", "Ǆ ﬁn ½", "\ud800 lone", OTHER]
    together = Words(texts)
    for n, t in enumerate(texts):
        assert together.hash[together.owner == n].tolist() == Words([t]).hash.tolist()
        assert together.name[together.owner == n].tolist() == Words([t]).name.tolist()


def tables(spark):
    docs = [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (5, "x " * 50000 + QUESTION), (6, OTHER), (None, QUESTION)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    return docs, spark.createDataFrame(ITEMS, "item_id bigint, passage string, question string, answer string").withColumn("text", F.lit("clash"))


def test_table(spark):
    docs, items = tables(spark)
    assert {(r.doc_id, r.item_id) for r in leaked_items(docs, items).collect()} == {(1, 1), (2, 1), (5, 1), (None, 1)}
    assert [(r.doc_id, r.item_id, r.slots) for r in reparameterised_items(docs, items).collect()] == [(6, 1, 5)]
    assert leaked_items(docs, items.limit(0)).collect() == [] and leaked_items(docs.limit(0), items).collect() == []


def test_full_bit_maps_lose_nothing(spark, monkeypatch):
    docs, items = tables(spark)
    want = {(r.doc_id, r.item_id, r.copied) for r in template_matches(docs, items).where("copied > 0").collect()}
    monkeypatch.setattr(leakage, "bit_map", lambda found, size: np.ones(1 << size, bool))
    assert {(r.doc_id, r.item_id, r.copied) for r in template_matches(docs, items).where("copied > 0").collect()} == want
