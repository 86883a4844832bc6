import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm.packing import TOKENIZER, Plan, Sums, container_fill, fill_containers, ranked, token_counts

DOCS = "doc_id bigint, text string, lang string"
SPECS = "spec_id int, spec_name string, capacity_tokens int"


def check(histogram, capacity):
    plan = Plan(dict(histogram), capacity)
    used = {}
    for lengths, times in plan.patterns:
        assert sum(lengths) <= capacity and times > 0
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == {k: v for k, v in histogram.items() if v}
    return sum(t for _, t in plan.patterns)


def best_fit(histogram, capacity):
    rooms = []
    for x in sorted((k for k, v in histogram.items() for _ in range(v)), reverse=True):
        i = min((i for i, r in enumerate(rooms) if r >= x), key=lambda i: rooms[i], default=None)
        if i is None:
            rooms.append(capacity - x)
        else:
            rooms[i] -= x
    return len(rooms)


def test_plans_use_every_item_once_and_stay_near_the_bound():
    rng = random.Random(4)
    for capacity in (10, 64, 512):
        for _ in range(8):
            h = {rng.randint(1, capacity): rng.choice([1, 2, 7, 60]) for _ in range(rng.randint(1, 40))}
            assert check(h, capacity) <= 1.1 * best_fit(h, capacity) + 1
    assert check({}, 8) == 0 and check({8: 3}, 8) == 3 and check({5: 4, 3: 4}, 8) == 4 and check({4: 5}, 8) == 3 and check({5: 2, 2: 1, 1: 3}, 8) == 2
    assert check({i: 1000 for i in range(1, 257)}, 512) <= math.ceil(1000 * 256 * 257 / 2 / 512) + 1


def test_index_of_sums_against_all_combinations():
    rng = random.Random(2)
    for _ in range(60):
        left = np.zeros(41, dtype=np.int64)
        for _ in range(rng.randint(0, 9)):
            left[rng.randint(1, 40)] = rng.choice([1, 1, 2, 5])
        sums = Sums(left)
        for _ in range(6):
            stock = [x for x in range(41) for _ in range(min(int(left[x]), 3))]
            for parts in (1, 2, 3):
                can = {sum(c) for c in itertools.combinations(stock, parts)}
                for gap in range(1, 41):
                    got = sums.filling(gap, parts, {})
                    assert (got is not None) == (gap in can)
                    if got:
                        assert sum(got) == gap and len(got) == parts and all(got.count(x) <= left[x] for x in got)
            there = np.flatnonzero(left)
            if len(there):
                left[rng.choice(there.tolist())] -= 1


def test_places_are_a_bijection():
    plan = Plan({5: 3, 3: 4, 2: 9}, 8)
    seats = {}
    for x, ranks, base, times in plan.places():
        for start, first, n in zip(ranks, base, times, strict=True):
            for i in range(n):
                seats.setdefault(first + i, []).append(x)
    assert sorted(x for s in seats.values() for x in s) == sorted([5] * 3 + [3] * 4 + [2] * 9) and all(sum(s) <= 8 for s in seats.values())


def test_ranks_count_each_value_once(spark):
    df = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(300)], "k bigint, v bigint")
    got = {}
    for r in ranked(df.withColumn("salts", F.lit(8)), ["v"], ["k"]).collect():
        got.setdefault(r.v, []).append(r["rank"])
    assert all(sorted(x) == list(range(len(x))) for x in got.values())


@pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no tokenizer files here")
def test_containers(spark):
    rows = [(i, "one two three " * (i % 9 + 1), "en") for i in range(60)] + [(100, "long words everywhere " * 40, "en"), (101, None, "en"), (102, " \n ", None), (3, "one two three " * 4, "en"), (103, "word " * 20000, None)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as piece", "2 as rank", "3 as container")
    specs = spark.createDataFrame([(1, "a", 32), (2, "b", 128), (3, "c", None), (4, "d", 0), (1, "a", 32)], SPECS)
    placed = fill_containers(docs, specs)
    rows = placed.collect()
    sizes = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    assert set(sizes) == {*range(60), 100, 103}
    for spec, cap in ((1, 32), (2, 128)):
        mine = [r for r in rows if r.spec_id == spec]
        room = {}
        for r in mine:
            room[r.container] = room.get(r.container, 0) + r.n_tokens
        assert max(room.values()) <= cap
        for doc, n in sizes.items():
            parts = sorted((r.piece, r.n_tokens) for r in mine if r.doc_id == doc)
            assert sum(x for _, x in parts) == n and len(parts) == max(1, math.ceil(n / cap)) and [p for p, _ in parts] == list(range(len(parts)))
        assert len(room) <= math.ceil(sum(sizes.values()) / cap) + 2
    assert {r.spec_id for r in container_fill(placed, specs).collect()} == {1, 2} == {r.spec_id for r in rows}
    assert fill_containers(docs.limit(0), specs).collect() == [] and fill_containers(docs, specs.limit(0)).collect() == []
