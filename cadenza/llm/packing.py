"""Texts of varying length into containers of fixed capacity with little unused room (problem 7).

The items of a capacity are known by their length alone, so the plan is made on the histogram of lengths, which has no more
rows than the capacity. The sums of one, two and three lengths are indexed; for each length the gap it leaves is looked up
there, and combinations that fill a container exactly are consumed as often as the counts allow. The rest is placed
best-fit. The plan is then dealt out to the documents in parallel.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.sources.shared import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of every non-blank text, read whole. A doc_id delivered more than once counts once (its longest)."""

    def run(batches):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        for b in batches:
            texts = b.column(1).to_pylist()
            counts: list[int] = []
            for at in range(0, len(texts), 64):
                counts += [len(e) for e in t.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    rows = documents.select("doc_id", "text").where(F.col("text").rlike(r"[^\s\p{Z}\p{C}]"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


class Sums:
    """Index of the sums of one, two and three lengths: for each sum a length that is part of it, the longest at first.

    Counts only fall, so what is no sum now never will be one; an entry whose lengths are used up is looked for anew.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        top = len(left)
        lengths = np.flatnonzero(left[1:]) + 1
        self.pair = np.zeros(top, dtype=np.int32)
        self.triple = np.zeros(top, dtype=np.int32)
        for a in lengths.tolist():
            self.pair[a + lengths[: np.searchsorted(lengths, min(a, top - 1 - a), "right")]] = a
        pairs = np.flatnonzero(self.pair)
        for a in lengths.tolist():
            self.triple[a + pairs[: np.searchsorted(pairs, top - 1 - a, "right")]] = a

    def filling(self, gap: int, parts: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """``parts`` lengths (1, 2 or 3) that sum to ``gap`` within the counts left beside ``used``."""
        if gap <= 0:
            return None
        if parts == 1:
            return (gap,) if self.left[gap] > used.get(gap, 0) else None
        index = self.pair if parts == 2 else self.triple
        a = int(index[gap])
        if not a:
            return None
        found = self._with(a, gap, parts, used)
        if found:
            return found
        free = self.left[: gap + 1].copy()
        for x, k in used.items():
            if x <= gap:
                free[x] -= k
        there = free > 0
        there[0] = False
        if parts == 2:
            both = there & there[::-1]
            if gap % 2 == 0 and free[gap // 2] < 2:
                both[gap // 2] = False
            longest = gap - int(both.argmax()) if both.any() else 0
            if longest or all(self.left[x] >= k + parts for x, k in used.items()):  # else only what is in use stands in the way
                index[gap] = longest
            return (longest, gap - longest) if longest else None
        may = there & (self.pair[: gap + 1][::-1] > 0)
        for x in np.flatnonzero(may)[::-1].tolist():
            if x * 3 < gap:  # the longest of three is a third at least
                break
            found = self._with(x, gap, parts, used)
            if found:
                index[gap] = x
                return found
        if all(self.left[x] >= k + parts for x, k in used.items()):
            index[gap] = 0
        return None

    def _with(self, a: int, gap: int, parts: int, used: dict[int, int]) -> tuple[int, ...] | None:
        if self.left[a] <= used.get(a, 0):
            return None
        rest = self.filling(gap - a, parts - 1, {**used, a: used.get(a, 0) + 1})
        return (a, *rest) if rest else None


class Plan:
    """Patterns (lengths of one container, how many such containers). Every length is used as often as it is there."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.sums = Sums(self.left)
        self._exact()
        self._best_fit()

    def _take(self, lengths: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(self.left[x]) // k for x, k in need.items())
        for x, k in need.items():
            self.left[x] -= k * times
        self.patterns.append((lengths, times))

    def _exact(self) -> None:
        full = self.capacity
        if self.left[full]:
            self._take((full,))
        for parts in (1, 2, 3):
            for a in range(full - 1, 0, -1):
                while self.left[a]:
                    rest = self.sums.filling(full - a, parts, {a: 1})
                    if rest is None:
                        break
                    self._take((a, *rest))

    def _best_fit(self) -> None:
        """Longest first, each into the container with the least room that still holds it; equal ones together."""
        room: list[int] = []
        open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

        def add(gap: int, lengths: tuple[int, ...], n: int) -> None:
            if gap not in open_:
                insort(room, gap)
                open_[gap] = []
            open_[gap].append((lengths, n))

        for a in np.flatnonzero(self.left)[::-1].tolist():
            n = int(self.left[a])
            while n:
                at = bisect_left(room, a)
                if at == len(room):
                    each = self.capacity // a
                    whole, some = divmod(n, each)
                    if whole:
                        add(self.capacity - each * a, (a,) * each, whole)
                    if some:
                        add(self.capacity - some * a, (a,) * some, 1)
                    break
                gap = room[at]
                lengths, m = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    room.pop(at)
                each = min(gap // a, n)
                k = min(m, n // each)
                if m > k:
                    add(gap, lengths, m - k)
                add(gap - each * a, lengths + (a,) * each, k)
                n -= k * each
        self.left[:] = 0
        for groups in open_.values():
            self.patterns += groups

    def places(self) -> list[tuple[int, list[int], list[int], list[int]]]:
        """(length, first ranks, first containers, containers in a row) - the r-th item of a length finds its place there."""
        out: dict[int, tuple[list[int], list[int], list[int], list[int]]] = {}
        first = 0
        for lengths, times in self.patterns:
            for x in sorted(set(lengths)):
                ranks, base, rows, total = out.setdefault(x, ([], [], [], [0]))
                for _ in range(lengths.count(x)):
                    ranks.append(total[0])
                    base.append(first)
                    rows.append(times)
                    total[0] += times
            first += times
        return [(x, ranks, base, rows) for x, (ranks, base, rows, _) in sorted(out.items())]


def salts_of(n: int, most: int = 200_000) -> int:
    """Parts in which the items of one length are ranked: no part is expected to hold more than ``most``."""
    return -(-n // most)


def ranked(items: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """``rank`` (0, 1, ...) of each row among those of equal ``by``; a frequent value is counted in ``salts`` parts (a column)."""
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(*key), F.col("salts")))
    parts = salted.groupBy(*by, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*key)) - 1
    return salted.withColumn("_in", inside).join(offsets, [*by, "_salt"]).withColumn("rank", F.col("_before") + F.col("_in")).drop("_salt", "_in", "_before")


def fill_containers(documents: DataFrame, specs: DataFrame, tokenizer: str = TOKENIZER, at_once: int = 100) -> DataFrame:
    """Container of every non-blank document for each capacity: spec_id, doc_id, piece, n_tokens, container.

    A document stays whole unless it alone exceeds the capacity; then it gives full containers of its own and a last piece
    that is placed like any item. Null and blank texts are no items; texts without tokens take no room and share one
    container; ties in length are settled by doc_id; a null or non-positive capacity holds nothing and gives no rows; empty
    tables give an empty result; extra columns are ignored. Capacities are planned ``at_once`` at a time, each from its
    histogram, which has no more rows than the capacity.
    """
    spark = documents.sparkSession
    rows = sorted((tuple(r) for r in specs.select(F.col("spec_id").cast("int"), F.col("capacity_tokens").cast("bigint")).where("capacity_tokens > 0").distinct().collect()), key=lambda r: (r[0] is None, r))
    sizes = written(token_counts(documents, tokenizer), "token_counts")
    out = spark.createDataFrame([], "spec_id int, doc_id bigint, piece bigint, n_tokens bigint, container string")
    for low in range(0, len(rows), at_once):
        out = out.unionByName(_filled(sizes, list(enumerate(rows[low : low + at_once], low))))
    return out


def _filled(sizes: DataFrame, specs: list[tuple[int, tuple[int | None, int]]]) -> DataFrame:
    spark = sizes.sparkSession
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).cast("int").alias("spec_id"), F.lit(cap).cast("bigint").alias("cap")) for k, (i, cap) in specs])
    each = sizes.select("doc_id", "n_tokens", F.explode(kinds).alias("s")).select("doc_id", "n_tokens", "s.*").withColumn("whole", F.floor(F.col("n_tokens") / F.col("cap")).cast("bigint"))
    over = F.col("n_tokens") > F.col("cap")
    full = each.where(over).select("spec_id", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"), F.col("cap").alias("n_tokens"))
    full = full.withColumn("container", F.concat_ws("-", F.lit("d"), "doc_id", "piece"))
    # a text of exactly the capacity is one item; of a longer one what is left is an item
    items = each.select(
        "k", "spec_id", "doc_id", F.when(over, F.col("whole")).otherwise(0).cast("bigint").alias("piece"),
        F.when(over, F.col("n_tokens") - F.col("whole") * F.col("cap")).otherwise(F.col("n_tokens")).alias("n_tokens"),
    ).where((F.col("n_tokens") > 0) | (F.col("piece") == 0))
    counts: dict[int, dict[int, int]] = {k: {} for k, _ in specs}
    for r in items.groupBy("k", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect():  # capacity + 1 rows a capacity at most
        counts[r["k"]][r["n_tokens"]] = r["n"]
    places: list[tuple] = []
    for k, (_, cap) in specs:
        empty = counts[k].pop(0, 0)
        places += [(k, x, salts_of(counts[k][x]), *where) for x, *where in Plan(counts[k], cap).places()]
        places += [(k, 0, salts_of(empty), [0], [0], [1])] if empty else []
    dealt = F.broadcast(spark.createDataFrame(places, "k int, n_tokens bigint, salts bigint, ranks array<bigint>, base array<bigint>, times array<bigint>"))
    placed = ranked(items.join(dealt, ["k", "n_tokens"]), ["k", "n_tokens"], ["doc_id", "piece"])
    at = F.size(F.filter("ranks", lambda x: x <= F.col("rank"))) - 1
    number = F.col("base")[F.col("at")] + (F.col("rank") - F.col("ranks")[F.col("at")])
    placed = placed.withColumn("at", at).select(
        "spec_id", "doc_id", "piece", "n_tokens", F.when(F.col("n_tokens") == 0, "empty").otherwise(F.concat(F.lit("c-"), number.cast("string"))).alias("container")
    )
    return placed.unionByName(full)


def container_fill(placed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, items and share of used room per capacity."""
    total = placed.groupBy("spec_id").agg(F.countDistinct("container").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    return total.join(specs.select("spec_id", "capacity_tokens").distinct(), "spec_id").select(
        "spec_id", "containers", "items", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used")
    )
