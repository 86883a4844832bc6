"""Order-dependent utterance building: flush, split and smoothing rules that look at running state.

Rows are first cut into speech blocks at pauses (in parallel, whatever the size of a key); inside a sorted partition the
blocks then stream past, one row at a time, so no group is ever held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.sequences import chunked_runs

Word = tuple  # word, start and end in ms, and what else travels with it


def flushed(words: Iterator[Word], gap: int = 800, target: int = 10_000) -> Iterator[list[Word]]:
    """Utterances: a new one after a pause over ``gap``, or once ``target`` is reached and the last word ends a sentence."""
    held: list[Word] = []
    for w in words:
        if held and (w[1] - held[-1][2] > gap or (held[-1][2] - held[0][1] >= target and held[-1][0].rstrip()[-1:] in tuple(".?!"))):
            yield held
            held = []
        held.append(w)
    if held:
        yield held


def split_long(words: list[Word], most: int = 15_000) -> list[list[Word]]:
    """Split while longer than ``most``: best after a sentence mark (100), a clause mark (50) or a long pause (10 a second),
    less the distance of the cut from the middle in seconds; in the middle if nothing scores. One word stays whole."""
    out, todo = [], [words]
    while todo:
        part = todo.pop()
        if len(part) < 2 or part[-1][2] - part[0][1] <= most:
            out.append(part)
            continue
        middle = (part[0][1] + part[-1][2]) / 2
        best, at = -1.0, len(part) // 2 - 1
        for i, w in enumerate(part[:-1]):
            mark = w[0].rstrip()[-1:]
            score = 100.0 if mark and mark in ".?!" else 50.0 if mark and mark in ",;:" else (part[i + 1][1] - w[2]) / 100
            score -= abs(w[2] - middle) / 1000
            if score > best:
                best, at = score, i
        todo += [part[at + 1 :], part[: at + 1]]
    return out


def smoothed(labels: list[str], spans: list[tuple[int, int]], few: int = 3, brief: int = 700) -> list[str]:
    """Runs of fewer than ``few`` words and under ``brief`` ms join the nearer neighbour in time (left on ties), first run
    first, until none is left; a single run stays."""
    labels = list(labels)
    while True:
        runs: list[list[int]] = []
        for i, x in enumerate(labels):
            if runs and labels[runs[-1][0]] == x:
                runs[-1].append(i)
            else:
                runs.append([i])
        weak = next((k for k, r in enumerate(runs) if len(runs) > 1 and len(r) < few and spans[r[-1]][1] - spans[r[0]][0] < brief), None)
        if weak is None:
            return labels
        r = runs[weak]
        left = spans[r[0]][0] - spans[runs[weak - 1][-1]][1] if weak else None
        right = spans[runs[weak + 1][0]][0] - spans[r[-1]][1] if weak + 1 < len(runs) else None
        other = runs[weak - 1] if right is None or (left is not None and left <= right) else runs[weak + 1]
        for i in r:
            labels[i] = labels[other[0]]


def utterances(lines: DataFrame, key: str, gap: int = 800, target: int = 10_000, most: int = 15_000) -> DataFrame:
    """Lines (key, row_id, start, end, text) grouped into utterances: key, first_id, last_id, n, start_ms, end_ms, text.

    Null times or texts give no utterance. Blocks between pauses are found in time buckets; each streams through the flush
    and split rules in its sorted partition. Equal starts are taken in order of row_id.
    """
    rows = lines.where("start is not null and end is not null and text is not null")
    same = lambda prev, cur: cur["start"] - prev["end"] <= gap
    blocks = chunked_runs(rows, [key], ["start", "row_id"], ["end"], same)
    blocks = blocks.select(key, F.col("run.start").alias("b"), F.col("run.row_id").alias("bid"), "start", "row_id", "end", "text")
    blocks = blocks.repartition(key, "b", "bid").sortWithinPartitions(key, "b", "bid", "start", "row_id")

    def run(batches):
        import itertools

        import pandas as pd

        def stream():
            for b in batches:
                yield from b.itertuples(index=False)

        out = []
        for (k, _, _), group in itertools.groupby(stream(), key=lambda r: (r[0], r.b, r.bid)):
            ids: dict[int, int] = {}
            words = ((r.text, r.start, r.end) + (ids.setdefault(len(ids), r.row_id),) for r in group)
            for held in flushed(words, gap, target):
                for part in split_long(held, most):
                    out.append((k, part[0][3], part[-1][3], len(part), part[0][1], max(w[2] for w in part), " ".join(w[0] for w in part)))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    names = [key, "first_id", "last_id", "n", "start_ms", "end_ms", "text"]
    return blocks.mapInPandas(run, f"{key} string, first_id bigint, last_id bigint, n bigint, start_ms bigint, end_ms bigint, text string")
