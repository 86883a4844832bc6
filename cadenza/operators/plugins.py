"""Plug-ins: models are loaded once per partition and see batches; nothing here depends on a particular one."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions import scores, text

REGISTRY: dict[str, Callable[[], Translator]] = {}


class Translator(Protocol):
    def candidates(self, texts: list[str], source: str, target: str) -> list[list[tuple[str, str]]]:
        """(text, label) candidates of each text."""


def register(name: str):
    def add(factory: Callable[[], Translator]):
        REGISTRY[name] = factory
        return factory

    return add


@register("copy")
class CopyTranslator:
    """Returns the text itself; what remains of a pipeline without a model."""

    def candidates(self, texts, source, target):
        return [[(t, "copy")] for t in texts]


def map_model(df: DataFrame, load: Callable[[], object], apply: Callable, schema: str) -> DataFrame:
    """``apply(model, batch)`` over all batches, with one ``load`` per partition that has rows."""

    def run(batches: Iterator):
        model = None
        for b in batches:
            if len(b):
                model = model if model is not None else load()
                yield apply(model, b)

    return df.mapInPandas(run, schema)


def translate(df: DataFrame, make: Callable[[], Translator], source: str, target: str, terms: list[str], key: str = "seg_uid", said: str = "source_text", slot: str = "slot") -> DataFrame:
    """Protect terms, ask for candidates, add shorter wordings, restore, score, take the best: key, text, backend, score.

    Blank texts pass unchanged; one language is copied; a failing model leaves the text (``passthrough``).
    """

    def ask(model, b):
        out = b[[key, said, slot]].copy()
        try:
            got = model.candidates(list(b["_guarded"]), source, target)
        except Exception:  # noqa: BLE001
            got = [[(t, "passthrough")] for t in b["_guarded"]]
        out["c"] = [[{"text": t, "backend": n} for t, n in dict.fromkeys(c)] for c in got]
        return out

    rows = df.select(key, said, slot).withColumn("_guarded", text.protect(F.coalesce(said, F.lit("")), terms))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    same = source.split("-")[0] == target.split("-")[0]
    asked = map_model(rows, CopyTranslator if same else make, ask, f"{key} {kinds[key]}, {said} string, {slot} double, c array<struct<text:string,backend:string>>")
    flat = asked.select(key, said, slot, F.posexplode("c").alias("pos", "e")).select(key, said, slot, "pos", text.restore(F.col("e.text"), terms).alias("text"), F.col("e.backend").alias("backend"))
    shorter = flat.select(key, said, slot, (F.col("pos") + 1000).alias("pos"), text.condense(F.col("text"), F.lit(target)).alias("text"), F.concat("backend", F.lit("+short")).alias("backend")).where("text is not null")
    wanted = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    said_terms = F.filter(wanted, lambda t: F.contains(F.lower(said), F.lower(t)))
    kept = F.when(F.size(said_terms) == 0, 1.0).otherwise(1 - F.try_divide(F.size(text.missing_terms(F.col("text"), said_terms)), F.size(said_terms)))
    every = flat.unionByName(shorter)
    every = every.withColumn("score", scores.candidate_score(text.duration(F.col("text"), F.lit(target)), F.col(slot), F.col(said), F.col("text"), kept))
    return every.groupBy(key).agg(F.max_by(F.struct("text", "backend", "score"), F.struct(F.round("score", 4), -F.col("pos"))).alias("b")).select(key, "b.*")
