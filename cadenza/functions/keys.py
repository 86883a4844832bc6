"""Content keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import stripped


def render_key(text: Column, speaker: Column, lang: Column, voice: Column, model: Column, slot: Column, prosody: Column) -> Column:
    """First 16 hex digits of the SHA-256 of all that shapes a rendering; the slot counts in whole milliseconds."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    ms = F.floor(F.coalesce(slot, F.lit(0.0)) * 1000 + 0.5).cast("bigint").cast("string")
    return F.substring(F.sha2(F.concat_ws("||", stripped(empty(text)), empty(speaker), empty(lang), empty(voice), empty(model), ms, empty(prosody)), 256), 1, 16)


def canonical_map(config: Column, secrets: list[str]) -> Column:
    """Compact text of a map with sorted keys, secret ones left out; an empty map gives '{}'."""
    kept = F.filter(F.array_sort(F.map_keys(config)), lambda k: ~k.isin(secrets))
    return F.concat(F.lit("{"), F.array_join(F.transform(kept, lambda k: F.concat(k, F.lit(":"), F.coalesce(F.try_element_at(config, k), F.lit("null")))), ","), F.lit("}"))


def prosody_signature(db: Column, voiced: Column, rate: Column, pitch: Column) -> Column:
    """Delivery rounded to tenths (level), hundredths (voiced share, rate) and whole hertz; missing parts are 0."""
    whole = lambda c, k: F.floor(F.coalesce(c, F.lit(0.0)) * k + 0.5).cast("bigint").cast("string")
    return F.concat_ws("|", F.concat(F.lit("e"), whole(db, 10)), F.concat(F.lit("v"), whole(voiced, 100)), F.concat(F.lit("r"), whole(rate, 100)), F.concat(F.lit("p"), whole(pitch, 1)))
