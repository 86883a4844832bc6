"""Small relational operators over records: bypass, hydration, nested settings, last states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.lineage import STAGES

# Names of language codes.
LANGUAGE_NAMES = {"en": "English", "pt": "Portuguese", "es": "Spanish", "fr": "French", "de": "German", "ru": "Russian", "it": "Italian", "nl": "Dutch", "ja": "Japanese", "ko": "Korean", "zh": "Chinese"}


def bypass(df: DataFrame, skip: Column, column: str, change: Callable[[Column], Column]) -> DataFrame:
    """``change`` applied to a column where ``skip`` does not hold; the other rows pass unchanged. A null condition does not skip."""
    return df.withColumn(column, F.when(F.coalesce(skip, F.lit(False)), F.col(column)).otherwise(change(F.col(column))))


def hydrated(df: DataFrame, known: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Columns still at their default (or null) take the value of ``known`` (one row per key), if it has one."""
    found = known.select(*keys, *[F.col(c).alias(f"_{c}") for c in defaults])
    joined = df.join(found, keys, "left")
    for c, default in defaults.items():
        untouched = F.col(c).isNull() | (F.col(c).eqNullSafe(F.lit(default)))
        joined = joined.withColumn(c, F.when(untouched, F.coalesce(f"_{c}", c)).otherwise(F.col(c))).drop(f"_{c}")
    return joined


def nested_settings(flat: Column, folded: dict[str, str]) -> Column:
    """``stage.name -> value`` as stage -> (name -> value); stages in ``folded`` go into another one. Names without a dot are left out."""
    keys = F.filter(F.map_keys(flat), lambda k: k.contains("."))
    owner = lambda k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in folded.items() for x in kv]), F.split_part(k, F.lit("."), F.lit(1))), F.split_part(k, F.lit("."), F.lit(1)))
    stages = F.array_sort(F.array_distinct(F.transform(keys, owner)))
    return F.map_from_entries(
        F.transform(stages, lambda s: F.struct(s, F.map_from_entries(F.transform(F.array_sort(F.filter(keys, lambda k: owner(k) == s)), lambda k: F.struct(F.substring_index(k, ".", -1), F.element_at(flat, k))))))
    )


def language_name(code: Column) -> Column:
    """Name of a code, of its part before ``-`` or ``_``, else the code itself."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGE_NAMES.items() for x in kv])
    low = F.lower(F.trim(code))
    return F.coalesce(F.try_element_at(names, low), F.try_element_at(names, F.regexp_extract(low, r"^([^\-_]*)", 1)), code)


def last_states(records: DataFrame, keys: list[str], at: str, state: str) -> DataFrame:
    """The latest state per key; states without a time come before all others, ties go to the greater state."""
    return records.groupBy(*keys).agg(F.max_by(state, F.struct(at, state)).alias(state))


def resume_points(states: DataFrame, key: str, done: str = "done") -> DataFrame:
    """First stage in order that is not done: key, stage_name; null where all are. Stages without a record are not done."""
    finished = F.collect_set(F.when(F.col("status") == done, F.col("stage_name")))
    left = F.filter(F.array(*[F.lit(s) for s in STAGES]), lambda s: ~F.array_contains("_done", s))
    return states.groupBy(key).agg(finished.alias("_done")).select(key, F.get(left, F.lit(0)).alias("stage_name"))
