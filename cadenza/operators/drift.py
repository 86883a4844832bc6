"""Schemas that drift between files: one consistent table per kind, and a report of every change (problem 5)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadenza.operators.sequences import with_previous
from cadenza.sources.shared import written

NUMBER, STRING, BOOLEAN, NUMERAL, ARRAY = 1, 2, 4, 8, 16  # NUMERAL: text that reads as a number; ARRAY: a list of plain values
_NUMERAL = re.compile(r"-?\d{1,15}(?:\.\d+)?(?:[eE][+-]?\d{1,2})?")
LEAVES = "series_id string, file_id bigint, written_at timestamp, path string, entry bigint, type int, value bigint"


@dataclass(frozen=True)
class Layout:
    """What tells entries apart. The defaults are the shapes of timelines, manifests and iteration records."""

    document_key: str = "iteration"  # field that names a document which is an entry itself, such as a line of a log
    list_keys: dict[str, str] = field(default_factory=lambda: {"segments": "id"})  # field that names a list's elements, by path; others go by position
    named: tuple[str, ...] = ("stages",)  # objects whose keys are names of entries, not of fields; written ``*`` in paths


def leaves_of(doc: dict, layout: Layout = Layout()) -> list[tuple[str, str, object]]:
    """(path, entry, value) of every field that is no container. An entry is a line, a list element or a named object.

    A list of plain values is one value; an empty list may be either and says nothing.
    """
    out: list[tuple[str, str, object]] = []

    def walk(value: object, path: str, entry: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                if path in layout.named:
                    walk(v, f"{path}/*", f"{entry}|{k}")
                else:
                    walk(v, f"{path}/{k}" if path else k, entry)
        elif isinstance(value, list) and any(isinstance(v, (dict, list)) for v in value):
            key = layout.list_keys.get(path)
            for i, v in enumerate(value):
                name = v.get(key) if key and isinstance(v, dict) else None
                walk(v, path, f"{entry}|{i if name is None else name}")
        elif value != []:
            out.append((path, entry, value))

    walk(doc, "", str(doc[layout.document_key]) if layout.document_key in doc else "")
    return out


def json_type(value: object) -> int:
    if value is None:
        return 0
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, str):
        return NUMERAL if _NUMERAL.fullmatch(value) else STRING
    return ARRAY if isinstance(value, list) else NUMBER


def parse(payload: str | None) -> dict | None:
    """The object of a payload; None for cut, empty or other payloads. Endless numbers count as unreadable."""
    import json

    try:
        doc = json.loads(payload) if payload else None
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def hashed(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def read_leaves(raw: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """The fields of all readable payloads, one row per field and entry, values as hashes. Repeated lines stay repeated."""

    def run(batches):
        import json

        import pyarrow as pa

        names = ["series_id", "file_id", "written_at", "path", "entry", "type", "value"]
        for b in batches:
            of, path, entry, kind, value = [], [], [], [], []
            for i, payload in enumerate(b.column(3).to_pylist()):
                found = leaves_of(parse(payload) or {}, layout)
                named = {e: hashed(e) for e in {e for _, e, _ in found}}
                of += [i] * len(found)
                for p, e, v in found:
                    t = json_type(v)
                    path.append(p)
                    entry.append(named[e])
                    kind.append(t)
                    value.append(None if t == 0 else hashed("s" + v) if t & (STRING | NUMERAL) else hashed(f"n{float(v)!r}" if t == NUMBER and abs(v) < 1e15 else json.dumps(v)))
            rows = pa.array(of, pa.int64())
            at = [b.column(i).take(rows) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*at, pa.array(path, pa.string()), pa.array(entry, pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64())], names=names)

    return raw.select("series_id", "file_id", "written_at", "payload").where("payload is not null").mapInArrow(run, LEAVES)


YEAR = 31_536_000_000_000  # microseconds


def schema_changes(raw: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Changes of each file against the one before it in its series: file_id, change_type, field, new_field.

    The field set of a file is folded over its readable entries (a field left out or null in some is still there); types of
    non-null values are compared, numbers being one type and lists of plain values another. A removed and an added field
    are one ``renamed`` field if no entry that both files share tells their values apart and at least one shows the same
    value; ties go to the pair with more equal values, then the same parent, then the nearer name. A field of a document that is no entry itself, such as
    its version, may change value and name at once: it is known by its place and the last word of its name. Files without a readable
    entry are passed over; files of one series are ordered by ``written_at``, then ``file_id``; repeated and late lines
    change nothing; null series form one series; an empty table gives an empty result. Payloads are parsed once, into a
    table in the shared folder, and folded once.
    """
    leaves = written(read_leaves(raw, layout), "leaves")
    json_kind = F.when(F.col("type") == NUMERAL, STRING).otherwise(F.col("type"))
    fields = written(leaves.groupBy("series_id", "file_id", "path").agg(F.bit_or(json_kind).alias("mask"), F.min("written_at").alias("written_at"), F.bool_and(F.col("entry") == hashed("")).alias("whole")), "fields")
    files = fields.groupBy("series_id", "file_id").agg(F.unix_micros(F.min("written_at")).alias("at"))
    pairs = with_previous(files, ["series_id"], ["at", "file_id"], [], YEAR).select("file_id", F.col("previous.file_id").alias("before")).where("before is not null")
    pairs = written(pairs, "file-pairs")
    now = fields.join(pairs, "file_id").select("file_id", "before", "path", "mask", F.lit(None).cast("int").alias("old_mask"), "whole")
    then = fields.withColumnsRenamed({"file_id": "before"}).join(pairs, "before").select("file_id", "before", "path", F.lit(None).cast("int").alias("mask"), F.col("mask").alias("old_mask"), "whole")
    both = now.unionByName(then).groupBy("file_id", "before", "path").agg(F.max("mask").alias("mask"), F.max("old_mask").alias("old_mask"), F.bool_and("whole").alias("whole"))
    change = (
        F.when(F.col("old_mask").isNull(), "added")
        .when(F.col("mask").isNull(), "removed")
        .when((F.col("mask") != 0) & (F.col("old_mask") != 0) & (F.col("mask") != F.col("old_mask")), "type_changed")
    )
    changed = written(both.select("file_id", "before", "path", change.alias("change_type"), "whole").where("change_type is not null"), "changed")
    by_value = written(renames(leaves, changed), "renamed")
    renamed = by_value.unionByName(renamed_of_documents(changed, by_value))
    gone, come = (F.struct(F.lit(k).alias("change_type"), F.col(c).alias("path")) for k, c in (("removed", "field"), ("added", "new_field")))
    used = renamed.select("file_id", F.inline(F.array(gone, come)))
    rest = changed.join(used, ["file_id", "change_type", "path"], "left_anti")
    return rest.select("file_id", "change_type", F.col("path").alias("field"), F.lit("").alias("new_field")).unionByName(
        renamed.select("file_id", F.lit("renamed").alias("change_type"), "field", "new_field")
    )


def renamed_of_documents(changed: DataFrame, known: DataFrame) -> DataFrame:
    """file_id, field, new_field of fields outside any entry: the only removed and the only added one of a place with the same last word."""
    word = F.lower(F.regexp_extract("path", r"([A-Z]?[a-z]{4,})$", 1))
    used = known.select("file_id", F.explode(F.array("field", "new_field")).alias("path"))
    free = changed.where("whole and change_type <> 'type_changed'").join(used, ["file_id", "path"], "left_anti").withColumn("word", word).where("word <> ''")
    of = lambda k: F.when(F.col("change_type") == k, F.col("path"))
    told = free.groupBy("file_id", parent(F.col("path")).alias("parent"), "word").agg(F.min(of("removed")).alias("field"), F.min(of("added")).alias("new_field"), F.count(of("removed")).alias("n"), F.count(of("added")).alias("m"))
    return told.where("n = 1 and m = 1").select("file_id", "field", "new_field")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def renames(leaves: DataFrame, changed: DataFrame) -> DataFrame:
    """file_id, field, new_field of removed and added fields that keep their values; only files with both are looked at."""
    sides = changed.groupBy("file_id").agg(F.bool_or(F.col("change_type") == "added").alias("a"), F.bool_or(F.col("change_type") == "removed").alias("r")).where("a and r")
    wanted = changed.where("change_type <> 'type_changed'").join(sides.select("file_id"), "file_id")
    at = F.when(F.col("change_type") == "added", F.col("file_id")).otherwise(F.col("before"))
    wanted = wanted.select("file_id", "path", (F.col("change_type") == "added").alias("new"), at.alias("at"))
    values = leaves.where("type <> 0").select(F.col("file_id").alias("at"), "path", "entry", "value").join(wanted, ["at", "path"])
    # the fields of one entry that changed: no more than a file's changed fields
    entries = values.groupBy("file_id", "entry").agg(F.collect_set(F.struct("new", "path", "value")).alias("v"))
    old, new = F.filter("v", lambda x: ~x["new"]), F.filter("v", lambda x: x["new"])
    told = F.flatten(F.transform(old, lambda o: F.transform(new, lambda n: F.struct(o["path"].alias("field"), n["path"].alias("new_field"), (o["value"] == n["value"]).alias("same")))))
    counts = entries.select("file_id", F.inline(told)).groupBy("file_id", "field", "new_field").agg(F.count_if("same").alias("equal"), F.count_if(~F.col("same")).alias("other"))
    best = [F.desc("equal"), F.desc(parent(F.col("field")) == parent(F.col("new_field"))), F.levenshtein("field", "new_field"), "field", "new_field"]
    ranked = counts.where("equal > 0 and other = 0").repartition("file_id").select(
        "file_id", "field", "new_field",
        F.row_number().over(Window.partitionBy("file_id", "field").orderBy(*best)).alias("i"),
        F.row_number().over(Window.partitionBy("file_id", "new_field").orderBy(*best)).alias("j"),
    )
    return ranked.where("i = 1 and j = 1").select("file_id", "field", "new_field")


def promoted(mask: int) -> str:
    """Least type that holds all values. Lattice: null below boolean, number, numeral and array; number and numeral meet in double, all else in string."""
    return {NUMBER: "double", NUMBER | NUMERAL: "double", BOOLEAN: "boolean", ARRAY: "array<string>"}.get(mask, "string")


def read_entries(raw: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Entries of all readable payloads: record_id, file_id, series_id, written_at, entry, fields (texts by path), types (by path). Repeated lines of a file count once."""
    rows = raw.select("record_id", "file_id", "series_id", "written_at", "line_no", "payload").where("payload is not null").dropDuplicates(["file_id", "line_no", "payload"])

    def run(batches):
        import json

        import pyarrow as pa

        for b in batches:
            of, names, fields, types = [], [], [], []
            for i, payload in enumerate(b.column(4).to_pylist()):
                grouped: dict[str, dict[str, str]] = {}
                kinds: dict[str, dict[str, int]] = {}
                for path, entry, value in leaves_of(parse(payload) or {}, layout):
                    at = "|".join(entry.split("|")[:2])
                    text = value if isinstance(value, str) or value is None else json.dumps(value)
                    had, kind = grouped.setdefault(at, {}), kinds.setdefault(at, {})
                    had[path] = text if path not in had or had[path] is None else f"{had[path]},{text}"
                    kind[path] = kind.get(path, 0) | json_type(value) | (STRING if path in kind and kind[path] else 0)
                inner = [k for k in grouped if "|" in k]
                for k in inner or grouped:
                    outer, more = (grouped.get(k.split("|")[0], {}), kinds.get(k.split("|")[0], {})) if "|" in k else ({}, {})
                    of.append(i)
                    names.append(k.partition("|")[2] or k)
                    fields.append(list({**outer, **grouped[k]}.items()))
                    types.append(list({**more, **kinds[k]}.items()))
            rows = pa.array(of, pa.int64())
            more = [pa.array(names, pa.string()), pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(types, pa.map_(pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(4)), *more], names=["record_id", "file_id", "series_id", "written_at", "entry", "fields", "types"])

    schema = "record_id bigint, file_id bigint, series_id string, written_at timestamp, entry string, fields map<string,string>, types map<string,int>"
    return rows.select("record_id", "file_id", "series_id", "written_at", "payload").mapInArrow(run, schema)


def union_schema(entries: DataFrame, widest: int = 5000) -> tuple[list[tuple[str, str]], bool]:
    """(path, type) of the fields that any entry has, and whether more than ``widest`` names are left for a map; the most frequent are columns."""
    found = entries.select(F.explode("types").alias("path", "type")).groupBy("path").agg(F.bit_or("type").alias("mask"), F.count(F.lit(1)).alias("n"))
    rows = found.orderBy(F.desc("n"), "path").limit(widest + 1).collect()
    return sorted((r["path"], promoted(r["mask"])) for r in rows[:widest]), len(rows) > widest


def consistent_table(raw: DataFrame, kind: str, layout: Layout = Layout(), widest: int = 5000) -> DataFrame:
    """All entries of a kind in one table: record_id, file_id, series_id, written_at, entry and a column per field.

    A history line is an entry; a segment or stage is one, with the fields of its document beside it. Values that do not
    fit the promoted type become text or, if they can't, null; several values of a field inside an entry are joined by
    commas. Beyond ``widest`` field names the rarer ones come in the map ``more_fields``, so that none is lost. Repeated
    lines of a file count once. Payloads are parsed once, into a table in the shared folder.
    """
    entries = written(read_entries(raw.where(F.col("kind") == kind), layout), "entries")
    schema, more = union_schema(entries, widest)

    def value(path: str, target: str) -> Column:
        text = F.try_element_at("fields", F.lit(path))
        return F.from_json(text, target) if target.startswith("array") else text.try_cast(target)

    rest = F.map_filter("fields", lambda k, _: ~k.isin([p for p, _ in schema]))
    return entries.select("record_id", "file_id", "series_id", "written_at", "entry", *[value(p, t).alias(p) for p, t in schema], *([rest.alias("more_fields")] if more else []))
