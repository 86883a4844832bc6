import datetime as dt
import json

from cadenza.operators.drift import Layout, consistent_table, leaves_of, parse, promoted, read_entries, schema_changes, union_schema

RAW = "record_id bigint, file_id bigint, series_id string, kind string, file_path string, written_at timestamp, line_no int, payload string"


def raw(spark, files):
    """files: (file_id, series, kind, [payloads]) in order of writing."""
    rows, n = [], 0
    for day, (file, series, kind, payloads) in enumerate(files):
        for i, p in enumerate(payloads):
            n += 1
            rows.append((n, file, series, kind, "f", dt.datetime(2031, 1, 1) + dt.timedelta(days=day), i, p if isinstance(p, str) or p is None else json.dumps(p)))
    return spark.createDataFrame(rows, RAW)


def found(df):
    return {tuple(r) for r in df.select("file_id", "change_type", "field", "new_field").collect()}


def entry(i, **more):
    return {"iteration": i, "score": i + 0.5, "parameters": {"a.b": 0.25 * i, "flag": True}, **more}


def test_every_change(spark):
    first = [entry(i, took=10.0 + i) for i in range(4)]
    second = [{k: v for k, v in entry(i).items() if k != "score"} | {"total": i + 0.5, "note": None, "took": str(10.0 + i)} for i in range(5)]
    third = [{**r, "parameters": {"a.b": r["parameters"]["a.b"]}} for r in second]
    df = raw(spark, [(7, "s", "history", first), (3, "s", "history", second + second[:1] + ['{"iteration": 9, "sco']), (5, "s", "history", third), (9, "t", "history", first)])
    assert found(schema_changes(df)) == {
        (3, "renamed", "score", "total"), (3, "added", "note", ""), (3, "type_changed", "took", ""), (5, "removed", "parameters/flag", ""),
    }


def test_documents_paths_and_whole_document_names(spark):
    one = {"schema_version": 1, "segments": [{"id": "x", "start": 1.0, "tags": ["a"]}, {"id": "y", "start": 2.0, "tags": []}], "stages": {"mix": {"status": "done"}}}
    two = {"schemaVersion": 2, "segments": [{"id": "y", "begin": 2.0, "tags": ["b"]}, {"id": "x", "begin": 1.0}], "stages": {"mix": {"state": "done"}, "video": {"state": "failed"}}}
    got = found(schema_changes(raw(spark, [(1, "s", "timeline", [one]), (2, "s", "timeline", ["[1]"]), (3, "s", "timeline", [two])])))
    assert got == {(3, "renamed", "schema_version", "schemaVersion"), (3, "renamed", "segments/start", "segments/begin"), (3, "renamed", "stages/*/status", "stages/*/state")}


def test_unreadable_and_empty(spark):
    df = raw(spark, [(1, None, "history", [None, "", "nonsense", "{"]), (2, None, None, [entry(0)])])
    assert found(schema_changes(df)) == set()
    empty = spark.createDataFrame([], RAW)
    assert schema_changes(empty).collect() == [] and consistent_table(empty, "history").collect() == []


def test_lattice_and_table(spark):
    assert [promoted(m) for m in (0, 1, 4, 8, 9, 5, 3, 2)] == ["string", "double", "boolean", "string", "double", "string", "string", "string"]
    df = raw(spark, [(1, "s", "history", [entry(0), entry(1, took=1)]), (2, "s", "history", [entry(1, took="2.5"), {"iteration": 2, "parameters": {"flag": "maybe"}}])])
    assert dict(union_schema(read_entries(df))[0]) == {"iteration": "double", "parameters/a.b": "double", "parameters/flag": "string", "score": "double", "took": "double"}
    rows = {(r.file_id, r.entry): r for r in consistent_table(df, "history").collect()}
    assert rows[(2, "1")]["took"] == 2.5 and rows[(1, "0")]["took"] is None and rows[(2, "2")]["parameters/flag"] == "maybe" and len(rows) == 4


def test_a_renamed_field_keeps_its_values(spark):
    df = raw(spark, [(1, "s", "history", [entry(0, version=1)]), (2, "s", "history", [{**entry(0), "schemaVersion": 2}])])
    assert found(schema_changes(df)) == {(2, "removed", "version", ""), (2, "added", "schemaVersion", "")}


def test_a_value_that_becomes_a_list_changes_its_type(spark):
    df = raw(spark, [(1, "s", "history", [entry(0, tags="a")]), (2, "s", "history", [entry(0, tags=["a"])]), (3, "s", "history", [entry(0, labels=["a"])]), (4, "s", "history", [entry(0, labels=[])])])
    assert found(schema_changes(df)) == {(2, "type_changed", "tags", ""), (3, "renamed", "tags", "labels"), (4, "removed", "labels", "")}
    rows = consistent_table(raw(spark, [(1, "s", "history", [entry(0, labels=["a", "b"])])]), "history").collect()
    assert rows[0]["labels"] == ["a", "b"]


def test_other_layouts_and_wide_tables(spark):
    layout = Layout("run", {"items": "name"}, ("teams",))
    one, two = {"run": 1, "items": [{"name": "a", "x": 1}, {"name": "b", "x": 2}]}, {"run": 1, "items": [{"name": "b", "y": 2}, {"name": "a", "y": 1}]}
    assert found(schema_changes(raw(spark, [(1, "s", "k", [one]), (2, "s", "k", [two])]), layout)) == {(2, "renamed", "items/x", "items/y")}
    wide = consistent_table(raw(spark, [(1, "s", "k", [{"run": 1, "a": 1, "b": 2}, {"run": 2, "a": 3}])]), "k", layout, widest=2)
    assert [(r.a, r.run, r.more_fields) for r in wide.orderBy("run").collect()] == [(1.0, 1.0, {"b": "2"}), (3.0, 2.0, {})]


def test_leaves_and_parse():
    assert parse('{"a": NaN}') is not None and parse("7") is None and parse("[" * 100000) is None
    assert ("stages/*/outputs/path", "|mix|1", "q") in leaves_of({"stages": {"mix": {"outputs": [{"path": "p"}, {"path": "q"}]}}})
