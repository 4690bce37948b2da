import datetime as dt
import json

import pytest

from hubloom.operators.drift import Field, drift, enforce, ingest, replay, schema_changes

T0 = dt.datetime(2025, 1, 1)
FILES = "file_id long, feed_id long, model string, released timestamp, key string"
RECORDS = "record_id long, file_id long, line_no int, body string, field string"


def tables(spark, files, bodies):
    f = spark.createDataFrame([(i, feed, "m", T0 + dt.timedelta(days=i), "clash") for i, feed in files], FILES)
    rows, n = [], 0
    for file_id, body in bodies:
        n += 1
        rows.append((n, file_id, n, body if body is None or isinstance(body, str) else json.dumps(body, ensure_ascii=False), "clash"))
    return spark.createDataFrame(rows, RECORDS), f


def changes(spark, files, bodies):
    _, c = drift(*tables(spark, files, bodies))
    return sorted(tuple(r) for r in c.collect())


def nodes(*names, values=None):
    return [dict(zip(names, v)) for v in values]


def test_kinds_of_change(spark):
    got = changes(
        spark,
        [(1, 1), (2, 1), (3, 1)],
        [(1, {"Node": 5, "Boardings": 7, "Zone": 1, "Transfers": 3}), (2, {"Node": "5", "On": 7, "TransferBoardings": 1, "TransferAlight": 2}), (3, {"Node": "5", "On": 7.5, "Transfers": 3, "Extra": 1})],
    )
    assert got == [
        (2, "boardings_daily", "renamed"), (2, "node", "retyped"), (2, "totaltransfers", "split"), (2, "zone", "removed"),
        (3, "boardings_daily", "retyped"), (3, "extra", "added"), (3, "totaltransfers", "merged"),
    ]


def test_values_bind_unknown_keys(spark):
    ns = list(range(500, 510))
    first = [(1, {"Node": n, "Boardings": n * 10, "Alightings": n * 7, "Boardings_AM": n * 2}) for n in ns]
    second = [(2, {"X1": n, "col_9": n * 10 + 3, "Alightings": n * 7, "Boardings_AM": n * 2, "OldNode": n + 900000}) for n in ns]
    got = changes(spark, [(1, 1), (2, 1)], first + second)
    assert got == [(2, "boardings_daily", "renamed"), (2, "node", "renamed"), (2, "oldnode", "added")]


def test_order_is_of_release_and_repeats_change_nothing(spark):
    records, files = tables(spark, [(9, 1), (2, 1)], [(9, {"Node": 1, "A": 1}), (9, {"Node": 1, "A": 1}), (2, {"Node": 1})])
    assert [tuple(r) for r in drift(records, files)[1].collect()] == [(9, "a", "added")]


def test_bad_rows(spark):
    got = changes(spark, [(1, 1), (2, None)], [(1, None), (1, "no json"), (1, ""), (1, "[1]"), (7, {"Node": 1}), (None, {"Node": 1}), (2, {"Node": 1})])
    assert got == []


def test_empty(spark):
    records, files = tables(spark, [(1, 1)], [(1, {"Node": 1})])
    assert drift(records.limit(0), files)[1].count() == 0
    assert drift(records, files.limit(0))[1].count() == 0


def test_null_values_keep_a_column(spark):
    assert changes(spark, [(1, 1), (2, 1)], [(1, {"Node": 1, "B": 1}), (2, {"Node": 1, "B": None})]) == []


def test_enforce_and_replay(spark):
    records, files = tables(spark, [(1, 1)], [(1, {"Node": "12.0", "Boardings": "1,448", "Alightings": "#REF!", "TransferBoardings": 1, "TransferAlight": 2.5, "OldNode": 9, "Note": "x"}), (1, "broken"), (1, None)])
    typed = enforce(records)
    rows = {r.record_id: r for r in typed.collect()}
    assert (rows[1].node, rows[1].boardings_daily, rows[1].alightings_daily, rows[1].totaltransfers) == (12, 1448.0, None, 3.5)
    assert json.loads(rows[1].rescued) == {"Alightings": "#REF!", "OldNode": 9, "Note": "x"}
    assert json.loads(rows[2].rescued) == {"_body": "broken"} and rows[3].rescued is None
    again = {r.record_id: r for r in replay(typed, {"OldNode": ("old_node", "bigint"), "Note": ("note", "double")}).collect()}
    assert again[1].old_node == 9 and again[1].note is None
    assert json.loads(again[1].rescued) == {"Alightings": "#REF!", "Note": "x"}
    assert json.loads(again[2].rescued) == {"_body": "broken"}


@pytest.mark.parametrize("body, column, value, rescued", [
    ({"Boardings": 5, "on": 7}, "boardings_daily", 5.0, {"on": 7}),
    ({"on": 7, "Boardings": "n/a"}, "boardings_daily", 7.0, {"Boardings": "n/a"}),
    ({"Node": "3", "Node ID": 4}, "node", 3, {"Node ID": 4}),
    ({"TransferBoardings": 10, "TransferAlight": "n/a"}, "totaltransfers", None, {"TransferBoardings": 10, "TransferAlight": "n/a"}),
    ({"TransferBoardings": 10}, "totaltransfers", None, {"TransferBoardings": 10}),
    ({"Transfers": 4, "TransferBoardings": 1, "TransferAlight": 2}, "totaltransfers", 4.0, {"TransferBoardings": 1, "TransferAlight": 2}),
    ({"Boardings": "12,5"}, "boardings_daily", None, {"Boardings": "12,5"}),
    ({"Boardings": " 1,234,567.5 "}, "boardings_daily", 1234567.5, None),
    ({"Boardings": "1,23,456"}, "boardings_daily", None, {"Boardings": "1,23,456"}),
    ({"Boardings": "NaN"}, "boardings_daily", None, {"Boardings": "NaN"}),
    ({"Node": 9007199254740993}, "node", 9007199254740993, None),
    ({"Node": "9007199254740993.0"}, "node", 9007199254740993, None),
    ({"Node": 3.5}, "node", None, {"Node": 3.5}),
    ({"Node": 10**19}, "node", None, {"Node": 10**19}),
    ({"Node": None, "a": {"b": [1]}}, "node", None, {"Node": None, "a": {"b": [1]}}),
    ({}, "node", None, None),
])
def test_no_value_is_lost_or_falsified(spark, body, column, value, rescued):
    records, _ = tables(spark, [(1, 1)], [(1, body)])
    (row,) = enforce(records).collect()
    assert row[column] == value
    assert (None if row.rescued is None else json.loads(row.rescued)) == rescued


def test_approved_keys_are_promoted(spark):
    ns = list(range(500, 510))
    bodies = [(1, {"Node": n, "Boardings": n * 10, "Zone": 1}) for n in ns] + [(2, {"Node": n, "col_9": "?" if n == 505 else n * 10 + 3, "Zone": 2}) for n in ns]
    typed, approved = ingest(*tables(spark, [(1, 1), (2, 1)], bodies))
    assert [tuple(r) for r in approved.select("file_id", "key", "field").collect()] == [(2, "col_9", "boardings_daily")]
    rows = {(r.file_id, r.node): r for r in typed.collect()}
    assert rows[2, 503].boardings_daily == 5033.0 and json.loads(rows[2, 503].rescued) == {"Zone": 2}
    assert rows[2, 505].boardings_daily is None and json.loads(rows[2, 505].rescued) == {"col_9": "?", "Zone": 2}


def test_a_spelling_approved_in_several_feeds_is_approved_for_all(spark):
    ns = list(range(500, 510))
    files, bodies = [], []
    for feed in (1, 2):
        files += [(feed * 10, feed), (feed * 10 + 1, feed)]
        bodies += [(feed * 10, {"Node": n, "Boardings": n * 10}) for n in ns] + [(feed * 10 + 1, {"Node": n, "Einsteiger": n * 10}) for n in ns]
    # here no file has a spelling that is configured, and the last one's only says so by its values
    files += [(30, 3), (31, 3)]
    bodies += [(30, {"Node": n, "einsteiger": n * 7}) for n in ns] + [(31, {"Node": n, "x1": n * 7 + 1}) for n in ns]
    records, known = tables(spark, files, bodies)
    typed, approved = ingest(records, known)
    assert {(r.file_id, r.key) for r in approved.collect()} == {(11, "Einsteiger"), (21, "Einsteiger"), (30, "einsteiger"), (31, "x1")}
    assert [tuple(r) for r in schema_changes(typed, known).where("file_id > 29").collect()] == [(31, "boardings_daily", "renamed")]


def test_other_targets(spark):
    target = (Field("place", "bigint", ("place",)), Field("heads", "bigint", ("heads",)), Field("kind", "string", ("kind",)))
    records, _ = tables(spark, [(1, 1)], [(1, {"Place": 1, "HEADS": "2", "kind": "bus", "x": 1})])
    (row,) = enforce(records, target).collect()
    assert (row.place, row.heads, row.kind, json.loads(row.rescued)) == (1, 2, "bus", {"x": 1})


@pytest.mark.parametrize("n", [20_000])
def test_long_body(spark, n):
    assert changes(spark, [(1, 1), (2, 1)], [(1, {"Node": 1}), (2, {"Node": 1, "T": "x" * n})]) == [(2, "t", "added")]


def test_spelling_of_a_key_alone_is_a_rename(spark):
    records, files = tables(spark, [(1, 1), (2, 1)], [(1, {"Node": 1}), (2, {"node ": 1})])
    assert [tuple(r) for r in schema_changes(enforce(records), files).collect()] == [(2, "node", "renamed")]
