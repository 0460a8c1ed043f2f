"""Edited workbooks merged with rows made anew, and lists of choices put on again."""

import itertools

import pytest
from pyspark.sql import functions as F

from sparloom.sources import workbooks

COLUMNS = ["value", "result"]


def merge(spark, was, mine, new):
    made = lambda rows: spark.createDataFrame([(k, *cells, n) for n, (k, cells) in enumerate(rows)], "k string, value string, result string, source_row int")
    got = workbooks.merge_edits(made(was), made(mine), made(new), ["k"], COLUMNS).collect()
    return {r.k: (r.value, r.result, r.conflicts) for r in got}


def expected(was, mine, new):
    """One row after another, by the rule as it is told; None: no row."""
    if was is not None and mine is None and (new is None or new == was):
        return None
    if was is not None and new is None and (mine is None or mine == was):
        return None
    if mine is None and new is None:
        return None
    if mine is None or new is None:
        kind = [] if was is None else ["row_removed" if new is None else "row_restored"]
        return (*(mine or new), kind)
    cells, bad = [], []
    for i, c in enumerate(COLUMNS):
        m, n, w = mine[i], new[i], was[i] if was else None
        if m != n and m != w and n != w:
            bad.append(c)
        cells.append(n if m == w else m)
    return (*cells, bad)


def test_every_way_two_sides_can_differ(spark):
    cells = [None, *itertools.product("ab", "xy"), ("c", "x")]
    cases = {f"{a}{b}{c}": (cells[a], cells[b], cells[c]) for a, b, c in itertools.product(range(len(cells)), repeat=3)}
    sides = [[(k, v[s]) for k, v in cases.items() if v[s] is not None] for s in range(3)]
    assert merge(spark, *sides) == {k: want for k, v in cases.items() if (want := expected(*v)) is not None}


def test_nulls_repeats_and_empty_sides(spark):
    assert merge(spark, [("a", (None, ""))], [("a", ("", "ok"))], [("a", ("", None))]) == {"a": ("", "ok", [])}
    assert merge(spark, [], [("a", ("1", "x")), ("a", ("2", "y"))], []) == {"a": ("1", "x", [])}
    assert merge(spark, [(None, ("1", "x"))], [(None, ("2", "x"))], [(None, ("1", "x"))]) == {None: ("2", "x", [])}
    assert merge(spark, [], [], []) == {}


def test_choices_leave_cells_alone(spark):
    rows = [["id", "result"], ["1", " a & <b>"], ["", ""], ["2"]]
    files = spark.createDataFrame([("x", workbooks.build(rows)), ("y", workbooks.build([["id"]])), ("z", workbooks.build([]))], "path string, content binary")
    got = {r.path: r for r in workbooks.with_choices(files, {"result": ["correct", "wrong"]}, ("result",)).collect()}
    assert got["x"].problem is None and workbooks.parse(bytes(got["x"].content)) == rows and got["x"].n_rows == 4
    assert got["y"].problem == got["z"].problem == "columns are missing: result"
    again = workbooks.with_choices(spark.createDataFrame([("x", got["x"].content)], "path string, content binary"), {"result": ["correct", "wrong"]})
    assert again.first().content == got["x"].content
    assert workbooks.replace_unproblematic(workbooks.with_choices(files.filter("path = 'x'"), {})).columns == ["path", "content"]
    with pytest.raises(Exception, match="columns are missing"):
        workbooks.replace_unproblematic(workbooks.with_choices(files, {}, ("result",))).agg(F.count("content")).collect()
