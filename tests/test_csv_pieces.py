"""CSV in pieces of a range: the rows of the whole-file reader, and no window holds the lines of a range."""

import csv
import random
import re

import pytest

from sparloom.sources import tables


@pytest.mark.parametrize("piece", [1, 3, 7])
def test_pieces_within_ranges(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(tables, "PIECE", piece)
    rng = random.Random(piece)
    words = ["red", "", "two\nlines", 'say "so"', "a,b", "line\n\n\nline", '"\n"', "long\n" * 40]
    for n in ("a", "b"):
        with open(tmp_path / f"{n}.csv", "w", newline="", encoding="utf-8") as f:
            csv.writer(f, lineterminator="\n").writerows([["id", "t", "u"], *[[str(k), rng.choice(words), rng.choice(words)] for k in range(150)]])
    rows = lambda d: [tuple(r) for r in d.orderBy("_file", "_row").select("id", "t", "u").collect()]
    assert rows(tables.read_csv_split(spark, str(tmp_path))) == rows(tables.read_csv(spark, str(tmp_path)))


def test_windows_of_lines_are_of_pieces(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,t\n1,x\n")
    plan = tables.csv_records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    specs = [x for x in re.findall(r"windowspecdefinition\((.*?) ASC", plan)]
    of_lines = [x for x in specs if x.split(", ")[-1].startswith("_id")]
    assert of_lines and all("_piece" in x for x in of_lines)
    assert all(x.split(", ")[-1].startswith(("_id", "_block")) for x in specs)
