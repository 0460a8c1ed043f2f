"""CSV in splits gives the rows of the whole-file reader, also where quoted cells cross the splits."""

import csv
import random

import pytest

from sparloom.sources import tables


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def write(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def rows_of(d, *columns):
    return [tuple(r) for r in d.orderBy("_file", "_row").select(*columns).collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_same_rows_in_splits(spark, small_splits, tmp_path, end):
    rng = random.Random(4)
    words = ["red", "", "two\nlines", 'say "so"', "a,b", '"', "é😀", " x ", "line\n\n\nline", "long\n" * 300]
    rows = [[str(k), rng.choice(words[:-1]), rng.choice(words if k % 40 == 0 else words[:-1])] for k in range(400)]
    for n in ("a", "b"):
        write(tmp_path / f"{n}.csv", [["id", "t", "u"], *rows], end)
    want = rows_of(tables.read_csv(spark, str(tmp_path)), "id", "t", "u")
    got = tables.read_csv_split(spark, str(tmp_path))
    assert tables.csv_records(spark, str(tmp_path)).select("_file").count() == 802
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() >= 8
    assert rows_of(got, "id", "t", "u") == want and len(want) == 800


def test_small_files(spark, tmp_path):
    write(tmp_path / "h.csv", [["id", "t"]])
    assert rows_of(tables.read_csv_split(spark, str(tmp_path / "h.csv")), "id", "t") == []
    write(tmp_path / "o.csv", [["id", "t"], ["1", "only\none"]])
    assert rows_of(tables.read_csv_split(spark, str(tmp_path / "o.csv")), "id", "t") == [("1", "only\none")]
