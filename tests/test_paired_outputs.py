"""Both views of the same rows, or the old ones."""

import pytest

from sparloom.sinks import writers


def views(spark, path):
    pair = writers.current(spark, path)
    csv = sorted(int(r.a) for r in spark.read.option("header", True).csv(f"{pair}/csv").collect())
    return csv, sorted(r.a for r in spark.read.json(f"{pair}/jsonl").collect())


@pytest.mark.parametrize("stops_in", ["write_json", "write_csv"])
def test_a_stop_between_both(spark, tmp_path, monkeypatch, stops_in):
    path, rows = str(tmp_path / "pair"), lambda n: spark.range(n).toDF("a")

    def stop(*args, **more):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(writers, stops_in, stop)
        writers.write_both(rows(2), path, ["a"])
    assert not any(p.name.startswith("version") for p in (tmp_path / "pair").iterdir())
    writers.write_both(rows(3), path, ["a"])
    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(writers, stops_in, stop)
        writers.write_both(rows(4), path, ["a"])
    assert views(spark, path) == ([0, 1, 2], [0, 1, 2])
    before = writers.current(spark, path)
    for n in (5, 6):
        assert writers.write_both(rows(n), path, ["a"]) == writers.current(spark, path) != before
        assert views(spark, path) == (list(range(n)), list(range(n)))
    assert len([p for p in (tmp_path / "pair").iterdir() if p.name.startswith("version")]) == 2


def test_what_a_killed_writer_left_is_not_read(spark, tmp_path):
    path = str(tmp_path / "pair")
    writers.write_both(spark.range(2).toDF("a"), path, ["a"])
    left = tmp_path / "pair" / "version-0-killed" / "jsonl"
    left.mkdir(parents=True)
    (left / "part-0.json").write_text('{"a": 99}')
    assert views(spark, path) == ([0, 1], [0, 1])
    writers.write_both(spark.range(3).toDF("a"), path, ["a"])
    assert views(spark, path) == ([0, 1, 2], [0, 1, 2]) and not left.exists()
