"""Samples that name their images, and the gate at failed rows."""

import json

import pytest

from sparloom.operators import quality
from sparloom.sources import layout


def test_problems_of_samples(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "img" / "x y.png").write_bytes(b"1")
    files = {
        "a/good": {"sample_id": "good", "source_image": "../img/x y.png"},
        "a/b/bom": {"sample_id": "bom", "source_image": "./.././../img/x y.png"},
        "a/whole": {"sample_id": "whole", "source_image": str(tmp_path / "img" / "x y.png")},
        "a/number": {"sample_id": 7, "source_image": "../img/x y.png"},
        "a/blank": {"sample_id": "blank", "source_image": "  "},
        "a/lost": {"sample_id": "lost", "source_image": "x y.png"},
        "a/list": [1],
        "a/t1": {"sample_id": "twice", "source_image": "../img/x y.png"},
        "a/t2": {"sample_id": "twice", "source_image": "../img/x y.png"},
    }
    for name, value in files.items():
        (tmp_path / f"{name}.json").write_text(("﻿" if name.endswith("bom") else "") + json.dumps(value), encoding="utf-8")
    (tmp_path / "a" / "bad.json").write_text("{")
    got = {r.metadata_path.rsplit("/", 1)[-1][:-5]: r for r in layout.sample_images(spark, str(tmp_path)).collect()}
    assert {k: r.problem for k, r in got.items()} == {"good": None, "bom": None, "whole": None, "number": "missing sample_id", "blank": "missing source_image", "lost": "image is not there", "list": "JSON root is no object", "t1": "duplicate sample_id", "t2": "duplicate sample_id", "bad": "invalid JSON"}
    with pytest.raises(Exception, match="metadata_path|invalid JSON|duplicate|missing|not there|no object"):
        layout.read_sample_images(spark, str(tmp_path)).collect()
    assert [r.sample_id for r in layout.read_sample_images(spark, str(tmp_path / "a" / "b"), str(tmp_path)).collect()] == ["bom"]
    with pytest.raises(Exception, match="no sample|PATH"):
        layout.read_sample_images(spark, str(tmp_path / "img"))


def test_gate(spark):
    report = spark.createDataFrame([("a", "PASS", ""), ("b", "WARN", ""), ("c", "FAIL", "missing_view")], "id string, qc_status string, issues string")
    assert quality.passed(report.filter("id <> 'c'")).count() == 2
    with pytest.raises(Exception, match="a row failed: missing_view"):
        quality.passed(report).collect()
    with pytest.raises(ValueError, match="1 rows failed"):
        quality.fail_on_errors(report)
