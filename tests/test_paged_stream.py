"""The paged listing as a stream: cap, end, resumption."""

import json

import pytest

from sparloom.sources import pages


def put(folder, page, ids):
    (folder / f"{page}.json").write_text(json.dumps([{"id": i} for i in ids] if page % 2 == 0 else {"posts": [{"id": i} for i in ids]}))


def test_resumes_without_repeats(spark, tmp_path):
    source = tmp_path / "pages"
    source.mkdir()
    for page in range(9):
        put(source, page, [f"{page}a", f"{page}b"] if page < 5 else [])
    options = {"location": str(source), "fetcher": "sparloom.sources.pages:read_file", "pages_per_batch": "2"}
    go = lambda **more: pages.append_pages(spark, options | more, str(tmp_path / "out"), str(tmp_path / "cp"))
    ids = lambda rows: sorted(r.post_id for r in rows.collect())
    want = [f"{p}{x}" for p in range(6) for x in "ab"]
    assert ids(go(max_pages="3")) == want[:6]
    assert ids(go()) == want[:10]
    assert ids(go()) == want[:10]
    put(source, 5, ["5a", "5b"])
    rows = go()
    assert ids(rows) == want and {(r.page, r.position) for r in rows.collect()} == {(p, k) for p in range(6) for k in range(2)}


def test_offsets_are_repeatable(tmp_path):
    for page in range(4):
        put(tmp_path, page, [page] if page < 3 else [])
    reader = pages.PagedStreamReader({"location": str(tmp_path), "fetcher": "sparloom.sources.pages:read_file", "pages_per_batch": "2"})
    first, after = reader.read(reader.initialOffset())
    assert list(first) == list(reader.readBetweenOffsets({"page": 0}, after)) and after == {"page": 2}
    assert reader.read({"page": 3})[1] == {"page": 3}


def test_cap_of_the_batch_reader(spark, tmp_path):
    for page in range(4):
        put(tmp_path, page, [page])
    spark.dataSource.register(pages.PagedSource)
    read = spark.read.format("paged").options(location=str(tmp_path), fetcher="sparloom.sources.pages:read_file", max_pages=2)
    assert read.load().count() == 2 and read.option("pages", 3).load().count() == 2


def test_a_failing_page_is_tried_again(monkeypatch):
    waits, calls = [], []
    monkeypatch.setattr(pages.time, "sleep", waits.append)

    def fetch(location, page, limit):
        calls.append(page)
        if len(calls) < 4:
            raise OSError("later")
        return "[]"

    monkeypatch.setattr(pages, "read_file", fetch)
    assert pages.PagedReader({"location": "x", "fetcher": "sparloom.sources.pages:read_file"}).page(0) == [] and waits == [1.0, 2.5, 4.0]
    monkeypatch.setattr(pages, "read_file", lambda *a: "{")
    with pytest.raises(ValueError):
        pages.PagedReader({"location": "x", "fetcher": "sparloom.sources.pages:read_file"}).page(0)
