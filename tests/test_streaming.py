import json
import random

import pytest

from sparloom.streaming import follow, keyed, posts


def test_follow_consumes_once(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    schema = "k string, t int"
    for batch in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]):
        name = f"{len(list(source.iterdir()))}.json"
        (source / name).write_text("\n".join(json.dumps({"k": k, "t": t}) for k, t in batch))
        follow.follow(spark, str(source), schema, str(tmp_path / "cp"), follow.append_new(out, "k")).awaitTermination()
    assert sorted((r.k, r.t) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 4)]
    follow.follow(spark, str(source), schema, str(tmp_path / "cp"), follow.append_new(out, "k")).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_snapshots(spark, tmp_path):
    path, rnd, latest = str(tmp_path / "s"), random.Random(4), {}
    consume = follow.snapshot(path, "k", "t", fan=3)
    for number in range(10):
        rows = [(f"k{rnd.randrange(20)}", 10 * number + j) for j in range(6)]
        latest |= {k: t for k, t in rows}
        df = spark.createDataFrame(rows, "k string, t int")
        consume(df, number)
        if number in (4, 8):  # again, as after a failure
            consume(df, number)
        assert {r.k: r.t for r in follow.read_snapshot(spark, path, "k", "t", df.schema, fan=3).collect()} == latest
    table = keyed.KeyedTable(path, ["k"], "t", 3)
    assert table.runs(10) == [(2, 0), (0, 9)] and {p.name for p in (tmp_path / "s").iterdir()} == {"run-2-0", "run-0-9"}
    asked = spark.createDataFrame([("k3",), ("none",)], "k string")
    assert {r.k: r.t for r in table.read(spark, df.schema, 10, asked).collect()} == {k: t for k, t in latest.items() if k == "k3"}
    assert follow.read_snapshot(spark, path + "-none", "k", "t", df.schema).count() == 0


def test_work_of_a_batch_does_not_grow():
    table = keyed.KeyedTable("x", ["k"], "t", 8)
    assert max(len(table.runs(n)) for n in range(4096)) <= 7 * 4
    for n in (1, 63, 64, 200, 777):
        runs = sorted((i * 8**level, (i + 1) * 8**level) for level, i in table.runs(n))
        assert runs[0][0] == 0 and runs[-1][1] == n and all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))


def test_posts_across_batches(spark, tmp_path):
    schema = "order long, id string, tags string, rating string, sample_width string, sample_height string, width string, height string, source string, crawl_label string, raw_tags string"
    post = lambda o, i, name: (o, i, f"multiple_views solo turnaround 1girl {name}", "safe", None, None, "500", "500", "", "sheets", "turnaround")
    seen = []
    consume = posts.accept_posts(str(tmp_path / "kept"), on_accept=lambda d, n: seen.append(d.count()))
    consume(spark.createDataFrame([post(1, "1", "zed"), post(2, "2", "zed"), post(3, "3", "amy")], schema), 0)
    consume(spark.createDataFrame([post(4, "3", "new"), post(5, "5", "amy"), post(6, "6", "bob")], schema), 1)
    consume(spark.createDataFrame([post(4, "3", "new"), post(5, "5", "amy"), post(6, "6", "bob")], schema), 1)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == ["1", "3", "6"] and seen == [2, 1, 1]


def test_chains_across_batches_and_a_restart(spark, tmp_path):
    schema = "order long, id string, tags string, rating string, sample_width string, sample_height string, width string, height string, source string, crawl_label string, raw_tags string"
    rnd = random.Random(6)
    made = [(o, str(rnd.randrange(40)), f"1girl solo multiple_views turnaround t{rnd.randrange(40)}", "safe", "900", "900", "900", "900", "", "sheets", "") for o in range(120)]
    existing = spark.createDataFrame([(-1, "7", "character_tags:t3")], "order long, id string, signature string")
    ids, names, want = {"7"}, {"t3"}, []
    for o, i, tags, *_ in made:
        if i not in ids and tags.split()[-1] not in names:
            ids.add(i)
            names.add(tags.split()[-1])
            want.append(o)
    consume = posts.accept_posts(str(tmp_path / "kept"), existing=existing, fan=2)

    def fails(d, n):
        raise RuntimeError("stopped")

    broken = posts.accept_posts(str(tmp_path / "kept"), existing=existing, fan=2, on_accept=fails)
    for number in range(6):
        df = spark.createDataFrame(made[20 * number : 20 * number + 20], schema)
        if number in (0, 3):
            with pytest.raises(RuntimeError):
                broken(df, number)
        consume(df, number)
    assert sorted(r.order for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == want
