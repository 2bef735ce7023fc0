"""Rebuilding by content, counts of a write, upserts from a stream."""

import pytest

from tonarium.sources import builds
from tonarium.streaming import upserts


def test_rebuild_by_hash(spark, tmp_path):
    sources, made = tmp_path / "sources", []
    sources.mkdir()
    (sources / "a.txt").write_text("one\ntwo\n")
    (sources / "b.txt").write_text("three\n")
    pattern, build = f"file://{sources}/*.txt", builds.Build(spark, f"file://{tmp_path}/built")
    with pytest.raises(FileNotFoundError):
        build.table("words")

    def make():
        made.append(1)
        return {"words": spark.read.text(pattern)}

    kinds = lambda: sorted(r.change for r in build.refresh(pattern, make).collect())
    words = lambda: sorted(r.value for r in build.table("words").collect())
    assert kinds() == ["added", "added"] and words() == ["one", "three", "two"]
    before = sorted(p.name for p in (tmp_path / "built").iterdir())
    assert kinds() == ["same", "same"] and len(made) == 1  # the second run writes nothing
    assert sorted(p.name for p in (tmp_path / "built").iterdir()) == before
    (sources / "b.txt").write_text("four\n")
    (sources / "c.txt").write_text("five\n")

    def cut_off():
        return {"words": spark.read.text(pattern), "other": spark.range(1).selectExpr("raise_error('stopped')")}

    with pytest.raises(Exception, match="stopped"):
        build.refresh(pattern, cut_off)
    assert words() == ["one", "three", "two"]  # the old version is in use
    assert kinds() == ["added", "changed", "same"] and words() == ["five", "four", "one", "two"]
    (sources / "a.txt").unlink()
    assert kinds() == ["removed", "same", "same"] and words() == ["five", "four"]


def test_counts_are_taken_while_writing(spark, tmp_path):
    from pyspark.sql import functions as F

    path, calls = f"file://{tmp_path}/t", spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            calls.add(len(r))
            yield r

    df = spark.range(10).mapInPandas(seen, "id long")
    found = builds.write_counted(df, path, {"n": F.count(F.lit(1)), "sum": F.sum("id")}, {"from": "test"})
    assert {(r["kind"], r["name"]): r["value"] for r in found.collect()} == {("count", "n"): "10", ("count", "sum"): "45", ("fact", "from"): "test", ("fact", "columns"): '["id"]'}
    assert spark.read.parquet(path).count() == 10 and calls.value == 10
    empty = builds.write_counted(spark.range(0), path, {"sum": F.sum("id")})
    assert empty.where("kind = 'count'").first()["value"] == "0"


def test_replayed_batches_change_nothing(spark, tmp_path):
    target = upserts.Upserts(spark, f"file://{tmp_path}/kv", "k", ["t"])
    batch = lambda *rows: spark.createDataFrame(rows, "k string, t int, v string")
    assert target.version() == -1 and target.table() is None
    rows = lambda: sorted(map(tuple, target.table().collect()), key=str)
    target.merge(batch(("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z"), (None, 1, "n")), 0)
    first = rows()
    assert first == sorted([("a", 2, "y"), ("b", 5, "z"), (None, 1, "n")], key=str)
    target.merge(batch(("c", 9, "never")), 0)  # the batch is known
    assert rows() == first
    target.merge(batch(("b", 4, "old"), ("a", 2, "yy"), ("d", 1, "d")), 1)
    assert rows() == sorted([("a", 2, "yy"), ("b", 5, "z"), ("d", 1, "d"), (None, 1, "n")], key=str)
    target.merge(batch(("e", 1, "e")), 2)
    target.prune(1)
    assert sorted(p.name for p in (tmp_path / "kv").iterdir()) == ["version=2"] and target.table().count() == 5


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows = spark.range(200).selectExpr("string(id % 17) AS k", "int(id * 7 % 50) AS t", "string(id) AS v")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    target = upserts.Upserts(spark, f"file://{tmp_path}/kv", "k", ["t"])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    broken = []

    def fail_once(_, batch_id):
        if batch_id == 1 and not broken:
            broken.append(1)
            raise RuntimeError("lost")  # after the merge, before the batch counts as done

    with pytest.raises(Exception, match="lost"):
        upserts.follow(stream, target, f"{tmp_path}/checkpoint", fail_once).awaitTermination()
    upserts.follow(stream, target, f"{tmp_path}/checkpoint", fail_once).awaitTermination()
    assert sorted(map(tuple, target.table().collect())) == sorted(map(tuple, target.latest(rows).collect())) and broken
