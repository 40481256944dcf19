"""Compaction of small saves and the snapshot table."""

import posixpath
import random
import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placetrail.functions.paths import canonical_path
from placetrail.operators.compaction import compact_saves, compact_table, valid_saves
from placetrail.sources.snapshots import ConflictError, SnapshotTable

SCHEMA = "file_id bigint, out_path string, saved_at timestamp, n_bytes bigint, body string, bucket string"


def want_path(p: str) -> str:
    if p[:5].lower() == "file:":
        p = p[5:]
        if p.startswith("//"):
            p = p[2:][p[2:].index("/") :]
        p = urllib.parse.unquote(p)
    return posixpath.normpath("/" + p.lstrip("/"))


def test_canonical_paths(spark):
    paths = [
        "/a/b", "//a///b/", "/a/./b", "/a/x/../b", "/../a/b", "file:///a/b", "file:/a/b", "FILE:///a/b", "file://localhost/a/b",
        "file:///a%20c/%62", "/a%20c/b", "file:///a+c/b", "a/b", "/", "/a/../..", "/A/b", "/a/01", "/a/1", "/a/.../b",
    ]
    df = spark.createDataFrame([(p,) for p in paths] + [(None,)], "p string")
    got = {r.p: r.c for r in df.select("p", canonical_path(F.col("p")).alias("c")).collect()}
    assert got.pop(None) is None
    assert got == {p: want_path(p) for p in paths}
    assert spark.createDataFrame([("file://host/a",), ("file:///a%zz",)], "p string").select(
        canonical_path(F.col("p")).alias("c")
    ).collect() == [("//host/a",), ("/a%zz",)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", ".", "..", ""]), max_size=6), min_size=1, max_size=8))
def test_canonical_paths_at_random(spark, parts):
    paths = ["/" + "/".join(p) for p in parts]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(canonical_path(F.col("p")).alias("c")).collect()
    assert [r.c for r in got] == [want_path(p) for p in paths]


def save(k, path, at, body, n=None):
    return (k, path, at, len(body.encode()) if n is None and body is not None else n, body, "other")


def test_valid_saves_and_records(spark):
    from datetime import datetime

    day = lambda k: datetime(2024, 1, k)
    rows = [
        save(1, "/d/a", day(1), "x\r\n\ny\rz"),
        save(2, "/d/./a", None, "later id, no time"),
        save(3, "/d/b", None, "p"), save(4, "file:///d/b", None, "q\n"),  # equal times: the larger id
        save(5, "/d/c", day(2), "cut", 9), save(6, "/d/c", day(1), "whole\nfile"),
        save(7, "/d/e", day(1), "\n\r\n"), save(8, "/d/f", day(1), None, 0), save(9, None, day(1), "k"),
        save(10, "/d/g", day(1), "é" * 3), save(10, "/d/g", day(1), "é" * 3),
        save(11, "/d/h", day(1), "l" * 100_000 + "\n" + "m"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.path, r.file_id) for r in valid_saves(df).collect()} == {("/d/a", 1), ("/d/b", 4), ("/d/c", 6), ("/d/g", 10), ("/d/h", 11)}
    for max_small in (0, 100):
        got = compact_saves(df, max_small=max_small)[1].select("file_id", "item_no", "record").collect()
        assert sorted(got) == sorted(
            [(1, 0, "x"), (1, 1, "y"), (1, 2, "z"), (4, 0, "q"), (6, 0, "whole"), (6, 1, "file"), (10, 0, "ééé"), (11, 0, "l" * 100_000), (11, 1, "m")]
        )
    assert compact_saves(df.limit(0))[1].count() == 0


def test_few_files_of_the_wanted_size(spark):
    random.seed(1)
    rows = [save(k, f"/d{k % 7}/f{k}", None, "\n".join(str(random.random()) for _ in range(20))) for k in range(400)]
    store, records = compact_saves(spark.createDataFrame(rows, SCHEMA), target_bytes=40_000)
    total = sum(r[3] for r in rows)
    stored = store.read()
    assert records.count() == 8000 and stored.count() == 8000
    n_files = stored.select(F.input_file_name()).distinct().count()
    assert n_files == -(-total // 40_000)


def test_broken_sizes_count_for_nothing(spark):
    rows = [save(k, f"/d/f{k}", None, "a\nb") for k in range(40)] + [save(99, "/d/bad", None, "a", 1 << 60), save(98, "/d/f1", None, "a", 10**12)]
    store, records = compact_saves(spark.createDataFrame(rows, SCHEMA), target_bytes=1000)
    assert records.count() == 80 and len(store.buckets()) == 1


def test_saves_onto_a_table_that_is_there(spark, tmp_path):
    """Later saves go onto a version that holds earlier ones; only buckets with enough small saves are rewritten."""
    root = f"file://{tmp_path}/t"
    first = [save(k, f"/d/f{k}", None, f"a{k}\nb{k}") for k in range(300)]
    store, _ = compact_saves(spark.createDataFrame(first, SCHEMA), root, target_bytes=300)
    before = store.buckets()
    assert len(before) > 5
    later = [save(1000 + k, f"/d/f{k}", None, f"new{k}") for k in range(0, 40, 2)] + [save(2000, "/e/g", None, "g")]
    store, records = compact_saves(spark.createDataFrame(later, SCHEMA), root, target_bytes=300, max_small=2)
    after = store.buckets()
    changed = {b for b in after if after[b] != before.get(b)}
    assert 0 < len(changed) < len(after) and set(before) <= set(after)
    replaced = set(range(0, 40, 2))
    want = [(k, n, f"{c}{k}") for k in range(300) if k not in replaced for n, c in enumerate("ab")]
    want += [(1000 + k, 0, f"new{k}") for k in replaced] + [(2000, 0, "g")]
    assert sorted(tuple(r) for r in records.select("file_id", "item_no", "record").collect()) == sorted(want)


def test_old_versions_are_removed(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    for k in range(4):
        rows = [(k, 0)] if k else [(0, 0), (7, 1)]
        t.replace(spark.createDataFrame(rows, "x bigint, bucket int"), k)
    assert t.expire(keep=2) == 1 and sorted(r.x for r in t.read(3).collect()) == [2, 7]
    assert t.expire() == 1 and sorted(r.x for r in t.read().collect()) == [3, 7] and t.version() == 4


def test_snapshots_and_conflicts(spark, tmp_path):
    def rows(*values):
        return spark.createDataFrame(values, "x bigint, bucket int")

    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    assert t.version() == 0 and t.read(schema="x bigint").count() == 0
    assert t.replace(rows((1, 0), (2, 1)), 0) == 1
    first = t.read(1)
    assert t.replace(rows((3, 1)), 1) == 2
    assert sorted(r.x for r in first.collect()) == [1, 2]  # an old snapshot stays readable
    assert sorted(r.x for r in t.read().collect()) == [1, 3]
    assert t.replace(rows((4, 0)), 1) == 3  # from an old base, but no bucket in common with what came since
    with pytest.raises(ConflictError):
        t.replace(rows((5, 1)), 1)
    assert sorted(r.x for r in t.read().collect()) == [3, 4]
    assert t.replace(rows((6, 2)), 3, touched={0}) == 4
    assert sorted(r.x for r in t.read().collect()) == [3, 6]


def test_compact_table_rewrites_only_full_buckets(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    many = spark.range(1000).select(F.col("id").alias("x"), F.lit(0).alias("bucket")).repartition(12)
    few = spark.range(10).select((F.col("id") + 5000).alias("x"), F.lit(1).alias("bucket")).coalesce(1)
    t.replace(many.unionByName(few), 0)
    files = lambda: {r[0]: r[1] for r in t.read().select("bucket", F.input_file_name().alias("f")).groupBy("bucket").agg(F.count_distinct("f")).collect()}
    assert files()[0] == 12
    version = compact_table(t)
    assert version == 2 and files() == {0: 1, 1: 1}
    assert t.buckets() == {0: 2, 1: 1}
    assert sorted(r.x for r in t.read().collect()) == [*range(1000), *range(5000, 5010)]
    assert compact_table(t) == 2
