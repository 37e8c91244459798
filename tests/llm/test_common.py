"""The bitmap that sorts rows without a join, and the shared folder."""

import os

import pyarrow as pa
from pyspark.sql import functions as F
from riskloom.llm import common


def test_bitmap_never_misses_and_grows_with_what_it_holds(spark):
    some = spark.range(0, 3000).withColumnRenamed("id", "x").unionByName(spark.createDataFrame([(None,)], "x long"))
    bits = common.Bitmap(some, F.col("x"))
    assert bits.words.count() <= 3001 and 2**bits.bits >= 32 * 3001
    rows = spark.range(0, 60_000).selectExpr("id AS x", "id AS word", "1 AS bits", "2 AS h").unionByName(spark.createDataFrame([(None, 0, 1, 2)], "x long, word long, bits int, h int"))
    maybe, sure = bits.split(rows, F.col("x"))
    assert maybe.columns == rows.columns and sure.columns == rows.columns
    a, b = {r.x for r in maybe.collect()}, {r.x for r in sure.collect()}
    assert not a & b and len(a) + len(b) == 60_001 and {None, *range(3000)} <= a and len(a) < 3000 + 60_000 / 16
    assert {r.x for r in bits.pick(rows, some, "x").collect()} == {None, *range(3000)}
    maybe, sure = common.Bitmap(some.limit(0), F.col("x")).split(rows, F.col("x"))
    assert maybe.count() == 0 and sure.count() == 60_001


def test_a_full_bitmap_sends_all_to_the_first_part_and_picks_the_same(spark, monkeypatch):
    monkeypatch.setattr(common, "BITMAP_BITS", 8)
    some = spark.range(5000)
    bits = common.Bitmap(some, F.col("id"))
    assert bits.words.count() == 4
    rows = spark.range(4000, 8000)
    maybe, sure = bits.split(rows, F.col("id"))
    assert (maybe.count(), sure.count()) == (4000, 0) and bits.pick(rows, some, "id").count() == 1000


def test_tables_can_be_deleted(spark):
    one, two = common.materialise(spark.range(3), "one"), common.materialise(spark.range(4), "two")
    files = [f.removeprefix("file://") for f in one.inputFiles()]
    assert all(os.path.exists(f) for f in files)
    common.discard(one)
    assert not any(os.path.exists(f) for f in files) and two.count() == 4


def test_slices_bound_bytes():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 30, "c" * 5, "", "d" * 100, "e"]})
    parts = list(common.slices(iter([batch]), "t", 40))
    assert [x for p in parts for x in common.texts(p, "t")] == ["a" * 10, "", "b" * 30, "c" * 5, "", "d" * 100, "e"]
    assert [p.num_rows for p in parts] == [3, 2, 1, 1]


def test_the_shared_folder_is_the_session_s(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert common.shared_dir(spark) == folder.rstrip("/") if folder else common.shared_dir(spark).startswith("file:///")
    kept = common.materialise(spark.range(3), "kept")
    assert kept.count() == 3 and common.shared_dir(spark).split("://")[-1] in kept.inputFiles()[0]


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Word int, _word int")
    assert common.fresh(df, "word", "other", "other") == ["__word", "other", "_other"]
