import pytest

from cellweave.sources.store import Project, check_channels
from cellweave.streaming.incremental import process_new_shards


def kinds(spark, values):
    return spark.createDataFrame([(i, f"ch{i}", k) for i, k in enumerate(values)], "c int, channel string, kind string")


def test_channel_checks(spark):
    check_channels(kinds(spark, ["mask", "image_channel"]))
    for bad in (["image_channel"], ["mask", None], ["mask", "other"]):
        with pytest.raises(ValueError):
            check_channels(kinds(spark, bad))
    with pytest.raises(ValueError):
        check_channels(kinds(spark, ["mask"]).drop("kind"))


def test_round_trip_and_windows(spark, tmp_path):
    p = Project(spark, str(tmp_path), {"Cells": {"size": 3}, "other": 1})
    px = spark.createDataFrame([(c, y, x, y * 10 + x) for c in (0, 1) for y in range(6) for x in range(6)], "c int, y int, x int, value int")
    p.write_image(px, channels=["dna", "rna"])
    assert p.read_image(channels=[1], window=(1, 3, 2, 5)).count() == 6
    with pytest.raises(Exception, match="(?i)already exists"):
        p.write_image(px)
    mask = px.where("c = 0 and y in (1, 2)").selectExpr("y", "x", "cast(y as long) as cell_id")
    p.write_mask(mask, "nucleus")
    assert p.read("points", "centers_nucleus").count() == 2
    table = spark.createDataFrame([(1, 0.5), (9, 0.1)], "cell_id long, score double")
    with pytest.raises(ValueError):
        p.write_cell_table(table, "scores", "nucleus")
    p.write_cell_table(table.where("cell_id = 1"), "scores", "nucleus")
    assert p.status()["image/input_image"] and not p.exists("mask", "cytosol")
    assert p.section("Cells") == {"size": 3} and p.section("none")["other"] == 1
    assert p.rename("mask", "nucleus", "old") and p.drop("mask", "old") and not p.exists("mask", "old")


def test_stream_resumes(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(5).write.parquet(source)
    run = lambda: process_new_shards(spark, source, "id long", target, state, lambda df: df.selectExpr("id * 2 as id"))
    run()
    spark.range(5, 8).write.mode("append").parquet(source)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [2 * i for i in range(8)]
