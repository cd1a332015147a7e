import pytest

from cellweave.operators import plates, sampling


def clusters(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "px double")
    return [r["x_pos"] for r in plates.cluster_positions(df, "px", "x_pos").orderBy("px").collect()]


def test_gap_clusters(spark):
    assert clusters(spark, [0, 0.001, 0.002, 1, 1.001, 1.002, 2, 2.001]) == [0, 0, 0, 1, 1, 1, 2, 2]
    assert clusters(spark, [0.0, 1.0, 2.0]) == [0, 1, 2]
    assert clusters(spark, [5.0]) == [0]


def test_first_measurement_wins(spark):
    rows = [("A", 0.0, "tile_a0", 0), ("A", 1.0, "tile_a1", 0), ("A", 0.001, "tile_b1", 1), ("A", 2.0, "tile_b2", 1)]
    tiles = spark.createDataFrame(rows, "well string, px double, file string, rank int")
    placed = plates.cluster_positions(tiles, "px", "x_pos", ["well"]).select("well", "x_pos", "file", "rank")
    got = {(r["x_pos"], r["file"]) for r in plates.first_measurement(placed, ["well", "x_pos"], "rank").collect()}
    assert got == {(0, "tile_a0"), (1, "tile_a1"), (2, "tile_b2")}


def test_missing_tiles(spark):
    tiles = spark.createDataFrame([(y, x) for y in range(3) for x in range(4) if (y, x) != (1, 2)], "y int, x int")
    assert [tuple(r) for r in plates.missing_tiles(tiles, ["y", "x"]).collect()] == [(1, 2)]


def test_xml_metadata(spark, tmp_path):
    (tmp_path / "Index.xml").write_text('<Images><Image id="1"><URL>a.tif</URL><Row>2</Row><Col>3</Col><PlaneID>1</PlaneID><TimepointID>0</TimepointID><ChannelID>1</ChannelID><ChannelName>HOECHST 33342</ChannelName><PositionX>0.5</PositionX><PositionY>-0.5</PositionY><AbsTime>2024-01-02T03:04:05.0+00:00</AbsTime></Image></Images>')
    row = plates.images_from_xml(spark, str(tmp_path)).first()
    assert (row["row_id"], row["well"], row["px"], row["filename"]) == ("02", "03", 0.5, "a.tif")
    assert plates.channels_from_xml(spark, str(tmp_path)).first()["name"] == "HOECHST33342"


def test_splits(spark):
    rows = spark.range(103)
    split = sampling.split_fractions(rows, [0.8, 0.1, 0.1], ["a", "b", "c"], "id")
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"a": 83, "b": 10, "c": 10}
    with pytest.raises(ValueError):
        sampling.split_fractions(rows, [0.8, 0.1], ["a", "b"], "id")
    assert sampling.sample_n(rows, 10, "id", 5).distinct().count() == 10
