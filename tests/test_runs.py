import pytest
from pyspark.sql import functions as F

from cellweave.operators import augment, plates
from cellweave.plans import runs
from cellweave.sources import metrics

HEAD = '<?xml version="1.0"?><EvaluationInputData xmlns="http://www.perkinelmer.com/PEHH/{}" Version="1"><Images>{}</Images></EvaluationInputData>'
IMAGE = "<Image><URL>a</URL><Row>2</Row><Col>11</Col><FieldID>3</FieldID><PlaneID>1</PlaneID><TimepointID>0</TimepointID><ChannelID>{}</ChannelID>{}<FlimID>1</FlimID><PositionX>-0.5</PositionX><PositionY>1e-3</PositionY><AbsTime>2022-11-05T12:30:11.12+01:00</AbsTime></Image>"


def documents(spark, **xml):
    return spark.createDataFrame(list(xml.items()), "name string, xml string")


def test_plate_versions(spark):
    body = IMAGE.format("4", "<ChannelName>Alexa 647</ChannelName>") + IMAGE.format("1", "<ChannelName>DAPI</ChannelName>") + IMAGE.format("1", "")
    docs = documents(spark, five=HEAD.format("HarmonyV5", body), seven=HEAD.format("HarmonyV7", body), none=HEAD.format("HarmonyV7", ""))
    plain = {(r.name, r.filename): r for r in plates.plate_index(docs).collect()}
    assert set(plain) == {("five", "r02c11f03p01-ch4sk1fk1fl1.tiff"), ("five", "r02c11f03p01-ch1sk1fk1fl1.tiff"), ("seven", "r02c11f03p01-ch4sk0fk1fl1.tiff"), ("seven", "r02c11f03p01-ch1sk0fk1fl1.tiff")}
    row = plain["five", "r02c11f03p01-ch4sk1fk1fl1.tiff"]
    assert (row.channel, row.timepoint, row.px, row.py, row.date, row.unix_time) == ("Alexa647", 1, -0.5, 0.001, "2022-11-05", 1667647811)
    flat = {r.filename for r in plates.plate_index(docs, flatfield=True).where("version = 'HarmonyV7'").collect()}
    assert flat == {"r02c11f03p01-ch4t00.tiff", "r02c11f03p01-ch1t00.tiff"}
    assert {r.channel for r in plates.plate_index(docs).where("filename like '%ch1%'").collect()} == {"DAPI"}  # an image without a name takes its channel's


def test_other_versions_are_refused(spark):
    with pytest.raises(Exception, match="unknown version of odd"):
        plates.plate_index(documents(spark, odd=HEAD.format("HarmonyV9", ""))).collect()
    assert plates.plate_index(documents(spark, x="").where("false")).count() == 0


def test_a_plate_of_many_files(spark, tiny, monkeypatch):
    """index files hold a bounded number of images; a channel's name may come from another file of the plate."""
    first, second = (HEAD.format("HarmonyV5", IMAGE.format("4", name)) for name in ("<ChannelName>Alexa 647</ChannelName>", ""))
    got = plates.plate_index(spark.createDataFrame([("a", first), ("a", second)], "name string, xml string")).collect()
    assert [r.channel for r in got] == ["Alexa647"] * 2

    seen, index = [], plates.plate_index
    monkeypatch.setattr(runs, "_FILE_IMAGES", 20, raising=False)
    monkeypatch.setattr(plates, "plate_index", lambda docs: seen.append(docs) or index(docs))
    n = runs.s17_plate_xml(spark, tiny).count()
    files = [r.xml.count("</Image>") for r in seen[0].collect()]
    assert sum(files) == n and max(files) <= 20


def test_metrics_are_counted_once(spark, tmp_path):
    df, table = spark.range(1000).repartition(7), f"{tmp_path}/metrics"
    got = metrics.measured(df, lambda x: x.write.parquet(f"{tmp_path}/a"), "first", table, "r1", odd=F.count_if(F.col("id") % 2 == 1), top=F.max("id"))
    assert got == {"rows": 1000.0, "odd": 500.0, "top": 999.0}
    assert metrics.measured(df.where("id < 0"), lambda x: x.write.parquet(f"{tmp_path}/b"), "empty", table, "r1", top=F.max("id")) == {"rows": 0.0}
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        metrics.measured(df, lambda x: x.write.parquet(f"{tmp_path}/a"), "again", table)
    rows = {r.stage: r for r in metrics.read_metrics(spark, table).collect()}
    assert set(rows) == {"first", "empty"} and rows["first"].metrics["rows"] == 1000 and rows["first"].run == "r1" and rows["first"].seconds > 0


CHAIN = [augment.quarter_turns(), augment.flip(), augment.scale(0.5, 2.0), augment.noise(3.0)]


def crops(spark, n=40, side=6):
    return spark.createDataFrame([(i, y, x, float(100 * i + 10 * y + x)) for i in range(n) for y in range(side) for x in range(side)], "cell_id long, y int, x int, value double")


def test_draws_do_not_depend_on_partitions(spark):
    px = crops(spark)
    key = lambda df: sorted(map(tuple, df.collect()))
    once = key(augment.apply_chain(px.repartition(2), CHAIN, 6, seed=1, epoch=3))
    assert once == key(augment.apply_chain(px.repartition(9, "x"), CHAIN, 6, seed=1, epoch=3))
    assert once != key(augment.apply_chain(px, CHAIN, 6, seed=1, epoch=4))
    assert once != key(augment.apply_chain(px, CHAIN, 6, seed=2, epoch=3))
    assert key(augment.apply_chain(px, [], 6)) == key(px)


def test_turns_and_flips_keep_each_cell(spark):
    px = crops(spark)
    out = augment.apply_chain(px, [augment.quarter_turns(), augment.flip()], 6)
    seen = {}
    for r in out.collect():
        seen.setdefault(r.cell_id, {})[r.y, r.x] = r.value
    kinds = set()
    for i, cell in seen.items():
        assert sorted(cell) == [(y, x) for y in range(6) for x in range(6)]
        assert sorted(cell.values()) == sorted(100.0 * i + 10 * y + x for y in range(6) for x in range(6))
        assert abs(cell[0, 1] - cell[0, 0]) in (1, 10)
        kinds.add((cell[0, 0] - 100 * i, cell[0, 1] - cell[0, 0]))
    assert len(kinds) == 8  # all turns of a square, flipped or not


def test_noise_has_its_spread(spark):
    px = spark.createDataFrame([(i, y, x, 0.0) for i in range(50) for y in range(10) for x in range(10)], "cell_id long, y int, x int, value double")
    m = augment.apply_chain(px, [augment.noise(2.0)], 10).agg(F.avg("value").alias("m"), F.stddev("value").alias("s")).first()
    assert abs(m.m) < 0.15 and abs(m.s - 2) < 0.1
