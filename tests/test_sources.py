import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rainledger.sources import readers, sinks
from rainledger.streaming import runs

DOC = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'


def docx(*lines):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", DOC.format("".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in lines)))
    return buffer.getvalue()


def test_docx_archives(spark, tmp_path):
    for name, files in (("b.zip", {"2.docx": docx("een", "twee"), "1.docx": b"kapot", "x.txt": b""}), ("a.zip", {"z.docx": docx("drie")})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for f, content in files.items():
                z.writestr(f, content)
    rows = readers.read_docx_archives(spark, str(tmp_path)).orderBy("article_id").collect()
    assert [tuple(r) for r in rows] == [(0, "a.zip", "z.docx", "drie"), (1, "b.zip", "1.docx", None), (2, "b.zip", "2.docx", "een\ntwee")]


@pytest.mark.parametrize("wrap", [lambda a: a, lambda a: {"sample": a}, lambda a: {"articles": a}])
def test_articles_in_any_wrapping(spark, tmp_path, wrap):
    (tmp_path / "a.json").write_text(json.dumps(wrap([{"id": "x", "features": {"article_id": 7, "clean_text": "t"}}, {"id": "", "text_content": " "}])))
    rows = readers.normalised_corpus(readers.read_articles(spark, str(tmp_path))).orderBy("text").collect()
    assert ("x", "t") in {(r["id"], r["text"]) for r in rows} and len(rows) == 2


def test_checkpoint_last_wins(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"k": 1, "v": "a"}\n\n{kapot\n{"k": 1, "v": "b"}\n{"k": 2, "v": null}\n')
    assert sorted(map(tuple, readers.read_checkpoint(spark, str(tmp_path), "k int, v string", "k").collect())) == [(1, "b"), (2, None)]


def test_points_csv(spark, tmp_path):
    head = [c.split()[0] for c in readers.POINT_COLUMNS.split(", ")]
    line = ["i", "1", "m", "2020-13-01", "f", "0", "P", "c", "", "0.456", '"regel\n""twee"""', "x", "52.1", "5.2", "city"]
    bad = line[:12] + ["", "5.2", "city"]
    (tmp_path / "p.csv").write_text(",".join(head) + "\n" + ",".join(line) + "\n" + ",".join(bad) + "\n")
    rows = readers.read_points(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0]["severity"] == 1 and rows[0]["confidence"] == 0.46 and rows[0]["publication_date"] is None and rows[0]["recency_in_months"] is None and rows[0]["evidence"] == 'regel\n"twee"'


def test_daily_grid_manifest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "k.txt").write_text("# kop\n20200101  1.5\n20200101 2.5\nkapot\n20200102 x\n")
    assert sorted((str(r[0]), r[1]) for r in readers.read_daily(spark, str(tmp_path / "d")).collect()) == [("2020-01-01", 2.5), ("2020-01-02", None)]
    (tmp_path / "g.csv").write_text("x,y,time,wildfires_sum,a,b\n1,2,2020-01-01,1,5,6\n1,2,2020-01-01,0,5,6\n,2,2020-01-01,3,5,6\n")
    assert [tuple(r)[3:] for r in readers.read_grid(spark, str(tmp_path / "g.csv"), ["a"]).collect()] == [(1.0, 5.0)]
    (tmp_path / "m.csv").write_text("group,feature\nt,year\nt,month\nu,x\n")
    assert readers.read_manifest(spark, str(tmp_path / "m.csv")) == {"t": ["month"], "u": ["x"]}


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    feature = lambda i, kind, c: {"type": "Feature", "properties": {"NUTS_ID": i, "LEVL_CODE": 3, "NUTS_NAME": "n"}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "r.json").write_text(json.dumps({"features": [feature("A", "Polygon", [ring]), feature("B", "MultiPolygon", [[ring], [ring]]), feature("", "Polygon", [ring])]}))
    got = {r["nuts_id"]: len(r["rings"]) for r in readers.read_geojson(spark, str(tmp_path / "r.json"), 3).collect()}
    assert got == {"A": 1, "B": 2}


def test_stations(spark, tmp_path):
    head = "\n\nTHIS FILE HOLDS DATA FOR STATION NETHERLANDS   DE   BILT   (STAID:    9)\nLATITUDE: dd:mm:ss +52:06:00\nLONGITUDE: ddd:mm:ss -005:30:00\nELEVATION: m   -4\n"
    (tmp_path / "s.txt").write_text(head + " 9    1950 -999999 100\n text\n")
    (tmp_path / "t.txt").write_text("no header\n")
    stations, series = readers.read_station_files(spark, str(tmp_path), "NETHERLANDS")
    assert [tuple(r)[:5] for r in stations.collect()] == [(9, "NETHERLANDS DE BILT", 52.1, -5.5, -4)]
    assert sorted(map(tuple, series.collect())) == [(9, 1950, "annual", None), (9, 1950, "winter_half", 1.0)]


def test_raster_decoder_and_sinks(spark, tmp_path):
    import datetime

    (tmp_path / "r.bin").write_bytes(b"x")
    t = datetime.datetime(2020, 1, 1)
    cells = readers.read_raster(spark, str(tmp_path / "r.bin"), lambda b: [(1.0, 2.0, t, 3.0), (1.0, 2.0, t, 1e20), (1.0, 2.0, t, -9.0)], -9.0)
    assert sorted((r["value"] for r in cells.collect()), key=str) == [3.0, None, None]
    articles = spark.read.parquet("/root/testdata/sf0.001/sample_impacts.parquet")
    rows = sinks.point_rows(articles)
    sinks.write_csv(rows, str(tmp_path / "out"), ["id", "location", "missing"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["id", "location", "missing"]
    assert sinks.batch_summary(rows, "model_name", "publication_date", {"least": 0.3}).count() > 0


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        runs.run_available(stream().select("event_id"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    got = []
    runs.run_each(stream().select("event_id"), lambda batch, number: got.append(batch.count()), str(tmp_path / "each"))
    assert sum(got) == events.count()
    batch = runs.windowed_counts(events, "ts", "event_type")
    assert batch.agg(F.sum("n")).first()[0] == events.count()


def test_asking_retries_and_resumes(spark):
    from rainledger.sources import answers

    def ask(text):
        if text == "slecht":
            raise ValueError("nee")
        return text.upper()

    rows = spark.createDataFrame([(1, "a"), (2, "slecht"), (3, None), (4, "b")], "id int, text string")
    done = spark.createDataFrame([(4, "klaar"), (9, "weg")], "id int, answer string")
    out = answers.resume(rows, done, ask, base=0.0)
    assert {tuple(r) for r in out.collect()} == {(1, "A"), (2, "Error: nee"), (3, None), (4, "klaar")}
    assert tuple(answers.usage_totals(out).first()) == (4, 1, 6)


def test_a_later_checkpoint_file_wins(spark, tmp_path):
    import os

    for name, value, at in (("b.jsonl", "oud", 1_000_000), ("a.jsonl", "nieuw", 2_000_000)):
        (tmp_path / name).write_text(json.dumps({"k": 1, "v": value}) + "\n")
        os.utime(tmp_path / name, (at, at))
    assert [tuple(r) for r in readers.read_checkpoint(spark, str(tmp_path), "k int, v string", "k").collect()] == [(1, "nieuw")]


def test_text_preference(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "text_content": "heel", "features": {"clean_text": "schoon"}}]))
    rows = readers.read_articles(spark, str(tmp_path))
    assert [readers.normalised_corpus(rows, c).first()["text"] for c in (False, True)] == ["heel", "schoon"]


def test_regions_csv(spark, tmp_path):
    head = [c.split()[0] for c in readers.REGION_COLUMNS.split(", ")]
    line = ["i", "1", "m", "2020-02-03", "f", "0", "De Jordaan", "c", "3", "0.5", "e", "x", "", "", "city", "nuts3", " NX1 ", "", "NX11", "", "12", "", ""]
    (tmp_path / "r.csv").write_text(",".join(head) + "\n" + ",".join(line) + "\n")
    r = readers.read_regions(spark, str(tmp_path)).first()
    assert (r["mention_weight"], r["nuts2_id"], r["nuts2_name"], r["nuts_match_distance_m"], r["severity"], str(r["year_month"])) == (1.0, "NX1", "", 12, 3, "2020-02-01")
    assert r["geocoded_place_rank"] == 1 and r["geocoded_is_low_quality"] and r["geocoded_latitude"] is None


def test_long_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("group,feature\n" + "".join(f"g,f{i}\n" for i in range(10_050)))
    assert len(readers.read_manifest(spark, str(tmp_path / "m.csv"))["g"]) == 10_050


def test_xml_polygons(spark, tmp_path):
    part = "<soil><code>{}</code><geom><out><posList>{}</posList></out>{}</geom></soil>"
    hole = "<in><posList>10 10 20 10 20 20 10 20 10 10</posList></in>"
    (tmp_path / "s.xml").write_text("<all>" + part.format("v", "0 0 1000 0 1000 1000 0 1000 0 0", hole) + part.format("z", "0 0 10 0 10 10 0 0", "") + "</all>")
    got = {r["class"]: (len(r["rings"]), r["area_km2"]) for r in readers.read_xml_polygons(spark, str(tmp_path / "s.xml"), "soil", "code", "geom.out.posList", "geom.in.posList").collect()}
    assert got["v"][0] == 2 and abs(got["v"][1] - 0.9999) < 1e-9 and got["z"][0] == 1 and abs(got["z"][1] - 5e-5) < 1e-12


def test_raster_archives_and_clip(spark, tmp_path):
    import datetime

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("b.tif", b"2")
        z.writestr("a.tif", b"1")
        z.writestr("x.txt", b"")
    t = datetime.datetime(2003, 1, 1)
    cells = readers.read_raster_archives(spark, str(tmp_path / "r.zip"), lambda b: [(4.0, 51.0, t, float(b)), (9.0, 51.0, t, 7.0)])
    assert sorted((r["path"].rsplit("/", 1)[-1], r["value"]) for r in readers.clipped(cells, 50.75, 53.55, 3.35, 7.25).collect()) == [("a.tif", 1.0), ("b.tif", 2.0)]
    assert readers.clipped(cells, 50.75, 53.55, 3.35, 7.25, 2004).count() == 0


def test_documents_and_region_rows(spark, tmp_path):
    sinks.write_document(spark, f"file://{tmp_path}/best.json", {"c": 0.01, "naam": "é"})
    sinks.write_document(spark, f"file://{tmp_path}/best.json", {"c": 0.1})
    assert sinks.read_document(spark, f"file://{tmp_path}/best.json") == {"c": 0.1}
    regions = spark.createDataFrame([("A1", "een", "A"), ("B1", "twee", "B"), ("A", "groot", None), ("B", "ander", None)], "nuts_id string, name string, parent_id string")
    impacts, found = spark.createDataFrame([(1,), (2,)], "row_id long"), spark.createDataFrame([(1, "A1", 0.5), (1, "B1", 0.5), (2, None, 1.0)], "row_id long, region_id string, weight double")
    for first, parents in ((False, {"A1": "A", "B1": "B"}), (True, {"A1": "A", "B1": "A"})):
        rows = sinks.region_rows(impacts, found, regions, first).collect()
        assert {r["nuts3_id"]: r["nuts2_id"] for r in rows if r["nuts3_id"]} == parents and len(rows) == 3


def test_first_seen_drops_repeats_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")], "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    runs.run_available(runs.first_seen(stream, "t", "k"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
