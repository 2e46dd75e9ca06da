from pyspark.sql import functions as F

from trailmill.sources import gpx, records

GPX = """<?xml version="1.0"?><gpx xmlns="http://www.topografix.com/GPX/1/1"><metadata><link href="https://file.example/x"/></metadata>
<trk><name>A%20trail</name><trkseg><trkpt lat="47.0" lon="11.0"><ele>500</ele><time>2024-01-01T10:00:00Z</time></trkpt><trkpt lat="47.0" lon="11.0"/><trkpt lat="95" lon="1"/></trkseg>
<trkseg><trkpt lat="47.1" lon="11.1"/></trkseg></trk><trk><name>one point</name><trkseg><trkpt lat="1" lon="1"/></trkseg></trk>
<rte><link href="https://own.example/"/><rtept lat="1" lon="1"/><rtept lat="2" lon="2"/></rte></gpx>"""


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(GPX)
    (tmp_path / "b.gpx").write_text("<kml/>")
    (tmp_path / "c.gpx").write_text("<gpx")
    found = gpx.read_gpx(spark, str(tmp_path))
    good = found.filter("error is null").orderBy("track_no").collect()
    assert [(r.kind, r.name, r.link, len(r.points)) for r in good] == [("trk", "A trail", "https://file.example/x", 2), ("rte", None, "https://own.example/", 2)]
    assert good[0].points[0].ele == 500 and good[0].points[0].t is not None and good[0].points[1].ele is None
    assert found.filter("error is not null").count() == 2
    out = tmp_path / "out"
    gpx.write_gpx(found.filter("kind = 'trk'").withColumn("track_id", F.lit(7)), str(out))
    text = spark.read.text(f"{out}/track_id=7").first().value
    again = list(gpx.tracks_of("x", text.encode()))
    assert again[0]["name"] == "A trail" and [(p["lat"], p["lon"], p["ele"]) for p in again[0]["points"]] == [(47.0, 11.0, 500.0), (47.1, 11.1, None)]


def test_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text("a,1000000,1,2,3\nnonsense\ng,1500000,7\nb,x,1\nj,2000000,9\nq,5\na,3000000,1,zz\n")
    rows = records.sensor_log(records.read_lines(spark, str(tmp_path / "log.txt"))).orderBy("t_us").collect()
    assert [(r.kind, r.group, r.t) for r in rows] == [("q", "missed", -0.999995), ("a", "sample", 0.0), ("g", "sample", 0.5), ("j", "detection", 1.0)]
    (tmp_path / "f.geojsonseq").write_text('\x1e{"id": "n1", "properties": {"k": "v"}, "geometry": {"type": "LineString", "coordinates": [[11.0, 47.0], [12.0, 48.0]]}}\n\n')
    (f,) = records.geojson_sequence(records.read_lines(spark, str(tmp_path / "f.geojsonseq"))).withColumn("c", records.box_centre(F.col("coordinates"))).collect()
    assert f.tags == {"k": "v"} and tuple(f.c) == (11.5, 47.5)
    (tmp_path / "ride.jsonl").write_text('{"id": "r", "startedAt": "2024-01-01T10:00:00Z"}\n{"at": "2024-01-01T10:05:00Z", "lat": 47, "lng": 11}\n{"kind": "start", "at": "2024-01-01T10:01:00Z"}\n{"type": "ask", "trail": "t", "at": "2024-01-01T10:02:00Z"}\n')
    parts = records.ride_files(records.read_lines(spark, str(tmp_path / "ride.jsonl")))
    assert {k: v.count() for k, v in parts.items()} == {"points": 1, "marks": 1, "confirmations": 1, "rides": 1}
    assert parts["rides"].first().ended_at == parts["points"].first()["at"]
    (tmp_path / "t.tsv").write_text('ab\t{"id": "1", "n": 2}\n')
    assert tuple(records.tab_bundle(records.read_lines(spark, str(tmp_path / "t.tsv")), "id string, n int").first()) == ("ab", "1", 2)
    (tmp_path / "l.json").write_text('{"Contents": [{"Key": "a/b", "Size": 5, "ETag": "\\"x\\"", "LastModified": "2024-01-01T00:00:00Z"}]}')
    assert tuple(records.object_listing(spark, str(tmp_path / "l.json")).select("key", "size", "etag").first()) == ("a/b", 5, "x")


def test_cells_and_guards(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "g", "1", "x"), ("c1", "g", "1", "x"), ("c2", "g", "2", "y")], "cell string, group string, id string, name string")
    assert tuple(records.write_cells(rows, str(tmp_path / "cells")).first()) == ("g", 2, 2)
    assert spark.read.json(str(tmp_path / "cells")).count() == 2
    table = lambda n, shut: spark.createDataFrame([(k, k < shut) for k in range(n)], "id int, shut boolean")
    ok = lambda new: records.guarded_update(table(9, 0), new, "id", F.col("shut"))[0]
    assert ok(table(7, 2)) and not ok(table(5, 0)) and not ok(table(9, 4))
