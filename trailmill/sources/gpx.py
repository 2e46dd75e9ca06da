"""GPX tracks as rows: whole files in, one row for each track or route out, and back."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decoded_name

POINT = "struct<lat:double,lon:double,ele:double,t:string>"
SCHEMA = f"path string, kind string, track_no int, name string, link string, points array<{POINT}>, error string"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def children(e: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [c for c in e if local(c.tag) == name]


def words(e: ElementTree.Element, name: str) -> str | None:
    """Text of the first child of a name, null if blank."""
    found = children(e, name)
    return ("".join(found[0].itertext()).strip() or None) if found else None


def link_of(e: ElementTree.Element) -> str | None:
    """The first https link of an element."""
    options = [c.get("href") for c in children(e, "link")] + [words(e, "url")]
    return next((x.strip() for x in options if x and x.strip().startswith("https://")), None)


def points_of(elements: list[ElementTree.Element]) -> list[dict]:
    """Points with usable coordinates; a point at the place of the one before is left out."""
    found: list[dict] = []
    for e in elements:
        try:
            lat, lon = float(e.get("lat", "")), float(e.get("lon", ""))
            ele = words(e, "ele")
            height = float(ele) if ele else None
        except ValueError:
            continue
        if not (-90 <= lat <= 90 and -180 <= lon <= 180):
            continue
        if found and abs(lat - found[-1]["lat"]) < 1e-9 and abs(lon - found[-1]["lon"]) < 1e-9:
            continue
        found.append({"lat": lat, "lon": lon, "ele": height, "t": words(e, "time")})
    return found


def tracks_of(path: str, content: bytes) -> Iterator[dict]:
    """Tracks, then routes, of one file; a file that cannot be read gives one row with the error."""
    row = {"path": path, "kind": None, "track_no": None, "name": None, "link": None, "points": None, "error": None}
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        yield row | {"error": str(e)}
        return
    if local(root.tag) != "gpx":
        yield row | {"error": f"root element {local(root.tag)}"}
        return
    file_link = next((link_of(m) for m in children(root, "metadata")), None)
    number = 0
    for kind, parts in (("trk", "trkseg"), ("rte", None)):
        for e in children(root, kind):
            groups = [children(s, "trkpt") for s in children(e, parts)] if parts else [children(e, "rtept")]
            points = points_of([p for g in groups for p in g])
            if len(points) >= 2:
                yield row | {"kind": kind, "track_no": number, "name": words(e, "name"), "link": link_of(e) or file_link, "points": points}
                number += 1


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, track_no, name, link, points (lat, lon, ele, t), error of all GPX files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gpx").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in tracks_of(p, c)]
            yield pd.DataFrame(rows, columns=["path", "kind", "track_no", "name", "link", "points", "error"]).astype({"track_no": "Int32"})

    raw = files.mapInPandas(batches, SCHEMA)
    stamp = lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["ele"].alias("ele"), F.try_to_timestamp(p["t"]).alias("t"))
    return raw.withColumn("name", decoded_name(F.col("name"))).withColumn("points", F.transform("points", stamp))


def escaped(text: Column) -> Column:
    """Text for XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def gpx_text(name: Column, link: Column, points: Column, creator: str = "trailmill") -> Column:
    """A GPX 1.1 file with one track; heights, times and link only where they are there."""

    def point(p: Column) -> Column:
        at = F.concat(F.lit('<trkpt lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lon"].cast("string"), F.lit('">'))
        ele = F.coalesce(F.concat(F.lit("<ele>"), p["ele"].cast("string"), F.lit("</ele>")), F.lit(""))
        time = F.coalesce(F.concat(F.lit("<time>"), F.date_format(p["t"], "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</time>")), F.lit(""))
        return F.concat(at, ele, time, F.lit("</trkpt>"))

    head = F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1"><trk>')
    named = F.coalesce(F.concat(F.lit("<name>"), escaped(name), F.lit("</name>")), F.lit(""))
    linked = F.coalesce(F.concat(F.lit('<link href="'), escaped(link), F.lit('"/>')), F.lit(""))
    return F.concat(head, named, linked, F.lit("<trkseg>"), F.array_join(F.transform(points, point), ""), F.lit("</trkseg></trk></gpx>\n"))


def write_gpx(tracks: DataFrame, path: str) -> None:
    """One file of one line-free text for each track (track_id, name, link, points), in folders by track_id."""
    tracks.select("track_id", F.replace(gpx_text(F.col("name"), F.col("link"), F.col("points")), F.lit("\n"), F.lit("")).alias("value")).repartition("track_id").write.partitionBy("track_id").text(path)
