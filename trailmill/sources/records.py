"""Line-based sources: sensor logs, ride files, GeoJSON sequences, tab-separated bundles, object listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# One-letter kinds of a sensor log. Samples: accelerometer, gyro, position, barometer, other.
SAMPLES, DETECTIONS, ANSWERS, MISSED = ("a", "w", "g", "b", "x"), ("e", "j", "s"), ("l", "k", "p"), ("m", "n", "q")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, value: lines of text files with the file they are from."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def sensor_log(lines: DataFrame) -> DataFrame:
    """path, kind, t_us, v (numbers), group, t (seconds from the file's first sample) of log lines ``kind,t,v...``.

    Lines of another form are left out. The origin is the earliest sample of the three kinds that every log has.
    """
    parts = F.split("value", ",")
    rows = lines.select("path", F.trim(parts[0]).alias("kind"), F.get(parts, F.lit(1)).try_cast("long").alias("t_us"), F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: x.try_cast("double")).alias("v"))
    good = rows.filter(F.col("t_us").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    group = F.when(F.col("kind").isin(*SAMPLES), "sample").when(F.col("kind").isin(*DETECTIONS), "detection").when(F.col("kind").isin(*ANSWERS), "answer").when(F.col("kind").isin(*MISSED), "missed")
    origin = F.min(F.when(F.col("kind").isin("a", "w", "g"), F.col("t_us"))).over(W.partitionBy("path"))
    told = good.withColumn("group", group).filter("group is not null")
    return told.withColumn("t", (F.col("t_us") - origin) / 1e6)


RIDE_SCHEMA = "id string, type string, at timestamp, lat double, lng double, acc double, alt double, kind string, name string, startedAt timestamp, endedAt timestamp, choice string, trail string"


def ride_files(lines: DataFrame) -> dict[str, DataFrame]:
    """points, marks, confirmations and rides of ride files, one JSON object a line, told apart by what they hold.

    A ride without an end takes the time of its last point, or its start.
    """
    rows = lines.select("path", F.from_json("value", RIDE_SCHEMA).alias("r")).select("path", "r.*")
    points = rows.filter("lat is not null and lng is not null").select("path", "at", "lat", "lng", "acc", "alt")
    marks = rows.filter("kind is not null").select("path", "at", "kind", "name")
    confirmations = rows.filter("type is not null").select("path", "type", "trail", "at", "choice")
    last = points.groupBy("path").agg(F.max("at").alias("last_at"))
    heads = rows.groupBy("path").agg(F.min("startedAt").alias("started_at"), F.max("endedAt").alias("ended_at"), F.first("id", ignorenulls=True).alias("id"))
    rides = heads.join(last, "path", "left").select("path", "id", "started_at", F.coalesce("ended_at", "last_at", "started_at").alias("ended_at"))
    return {"points": points, "marks": marks, "confirmations": confirmations, "rides": rides}


FEATURE_SCHEMA = "id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"


def geojson_sequence(lines: DataFrame) -> DataFrame:
    """id, tags, geometry_type, coordinates (JSON text) of features, one a line, with or without record separators."""
    text = F.ltrim(F.replace("value", F.lit("\x1e"), F.lit("")))
    rows = lines.select(F.from_json(F.when(F.trim(text) != "", text), FEATURE_SCHEMA).alias("f")).filter("f is not null")
    return rows.select("f.id", F.col("f.properties").alias("tags"), F.col("f.geometry.type").alias("geometry_type"), "f.geometry.coordinates")


def box_centre(coordinates: Column) -> Column:
    """Struct (lon, lat) in the middle of all numbers of a coordinates text, whatever its depth."""
    numbers = F.transform(F.regexp_extract_all(coordinates, F.lit(r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0)), lambda x: x.cast("double"))

    def middle(parity: int) -> Column:
        own = F.filter(numbers, lambda v, k: k % 2 == parity)
        return (F.array_min(own) + F.array_max(own)) / 2

    return F.struct(middle(0).alias("lon"), middle(1).alias("lat"))


def tab_bundle(lines: DataFrame, schema: str) -> DataFrame:
    """key and the fields of a JSON record from lines ``key<tab>record``."""
    parts = F.split("value", "\t", 2)
    return lines.select(parts[0].alias("key"), F.from_json(F.get(parts, F.lit(1)), schema).alias("r")).select("key", "r.*")


def object_listing(spark: SparkSession, path: str) -> DataFrame:
    """key, size, etag, modified of listing files with a ``Contents`` array."""
    raw = spark.read.option("multiLine", "true").schema("Contents array<struct<Key:string,Size:long,ETag:string,LastModified:timestamp>>").json(path)
    return raw.select(F.explode("Contents").alias("c")).select(F.col("c.Key").alias("key"), F.col("c.Size").alias("size"), F.replace("c.ETag", F.lit('"'), F.lit("")).alias("etag"), F.col("c.LastModified").alias("modified"))


def error_digest(errors: DataFrame) -> DataFrame:
    """week, context, error_type with n, versions, platforms and the first message, the most frequent first by n."""
    week = (F.expr("extract(yearofweek from created_at)") * 100 + F.weekofyear("created_at")).cast("int")
    sets = lambda c: F.sort_array(F.collect_set(c))
    return errors.groupBy(week.alias("week"), "context", "error_type").agg(F.count("*").alias("n"), sets("app_version").alias("versions"), sets("platform").alias("platforms"), F.min_by("message", "created_at").alias("example"))


def write_cells(records: DataFrame, path: str) -> DataFrame:
    """Write records (cell, group, id, ...) as JSON in folders by cell and group, sorted by id; returns counts as the manifest."""
    unique = records.dropDuplicates(["cell", "group", "id"])
    unique.repartition("cell", "group").sortWithinPartitions("cell", "group", "id").write.partitionBy("cell", "group").json(path)
    return unique.groupBy("group").agg(F.count("*").alias("records"), F.count_distinct("cell").alias("cells"))


def guarded_update(old: DataFrame, new: DataFrame, key: str, closed: Column) -> tuple[bool, str]:
    """May a new table replace an old one? Not if over a third of it is gone or newly closed."""
    was, now = old.count(), new.count()
    if was and now < was * 2 / 3:
        return False, f"rows fell from {was} to {now}"
    before = old.filter(closed).select(key)
    fresh = new.filter(closed).join(before, key, "left_anti").join(old.select(key), key, "left_semi").count()
    if was and fresh > was / 3:
        return False, f"{fresh} of {was} rows are newly closed"
    return True, "ok"
