"""Cost and time of road edges as column expressions over a small class table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Road classes with their factors up and down (null: the rider's path factors), factor on easy tours,
# and whether they are for hiking, pushed, ridden at path speed, climbed at path rate; factor of steep metres.
CLASSES = [
    ("forest_road", 1.0, 1.0, 1.15, False, False, False, False, 3.0),
    ("cycleway", 1.0, 1.0, 1.0, False, False, False, False, 1.0),
    ("side_road", 1.2, 1.2, 1.0, False, False, False, False, 1.0),
    ("access_road", 1.2, 1.2, 1.0, False, False, False, False, 1.0),
    ("path", None, None, 3.0, True, False, True, True, 3.0),
    ("footway", 2.0, 2.5, 2.5, True, False, True, True, 3.0),
    ("steps", 3.0, 3.0, 6.0, True, True, False, False, 0.0),
    ("country_road", 1.6, 1.6, 1.3, False, False, False, False, 1.0),
    ("main_road", 2.5, 2.5, 2.0, False, False, False, False, 1.0),
    ("trunk_road", 4.0, 4.0, 4.0, False, False, False, False, 1.0),
]
CLASS_SCHEMA = "cls string, up double, down double, easy double, hiking boolean, pushing boolean, path_speed boolean, path_rate boolean, steep double"
# Riders with climb rates in m/h, speeds in km/h, factors on paths, climb budget in m.
RIDERS = [("muscle", 450.0, 350.0, 300.0, 15.0, 8.0, 3.0, 25.0, 1.4, 2.0, 800.0), ("electric", 850.0, 650.0, 220.0, 20.0, 10.0, 2.5, 25.0, 2.0, 2.5, 1400.0)]
RIDER_SCHEMA = "rider string, climb_track double, climb_path double, push_rate double, v_flat double, v_path_up double, v_push double, v_down double, up_factor double, down_factor double, climb_budget double"
# km/h by trail grade S0 to S5, and without a grade.
TRAIL_KMH, TRAIL_KMH_UNKNOWN = [16.0, 12.0, 9.0, 6.0, 4.0, 4.0], 10.0
DESCENT_SHARE, CARRY_S, EASY_CLIMB = 0.3, 60.0, 1.5


def class_table(spark: SparkSession) -> DataFrame:
    """The road classes."""
    return spark.createDataFrame(CLASSES, CLASS_SCHEMA)


def rider_table(spark: SparkSession) -> DataFrame:
    """The riders."""
    return spark.createDataFrame(RIDERS, RIDER_SCHEMA)


def road_class(kind: Column, detail: Column, access: Column, service: Column) -> Column:
    """Class of a road by its tags; null where bicycles are not let in or the kind is unknown."""
    path = F.when(detail == "track", "forest_road").when(detail == "cycleway", "cycleway").when(detail.isin("path", "bridleway"), "path").when(detail.isin("footway", "pedestrian"), "footway").when(detail == "steps", "steps")
    minor = F.when(F.coalesce(detail, F.lit("")) != "service", "side_road").when(~F.coalesce(service, F.lit("")).isin("driveway", "parking_aisle"), "access_road")
    open_ = ~F.coalesce(access, F.lit("")).isin("private", "no")
    found = F.when(kind == "major_road", F.when(F.coalesce(detail, F.lit("")).startswith("primary"), "trunk_road").otherwise("main_road")).when(kind == "medium_road", "country_road").when(kind == "minor_road", minor).when(kind == "path", path)
    return F.when(open_, found)


def trail_kmh(grade: Column) -> Column:
    """Speed down a trail of a grade."""
    return F.coalesce(F.get(F.array(*map(F.lit, TRAIL_KMH)), grade), F.lit(TRAIL_KMH_UNKNOWN))


def trail_time(length: Column, grade: Column) -> Column:
    """Seconds down a trail."""
    return length / (trail_kmh(grade) / 3.6)


def climb_rate() -> Column:
    """Metres of climb in a second, by the columns of a class and a rider."""
    return F.when(F.col("pushing"), F.col("push_rate")).when(F.col("path_rate"), F.col("climb_path")).otherwise(F.col("climb_track")) / 3600


def edge_time() -> Column:
    """Seconds along an edge (length, gain, loss) of a class by a rider."""
    downhill = F.col("loss") > F.col("gain")
    down = F.when(F.col("cls") == "path", TRAIL_KMH_UNKNOWN).when(F.col("hiking"), F.col("v_path_up")).otherwise(F.col("v_down"))
    level = F.when(F.col("path_speed"), F.col("v_path_up")).otherwise(F.col("v_flat"))
    speed = F.when(F.col("pushing"), F.col("v_push")).when(downhill, down).otherwise(level)
    return F.col("length") / (speed / 3.6) + F.col("gain") / climb_rate()


def way_cost() -> Column:
    """Extra seconds uphill for the quality of a way (``way`` 1 to 8, ``uphill`` 0 to 5)."""
    way, uphill, gain, loss, length = (F.col(c) for c in ("way", "uphill", "gain", "loss", "length"))
    track = F.when(way == 3, 0.3 * gain / (F.col("climb_track") / 3600) + 0.15 * length / (F.col("v_flat") / 3.6)).when(way == 7, 1.0 * gain / (F.col("climb_track") / 3600) + 0.3 * length / (F.col("v_flat") / 3.6))
    pushed = length / (F.col("v_push") / 3.6) + gain / (F.col("push_rate") / 3600)
    share = F.when(uphill.isNotNull(), F.when(uphill == 3, 1.0).when(uphill.isin(4, 5), 2.0)).otherwise(F.when(way == 6, 1.0).when(way == 8, 2.0))
    path = F.when(uphill == 2, 0.5 * gain / (F.col("climb_path") / 3600)).otherwise(F.greatest(F.lit(0.0), share * pushed - edge_time()))
    return F.coalesce(F.when(loss > gain, 0.0).when(F.col("cls") == "forest_road", track).when((F.col("cls") == "path") & (gain > loss), path), F.lit(0.0))


def edge_cost(descent: bool = True, easy: bool = False, steep_strength: float = 1.0) -> Column:
    """Cost of an edge in seconds: time by factor, steep metres, wasted descent, carrying, way quality."""
    downhill = F.col("loss") > F.col("gain")
    factor = F.col("easy") if easy else F.when(downhill, F.coalesce("down", "down_factor")).otherwise(F.coalesce("up", "up_factor"))
    steep = F.when(F.col("steep") > 0, F.greatest("steep", F.lit(3.0))).otherwise(F.col("steep")) if easy else F.col("steep")
    cost = edge_time() * factor + F.coalesce("steep_w", F.lit(0.0)) / climb_rate() * steep * steep_strength
    if descent:
        cost = cost + DESCENT_SHARE * F.col("loss") / climb_rate()
    cost = cost + F.when(F.col("pushing") & (F.col("gain") > F.col("loss")), CARRY_S * F.coalesce("carry", F.lit(1.0))).otherwise(0.0)
    cost = cost + way_cost() * (2.0 if easy else 1.0)
    return cost + EASY_CLIMB * F.col("gain") / climb_rate() if easy else cost


def directed_costs(edges: DataFrame, rider: str, **style) -> DataFrame:
    """Two rows for each open edge (edge_id, a, b, cls, oneway, length, gain, loss, ...): a, b, cost, edge_id, seconds."""
    spark = edges.sparkSession
    back = edges.filter("not oneway").withColumns({"a": F.col("b"), "b": F.col("a"), "gain": F.col("loss"), "loss": F.col("gain")})
    both = edges.unionByName(back)
    for name, kind in (("steep_w", "double"), ("carry", "double"), ("way", "int"), ("uphill", "int")):
        if name not in both.columns:
            both = both.withColumn(name, F.lit(None).cast(kind))
    told = both.join(F.broadcast(class_table(spark)), "cls").crossJoin(F.broadcast(rider_table(spark).filter(F.col("rider") == rider)))
    return told.select("a", "b", edge_cost(**style).alias("cost"), "edge_id", edge_time().alias("seconds"))


def steep_weight(grade: Column) -> Column:
    """Weight of a metre of climb on a grade: nothing up to 10 %, then growing steeply up to 30."""
    rise = F.exp((grade - 0.22) / 0.0455) - F.exp(F.lit((0.10 - 0.22) / 0.0455))
    return F.when(grade <= 0.10, 0.0).otherwise(F.least(F.lit(30.0), rise))


def preference_weight(rating: Column, rides: Column) -> Column:
    """Weight of a trail by one's own rating and rides: 1 to 1.8."""
    liked = F.when(rating >= 5, 0.3).when(rating == 4, 0.15).otherwise(0.0)
    known = 0.6 * F.least(F.greatest(F.coalesce(rides, F.lit(0)), F.lit(0)), F.lit(5)) / 5
    return 1 + F.least(liked + known, F.lit(0.8))


def reach_radius(hours: Column) -> Column:
    """Metres to look around for so many hours, linear between 1 h: 5 km, 2 h: 8 km, 3 h: 12 km and 4 h: 15 km."""
    return F.when(hours <= 1, 5000.0).when(hours <= 2, 5000 + 3000 * (hours - 1)).when(hours <= 3, 8000 + 4000 * (hours - 2)).when(hours <= 4, 12000 + 3000 * (hours - 3)).otherwise(15000.0)


def next_reach(radius: Column) -> Column:
    """The next wider radius, null after the last."""
    steps = F.array(*map(F.lit, (5000.0, 8000.0, 12000.0, 15000.0, 20000.0)))
    return F.get(F.filter(steps, lambda r: r > radius + 1), F.lit(0))


def gap_cost(length: Column) -> Column:
    """Seconds across a gap in the map."""
    return length + 10 * F.greatest(F.lit(0.0), length - 5)


def pause_reason(enabled: Column, has_position: Column, home_m: Column, start_m: Column, foreground: Column, quiet_m: float = 1000.0) -> Column:
    """Why presence is not shared, the first reason that holds; null if it is. Distances are null without that point."""
    return (
        F.when(~F.coalesce(enabled, F.lit(False)), "off")
        .when(~has_position, "no-position")
        .when(home_m < quiet_m, "home")
        .when(start_m.isNotNull(), F.when(start_m < quiet_m, "near-start"))
        .when(~foreground, "background")
        .when(home_m.isNull(), "no-home")
    )


# Scales of way tags, from best to worst.
SAC_SCALE = {"hiking": 1, "mountain_hiking": 2, "demanding_mountain_hiking": 3, "alpine_hiking": 4, "demanding_alpine_hiking": 5, "difficult_alpine_hiking": 6}
SMOOTHNESS = ["excellent", "good", "intermediate", "bad", "very_bad", "horrible", "very_horrible", "impassable"]


def worst_number(tag: Column, pattern: str, most: int) -> Column:
    """The highest number of a ``;`` list whose parts match a pattern with one group, up to ``most``."""
    parts = F.transform(F.split(F.lower(tag), ";"), lambda p: F.regexp_extract(F.trim(p), pattern, 1))
    numbers = F.transform(F.filter(parts, lambda p: p != ""), lambda p: p.cast("int"))
    return F.array_max(F.filter(numbers, lambda n: n <= most))


def track_grade(tag: Column) -> Column:
    """Grade 1 to 5 of a track, the worst of several."""
    return worst_number(tag, r"^(?:grade)? ?([1-5])$", 5)


def mtb_grade(tag: Column, most: int = 6) -> Column:
    """Grade of a mountain-bike scale, the worst of several."""
    return worst_number(tag, r"^s?(\d)[+-]*$", most)


def way_class(tags: Column) -> Column:
    """Class 1 to 8 of a way by its tags (a map), null without a grade."""
    from .text import worst_of

    tag = lambda k: F.try_element_at(tags, F.lit(k))
    grade, mtb = track_grade(tag("tracktype")), mtb_grade(tag("mtb:scale"))
    smooth = worst_of(F.lower(tag("smoothness")), {s: k for k, s in enumerate(SMOOTHNESS)})
    sac = F.coalesce(worst_of(F.lower(tag("sac_scale")), SAC_SCALE), worst_number(tag("sac_scale"), r"^t([1-6])$", 6))
    mud = F.exists(F.split(F.lower(F.coalesce(tag("surface"), F.lit(""))), ";"), lambda p: F.trim(p) == "mud")
    rough = (grade == 5) | mud | (smooth >= SMOOTHNESS.index("bad"))
    track = F.when(F.coalesce(rough, F.lit(False)), 7).when(grade <= 2, 1).when(grade == 3, 2).when(grade == 4, 3)
    foot = lambda n: F.when(n <= 1, 4).when(n == 2, 5).when(n == 3, 6).when(n > 3, 8)
    path = F.when(mtb.isNotNull(), foot(mtb)).otherwise(foot(sac))
    return F.when(tag("highway") == "track", track).when(tag("highway").isin("path", "bridleway"), path)
