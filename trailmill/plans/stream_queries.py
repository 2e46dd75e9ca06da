"""Streams over the test tables: each is read from files in parts, stopped and started again from its checkpoint between them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import scratch_root
from ..streaming import stateful as S
from .catalog import query, table

#: Parts in which rows come, and how much later than its own time one may come, in hours.
PARTS, JITTER_H = 3, 6


def streamed(spark, rows: DataFrame, at: str, operator) -> DataFrame:
    """What a stream makes of rows that come in ``PARTS`` parts, out of order by up to ``JITTER_H`` hours.

    The stream reads each part as it lies in the shared folder, ends, and goes on from its checkpoint with the next one.
    """
    session, root = S.state_session(spark), f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    comes = F.unix_timestamp(F.col(at).cast("timestamp")) + F.pmod(F.xxhash64(*rows.columns), F.lit(JITTER_H * 3600))
    first, last = rows.select(F.min(comes), F.max(comes)).first()
    part = F.least(F.floor((comes - F.lit(first or 0)) * PARTS / F.lit(max(1, (last or 0) - (first or 0)))), F.lit(PARTS - 1))
    dealt = rows.withColumn("__part", part)
    for k in range(PARTS):
        dealt.filter(F.col("__part") == k).drop("__part").write.mode("append").parquet(f"{root}/in")
        found = operator(session.readStream.schema(rows.schema).parquet(f"{root}/in"))
        run = found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out")


#: Fixes of the rides of all users: the way grows with each event but after an error, and sections of a trail come and go along it.
RIDES = """n AS (SELECT user_id, date_trunc('milliseconds', ts) AS ts, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT *, k * 9.0::DOUBLE - CASE WHEN event_type = 'error' THEN 25 ELSE 0 END AS m FROM n),
f AS (SELECT user_id, ts, k, m, k % 40 = 39 AS arrived, value, CASE WHEN floor(m / 60) % 3 <> 2 AND m >= 0 THEN floor(m / 60)::BIGINT END AS s FROM w)"""


@query(
    f"""WITH RECURSIVE {RIDES}, mark AS (SELECT (max(ts) - INTERVAL 12 HOUR) AS until FROM f), l AS MATERIALIZED (SELECT f.*, s * 60.0::DOUBLE AS a, s * 60.0::DOUBLE + 50 AS b FROM f, mark WHERE ts <= mark.until),
run(user_id, k, s, a, b, ent, m0, most, done) AS (SELECT DISTINCT user_id, 0::BIGINT, -1::BIGINT, 0::DOUBLE, 0::DOUBLE, NULL::TIMESTAMP, 0::DOUBLE, 0::DOUBLE, NULL::STRUCT(s BIGINT, e TIMESTAMP, t TIMESTAMP, d DOUBLE, v DOUBLE) FROM l
UNION ALL SELECT user_id, k, CASE WHEN begins THEN ns WHEN stays THEN s ELSE -1 END, CASE WHEN begins THEN na ELSE a END, CASE WHEN begins THEN nb ELSE b END, CASE WHEN begins THEN ts ELSE ent END, CASE WHEN begins THEN m ELSE m0 END, CASE WHEN begins THEN value WHEN stays THEN greatest(most, value) ELSE most END,
CASE WHEN ends AND least(m, b) - m0 >= (b - a) * 0.5 THEN {{'s': s, 'e': ent, 't': ts, 'd': least(m, b) - m0, 'v': most}} END
FROM (SELECT *, NOT ends AND NOT stays AND ns IS NOT NULL AND NOT arrived AND m < nb - 10 AS begins FROM (SELECT *, s >= 0 AND m >= a AND NOT ends AS stays FROM (SELECT run.user_id, l.k, run.s, run.a, run.b, run.ent, run.m0, run.most, l.ts, l.m, l.arrived, l.value, l.s AS ns, l.a AS na, l.b AS nb,
run.s >= 0 AND l.m >= run.a AND (l.m >= run.b - 10 OR l.arrived OR l.s IS DISTINCT FROM run.s) AS ends FROM run JOIN l ON l.user_id = run.user_id AND l.k = run.k + 1))))
SELECT user_id AS ride_id, done.s AS section_id, epoch_us(done.e) AS entered_us, epoch_us(done.t) AS ended_us, round(done.d, 4) AS ridden_m, round(done.v, 4) AS max_speed_mps FROM run WHERE done IS NOT NULL"""
)
def t15_trails_done(spark, sf_dir):
    """Trail sections that the rides of all users have finished, up to twelve hours before the last fix, as a stream tells them."""
    at = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    k = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    m = F.col("k") * 9.0 - F.when(F.col("event_type") == "error", 25).otherwise(0)
    inside = (F.floor(m / 60) % 3 != 2) & (m >= 0)
    section = F.when(inside, F.floor(m / 60))
    fixes = table(spark, sf_dir, "events").withColumns({"k": k, "at": at}).select(
        F.col("user_id").alias("ride_id"), "at", m.alias("along_m"), (F.col("k") % 40 == 39).alias("arrived"), F.col("value").alias("speed_mps"), section.alias("section_id"), (section * 60.0).alias("start_m"), (section * 60.0 + 50).alias("end_m")
    )
    found = streamed(spark, fixes, "at", lambda df: S.trails_done(df, "12 hours"))
    return found.select("ride_id", "section_id", F.unix_micros("entered_at").alias("entered_us"), F.unix_micros("ended_at").alias("ended_us"), F.round("ridden_m", 4).alias("ridden_m"), F.round("max_speed_mps", 4).alias("max_speed_mps"))
