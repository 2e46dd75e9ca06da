import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailmill.streaming import events as S

numbers = itertools.count()


def ts(s):
    return (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()


@pytest.fixture
def run(spark, tmp_path):
    """Feed batches of rows one after another through a stream operator; all rows that come out."""

    def go(schema, batches, operator):
        name, folder = f"out{next(numbers)}", tmp_path / "in"
        folder.mkdir()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
        query = operator(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            for k, rows in enumerate(batches):
                pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).to_json(folder / f"{k}.json", orient="records", lines=True, date_format="iso")
                query.processAllAvailable()
        finally:
            query.stop()
        return spark.table(name).collect()

    return go


def test_windows_wait_for_the_watermark(run):
    schema = "key string, at timestamp, value double"
    batches = [[("a", ts(1), 1.0), ("a", ts(700), 5.0)], [("a", ts(2), 2.0)], [("a", ts(5000), 0.0)], [("a", ts(3), 9.0), ("a", ts(9000), 0.0)]]
    found = run(schema, batches, lambda df: S.windowed(df, "at", ["key"], "10 minutes", "20 minutes", [F.sum("value").alias("total")]))
    assert {(r.start, r.total) for r in found if r.start < ts(4000)} == {(ts(0), 3.0), (ts(600), 5.0)}


def test_replays_change_nothing(run):
    found = run("client string, at timestamp", [[("x", ts(1)), ("y", ts(2))], [("x", ts(3))]], lambda df: S.first_only(df, "at", "client", "1 hour"))
    assert sorted(r.client for r in found) == ["x", "y"]


def test_debounced(run):
    schema = "key string, at timestamp, sender string"
    rows = [("a", ts(0), "u"), ("a", ts(200), "v"), ("a", ts(400), "u"), ("a", ts(2000), "w")]
    found = run(schema, [rows[:2], rows[2:], [("b", ts(9000), "z")], [("b", ts(9001), "z")]], lambda df: S.debounced(df, "key", "at", "sender", 300_000, 500_000, "0 seconds"))
    assert sorted((r.key, r.first_at, r.due_at, r.events, tuple(r.senders)) for r in found) == [("a", ts(0), ts(500), 3, ("u", "v")), ("a", ts(2000), ts(2300), 1, ("w",))]


def test_late_reports_are_ignored(run):
    found = run("trail string, at timestamp, status string", [[("t", ts(10), "open")], [("t", ts(30), "closed")], [("t", ts(20), "open")], [("t", ts(40), "closed"), ("t", ts(50), "open")]], lambda df: S.changes(df, "trail", "at", "status"))
    assert [(r.before, r.status) for r in sorted(found, key=lambda r: r["at"])] == [(None, "open"), ("open", "closed"), ("closed", "open")]


def test_prompts(run):
    schema = "ride_id string, at timestamp, x double, y double, acc_m double, trail_id string, distance_m double"
    rows = [("r", ts(0), 0.0, 0.0, 5.0, "t", 10.0), ("r", ts(1), 5.0, 0.0, 5.0, "t", 10.0), ("r", ts(2), 40.0, 0.0, 50.0, "t", 10.0), ("r", ts(3), 60.0, 0.0, 5.0, "t", 10.0), ("r", ts(4), 90.0, 0.0, 5.0, "t", 10.0), ("r", ts(5), 190.0, 0.0, 5.0, "t", 10.0)]
    found = run(schema, [rows[:2], rows[2:]], S.prompts)
    assert [(r.trail_id, r["at"]) for r in found] == [("t", ts(4))]


def test_off_route(run):
    rows = [("r", ts(k), d, left) for k, (d, left) in enumerate([(5, 900.0), (40, 800.0), (5, 700.0), (40, 600.0), (50, 500.0), (60, 400.0), (3, 300.0), (3, 20.0), (2, 10.0)])]
    found = run("ride_id string, at timestamp, distance_m double, left_m double", [rows[:4], rows[4:]], S.off_route)
    assert [(r.event, r["at"]) for r in sorted(found, key=lambda r: r["at"])] == [("off", ts(4)), ("back", ts(6)), ("arrived", ts(7))]


def test_chunks(run):
    schema = "message_id string, part int, parts int, body string"
    found = run(schema, [[("m", 1, 3, "b"), ("n", 0, 2, "x")], [("m", 1, 3, "b"), ("m", 2, 3, "c")], [("m", 0, 3, "a")], [("m", 0, 3, "a")]], lambda df: S.reassembled(df, "at", "0 seconds"))
    assert [tuple(r) for r in found] == [("m", "abc")]


def test_samples_come_in_order(run):
    schema = "ride string, at timestamp, kind string, value double"
    batches = [[("r", ts(3), "a", 3.0), ("r", ts(1), "g", 1.0)], [("r", ts(2), "a", 2.0), ("r", ts(20), "g", 20.0)], [("r", ts(15), "a", 15.0), ("r", ts(40), "a", 40.0)], [("r", ts(60), "a", 60.0)]]
    found = run(schema, batches, lambda df: S.in_order(df, "ride", "at", "10 seconds"))
    by_seq = [r.value for r in sorted(found, key=lambda r: r.seq)]
    assert by_seq == sorted(by_seq) and by_seq[:5] == [1.0, 2.0, 3.0, 15.0, 20.0]


def test_presence(spark):
    fixes = spark.createDataFrame([("a", ts(0), 1.0), ("a", ts(500), 2.0), ("b", ts(100), 3.0), ("c", ts(590), 4.0)], "account string, at timestamp, x double")
    found = {(r.account, r.x, r.freshness) for r in S.presence(fixes, F.lit(ts(1010)), 450, 900).collect()}
    assert found == {("a", 2.0, "seen"), ("c", 4.0, "live")}
