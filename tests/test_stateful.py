"""Stream operators with timers, over restarts from a checkpoint."""

import itertools
import json
import random

import pandas as pd
import pytest

from trailmill.streaming import stateful as S

numbers = itertools.count()


def ts(s):
    return (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)).to_pydatetime()


@pytest.fixture
def run(spark, tmp_path):
    """Feed batches of rows through a stream operator that stops after each of them and starts again from its checkpoint."""

    def go(schema, batches, operator):
        session, folder, out = S.state_session(spark), tmp_path / "in", tmp_path / "out"
        folder.mkdir()
        for k, rows in enumerate(batches):
            names = [c.split()[0] for c in schema.split(", ")]
            (folder / f"{k}.json").write_text("".join(json.dumps(dict(zip(names, r)), default=lambda t: t.isoformat()) + "\n" for r in rows))
            stream = operator(session.readStream.schema(schema).json(str(folder)))
            query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(100)
        return session.read.parquet(str(out)).collect()

    return go


def by_loop(rows):
    """Finished sections of one ride, over its fixes in order."""
    run, out = None, []
    for at, along, arrived, speed, section, start, end in sorted(rows, key=lambda r: (r[0], r[1])):
        if run and along < run["start"]:
            run = None
        elif run and (along >= run["end"] - S.END_M or arrived or section != run["id"]):
            to, done, run = min(along, run["end"]), run, None
            if to - done["from"] >= (done["end"] - done["start"]) * S.DONE_SHARE:
                out.append((done["id"], ts(done["at"]), ts(at), to - done["from"], done["most"]))
            continue
        if not run and section is not None and end > start and not arrived and along < end - S.END_M:
            run = {"id": section, "start": start, "end": end, "at": at, "from": along, "most": None}
        if run and speed is not None and speed >= 0:
            run["most"] = max(run["most"] or 0, speed)
    return out


def test_trails_done_over_restarts(run):
    rng = random.Random(3)
    rides, rows = {}, []
    for ride in ("a", "b"):
        along, told = 0.0, []
        for k in range(120):
            along = max(0.0, along + rng.choice([5, 9, 14, 14, -30, 20]))
            i = int(along // 120)
            section = (i, i * 120.0, i * 120.0 + 90.0) if i % 3 != 2 and along < i * 120 + 90 else (None, None, None)
            told.append((k * 10, along, k == 100, rng.choice([None, -1.0, 3.0, 7.5]), *section))
        rides[ride] = told
        rows += [(ride, ts(t), *rest) for t, *rest in told]
    rows.sort(key=lambda r: (r[1] - ts(0)).total_seconds() + rng.uniform(0, 200))  # out of order, within the wait
    batches = [rows[:90], rows[90:170], rows[170:], [(None, ts(99_999), 0.0, False, None, None, None, None)]]
    found = run("ride_id string, at timestamp, along_m double, arrived boolean, speed_mps double, section_id long, start_m double, end_m double", batches, lambda df: S.trails_done(df, "400 seconds"))
    for ride, told in rides.items():
        assert sorted(tuple(r)[1:] for r in found if r.ride_id == ride) == sorted(by_loop(told)) and by_loop(told)


def test_samples_in_order(run):
    rows = [("r", ts(s), kind, float(s)) for s, kind in [(5, "a"), (1, "g"), (3, "a"), (2, "g"), (9, "a"), (7, "g")]]
    found = run("ride string, at timestamp, kind string, value double", [rows[:3], rows[3:], [("x", ts(9999), "a", 0.0)]], lambda df: S.in_order(df, "ride", "at", "60 seconds"))
    told = sorted((r.seq, r.value) for r in found if r.ride == "r")
    assert told == [(k, v) for k, v in enumerate([1.0, 2.0, 3.0, 5.0, 7.0, 9.0])]
