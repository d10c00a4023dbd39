"""Streams against the batch: strict gaps, rows out of order and late, a restart, and JSON lines."""

import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from usagelens.operators.sequences import active_seconds
from usagelens.streaming.telemetry import activity_spans_stream, advanced, candidates_stream, daily_totals_stream

SF = "/root/testdata/sf0.001"
BASE = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double"


def test_spans_of_rows_in_any_slices():
    rng = random.Random(3)
    for _ in range(300):
        rows = np.array([[rng.randint(0, 60), rng.randint(0, 5)] for _ in range(rng.randint(0, 14))], np.int64).reshape(-1, 2)
        want: list = []
        for at, cost in sorted(rows.tolist()):
            if want and at - want[-1][1] < 5:
                want[-1] = [want[-1][0], at, want[-1][2] + 1, want[-1][3] + at - want[-1][1], want[-1][4] + cost]
            else:
                want.append([at, at, 1, 0, cost])
        pending, span, got = rows, None, []
        for upto in sorted(rng.sample(range(70), 6)) + [100]:
            pending, span, closed = advanced(pending, span, upto, 5)
            got += closed
        assert got == want and span is None and not len(pending)


def put(spark, folder, n, rows):
    made = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    made.write.parquet(f"{folder}/.{n}")
    part = next(Path(folder, f".{n}").glob("*.parquet"))
    part.rename(Path(folder, f"{n}.parquet"))


def run(spark, folder, made, checkpoint, name):
    out = Path(folder, "out")
    made.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(out)).collect() if list(out.glob("*.parquet")) else []


def test_spans_equal_the_batch_over_restarts_and_late_rows(spark, tmp_path):
    rng, inside = random.Random(5), tmp_path / "in"
    inside.mkdir()
    rows = [(i, BASE + timedelta(seconds=s), rng.choice([1, 1, 2, 3]), float(rng.randint(1, 9))) for i, s in enumerate(rng.randint(0, 9000) for _ in range(120))]
    rows += [(900, BASE + timedelta(seconds=20_000), 7, 1.0), (901, BASE + timedelta(seconds=20_300), 7, 1.0), (902, BASE + timedelta(seconds=20_599.999999), 7, 1.0)]  # a gap of exactly the limit, and one just under
    # Files by time, but each row up to eight minutes out of order.
    order = sorted(rows, key=lambda r: (r[1] + timedelta(seconds=rng.randint(0, 480)), r[0]))
    far = BASE + timedelta(days=1)
    source = lambda: activity_spans_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(inside)))
    put(spark, inside, 0, order[:60])
    run(spark, tmp_path, source(), tmp_path / "c", "first")
    for n, part in enumerate((order[60:90], order[90:], [(999, far, 9, 1.0)], [(1000, BASE, 1, 5.0), (1001, far, 9, 1.0)], [(1002, far + timedelta(seconds=1), 9, 1.0)]), 1):
        put(spark, inside, n, part)  # the next to last file has a row a day late
    got = run(spark, tmp_path, source(), tmp_path / "c", "again")  # goes on where the first stopped
    batch = active_seconds(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", 300, "event_id")
    want = {r.user_id: r.active_seconds for r in batch.collect()}
    total: dict = {}
    for r in got:
        s = total.setdefault(r.user_id, [0, 0, 0])
        total[r.user_id] = [s[0] + r.active_micros, s[1] + r.steps, s[2] + float(r.cost)]
    assert {u: s[0] // 1_000_000 for u, s in total.items() if u != 9} == want and 9 not in total
    assert {u: s[1:] for u, s in total.items()} == {u: [sum(r[2] == u for r in rows), sum(r[3] for r in rows if r[2] == u)] for u in want}
    assert want[7] == 299 and len([r for r in got if r.user_id == 7]) == 2


def test_candidates_are_json_lines(spark, tmp_path):
    inside = tmp_path / "in"
    inside.mkdir()
    at = lambda s: BASE + timedelta(seconds=s)
    put(spark, inside, 0, [(1, at(0), 1, 1.0), (2, at(120), 1, 3.0), (3, at(0), 2, 0.1), (4, at(240), 2, 0.1), (5, at(0), 3, 9.0)])
    put(spark, inside, 1, [(6, at(9000), 4, 1.0)])
    put(spark, inside, 2, [(7, at(9001), 4, 1.0)])
    source = lambda: activity_spans_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(inside)))
    candidates_stream(source(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    read = lambda: [json.loads(x) for p in sorted((tmp_path / "out").glob("batch=*/*.json")) for x in p.read_text().splitlines()]
    assert [(x["user_id"], x["steps"], x["cost_per_active_minute"]) for x in read()] == [(1, 2, 2.0)]  # one is cheap, one has no active time
    candidates_stream(source(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert len(read()) == 1


def test_daily_totals(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    made = daily_totals_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    made.writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "days")).start().awaitTermination()
    days = {str(r.day)[:10]: (r.cost, r.steps) for r in spark.table("days").collect()}
    assert days == {str(r.d): (r.c, r.n) for r in events.groupBy(F.to_date("ts").alias("d")).agg(F.sum(F.col("value").cast("decimal(18,6)")).alias("c"), F.count(F.lit(1)).alias("n")).collect()}
