"""Streams against batch, with rows out of order across micro-batches."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tickloom.streaming.bars import run_to_table, stream_events, stream_table, summarise
from tickloom.streaming.indicators import run_stateful, stream_indicators
from tickloom.streaming.marks import stream_marks
from tickloom.streaming.positions import stream_positions

SIGNALS = "symbol string, ts timestamp, price double, entry boolean, exit boolean"


def test_positions_with_shuffled_micro_batches(spark, tmp_path):
    rnd, start = random.Random(11), dt.datetime(2024, 1, 1)
    rows = [
        (s, start + dt.timedelta(minutes=i), float(i), rnd.random() < 0.3, rnd.random() < 0.3)
        for i in range(240) for s in ("A", "B")
    ]
    # rows move by at most 20 minutes, inside the watermark delay of an hour
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 20)))
    inbox = str(tmp_path / "inbox")
    for k in range(0, len(arrival), 80):
        spark.createDataFrame(arrival[k:k + 80], SIGNALS).coalesce(1).write.mode("append").parquet(inbox)
    schema = spark.createDataFrame([], SIGNALS).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox).withWatermark("ts", "1 hour")
    got = {(r.symbol, r.ts): r.pos for r in run_to_table(stream_positions(source), "positions").collect()}
    last = max(r[1] for r in rows) - dt.timedelta(hours=1)
    wanted = {}
    for symbol in ("A", "B"):
        pos = 0
        for s, ts, _, entry, leave in sorted(r for r in rows if r[0] == symbol):
            pos = 1 if not pos and entry else 0 if pos and leave else pos
            if ts <= last:
                wanted[s, ts] = pos
    assert got == wanted


def test_bars_over_many_batches(spark, tmp_path, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    inbox = str(tmp_path / "events")
    events.repartitionByRange(6, "ts").sortWithinPartitions("ts").write.parquet(inbox)
    one = run_to_table(summarise(stream_events(spark, folder, "events.parquet")), "one")
    many = run_to_table(summarise(stream_events(spark, inbox, per_batch=6)), "many")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_table_stream_has_watermark(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1.0)], "symbol string, ts timestamp, v double")
    df.write.parquet(str(tmp_path / "t"))
    stream = stream_table(spark, str(tmp_path / "t"), df.schema)
    assert stream.isStreaming and run_to_table(stream, "copy").select(F.count("*")).first()[0] == 1


def test_positions_of_a_batch_against_a_loop():
    import numpy as np

    from tickloom.streaming.positions import _after

    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(0, 12)
        entry, leave, start = rng.random(n) < 0.4, rng.random(n) < 0.4, int(rng.integers(0, 2))
        pos, wanted = start, []
        for e, x in zip(entry, leave):
            pos = 1 if pos == 0 and e else 0 if pos == 1 and x else pos
            wanted.append(pos)
        assert _after(start, entry, leave).tolist() == wanted


def plain_indicators(bars, fast, slow, atr):
    """bars of one symbol in order: (ts, high, low, close, volume)."""
    def mean(xs, period, keep):
        if len(xs) < period:
            return None
        y = sum(xs[:period]) / period
        for x in xs[period:]:
            y = keep * y + (1 - keep) * x
        return y

    out, closes, ranges, traded, volume, side = {}, [], [], 0.0, 0, 0
    for ts, high, low, close, size in bars:
        if closes:
            ranges.append(max(high, closes[-1]) - min(low, closes[-1]))
        closes.append(close)
        traded, volume = traded + close * size, volume + size
        f, s = mean(closes, fast, 1 - 2 / (fast + 1)), mean(closes, slow, 1 - 2 / (slow + 1))
        cross = None
        if f is not None and s is not None:
            now = (f - s > 1e-9) - (f - s < -1e-9)
            cross = now if now and now == -side else 0
            side = now or side
        out[ts] = (f, s, mean(ranges, atr, 1 - 1 / atr), traded / volume if volume else close, cross)
    return out


def test_indicators_with_shuffled_micro_batches_and_a_restart(spark, tmp_path):
    rnd, start = random.Random(12), dt.datetime(2024, 1, 1)
    schema = "symbol string, ts timestamp, high double, low double, close double, volume long"
    rows = []
    for symbol in ("A", "B"):
        price = 100.0
        for i in range(150):
            price += rnd.choice([0.0, rnd.gauss(0, 1)])
            rows.append((symbol, start + dt.timedelta(minutes=i), price + 1, price - rnd.random(), price, rnd.choice([0, 0, 5, 9]) if i < 9 else 5))
    arrival = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rnd.uniform(0, 20)))
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    empty = spark.createDataFrame([], schema)
    for some in (arrival[:150], arrival[150:]):        # the second run goes on from the checkpoint of the first
        for k in range(0, len(some), 75):
            spark.createDataFrame(some[k:k + 75], schema).coalesce(1).write.mode("append").parquet(inbox)
        source = spark.readStream.schema(empty.schema).option("maxFilesPerTrigger", 1).parquet(inbox).withWatermark("ts", "1 hour")
        table = run_stateful(stream_indicators(source, fast=3, slow=7, atr=4), "indicators", out)
    got = {(r.symbol, r.ts): (r.ema_fast, r.ema_slow, r.atr, r.vwap, r.cross) for r in table.collect()}
    last = max(r[1] for r in rows) - dt.timedelta(hours=1)
    wanted = {}
    for symbol in ("A", "B"):
        found = plain_indicators([r[1:] for r in rows if r[0] == symbol], 3, 7, 4)
        wanted |= {(symbol, ts): v for ts, v in found.items() if ts <= last}
    assert got.keys() == wanted.keys()
    for k, values in wanted.items():
        for a, b in zip(got[k], values):
            assert a == b if a is None or b is None else a == pytest.approx(b)
    assert {v[4] for v in wanted.values()} == {None, 0, 1, -1}


def test_marks_with_late_events(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda minutes: start + dt.timedelta(minutes=minutes)
    bars = [("A", at(60 * i), float(i)) for i in range(8)] + [("B", at(60 * i), 10.0 + i) for i in range(8)]
    bar_schema, event_schema = "symbol string, ts timestamp, close double", "symbol string, at timestamp, kind string"
    arrivals = [
        [("A", at(5), "buy"), ("A", at(59), "buy"), ("A", at(60), "sell"), ("B", at(150), "sell"), ("B", at(151), "buy"), ("C", at(3), "buy")],
        [("A", at(420), "buy"), ("B", at(421), "sell"), ("A", at(200), "odd")],
        [("A", at(121), "buy")],        # an hour behind the watermark: as if it had not happened
        [("A", at(470), "sell")],
    ]
    folder, inbox = str(tmp_path / "bars"), tmp_path / "events"
    spark.createDataFrame(bars, bar_schema).coalesce(1).write.parquet(folder)
    for k, rows in enumerate(arrivals):
        known = set(inbox.glob("*.parquet")) if k else set()
        spark.createDataFrame(rows, event_schema).coalesce(1).write.mode("append").parquet(str(inbox))
        for path in set(inbox.glob("*.parquet")) - known:
            os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))       # one batch each, in this order
    stream = spark.readStream.schema(event_schema).option("maxFilesPerTrigger", 1).parquet(str(inbox)).withWatermark("at", "10 minutes")
    left = spark.readStream.schema(bar_schema).parquet(folder).withWatermark("ts", "10 minutes")
    table = run_to_table(stream_marks(left, stream), "marks")
    got = {(r.symbol, r.ts): (r.buy_mark, r.sell_mark) for r in table.collect()}
    marks = {("A", 0): "buy", ("A", 1): "sell", ("B", 2): "both"}
    wanted = {}
    for symbol, ts, close in bars:
        hour = int((ts - start).total_seconds() // 3600)
        mark = marks.get((symbol, hour))
        if hour <= 5:
            wanted[symbol, ts] = (close if mark in ("buy", "both") else None, close if mark in ("sell", "both") else None)
    assert got == wanted
