import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from depthline.operators import book, carry, features, metrics, sampling
from test_order_book import msgs


def feed(spark, rng, n, instruments=3):
    """Random messages of some instruments, with sides that empty and times that tie."""
    rows, t = [], 0
    for i in range(n):
        side = rng.choice(["Buy", "Sell"])
        kind = rng.choice(["Add", "Modify", "Delete", "Delete", "Trade"])
        t += rng.choice([0, 0, 40_000, 400_000])
        rows.append((t, kind, 1000000 + (-100 if side == "Buy" else 100) * rng.randint(1, 2), 0 if kind == "Delete" else rng.randint(1, 30), 0, 0, side))
    return msgs(spark, rows).withColumn("instrument", (F.col("pos") % instruments).cast("string"))


def test_running_values_equal_plain_loops_for_any_bucket(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(f"i{rng.randint(0, 2)}", p, rng.choice([None, -1, 2, 5]), rng.choice([None, 0.5, 1.5])) for p in range(300)]
    df = spark.createDataFrame(rows, "instrument string, pos long, a long, b double")
    for bucket in (1, 7, 4096):
        monkeypatch.setattr(carry, "BUCKET", bucket)
        made = carry.running(df, sums={"s": F.col("a")}, lasts={"l": F.col("b")}, products={"p": F.coalesce("b", F.lit(1.0))}, previous={"w": F.col("a")}, tails={"t": (F.col("a"), 3, lambda v: v)}, keep_bucket=True)
        state = {}
        for r in made.orderBy("pos").collect():
            s, last, prod, before, seen = state.get(r["instrument"], (0, None, 1.0, None, []))
            assert r["w"] == before and list(r["t"] or []) == [v for p, v in seen if p // bucket < r["pos"] // bucket][-3:]
            s, last, prod = s + (r["a"] or 0), r["b"] if r["b"] is not None else last, prod * (r["b"] or 1.0)
            assert (r["s"], r["l"]) == (s, last) and r["p"] == pytest.approx(prod)
            state[r["instrument"]] = s, last, prod, r["a"], seen + ([(r["pos"], r["a"])] if r["a"] is not None else [])


def test_features_do_not_depend_on_buckets_and_match_loops(spark, monkeypatch):
    m = feed(spark, random.Random(2), 400)
    names = ["instrument", "pos", "ofi", "arrival_rate", "cancel_rate", "trade_intensity", "buy_ratio", "midprice", "volatility", "bid_slope", "type", "ts_us", "best_bid", "best_ask", "px"]
    want = {(r["instrument"], r["pos"]): r for r in features.all_features(m).select(names).collect()}
    past = {}
    for (name, _), r in sorted(want.items(), key=lambda x: x[0][1]):
        seen, mids, state = past.setdefault(name, ([], [], {"vol": 0.0, "ratio": 0.0}))
        two = r["best_bid"] != 0 and r["best_ask"] != 0
        if two:
            mids.append((r["best_bid"] / 10000 + r["best_ask"] / 10000) / 2)
            returns = [math.log(b / a) for a, b in zip(mids[-10:], mids[-10:][1:])]
            state["vol"] = statistics.stdev(returns) if len(returns) > 1 else 0.0
        trade = r["type"] == "Trade"
        seen.append((r["ts_us"], r["type"], trade and two and r["px"] / 10000 >= mids[-1]))
        near = [x for x in seen if x[0] >= r["ts_us"] - 1_000_000]
        trades = [x for x in near if x[1] == "Trade"]
        if trades:
            state["ratio"] = sum(x[2] for x in trades) / len(trades)
        assert (r["arrival_rate"], r["cancel_rate"], r["trade_intensity"]) == (sum(x[1] == "Add" for x in near), sum(x[1] == "Delete" for x in near), len(trades))
        assert r["midprice"] == (mids[-1] if mids else 0.0) and r["volatility"] == pytest.approx(state["vol"], abs=1e-12) and r["buy_ratio"] == state["ratio"]
    for bucket in (3, 50):
        monkeypatch.setattr(carry, "BUCKET", bucket)
        monkeypatch.setattr(carry, "TIME_BUCKET", 500_000 if bucket == 3 else 7)
        for r in features.all_features(m).select(names).collect():
            w = want[r["instrument"], r["pos"]].asDict()
            assert r.asDict() == {**w, "volatility": pytest.approx(w["volatility"], abs=1e-12)}
        single = features.rates(features.ofi(m)).select("instrument", "pos", "ofi", "arrival_rate", "cancel_rate", "trade_intensity").collect()
        assert {tuple(r) for r in single} == {tuple(r)[:6] for r in want.values()}


def test_one_instrument_spreads_over_tasks_in_every_feature_stage(spark, monkeypatch):
    monkeypatch.setattr(carry, "BUCKET", 500)
    monkeypatch.setattr(book, "BUCKET", 500)
    m = feed(spark, random.Random(3), 8000, 1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = lambda df: len({r[0] for r in df.select(F.spark_partition_id(), F.hash(*df.columns)).collect()})
        rows = features.priced(m).withColumns({"prob": F.lit(0.7), "y": F.lit(1), "next_return_1": F.lit(0.0)})
        for df in (features.ofi(m), features.rates(m), features.all_features(m), rows, features.buy_ratio(rows), metrics.strategy(metrics.positions(rows)), metrics.direction_pnl(rows)):
            assert tasks(df) >= 4
        for df in (features.all_features(m), metrics.strategy(metrics.positions(rows))):
            # Only the buckets' sums, one row a bucket, are dealt by instrument alone.
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            ordered = re.findall(r"Window \[.*\], \[instrument#\d+\], \[(\w+)#", plan)
            assert ordered and set(ordered) <= {"_bucket", "_n__tail"}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def scan(ts, time_us, count):
    """The sampler as one loop."""
    kept, last, since = [], None, 0
    for i, t in enumerate(ts):
        since += 1
        if last is None or t - last >= time_us or since >= count:
            kept.append(i)
            last, since = t, 0
    return kept


def test_successors_equal_a_scan_on_random_feeds():
    rng = random.Random(4)
    for k in range(10_000):
        n, count, time_us = rng.randint(1, 60), rng.randint(1, 20), rng.randint(1, 60)
        ts = [rng.randint(0, 100) for _ in range(n)]
        if k % 2:
            ts.sort()
        after, at, kept = sampling.successors(sampling.np.array(ts), time_us, count), 0, []
        while at < n:
            kept.append(at)
            at = int(after[at])
        assert kept == scan(ts, time_us, count)


def test_sampler_equals_a_scan_over_blocks(spark, monkeypatch):
    rng = random.Random(5)
    feeds = {}
    for i in range(60):
        n = rng.choice([1, 7, 16, 40, 150])
        ts = [rng.randint(0, 400) for _ in range(n)]
        feeds[f"i{i}"] = sorted(ts) if i % 3 else ts
    monkeypatch.setattr(sampling, "LIMITS", 1)
    monkeypatch.setattr(carry, "BUCKET", 13)
    df = spark.createDataFrame([(k, 10 + 3 * p, t) for k, ts in feeds.items() for p, t in enumerate(ts)], "instrument string, pos long, ts_us long").repartition(5)
    for block, time_us, count in ((8, 9, 8), (16, 50, 5), (5, 1000, 5)):
        monkeypatch.setattr(sampling, "BLOCK", block)
        got = {(r["instrument"], r["pos"]) for r in sampling.sample_positions(df, time_us, count).collect()}
        assert got == {(k, 10 + 3 * p) for k, ts in feeds.items() for p in scan(ts, time_us, count)}
    assert sampling.sample_positions(df.where("false")).collect() == []


def test_queue_fills_equal_a_search_over_blocks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"i{k}", p, 1000 * p + rng.randint(0, 900), 100 if rng.random() < 0.9 else 0, rng.randint(0, 60), 200, rng.randint(1, 9)) for k in range(3) for p in range(rng.choice([1, 30, 200]))]
    df = spark.createDataFrame(rows, "instrument string, pos long, ts_us long, best_bid long, best_bid_qty long, best_ask long, best_ask_qty long")
    for block, ahead in ((8, 7), (50, 20), (16_384, 10_000)):
        monkeypatch.setattr(sampling, "BLOCK", block)
        got = {(r["instrument"], r["pos"]): r["expected_fill_time_us"] for r in sampling.queue_fills(df, 5, ahead=ahead).collect()}
        want = {}
        for name in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == name]
            for i, r in enumerate(own):
                if r[3]:
                    want[name, r[1]] = next((float(x[2] - r[2]) for x in own[i + 1 : i + 1 + ahead] if x[4] < r[4] - 5), None)
        assert got == want
