"""The live strategy: stream against a plain loop, with a restart inside the bootstrap and after it."""

import json
import random

import numpy as np
import pytest

from depthline.streaming import strategy

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def plain(frames, predict, sync, lag, threshold):
    """Rows of one instrument's decoded frames by the definition, every value from whole histories."""
    book, out, mids, past, done, ofi, score = ({}, {}), [], [], [], [], 0, [0, 0]
    snapshot = next(i for i, f in enumerate(frames) if "lastUpdateId" in f)
    last = frames[snapshot]["lastUpdateId"]
    for side, name in enumerate(("bids", "asks")):
        book[side].update({round(float(p) * 10000): int(float(q)) for p, q in frames[snapshot][name] if int(float(q)) > 0})

    def mid():
        return (max(book[0]) + min(book[1])) / 20000 if book[0] and book[1] else None

    mids += [mid()] if mid() else []
    for i, f in enumerate([f for f in frames if "U" in f]):
        live = i >= sync
        if not live and not (f["U"] > last or (f["U"] <= last + 1 and f["u"] > last)):
            continue
        for side, name in enumerate("ba"):
            for p, q in f[name]:
                px, qty = round(float(p) * 10000), int(float(q))
                ofi += (1 - 2 * side) * max(qty - book[side].get(px, 0), 0)
                book[side][px] = qty
                if qty <= 0:
                    del book[side][px]
        if not live:
            continue
        past.append((f["E"] * 1000, [float(q) > 0 for _, q in f["b"] + f["a"]]))
        if mid() is None:
            continue
        mids.append(mid())
        recent = [u for t, us in past if t >= f["E"] * 1000 - 1_000_000 for u in us]
        slopes = []
        for side, best_first in ((0, True), (1, False)):
            top = [book[side][p] for p in sorted(book[side], reverse=best_first)][:5]
            slopes.append(np.polyfit(range(len(top)), np.log(np.maximum(top, 1)), 1)[0] if len(top) > 2 else 0.0)
        b, a = max(book[0]), min(book[1])
        bq, aq = book[0][b], book[1][a]
        r = np.diff(np.log(mids[-10:]))
        x = [mid(), (a - b) / 10000, (bq * a / 10000 + aq * b / 10000) / (bq + aq), ofi, bq / (bq + aq), sum(recent), len(recent) - sum(recent), *slopes, np.std(r, ddof=1) if len(r) > 1 else 0.0, 0.0, 0.0]
        prob, ofi = predict(x), 0
        done.append((prob, mid()))
        if len(done) > lag:
            p, m = done[-1 - lag]
            score[(p > threshold) != (mid() > m)] += 1
        out.append([*x, prob, 1 if prob > threshold else -1 if prob < 1 - threshold else 0, i - sync + 1, *score])
    return out


def made(rng, n, snapshot_at):
    """Frames: stale and fresh updates around a snapshot, quantities that cut to 0, sides that empty."""
    out, uid = [], 100
    for i in range(n):
        if i == snapshot_at:
            out.append({"lastUpdateId": 112, "bids": [[f"{100 - j / 10:.4f}", "5.5"] for j in range(1, 6)], "asks": [[f"{100 + j / 10:.4f}", "4"] for j in range(1, 6)] + [["101.0", "0.4"]]})
        if i % 17 == 5:
            out.append({"E": i, "e": "heartbeat"})
        size = rng.randint(1, 3)
        empty = i % 23 == 22
        level = lambda s: [f"{100 + s * rng.randint(1, 6) / 10:.4f}", rng.choice(["0", "0.5", "3.7", "9", "12"])]
        bids = [[f"{100 - j / 10:.4f}", "0"] for j in range(1, 7)] if empty else [level(-1) for _ in range(rng.randint(0, 3))]
        out.append({"e": "depthUpdate", "E": 1000 + i * 90, "U": uid, "u": uid + size, "b": bids, "a": [level(1) for _ in range(rng.randint(0, 3))]})
        uid += size + 1
    return out


def lines(spark, feeds):
    rows = [(name, pos, json.dumps(f)) for name, fs in feeds.items() for pos, f in enumerate(fs)]
    return spark.createDataFrame(rows, "instrument string, pos long, line string")


def test_stream_with_restarts_equals_a_plain_loop(spark, tmp_path):
    rng = random.Random(8)
    feeds = {"x": made(rng, 70, 3), "y": made(rng, 50, 0)}
    table = lines(spark, feeds)
    source, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for lo, hi in ((0, 3), (3, 12), (12, 40), (40, 90)):
            table.where(f"pos >= {lo} AND pos < {hi}").coalesce(1).write.mode("append").parquet(source)
            # Each part runs as a new query from the checkpoint: inside the bootstrap and after it.
            stream = strategy.frames(spark.readStream.schema(table.schema).parquet(source))
            rows = strategy.live_strategy(stream, lambda f: (f["midprice"] * 7919 + f["ofi"]).to_numpy() % 1, quiet_ms=None)
            query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER)
    got = spark.read.parquet(out)
    for name, fs in feeds.items():
        want = plain(fs, lambda x: (x[0] * 7919 + x[3]) % 1, 20, 5, 0.55)
        have = got.where(f"instrument = '{name}'").orderBy("pos").select(*strategy.INPUTS, "prob", "position", "events", "correct", "wrong").collect()
        assert len(have) == len(want) > 20
        assert np.allclose(np.array([list(r) for r in have], float), np.array(want, float), atol=1e-6)
    shown = strategy.dashboard(got).collect()
    assert shown and all(r["events"] % 10 == 0 and r["signal"] in ("BULLISH", "BEARISH", "NEUTRAL") and 0 <= r["accuracy"] <= 1 for r in shown)


def test_bootstrap_ends_when_no_frame_comes(spark, tmp_path):
    feed = [{"lastUpdateId": 5, "bids": [["1", "5"]], "asks": [["2", "5"]]}, {"E": 1, "U": 6, "u": 7, "b": [["1.1", "3"]], "a": []}, {"E": 2, "U": 8, "u": 9, "b": [], "a": [["1.9", "2"]]}]
    table = lines(spark, {"x": feed})
    source, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for lo, hi in ((0, 2), (2, 3)):
            table.where(f"pos >= {lo} AND pos < {hi}").coalesce(1).write.mode("append").parquet(source)
            rows = strategy.live_strategy(strategy.frames(spark.readStream.schema(table.schema).parquet(source)), quiet_ms=1)
            rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER)
    got = spark.read.parquet(out).collect()
    assert [(r["pos"], r["best_bid"], r["best_ask"], r["ofi"], r["position"]) for r in got] == [(2, 11000, 19000, 1.0, 0)]


def test_desk_waits_resets_and_ends_the_bootstrap():
    def frame(first, last, bids, asks, pos=0):
        f = strategy._Frame()
        f.pos, f.ts_us, f.first, f.last = pos, 0, first, last
        f.bids, f.asks = ([{"px": p, "qty": q, "up": q > 0} for p, q in side] for side in (bids, asks))
        return f

    desk = strategy.Desk(iter(()), {}, 2, 5, 0.55)
    desk.take(frame(1, 5, [(90, 1)], []))
    desk.take(frame(6, 9, [(80, 2)], []))
    assert len(desk.waiting) == 2 and not desk.rows
    desk.take(frame(None, 5, [(100, 3)], [(110, 4)]))
    assert desk.sides[0].at == {100: 3, 80: 2} and not desk.waiting and desk.k["live"] and desk.k["ofi"] == 2
    desk.take(frame(10, 11, [(100, 0)], [(110, 9)]))
    assert desk.rows[0]["ofi"] == 2 - 5 and desk.rows[0]["best_bid"] == 80 and desk.k["ofi"] == 0
    desk.take(frame(None, 20, [(70, 1)], [(75, 1)]))
    assert desk.sides[0].at == {70: 1} and not desk.k["live"] and desk.sides[0].touched >= {70, 80, 100}
    desk.take(frame(12, 19, [(71, 1)], []))
    assert desk.sides[0].at == {70: 1} and desk.k["synced"] == 1


def test_slope_is_the_fitted_line():
    assert strategy.slope([5, 7]) == 0.0
    assert strategy.slope([1, 4, 9, 2]) == pytest.approx(np.polyfit(range(4), np.log([1, 4, 9, 2]), 1)[0])
