import random
import struct

import pytest
from pyspark.sql import functions as F

from depthline.operators import book, features, metrics, sampling
from depthline.operators.compat import compat_bbo
from depthline.schema import MESSAGE
from depthline.sources import depth_json, itch
from depthline.sources.tables import csv_rows


def msgs(spark, rows):
    full = [("x", i, i, r[0], r[1], r[4] if len(r) > 4 else 0, r[5] if len(r) > 5 else 0, r[2], r[3], r[6] if len(r) > 6 else ("Buy" if r[2] < 1005000 else "Sell")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, MESSAGE)


def test_best_prices_follow_messages(spark):
    m = msgs(spark, [(0, "Add", 1000000, 100), (1, "Add", 1010000, 50), (2, "Modify", 1000000, 70), (3, "Trade", 1000000, 80), (4, "Add", 999000, 5), (5, "Delete", 1010000, 0)])
    got = [tuple(r)[2:] for r in book.bbo(m).orderBy("pos").collect()]
    assert got == [(1000000, 100, 0, 0), (1000000, 100, 1010000, 50), (1000000, 70, 1010000, 50), (0, 0, 1010000, 50), (999000, 5, 1010000, 50), (999000, 5, 0, 0)]


def test_relational_book_equals_scan_on_random_messages(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        side = rng.choice(["Buy", "Sell"])
        px = 1000000 + (-100 if side == "Buy" else 100) * rng.randint(0, 4)
        kind = rng.choice(["Add", "Modify", "Delete", "Trade", "Snapshot"])
        rows.append((i // 3, kind, px, 0 if kind == "Delete" else rng.randint(1, 30), 0, 0, side))
    m = msgs(spark, rows)
    a = {tuple(r) for r in book.bbo(m).collect()}
    assert a == {tuple(r) for r in compat_bbo(m).collect()}


def test_price_features(spark):
    m = msgs(spark, [(0, "Add", 1005000, 200, 0, 0, "Buy"), (1, "Add", 1007000, 100, 0, 0, "Sell")])
    r = features.price_features(book.bbo(m)).orderBy("pos").collect()[1]
    assert r["midprice"] == pytest.approx(100.6) and r["microprice"] == pytest.approx((100.5 * 100 + 100.7 * 200) / 300) and r["queue_imbalance"] == pytest.approx(1 / 3)


def test_order_flow_and_rates(spark):
    m = msgs(spark, [(0, "Add", 1000000, 100), (10, "Modify", 1000000, 200), (20, "Modify", 1000000, 150), (30, "Delete", 1000000, 0), (1_000_011, "Add", 1000000, 150)])
    r = features.rates(features.ofi(m)).orderBy("pos").collect()
    assert [x["ofi"] for x in r] == [100, 200, 200, 200, 350]
    assert [x["arrival_rate"] for x in r] == [1, 1, 1, 1, 1] and r[-1]["cancel_rate"] == 1


@pytest.mark.parametrize("times,count,want", [([0, 50_000, 150_000], 1000, [0, 2]), ([0] * 10, 3, [0, 3, 6, 9]), ([], 3, [])])
def test_sampler(spark, times, count, want):
    m = msgs(spark, [(t, "Add", 1000000, 1) for t in times])
    assert sorted(r["pos"] for r in sampling.sample_positions(m, count=count).collect()) == want


def test_quirk_full_delete_erases_the_level(spark):
    m = msgs(spark, [(0, "Add", 1000000, 10, 1), (1, "Add", 1000000, 20, 2), (2, "Delete", 0, 0, 1)])
    assert [r["best_bid_qty"] for r in compat_bbo(m).orderBy("pos").collect()] == [10, 30, 0]
    assert [r["vol"] for r in book.l3_levels(book.l3_remaining(m)).orderBy("pos").collect()] == [10, 30, 20]


def test_replacement_chain_keeps_side(spark):
    m = msgs(spark, [(0, "Add", 1010000, 10, 1, 0, "Sell"), (1, "Replace", 1011000, 7, 1, 2, "Buy"), (2, "Replace", 1012000, 5, 2, 3, "Buy")])
    left = book.l3_remaining(book.resolve_replacements(m)).groupBy("side", "px").agg(F.sum("delta").alias("v")).where("v > 0").collect()
    assert [tuple(r) for r in left] == [("Sell", 1012000, 5)]


def test_depth_json(spark):
    lines = spark.createDataFrame([('{"e":"depthUpdate","E":5,"U":8,"u":9,"b":[["100.50","2.5"],["bad"]],"a":[["99999.9999","0.0001"],[1]]}',), ("{",), ('{"u":1,"b":[],"a":[]}',)], "line string")
    got = [tuple(r)[1:] for r in depth_json.parse_depth_updates(lines).orderBy("n").collect()]
    assert got == [(9, 5000, "Modify", 1005000, 1005000, 3, "Buy"), (9, 5000, "Delete", 999999999, 999999999, 0, "Sell")]


def test_itch_resync_and_every_type(spark):
    head = lambda k, t: k.encode() + struct.pack(">HHHI", 1, t, 0, 7_000_000)
    add = head("A", 1) + struct.pack(">QcI8sI", 11, b"S", 500, b"TEST    ", 1005000)
    data = b"?" + add + head("E", 2) + struct.pack(">QIQ", 11, 200, 1) + head("X", 3) + struct.pack(">QI", 11, 200) + head("D", 4) + struct.pack(">Q", 11) + head("U", 5) + struct.pack(">QQII", 11, 12, 5, 7) + head("S", 6) + b"O" + b"\0\0\0\0" + add[:20]
    rows = itch.parse_itch(spark.createDataFrame([("f", bytearray(data))], "instrument string, content binary")).orderBy("n").collect()
    assert [(r["type"], r["order_id"], r["new_order_id"], r["px"], r["qty"], r["side"]) for r in rows] == [("Add", 11, 0, 1005000, 500, "Sell"), ("Execute", 11, 0, 0, 200, "Buy"), ("Delete", 11, 0, 0, 200, "Buy"), ("Delete", 11, 0, 0, 0, "Buy"), ("Replace", 11, 12, 7, 5, "Buy")]
    assert rows[0]["ts_us"] == 7000 and rows[0]["offset"] == 1


def test_csv_numbers(spark):
    m = msgs(spark, [(0, "Add", 1000000, 100), (1, "Add", 1010000, 50)])
    r = csv_rows(sampling.market_snapshots(m)).collect()[0]
    assert len(r) == 19 and r["midprice"] == "0.0" and r["prediction"] == ""


def test_ties_in_auc(spark):
    s = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "prob double, y int")
    assert metrics.auc(s).first()[0] == pytest.approx(0.875)


def test_stream_equals_batch(spark, tmp_path):
    from depthline.streaming.live import flow_features, record

    rng = random.Random(3)
    rows = [(i * 40_000, rng.choice(["Add", "Modify", "Delete", "Trade"]), 1000000 + 100 * rng.randint(0, 3), rng.randint(1, 9)) for i in range(60)]
    m = msgs(spark, rows)
    for lo in (0, 30):
        m.where(f"pos >= {lo} AND pos < {lo + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = record(flow_features(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    want = features.rates(features.ofi(m)).select("pos", "ofi", "arrival_rate", "cancel_rate", "trade_intensity").collect()
    got = spark.read.parquet(str(tmp_path / "out")).select("pos", "ofi", "arrival_rate", "cancel_rate", "trade_intensity").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_live_loop_equals_batch(spark, tmp_path):
    from depthline.streaming.live import live_loop, record

    rng = random.Random(13)
    rows = [(i * 30_000, rng.choice(["Modify", "Modify", "Delete"]), 1000000 + (-100 if i % 2 else 100) * rng.randint(1, 4), rng.randint(1, 9), 0, 0, "Buy" if i % 2 else "Sell") for i in range(90)]
    m = msgs(spark, rows)
    for lo in (0, 30, 60):
        m.where(f"pos >= {lo} AND pos < {lo + 30}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = record(live_loop(stream, lambda f: (f["pos"] * 7919 % 1000 / 1000.0).to_numpy()), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()
    batch = features.rates(features.ofi(m)).join(features.live_features(m), ["instrument", "pos"]).join(book.book_states(m.select("instrument", "pos"), book.l2_levels(m)).select("pos", F.col("bid_slope").alias("b"), F.col("ask_slope").alias("a")), "pos").orderBy("pos").collect()
    for g, w in zip(got, batch):
        assert (g["ofi"], g["arrival_rate"], g["cancel_rate"], g["best_bid"], g["best_bid_qty"], g["best_ask"], g["best_ask_qty"]) == (w["ofi"], w["arrival_rate"], w["cancel_rate"], w["best_bid"], w["best_bid_qty"], w["best_ask"], w["best_ask_qty"])
        assert g["bid_slope"] == pytest.approx(w["b"]) and g["ask_slope"] == pytest.approx(w["a"]) and (g["midprice"] or 0) == pytest.approx(w["midprice"] or 0, nan_ok=True)
    mids = [w["midprice"] for w in batch]
    due = [i for i in range(5, 90) if mids[i] is not None and mids[i - 5] is not None]
    hits = sum(((i - 5) * 7919 % 1000 > 500) == (mids[i] > mids[i - 5]) for i in due)
    assert got[-1]["seen"] == len(due) > 20 and got[-1]["pnl"] == 2 * hits - len(due)


def test_trade_messages_of_the_feed(spark):
    head = lambda k, t: k.encode() + struct.pack(">HHHI", 1, t, 0, 7_000_000)
    data = head("F", 1) + struct.pack(">QcI8sI4s", 11, b"B", 500, b"TEST    ", 1005000, b"ABCD")
    data += head("C", 2) + struct.pack(">QIQcI", 11, 20, 1, b"Y", 1004000) + head("P", 3) + struct.pack(">QcI8sIQ", 12, b"S", 30, b"TEST    ", 1006000, 5) + head("Q", 4) + struct.pack(">QI8sQ", 40, 1007000, b"TEST    ", 6)[:25]
    rows = itch.parse_itch(spark.createDataFrame([("f", bytearray(data))], "instrument string, content binary")).orderBy("n").collect()
    assert [(r["type"], r["order_id"], r["px"], r["qty"], r["side"]) for r in rows[:3]] == [("Add", 11, 1005000, 500, "Buy"), ("Trade", 11, 1004000, 20, "Buy"), ("Trade", 12, 1006000, 30, "Sell")]


def test_order_feed_changes_book_and_trade_side(spark):
    rows = [(0, "Add", 1010000, 500, 1, 0, "Sell"), (1, "Add", 1000000, 300, 2, 0, "Buy"), (2, "Execute", 0, 200, 1, 0, "Buy"), (3, "Delete", 0, 100, 2, 0, "Buy"), (4, "Replace", 1020000, 50, 1, 3, "Buy"), (5, "Execute", 0, 50, 3, 0, "Buy"), (6, "Delete", 0, 0, 2, 0, "Buy")]
    got = features.order_features(msgs(spark, rows)).orderBy("pos").collect()
    assert [(r["best_bid_qty"], r["best_ask"], r["best_ask_qty"]) for r in got] == [(0, 1010000, 500), (300, 1010000, 500), (300, 1010000, 300), (200, 1010000, 300), (200, 1020000, 50), (200, 0, 0), (0, 0, 0)]
    # The second execute fills its order, which therefore no longer stands and gives no side.
    assert [r["buy_ratio"] for r in got] == [0, 0, 1, 1, 1, 0.5, 0.5]


def test_a_single_instrument_spreads_over_tasks(spark):
    m = spark.range(60_000).select(F.lit("x").alias("instrument"), F.col("id").alias("pos"), F.col("id").alias("seq"), F.col("id").alias("ts_us"), F.lit("Modify").alias("type"), F.lit(0).cast("bigint").alias("order_id"), F.lit(0).cast("bigint").alias("new_order_id"), (1000000 + F.col("id") % 7).alias("px"), (1 + F.col("id") % 5).alias("qty"), F.lit("Buy").alias("side"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert book.book_states(m, book.l2_levels(m)).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_predictor_in_snapshots(spark, tmp_path):
    from depthline.operators import models

    rng = random.Random(5)
    rows = []
    for i in range(400):
        side = rng.choice(["Buy", "Sell"])
        rows.append((i * 1000, "Modify", 1000000 + (-100 if side == "Buy" else 100) * rng.randint(1, 4), rng.randint(1, 30), 0, 0, side))
    m = msgs(spark, rows)
    fitted, _ = models.train(features.all_features(m), "label_1", ("logistic",))
    fitted["logistic"].write().overwrite().save(str(tmp_path / "model"))
    for model, bounds in ((models.load(str(tmp_path / "model")), (0, 1)), (models.load_or_none(str(tmp_path / "none")), None)):
        got = [r["prediction"] for r in sampling.market_snapshots(m, count=50, predict=model).collect()]
        assert len(got) > 5 and all((p != p) if bounds is None else 0 <= p <= 1 for p in got)


def test_models_train_and_score(spark):
    # A test part of one class has no area under the curve: NaN.
    from depthline.operators import models

    rng = random.Random(5)
    rows = []
    for i in range(400):
        side = rng.choice(["Buy", "Sell"])
        rows.append((i * 1000, "Modify", 1000000 + (-100 if side == "Buy" else 100) * rng.randint(1, 4), rng.randint(1, 30), 0, 0, side))
    fitted, test = models.train(features.all_features(msgs(spark, rows)), "label_1", ("logistic",))
    got = models.evaluate(fitted["logistic"], test)
    assert (got["auc"] != got["auc"] or 0 <= got["auc"] <= 1) and 0 <= got["accuracy"] <= 1 and len(models.importance(fitted["logistic"])) == 12
