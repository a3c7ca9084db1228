import os
import random
import time

import pytest
from pyspark.sql import functions as F

from depthline.operators import book, carry, features, sampling
from depthline.scratch import shared_dir, stored
from test_compat import random_orders
from test_level_pieces import unique_orders
from test_order_book import msgs


@pytest.fixture
def small_buckets(monkeypatch):
    for module in (book, features, carry):
        monkeypatch.setattr(module, "BUCKET", 8)


def recent(rows):
    """Adds and deletes of the last second by a loop: those so far less all that are older, wherever they stand."""
    out, hits = {}, {"Add": 0, "Delete": 0}
    for pos, ts, kind in rows:
        if kind in hits:
            hits[kind] += 1
        out[pos] = tuple(float(n - sum(k == c and t is not None and ts is not None and t < ts - features.SECOND for _, t, k in rows)) for c, n in hits.items())
    return out


@pytest.mark.parametrize("step", [(0, 1000), (200_000, 200_000), (-3_000_000, 4_000_000)], ids=["dense", "sparse", "back and forth"])
def test_last_seconds_across_buckets_equal_a_loop(spark, small_buckets, step):
    rng, t, rows = random.Random(1), 0, []
    for i in range(150):
        t += rng.randint(*step)
        rows.append((t, rng.choice(["Add", "Add", "Delete", "Trade"]), 1000000 + 100 * rng.randint(0, 3), rng.randint(1, 9), 0, 0, rng.choice(["Buy", "Sell"])))
    # A message without a time never grows old and sees nothing grow old.
    m = msgs(spark, rows).withColumn("ts_us", F.when(F.col("pos") % 40 != 7, F.col("ts_us")))
    got = features.all_features(m).collect()
    assert {r["pos"]: (r["arrival_rate"], r["cancel_rate"]) for r in got} == recent([(r["pos"], r["ts_us"], r["type"]) for r in m.orderBy("pos").collect()])


@pytest.mark.parametrize("gap", [20_000, 3_000_000])
def test_order_features_do_not_depend_on_buckets(spark, monkeypatch, gap):
    rng = random.Random(4)
    # Clean semantics leave open what orders are whose ids are used twice.
    feeds = {semantics: msgs(spark, [(i * gap + rng.randint(0, gap), *r[1:]) for i, r in enumerate(f(rng, 60))]) for semantics, f in (("clean", unique_orders), ("compat", random_orders))}
    made = {}
    for size in (4096, 5):
        for module in (book, features, carry):
            monkeypatch.setattr(module, "BUCKET", size)
        for semantics, m in feeds.items():
            made[size, semantics] = [r.asDict() for r in features.order_features(m, semantics).orderBy("pos").collect()]
    for semantics in feeds:
        assert len(made[5, semantics]) == 60
        for a, b in zip(made[4096, semantics], made[5, semantics]):
            assert a == {**b, "volatility": pytest.approx(b["volatility"], abs=1e-12), "queue_imbalance": pytest.approx(b["queue_imbalance"], nan_ok=True)}
    # The book by sums of changes is that of the levels' intervals.
    m = feeds["clean"]
    want = {r["pos"]: r for r in book.bbo(m, book.order_levels(m, book.l3_remaining(book.resolve_replacements(m)))).collect()}
    assert all(r[c] == want[r["pos"]][c] for r in made[5, "clean"] for c in ("best_bid", "best_bid_qty", "best_ask", "best_ask_qty"))


def test_ratios_are_held_over_buckets_that_only_open_messages_end(spark, small_buckets):
    # Bought trades end the first bucket; those behind it are quiet, then one trade is sold right behind a bucket's begin.
    rows = [(0, "Modify", 1000000, 5, 0, 0, "Buy"), (0, "Modify", 1000200, 50, 0, 0, "Sell")] + [(10_000 * i, "Trade", 1000200, 1, 0, 0, "Sell") for i in range(6)]
    rows += [(5_000_000 + 1_500_000 * i, "Add", 999000, 1, 0, 0, "Buy") for i in range(16)]
    rows += [(40_000_000, "Add", 999000, 1, 0, 0, "Buy"), (40_000_000, "Trade", 1000000, 1, 0, 0, "Buy"), (40_000_001, "Trade", 1000200, 1, 0, 0, "Sell")] + [(50_000_000 + i, "Add", 999000, 1, 0, 0, "Buy") for i in range(12)]
    got = [r["buy_ratio"] for r in features.all_features(msgs(spark, rows)).orderBy("pos").collect()]
    assert got == [0.0] * 2 + [1.0] * 6 + [1.0] * 17 + [0.0, 0.5] + [0.5] * 12


def test_wanted_rows_are_those_of_all_rows(spark, small_buckets):
    rng = random.Random(6)
    m = msgs(spark, [(i * 30_000, *r[1:]) for i, r in enumerate(random_orders(rng, 120))])
    sample = sampling.sample_positions(m, count=3)
    want = {r["pos"]: r for r in features.order_features(m, "compat", keep=()).collect()}
    got = features.order_features(m, "compat", keep=(), sample=sample).collect()
    assert sorted(r["pos"] for r in got) == sorted(r["pos"] for r in sample.collect()) and all(str(r) == str(want[r["pos"]]) for r in got)


def shuffle_files(spark):
    listed = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in listed.split("\n") if os.path.basename(f).startswith("shuffle_") and f.endswith(".data")}


def test_what_is_not_read_again_leaves_the_disk(spark):
    before = shuffle_files(spark)
    table = stored(spark.range(20_000).repartition(3).groupBy((F.col("id") % 5000).alias("k")).count(), "counts")
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before and table.count() == 5000
    at = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    m = msgs(spark, [(i * 1000, *r[1:]) for i, r in enumerate(random_orders(random.Random(2), 60)) if r[1] not in ("Modify", "Snapshot")])
    for semantics in ("clean", "compat"):
        features.order_features(m, semantics)
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(at)) - before}
    assert not left & {"remaining", "level-changes"} and "book-states" in left
