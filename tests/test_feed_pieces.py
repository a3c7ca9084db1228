import random
import re
from datetime import datetime, timedelta

import pytest

from depthline.plans.registry import QUERIES
from depthline.sources import fixtures

LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]


def tables(spark, path, orders=120):
    """Orders and lines of a few days, so that many share a time; returns the orders with their lines."""
    rng, day = random.Random(1), datetime(2024, 1, 1)
    made = [(k * 3, rng.randint(0, 40), day + timedelta(days=rng.randint(0, 3))) for k in range(orders)]
    lines = [(k, rng.randint(1, 3), rng.randint(1, 3), n, float(rng.randint(1, 9)), 1.5, day + timedelta(days=rng.randint(0, 6))) for k, _, _ in made[5:] for n in range(rng.randint(1, 4))]
    spark.createDataFrame(made, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    return made, lines


def test_messages_are_numbered_by_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "PIECE_BITS", 4)
    made, lines = tables(spark, tmp_path)
    for orphans in (False, True):
        want = {}
        for key, customer, date in made:
            own = sorted((x for x in lines if x[0] == key), key=lambda x: (x[6], x[3], x[1], x[2], x[4], x[5]))
            if own:
                rows = [(date, key, 0, "Add", int(sum(x[4] for x in own)))] + [(x[6] if orphans else max(date, x[6]), key, n, "Execute", int(x[4])) for n, x in enumerate(own, 1)]
                want.setdefault(str(customer % 4), []).extend(rows)
        want = {(i, pos): (r[3], r[1], r[4]) for i, rows in want.items() for pos, r in enumerate(sorted(rows), 1)}
        got = fixtures.l3_messages(spark, str(tmp_path), orphans)
        assert {(r["instrument"], r["pos"]): (r["type"], r["order_id"], r["qty"]) for r in got.collect()} == want


def test_only_pieces_are_ordered_by_instrument(spark, tmp_path):
    tables(spark, tmp_path)
    for rows in (fixtures.l3_messages(spark, str(tmp_path)), fixtures.order_feed(spark, str(tmp_path))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        # Windows of messages are by order or by piece; that by instrument alone sums the pieces' sizes.
        by_instrument = [w for w in re.findall(r"Window \[(.*?)\], \[instrument#\d+\],", plan)]
        assert len(by_instrument) == 1 and "sum(_rows" in by_instrument[0]


@pytest.mark.parametrize("name", ["batch_track_range", "itch_messages", "itch_ranges"])
def test_feed_queries_see_an_instrument_by_days_only(spark, tmp_path, name):
    tables(spark, tmp_path)
    plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    # What is ordered by instrument alone is one row a day, however fine the times are.
    by_instrument = re.findall(r"Window \[.*?\], \[instrument#\d+\], .*\n(.*)\n", plan)
    assert by_instrument and all(re.search(r"Aggregate \[instrument#\d+, dated#\d+, day#\d+\]", x) for x in by_instrument)


def test_the_sizes_of_pieces_are_made_once(spark, tmp_path):
    tables(spark, tmp_path)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES["batch_track_range"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # Lines are ordered once for their numbers and once for the sizes, which the days read again.
    assert plan.count("partial_count(1)") == 1 and len(re.findall(r"row_number\(\) windowspecdefinition\(l_orderkey", plan)) == 2


@pytest.mark.parametrize("orphans", [False, True])
def test_messages_without_time_or_customer_are_numbered(spark, tmp_path, orphans):
    day = datetime(2024, 1, 1)
    made = [(1, 3, day), (2, 3, None), (3, None, day), (4, 7, day + timedelta(hours=5)), (5, 3, day)]
    lines = [(1, 1, 1, 1, 2.0, 1.5, None), (1, 1, 1, 2, 3.0, 1.5, day + timedelta(hours=1)), (2, 1, 1, 1, 4.0, 1.5, None), (3, 1, 1, 1, 5.0, 1.5, day), (4, 1, 1, 1, 6.0, 1.5, day + timedelta(days=1)), (5, 1, 1, 1, 7.0, 1.5, day)]
    spark.createDataFrame(made, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {}
    for r in sorted(fixtures.l3_messages(spark, str(tmp_path), orphans).collect(), key=lambda r: r["pos"]):
        got.setdefault(r["instrument"], []).append((r["pos"], r["order_id"], r["type"], r["qty"]))
    # Messages without a time come last, but executes that may precede their order come first.
    undated = [(1, "Execute", 2), (2, "Execute", 4)]
    dated = [(1, "Add", 5), *([] if orphans else [(1, "Execute", 2)]), (5, "Add", 7), (5, "Execute", 7), (1, "Execute", 3), (4, "Add", 6), (4, "Execute", 6)]
    want = [*undated, *dated, (2, "Add", 4)] if orphans else [*dated, (2, "Add", 4), (2, "Execute", 4)]
    assert got == {"3": [(pos, *x) for pos, x in enumerate(want, 1)], None: [(1, 3, "Add", 5), (2, 3, "Execute", 5)]}


def test_an_undated_line_is_placed_at_its_order(spark, tmp_path):
    day = datetime(2024, 1, 1)
    spark.createDataFrame([(4, 3, day), (9, 3, day)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(key, 1, 1, n, q, 1.5, at) for key in (4, 9) for n, q, at in ((1, 2.0, None), (2, 3.0, day + timedelta(days=1)))]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = fixtures.order_feed(spark, str(tmp_path)).orderBy("pos").select("type", "order_id", "qty").collect()
    moved = 4 + 1_000_000_000
    assert list(map(tuple, got)) == [("Add", 4, 5), ("Replace", 4, 5), ("Add", 9, 5), ("Execute", 9, 2), ("Execute", moved, 3), ("Delete", 9, 0)]


def test_replaced_orders_are_numbered_once(spark, tmp_path):
    made, lines = tables(spark, tmp_path)
    rows, want = QUERIES["l3_replace"](spark, str(tmp_path)), {}
    for key, customer, _ in made:
        total = int(sum(x[4] for x in lines if x[0] == key))
        way = 1 if key % 2 else -1
        level = str(customer % 4), "Sell" if key % 2 else "Buy", 1000000 + way * 100 * (1 + key % 10) + (way * 50 if key % 10 == 0 else 0)
        want[level] = want.get(level, 0) + total
    assert {tuple(r)[:3]: r["vol"] for r in rows.collect()} == {k: v for k, v in want.items() if v}
    # Chains and result read the written adds; no step numbers the messages anew.
    assert "l_orderkey" not in rows._jdf.queryExecution().optimizedPlan().toString()
