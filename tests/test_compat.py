import random

from depthline.operators import book, features, sampling
from depthline.operators.compat import compat_bbo, level_changes, order_chains
from plain_book import Book
from test_order_book import msgs


def random_orders(rng, n):
    """Messages of every kind; ids are reused, replaced, over-executed and unknown."""
    rows, made, t = [], [1], 0
    for i in range(n):
        kind = rng.choice(["Add", "Add", "Add", "Execute", "Trade", "Delete", "Replace", "Replace", "Modify", "Snapshot"])
        side = rng.choice(["Buy", "Sell"])
        px = 1000000 + (-100 if side == "Buy" else 100) * rng.randint(0, 3)
        order = rng.choice([0, rng.choice(made), rng.choice(made[-3:]), 9999]) if kind != "Add" else rng.choice([0, i + 10, i + 10, rng.choice(made)])
        new = i + 5000 if kind == "Replace" else 0
        if kind == "Add" and order:
            made.append(order)
        if new:
            made.append(new)
        t += rng.choice([0, 30_000])
        rows.append((t, kind, rng.choice([0, px]) if kind == "Trade" else px, rng.choice([0, 1, 5, 20]), order, new, side))
    return rows


def test_chains_give_the_quirky_book_of_a_plain_loop(spark):
    for seed in range(4):
        m = msgs(spark, random_orders(random.Random(seed), 500))
        plain, want, rests = Book(), {}, {}
        for r in m.orderBy("pos").collect():
            plain.apply(r["type"], r["order_id"], r["new_order_id"], r["px"], r["qty"], r["side"])
            # A level may stand at 0 after a snapshot of 0; it is no level of the relational book.
            for ladder in plain.sides.values():
                for px in [p for p, q in ladder.items() if q <= 0]:
                    del ladder[px]
            want[r["pos"]] = plain.best()
            order = plain.orders.get(r["order_id"]) if r["order_id"] else None
            rests[r["pos"]] = order[2] if order else None
        got = {r["pos"]: (r["best_bid"], r["best_bid_qty"], r["best_ask"], r["best_ask_qty"]) for r in compat_bbo(m).collect()}
        assert got == want
        assert {r["pos"]: r["resting_side"] for r in level_changes(m).where("part = 0").collect()} == rests


def test_long_chains_and_messages_without_orders(spark):
    rows = [(0, "Add", 1010000, 10, 1, 0, "Sell")] + [(i, "Replace", 1010000 + 100 * i, 10, i, i + 1, "Sell") for i in range(1, 60)]
    m = msgs(spark, rows)
    assert {r["root"] for r in order_chains(m).collect()} == {1}
    assert [r["best_ask"] for r in compat_bbo(m).orderBy("pos").collect()] == [1010000 + 100 * i for i in range(60)]


def test_compat_features_and_snapshots(spark):
    rows = [(0, "Add", 1010000, 500, 1, 0, "Sell"), (1, "Add", 1000000, 300, 2, 0, "Buy"), (2, "Add", 1000000, 40, 3, 0, "Buy"), (3, "Delete", 0, 0, 2, 0, "Buy"), (4, "Add", 1000000, 7, 5, 0, "Buy"), (5, "Execute", 0, 100, 1, 0, "Buy"), (6, "Replace", 1020000, 50, 1, 4, "Buy")]
    m = msgs(spark, rows)
    got = features.order_features(m, "compat").orderBy("pos").collect()
    # The whole bid level goes with order 2; the replaced sell order comes back as a bid.
    assert [(r["best_bid"], r["best_bid_qty"], r["best_ask_qty"]) for r in got] == [(0, 0, 500), (1000000, 300, 500), (1000000, 340, 500), (0, 0, 500), (1000000, 7, 500), (1000000, 7, 400), (1020000, 50, 0)]
    assert [r["buy_ratio"] for r in got] == [0, 0, 0, 0, 0, 1, 1]
    clean = features.order_features(m).orderBy("pos").collect()
    assert (clean[3]["best_bid_qty"], clean[6]["best_ask"]) == (40, 1020000)
    assert sampling.market_snapshots(m, count=2, by_order=True, semantics="compat").count() == 4
    assert book.bbo(m, book.order_levels(m, book.l3_remaining(book.resolve_replacements(m)))).count() == 7
