import random
import re

from depthline.operators import book, carry, compat
from test_compat import random_orders
from test_order_book import msgs


def level_rows(df):
    return sorted(map(tuple, df.select("instrument", "side", "px", "pos", "next_pos", "vol").collect()))


def plain_levels(rows, end):
    """Level states and where each ends, by a loop over messages ``pos, type, side, px, qty``."""
    held, out, last = {}, [], {}
    for pos, kind, side, px, qty in rows:
        now = held.get((side, px), 0)
        held[side, px] = now = max(0, {"Add": now + max(qty, 0), "Trade": now - qty, "Execute": now - qty, "Delete": 0, "Modify": max(qty, 0)}.get(kind, qty))
        if (side, px) in last:
            out[last[side, px]][4] = pos
        last[side, px] = len(out)
        out.append(["X", side, px, pos, end, now])
    return sorted(map(tuple, out))


def test_levels_by_buckets_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(carry, "BUCKET", 7)
    rng = random.Random(5)
    rows = [(i, rng.choice(["Add", "Add", "Trade", "Trade", "Execute", "Delete", "Modify"] if i > 60 else ["Add", "Trade"]), rng.choice(["Buy", "Sell"]), 1000000 + 100 * rng.randint(0, 2), rng.choice([0, 3, 9])) for i in range(400)]
    m = spark.createDataFrame([("X", *r) for r in rows], "instrument string, pos bigint, type string, side string, px bigint, qty bigint")
    assert level_rows(book.l2_levels(m)) == plain_levels(rows, 400)


def test_normal_forms_across_buckets(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("X", i, rng.choice(["Modify", "Delete", "Snapshot", "Snapshot", "Trade"]), rng.choice(["Buy", "Sell"]), 1000000, 1) for i in range(300)]
    m = spark.createDataFrame(rows, "instrument string, pos bigint, type string, side string, px bigint, qty bigint")
    seen, want, last = {}, {}, None
    for _, pos, kind, side, _, _ in rows:
        if kind == "Snapshot" and last != "Snapshot":
            seen.clear()
        want[pos] = "Add" if kind == "Modify" and seen.get(side) in (None, "Delete") else kind
        seen[side], last = kind, kind
    monkeypatch.setattr(carry, "BUCKET", 5)
    assert {r["pos"]: r["type"] for r in book.normalize(m).collect()} == want


def unique_orders(rng, n):
    """Adds, takes and replacements of orders whose ids are used once."""
    rows, live = [], []
    for i in range(n):
        kind = rng.choice(["Add", "Add", "Execute", "Delete", "Replace"]) if live else "Add"
        side, px, order, new = rng.choice(["Buy", "Sell"]), 1000000 + 100 * rng.randint(0, 2), i + 10, 0
        if kind == "Add":
            live.append(order)
        else:
            order = live.pop(rng.randrange(len(live)))
            if kind == "Replace":
                new = i + 5000
                live.append(new)
            elif kind == "Execute":
                live.append(order)
        rows.append((i * 1000, kind, px, rng.choice([1, 5, 20]), order, new, side))
    return rows


def test_order_and_quirky_levels_do_not_depend_on_buckets(spark, monkeypatch):
    m, quirky = (msgs(spark, f(random.Random(3), 300)) for f in (unique_orders, random_orders))
    made = []
    for size in (4096, 6):
        monkeypatch.setattr(carry, "BUCKET", size)
        left = book.l3_remaining(book.resolve_replacements(m))
        made.append((level_rows(book.order_levels(m, left)), sorted(map(tuple, book.l3_levels(left).collect())), level_rows(compat.change_levels(quirky, compat.level_changes(quirky)))))
    assert made[0] == made[1]


def test_no_window_of_messages_is_by_level_alone(spark):
    m = msgs(spark, unique_orders(random.Random(3), 50))
    left = book.l3_remaining(book.resolve_replacements(m))
    for df in (book.l2_levels(m), book.normalize(m), book.order_levels(m, left), book.l3_levels(left), compat.change_levels(m, compat.level_changes(m))):
        for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
            keys = re.findall(r"Window .*\], \[([^\[\]]*)\], \[(\w+)#", line)
            # Windows ordered by bucket run over one row a bucket.
            assert all("_bucket" in by or "order_id" in by or order == "_bucket" for by, order in keys), line
