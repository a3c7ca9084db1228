import random
import re

from depthline.operators import book, carry, features
from test_order_book import msgs


def rows_of(rng, n):
    return [(20_000 * i, rng.choice(["Add", "Modify", "Delete", "Trade"]), 1000000 + 100 * rng.randint(0, 2), rng.choice([0, 1, 5, 20]), 0, 0, rng.choice(["Buy", "Sell"])) for i in range(n)]


def test_growth_in_buckets_equals_the_windows(spark, monkeypatch):
    m = msgs(spark, rows_of(random.Random(2), 200))
    for module in (book, features, carry):
        monkeypatch.setattr(module, "BUCKET", 16)
    states = book.book_states(m, book.l2_levels(m), before=features._openings(m))
    want, held = {}, {}
    for r in m.orderBy("pos").collect():
        now = 0 if r["type"] == "Delete" else r["qty"]
        grown = max(now - held.get((r["side"], r["px"]), 0), 0)
        held[r["side"], r["px"]], want[r["pos"]] = now, grown if r["side"] == "Buy" else -grown
    assert {r["pos"]: r["delta"] for r in states.collect()} == want
    # Growth by windows in buckets says the same; no window is by level alone.
    windows = features.ofi_deltas(m)
    assert {r["pos"]: r["delta"] for r in windows.collect()} == want
    for by, order in re.findall(r"Window .*\], \[([^\[\]]*)\], \[(\w+)#", windows._jdf.queryExecution().optimizedPlan().toString()):
        assert "_bucket" in by or order == "_bucket"


def test_messages_some_milliseconds_apart_share_a_time_bucket(spark):
    m = msgs(spark, rows_of(random.Random(2), 500))
    buckets = m.select(carry.bucket_of("ts_us", carry.TIME_BUCKET).alias("b")).distinct().count()
    assert buckets * 40 <= 500
    old = {r["ts_us"]: r["n"] for r in carry.expired(m, {"n": m["type"] == "Add"}, features.SECOND).collect()}
    times = [(r["ts_us"], r["type"]) for r in m.collect()]
    assert old == {t: sum(k == "Add" and u < t - features.SECOND for u, k in times) for t, _ in times}
