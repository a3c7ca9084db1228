"""All registered queries of the order-book engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depthline.functions.fixed_point import csv_double, filled, opposite, to_double, to_price, to_qty
from depthline.operators import book, features, metrics, sampling
from depthline.operators.compat import compat_bbo
from depthline.plans.oracles import ORACLES  # noqa: F401
from depthline.schema import FEATURES
from depthline.scratch import freed, stored
from depthline.sources import depth_json, fixtures, itch

FLAGSHIP = "market_snapshots"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _l2(s: SparkSession, d: str) -> DataFrame:
    return fixtures.l2_messages(s, d)


def _priced(s: SparkSession, d: str) -> DataFrame:
    """Held prices of the level messages, the base of labels and backtests."""
    return features.priced(_l2(s, d)).select("instrument", "pos", "ts_us", "best_bid", "best_bid_qty", "best_ask", "best_ask_qty", "midprice", "spread", "microprice", "queue_imbalance")


def _quoted(s: SparkSession, d: str) -> DataFrame:
    """Priced rows from the first two-sided book on (before it the mid is 0 and returns mean nothing)."""
    return _priced(s, d).where("midprice > 0")


def _scored(s: SparkSession, d: str) -> DataFrame:
    """Quoted rows with the first label and a score."""
    rows = sampling.add_labels(_quoted(s, d), (1,))
    return rows.withColumns({"prob": F.col("pos") * 7919 % 1000 / F.lit(1000.0), "y": F.col("label_1").cast("int")})


r9 = lambda *cs: [F.round(c, 9).alias(c) for c in cs]


@query
def parse_depth_json(s, d):
    return depth_json.parse_depth_updates(fixtures.depth_lines(s, d)).select("event_id", F.col("n").cast("bigint").alias("n"), "seq", "ts_us", "type", "px", "qty", "side")


@query
def parse_snapshot_json(s, d):
    lines = fixtures.depth_lines(s, d).select("event_id", F.regexp_replace(F.regexp_replace(F.regexp_replace("line", '"u":', '"lastUpdateId":'), '"b":', '"bids":'), '"a":', '"asks":').alias("line"))
    return depth_json.parse_snapshots(lines).select("event_id", "seq", "ts_us", "type", "px", "qty", "side")


@query
def route_lines(s, d):
    line = F.when(F.col("event_id") % 7 == 0, '{"type":"snapshot"}').when(F.col("event_id") % 5 == 0, "{}").otherwise(F.col("line"))
    return fixtures.depth_lines(s, d).select(depth_json.route(line).alias("kind")).where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def itch_parse(s, d):
    files = itch.encode_orders(fixtures.l3_messages(s, d))
    return itch.parse_orders(files).select("instrument", "n", "track", "ts_us", "type", "order_id", "px", "qty", "side")


@query
def batch_track_range(s, d):
    m = itch.parse_orders(itch.encode_orders(fixtures.l3_messages(s, d)))
    return m.groupBy("instrument").agg(F.min_by("track", "n").alias("first_track"), F.max_by("track", "n").alias("last_track"))


@query
def be_decode(s, d):
    o = fixtures.table(s, d, "orders").select("o_orderkey", F.unhex(F.lpad(F.hex("o_orderkey"), 16, "0")).alias("raw"))
    return o.select("o_orderkey", itch.big_endian(F.col("raw"), 1, 8).alias("u64"), itch.big_endian(F.col("raw"), 7, 2).alias("u16"))


@query
def itch_sizes(s, d):
    kinds = s.range(26).select(F.char(F.col("id") + 65).alias("kind"))
    return kinds.select("kind", itch.size_of(F.col("kind")).cast("bigint").alias("size"))


@query
def scan_parquet(s, d):
    return fixtures.table(s, d, "events").where("event_type = 'purchase'").select("event_id", "value")


@query
def csv_format(s, d):
    return fixtures.table(s, d, "events").select("event_id", csv_double(F.floor(F.col("value") * 1000) / 8000.0).alias("text"))


@query
def price_fixed(s, d):
    x = F.floor(F.col("value") * 100) / 100.0
    return fixtures.table(s, d, "events").select("event_id", to_price(x).alias("px"), to_double(to_price(x)).alias("back"))


@query
def qty_round(s, d):
    x = (F.col("event_id") % 41 - 20) / 8.0
    return fixtures.table(s, d, "events").select("event_id", to_qty(x).alias("replay"), to_qty(x, "live").alias("live"))


@query
def side_opposite(s, d):
    return _l2(s, d).select("instrument", "pos", opposite(F.col("side")).alias("other"))


@query
def feature_vector(s, d):
    rows = features.all_features(_l2(s, d), keep=())
    return rows.select("instrument", "pos", *[F.round(F.array(*[filled(F.col(c)) for c in FEATURES])[i], 6).alias(f"f{i}") for i in range(len(FEATURES))])


@query
def feature_fill(s, d):
    x = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 1, F.col("value"))
    return fixtures.table(s, d, "events").select("event_id", filled(x).alias("x"))


@query
def two_sided_rows(s, d):
    return book.bbo(_l2(s, d)).where("best_bid <> 0 AND best_ask <> 0")


@query
def diff_sync(s, d):
    """Updates kept after a snapshot at the 500th id: first id past it, or spanning it."""
    e = fixtures.table(s, d, "events").select((F.col("event_id") * 3).alias("first"), (F.col("event_id") * 3 + 2).alias("final"))
    return e.where("first > 500 OR (first <= 501 AND final > 500)")


@query
def normalize_msgs(s, d):
    return book.normalize(_l2(s, d)).select("instrument", "pos", "type")


@query
def seq_gap(s, d):
    t = _l2(s, d).select("instrument", "pos", (F.row_number().over(Window.partitionBy("instrument").orderBy("pos")) + F.floor(F.col("pos") / 997)).cast("int").alias("track"))
    return book.sequence_gaps(t.withColumn("track", F.col("track") % 65536))


@query
def l2_levels(s, d):
    return book.l2_levels(_l2(s, d))


@query
def l2_levels_live(s, d):
    m = _l2(s, d).withColumn("type", F.when(F.col("pos") % 1000 < 3, "Snapshot").otherwise(F.col("type")))
    return book.l2_levels(m, clear_on_snapshot=True).select("instrument", "side", "px", "pos", "vol")


@query
def bbo(s, d):
    return book.bbo(_l2(s, d))


@query
def compat_book(s, d):
    """The sequential scan, which on level messages must equal the relational book."""
    return compat_bbo(_l2(s, d))


def _probes(s, d):
    return _l2(s, d).where("pos % 3 = 0").select("instrument", "pos", "side", F.when(F.col("side") == "Buy", 1000000 - 100 * (1 + F.col("pos") % 10)).otherwise(1000000 + 100 * (1 + F.col("pos") % 10)).cast("bigint").alias("px"))


@query
def volume_at(s, d):
    return book.volume_at(_probes(s, d), book.l2_levels(_l2(s, d)))


@query
def level_imbalance(s, d):
    """Volume share of the bid at a probed price; 0.5 where neither side has a level."""
    levels = book.l2_levels(_l2(s, d))
    p = _probes(s, d).select("instrument", "pos", "px")
    of = lambda side, name: book.volume_at(p.withColumn("side", F.lit(side)), levels).select("instrument", "pos", F.col("volume").alias(name))
    both = of("Buy", "bid").join(of("Sell", "ask"), ["instrument", "pos"], "full_outer")
    return both.select("instrument", "pos", F.coalesce(F.try_divide(F.col("bid"), F.col("bid") + F.col("ask")), F.lit(0.5)).alias("level_imbalance"))


@query
def depth_topn(s, d):
    m = _l2(s, d)
    return book.depth_topn(m.where("pos % 10 = 0"), book.l2_levels(m), 5)


@query
def l3_remaining(s, d):
    return book.l3_remaining(fixtures.l3_messages(s, d)).select("instrument", "order_id", "pos", "remaining")


@query
def l3_orphans(s, d):
    """Executes before their order are ignored."""
    return book.l3_remaining(fixtures.l3_messages(s, d, orphans=True)).groupBy("instrument", "order_id").agg(F.max_by("remaining", "pos").alias("remaining"))


@query
def l3_levels(s, d):
    return book.l3_levels(book.l3_remaining(fixtures.l3_messages(s, d))).select("instrument", "side", "px", "pos", "vol")


@query
def l3_replace(s, d):
    """Every tenth order is replaced at once by a new id at a price further out; final level sums."""
    # Read by every step of the chains and by the result.
    m = stored(fixtures.l3_messages(s, d).where("type = 'Add'"), "adds").withColumn("pos", F.col("pos") * 2).withColumn("new_order_id", F.lit(0).cast("bigint"))
    moved = m.where("order_id % 10 = 0").select("instrument", (F.col("pos") + 1).alias("pos"), F.lit("Replace").alias("type"), "order_id", (F.col("px") + F.when(F.col("side") == "Buy", -50).otherwise(50)).cast("bigint").alias("px"), "qty", F.lit("Buy").alias("side"), (-F.col("order_id") - 1).alias("new_order_id"))
    rows = book.l3_remaining(book.resolve_replacements(m.unionByName(moved)))
    return rows.groupBy("instrument", "side", "px").agg(F.sum("delta").alias("vol")).where("vol > 0")


@query
def order_lookup(s, d):
    m = fixtures.l3_messages(s, d)
    return book.order_lookup(m.where("type = 'Execute'").select("instrument", "pos", "order_id"), book.l3_remaining(m))


def _fed(s: SparkSession, d: str) -> DataFrame:
    """The order feed after a round trip through its binary files."""
    return itch.parse_orders(itch.encode_orders(fixtures.order_feed(s, d)))


def _needed(m: DataFrame) -> DataFrame:
    """The columns of an order feed that its book and features read; what else there is would travel with every row."""
    return m.select("instrument", "pos", "ts_us", "type", "order_id", "new_order_id", "px", "qty", "side")


@query
def itch_messages(s, d):
    """Every kind of order message as decoded from the binary feed."""
    return _fed(s, d).select("instrument", "pos", "ts_us", "type", "order_id", "new_order_id", "px", "qty", "side")


@query
def itch_ranges(s, d):
    """The same messages with every file framed and decoded in ranges of 10,000 bytes, cut anywhere."""
    files = itch.encode_orders(fixtures.order_feed(s, d)).select(F.concat_ws("/", "instrument", "chunk").alias("instrument"), "content")
    m = itch.parse_ranges(itch.cut_ranges(files, 10_000)).withColumn("pos", F.split_part("instrument", F.lit("/"), F.lit(2)).cast("bigint") * itch.CHUNK + F.col("n") + 1)
    return m.withColumn("instrument", F.split_part("instrument", F.lit("/"), F.lit(1))).select("instrument", "pos", "ts_us", "type", "order_id", "new_order_id", "px", "qty", "side")


@query
def order_bbo(s, d):
    m = stored(fixtures.order_feed(s, d), "feed")
    return book.bbo(m, book.order_levels(m, stored(book.l3_remaining(book.resolve_replacements(m)), "remaining")))


def _order_features(s: SparkSession, d: str) -> DataFrame:
    m = stored(_needed(fixtures.order_feed(s, d)), "feed")
    rows = features.order_features(m, keep=())
    freed(m)
    return rows


@query
def buy_ratio_orders(s, d):
    """Trades by order id count as bought when the order they meet is a sell order that still stands."""
    return _order_features(s, d).select("instrument", "pos", "buy_ratio")


@query
def order_features(s, d):
    return _order_features(s, d).select("instrument", "pos", "ofi", "arrival_rate", "cancel_rate", "trade_intensity", "buy_ratio", *r9("midprice", "spread", "microprice", "queue_imbalance", "bid_slope", "ask_slope", "volatility"))


@query
def itch_snapshots(s, d):
    """The main program: binary feed, order book, twelve features, sampler, 19 columns."""
    rows = sampling.market_snapshots(_needed(_fed(s, d)), by_order=True).drop("prediction")
    return rows.select(*[F.round(c, 9).alias(c) if t == "double" and c != "buy_ratio" else F.col(c) for c, t in rows.dtypes])


def _quirky(m: DataFrame) -> DataFrame:
    """An order feed in which every second order that is traded by id is so a tick from where it stands."""
    return m.withColumn("px", F.when((F.col("type") == "Trade") & (F.col("order_id") % 12 == 2), F.col("px") + 100).otherwise(F.col("px")))


@query
def order_bbo_compat(s, d):
    """Best prices with the published engine's quirks: whole levels deleted, trades at their own price, replaced orders on the bid side."""
    return compat_bbo(_quirky(stored(fixtures.order_feed(s, d), "feed")))


@query
def itch_snapshots_compat(s, d):
    """The main program as published: binary feed, quirky book, twelve features, sampler, 19 columns."""
    rows = sampling.market_snapshots(_quirky(_needed(_fed(s, d))), by_order=True, semantics="compat").drop("prediction")
    return rows.select(*[F.round(c, 9).alias(c) if t == "double" and c != "buy_ratio" else F.col(c) for c, t in rows.dtypes])


@query
def depth_pipeline(s, d):
    """Update lines to normalised messages and the best prices after each."""
    m = depth_json.parse_depth_updates(fixtures.depth_lines(s, d)).withColumns({"instrument": F.lit("X"), "pos": F.col("event_id") * 3 + F.col("n")})
    # Read several times by the two results, and much shorter than its lines.
    m = stored(m.select("instrument", "pos", "type", "px", "qty", "side"), "depth-messages")
    kinds = book.normalize(m).select("instrument", "pos", "type")
    return book.bbo(m).join(kinds, ["instrument", "pos"]).drop("instrument")


@query
def midprice(s, d):
    return features.priced(_l2(s, d)).select("instrument", "pos", "midprice")


@query
def spread(s, d):
    return features.priced(_l2(s, d)).select("instrument", "pos", *r9("spread"))


@query
def microprice(s, d):
    return features.priced(_l2(s, d)).select("instrument", "pos", *r9("microprice"))


@query
def queue_imbalance(s, d):
    return features.priced(_l2(s, d)).select("instrument", "pos", *r9("queue_imbalance"))


@query
def ofi_cumulative(s, d):
    return features.ofi(_l2(s, d)).select("instrument", "pos", "ofi")


@query
def ofi_interval(s, d):
    return features.ofi_interval(_l2(s, d), 50)


@query
def arrival_rate(s, d):
    return features.rates(_l2(s, d)).select("instrument", "pos", "arrival_rate")


@query
def cancel_rate(s, d):
    return features.rates(_l2(s, d)).select("instrument", "pos", "cancel_rate")


@query
def trade_intensity(s, d):
    return features.rates(_l2(s, d)).select("instrument", "pos", "trade_intensity")


@query
def buy_ratio(s, d):
    return features.buy_ratio(features.priced(_l2(s, d))).select("instrument", "pos", "buy_ratio")


@query
def book_slope(s, d):
    return features.book_features(_l2(s, d)).select("instrument", "pos", *r9("bid_slope", "ask_slope"))


@query
def book_slope_live(s, d):
    return features.live_features(_l2(s, d)).select("instrument", "pos", *r9("bid_slope", "ask_slope"))


@query
def live_features(s, d):
    return features.live_features(_l2(s, d)).select("instrument", "pos", *r9("midprice", "spread", "microprice", "queue_imbalance"))


@query
def volatility(s, d):
    return features.book_features(_l2(s, d)).select("instrument", "pos", *r9("volatility"))


@query
def features_all(s, d):
    return features.all_features(_l2(s, d), keep=()).select("instrument", "pos", "ofi", "arrival_rate", "cancel_rate", "trade_intensity", "buy_ratio", *r9("midprice", "spread", "microprice", "queue_imbalance", "bid_slope", "ask_slope", "volatility"))


@query
def sample_snapshots(s, d):
    return sampling.sample_positions(_l2(s, d))


@query
def sample_snapshots_by_count(s, d):
    return sampling.sample_positions(_l2(s, d), count=7)


@query
def market_snapshots(s, d):
    rows = sampling.market_snapshots(_l2(s, d)).drop("prediction")
    return rows.select(*[F.round(c, 9).alias(c) if t == "double" and c != "buy_ratio" else F.col(c) for c, t in rows.dtypes])


@query
def prediction_default(s, d):
    return sampling.market_snapshots(_l2(s, d)).select("instrument", "pos", F.isnan("prediction").alias("none"))


@query
def sample_every_k(s, d):
    return sampling.every_k(_l2(s, d), 7).select("instrument", "pos")


def _labels(h):
    def f(s, d):
        return sampling.add_labels(_quoted(s, d), (h,)).select("instrument", "pos", *r9(f"next_return_{h}"), f"label_{h}", *r9(f"microprice_change_{h}"))

    f.__name__ = f"labels_{h}"
    return query(f)


labels_1, labels_5, labels_10 = _labels(1), _labels(5), _labels(10)


@query
def chrono_split(s, d):
    return sampling.chrono_split(_l2(s, d)).groupBy("instrument", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))


@query
def queue_fill_sim(s, d):
    return sampling.queue_fills(_priced(s, d)).select("instrument", "pos", "depth_ahead", "expected_fill_time_us", "fill_1ms", "fill_5ms", "fill_10ms")


@query
def queue_fill_sim_sell(s, d):
    return sampling.queue_fills(_priced(s, d), side="sell").select("instrument", "pos", "depth_ahead", "expected_fill_time_us")


@query
def queue_features(s, d):
    """What an order placed at the probed price would find."""
    levels = book.l2_levels(_l2(s, d))
    ahead = book.volume_at(_probes(s, d), levels).withColumnRenamed("volume", "depth_ahead")
    return ahead.join(_priced(s, d), ["instrument", "pos"]).select("instrument", "pos", "side", "px", "depth_ahead", *r9("midprice", "spread", "queue_imbalance"))


@query
def queue_model_features(s, d):
    """The eight features of an order placed at the probed price."""
    m = _l2(s, d)
    ahead = volume_at(s, d).select("instrument", "pos", "side", "px", F.col("volume").alias("depth_ahead"))
    rows = features.ofi(features.rates(features.priced(m))).select("instrument", "pos", "midprice", "spread", "queue_imbalance", "arrival_rate", "cancel_rate", "ofi")
    return ahead.join(level_imbalance(s, d), ["instrument", "pos"]).join(rows, ["instrument", "pos"]).select("instrument", "pos", "side", "px", "depth_ahead", *r9("level_imbalance"), F.round("queue_imbalance", 9).alias("top_imbalance"), *r9("spread", "midprice"), "arrival_rate", "cancel_rate", "ofi")


@query
def queue_train_table(s, d):
    """Features and targets of the fill model, from simulated orders."""
    rows = sampling.queue_fills(features.ofi(features.rates(features.priced(_l2(s, d)))))
    return rows.select("instrument", "pos", "order_price", "depth_ahead", *r9("level_imbalance"), F.round("queue_imbalance", 9).alias("top_imbalance"), *r9("spread", "midprice"), "arrival_rate", "cancel_rate", "ofi", "fill_1ms", "fill_5ms", "fill_10ms")


@query
def evaluate_sharpe(s, d):
    return metrics.evaluation(_scored(s, d), "instrument").select("instrument", F.round("sharpe", 6).alias("sharpe"), *r9("right"), "n")


@query
def backtest_positions(s, d):
    return metrics.turnover(metrics.positions(_scored(s, d), 0.55)).select("instrument", "pos", F.col("position").cast("bigint").alias("position"), F.col("turnover").cast("bigint").alias("turnover"))


@query
def turnover(s, d):
    return metrics.turnover(metrics.positions(_scored(s, d))).groupBy("instrument").agg(F.sum("turnover").alias("turnover"))


@query
def equity_curve(s, d):
    return metrics.strategy(metrics.positions(_scored(s, d)), 1.0).select("instrument", "pos", *r9("equity"))


@query
def backtest_summary(s, d):
    rows = metrics.strategy(metrics.positions(sampling.chrono_split(_scored(s, d)).where("part = 'test'")))
    return metrics.backtest_summary(rows)


@query
def direction_pnl(s, d):
    return metrics.direction_pnl(_scored(s, d)).groupBy("instrument").agg(F.sum("reward").alias("pnl"), F.avg("reward").alias("mean"))


@query
def pnl_curve(s, d):
    return metrics.direction_pnl(_scored(s, d)).select("instrument", "pos", *r9("curve"))


@query
def live_signal(s, d):
    return metrics.positions(fixtures.scored(s, d), 0.55).select("pos", F.col("position").cast("bigint").alias("position"), F.when(F.col("prob") > 0.55, "UP").when(F.col("prob") < 0.45, "DOWN").otherwise("FLAT").alias("label"))


@query
def live_accuracy(s, d):
    return metrics.live_accuracy(_scored(s, d)).select("instrument", "pos", *r9("accuracy"), "pnl")


@query
def confusion_matrix(s, d):
    return metrics.confusion(fixtures.scored(s, d))


@query
def auc_rank(s, d):
    return metrics.auc(fixtures.scored(s, d)).select(*r9("auc"))


@query
def roc_points(s, d):
    return metrics.roc_points(fixtures.scored(s, d)).select("prob", *r9("fpr", "tpr"))


@query
def calibration(s, d):
    return metrics.calibration(fixtures.scored(s, d)).select("bin", *r9("mean_pred", "mean_label"), "n")


@query
def brier(s, d):
    return metrics.brier(fixtures.scored(s, d)).select(*r9("brier"))


@query
def classif_metrics(s, d):
    return metrics.classification(fixtures.scored(s, d)).select(*r9("accuracy", "precision", "recall"))


@query
def class_weights(s, d):
    return metrics.class_weights(fixtures.scored(s, d)).select("y", *r9("weight"))


@query
def standard_scale(s, d):
    rows = _priced(s, d)
    return metrics.standard_scale(rows, ["midprice", "spread"]).select("instrument", "pos", F.round("midprice", 6).alias("midprice"), F.round("spread", 6).alias("spread"))


@query
def union_sides(s, d):
    m = _l2(s, d)
    part = lambda side, n: m.where(F.col("side") == side).select("instrument", "pos", F.lit(n).cast("bigint").alias("part"), "px", "qty")
    return part("Buy", 0).unionByName(part("Sell", 1))
