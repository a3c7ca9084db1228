"""The canonical message and the snapshot table."""

from __future__ import annotations

#: Prices are integers in units of 1 / SCALE.
SCALE = 10_000
MESSAGE = "instrument string, pos bigint, seq bigint, ts_us bigint, type string, order_id bigint, new_order_id bigint, px bigint, qty bigint, side string"
# The feature vector and the snapshot columns, names and order.
FEATURES = ["midprice", "spread", "microprice", "ofi", "queue_imbalance", "arrival_rate", "cancel_rate", "bid_slope", "ask_slope", "volatility", "trade_intensity", "buy_ratio"]
SNAPSHOT = ["seq", "ts_us", "best_bid", "best_bid_qty", "best_ask", "best_ask_qty", "midprice", "spread", "microprice", "ofi", "queue_imbalance", "arrival_rate", "cancel_rate", "bid_slope", "ask_slope", "volatility", "trade_intensity", "buy_ratio", "prediction"]
