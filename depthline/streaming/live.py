"""Streaming: per-instrument order flow, rates, book and delayed scoring as keyed state, and the recorder.

State is what the next messages need and no more: the quantity last seen at each level, the
times of the last second's events, and the predictions not scored yet.  A trigger's messages of an
instrument are handled as arrays; how many they are is set by the source's limits for a trigger.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from depthline.operators.book import _side

SECOND = 1_000_000
_KINDS = (("arrival_rate", ("Add",)), ("cancel_rate", ("Delete",)), ("trade_intensity", ("Trade", "Execute")))
_FLOW = "instrument string, pos bigint, ts_us bigint, ofi bigint, arrival_rate double, cancel_rate double, trade_intensity double"
_LIVE = _FLOW + ", best_bid bigint, best_bid_qty bigint, best_ask bigint, best_ask_qty bigint, midprice double, bid_slope double, ask_slope double, prob double, seen bigint, accuracy double, pnl bigint"
_STATE = "ofi bigint, sides array<string>, prices array<bigint>, volumes array<bigint>, adds array<bigint>, cancels array<bigint>, trades array<bigint>, probs array<double>, mids array<double>, seen bigint, hits bigint"


def _levels(rows: pd.DataFrame, state: tuple) -> pd.DataFrame:
    """The level changes of state and messages by level and position: ``now`` and the quantity ``before``; state comes first, at position -1."""
    held = pd.DataFrame({"side": state[1], "px": pd.Series(state[2], dtype="int64"), "now": pd.Series(state[3], dtype="int64"), "at": -1})
    now = np.where((rows["type"] == "Delete") | (rows["qty"] <= 0), 0, rows["qty"])
    own = pd.concat([held, pd.DataFrame({"side": rows["side"], "px": rows["px"], "now": now, "at": np.arange(len(rows))})], ignore_index=True)
    own["before"] = own.groupby(["side", "px"])["now"].shift(fill_value=0)
    own["stop"] = own.groupby(["side", "px"])["at"].shift(-1, fill_value=len(rows))
    return own


def _flow(rows: pd.DataFrame, state: tuple, own: pd.DataFrame) -> tuple[dict, int, list[list[int]]]:
    """Running order flow and rates of the messages, and what the state keeps of them."""
    mine = own[own["at"] >= 0]
    grown = np.maximum(mine["now"].to_numpy() - mine["before"].to_numpy(), 0)
    ofi = state[0] + np.cumsum(np.where(rows["side"] == "Buy", grown, -grown))
    ts, out, kept = rows["ts_us"].to_numpy(), {"ofi": ofi}, []
    for (name, kinds), old in zip(_KINDS, state[4:7]):
        hit = rows["type"].isin(kinds).to_numpy()
        times = np.concatenate((np.asarray(old, np.int64), ts[hit]))
        out[name] = (len(old) + np.cumsum(hit) - np.searchsorted(times, ts - SECOND, "left")).astype(float)
        kept.append(times[np.searchsorted(times, ts[-1] - SECOND, "left") :].tolist())
    return out, int(ofi[-1]), kept


def _step(key, batches, state: GroupState, predict: Callable[[pd.DataFrame], np.ndarray] | None, lag: int, live: bool):
    rows = pd.concat(list(batches)).sort_values("pos", ignore_index=True)
    old = state.get if state.exists else (0, [], [], [], [], [], [], [], [], 0, 0)
    own = _levels(rows, old)
    made, ofi, times = _flow(rows, old, own)
    out = rows[["instrument", "pos", "ts_us"]].assign(**made)
    probs, mids, seen, hits = list(old[7]), list(old[8]), old[9], old[10]
    if live:
        held = own[own["now"] > 0].assign(begin=lambda o: np.maximum(o["at"], 0)).rename(columns={"now": "vol"})
        at = np.arange(len(rows))
        bid, bid_qty, _, bid_slope = _side(at, held[held["side"] == "Buy"], True, 5)
        ask, ask_qty, _, ask_slope = _side(at, held[held["side"] == "Sell"], False, 5)
        mid = np.where((bid != 0) & (ask != 0), (bid / 10000.0 + ask / 10000.0) / 2.0, np.nan)
        out = out.assign(best_bid=bid, best_bid_qty=bid_qty, best_ask=ask, best_ask_qty=ask_qty, midprice=mid, bid_slope=bid_slope, ask_slope=ask_slope)
        prob = np.asarray(predict(out) if predict else np.full(len(out), 0.5), float)
        # Each row scores the prediction made ``lag`` rows before against the mid's move since.
        p, m = np.concatenate((np.full(lag - len(probs), np.nan), probs, prob)), np.concatenate((np.full(lag - len(mids), np.nan), mids, mid))
        due = ~(np.isnan(p[:-lag]) | np.isnan(m[:-lag]) | np.isnan(mid))
        right = due & ((p[:-lag] > 0.5) == (mid > m[:-lag]))
        n, k = seen + np.cumsum(due), hits + np.cumsum(right)
        out = out.assign(prob=prob, seen=n, accuracy=np.where(n > 0, k / np.maximum(n, 1), np.nan), pnl=2 * k - n)
        probs, mids, seen, hits = p[-lag:].tolist(), m[-lag:].tolist(), int(n[-1]), int(k[-1])
    last = own[own["stop"] == len(rows)]
    last = last[last["now"] > 0]
    state.update((ofi, last["side"].tolist(), last["px"].tolist(), last["now"].tolist(), *times, probs, mids, seen, hits))
    yield out


def flow_features(messages: DataFrame) -> DataFrame:
    """Running order-flow imbalance and rates of a message stream."""

    def run(key, batches, state):
        yield from _step(key, batches, state, None, 1, False)

    return messages.groupBy("instrument").applyInPandasWithState(run, _FLOW, _STATE, "append", GroupStateTimeout.NoTimeout)


def live_loop(messages: DataFrame, predict: Callable[[pd.DataFrame], np.ndarray] | None = None, lag: int = 5) -> DataFrame:
    """The live loop over a stream of level updates (each sets its level): book, flow, score, and scoring of the prediction ``lag`` rows ago.

    A snapshot's messages at the head of the stream are the bootstrap: they set levels like any
    other.  ``predict`` takes the rows so far made as a frame and gives a probability for each.
    """

    def run(key, batches, state):
        yield from _step(key, batches, state, predict, lag, True)

    return messages.groupBy("instrument").applyInPandasWithState(run, _LIVE, _STATE, "append", GroupStateTimeout.NoTimeout)


def record(features: DataFrame, path: str, checkpoint: str):
    """Write a stream to Parquet, exactly once."""
    return features.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
