"""The live strategy on a stream of depth frames: bootstrap, book, twelve inputs, position and delayed scoring.

A frame is a snapshot or one update with all its levels.  Per instrument the first updates
(``sync_events`` of them, or fewer when none comes for ``quiet_ms``) are the bootstrap: those that
come before a snapshot wait in a list state, and once it is there each is applied only if it is
newer than the snapshot.  The wait is judged by the clock when the next frames come, not by
timers, which would keep a stream without data busy.  Bootstrap updates change the book and give no row.  Every later
update gives a row when both sides have a price.  Order flow counts from the row before.

State is a map of the book's levels (only changed levels are written back), the waiting
frames, and one small value; it needs the RocksDB state store.  What a trigger holds of one
instrument is bounded by the source's limits for a trigger.

Defined results: frames that are neither kind, or updates without ``U``, are dropped;
missing sides count as empty; a later snapshot replaces the book, empties the order
flow and starts a new bootstrap; a repeated update is applied again, as it sets its levels.
Rates are of event time.  Executions and trade sides are not in depth frames, so
``trade_intensity`` and ``buy_ratio`` are 0.
"""

from __future__ import annotations

import json
import math
import time
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from depthline.functions.fixed_point import number, to_price, to_qty
from depthline.schema import SCALE
from depthline.streaming.live import SECOND

#: The model's inputs, in its order (fixed values).
INPUTS = ("midprice", "spread", "microprice", "ofi", "queue_imbalance", "arrival_rate", "cancel_rate", "bid_slope", "ask_slope", "volatility", "trade_intensity", "buy_ratio")

_LEVEL = "array<struct<px:bigint,qty:bigint,up:boolean>>"
_ROW = "instrument string, pos bigint, ts_us bigint, best_bid bigint, best_bid_qty bigint, best_ask bigint, best_ask_qty bigint, " + ", ".join(f"{c} double" for c in INPUTS) + ", prob double, position int, events bigint, rows bigint, correct bigint, wrong bigint, pnl bigint"
_MIDS = 10
_SLOPE_LEVELS = 5


def _level(pair: Column) -> Column:
    """A level of a text pair; ``up`` tells quantities over 0 before they are cut to whole ones."""
    qty = number(F.get(pair, F.lit(1)))
    return F.struct(to_price(number(F.get(pair, F.lit(0))), "live").alias("px"), to_qty(qty, "live").alias("qty"), (qty > 0).alias("up"))


def _levels(*sides: str) -> Column:
    pairs = F.coalesce(*[F.col(f"_f.{c}") for c in sides], F.array().cast("array<array<string>>"))
    return F.transform(F.filter(pairs, lambda p: F.coalesce(F.size(p) >= 2, F.lit(False))), _level)


def frames(lines: DataFrame, line: str = "line") -> DataFrame:
    """``instrument, pos, ts_us, first, last, bids, asks`` of JSON lines; ``first`` is null for a snapshot."""
    text = "array<array<string>>"
    # Field names are looked up without case, so U is read apart from u.
    rest = F.from_json(F.col(line), f"E bigint, u bigint, b {text}, a {text}, lastUpdateId bigint, bids {text}, asks {text}")
    read = lines.select("instrument", "pos", F.from_json(F.col(line), "U bigint")["U"].alias("_first"), rest.alias("_f"))
    kept = read.where("(_first IS NOT NULL AND _f.u IS NOT NULL) OR _f.lastUpdateId IS NOT NULL")
    first = F.when(F.col("_f.lastUpdateId").isNull(), F.col("_first"))
    return kept.select("instrument", "pos", (F.coalesce(F.col("_f.E"), F.lit(0)) * 1000).alias("ts_us"), first.alias("first"), F.coalesce("_f.lastUpdateId", "_f.u").alias("last"), _levels("b", "bids").alias("bids"), _levels("a", "asks").alias("asks"))


def slope(quantities: list[int]) -> float:
    """Least-squares slope of the log quantities by level; 0 for fewer than three levels."""
    n = len(quantities)
    if n < 3:
        return 0.0
    x = np.arange(n) - (n - 1) / 2
    return float(x @ np.log(np.maximum(quantities, 1)) / (x @ x))


class Side:
    """One side's levels, with its prices in order (bids negated, so the best is always first)."""

    def __init__(self, sign: int):
        self.sign, self.at, self.order, self.touched = sign, {}, [], set()

    def put(self, px: int, qty: int) -> int:
        """Set a level (none at 0); by how much it grew."""
        before = self.at.get(px, 0)
        key = self.sign * px
        if qty > 0 and px not in self.at:
            insort(self.order, key)
        if qty > 0:
            self.at[px] = qty
        elif px in self.at:
            del self.at[px]
            del self.order[bisect_left(self.order, key)]
        self.touched.add(px)
        return max(qty - before, 0)

    def clear(self) -> None:
        self.touched.update(self.at)
        self.at, self.order = {}, []

    def top(self, n: int) -> list[tuple[int, int]]:
        return [(self.sign * k, self.at[self.sign * k]) for k in self.order[:n]]


class Desk:
    """What an instrument's frames do, one after another, between two reads of the state."""

    def __init__(self, levels: Iterator, kept: dict, sync_events: int, lag: int, threshold: float):
        self.sides, self.waiting, self.rows = (Side(-1), Side(1)), [], []
        for (side, px), (qty,) in levels:
            self.sides[side].put(px, qty)
        for side in self.sides:
            side.touched.clear()
        self.k = {"last": None, "synced": 0, "live": False, "until": None, "ofi": 0, "mids": [], "times": [], "events": 0, "rows": 0, "open": [], "correct": 0, "wrong": 0, **kept}
        self.sync_events, self.lag, self.threshold = sync_events, lag, threshold

    def take(self, frame) -> None:
        if frame.first is None:
            self._start(frame)
        elif self.k["last"] is None:
            self.waiting.append(frame)
        elif self.k["live"]:
            self._event(frame)
        else:
            self._bootstrap(frame)

    def _start(self, frame) -> None:
        for side, levels in zip(self.sides, (frame.bids, frame.asks)):
            side.clear()
            for level in levels:
                if level["qty"] > 0:
                    side.put(level["px"], level["qty"])
        self.k.update(last=int(frame.last), synced=0, live=self.sync_events == 0, ofi=0)
        self._remember(self._mid())
        waiting, self.waiting = self.waiting, []
        for held in waiting:
            self.take(held)

    def _bootstrap(self, frame) -> None:
        last = self.k["last"]
        if frame.first > last or frame.last > last >= frame.first - 1:
            self._apply(frame)
        self.k["synced"] += 1
        self.k["live"] = self.k["synced"] >= self.sync_events

    def _apply(self, frame) -> None:
        for side, levels, sign in zip(self.sides, (frame.bids, frame.asks), (1, -1)):
            for level in levels:
                self.k["ofi"] += sign * side.put(level["px"], level["qty"])

    def _mid(self) -> float | None:
        bid, ask = (side.top(1) for side in self.sides)
        two = bid and ask and bid[0][0] and ask[0][0]
        return (bid[0][0] + ask[0][0]) / (2 * SCALE) if two else None

    def _remember(self, mid: float | None) -> None:
        if mid is not None and mid > 0:
            self.k["mids"] = [*self.k["mids"], mid][-_MIDS:]

    def _event(self, frame) -> None:
        k = self.k
        k["events"] += 1
        up = sum(bool(level["up"]) for levels in (frame.bids, frame.asks) for level in levels)
        times = [*k["times"], (int(frame.ts_us), up, len(frame.bids) + len(frame.asks) - up)]
        fresh = next((i for i, t in enumerate(times) if t[0] >= frame.ts_us - SECOND), len(times))
        k["times"] = times = times[fresh:]
        self._apply(frame)
        mid = self._mid()
        self._remember(mid)
        if mid is None or mid <= 0:
            return
        k["rows"] += 1
        bids, asks = (side.top(_SLOPE_LEVELS) for side in self.sides)
        (bid, bid_qty), (ask, ask_qty) = bids[0], asks[0]
        both = bid_qty + ask_qty
        returns = np.diff(np.log(k["mids"]))
        self.rows.append({
            "pos": int(frame.pos), "ts_us": int(frame.ts_us), "best_bid": bid, "best_bid_qty": bid_qty, "best_ask": ask, "best_ask_qty": ask_qty,
            "midprice": mid, "spread": (ask - bid) / SCALE, "microprice": (bid_qty * ask + ask_qty * bid) / SCALE / both, "ofi": float(k["ofi"]), "queue_imbalance": bid_qty / both,
            "arrival_rate": float(sum(t[1] for t in times)), "cancel_rate": float(sum(t[2] for t in times)),
            "bid_slope": slope([q for _, q in bids]), "ask_slope": slope([q for _, q in asks]),
            "volatility": float(np.std(returns, ddof=1)) if len(returns) >= 2 else 0.0, "trade_intensity": 0.0, "buy_ratio": 0.0,
            "events": k["events"], "rows": k["rows"],
        })
        k["ofi"] = 0

    def scored(self, predict: Callable[[pd.DataFrame], np.ndarray] | None) -> pd.DataFrame:
        """The rows so far with probability, position and the score of the prediction ``lag`` rows ago."""
        out, k = pd.DataFrame(self.rows), self.k
        prob = np.asarray(predict(out[list(INPUTS)]) if predict else np.full(len(out), 0.5), float)
        mids = np.concatenate(([m for _, m in k["open"]], out["midprice"]))
        probs = np.concatenate(([p for p, _ in k["open"]], prob))
        due = max(len(probs) - self.lag, 0)
        right = (probs[:due] > self.threshold) == (mids[self.lag :] > mids[:due])
        seen = np.concatenate((np.zeros(len(out) - due, int), np.ones(due, int)))
        hits = np.concatenate((np.zeros(len(out) - due, int), right.astype(int)))
        correct, wrong = k["correct"] + np.cumsum(hits), k["wrong"] + np.cumsum(seen - hits)
        k.update(open=list(zip(probs[due:].tolist(), mids[due:].tolist())), correct=int(correct[-1]), wrong=int(wrong[-1]))
        return out.assign(prob=prob, position=np.where(prob > self.threshold, 1, np.where(prob < 1 - self.threshold, -1, 0)), correct=correct, wrong=wrong, pnl=correct - wrong)


class _Strategy(StatefulProcessor):
    def __init__(self, predict, sync_events: int, quiet_ms: int | None, lag: int, threshold: float):
        self.predict, self.quiet_ms, self.settings = predict, quiet_ms, (sync_events, lag, threshold)

    def init(self, handle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "side int, px bigint", "qty bigint")
        self.waiting = handle.getListState("waiting", f"pos bigint, ts_us bigint, first bigint, last bigint, bids {_LEVEL}, asks {_LEVEL}")
        self.kept = handle.getValueState("kept", "json string")

    def handleInputRows(self, key, rows, timerValues):
        desk = Desk(self.levels.iterator(), json.loads(self.kept.get()[0]) if self.kept.exists() else {}, *self.settings)
        if desk.k["last"] is not None and desk.k["until"] is not None and time.time() * 1000 >= desk.k["until"]:
            desk.k["live"] = True
        waited = self.waiting.exists()
        if waited:
            desk.waiting = list(_frames(pd.DataFrame(list(self.waiting.get()), columns=["pos", "ts_us", "first", "last", "bids", "asks"])))
        for frame in _frames(pd.concat(list(rows)).sort_values("pos", kind="stable")):
            desk.take(frame)
        if desk.rows:
            yield desk.scored(self.predict).assign(instrument=key[0])[[c.split()[0] for c in _ROW.split(", ")]]
        for n, side in enumerate(desk.sides):
            for px in side.touched:
                if px in side.at:
                    self.levels.updateValue((n, px), (side.at[px],))
                else:
                    self.levels.removeKey((n, px))
        if desk.waiting:
            self.waiting.put([(f.pos, f.ts_us, f.first, f.last, f.bids, f.asks) for f in desk.waiting])
        elif waited:
            self.waiting.clear()
        if self.quiet_ms is not None:
            desk.k["until"] = time.time() * 1000 + self.quiet_ms
        self.kept.update((json.dumps(desk.k),))

    def close(self) -> None:
        pass


class _Frame:
    __slots__ = ("pos", "ts_us", "first", "last", "bids", "asks")


def _plain(levels) -> list[dict]:
    return [{"px": int(v["px"]), "qty": int(v["qty"]), "up": bool(v["up"])} for v in levels]


def _frames(rows: pd.DataFrame) -> Iterator[_Frame]:
    for pos, ts, first, last, bids, asks in zip(rows["pos"], rows["ts_us"], rows["first"], rows["last"], rows["bids"], rows["asks"]):
        out = _Frame()
        out.pos, out.ts_us, out.last, out.bids, out.asks = int(pos), int(ts), int(last), _plain(bids), _plain(asks)
        out.first = None if first is None or math.isnan(first) else int(first)
        yield out


def live_strategy(stream: DataFrame, predict: Callable[[pd.DataFrame], np.ndarray] | None = None, sync_events: int = 20, quiet_ms: int | None = 3000, lag: int = 5, threshold: float = 0.55) -> DataFrame:
    """A row per live update of ``frames``: book, inputs, ``prob``, ``position`` and running score.

    ``predict`` takes the twelve inputs as a frame.  The session's state store has to be RocksDB's.
    """
    run = _Strategy(predict, sync_events, quiet_ms, lag, threshold)
    return stream.groupBy("instrument").transformWithStateInPandas(run, _ROW, "append", "none")


def dashboard(rows: DataFrame, every: int = 10) -> DataFrame:
    """What a dashboard shows at every ``every``-th update of an instrument; any sink takes it."""
    seen = F.col("correct") + F.col("wrong")
    signal = F.when(F.col("prob") > 0.55, "BULLISH").when(F.col("prob") < 0.45, "BEARISH").otherwise("NEUTRAL")
    position = F.when(F.col("position") == 1, "LONG").when(F.col("position") == -1, "SHORT").otherwise("FLAT")
    accuracy = F.when(seen > 0, F.col("correct") / seen).otherwise(0.0)
    price = {c: F.col(c) / float(SCALE) for c in ("best_bid", "best_ask")}
    kept = rows.where((F.col("events") % every) == 0)
    return kept.select("instrument", "pos", *[v.alias(c) for c, v in price.items()], "best_bid_qty", "best_ask_qty", "midprice", "spread", "prob", signal.alias("signal"), position.alias("position"), "pnl", accuracy.alias("accuracy"), "correct", "wrong", "events", "rows", "bid_slope", "ask_slope", "volatility", "ofi")
