"""Twelve features per message: projections, windows by level, and running values in pieces of an instrument."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthline.operators.book import BUCKET, book_states, l2_levels, l3_remaining, order_pieces, piece_of, resolve_replacements  # noqa: F401
from depthline.operators.compat import change_levels, level_changes
from depthline.operators.carry import expired, let, numbered, running
from depthline.scratch import freed, stored

SECOND = 1_000_000
_TWO = "best_bid <> 0 AND best_ask <> 0"


def price_features(df: DataFrame) -> DataFrame:
    """Adds mid, spread, microprice, imbalance (null while a side is empty)."""
    b, a = F.col("best_bid") / 10000.0, F.col("best_ask") / 10000.0
    bq, aq = F.col("best_bid_qty").cast("double"), F.col("best_ask_qty").cast("double")
    two = F.expr(_TWO)
    mid = (b + a) / 2.0
    return df.withColumns({
        "midprice": F.when(two, mid),
        "spread": F.when(two, a - b),
        "microprice": F.when(two, F.when(bq + aq > 0, (b * aq + a * bq) / (bq + aq)).otherwise(mid)),
        "queue_imbalance": F.when(two, F.coalesce(F.try_divide(bq - aq, bq + aq), F.lit(float("nan")))),
    })


HELD = ("midprice", "spread", "microprice", "queue_imbalance")
_SLOPES = ("bid_slope", "ask_slope")


def held(df: DataFrame, *columns: str) -> DataFrame:
    """Keeps the last known value while a side is empty; 0 before the first."""
    kept = running(df, lasts={f"_held_{c}": F.col(c) for c in columns})
    return kept.withColumns({c: F.coalesce(f"_held_{c}", F.lit(0.0)) for c in columns}).drop(*[f"_held_{c}" for c in columns])


def _tail_statistics(mids: int):
    """From the last mids before a bucket: the last one, and for k = 0, 1, ... the number, mean and squared deviation of the last k returns."""

    def fold(so_far: Column, r: Column) -> Column:
        n, d = so_far["n"] + 1, r - so_far["mean"]
        return F.struct(n.alias("n"), (so_far["mean"] + d / n).alias("mean"), (so_far["m2"] + d * d * (so_far["n"] / n)).alias("m2"))

    def made(values: Column) -> Column:
        none = F.struct(F.lit(0).cast("double").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
        last = F.sequence(F.greatest(F.size(values) - 1, F.lit(1)), F.lit(1), F.lit(-1))
        returns = F.filter(F.transform(last, lambda i: F.ln(F.get(values, i) / F.get(values, i - 1))), lambda r: r.isNotNull())
        return F.struct(F.try_element_at(values, F.lit(-1)).alias("mid"), let(returns, lambda r: F.transform(F.sequence(F.lit(0), F.lit(mids - 1)), lambda k: F.aggregate(F.slice(r, F.lit(1), k), none, fold))).alias("k"))

    return made


def _deviation(rows: DataFrame, mids: int) -> DataFrame:
    """Adds ``volatility`` to rows with ``_bucket``, ``_tail`` and two-sided ``midprice`` (null otherwise) from windows inside the bucket.

    Counts, means and squared deviations of the returns inside and before the bucket are put together.
    """
    two = F.expr(_TWO)
    inner = Window.partitionBy("instrument", "_bucket").orderBy("pos")
    mid = F.when(two, F.col("_mid"))
    before = F.coalesce(F.last(mid, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.col("_tail.mid"))
    rows = rows.withColumns({"_i": F.count(F.when(two, 1)).over(inner.rowsBetween(Window.unboundedPreceding, 0)), "_r": F.when(two, F.ln(F.col("_mid") / before))})
    w = Window.partitionBy("instrument", "_bucket").orderBy("_i").rangeBetween(-(mids - 2), 0)
    rows = rows.withColumns({"_rn": F.count("_r").over(w), "_rm": F.coalesce(F.avg("_r").over(w), F.lit(0.0)), "_rv": F.coalesce(F.var_pop("_r").over(w), F.lit(0.0)) * F.count("_r").over(w)})
    left = F.get(F.col("_tail.k"), F.greatest(F.lit(mids - 1) - F.col("_i"), F.lit(0)).cast("int"))
    n0 = F.coalesce(left["n"], F.lit(0))
    n = F.col("_rn") + n0
    apart = F.col("_rm") - F.coalesce(left["mean"], F.lit(0.0))
    m2 = F.col("_rv") + F.coalesce(left["m2"], F.lit(0.0)) + apart * apart * F.col("_rn") * n0 / F.greatest(n, F.lit(1))
    return rows.withColumn("volatility", F.when(n >= 2, F.sqrt(m2 / (n - 1))).otherwise(0.0)).drop("_i", "_r", "_rn", "_rm", "_rv")


def _tail(mids: int) -> dict:
    return {"_tail": (F.when(F.expr(_TWO), F.col("midprice")), mids, _tail_statistics(mids))}


def volatility(df: DataFrame, mids: int = 10) -> DataFrame:
    """Adds ``volatility``: sample deviation of the log returns of the last ``mids`` two-sided mids, held while a side is empty."""
    rows = running(df.withColumn("_mid", F.col("midprice")), tails=_tail(mids), keep_bucket=True)
    return _deviation(rows, mids).drop("_mid", "_tail", "_bucket")


def _recent(rows: DataFrame, counted: DataFrame, hits: dict[str, Column], window_us: int) -> DataFrame:
    """``counted`` (with running counts of ``hits`` over ``rows``) less what is older than ``window_us``.

    Rows that share a time but come later do not count, so this is a difference of two
    running counts rather than a range frame.
    """
    old = expired(rows, {f"_old_{n}": c for n, c in hits.items()}, window_us)
    return _less(counted, old, hits)


def _less(counted: DataFrame, old: DataFrame, hits: Mapping[str, Column]) -> DataFrame:
    """Running counts less those in ``old`` at a row's time."""
    both = counted.join(old, ["instrument", "ts_us"], "left")
    return both.withColumns({n: F.col(n) - F.coalesce(f"_old_{n}", F.lit(0)) for n in hits}).drop(*[f"_old_{n}" for n in hits])


def _ones(hits: dict[str, Column]) -> dict[str, Column]:
    return {n: F.when(c, 1).otherwise(0).cast("long") for n, c in hits.items()}


def _kinds() -> dict[str, Column]:
    """Events that are counted over the last second."""
    return {"arrival_rate": F.col("type") == "Add", "cancel_rate": F.col("type") == "Delete", "trade_intensity": F.col("type").isin("Trade", "Execute")}


def rates(messages: DataFrame, window_us: int = SECOND) -> DataFrame:
    """Adds ``arrival_rate, cancel_rate, trade_intensity``: events of the last second so far, ends included."""
    hits = _kinds()
    rows = _recent(messages, running(messages, sums=_ones(hits)), hits, window_us)
    return rows.withColumns({n: F.col(n).cast("double") for n in hits})


def ofi_deltas(messages: DataFrame) -> DataFrame:
    """Adds ``delta``: the signed growth of the message's own level (only growth counts)."""
    rows = running(messages.withColumn("_now", _left_at()), previous={"_was": F.col("_now")}, by=("instrument", "side", "px"))
    grown = F.greatest(F.col("_now") - F.coalesce("_was", F.lit(0)), F.lit(0))
    return rows.withColumn("delta", F.when(F.col("side") == "Buy", grown).otherwise(-grown)).drop("_now", "_was")


def _left_at() -> Column:
    """What a message leaves at its own level, taken by itself."""
    return F.when((F.col("type") == "Delete") | (F.col("qty") <= 0), 0).otherwise(F.col("qty"))


def _openings(messages: DataFrame) -> DataFrame:
    """``instrument, bucket, side, px, qty``: what the last message before a bucket left at each level that the bucket names."""
    level = ["instrument", "side", "px"]
    last = messages.groupBy(*level, piece_of().alias("bucket")).agg(F.max_by(_left_at(), "pos").alias("qty"))
    return last.withColumn("qty", F.lag("qty").over(Window.partitionBy(*level).orderBy("bucket"))).where("qty IS NOT NULL")


def ofi(messages: DataFrame) -> DataFrame:
    """Adds ``ofi``, the running total of ``delta``."""
    return running(ofi_deltas(messages), sums={"ofi": F.col("delta")}).drop("delta")


def ofi_interval(messages: DataFrame, every: int) -> DataFrame:
    """``instrument, bucket, ofi`` summed over captures of ``every`` messages."""
    rows = numbered(ofi_deltas(messages)).withColumn("bucket", F.floor((F.col("_n") - 1) / every).cast("bigint"))
    return rows.groupBy("instrument", "bucket").agg(F.sum("delta").alias("ofi"))


def _trades(columns: list[str], mid: str = "midprice") -> dict[str, Column]:
    """Trades and bought trades: by the side of the resting order, or at or over the mid of a two-sided book."""
    trade = F.col("type").isin("Trade", "Execute")
    by_price = F.coalesce(F.expr(_TWO) & (F.col("px") / 10000.0 >= F.col(mid)), F.lit(False))
    bought = F.when(F.col("order_id") != 0, F.coalesce(F.col("resting_side") == "Sell", F.lit(False))).otherwise(by_price) if "resting_side" in columns else by_price
    return {"_trades": trade, "_buys": trade & bought}


def _held_ratio(rows: DataFrame, trades: Column) -> DataFrame:
    """Adds ``buy_ratio`` from recent ``trades`` and ``_buys``, held while there are none."""
    kept = running(rows, lasts={"buy_ratio": F.when(trades > 0, F.col("_buys") / trades)})
    return kept.withColumn("buy_ratio", F.coalesce("buy_ratio", F.lit(0.0)))


def buy_ratio(df: DataFrame, window_us: int = SECOND) -> DataFrame:
    """Adds ``buy_ratio``; needs the mid, both best prices and, for orders, ``resting_side``."""
    hits = _trades(df.columns)
    rows = _recent(df, running(df, sums=_ones(hits)), hits, window_us)
    return _held_ratio(rows, F.col("_trades")).drop(*hits)


def _states(messages: DataFrame, levels: DataFrame | None, depth: int, **more: DataFrame | None) -> DataFrame:
    """Book states with price features, null while a side is empty.

    They are read more than once (by the rows and by the buckets' sums), so they are written.
    """
    rows = price_features(book_states(messages, l2_levels(messages) if levels is None else levels, depth, **more))
    return stored(rows.withColumns({c: F.when(F.expr(_TWO), F.col(c)) for c in _SLOPES}), "book-states")


def priced(messages: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Messages with best prices and the four price features, held while a side is empty."""
    return held(_states(messages, levels, 1), *HELD).drop("bid_levels", "ask_levels", *_SLOPES)


def _held_rows(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Held prices, slopes and volatility, and running ``sums``, of book states in one pass."""
    kept = HELD + _SLOPES
    out = running(rows.withColumn("_mid", F.col("midprice")), sums=sums, lasts={f"_held_{c}": F.col(c) for c in kept}, tails=_tail(10), keep_bucket=True)
    out = _deviation(out, 10)
    return out.withColumns({c: F.coalesce(f"_held_{c}", F.lit(0.0)) for c in kept}).drop("bid_levels", "ask_levels", "_mid", "_tail", "_bucket", *[f"_held_{c}" for c in kept])


def book_features(messages: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Messages with best prices, price features, slopes and volatility, held while a side is empty."""
    return _held_rows(_states(messages, levels, 5), {})


# ---- all features in two passes over buckets --------------------------------
#
# The first pass builds the book inside a bucket and counts events; the second has what every bucket inherits from those
# before it and computes the features.  Between them only sums, one row a bucket, and messages whose last second cannot be
# counted inside their bucket are looked at.

#: Bits of a message: arrival, cancel, trade, bought trade; whether its last second reaches out of its bucket (``OPEN``), and
#: whether it asks, for all open ones of its time and bucket, what is older (``ASK``).
_HITS = ("arrivals", "cancels", "trades", "buys")
_OPEN, _ASK = 1 << len(_HITS), 2 << len(_HITS)
_MIDS = 10
_BEST = ("best_bid", "best_bid_qty", "best_ask", "best_ask_qty")
_NEVER = (1 << 63) - 1


def _hit(name: str) -> Column:
    return F.getbit("_bits", F.lit(_HITS.index(name))).cast("long")


def _edges(messages: DataFrame) -> DataFrame:
    """``instrument, bucket, floor, ceil``: the latest time before a bucket and the earliest behind it; a message without a time never grows old."""
    times = messages.groupBy("instrument", piece_of().alias("_bucket")).agg(F.max(F.coalesce("ts_us", F.lit(_NEVER))).alias("_max"), F.min("ts_us").alias("_min"))
    by = Window.partitionBy("instrument").orderBy("_bucket")
    floor, ceil = F.max("_max").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.min("_min").over(by.rowsBetween(1, Window.unboundedFollowing))
    return times.select("instrument", F.col("_bucket").alias("bucket"), F.coalesce(floor, F.lit(-_NEVER)).alias("floor"), F.coalesce(ceil, F.lit(_NEVER)).alias("ceil"))


def _older(times: np.ndarray, timed: np.ndarray, hits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By row of ``at``, the ``hits`` (rows by kinds) of this bucket with a time up to it."""
    order = np.flatnonzero(timed)[np.argsort(times[timed], kind="stable")]
    sums = np.concatenate([np.zeros((1, hits.shape[1]), np.int64), hits[order].cumsum(axis=0)])
    return sums[np.searchsorted(times[order], at, "right")]


def _times(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    timed = rows["ts_us"].notna().to_numpy()
    return rows["ts_us"].fillna(0).to_numpy(np.int64), timed


def _bits_of(rows: pd.DataFrame) -> np.ndarray:
    return (rows["_bits"].to_numpy(np.int64)[:, None] >> np.arange(len(_HITS))) & 1


def _prices(best: np.ndarray) -> tuple[np.ndarray, ...]:
    """Whether both sides stand, and mid, spread, microprice and imbalance, from rows of the four best values, as in ``price_features``."""
    two = (best[:, 0] != 0) & (best[:, 2] != 0)
    b, a, bq, aq = best[:, 0] / 10000.0, best[:, 2] / 10000.0, best[:, 1].astype(float), best[:, 3].astype(float)
    mid = (b + a) / 2.0
    with np.errstate(invalid="ignore", divide="ignore"):
        micro = np.where(bq + aq > 0, (b * aq + a * bq) / (bq + aq), mid)
        imbalance = np.where(bq + aq != 0, (bq - aq) / (bq + aq), np.nan)
    return two, mid, a - b, micro, imbalance


_FIRST = "_bits int, _trades bigint, _buys bigint, _end bigint, _ratio double, _mids array<double>"


def _first_pass(window_us: int) -> Callable:
    def run(at: pd.DataFrame, floor: int, ceil: int) -> pd.DataFrame:
        """A bucket's events, what its open messages have counted so far, its last buy ratio that is known here (and where), and its last mids."""
        two, mid, *_ = _prices(at[list(_BEST)].to_numpy(np.int64))
        kind = at["type"]
        trade = kind.isin(["Trade", "Execute"]).to_numpy()
        bought = two & (at["px"].to_numpy(float, na_value=np.nan) / 10000.0 >= mid)
        if "resting_side" in at:
            bought = np.where(at["order_id"].fillna(0).to_numpy() != 0, (at["resting_side"] == "Sell").to_numpy(bool), bought)
        hits = np.stack([(kind == "Add").to_numpy(bool), (kind == "Delete").to_numpy(bool), trade, trade & bought], 1).astype(np.int64)
        times, timed = _times(at)
        due = times - window_us - 1
        known = timed & (due >= floor) & (due < ceil)
        ran = hits.cumsum(axis=0)
        recent = ran - _older(times, timed, hits, due)
        asks = ~known & timed
        asks[asks] = ~pd.Series(times[asks]).duplicated(keep="last").to_numpy()
        out = at.assign(_bits=((hits << np.arange(len(_HITS))).sum(axis=1) + _OPEN * ~known + _ASK * asks).astype(np.int32))
        for c, k in (("_trades", 2), ("_buys", 3)):
            out[c] = pd.Series(ran[:, k], at.index, "Int64").where(~known)
        ends = np.flatnonzero(known & (recent[:, 2] > 0))
        last = at.index == at.index[-1]
        out["_end"] = pd.Series(at["pos"].iloc[ends[-1]] if len(ends) else 0, at.index, "Int64").where(last & bool(len(ends)))
        out["_ratio"] = np.where(last, recent[ends[-1], 3] / recent[ends[-1], 2], np.nan) if len(ends) else np.nan
        mids = np.full(len(at), None, object)
        if two.any():
            mids[-1] = mid[two][-_MIDS:].tolist()
        return out.assign(_mids=mids)

    return run


def _volatility(mids: np.ndarray) -> np.ndarray:
    """The sample deviation of the last returns at each mid."""
    step = np.full(len(mids) + _MIDS - 2, np.nan)
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = mids[1:] / mids[:-1]
        step[_MIDS - 1 :] = np.where(ratio > 0, np.log(np.where(ratio > 0, ratio, 1.0)), np.nan)
    w = np.lib.stride_tricks.sliding_window_view(step, _MIDS - 1)
    there = ~np.isnan(w)
    n = there.sum(axis=1)
    mean = np.where(there, w, 0.0).sum(axis=1) / np.maximum(n, 1)
    m2 = (np.where(there, w - mean[:, None], 0.0) ** 2).sum(axis=1)
    return np.where(n >= 2, np.sqrt(m2 / np.maximum(n - 1, 1)), 0.0)


def _second_pass(window_us: int, sampled: bool) -> Callable:
    def run(at: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """A bucket's features from its states, what it inherits, and what is older than the last second of its open messages."""
        at = at.drop(columns="bucket").sort_values("pos", ignore_index=True)
        right = right.rename(columns=lambda c: c.removeprefix("_"))
        base = right[right["what"] == 0].iloc[0] if len(at) else None
        out = at.drop(columns=["delta", "_bits", *_SLOPES])
        if base is None:
            return out.reindex(columns=[*out.columns, *_NAMES])
        hits, (times, timed) = _bits_of(at), _times(at)
        ran = hits.cumsum(axis=0)
        recent = ran - _older(times, timed, hits, times - window_us - 1)
        opened = (at["_bits"].to_numpy(np.int64) & _OPEN) != 0
        if opened.any():
            old = right[right["what"] == 1].drop_duplicates("ts").set_index("ts")[list(_HITS)]
            older = old.reindex(times[opened]).fillna(0).to_numpy(np.int64)
            older[~timed[opened]] = 0
            recent[opened] = ran[opened] + base[list(_HITS)].to_numpy(np.int64) - older
        best = at[list(_BEST)].to_numpy(np.int64)
        two, *prices = _prices(best)
        # The last two-sided row, or what the bucket inherits.
        since = np.maximum.accumulate(np.where(two, np.arange(len(at)), -1))
        first = base["last"]
        inherited = [0.0] * 6 if first is None else [*(float(x[0]) for x in _prices(np.array([[first[c] for c in _BEST]], np.int64))[1:]), first["bid_slope"], first["ask_slope"]]
        for c, own, before in zip(HELD + _SLOPES, [*prices, *(at[s].to_numpy() for s in _SLOPES)], inherited):
            out[c] = np.where(since >= 0, own[since], before)
        mids = np.concatenate([np.array([] if base["tail"] is None else base["tail"], float), prices[0][two]])
        place = len(mids) - two.sum() + two.cumsum() - 1
        out["volatility"] = np.where(place >= 0, _volatility(mids)[place], 0.0) if len(mids) else 0.0
        out["ofi"] = int(base["ofi"]) + at["delta"].to_numpy(np.int64).cumsum()
        for k, c in enumerate(("arrival_rate", "cancel_rate", "trade_intensity")):
            out[c] = recent[:, k].astype(float)
        ratio = pd.Series(np.where(recent[:, 2] > 0, recent[:, 3] / np.maximum(recent[:, 2], 1), np.nan)).ffill()
        out["buy_ratio"] = ratio.fillna(0.0 if pd.isna(base["ratio"]) else float(base["ratio"]))
        return out[out["pos"].isin(right.loc[right["what"] == 2, "ts"])] if sampled else out

    return run


_SECOND = ", ".join([*(f"{c} double" for c in HELD + _SLOPES), "volatility double, ofi bigint, arrival_rate double, cancel_rate double, trade_intensity double, buy_ratio double"])
_NAMES = [c.split()[0] for c in _SECOND.split(", ")]


def all_features(messages: DataFrame, levels: DataFrame | None = None, sides: DataFrame | None = None, pieces: DataFrame | None = None, keep: tuple[str, ...] | None = None, sample: DataFrame | None = None) -> DataFrame:
    """All twelve features per message; ``sides`` are the resting sides of an order feed, ``pieces`` its levels and sides by bucket.

    ``keep`` are the columns of ``messages`` that come along (all, if not given), ``sample`` the rows wanted (``instrument, pos``; all, if not given).
    """
    keep = ("instrument", "pos", "ts_us", *[c for c in (messages.columns if keep is None else keep) if c not in ("instrument", "pos", "ts_us")])
    needed = [c for c in ("type", "px", "qty", "side", "order_id") if c in messages.columns and c not in keep]
    dropped = (*needed, "bid_levels", "ask_levels", *["resting_side"] * (sides is not None or pieces is not None))
    levels = l2_levels(messages) if levels is None and pieces is None else levels
    states = book_states(messages.select(*keep, *needed), levels, 5, sides, _openings(messages), pieces, _edges(messages), (_first_pass(SECOND), _FIRST, dropped))
    # Read by the sums and by the rows.
    states = stored(states.withColumn("bucket", piece_of()), "book-states")
    old = stored(expired(states, {n: _hit(n) == 1 for n in _HITS}, SECOND, states.where(F.col("_bits").bitwiseAND(_ASK) != 0).select("instrument", "bucket", "ts_us")), "expired")
    prefix = _inherited(states, old)
    right = {"_what": F.lit(0), "_ts": F.lit(None).cast("bigint"), **{f"_{n}": F.lit(0).cast("bigint") for n in (*_HITS, "ofi")}, "_ratio": F.lit(None).cast("double"), "_last": F.lit(None).cast(dict(prefix.dtypes)["last"]), "_tail": F.lit(None).cast("array<double>")}
    rows = lambda df, **given: df.select(F.col("instrument").alias("_i"), F.col("bucket").alias("_b"), *[(given[c[1:]] if c[1:] in given else none).alias(c) for c, none in right.items()])
    more = rows(prefix, **{c: F.col(c) for c in (*_HITS, "ofi", "ratio", "last", "tail")}).unionByName(rows(old, what=F.lit(1), ts=F.col("ts_us"), **{n: F.col(n) for n in _HITS}))
    if sample is not None:
        more = more.unionByName(rows(sample.withColumn("bucket", piece_of()), what=F.lit(2), ts=F.col("pos")))
    types = {f.name: f.dataType.simpleString() for f in states.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in (*keep, *_BEST)), _SECOND])
    wide = states.select(*keep, *_BEST, *_SLOPES, "delta", "_bits", "bucket")
    made = wide.groupBy("instrument", "bucket").cogroup(more.groupBy("_i", "_b")).applyInPandas(_second_pass(SECOND, sample is not None), schema)
    # What is no number comes back from Python as null.
    return made.withColumn("queue_imbalance", F.coalesce("queue_imbalance", F.lit(float("nan"))))


def _inherited(states: DataFrame, old: DataFrame) -> DataFrame:
    """``instrument, bucket`` and what all buckets before hold: counts and ``ofi``, the last two-sided best prices, the last mids (oldest first), the last buy ratio."""
    by = Window.partitionBy("instrument").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = states.groupBy("instrument", F.col("bucket").alias("_bucket")).agg(*[F.sum(_hit(n)).alias(n) for n in _HITS], F.sum("delta").alias("ofi"), F.max_by(F.struct(*_BEST, *_SLOPES), F.when(F.expr(_TWO), F.col("pos"))).alias("last"), F.first("_mids", ignorenulls=True).alias("_mids"), F.max_by("_ratio", "_end").alias("_ratio"), F.max("_end").alias("_end"))
    carried = [F.coalesce(F.sum(n).over(by), F.lit(0)).alias(n) for n in (*_HITS, "ofi")]
    counts = sums.select("instrument", "_bucket", *carried, F.last("last", ignorenulls=True).over(by).alias("last"), "_mids", "_ratio", "_end", F.coalesce(F.sum(F.col("_mids").isNotNull().cast("int")).over(by), F.lit(0)).alias("_n__tail"))
    # Buckets without a mid do not count, so the last ones that have any are enough.
    earlier = Window.partitionBy("instrument").orderBy("_n__tail").rangeBetween(-_MIDS, -1)
    counts = counts.withColumn("tail", F.reverse(F.slice(F.reverse(F.flatten(F.collect_list("_mids").over(earlier))), 1, _MIDS)))
    # Where open messages end a bucket, its last ratio follows from what is older than theirs.
    opened = states.where("_trades IS NOT NULL").select("instrument", F.col("bucket").alias("_bucket"), "pos", "ts_us", "_trades", "_buys")
    older = old.select("instrument", F.col("bucket").alias("_bucket"), "ts_us", F.col("trades").alias("_old"), F.col("buys").alias("_old_buys"))
    start = counts.select("instrument", "_bucket", F.col("trades").alias("_base"), F.col("buys").alias("_base_buys"))
    left = lambda n, old, base: F.col(n) + F.col(base) - F.coalesce(old, F.lit(0))
    resolved = opened.join(older, ["instrument", "_bucket", "ts_us"], "left").join(start, ["instrument", "_bucket"]).select("instrument", "_bucket", "pos", left("_trades", "_old", "_base").alias("_n"), left("_buys", "_old_buys", "_base_buys").alias("_b")).where("_n > 0")
    late = resolved.groupBy("instrument", "_bucket").agg(F.max("pos").alias("_late"), F.max_by(F.col("_b") / F.col("_n"), "pos").alias("_late_ratio"))
    ends = counts.join(late, ["instrument", "_bucket"], "left")
    ratio = F.when(F.col("_late") > F.coalesce("_end", F.lit(-_NEVER)), F.col("_late_ratio")).otherwise(F.col("_ratio"))
    return ends.withColumn("ratio", F.last(ratio, ignorenulls=True).over(by)).select("instrument", F.col("_bucket").alias("bucket"), *_HITS, "ofi", "last", "tail", "ratio")


def order_features(messages: DataFrame, semantics: str = "clean", keep: tuple[str, ...] | None = None, sample: DataFrame | None = None) -> DataFrame:
    """All twelve features per order message: the book is that of the orders, and a trade's side that of the order it meets.

    With ``semantics="compat"`` the book has the published engine's quirks.  Messages are read several
    times; a decoded feed should be ``stored`` first, and is not read by the result.
    """
    if semantics == "compat":
        changes = stored(level_changes(messages), "level-changes")
        levels, sides = change_levels(messages, changes), changes.where("part = 0 AND resting_side IS NOT NULL").select("instrument", "pos", "resting_side")
        rows = all_features(messages, levels, sides, keep=keep, sample=sample)
    else:
        changes = stored(l3_remaining(resolve_replacements(messages)), "remaining")
        rows = all_features(messages, pieces=order_pieces(messages, changes), keep=keep, sample=sample)
    freed(changes)
    return rows


def live_features(messages: DataFrame) -> DataFrame:
    """The live variant: nulls while a side is empty, imbalance in [0, 1], slopes from three levels on."""
    rows = book_states(messages.select("instrument", "pos"), l2_levels(messages, clear_on_snapshot=True), 5)
    bq, aq = F.col("best_bid_qty").cast("double"), F.col("best_ask_qty").cast("double")
    slope = lambda side: F.when(F.col(f"{side}_levels") >= 3, F.col(f"{side}_slope")).otherwise(F.lit(0.0))
    p = price_features(rows).withColumns({"queue_imbalance": F.coalesce(F.try_divide(bq, bq + aq), F.lit(0.5)), "bid_slope": slope("bid"), "ask_slope": slope("ask")})
    return p.drop("bid_levels", "ask_levels")
