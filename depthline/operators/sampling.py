"""Irregular sampling, snapshots, labels and queue simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthline.operators.carry import numbered
from depthline.operators.features import all_features, order_features
from depthline.schema import SNAPSHOT
from depthline.scratch import freed, stored

#: A cent in units of the fixed-point price.
TICK = 100


#: Rows of a block of the sampler, and how many count limits it holds at least.
BLOCK, LIMITS = 16_384, 16


def first_at_least(values: np.ndarray, due: np.ndarray, count: int) -> np.ndarray:
    """By row, the first later one whose value is at least ``due``: at most ``count`` rows on, and ``len(values)`` at most.

    Stretches of 2 ** k rows that lie wholly under it are skipped by their largest value.
    """
    n = len(values)
    tables = [values]
    while 2 ** len(tables) <= min(n, count):
        half = 2 ** (len(tables) - 1)
        tables.append(np.maximum(tables[-1][:-half], tables[-1][half:]))
    at = np.arange(1, n + 1)
    for k in range(len(tables) - 1, -1, -1):
        table = tables[k]
        # Stretches of one size may follow one another only at the top, where they reach the limit.
        for _ in range(2 if k == len(tables) - 1 else 1):
            fits = at < len(table)
            early = np.zeros(n, bool)
            early[fits] = table[at[fits]] < due[fits]
            at = at + (early << k)
    return np.minimum(np.minimum(at, np.arange(n) + count), n)


def successors(ts: np.ndarray, time_us: int, count: int) -> np.ndarray:
    """Where the sampler emits next after an emission at each row; ``len(ts)`` where not among these rows.

    The earlier of the ``count``-th row and the first later one at least ``time_us`` on; times need not rise.
    """
    return first_at_least(ts, ts + time_us, count)


def _last_inside(after: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The last emission in rows ``lo`` to ``hi`` of the chain that begins at each of them, by doubling."""
    jump = np.where(after[lo:hi] < hi, after[lo:hi] - lo, np.arange(hi - lo))
    while True:
        twice = jump[jump]
        if (twice == jump).all():
            return jump + lo
        jump = twice


def sample_positions(messages: DataFrame, time_us: int = 100_000, count: int = 1000) -> DataFrame:
    """``instrument, pos`` of emitted rows: the first, then when enough time or rows have passed since the last.

    Where an emission is followed by the next depends on that emission alone, so rows form chains.  An
    instrument is cut into blocks that no chain can jump over.  From a block and its neighbours follow all
    places where a chain may enter it and, for each, where it then enters the next block; chains that meet
    stay together, so these are few.  Only those pairs are followed through an instrument in order; the true
    chain's rows are then marked in each block by itself.
    """
    size = max(BLOCK, LIMITS * count)
    rows = numbered(messages.select("instrument", "pos", "ts_us")).withColumn("_n", F.col("_n") - 1).withColumn("block", F.expr(f"_n div {size}"))

    def enter(key, part: pd.DataFrame) -> pd.DataFrame:
        g = int(key[1])
        part = part.sort_values("_n")
        first, ts, block = int(part["_n"].iloc[0]), part["ts_us"].to_numpy(np.int64), part["block"].to_numpy()
        lo, hi = np.searchsorted(block, [g, g + 1])
        after = successors(ts, time_us, count)
        entries = np.zeros(1, np.int64) if g == 0 else np.unique(after[_last_inside(after, 0, lo)])
        entries = entries[(entries >= lo) & (entries < hi)]
        follow = after[_last_inside(after, lo, hi)[entries - lo]] if len(entries) else entries
        return pd.DataFrame({"instrument": key[0], "block": g, "entry": entries + first, "follow": np.where(follow < len(ts), follow + first, -1)})

    def chain(batches):
        name, now = None, 0
        for batch in batches:
            keep = []
            for instrument, block, entry, follow in batch.itertuples(index=False):
                if instrument != name:
                    name, now = instrument, 0
                if entry == now:
                    keep.append((instrument, block, entry))
                    now = follow
            yield pd.DataFrame(keep, columns=["instrument", "block", "entry"])

    def mark(part: pd.DataFrame, entered: pd.DataFrame) -> pd.DataFrame:
        keep = []
        if len(part) and len(entered):
            part = part.sort_values("_n")
            after = successors(part["ts_us"].to_numpy(np.int64), time_us, count).tolist()
            at = int(entered["_entry"].iloc[0]) - int(part["_n"].iloc[0])
            while at < len(after):
                keep.append(at)
                at = after[at]
        return part.iloc[keep][["instrument", "pos"]]

    near = rows.withColumn("_group", F.explode(F.array(*[F.col("block") + i for i in (-1, 0, 1)]))).where("_group >= 0")
    pairs = near.groupBy("instrument", "_group").applyInPandas(enter, "instrument string, block long, entry long, follow long")
    chained = pairs.repartition("instrument").sortWithinPartitions("instrument", "entry").mapInPandas(chain, "instrument string, block long, entry long")
    chained = chained.select(F.col("instrument").alias("_i"), F.col("block").alias("_b"), F.col("entry").alias("_entry"))
    return rows.groupBy("instrument", "block").cogroup(chained.groupBy("_i", "_b")).applyInPandas(mark, "instrument string, pos bigint")


def market_snapshots(messages: DataFrame, time_us: int = 100_000, count: int = 1000, predict=None, by_order: bool = False, semantics: str = "clean") -> DataFrame:
    """The 19-column snapshot table (and ``instrument, pos``).

    ``by_order`` takes the messages as an order feed, with clean or ``compat`` ``semantics``.  ``predict`` is a column over the rows or a
    fitted pipeline; without one ``prediction`` is NaN.
    """
    if by_order:
        messages = stored(messages, "messages")
    sample = stored(sample_positions(messages, time_us, count), "sample")
    # A predictor may read any column.
    keep = ("ts_us",) if predict is None else None
    rows = order_features(messages, semantics, keep, sample) if by_order else all_features(messages, keep=keep, sample=sample)
    freed(messages)
    rows = rows.withColumn("seq", F.col("ts_us"))
    if predict is None or isinstance(predict, Column):
        rows = rows.withColumn("prediction", F.lit(float("nan")) if predict is None else predict)
    else:
        from depthline.operators.models import score

        rows = score(predict, rows).withColumnRenamed("prob", "prediction")
    return rows.select("instrument", "pos", *SNAPSHOT)


def every_k(messages: DataFrame, k: int) -> DataFrame:
    """The first row of each instrument and every ``k``-th after it."""
    return numbered(messages).where((F.col("_n") - 1) % k == 0).drop("_n")


def add_labels(rows: DataFrame, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Adds ``next_return_h, label_h, microprice_change_h``; the label of the last rows is false."""
    w = Window.partitionBy("instrument").orderBy("ts_us", "pos")
    micro = F.col("microprice") if "microprice" in rows.columns else F.col("midprice")
    out = rows
    for h in horizons:
        ahead = F.lead("midprice", h).over(w)
        out = out.withColumns({f"next_return_{h}": (ahead - F.col("midprice")) / F.greatest("midprice", F.lit(1e-12)), f"label_{h}": F.coalesce(ahead > F.col("midprice"), F.lit(False)), f"microprice_change_{h}": F.lead(micro, h).over(w) - micro})
    return out


def chrono_split(rows: DataFrame, share: float = 0.8) -> DataFrame:
    """Adds ``part``: train for the first ``int(n * share)`` rows of each instrument in time order, else test."""
    w = Window.partitionBy("instrument")
    return rows.withColumn("_n", F.row_number().over(w.orderBy("ts_us", "pos"))).withColumn("_all", F.count(F.lit(1)).over(w)).withColumn("part", F.when(F.col("_n") <= F.floor(F.col("_all") * share), "train").otherwise("test")).drop("_n", "_all")


def queue_fills(rows: DataFrame, order_qty: int = 100, side: str = "buy", ahead: int = 99) -> DataFrame:
    """Per two-sided row the order's features and the first later row (within ``ahead``) where the best queue fell below what stood before it.

    Market columns of ``rows`` come along; ``order_price`` is one tick past the opposite best
    price and ``level_imbalance`` the queue's share of both best volumes.
    """
    qty, other = F.col("best_bid_qty" if side == "buy" else "best_ask_qty"), F.col("best_ask_qty" if side == "buy" else "best_bid_qty")
    price = F.col("best_ask") + TICK if side == "buy" else F.col("best_bid") - TICK
    size = max(BLOCK, ahead + 1)

    def find(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_n")
        q, ts = part["q"].to_numpy(np.int64), part["ts_us"].to_numpy(np.int64)
        # A queue under a limit is its negative over the limit's.
        at = first_at_least(-q, order_qty - q + 1, ahead + 1)
        mine = ((part["block"] == key[1]) & (at < len(q)) & (at <= np.arange(len(q)) + ahead)).to_numpy()
        return pd.DataFrame({"instrument": key[0], "_n": part["_n"].to_numpy()[mine], "_dt": (ts[np.minimum(at, len(q) - 1)] - ts)[mine].astype(float)})

    rows = numbered(rows)
    block = F.expr(f"(_n - 1) div {size}")
    # A block's search reaches into the first rows of the next one.
    groups = F.when((F.col("_n") - 1) % size < ahead, F.array(block - 1, block)).otherwise(F.array(block))
    near = rows.select("instrument", "_n", "ts_us", qty.alias("q"), block.alias("block"), F.explode(groups).alias("_group"))
    first = near.groupBy("instrument", "_group").applyInPandas(find, "instrument string, _n long, _dt double")
    rows = rows.join(first, ["instrument", "_n"], "left").withColumns({"order_price": price, "depth_ahead": qty, "level_imbalance": F.coalesce(F.try_divide(qty.cast("double"), (qty + other).cast("double")), F.lit(0.5))})
    rows = rows.withColumnRenamed("_dt", "expected_fill_time_us").drop("_n").where("best_bid <> 0 AND best_ask <> 0")
    return rows.withColumns({f"fill_{ms}ms": F.coalesce(F.col("expected_fill_time_us") <= 1000 * ms, F.lit(False)) for ms in (1, 5, 10)})
