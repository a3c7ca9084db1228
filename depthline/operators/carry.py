"""Running values in pieces.

A window over a whole instrument is one task.  Here an instrument's rows are cut into buckets of
``BUCKET`` positions: windows run inside a bucket, each bucket is summed up in one row (total,
product, last known value, last few values), a prefix over those rows gives what every bucket
inherits, and one join brings it back.  Only the prefix, one row a bucket, sees an instrument
as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthline.scratch import stored

BUCKET = 4096


def bucket_of(order: str = "pos", size: int | None = None) -> Column:
    return F.expr(f"`{order}` div {size or BUCKET}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(
    rows: DataFrame,
    sums: Mapping[str, Column] = {},
    lasts: Mapping[str, Column] = {},
    products: Mapping[str, Column] = {},
    previous: Mapping[str, Column] = {},
    following: Mapping[str, Column] = {},
    tails: Mapping[str, tuple[Column, int, Callable[[Column], Column]]] = {},
    by: str | tuple[str, ...] = "instrument",
    order: tuple[str, ...] = ("pos",),
    size: int | None = None,
    keep_bucket: bool = False,
    scattered: bool = False,
) -> DataFrame:
    """``rows`` with running columns, up to and with each row in ``order``.

    ``sums`` (null counts as 0), ``products`` and ``lasts`` (the last value that is not null) include the row
    itself; ``previous`` is the value of the row before and ``following`` that of the row after, null included.  ``tails`` gives a bucket's rows the last
    ``k`` values (that are not null, oldest first) of the buckets before it, put through a function.
    Buckets are of the first column of ``order``; with ``keep_bucket`` the column ``_bucket`` stays.
    ``scattered`` rows lie in no order, so they are brought together before they are summed up.
    """
    by = (by,) if isinstance(by, str) else tuple(by)
    rows = rows.withColumn("_bucket", bucket_of(order[0], size))
    if scattered:
        rows = rows.repartition(*by, "_bucket")
    place = F.struct(*order)
    inner = Window.partitionBy(*by, "_bucket").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    boxed = lambda c: F.struct(c.alias("v"))
    kept = lambda c: F.when(c.isNotNull(), place)
    whole = (
        [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
        + [F.product(c).alias(f"_p_{n}") for n, c in products.items()]
        + [F.max_by(c, kept(c)).alias(f"_l_{n}") for n, c in lasts.items()]
        + [F.max_by(boxed(c), place).alias(f"_b_{n}") for n, c in previous.items()]
        + [F.min_by(boxed(c), place).alias(f"_a_{n}") for n, c in following.items()]
        + [F.slice(F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(place.alias("at"), c.alias("v")))), asc=False), 1, k).alias(f"_t_{n}") for n, (c, k, _) in tails.items()]
    )
    totals = rows.groupBy(*by, "_bucket").agg(*whole)
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums]
    carried += [F.product(F.col(f"_p_{n}")).over(before).alias(f"_p_{n}") for n in products]
    carried += [F.last(f"{kind}_{n}", ignorenulls=True).over(before).alias(f"{kind}_{n}") for kind, names in (("_l", lasts), ("_b", previous)) for n in names]
    carried += [F.lead(f"_a_{n}").over(Window.partitionBy(*by).orderBy("_bucket")).alias(f"_a_{n}") for n in following]
    for n, (c, k, made) in tails.items():
        # Buckets without a value do not count, so the last k buckets that have one are enough.
        totals = totals.withColumn(f"_n_{n}", F.coalesce(F.sum((F.size(f"_t_{n}") > 0).cast("int")).over(before), F.lit(0)))
        earlier = Window.partitionBy(*by).orderBy(f"_n_{n}").rangeBetween(-k, -1)
        values = F.flatten(F.collect_list(f"_t_{n}").over(earlier))
        newest = F.transform(F.slice(F.sort_array(values, asc=False), 1, k), lambda x: x["v"])
        carried.append(let(F.reverse(newest), made).alias(n))
    prefix = totals.select(*by, "_bucket", *carried)
    zero = lambda c: F.coalesce(c, F.lit(0))
    local = rows.withColumns(
        {f"_x_{n}": F.sum(c).over(upto) for n, c in sums.items()}
        | {f"_y_{n}": F.product(c).over(upto) for n, c in products.items()}
        | {f"_z_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
        | {f"_w_{n}": F.lag(boxed(c)).over(inner) for n, c in previous.items()}
        | {f"_v_{n}": F.lead(boxed(c)).over(inner) for n, c in following.items()}
    )
    joined = local.join(prefix, [*by, "_bucket"], "left")
    out = joined.withColumns(
        {n: zero(F.col(f"_x_{n}")) + zero(F.col(f"_s_{n}")) for n in sums}
        | {n: F.coalesce(f"_y_{n}", F.lit(1.0)) * F.coalesce(f"_p_{n}", F.lit(1.0)) for n in products}
        | {n: F.coalesce(f"_z_{n}", f"_l_{n}") for n in lasts}
        | {n: F.coalesce(f"_w_{n}", f"_b_{n}")["v"] for n in previous}
        | {n: F.coalesce(f"_v_{n}", f"_a_{n}")["v"] for n in following}
    )
    made_up = [f"{a}_{n}" for pair, names in ((("_x", "_s"), sums), (("_y", "_p"), products), (("_z", "_l"), lasts), (("_w", "_b"), previous), (("_v", "_a"), following)) for n in names for a in pair]
    return out.drop(*made_up, *([] if keep_bucket else ["_bucket"]))


#: Microseconds of a time bucket: with one row a microsecond at most, its size is bounded;
#: rows some milliseconds apart still share one.
TIME_BUCKET = 1 << 20


def expired(rows: DataFrame, hits: Mapping[str, Column], window_us: int, asks: DataFrame | None = None) -> DataFrame:
    """``instrument, ts_us`` and how many hits lie more than ``window_us`` before each time.

    Rows are summed by time first, so a burst of rows at one time is one row; every time then asks for
    the running count at ``window_us`` before it.  Where only ``asks`` (``instrument, ts_us`` and more, which stays) are wanted, the
    rows of a time bucket in which none falls are one row.
    """
    back = window_us + 1
    counts = {n: F.when(c, 1).otherwise(0).cast("long") for n, c in hits.items()}
    if asks is None:
        times = rows.groupBy("instrument", "ts_us").agg(*[F.sum(c).alias(n) for n, c in counts.items()])
        stay = F.struct(F.col("ts_us").alias("_at"), F.lit(0).alias("_asks"), *[F.col(n).alias(f"_h_{n}") for n in hits])
        ask = F.struct((F.col("ts_us") - back).alias("_at"), F.lit(1).alias("_asks"), *[F.lit(0).cast("long").alias(f"_h_{n}") for n in hits])
        kept, both = [], times.select("instrument", F.explode(F.array(stay, ask)).alias("m")).select("instrument", "m.*")
    else:
        kept, time = {n: kind for n, kind in asks.dtypes if n not in ("instrument", "ts_us")}, bucket_of("_at", TIME_BUCKET)
        asks = asks.withColumn("_at", F.col("ts_us") - back)
        # Few where most messages have their last second by them; which side of the join travels is then Spark's choice by size.
        asked = stored(asks.select("instrument", time.alias("_time"), F.lit(True).alias("_asked")).distinct(), "asked")
        timed = rows.where("ts_us IS NOT NULL").select("instrument", F.col("ts_us").alias("_at"), *[c.alias(f"_h_{n}") for n, c in counts.items()]).withColumn("_time", time)
        at = F.when(F.col("_asked"), F.col("_at")).otherwise(F.col("_time") * TIME_BUCKET).alias("_at")
        stays = timed.join(asked, ["instrument", "_time"], "left").groupBy("instrument", at).agg(*[F.sum(f"_h_{n}").alias(f"_h_{n}") for n in hits])
        none = [F.lit(None).cast(kind).alias(n) for n, kind in kept.items()]
        both = stays.select("instrument", "_at", F.lit(0).alias("_asks"), *[f"_h_{n}" for n in hits], *none).unionByName(asks.select("instrument", "_at", F.lit(1).alias("_asks"), *[F.lit(0).cast("long").alias(f"_h_{n}") for n in hits], *kept))
    counted = running(both, sums={n: F.col(f"_h_{n}") for n in hits}, order=("_at", "_asks"), size=TIME_BUCKET, scattered=True)
    return counted.where("_asks = 1").select("instrument", *kept, (F.col("_at") + back).alias("ts_us"), *hits)


def numbered(rows: DataFrame, name: str = "_n") -> DataFrame:
    """``rows`` with their number in the instrument, from 1."""
    return running(rows, sums={name: F.lit(1).cast("long")})


def lagged(rows: DataFrame, columns: Mapping[str, str], by: int) -> DataFrame:
    """``rows`` (with their number ``_n``) and the values ``columns`` (new name: old) of the row ``by`` rows before, null for the first."""
    old = rows.select("instrument", (F.col("_n") + by).alias("_n"), *[F.col(c).alias(n) for n, c in columns.items()])
    return rows.join(old, ["instrument", "_n"], "left")
