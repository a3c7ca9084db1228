"""Depth-update and snapshot JSON as canonical messages, each line parsed once.

Keys that differ by case only (``E`` and ``e``, ``U`` and ``u``) are told apart by the JSON reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depthline.functions.fixed_point import number, to_price, to_qty

_PAIRS = "array<array<string>>"


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0))


def _levels(pairs: Column, side: str) -> Column:
    pairs = F.coalesce(pairs, F.array().cast(_PAIRS))
    whole = F.filter(pairs, lambda p: F.coalesce(F.size(p) >= 2, F.lit(False)) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    return F.transform(whole, lambda p: F.struct(F.lit(side).alias("side"), F.get(p, F.lit(0)).alias("px"), F.get(p, F.lit(1)).alias("qty")))


def parse_depth_updates(lines: DataFrame, line: str = "line", dialect: str = "replay") -> DataFrame:
    """Messages of update lines, bids before asks; ``n`` is the place in its line. Other columns stay."""
    c = F.col(line)
    keep = [x for x in lines.columns if x != line]
    read = lines.select(*keep, F.from_json(c, f"E string, u string, b {_PAIRS}, a {_PAIRS}").alias("_d"))
    rows = read.select(*keep, _whole(F.col("_d.u")).alias("seq"), (_whole(F.col("_d.E")) * 1000).alias("ts_us"), F.posexplode(F.concat(_levels(F.col("_d.b"), "Buy"), _levels(F.col("_d.a"), "Sell"))).alias("n", "level"))
    px, qty = to_price(number(F.col("level.px")), dialect), to_qty(number(F.col("level.qty")), dialect)
    return rows.select(*keep, "n", "seq", "ts_us", F.when(qty == 0, "Delete").otherwise("Modify").alias("type"), px.alias("order_id"), px.alias("px"), qty.alias("qty"), F.col("level.side").alias("side"))


def parse_snapshots(lines: DataFrame, line: str = "line") -> DataFrame:
    """Snapshot messages of whole-book lines; levels whose quantity rounds to 0 are left out."""
    c = F.col(line)
    keep = [x for x in lines.columns if x != line]
    read = lines.select(*keep, F.from_json(c, f"lastUpdateId string, bids {_PAIRS}, asks {_PAIRS}").alias("_d"))
    rows = read.select(*keep, _whole(F.col("_d.lastUpdateId")).alias("seq"), F.posexplode(F.concat(_levels(F.col("_d.bids"), "Buy"), _levels(F.col("_d.asks"), "Sell"))).alias("n", "level"))
    px, qty = to_price(number(F.col("level.px"))), to_qty(number(F.col("level.qty")))
    return rows.select(*keep, "n", "seq", F.lit(0).cast("bigint").alias("ts_us"), F.lit("Snapshot").alias("type"), px.alias("order_id"), px.alias("px"), qty.alias("qty"), F.col("level.side").alias("side")).where("qty <> 0")


def route(line: Column) -> Column:
    """What a line is: a snapshot, an update, or null (left out)."""
    return F.when(line.contains("snapshot"), "snapshot").when(line.contains("depthUpdate"), "update")


def read_lines(spark, path: str) -> DataFrame:
    """Lines of a file with their order, carriage returns and blank lines removed.

    The order comes from reading each file whole, so keep files of moderate size.
    """
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return text.withColumn("line", F.regexp_replace("line", "\r+$", "")).where(F.trim("line") != "")
