"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Plan.  Sources get targets in words (weights, at most ``max_repeats`` times what a
source has, the excess reshared).  A target is whole passes over the source plus a
remainder.  Each source's documents lie in blocks: a keyed hash permutes them, so
block ``b`` holds the ``b``-th slice of the permuted source.  A source's quota is its
blocks once per pass and, for the remainder, the first blocks of the permutation; of the
last of these only the documents whose hash is under a cut.  Draws of blocks are dealt
to output shards: a binary tree halves the shards, and at each node the quota vector of
the sources is split by one multivariate-hypergeometric draw, so shards have equal
numbers of block draws and exact totals per source.  A shard's part of a source is a run
of block draws, disjoint from all other shards' runs.  A document is taken once for every
draw of its block that a shard's run holds; ``mix`` writes it to those shards, shuffled
there by another keyed hash, and ``mix_report`` counts the same draws.

So what a row contributes follows from its own hash and its source's plan: documents are
never numbered, and their texts cross the network once, on the way to their shard.  Sums
over a source's blocks are taken in levels of ``FANOUT``, so no task holds more than
``FANOUT`` rows of a key.  The plan has a row per source and is broadcast; its size is
checked: more than ``MAX_SOURCES`` sources are an error, not a silent cut.

Defined results: a null text has size 0; a null source is a source of its own, last;
sources of size 0 have target 0; an empty table gives an empty table; rows that repeat
``doc_id``, ``source`` and ``text`` share their hash, and where the cut falls among them,
exactly as many of them are drawn as fit, however the input is split (of rows that differ in
other columns only, which ones depends on their order); other columns may have any name.  Only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from depthline.llm.common import WORD_PATTERN, Scratch, stored, text_of

FANOUT = 1024
#: Rows of the plan at most; with 16 shards a row is about 250 bytes.
MAX_SOURCES = 50_000
#: Block draws of the tree at most; blocks hold more documents where there would be more draws.
MAX_DRAWS = 400_000_000


def water_fill(sizes: list[int], weights: list[float], max_repeats: float) -> list[float]:
    """Targets in proportion to the weights, none over ``max_repeats`` times its size, summing to all sizes."""
    total = float(sum(sizes))
    caps = [max_repeats * s for s in sizes]
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        share = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / share > caps[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / share
            break
        for i in over:
            targets[i] = caps[i]
        left -= sum(caps[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return targets


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """``[shard, source]`` block draws; column sums are the quotas, row sums differ by one at most."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def draw(vector: np.ndarray, take: int) -> np.ndarray:
        left, got = int(vector.sum()), np.zeros_like(vector)
        for i, v in enumerate(vector):
            left -= int(v)
            got[i] = rng.hypergeometric(int(v), left, take) if v and take else 0
            take -= int(got[i])
        return got

    def node(lo: int, hi: int, vector: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = vector
            return
        mid = (lo + hi) // 2
        total = int(vector.sum())
        left = draw(vector, total * (mid - lo) // (hi - lo))
        node(lo, mid, left)
        node(mid, hi, vector - left)

    node(0, shards, np.array(quotas, np.int64))
    return out


def _prefix(df: DataFrame, keys: list[str], index: str, value: str, levels: int) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over smaller ``index`` of the same keys, level by level."""
    if levels <= 1:
        w = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))
    up = df.withColumn("_up", F.floor(F.col(index) / FANOUT))
    tops = _prefix(up.groupBy(*keys, "_up").agg(F.sum(value).alias("_sum")), keys, "_up", "_sum", levels - 1)
    tops = tops.select(*keys, "_up", F.col("before").alias("_top"))
    w = Window.partitionBy(*keys, "_up").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    inner = up.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inner.join(tops, [*keys, "_up"]).withColumn("before", F.col("_in") + F.col("_top")).drop("_up", "_in", "_top")


def _unit(h: Column) -> Column:
    """A hash as a number in [0, 1)."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def _hash(docs: DataFrame, seed: int) -> Column:
    """A row's place in its source's permutation."""
    return F.xxhash64(F.lit(seed), docs["doc_id"], docs["source"].cast("string"), docs["text"].cast("string"))


def document_sizes(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, size, h``: what mixing needs of each row; the texts stay where they are."""
    size = F.regexp_count(text_of(docs), F.lit(WORD_PATTERN)).cast("long")
    return docs.select(docs["doc_id"].alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), _hash(docs, seed).alias("h"))


def plan_sources(sizes: DataFrame, weight_cycle: tuple[float, ...], max_repeats: float, docs_per_block: int) -> list[dict]:
    """A row per source with its target, passes, remainder and number of blocks."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: give coarser ones")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be", "surrogatepass")))
    totals = [int(r["size"]) for r in rows]
    targets = water_fill(totals, [weight_cycle[i % len(weight_cycle)] for i in range(len(rows))], max_repeats)
    docs_per_block = max(docs_per_block, math.ceil((max_repeats + 1) * sum(r["n"] for r in rows) / MAX_DRAWS))
    out = []
    for i, (r, size, target) in enumerate(zip(rows, totals, targets)):
        passes = int(target // size) if size else 0
        out.append({"sid": i, "source": r["source"], "source_size": size, "target": target, "passes": passes, "rest": target - passes * size, "blocks": max(1, math.ceil(r["n"] / docs_per_block))})
    return out


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small driver-side table as a DataFrame, without Python on the executors."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    fields = ",".join(c.replace(" ", ":", 1) for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{fields}>>")))


_PLAN = "sid long, source string, source_size long, target double, passes long, rest double, blocks long"


def _table(spark: SparkSession, plan: list[dict], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return _values(spark, [tuple(p[c] for c in names) for p in plan], schema)


def _block(h: Column, blocks: Column) -> Column:
    return F.floor(_unit(h) * blocks)


def _cuts(sizes: DataFrame, plan: list[dict]) -> dict[int, dict]:
    """Per source with a remainder: the block where its quota ends, the cut in it, the rows at the cut and how many of them fit.

    A row of that block is in the last draw when its hash is under the cut, or when it is
    one of the first ``fits`` of the ``ties`` rows at it.
    """
    table = F.broadcast(_table(sizes.sparkSession, plan, _PLAN).withColumnRenamed("source", "_s"))
    keyed = sizes.join(table, F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", _block(F.col("h"), F.col("blocks")))
    levels = max(1, math.ceil(math.log(max(p["blocks"] for p in plan) + 1, FANOUT)))
    blocks = keyed.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    placed = _prefix(blocks, ["sid"], "block", "words", levels).where("before < rest")
    last = placed.groupBy("sid").agg(F.max(F.struct("block", "before")).alias("last")).select("sid", "last.*")
    # Rows of one hash are one group, however many they are.
    groups = keyed.join(F.broadcast(last), ["sid", "block"]).groupBy("sid", "block", "h").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("before").alias("b0"), F.first("rest").alias("rest"))
    w = Window.partitionBy("sid", "block").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    at = groups.withColumn("at", F.col("b0") + F.coalesce(F.sum("words").over(w), F.lit(0))).withColumn("each", F.col("words") / F.col("n"))
    # As many rows of the group as bring the sum nearest to the remainder.
    fits = F.when(F.col("each") > 0, F.least(F.col("n"), F.floor((F.col("rest") - F.col("at")) / F.col("each") + 0.5))).otherwise(F.col("n"))
    cut = at.where("at < rest").groupBy("sid").agg(F.max(F.struct("h", fits.cast("long").alias("fits"), F.col("n").alias("ties"), "block")).alias("c")).select("sid", "c.*")
    return {r["sid"]: r for r in cut.collect()}


def plan_mix(sizes: DataFrame, weight_cycle: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: float = 3.0, docs_per_block: int = 64, shards: int = 16, seed: int = 17) -> list[dict]:
    """The whole plan: per source its target, blocks, cut and ``ends``, where the shards' runs of block draws end."""
    plan = plan_sources(sizes, weight_cycle, max_repeats, docs_per_block)
    if not plan:
        return []
    cuts = _cuts(sizes, plan)
    for p in plan:
        c = cuts.get(p["sid"])
        p["edge"], p["cut"], p["fits"], p["ties"] = (int(c["block"]), int(c["h"]), int(c["fits"]), int(c["ties"])) if c else (-1, 0, 0, 0)
    quotas = [p["passes"] * p["blocks"] + p["edge"] + 1 for p in plan]
    ends = np.cumsum(split_tree(quotas, shards, seed), axis=0)
    for i, p in enumerate(plan):
        p["ends"] = ends[:, i].tolist()
    return plan


_FULL = _PLAN.replace(", rest double", "") + ", edge long, cut long, fits long, ties long, ends array<long>"


def _first_ties(tied: DataFrame) -> DataFrame:
    """``tied`` with ``_in``: whether a row is one of its source's first ``fits``.

    Rows are counted within the tasks that wrote them and ranked from there, so one hash
    may have any number of rows and no task sorts more of them than a task has written.
    """
    tied = stored(tied.withColumn("_task", F.spark_partition_id()).withColumn("_row_id", F.monotonically_increasing_id()), "mix-ties")
    tasks = tied.groupBy("sid", "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("sid").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("sid", "_task").orderBy("_row_id"))
    ranked = tied.withColumn("_rank", rank).join(tasks.select("sid", "_task", before.alias("_before")), ["sid", "_task"])
    return ranked.withColumn("_in", F.col("_before") + F.col("_rank") <= F.col("fits")).drop("_task", "_row_id", "_rank", "_before")


def draws(spark: SparkSession, plan: list[dict], rows: DataFrame, seed: int = 17) -> DataFrame:
    """``rows`` (with ``source, h``) with ``source_size, target`` and ``draws``: structs ``turn, shard`` of the draws that hold the row."""
    table = F.broadcast(_table(spark, plan, _FULL).withColumnRenamed("source", "_s"))
    joined = rows.join(table, F.col("source").eqNullSafe(F.col("_s")))
    block = _block(F.col("h"), F.col("blocks"))
    # In the block where the quota ends the last draw holds the rows under the cut and those at it that fit.
    placed = joined.withColumn("_block", block)
    tie = (F.col("_block") == F.col("edge")) & (F.col("h") == F.col("cut")) & (F.col("fits") > 0) & (F.col("fits") < F.col("ties"))
    inside = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & (F.col("fits") >= F.col("ties")))
    joined = placed.withColumn("_in", (F.col("_block") != F.col("edge")) | inside)
    if any(0 < p["fits"] < p["ties"] for p in plan):
        joined = joined.where(~tie).unionByName(_first_ties(placed.where(tie)))
    shard_of = lambda draw: F.size(F.filter("ends", lambda e: e <= draw)).cast("long")
    turns = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda t: F.struct(t.alias("turn"), shard_of(t * F.col("blocks") + F.col("_block")).alias("shard")))
    held = F.filter(turns, lambda d: (d["shard"] < F.size("ends")) & (F.col("_in") | (d["turn"] < F.col("passes"))))
    return joined.withColumn("draws", held).drop("_s", "_block", "_in")


def mix_report(docs: DataFrame, weight_cycle: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: float = 3.0, docs_per_block: int = 64, shards: int = 16, seed: int = 17) -> DataFrame:
    """Per row its ``size``, its source's ``source_size`` and ``target``, ``taken``: the words of all draws that hold it, and ``shards`` of the draws."""
    with Scratch(docs.sparkSession) as scratch:
        sizes = stored(document_sizes(docs, seed), "mix-sizes")
        plan = plan_mix(sizes, weight_cycle, max_repeats, docs_per_block, shards, seed)
        if plan:
            rows = draws(docs.sparkSession, plan, sizes, seed)
            report = rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.col("draws.shard").alias("shards"))
        else:
            report = sizes.select("doc_id", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"), F.array().cast("array<long>").alias("shards"))
        return scratch.result(report, "mix-report")


def mix(docs: DataFrame, weight_cycle: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: float = 3.0, docs_per_block: int = 64, shards: int = 16, seed: int = 17) -> DataFrame:
    """The mixed documents: all columns of ``docs``, each row once for every draw that holds it.

    Rows lie in their shard, shuffled; ``shards`` is the number of output shards.
    """
    spark = docs.sparkSession
    with Scratch(spark):
        plan = plan_mix(stored(document_sizes(docs, seed), "mix-sizes"), weight_cycle, max_repeats, docs_per_block, shards, seed)
    if not plan:
        return docs.limit(0)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["source"].cast("string").alias("source"), _hash(docs, seed).alias("h"))
    placed = draws(spark, plan, rows, seed).select("_row", "h", F.explode("draws").alias("d"))
    mixed = placed.select("_row", F.col("d.shard").alias("shard"), F.xxhash64(F.lit(seed + 1), "h", "d.turn").alias("mixed"))
    parts = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = mixed.repartition(parts, "shard", F.pmod(F.col("mixed"), F.lit(max(1, parts // shards)))).sortWithinPartitions("shard", "mixed")
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
