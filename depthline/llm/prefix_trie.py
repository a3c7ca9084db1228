"""Conversation prefix trie by prefix-doubling naming.

Turns get names first: equal (role, text) pairs share one.  Blocks of 2, 4, 8, ... turns
that start at a multiple of their size are then named in one join round each from the names
of their halves, so conversations of ``n`` turns take ``log2(n)`` rounds and ``2 n`` rows.  A
prefix of ``d`` turns is the blocks of the binary digits of ``d``, longest first: the prefix
without the lowest digit, followed by one block.  So prefixes are named in as many rounds as a
length has digits, and rows with equal (depth, name) form one node.

Names are longs from a written table, one row for each different key (gaps between them do
no harm).  They come back to the rows by a join on the key; keys held by more than a
thousandth of the rows, of which there are at most ``HOT_SHARE``, go by broadcast and the rest
by shuffle, so no copied opening makes a hot task.

Sums over subtrees need no walk along the tree: a node is owned by its smallest member, what
a conversation owns is a tail of its path, and a subtree's sum is the sum over the node's
members of what each owns from that depth on.

Defined results: turns go by ``turn`` (null first), then role, then the SHA-256 of the text;
repeated rows are turns of their own; rows without ``conv_id`` belong to no conversation; null
roles and texts are empty; an empty table has no nodes; only the four columns are read.
Conversations may hold any number of turns: they are numbered and summed in pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthline.llm.common import Scratch, stored

HOT_SHARE = 1000
#: Depths of a path that are summed in one window.
PIECE = 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, name``: one name for each different key, with its number of rows."""
    return stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.monotonically_increasing_id()), "names")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
    """``rows`` with columns ``take`` of the only row of ``table`` of their keys; ``n`` says how many rows have it.

    At most ``HOT_SHARE`` keys can hold more than that share of all rows; these are broadcast.
    """
    cold = table.select(*keys, *take, "n")
    total, most = table.agg(F.sum("n"), F.max("n")).first()
    if total is None or most * HOT_SHARE <= total:
        return rows.join(cold.drop("n"), keys)
    hot = F.broadcast(cold.where(F.col("n") * HOT_SHARE > total))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot.drop("n"), keys).unionByName(rest.join(cold.where(F.col("n") * HOT_SHARE <= total).drop("n"), keys))


def _numbered(conversations: DataFrame) -> DataFrame:
    """``conv, i, key, bytes``: turns numbered from 1 in each conversation, which may be spread over many tasks."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    body = F.encode(text, "UTF-8")
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv"),
        conversations["turn"].alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    kinds = rows.groupBy("conv", "turn", "role", "digest", "bytes").agg(F.count(F.lit(1)).alias("times"))
    ranged = stored(kinds.repartitionByRange(F.col("conv"), *order).withColumn("piece", F.spark_partition_id()), "turns")
    within = Window.partitionBy("conv", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy("conv", "piece").agg(F.sum("times").alias("held")).select("conv", "piece", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("skipped"))
    last = ranged.withColumn("last", F.sum("times").over(within)).join(pieces, ["conv", "piece"])
    key = F.unhex(F.sha2(F.concat(F.unhex(F.sha2(F.encode("role", "UTF-8"), 256)), F.col("digest")), 256))
    spread = F.sequence(F.col("skipped") + F.col("last") - F.col("times") + 1, F.col("skipped") + F.col("last"))
    return last.select("conv", F.explode(spread).alias("i"), key.alias("key"), "bytes")


def rebuilt(conversations: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of the rebuilt conversations.

    Conversation ``c`` takes its first ``crc32(c) % heads`` turns from conversation ``c - c % group``
    and the others from itself.  Returns ``conv, j, key, bytes, size`` with places from 0, and
    ``conv, size`` for every conversation, turnless ones too.
    """
    turns = stored(_numbered(conversations), "numbered")
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    plan = own.select("conv", "own", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h"))
    plan = plan.join(own.select(F.col("conv").alias("base"), F.col("own").alias("of_base")), "base", "left")
    head = F.least("h", F.coalesce("of_base", F.lit(0)))
    plan = plan.select("conv", "own", "base", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    plan = stored(plan, "plan")
    lent = turns.where((F.col("conv") % group == 0) & (F.col("i") < heads)).withColumnRenamed("conv", "base").join(plan.drop("h", "own"), "base").where("i <= head")
    kept = looked_up(turns, plan.withColumnRenamed("own", "n"), ["conv"], ["h", "head", "size"]).where("i > h")
    columns = lambda place: ["conv", place.alias("j"), "key", "bytes", "size"]
    both = lent.select(*columns(F.col("i") - 1)).unionByName(kept.select(*columns(F.col("head") + F.col("i") - F.col("h") - 1)))
    return both, plan.select("conv", "size")


def prefixes(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """``conv, d, p, bytes, size``: the name of every prefix, that of no turns included; equal (d, p) are equal prefixes."""
    turns = stored(turns, "rebuilt")
    blocks = [stored(looked_up(turns, _named(turns, ["key"]), ["key"], ["name"]).drop("key"), "blocks")]
    longest = sizes.agg(F.max("size")).first()[0] or 0
    while longest >> len(blocks):
        odd = F.col("j") % 2 == 1
        halves = blocks[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(~odd, F.col("name"))).alias("a"), F.max(F.when(odd, F.col("name"))).alias("b"), F.max(F.when(odd, F.col("bytes"))).alias("bytes"), F.max("size").alias("size"))
        halves = stored(halves.where("b IS NOT NULL"), "halves")
        blocks.append(stored(looked_up(halves, _named(halves, ["a", "b"]), ["a", "b"], ["name"]).drop("a", "b"), "blocks"))
    # An even block ends exactly one prefix: the one it shares its start with comes before it.
    parts = None
    for k, level in enumerate(blocks):
        own = level.where("j % 2 = 0").select("conv", F.shiftleft(F.col("j") + 1, k).alias("d"), F.shiftleft("j", k).alias("prev"), F.bit_count("j").alias("digits"), F.col("name").alias("block"), "bytes", "size")
        parts = own if parts is None else parts.unionByName(own)
    columns = ["conv", "d", "p", "bytes", "size"]
    done = parts.where("prev = 0").withColumnRenamed("block", "p").select(*columns)
    out = done.unionByName(sizes.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("bytes"), "size"))
    # Places run to longest - 1; an even one below 2 ** r has at most r - 1 digits.
    for digits in range(1, max(0, longest - 1).bit_length()):
        known = done.select("conv", F.col("d").alias("prev"), F.col("p").alias("before"))
        longer = stored(parts.where(F.col("digits") == digits).join(known, ["conv", "prev"]), "longer")
        keys = ["d", "before", "block"]
        done = stored(looked_up(longer, _named(longer, keys), keys, ["name"]).withColumnRenamed("name", "p").select(*columns), "prefixes")
        out = out.unionByName(done)
    return out


def _chunks(batches):
    """Decimal ids of one node's neighbouring rows, joined."""
    for batch in batches:
        if not len(batch):
            continue
        d, p, conv = (batch[c].to_numpy() for c in ("d", "p", "conv"))
        cuts = np.concatenate(([0], np.flatnonzero((d[1:] != d[:-1]) | (p[1:] != p[:-1])) + 1, [len(d)]))
        starts = cuts[:-1]
        yield pd.DataFrame({"d": d[starts], "p": p[starts], "first": conv[starts], "ids": [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:])]})


def _digests(batches):
    """One SHA-256 a node over its chunks, which come in ascending order; only the running hash is held."""
    node, state = None, None
    for batch in batches:
        out = []
        for d, p, ids in zip(batch["d"].tolist(), batch["p"].tolist(), batch["ids"]):
            if (d, p) != node:
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (d, p), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pd.DataFrame(out, columns=["d", "p", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["d", "p", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """``d, p, ends_sha256`` of the nodes where conversations end."""
    last = paths.where("d = size").select("d", "p", "conv").repartitionByRange("d", "p", "conv").sortWithinPartitions("d", "p", "conv")
    chunks = last.mapInPandas(_chunks, "d long, p long, first long, ids string")
    return chunks.repartition("d", "p").sortWithinPartitions("d", "p", "first").mapInPandas(_digests, "d long, p long, ends_sha256 string")


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations ``conv, j, key, bytes, size``; ``sizes`` has every conversation."""
    paths = stored(prefixes(turns, sizes), "paths")
    owners = stored(paths.groupBy("d", "p").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.max("size").alias("longest")), "owners")
    saved = ((F.col("n") - 1) * F.col("bytes")).alias("saved")
    zero = F.lit(0).cast("long")
    mine = owners.select("conv", "d", saved, (F.col("longest") == F.col("d")).cast("long").alias("leaf"), zero.alias("kid"), F.lit(1).cast("long").alias("mine"))
    kids = owners.where("d > 0").select("conv", (F.col("d") - 1).alias("d"), zero.alias("saved"), zero.alias("leaf"), F.lit(1).cast("long").alias("kid"), zero.alias("mine"))
    held = mine.unionByName(kids).groupBy("conv", "d").agg(*[F.sum(c).alias(c) for c in ("saved", "leaf", "kid", "mine")])
    rows = paths.join(held, ["conv", "d"], "left").na.fill(0, ["saved", "leaf", "kid", "mine"]).withColumn("piece", F.expr(f"d div {PIECE}"))
    rows = stored(rows, "owned")
    sums = ("saved", "leaf")
    later = Window.partitionBy("conv").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    tails = rows.groupBy("conv", "piece").agg(*[F.sum(c).alias(c) for c in sums]).select("conv", "piece", *[F.coalesce(F.sum(c).over(later), zero).alias(f"{c}_later") for c in sums])
    onward = Window.partitionBy("conv", "piece").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    tailed = rows.select("conv", "d", "p", "piece", "kid", *[F.sum(c).over(onward).alias(c) for c in sums]).join(tails, ["conv", "piece"])
    nodes = tailed.groupBy("d", "p").agg(
        F.min("conv").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum("kid").alias("n_children"),
        F.sum(F.col("leaf") + F.col("leaf_later")).alias("n_leaves"),
        F.sum(F.col("saved") + F.col("saved_later")).alias("saved_tokens"),
    )
    nodes = stored(nodes, "nodes")
    # A path's first own node hangs on a node that another conversation owns.
    hung = stored(rows.where("kid > 0 AND mine = 0").select(F.col("conv").alias("conv_id"), "d", "p"), "hung")
    above = looked_up(hung, nodes.withColumn("n", F.col("n_children")).withColumnRenamed("conv_id", "above"), ["d", "p"], ["above"]).select("conv_id", (F.col("d") + 1).alias("d"), "above")
    out = nodes.join(above, ["conv_id", "d"], "left").join(ends(paths), ["d", "p"], "left")
    return out.select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(F.col("d") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    with Scratch(conversations.sparkSession) as scratch:
        return scratch.result(trie(*rebuilt(conversations)), "trie")
