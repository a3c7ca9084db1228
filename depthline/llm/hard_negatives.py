"""Hard-negative mining by norm-bucketed search.

Candidates are sorted by norm and cut into buckets of at most ``BUCKET`` rows; anchors, the
stated query set, are packed into blocks the same way.  By Cauchy-Schwarz no score of a bucket
exceeds the anchor's norm times the bucket's largest norm, so for every anchor

* positives: the ``FIRST`` buckets give a first k-th best score; of the others only those that
  can still reach it are read, and it keeps rising along a run of buckets of falling norm;
* negatives: buckets that cannot reach the lower limit of an anchor's lowest window are never
  read; along a run a bucket is passed over once it can beat no window's k-th best score.

Pruning only skips what cannot be in the result, so results are exact.  A task holds one block
of anchors and one run of buckets; what it returns per anchor is at most k rows.  Scores are
products of whole numbers, exact in doubles below 2**53 and in Python's integers beyond.

Defined results: vectors that are null or hold null or non-finite components and rows without
a label take no part (zero vectors do); only vectors of equal length are compared, empty ones
have score 0 with each other; components beyond 1e300 count as non-finite; rows without ``vec_id`` are no anchors and come last among
equal scores; repeated rows are rows of their own, as anchors, positives and negatives; scores
beyond 64 bits are reported as the nearest long; an empty table gives no rows; only
``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depthline.llm.common import Scratch, stored

BUCKET, ANCHORS = 4096, 8192
#: Numbers of a bucket or block at most, so that long vectors make shorter ones.
NUMBERS = 1 << 21
#: Buckets read before the first k-th best score is known, and buckets a task reads in a row.
FIRST, RUN = 2, 4
TILE = 256
EXACT = 2.0**53
#: Roundings of a norm of up to a million components stay below this.
SLACK = 1 + 1e-9
_NO_ID = np.iinfo(np.int64).max
_LOW, _HIGH = -(2**63), 2**63 - 1

PACKED = "part int, k int, width int, n int, most double, uid binary, id binary, label binary, v binary"


def whole_numbers(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """``uid, vec_id, label, width, norm, v``: valid rows with components ``floor(scale * x)`` as packed doubles."""

    def run(batches):
        for batch in batches:
            if len(batch):
                q = [np.floor(scale * np.asarray(e, np.float64)) for e in batch["embedding"]]
                with np.errstate(over="ignore"):
                    norm = [float(np.sqrt((x * x).sum())) for x in q]
                yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"], "width": [len(x) for x in q], "norm": norm, "v": [x.tobytes() for x in q]})

    e = F.col("embedding")
    whole = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 1e300)), F.lit(False))
    rows = rows.where(F.col("label").isNotNull() & e.isNotNull() & whole).select("vec_id", "label", "embedding")
    return rows.mapInPandas(run, "vec_id long, label long, width int, norm double, v binary").withColumn("uid", F.monotonically_increasing_id())


def packed(rows: DataFrame, most: int) -> DataFrame:
    """Blocks of at most ``most`` rows of falling norm; ``part`` and ``k`` number those of a width."""

    def run(batches):
        held, width, k, part = [], None, 0, None

        def pack():
            got = pd.concat(held, ignore_index=True)
            label = got["label"].to_numpy(np.int64)
            ids = np.array([_NO_ID if pd.isna(x) else int(x) for x in got["vec_id"]], np.int64)
            return pd.DataFrame({"part": [part], "k": [k], "width": [width], "n": [len(got)], "most": [float(got["norm"].max())], "uid": [got["uid"].to_numpy(np.int64).tobytes()], "id": [ids.tobytes()], "label": [label.tobytes()], "v": [b"".join(got["v"])]})

        for batch in batches:
            while len(batch):
                now = int(batch["width"].iloc[0])
                if now != width:
                    if held:
                        yield pack()
                    held, width, k, part = [], now, 0, int(batch["part"].iloc[0])
                room = max(1, min(most, NUMBERS // max(now, 1))) - sum(map(len, held))
                same = int((batch["width"] == now).to_numpy().argmin()) if (batch["width"] != now).any() else len(batch)
                take = min(room, same)
                held.append(batch.iloc[:take])
                batch = batch.iloc[take:]
                if take == room:
                    yield pack()
                    held, k = [], k + 1
        if held:
            yield pack()

    order = [F.col("width"), F.desc("norm"), F.col("vec_id"), F.col("uid")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return ranged.select("part", "uid", "vec_id", "label", "width", "norm", "v").mapInPandas(run, PACKED)


def _ranked(blocks: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: the place of each block among those of its width, from 0, by falling norm."""
    counts = blocks.groupBy("width", "part").agg(F.count(F.lit(1)).alias("blocks"))
    before = Window.partitionBy("width").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("width", "part", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("skipped"))
    return blocks.join(counts, ["width", "part"]).withColumn(name, F.col("skipped") + F.col("k")).drop("skipped", "part", "k")


class _Block:
    """A packed block's arrays."""

    def __init__(self, row):
        self.n, self.width = int(row["n"]), int(row["width"])
        self.uid, self.id, self.label = (np.frombuffer(row[c], np.int64) for c in ("uid", "id", "label"))
        self.v = np.frombuffer(row["v"], np.float64).reshape(self.n, self.width)
        self.most = float(row["most"])
        self.largest = float(np.abs(self.v).max()) if self.v.size else 0.0


def scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact inner products of whole-number rows, as longs (or Python's integers where longs may not hold them)."""
    if a.shape[1] * largest < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return exact(a).dot(exact(b).T)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: by falling score, then rising id."""
    at = np.arange(len(score))
    if len(score) > 4 * k and score.dtype != object:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[sorted(range(len(at)), key=lambda i: (-int(score[at[i]]), int(ids[at[i]])))[:k]]


def _long(x) -> int:
    return max(_LOW, min(_HIGH, int(x)))


def _search(k: int, share: tuple[int, int] | None):
    """Per anchor of a block, the ``k`` best rows of a run of buckets.

    Without ``share``: rows of the anchor's label other than itself.  With it: per positive, rows of other
    labels whose score lies between the two percentages of the positive's.
    """

    def run(key, buckets: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        anchors = anchors.rename(columns=lambda c: c.removeprefix("a_"))
        if len(buckets) and len(anchors):
            a = _Block(anchors.iloc[0])
            norm = np.sqrt((a.v * a.v).sum(1)) * SLACK
            # One window per anchor for positives, one per positive for negatives: (low, high) and the best so far.
            windows: list[list] = [[] for _ in range(a.n)]
            for w in anchors["windows"].iloc[0]:
                p = int(w["score"])
                if share is None:
                    windows[w["at"]].append([p, None, [], w])
                elif p >= 0:
                    windows[w["at"]].append([-(-share[0] * p // 100), share[1] * p // 100, [], w])
            asked = np.array([i for i in range(a.n) if windows[i]], np.int64)
            limit = np.array([float(min(w[0] for w in windows[i])) for i in asked])
            for _, row in buckets.sort_values("bucket").iterrows():
                b = _Block(row)
                live = asked[~(norm[asked] * b.most < limit)]
                for lo in range(0, len(live), TILE):
                    tile = live[lo : lo + TILE]
                    s = scores(a.v[tile], b.v, a.largest * b.largest)
                    same = a.label[tile][:, None] == b.label[None, :]
                    for r, i in enumerate(tile.tolist()):
                        fits = (same[r] & (b.uid != a.uid[i])) if share is None else ~same[r]
                        for w in windows[i]:
                            least = w[0] if len(w[2]) < k else max(w[0], w[2][-1][0])
                            good = fits & (s[r] >= least)
                            if w[1] is not None:
                                good &= s[r] <= w[1]
                            at = np.flatnonzero(good)
                            if len(at):
                                at = at[_best(s[r][at], b.id[at], k)]
                                w[2] = sorted(w[2] + [(int(s[r][j]), int(b.id[j])) for j in at], key=lambda x: (-x[0], x[1]))[:k]
                # What an anchor still needs: the least of its windows' limits and k-th best scores.
                limit = np.array([float(min(w[0] if len(w[2]) < k else max(w[0], w[2][-1][0]) for w in windows[i])) for i in asked])
            for i in range(a.n):
                for w in windows[i]:
                    for score, found in w[2]:
                        out.append((int(anchors["block"].iloc[0]), a.width, i, int(w[3]["slot"]), w[3]["id"], int(w[3]["score"]), None if found == _NO_ID else found, _long(score)))
        got = pd.DataFrame(out, columns=["block", "width", "at", "slot", "other", "other_score", "id", "score"])
        return got.astype({"other": "Int64", "id": "Int64"})

    return run


WINDOWS = "array<struct<at:int,slot:int,id:bigint,score:bigint>>"
FOUND = "block long, width int, at int, slot int, other long, other_score long, id long, score long"


def _found(buckets: DataFrame, blocks: DataFrame, k: int, share, reach: Column) -> DataFrame:
    """What each block of anchors finds in the buckets it has to read (``reach``, on the block's ``need`` and the bucket's ``bucket, most``)."""
    count = buckets.groupBy("width").agg(F.count(F.lit(1)).alias("buckets"))
    asked = blocks.select("block", "width", "need").join(count, "width")
    asked = asked.select("block", "width", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    pairs = asked.join(buckets.select("width", "bucket", "most"), ["width", "bucket"]).where(reach).select("block", "width", "bucket", F.expr(f"bucket div {RUN}").alias("run"))
    pairs = stored(pairs, "bucket-pairs")
    left = buckets.join(pairs, ["width", "bucket"])
    right = blocks.join(pairs.select("block", "width", "run").distinct(), ["block", "width"])
    keys = ["width", "block", "run"]
    right = right.select(*[F.col(c).alias(f"a_{c}") for c in [*keys, "n", "most", "uid", "id", "label", "v", "windows"]])
    return left.groupBy(*keys).cogroup(right.groupBy(*[f"a_{c}" for c in keys])).applyInPandas(_search(k, share), FOUND)


def _kept(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over ``vec_id, label, embedding``.

    Anchors are the rows of ``is_anchor`` (on ``vec_id``); a negative's score lies between ``low`` and ``high``
    percent of the positive's.
    """
    rows = stored(whole_numbers(vectors), "whole-vectors")
    buckets = stored(_ranked(packed(rows, BUCKET), "bucket"), "buckets")
    blocks = stored(_ranked(packed(rows.where(F.coalesce(is_anchor, F.lit(False))), ANCHORS), "block"), "anchors")
    keys = ["width", "block", "at"]
    # Positives: the first buckets with no lower limit, the others with the k-th best score so far.
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("at"), F.lit(0).alias("slot"), F.lit(None).cast("long").alias("id"), F.lit(_LOW).alias("score")))
    started = blocks.withColumns({"windows": every.cast(WINDOWS), "need": F.lit(0.0)})
    first = stored(_found(buckets, started, positives, None, F.col("bucket") < FIRST), "first-positives")
    kth = _kept(first, keys, positives).where(F.col("rank") == positives).select(*keys, F.col("score").alias("kth"))
    places = stored(blocks.select("width", "block", "uid", "v").mapInPandas(_places, "width int, block long, at int, u long, norm double"), "places")
    # A bucket's largest norm must reach this for one of the block's anchors to find such a score in it.
    needs = lambda score: F.min(F.when(F.col("norm") > 0, score / F.col("norm")).otherwise(F.when(score > 0, F.lit(float("inf"))).otherwise(-1.0)))
    floors = places.join(kth, keys, "left").withColumn("kth", F.coalesce("kth", F.lit(_LOW)))
    floors = floors.groupBy("width", "block").agg(F.collect_list(F.struct("at", F.lit(0).alias("slot"), F.lit(None).cast("long").alias("id"), F.col("kth").alias("score"))).cast(WINDOWS).alias("windows"), needs(F.col("kth").cast("double")).alias("need"))
    reach = F.col("most") * SLACK >= F.col("need")
    rest = _found(buckets, blocks.join(floors, ["width", "block"]), positives, None, (F.col("bucket") >= FIRST) & reach)
    near = stored(_kept(first.unionByName(rest), keys, positives), "positives")
    # Negatives: one window for every positive.
    wanted = near.where("score >= 0").join(places, keys).groupBy("width", "block").agg(F.collect_list(F.struct("at", F.col("rank").alias("slot"), "id", "score")).cast(WINDOWS).alias("windows"), needs(F.col("score") * (low / 100.0)).alias("need"))
    found = _found(buckets, blocks.join(wanted, ["width", "block"]), negatives, (low, high), reach)
    best = _kept(found, [*keys, "slot"], negatives)
    names = rows.where(F.coalesce(is_anchor, F.lit(False)))
    anchors = places.join(names.select(F.col("uid").alias("u"), F.col("vec_id").alias("anchor_id")), "u")
    return best.join(anchors, keys).select("anchor_id", F.col("other").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("other_score").alias("positive_score"), F.col("score").alias("negative_score"))


def _places(batches):
    """The row ids and norms of packed blocks with their places."""
    for batch in batches:
        for width, block, uid, v in zip(batch["width"], batch["block"], batch["uid"], batch["v"]):
            u = np.frombuffer(uid, np.int64)
            x = np.frombuffer(v, np.float64).reshape(len(u), width)
            yield pd.DataFrame({"width": width, "block": block, "at": np.arange(len(u)), "u": u, "norm": np.sqrt((x * x).sum(1))})


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The contract's anchors (``vec_id`` divisible by 50) and labels (moved on by one where divisible by 7)."""
    with Scratch(embeddings.sparkSession) as scratch:
        vec, label = embeddings["vec_id"].cast("long"), embeddings["label"].cast("long")
        rows = embeddings.select(vec.alias("vec_id"), F.when(vec % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), embeddings["embedding"].cast("array<double>").alias("embedding"))
        return scratch.result(mine(rows, F.col("vec_id") % 50 == 0), "hard-negatives")
