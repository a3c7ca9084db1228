"""Embedding near-duplicates by an inverted multi-index.

Vectors are cut into halves, each half has its own codebook (k-means on a sample of
``SAMPLE`` vectors, more for finer grids and ``MOST_SAMPLED`` at most), and the pair of nearest codewords is a vector's cell of the
product grid.  Every vector is posted in its cell and, as a query, visits the cells
nearest to it in multi-sequence order (by the sum of both halves' distances).  How
many is calibrated: sampled vectors are moved to exactly the threshold's cosine, and
enough cells are visited that ``recall`` of the moved ones are found.  A pair counts when
either of the two finds the other, and is verified by its cosine in double precision.

Equal vectors of a label are one entry with a count.  A cell's postings and its
queries are dealt over a grid of blocks of at most ``BLOCK`` and ``QUERIES`` rows, so no
task holds a whole cell; tasks return sums of links and a spanning forest, not pairs.

Defined results: vectors that are null, zero or hold null or non-finite components,
and vectors without a label, link with nothing; repeated rows are separate vectors; an
empty table gives an empty table; vectors of unequal length never link; components keep the
precision of the input.  Only ``vec_id``, ``embedding`` and ``label`` are read, so other columns
may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depthline.llm.common import Scratch, stored
from depthline.llm.components import components

SAMPLE, MOST_SAMPLED = 4096, 65_536
#: Cells that calibration looks at; a grid that needs more is made coarser.
MOST_VISITS = 4096
BLOCK, QUERIES = 2048, 8192
PER_CELL = 96


def unit(rows) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)).argmin(1)
        for i in range(len(centres)):
            if (near == i).any():
                centres[i] = x[near == i].mean(0)
    return centres


class MultiIndex:
    """Two codebooks and the number of cells a query visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1):
        self.first, self.second, self.visits = first, second, visits

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        a, b = x[:, :h], x[:, h:]
        far = lambda p, c: (p**2).sum(1)[:, None] - 2 * p @ c.T + (c**2).sum(1)
        return far(a, self.first), far(b, self.second)

    def traverse(self, x: np.ndarray, visits: int) -> np.ndarray:
        """``[vector, visit]`` cells in multi-sequence order, the own cell first.

        Cells are taken from the nearest codewords of both halves: a cell among the
        first ``visits`` has ranks r, s with (r + 1)(s + 1) <= visits.
        """
        da, db = self.distances(x)
        ka, kb = len(self.first), len(self.second)
        oa, ob = np.argsort(da, axis=1)[:, :visits], np.argsort(db, axis=1)[:, :visits]
        r, s = np.divmod(np.arange(oa.shape[1] * ob.shape[1]), ob.shape[1])
        good = (r + 1) * (s + 1) <= visits
        r, s = r[good], s[good]
        sa, sb = np.take_along_axis(da, oa, 1), np.take_along_axis(db, ob, 1)
        order = np.argsort(sa[:, r] + sb[:, s], axis=1, kind="stable")[:, : min(visits, ka * kb)]
        cells = np.take_along_axis(oa, r[order], 1) * kb + np.take_along_axis(ob, s[order], 1)
        return cells

    def calibrate(self, x: np.ndarray, cosine: float, recall: float, rng: np.random.Generator) -> bool:
        """Set the visits; False where ``recall`` would take more than ``MOST_VISITS``."""
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(1, keepdims=True) * x
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        moved = cosine * x + math.sqrt(1 - cosine**2) * noise
        limit = min(len(self.first) * len(self.second), MOST_VISITS)
        ranks = []
        for lo in range(0, len(x), 64):
            there, back = self.traverse(x[lo : lo + 64], limit), self.traverse(moved[lo : lo + 64], limit)
            place = lambda cells, own: np.where((cells == own).any(1), (cells == own).argmax(1), limit)
            ranks.append(np.minimum(place(there, back[:, :1]), place(back, there[:, :1])))
        need = int(np.quantile(np.concatenate(ranks), recall, method="higher"))
        self.visits = min(limit, need + 1)
        return need < limit


def _is_valid():
    e = F.col("embedding")
    return e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0) & F.col("label").isNotNull()


def build_index(entries: DataFrame, labels: int, cosine: float, recall: float, seed: int = 3) -> MultiIndex:
    """Codebooks and visits from at most ``SAMPLE`` entries; the grid's size follows the number of entries."""
    n = entries.count()
    want = max(1, round(math.sqrt(n / (max(labels, 1) * PER_CELL))))
    sample = entries.orderBy(F.xxhash64("id")).limit(min(max(SAMPLE, 16 * want), MOST_SAMPLED)).select("embedding").collect()
    rng = np.random.default_rng(seed)
    x = unit([r["embedding"] for r in sample])
    k = min(want, max(1, len(x) // 8))
    h = max(1, x.shape[1] // 2)
    while True:
        index = MultiIndex(codebook(x[:, :h], k, rng), codebook(x[:, h:], k, rng) if x.shape[1] > h else np.zeros((1, 0)))
        if index.calibrate(x[:1024], cosine, recall, rng) or k == 1:
            return index
        k //= 2


def _match(cosine: float):
    """One block of a cell's postings against one block of its queries."""

    def run(postings: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        queries = queries.rename(columns=lambda c: c.removeprefix("q_"))
        empty = pd.DataFrame({"id": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
        if not len(postings) or not len(queries):
            return empty
        p, ids, n = unit(postings["embedding"]), postings["id"].to_numpy(), postings["n"].to_numpy()
        visits = np.stack(postings["visits"].to_numpy()).astype(np.int64)
        wide = max(int(visits.max()), int(queries["own"].max())) + 1
        # What a posting visits, as sorted (posting, cell) keys.
        seen = np.sort((np.arange(len(p))[:, None] * wide + visits).ravel())
        back = np.zeros(len(p), np.int64)
        label = ids.copy()
        rows, pairs = [], []
        for lo in range(0, len(queries), 1024):
            part = queries.iloc[lo : lo + 1024]
            q, qid, qn, own = unit(part["embedding"]), part["id"].to_numpy(), part["n"].to_numpy(), part["own"].to_numpy()
            hit = (q @ p.T >= cosine) & (qid[:, None] != ids[None, :])
            any_hit = hit.any(1)
            if not any_hit.any():
                continue
            hit, qid, qn, own = hit[any_hit], qid[any_hit], qn[any_hit], own[any_hit]
            rows.append((qid, hit @ n))
            # The posting finds the query itself where it visits the query's cell.
            i, j = np.nonzero(hit)
            asked = j * wide + own[i]
            at = np.minimum(np.searchsorted(seen, asked), len(seen) - 1)
            new = seen[at] != asked
            back += np.bincount(j[new], weights=qn[i[new]], minlength=len(p)).astype(np.int64)
            pairs.append((qid, hit))
        if not pairs:
            return empty
        at = [label[h.argmax(1)] for _, h in pairs]
        while True:
            before = label.copy()
            for k, (qid, h) in enumerate(pairs):
                at[k] = np.minimum(np.where(h, label[None, :], np.iinfo(np.int64).max).min(1), np.minimum(qid, at[k]))
                label = np.minimum(label, np.where(h, at[k][:, None], np.iinfo(np.int64).max).min(0))
            if (label == before).all():
                break
        out = [pd.DataFrame({"id": qid, "root": at[k], "links": links_}) for k, ((qid, links_), _) in enumerate(zip(rows, pairs))]
        touched = (back > 0) | np.logical_or.reduce([h.any(0) for _, h in pairs])
        out.append(pd.DataFrame({"id": ids[touched], "root": label[touched], "links": back[touched]}))
        return pd.concat(out, ignore_index=True).astype("int64")

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.995, seed: int = 3) -> DataFrame:
    """Per vector ``vec_id, n_links, component_id, kept``."""
    with Scratch(vectors.sparkSession) as scratch:
        return scratch.result(_near_duplicates(vectors, cosine, recall, seed), "vector-classes")


def _near_duplicates(vectors: DataFrame, cosine: float, recall: float, seed: int) -> DataFrame:
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast(kind).alias("embedding"), vectors["label"].cast("string").alias("label"))
    good = rows.where(F.coalesce(_is_valid(), F.lit(False))).withColumn("key", F.xxhash64("label", "embedding"))
    entries = stored(good.groupBy("key", "label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()).withColumn("width", F.size("embedding")), "vectors")
    labels = entries.select("label").distinct().count()
    if not labels:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    widths = [r["width"] for r in entries.groupBy("width").count().orderBy(F.desc("count")).collect()]
    found = None
    for width in widths:
        part = entries.where(F.col("width") == width)
        index = build_index(part, labels, cosine, recall, seed)

        def post(batches, index=index):
            for batch in batches:
                if len(batch):
                    batch["visits"] = list(index.traverse(unit(batch["embedding"]), index.visits).astype(np.int32))
                    yield batch

        posted = stored(part.select("id", "n", "label", "embedding").mapInPandas(post, f"id long, n long, label string, embedding {kind}, visits array<int>"), "posted")
        postings = posted.withColumn("cell", F.col("visits")[0])
        asked = posted.select("label", F.explode("visits").alias("cell"), "id")
        load = postings.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ps")).join(asked.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qs")), ["label", "cell"])
        left = postings.join(load, ["label", "cell"]).select("label", "cell", "id", "n", "embedding", "visits", F.pmod(F.xxhash64("id"), F.col("ps")).cast("int").alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"))
        queries = posted.select("label", "id", "n", "embedding", F.col("visits")[0].alias("own"), F.explode("visits").alias("cell"))
        right = queries.join(load, ["label", "cell"]).select("label", "cell", "id", "n", "embedding", "own", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), F.pmod(F.xxhash64("id", F.lit(9)), F.col("qs")).cast("int").alias("q"))
        keys = ["label", "cell", "p", "q"]
        right = right.select(*[F.col(c).alias(f"q_{c}") for c in right.columns])
        pairs = left.groupBy(*keys).cogroup(right.groupBy(*[f"q_{k}" for k in keys])).applyInPandas(_match(cosine), "id long, root long, links long")
        found = pairs if found is None else found.unionByName(pairs)
    found = stored(found, "vector-links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    placed = entries.join(joined, entries["id"] == joined["node"], "left").select("key", "label", "embedding", "first", "n", "id", F.coalesce("component", "id").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    entry = placed.join(least, "component").join(links, "id", "left").select("key", F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    entry = stored(entry, "vector-entries")
    mine = good.join(entry, (good["key"] == entry["key"]) & (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e"))).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(_is_valid(), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return mine.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
