"""Near-duplicate documents by Order MinHash.

A text is its sequence of five-word k-mers, each labelled with its occurrence number.
One sketch takes the ``PICKED`` smallest k-mers under a hash and keeps them in text
order, so two texts share a sketch only when the sampled k-mers stand in the same
order in both: it follows edit similarity, not just set overlap.  ``ROWS`` sketches make
a band; texts that share a band are candidates.

Candidates are verified by banded alignment of their plain k-mers: similarity is the
length of the longest common subsequence over the number of k-mers of both less that
length (aligned Jaccard).  Labelled k-mers are unique in a text, so their longest chain
that rises in both is found quickly; it is a lower bound, as a repeated line that only
one text holds shifts all later labels of that line.  Pairs it does not settle are
aligned exactly, within the band of offsets that the threshold allows.

No pairs of a group are spelled out.  Equal texts become one node.  In each band each
node is verified against one leader, the node whose bands are most common; after
components of those links, only nodes outside a band's largest component are compared
with the band's nodes of other components, in blocks that return links alone.  So every
link between different components of a band is looked at, and a group of thousands of
copies costs one comparison each.  Pairs whose lengths rule a link out never meet: a
band's nodes are dealt by the logarithm of their length, and a node asks the classes of
length next to its own only; a pair that shares several bands is looked at in the first.

Rows are told apart by digest and ``doc_id``, so texts are read where they are and never
numbered or copied; intermediate tables go when the classes are written.

Defined results: a null text counts as empty; equal texts (empty ones too) are one
class; a text of fewer than five words is one k-mer; repeated rows share their class;
a class is told by ``component``, the smallest digest of its texts, as ``doc_id`` may be
null or repeated on different texts; one row of each class is kept, the one with the
smallest ``doc_id``, nulls last; ``doc_id`` and ``text`` are read, other columns may have
any name.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depthline.llm.common import Scratch, mix, stored, text_of, word_hashes
from depthline.llm.components import components

WORDS = 5
BANDS, ROWS, PICKED = 16, 2, 2
SIMILARITY = 0.8
#: Nodes of a band compared at a time.
BLOCK = 512


def labelled_kmers(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-labelled k-mers of all texts, in order, and each text's bounds."""
    _, labelled, bounds = plain_and_labelled_kmers(texts)
    return labelled, bounds


def plain_and_labelled_kmers(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-mers of all texts, in order, plain and occurrence-labelled, and each text's bounds."""
    h, bounds = word_hashes(texts)
    sizes = np.diff(bounds)
    counts = np.where(sizes >= WORDS, sizes - WORDS + 1, np.minimum(sizes, 1))
    ends = np.cumsum(counts)
    out_bounds = np.concatenate(([0], ends))
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), out_bounds
    doc = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(int(ends[-1])) - np.repeat(out_bounds[:-1], counts) + np.repeat(bounds[:-1], counts)
    last = np.repeat(bounds[1:], counts)
    kmers = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        inside = at + k < last
        word = np.where(inside, h[np.minimum(at + k, len(h) - 1)], np.uint64(0))
        kmers = mix(kmers * np.uint64(0x100000001B3) + word)
    own = kmers ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(own, kind="stable")
    same = own[order]
    fresh = np.concatenate(([True], same[1:] != same[:-1]))
    group = np.flatnonzero(fresh)
    seen = np.arange(len(order)) - np.repeat(group, np.diff(np.concatenate((group, [len(order)]))))
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = seen
    return kmers, mix(kmers + occurrence * np.uint64(0x9E3779B97F4A7C15)), out_bounds


def band_keys(texts, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of k-mers and ``[text, band]`` keys; keys of texts without words are zero."""
    kmers, bounds = labelled_kmers(texts)
    n = len(bounds) - 1
    keys = np.zeros((n, BANDS), np.uint64)
    sizes = np.diff(bounds)
    some = np.flatnonzero(sizes)
    # Some texts at a time, so that their k-mers stay in the processor's cache.
    lo = 0
    while lo < len(some):
        hi = int(np.searchsorted(bounds[some + 1], bounds[some[lo]] + 50_000, "right"))
        hi = max(hi, lo + 1)
        part = some[lo:hi]
        x = kmers[bounds[part[0]] : bounds[part[-1] + 1]]
        starts = bounds[part] - bounds[part[0]]
        count = sizes[part]
        for band in range(BANDS):
            for row in range(ROWS):
                salt = mix(np.array([seed * 1000 + band * ROWS + row + 1], np.uint64))[0]
                v = (x ^ salt) * np.uint64(0xD6E8FEB86659FD93)
                v ^= v >> np.uint64(32)
                picked = []
                for _ in range(PICKED):
                    least = np.minimum.reduceat(v, starts)
                    found = np.flatnonzero(v == np.repeat(least, count))
                    first = found[np.searchsorted(found, starts)]
                    picked.append((first, least))
                    v[first] = np.uint64(0xFFFFFFFFFFFFFFFF)
                (a, va), (b, vb) = picked
                one = count == 1
                va, vb = np.where(one | (a <= b), va, vb), np.where(one, va, np.where(a <= b, vb, va))
                sketch = mix(va * np.uint64(3) + mix(vb + np.uint64(row + 7)))
                keys[part, band] = mix(keys[part, band] + sketch)
        lo = hi
    return sizes, keys


def alignment_similarity(a: np.ndarray, b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Aligned Jaccard of two sequences of labelled k-mers; 0 where it must be under ``threshold``.

    Of texts with repeated k-mers this is a lower bound of the similarity of the texts.

    A chain of M matches has similarity M / (n + m - M), so one that reaches the
    threshold leaves at most n + m - 2 M k-mers unmatched, which bounds how far
    matching places can be apart: the band.
    """
    n, m = len(a), len(b)
    if n == 0 or m == 0:
        return 1.0 if n == m else 0.0
    need = threshold * (n + m) / (1 + threshold)
    if min(n, m) < need - 1e-9:
        return 0.0
    band = int(n + m - 2 * need) + 1
    order = np.argsort(b)
    at = np.searchsorted(b[order], a)
    at[at == m] = 0
    j = order[at]
    i = np.flatnonzero(b[j] == a)
    j = j[i]
    near = np.abs(i - j) <= band
    j = j[near]
    if len(j) < need - 1e-9:
        return 0.0
    if (j[1:] > j[:-1]).all():
        chain = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        chain = len(tails)
    return chain / (n + m - chain)


def common_length(x: np.ndarray, y: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence; where it is under ``least``, a lower bound of it.

    Places are the bits of one integer, a step takes one item of ``x``.  A subsequence of
    ``least`` items leaves few others unmatched, which bounds how far matching places can
    be apart; only this band of bits is held.
    """
    k = min(len(x), len(y))
    differ = np.flatnonzero(x[:k] != y[:k])
    head = int(differ[0]) if len(differ) else k
    x, y, k = x[head:], y[head:], k - head
    differ = np.flatnonzero(x[len(x) - k :][::-1] != y[len(y) - k :][::-1])
    tail = int(differ[0]) if len(differ) else k
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    n, m, found, least = len(x), len(y), head + tail, max(least - head - tail, 0)
    if min(n, m) < max(least, 1):
        return found
    places: dict[int, list[int]] = {}
    for j, c in enumerate(y.tolist()):
        places.setdefault(c, []).append(j)
    common = {c: sum(1 << j for j in at) for c, at in places.items() if len(at) > 16}
    bits, low, high, full = 0, 0, 0, 0
    for i, c in enumerate(x.tolist()):
        if high < min(i + m - least + 1, m):
            grown = min(i + m - least + 64, m)
            bits |= ((1 << (grown - high)) - 1) << (high - low)
            high = grown
            full = (1 << (high - low)) - 1
        if i - (n - least) - low >= 64:
            gone = i - (n - least) - low
            found += gone - (bits & ((1 << gone) - 1)).bit_count()
            bits >>= gone
            low += gone
            full >>= gone
        if c in common:
            here = (common[c] >> low) & full
        else:
            here = sum(1 << (j - low) for j in places.get(c, ()) if low <= j < high)
        if here:
            match = bits & here
            bits = ((bits + match) | (bits - match)) & full
    return found + high - low - bits.bit_count()


def text_similarity(a: np.ndarray, b: np.ndarray, plain_a: np.ndarray, plain_b: np.ndarray, threshold: float = SIMILARITY) -> float:
    """Aligned Jaccard of two texts, given their labelled and plain k-mers.

    At or over ``threshold`` a lower bound that reaches it may stand for the value, under it any lower value.
    """
    quick = alignment_similarity(a, b, threshold)
    n, m = len(a), len(b)
    need = threshold * (n + m) / (1 + threshold)
    if quick >= threshold - 1e-12 or min(n, m) < max(need - 1e-9, 1):
        return quick
    # Equal labels count what both hold, in any order; the alignment cannot hold more.
    if len(np.intersect1d(a, b, assume_unique=True)) < need - 1e-9:
        return quick
    x, y = plain_a[np.isin(plain_a, plain_b)], plain_b[np.isin(plain_b, plain_a)]
    if len(np.unique(x)) == len(x) and len(np.unique(y)) == len(y):
        return quick
    length = common_length(x, y, int(np.ceil(need - 1e-9)))
    return length / (n + m - length)


def _signed(texts: DataFrame) -> DataFrame:
    """``node, size, bands`` of each text: its digest, number of k-mers and band keys."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.iloc[lo : lo + 1024]
                sizes, keys = band_keys(part["t"].tolist())
                yield pd.DataFrame({"node": part["node"].to_numpy(), "size": sizes, "bands": list(keys.view(np.int64))})

    return texts.mapInPandas(run, "node string, size long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs ``u, v`` whose texts reach the threshold."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                both, where = pd.factorize(pd.concat([part["tu"], part["tv"]], ignore_index=True))
                plain, kmers, bounds = plain_and_labelled_kmers(where.tolist())
                k = len(part)
                of = [slice(lo, hi) for lo, hi in zip(bounds[:-1], bounds[1:])]
                good = [text_similarity(kmers[of[x]], kmers[of[y]], plain[of[x]], plain[of[y]], threshold) >= threshold - 1e-12 for x, y in zip(both[:k], both[k:])]
                yield part.loc[np.array(good, bool), ["u", "v"]]

    left = texts.select(F.col("node").alias("u"), F.col("t").alias("tu"))
    right = texts.select(F.col("node").alias("v"), F.col("t").alias("tv"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv").mapInPandas(run, "u string, v string")


def _length_class(size, threshold: float):
    """Linked texts lie in the same length class or in neighbouring ones.

    A link at similarity s needs min / max >= s of the numbers of k-mers.
    """
    return F.floor(F.log(size) / F.lit(np.log(1 / max(threshold - 0.01, 0.01)))).cast("int")


def _compared(placed: DataFrame, minor: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between a band's smaller components and all its other nodes, compared block by block.

    A block holds at most about ``BLOCK`` nodes of each side, whatever the size of the band.
    Shared k-mers are counted through the block's own index of k-mers; only pairs that
    share enough are aligned, and only links leave the task.
    """
    keys = ["band", "key", "length"]
    placed = placed.withColumn("length", _length_class(F.col("size"), threshold))
    less = placed.join(minor, ["band", "key", "component"], "left_semi").withColumn("own", F.col("length"))
    less = less.withColumn("length", F.explode(F.array(*[F.col("own") + d for d in (-1, 0, 1)])))
    load = less.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qs")).join(placed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("ps"), F.min("component").alias("c0"), F.max("component").alias("c1")), keys)
    spread = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A group that is all of one component has nothing to ask a node of that component.
    few = less.join(load, keys).where(~((F.col("c0") == F.col("component")) & (F.col("c1") == F.col("component"))))
    load = load.join(few.select(*keys).distinct(), keys, "left_semi")
    all_ = placed.join(load, keys).join(texts, "node").select(*keys, spread("ps").alias("p"), copies("qs").alias("q"), "node", "component", "bands", "t")
    few = few.join(texts, "node").select(*[F.col(k).alias(f"x{k}") for k in keys], copies("ps").alias("xp"), spread("qs").alias("xq"), F.col("node").alias("xnode"), F.col("component").alias("xcomponent"), F.col("bands").alias("xbands"), F.col("t").alias("xt"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str]] = []
        if len(left) and len(right):
            names, places = left["node"].to_numpy(), left["component"].to_numpy()
            band, held = int(left["band"].iloc[0]), np.stack(left["bands"].to_numpy())
            asking = np.stack(right["xbands"].to_numpy())
            # Pairs of different components whose first common band this one is.
            wanted = [np.flatnonzero((places != place) & ~(held[:, :band] == asked_[:band]).any(1)) for place, asked_ in zip(right["xcomponent"], asking)]
            some = np.flatnonzero([len(w) > 0 for w in wanted])
            if not len(some):
                return pd.DataFrame(out, columns=["u", "v"], dtype="str")
            plain, kmers, bounds = plain_and_labelled_kmers(left["t"].tolist())
            sizes = np.diff(bounds)
            order = np.argsort(kmers, kind="stable")
            listed, holder = kmers[order], np.repeat(np.arange(len(names)), sizes)[order]
            plain_asked, asked, ends = plain_and_labelled_kmers(right["xt"].iloc[some].tolist())
            for i, k in enumerate(some.tolist()):
                mine = asked[ends[i] : ends[i + 1]]
                lo, hi = np.searchsorted(listed, mine, "left"), np.searchsorted(listed, mine, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
                common = np.bincount(holder[at], minlength=len(names))[wanted[k]]
                near = wanted[k][common >= threshold * (len(mine) + sizes[wanted[k]]) / (1 + threshold) - 1e-9]
                name = right["xnode"].iloc[k]
                for j in near.tolist():
                    other = slice(bounds[j], bounds[j + 1])
                    if text_similarity(mine, kmers[other], plain_asked[ends[i] : ends[i + 1]], plain[other], threshold) >= threshold - 1e-12:
                        out.append((max(name, names[j]), min(name, names[j])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="str")

    return all_.groupBy(*keys, "p", "q").cogroup(few.groupBy(*[f"x{k}" for k in keys], "xp", "xq")).applyInPandas(run, "u string, v string").distinct()


def _row_keys(docs: DataFrame) -> list:
    """What tells rows apart: the text's digest and ``doc_id``."""
    return [F.md5(text_of(docs)).alias("node"), docs["doc_id"].cast("long").alias("doc_id")]


def _links(docs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """``node, component`` of all texts that link with another text."""
    source = docs.select(*_row_keys(docs), text_of(docs).alias("t"))
    signed = stored(_signed(source.select("node", "t")).dropDuplicates(["node"]).where("size > 0"), "omh-signed")
    bands = signed.select("node", F.posexplode("bands").alias("band", "key"))
    sizes = bands.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(bands.join(sizes, ["band", "key"]).select("band", "key", "node", "n"), "omh-shared")
    # The node whose bands are the most common ones is nearest to the middle of its group.
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    leaders = shared.join(weight, "node").groupBy("band", "key").agg(F.max(F.struct("weight", "node"))["node"].alias("v"))
    grouped = stored(shared.join(leaders, ["band", "key"]).select("band", "key", F.col("node").alias("u"), "v"), "omh-grouped")
    stars = stored(grouped.where("u <> v").select("u", "v").distinct(), "omh-stars")
    wanted = stars.select(F.col("u").alias("node")).union(stars.select(F.col("v").alias("node"))).distinct()
    # One row of each text that is wanted: few copies are left by doc_id, the rest by the digest.
    firsts = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node", "left_semi")
    one = source.alias("s").join(firsts.alias("f"), (F.col("s.node") == F.col("f.node")) & F.col("s.doc_id").eqNullSafe(F.col("f.doc_id")), "left_semi").select("node", "t").dropDuplicates(["node"])
    texts = stored(one, "omh-texts")
    links = stored(_verified(stars, texts, similarity), "omh-links")
    found = components(links)
    # What a band holds outside its largest component still meets the band's other components.
    placed = grouped.select("band", "key", F.col("u").alias("node")).join(found, "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("band", "key").orderBy(F.desc("n"), "component")
    minor = stored(sizes.withColumn("place", F.row_number().over(order)).where("place > 1").select("band", "key", "component"), "omh-minor")
    split = stored(placed.join(minor.select("band", "key").distinct(), ["band", "key"], "left_semi").join(signed, "node").select("band", "key", "node", "component", "size", "bands"), "omh-split")
    more = stored(_compared(split, minor, texts, similarity), "omh-more")
    return components(links.union(more)) if more.limit(1).count() else found


def _nodes(docs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Per different text ``node, component, class_id, keep_node, keep_doc, copies``.

    ``keep_*`` name the row that stands for the class, ``copies`` says how many rows have that name.
    """
    texts = rows.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")).alias("first"))
    placed = texts.join(_links(docs, rows, similarity), "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("keep"))
    return placed.join(smallest, "component").select("node", "component", F.col("keep.doc_id").alias("class_id"), F.col("keep.node").alias("keep_node"), F.col("keep.doc_id").alias("keep_doc"), F.col("keep.n").alias("copies"))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, component, kept`` for every row.

    ``component`` tells classes apart; ``class_id`` is the smallest ``doc_id`` of the class,
    which different classes may share; ``kept`` holds for one row of each class.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = stored(docs.select(F.monotonically_increasing_id().alias("uid"), *_row_keys(docs)), "omh-rows")
        nodes = stored(_nodes(docs, rows, similarity), "omh-nodes")
        named = rows.join(nodes, "node").withColumn("named", (F.col("node") == F.col("keep_node")) & F.col("doc_id").eqNullSafe(F.col("keep_doc")))
        # Of rows that repeat digest and doc_id the one with the smallest number stands for the class.
        first = rows.join(nodes.where("copies > 1 AND node = keep_node"), "node").where(F.col("doc_id").eqNullSafe(F.col("keep_doc"))).groupBy("node").agg(F.min("uid").alias("first_uid"))
        kept = named.join(first, "node", "left").select("doc_id", "class_id", "component", (F.col("named") & (F.col("first_uid").isNull() | (F.col("uid") == F.col("first_uid")))).alias("kept"))
        return scratch.result(kept, "omh-classes")


def near_duplicate_report(docs: DataFrame, **options) -> DataFrame:
    """Per row ``doc_id``, its class and whether it stands for the class."""
    return near_duplicate_classes(docs, **options).select("doc_id", "class_id", "component", "kept")


def deduplicate(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, the one with the smallest ``doc_id``, nulls last.

    Rows that repeat both text and ``doc_id`` are one row with the columns of any of them.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = stored(docs.select(*_row_keys(docs)), "omh-rows")
        keep = scratch.result(_nodes(docs, rows, similarity).where("node = keep_node").select("keep_node", "keep_doc", "copies"), "omh-keep")
    node, doc = _row_keys(docs)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), node.alias("_node"), doc.alias("_doc"))
    named = lambda k: (F.col("_node") == k["keep_node"]) & F.col("_doc").eqNullSafe(k["keep_doc"])
    once, often = keep.where("copies = 1"), keep.where("copies > 1")
    out = packed.join(once, named(once), "left_semi").select("_row")
    if often.limit(1).count():
        out = out.unionByName(packed.join(often, named(often), "left_semi").groupBy("_node", "_doc").agg(F.first("_row").alias("_row")).select("_row"))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
