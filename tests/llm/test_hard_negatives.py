import math
import random

import numpy as np

from depthline.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score double, uid long, n int"


def brute(rows):
    """All anchors against all rows, in Python's integers."""
    held = []
    for vec, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        held.append((vec, [math.floor(256.0 * x) for x in e], (label + 1) % 10 if vec is not None and vec % 7 == 0 else label))
    out = []
    for i, (vec, a, label) in enumerate(held):
        if vec is None or vec % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), float("inf") if v is None else v, other == label) for j, (v, b, other) in enumerate(held) if j != i and len(a) == len(b))
        for minus, p, _ in [s for s in scored if s[2]][:5]:
            for rank, (m, n, _) in enumerate([s for s in scored if not s[2] and -50 * minus <= -100 * s[0] <= -95 * minus][:3]):
                out.append((vec, None if p == float("inf") else p, rank + 1, None if n == float("inf") else n, -minus, -m))
    return sorted(out, key=repr)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 0.5, 1, 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in hard_negatives.hard_negatives(df).collect()), key=repr)


def test_negatives_match_brute_force_with_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 37)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(4)
    lengths = rng.lognormal(0, 1.5, 700)
    rows = [(int(i), (rng.normal(size=6) * lengths[i] / 8).tolist(), int(rng.integers(0, 4))) for i in range(700)]
    assert mined(spark, rows) == brute(rows) and len(brute(rows)) > 60


def test_negatives_with_nulls_ties_repeats_widths_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BUCKET", 16)
    rng = random.Random(5)
    rows = [(i, [float(rng.choice([1, 1, 2])) for _ in range(3)], i % 3) for i in range(120)]
    rows += [(50, [1.0, 1.0, 2.0], 2)] * 2 + [(7, [1.0, 1.0, 1.0], 1)] * 9
    rows += [(None, [1.0, 2.0, 1.0], 1), (200, None, 1), (250, [1.0, None, 1.0], 1), (300, [math.nan, 1.0, 1.0], 1), (350, [1.0, 1.0, 1.0], None), (400, [0.0, 0.0, 0.0], 1), (450, [], 1), (451, [], 1), (452, [], 2)]
    rows += [(1000 + i, [4e6 + rng.random(), 4e6 * rng.random()], i % 2) for i in range(0, 120, 5)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []


def test_buckets_that_cannot_reach_a_window_are_not_read(spark, monkeypatch):
    read = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(hard_negatives, "BUCKET", 20)
    monkeypatch.setattr(hard_negatives, "RUN", 1)
    whole = hard_negatives._search

    def counted(k, share):
        run = whole(k, share)

        def count(key, buckets, anchors):
            read.add(len(buckets))
            return run(key, buckets, anchors)

        return count

    monkeypatch.setattr(hard_negatives, "_search", counted)
    # Norms fall fast, so only the first buckets can matter.
    rows = [(i, [2.0 ** (-i / 60), 2.0 ** (-i / 60) * ((i % 5) / 5)], i % 2) for i in range(400)]
    assert mined(spark, rows) == brute(rows)
    assert read.value < 30  # of some 40 in all
