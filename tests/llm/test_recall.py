"""Planted cases: near copies of the deduplication stage, and why a plain tree cannot prune."""

import random

import numpy as np

from palimpsest.llm import simhash
from palimpsest.llm.common import read


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def test_near_copies_are_caught_and_others_stay(spark):
    """Of texts that share 0.8 or more of their five-word shingles nine in ten go; unlike ones stay."""
    rng = random.Random(12)
    source = [r.text for r in read(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 700").orderBy("doc_id").limit(260).collect()]
    source = [t for i, t in enumerate(source) if len(shingles(t)) > 0.6 * len(t.split()) and not any(len(shingles(t) & shingles(o)) > 3 for o in source[:i])]
    rows, near = list(enumerate(source)), []
    for i, text in enumerate(source):
        words = text.split()
        for _ in range(rng.randrange(1, 1 + max(1, len(words) // 50))):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = [rng.choice(["changed", "word", "here"])] * rng.randrange(1, 3)
        copy = " ".join(words)
        a, b = shingles(text), shingles(copy)
        if len(a & b) >= 0.8 * len(a | b):
            near.append(10_000 + i)
            rows.append((10_000 + i, copy))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 60 and len(source) > 80
    assert sum(d not in kept for d in near) >= 0.9 * len(near)
    assert all(i in kept for i in range(len(source)))


def test_distances_crowd_about_the_middle():
    """The figures behind the shards: with radius 4 about two thirds of random fingerprints go down both sides."""
    rng = np.random.default_rng(1)
    points = rng.integers(0, 2**63, 20_000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 20_000, dtype=np.uint64)
    far = np.bitwise_count(points[1:] ^ points[0]).astype(int)
    assert abs(far.mean() - 32) < 0.2 and abs(far.std() - 4) < 0.2
    both = np.mean(np.abs(far - np.median(far)) <= 4)
    assert 0.6 < both < 0.8
