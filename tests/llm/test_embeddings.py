"""Embedding near-duplicates against all pairs."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pytest

from depotcast.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, ball string, unit int"


def all_pairs(rows, threshold):
    usable = {}
    for key, vector, label in rows:
        v = None if vector is None or None in vector else np.array(vector, np.float32).astype(float)
        if label is not None and v is not None and len(v) and np.isfinite(v).all() and v.any():
            usable[key] = (label, v)
    links = []
    for a, b in combinations(usable, 2):
        (la, va), (lb, vb) = usable[a], usable[b]
        if la == lb and len(va) == len(vb) and va @ vb / math.sqrt(va @ va) / math.sqrt(vb @ vb) >= threshold:
            links.append((a, b))
    up = {key: key for key, _, _ in rows}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {k: (sum(k in x for x in links), top(k), top(k) == k) for k in up}


def result(spark, rows, **options):
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table, **options).collect()}


@pytest.mark.parametrize("spread", [0.002, 0.02, 0.035])
def test_links_equal_all_pairs(spark, spread):
    rng = np.random.default_rng(int(spread * 1000))
    rows = []
    for size in (1, 1, 2, 3, 12, 60):
        for label in (1, 2):
            centre = rng.standard_normal(32)
            centre /= np.linalg.norm(centre)
            rows += [((centre + spread * rng.standard_normal(32)) * rng.uniform(0.1, 9), label) for _ in range(size)]
    rows = [(int(k), v.tolist(), label) for k, (v, label) in zip(rng.permutation(len(rows)), rows, strict=True)]
    assert result(spark, rows) == all_pairs(rows, 0.98)


def test_vectors_that_link_with_nothing(spark):
    one = [1.0, 0.0, 2.0]
    rows = [
        (1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 2.0], 1),
        (9, [float("nan"), 0.0, 2.0], 1), (10, [float("inf"), 0.0, 2.0], 1), (11, [1.0, 0.0], 1), (12, [-1.0, 0.0, -2.0], 1), (13, [1e-30, 0.0, 2e-30], 1),
    ]
    got = result(spark, rows)
    assert got == {**{k: (0, k, True) for k in range(1, 13)}, 1: (2, 1, True), 2: (2, 1, False), 13: (2, 1, False)}


def test_repeated_rows_and_an_empty_table(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(table).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert embedding_dedup.near_duplicates(table.limit(0)).collect() == []


def test_the_plan_reaches_its_recall_and_does_not_grow_with_the_table():
    for n in (10, 5000, 10**6, 10**9):
        p = embedding_dedup.plan(n, 0.3)
        near = (1 - 0.3 / math.pi) ** p.bits * math.erf(embedding_dedup.WIDTH / math.sqrt(2))
        assert embedding_dedup._tail(p.lines, near, p.count) >= embedding_dedup.RECALL and n / 2**p.bits <= embedding_dedup.SIDE_SHARE


def test_copies_behind_other_leaders_are_few_balls(spark, monkeypatch):
    """Exact and near copies with the largest ids of their label: no pairs of theirs are formed."""
    rng = np.random.default_rng(8)
    others, centre = rng.standard_normal((600, 32)), rng.standard_normal(32)
    near = centre + 0.002 * rng.standard_normal((300, 32)) * np.linalg.norm(centre) / math.sqrt(32)
    rows = [(k, v.tolist(), 1) for k, v in enumerate([*others, *near])] + [(1000 + k, centre.tolist(), 1) for k in range(300)]
    seen = []
    plain = embedding_dedup._collisions
    monkeypatch.setattr(embedding_dedup, "_collisions", lambda balls, plan_: seen.append(balls.count()) or plain(balls, plan_))
    assert result(spark, rows) == all_pairs(rows, 0.98)
    assert seen[0] <= 600 + 60  # of 601 different places, not 1200 rows


def test_rows_that_share_a_key_share_one_result(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, [0.0, 1.0], 1), (0, [1.0, 0.0], 1)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = sorted({tuple(r) for r in embedding_dedup.near_duplicates(table).collect()})
    assert [r for r in got if r[0] == 1] == [(1, 2, 0, False)]


def test_recall_at_the_threshold_among_many_vectors_of_a_label(spark):
    """12,000 vectors of one label with 3000 pairs at cosines from 0.98 to 0.985, against all pairs."""
    rng = np.random.default_rng(9)
    one = rng.standard_normal((12_000, 32))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    for k in range(3000):
        across = rng.standard_normal(32)
        across -= across @ one[2 * k] * one[2 * k]
        cosine = rng.uniform(0.98005, 0.985)
        one[2 * k + 1] = cosine * one[2 * k] + math.sqrt(1 - cosine**2) * across / np.linalg.norm(across)
    one = one.astype(np.float32)
    wide = one.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    want = np.concatenate([(wide[i : i + 2000] @ wide.T >= 0.98).sum(axis=1) - 1 for i in range(0, len(wide), 2000)])
    got = result(spark, [(k, v.tolist(), 1) for k, v in enumerate(one)])
    found = np.array([got[k][0] for k in range(len(one))])
    assert want.sum() >= 6000 and (found <= want).all() and found.sum() >= 0.999 * want.sum()
