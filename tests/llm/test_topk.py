from __future__ import annotations

import math

import numpy as np
import pytest

from quillspark.llm import topk

SCHEMA = "vec_id long, embedding array<double>, q string, b int, label int"


def brute(rows, k, every):
    """The contract by all pairs."""
    fine = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    held = lambda x: max(-topk.LARGEST, min(topk.LARGEST, x))
    whole = [(i, tuple(held(math.floor(64 * x)) for x in v)) for i, v in fine]
    whole = sorted(set(whole))
    out = []
    for i, v in whole:
        if i % every == 0:
            scored = sorted((-held(sum(a * b for a, b in zip(v, w, strict=True))), j) for j, w in whole if j != i and len(w) == len(v))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def result(spark, rows, k=20, every=20):
    df = topk.exact_topk(spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA), k, every)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(topk, "BLOCK", 97)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 11)
    monkeypatch.setattr(topk, "TILE", 4)
    rng = np.random.default_rng(seed)
    scale = [0.3, 30.0, 1e5][seed]
    rows = [(n, (rng.standard_normal(6) * scale).tolist()) for n in range(300)]
    copies = [(n, [scale, -scale, 0.0, scale, scale, scale]) for n in range(300, 500)]  # ties over many blocks
    assert result(spark, rows + copies, 5) == brute(rows + copies, 5, 20)


def test_odd_rows(spark):
    rows = [(n, [float(n % 7), 1.0 - n % 3]) for n in range(-20, 41)] + [(20, [6.0, 1.0])] * 2 + [(20, [1.0, 1.0])]
    rows += [(None, [1.0, 2.0]), (60, None), (80, []), (100, [1.0, None]), (120, [float("nan"), 1.0]), (140, [1.0, float("-inf")])]
    rows += [(200, [1.0, 2.0, 3.0]), (201, [3.0, 2.0, 1.0]), (202, [0.0, 0.0, 0.0]), (220, [1.0])]
    assert result(spark, rows) == brute(rows, 20, 20)
    assert result(spark, []) == [] and result(spark, [(0, [1.0])]) == []


def test_components_of_any_size(spark):
    rows = [(n, [float(x), 1.0, float(n)]) for n, x in enumerate([1e300, -1e300, 1e12, -1e12, 3.0, 2.0**55, 0.0, 1e17, 5e8])]
    assert result(spark, rows, 4, 1) == brute(rows, 4, 1)
