"""Operators that SQL can't express, held against the plainest code that does the same on small inputs."""

from __future__ import annotations

import itertools
import math
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import nearest, packing, sharding, toxicity, transcripts


def risk(w, b, positive, unlabelled, prior, decay):
    """The non-negative risk and its two parts, row by row."""
    f = lambda r: sum(w[k] for k in r) + b
    mean = lambda rows, sign: sum(math.log1p(math.exp(-sign * f(r))) for r in rows) / max(1, len(rows))
    negative = mean(unlabelled, -1) - prior * mean(positive, -1)
    return prior * mean(positive, 1) + max(0.0, negative), negative, decay / 2 * sum(x * x for x in w)


@pytest.mark.parametrize("seed", range(4))
def test_nnpu_steps_down_the_risk(seed):
    """The first step goes against the gradient by differences, and the whole run ends near the risk's least value."""
    rng = np.random.default_rng(seed)
    width, prior, decay = 5, 0.2, 1e-4
    positive = [np.flatnonzero(rng.random(width) < 0.6) for _ in range(30)]
    unlabelled = [np.flatnonzero(rng.random(width) < 0.3) for _ in range(60)]
    value = lambda w, b: (lambda r: r[0] + r[2])(risk(w, b, positive, unlabelled, prior, decay))
    w, b = toxicity.fit_nnpu(positive, unlabelled, width, prior, rounds=1, rate=0.01, decay=decay)
    step = np.append(w, b)
    gradient = np.array([(value(np.eye(width + 1)[k, :width] * h, (k == width) * h) - value(-np.eye(width + 1)[k, :width] * h, -(k == width) * h)) / (2 * h) for k in range(width + 1) for h in [1e-5]])
    big = np.abs(gradient) > 1e-3  # Adam's first step is the sign of the gradient
    assert np.all(np.sign(step[big]) == -np.sign(gradient[big])) and np.allclose(np.abs(step[big]), 0.01, rtol=1e-3)
    w, b = toxicity.fit_nnpu(positive, unlabelled, width, prior, rounds=1500, rate=0.02, decay=decay)
    found = value(w, b)
    tried = min(value(w + rng.normal(0, s, width), b + rng.normal(0, s)) for s in (0.03, 0.1, 0.3, 1.0) for _ in range(150))
    assert found <= tried + 0.02 and found < value(np.zeros(width), 0.0)


def test_nnpu_turns_back_where_the_negative_part_is_below_zero():
    """With a prior that is too large the negative part would go on falling; the step is then made against it."""
    positive, unlabelled = [np.array([0])] * 20, [np.array([0])] * 10 + [np.array([1])] * 10
    w, b = toxicity.fit_nnpu(positive, unlabelled, 2, 0.9, rounds=800)
    _, negative, _ = risk(w, b, positive, unlabelled, 0.9, 0)
    assert negative > -0.05


def model(seed):
    rng = np.random.default_rng(seed)
    n = transcripts.N_STATES
    start, step = np.log(rng.dirichlet(np.ones(n))), np.log(rng.dirichlet(np.ones(n), n))
    half = n // 2
    start[half:] = -1e6
    for s in range(n):
        for r in range(half):
            if s % half != r:
                step[s, half + r] = -1e6
    return transcripts.Model(start, step, tuple(np.log(rng.dirichlet(np.ones(k), n)) for k in transcripts.N_FEATURES))


@pytest.mark.parametrize("seed", range(6))
def test_decoding_equals_all_paths(seed):
    """Viterbi over one block, and over blocks whose matrices are composed, against every path of states."""
    m, rng = model(seed), np.random.default_rng(seed)
    lines = [tuple(int(rng.integers(k)) for k in transcripts.N_FEATURES) for _ in range(6)]
    b = m.scores(lines)
    score = lambda p: m.start[p[0]] + b[0, p[0]] + sum(m.step[x, y] + b[k + 1, y] for k, (x, y) in enumerate(itertools.pairwise(p)))
    paths = np.array(list(itertools.product(range(transcripts.N_STATES), repeat=6)))
    values = m.start[paths[:, 0]] + b[0, paths[:, 0]] + sum(m.step[paths[:, k], paths[:, k + 1]] + b[k + 1, paths[:, k + 1]] for k in range(5))
    best = values.max()
    for size in (1, 2, 3, 6):
        blocks = [lines[k : k + size] for k in range(0, 6, size)]
        exits = transcripts._exits([m.matrix(x) for x in blocks], -1, None)
        path = [s for x, entry, exit_ in zip(blocks, [-1, *exits[:-1]], exits, strict=True) for s in m.decode(x, entry, exit_)]
        assert score(path) == pytest.approx(best)
        assert transcripts._product([m.matrix(x) for x in blocks])[-1].max() == pytest.approx(best)


@given(st.lists(st.integers(1, 60), min_size=1, max_size=30), st.integers(2, 5))
@settings(max_examples=15, deadline=None)
def test_plan_reaches_the_smallest_capacity(spark, sizes, shards):
    """Shards of groups in the order of their keys: no larger than the least that runs of the groups not set apart can have."""
    groups = [(f"{(k * 2654435761) % (1 << 32):08x}", s) for k, s in enumerate(sizes)]
    own, cuts = sharding.plan(spark.createDataFrame(groups, "key string, size long"), shards)
    rest = sorted((k, s) for k, s in groups if k not in own)
    edges = ["", *cuts, "z"]
    held = [sum(s for k, s in rest if a <= k < b) for a, b in itertools.pairwise(edges)]
    assert len(own) + len(held) == shards and sum(held) + sum(s for k, s in groups if k in own) == sum(sizes)
    assert max(held, default=0) == sharding.smallest_capacity(np.array([s for _, s in rest], np.int64), len(held))


def optimum(pieces: tuple[int, ...], capacity: int) -> int:
    """The fewest sequences, by trying each set that holds the largest piece."""

    @cache
    def fewest(left: tuple[int, ...]) -> int:
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = len(left)
        for n in range(len(rest) + 1):
            for some in set(itertools.combinations(range(len(rest)), n)):
                if first + sum(rest[k] for k in some) <= capacity:
                    best = min(best, 1 + fewest(tuple(x for k, x in enumerate(rest) if k not in some)))
        return best

    return fewest(tuple(sorted(pieces, reverse=True)))


@given(st.lists(st.integers(1, 20), max_size=9))
@settings(max_examples=250, deadline=None)
def test_dominance_never_costs_a_sequence(lengths):
    """What the reduction fixes, with the best of the rest, is the best of all."""
    p = packing.Packing({n: lengths.count(n) for n in set(lengths)}, 20)
    p.reduce()
    left = tuple(x for x, n in p.left.items() for _ in range(n))
    assert p.sequences + optimum(left, 20) == optimum(tuple(lengths), 20)


def test_nearest_of_several_widths(spark):
    rng = np.random.default_rng(1)
    rows = [(n, rng.standard_normal(3 + n % 3).tolist()) for n in range(400)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(found) == set(range(0, 400, 50))
    hits = 0
    for q, mine in found.items():
        v = np.array(rows[q][1])
        near = sorted((-float(v @ np.array(w)) / (np.linalg.norm(v) * np.linalg.norm(w)), i) for i, w in rows if len(w) == len(v) and i != q)[:5]
        hits += len({i for _, i in near} & {i for _, i in mine})
        assert len(mine) == 5
    assert hits >= 36


def test_transcripts_with_clashing_columns_and_odd_roles(spark):
    rows = [(c, n, r, f"Line {n} of {c}.", 7, "x", 1) for c in range(30) for n, r in enumerate(["system", "user", "assistant", "tool", None, "user"])]
    rows += [(None, None, "user", None, 1, "y", 2), (3, 1, "user", "Line 1 of 3.", 7, "x", 1), (4, 9, "user", "long " * 50_000, 7, "x", 1)]
    got = transcripts.recover(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int, line string, block int")).collect()
    assert {r.role for r in got} <= set(transcripts.ROLES) and {r.conv_id for r in got} == {*range(30), -1}
    whole = "".join(r.turn for r in sorted((r for r in got if r.conv_id == 4), key=lambda r: (r.block, r.seq)))
    assert whole.count("<|im_start|>") == whole.count("<|im_end|>") and "long long" in whole
    assert transcripts.recover(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_toxicity_with_clashing_columns_and_contradicting_labels(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 9)) + (" vile hateful" if n % 4 == 0 else "") for n in range(120)]
    docs = spark.createDataFrame([(n, t, 0, "y", 1) for n, t in enumerate(texts)], "doc_id long, text string, toxic int, y string, f int")
    labels = [(n, int(n % 4 == 0), "p") for n in range(100)] + [(n, 0, "u") for n in range(0, 100, 4)]  # a document with both is toxic
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text string")).collect()}
    assert len(got) == 120 and all(got[n].predicted == int(n % 4 == 0) for n in got) and sum(r.held_out for r in got.values()) > 10
