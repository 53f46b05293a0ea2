from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import runs


def lyndon(w):
    """Longest Lyndon words by comparing suffixes."""
    out = []
    for i in range(len(w)):
        j = i + 1
        while j < len(w) and w[j:] > w[i:]:
            j += 1
        out.append(j - i)
    return out


def brute(w, least=24, times=3):
    """Runs by trying every period at every place."""
    out = set()
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            x = w[s : i + p]
            if len(x) >= max(least, times * p) and not any(x[q:] == x[:-q] for q in range(1, p)):
                out.add((s, len(x), p))
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.lists(st.integers(0, 3), max_size=50))
@settings(max_examples=300, deadline=None)
def test_grouping_gives_the_lyndon_array(w):
    assert runs.lyndon_lengths(w) == lyndon(w)


@given(st.lists(st.lists(st.integers(0, 2), max_size=40), max_size=4), st.sampled_from([(2, 2), (6, 3), (24, 3)]))
@settings(max_examples=300, deadline=None)
def test_runs_equal_all_periods_tried(texts, least):
    assert runs.runs_of([np.array(t, np.int64) for t in texts], *least) == [brute(t, *least) for t in texts]


def periodic_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        w = []
        for _ in range(rng.randint(0, 5)):
            u = [rng.choice([b"a", b"b", b"c", b"d", b"e", b"\xff"][: rng.randint(1, 6)]) for _ in range(rng.randint(1, 12))]
            w += (u * rng.randint(1, 9))[: rng.randint(1, 80)]
        yield w


@pytest.mark.parametrize("seed", range(40))
def test_stretches_lose_no_run(seed):
    texts = list(periodic_texts(seed, 12))
    assert runs._texts_runs(texts) == [brute(t) for t in texts]


def expected(doc_id, text, rewrite):
    """The contract, word by word."""
    words = (text or "").encode().split()
    n = len(words)
    if rewrite and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + k for s, k, p in found)]
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(found), *first, hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in found).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


SCHEMA = "doc_id long, text string, start string, period int"
COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_word_runs(spark):
    rng = random.Random(5)
    texts = [None, "", " \t\n ", "one", "a b c " * 30, "x " * 24, "x " * 23, "a b \x1f c\x85d " * 9, *(b" ".join(t).decode("latin-1") for t in periodic_texts(3, 60))]
    texts += [" ".join(rng.choice(["w%d" % k for k in range(50)]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    rows = [(n, t, "x", 0) for n, t in enumerate(texts)] + [(4, "a b c " * 30, None, None)] * 2 + [(None, "x " * 30, None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for rewrite in (False, True):
        got = sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in runs.word_runs(df, rewrite).collect()), key=str)
        assert got == sorted(((i, *expected(i, t, rewrite)) for i, t, _, _ in rows), key=str)
    assert runs.word_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_text(spark):
    words = [f"w{k % 997}" for k in range(60_000)] + ["end"] + ["z"] * 50_000
    row = runs.word_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (2, 60_001, 50_000, 1, 50_000_000)
    assert row.collapsed_sha256 == hashlib.sha256(" ".join([*words[:997], "w177", "end", "z"][:997] + ["end", "z"]).encode()).hexdigest()
