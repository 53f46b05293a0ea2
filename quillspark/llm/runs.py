"""Periodic runs of words: Lyndon arrays by the grouping phase of Baier's suffix sorter (2016), extended through LCE.

A run's Lyndon root is the longest Lyndon word at its place under one of the two orders (Bannai et al., 2017), so
all runs come from the two Lyndon arrays: each longest Lyndon word is extended to both sides as far as its period holds.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow, table

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 24, 3
#: Words of a window that recurs; within a run each window of a third of LEAST words does, whatever the period.
WINDOW = LEAST // TIMES
#: Words of stretches that are sorted together.
TOGETHER = 1 << 20


def lyndon_lengths(w: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each place of w: the first phase of Baier's suffix sorter.

    Groups of suffixes start as those of equal first symbols and are taken from the last to the first. Every member
    points to the nearest suffix to its left in a lower group. Suffixes that are pointed to by the same number of
    members leave their group together for a new one right behind it, and what their group has in common grows by
    so many times what the members have in common; in the end it is the longest Lyndon word.
    """
    n = len(w)
    order = sorted(range(n), key=w.__getitem__)
    group, place, size, common = [0] * n, [0] * n, [0] * n, [0] * n
    at, symbol = 0, None
    for k, i in enumerate(order):
        if w[i] != symbol:
            at, symbol = k, w[i]
            common[at] = 1
        group[i], place[i] = at, k
        size[at] += 1
    before, end = [-1] * n, n
    while end > 0:
        at = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[at:end]):
            j = i - 1
            while j >= 0 and group[j] >= at:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        own = common[at]
        leaving: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            leaving.setdefault((group[j], times), []).append(j)
        for old, times in sorted(leaving, reverse=True):
            gone = leaving[old, times]
            if len(gone) == size[old]:
                common[old] += times * own
                continue
            last = old + size[old]
            new = last - len(gone)
            for j in gone:
                last -= 1
                other, k = order[last], place[j]
                order[k], place[other] = other, k
                order[last], place[j] = j, last
                group[j] = new
            size[old] -= len(gone)
            size[new], common[new] = len(gone), common[old] + times * own
        end = at
    return [common[g] for g in group]


class Extensions:
    """Longest common extensions of pairs of places, by names of all blocks of 1, 2, 4, ... symbols."""

    def __init__(self, w: np.ndarray, most: int):
        """most: no extension is longer."""
        self.names, step = [w], 1
        while 2 * step <= most:
            held = self.names[-1]
            pair = held[: len(held) - step].astype(np.int64) * (int(held.max()) + 1) + held[step:]
            found, names = np.unique(pair, return_inverse=True)
            self.names.append(names)
            step *= 2
            if len(found) == len(pair):
                break  # all differ, and so do longer ones

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from a on equal those from b on, a < b."""
        got = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            for _ in range(2 if k == len(self.names) - 1 else 1):  # the longest blocks may be met twice
                names = self.names[k]
                x, y = a + got, b + got
                fits = y < len(names)
                got += ((names[np.where(fits, x, 0)] == names[np.where(fits, y, 0)]) & fits) * (1 << k)
        return got

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before a equal those before b, a < b."""
        got = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            for _ in range(2 if k == len(self.names) - 1 else 1):
                names = self.names[k]
                x, y = a - got - (1 << k), b - got - (1 << k)
                fits = (x >= 0) & (y < len(names))
                got += ((names[np.where(fits, x, 0)] == names[np.where(fits, y, 0)]) & fits) * (1 << k)
        return got


def runs_of(stretches: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Of each sequence of symbols: its runs as (start, length, period), in this order of start and period."""
    out: list[list] = [[] for _ in stretches]
    if not stretches:
        return out
    sizes = np.array([len(s) for s in stretches])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])  # a symbol of its own ends each
    joined = np.full(int(sizes.sum()) + len(stretches), 0, np.int64)
    top, roots = max(int(s.max()) for s in stretches if len(s)) + 1 if sizes.any() else 0, []
    for n, s in enumerate(stretches):
        at = starts[n]
        joined[at : at + len(s)] = s
        joined[at + len(s)] = top + n
        for symbols in (s.tolist(), (-s).tolist()):
            length = np.array(lyndon_lengths(symbols), np.int64)
            k = np.arange(len(s))
            roots.append(np.stack([at + k, length])[:, k + length < len(s)])
    found = np.concatenate(roots, axis=1)
    found = np.unique(found[:, joined[found[0]] == joined[found[0] + found[1]]], axis=1)  # else the period ends within the root's second turn
    if found.shape[1]:
        a, period = found
        extend = Extensions(joined, int(sizes.max()))
        left, right = extend.left(a, a + period), extend.right(a, a + period)
        start, length = a - left, left + right + period
        fine = (length >= least) & (length >= times * period)
        for at, size, p in np.unique(np.stack([start, length, period])[:, fine], axis=1).T.tolist():
            n = int(np.searchsorted(starts, at, side="right")) - 1
            out[n].append((at - int(starts[n]), size, p))
    for rows in out:
        rows.sort(key=lambda r: (r[0], r[2]))
    return out


def stretches_with_runs(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, from, to) of all stretches of a text's words that may hold a run.

    ids: all texts' words one after the other, from 0 without gaps; ends: where each text ends. Each of the windows
    within a run comes twice in the text at least: moved by the period to the one side or the other it is still
    within the run. So a run lies in a stretch of so many windows in a row, one word apart, that recur in the text.
    """
    n = len(ids)
    if n < LEAST:
        return []
    rng = np.random.default_rng(11)
    words = rng.integers(0, 1 << 63, int(ids.max()) + 1, np.uint64)[ids] | np.uint64(1)
    key = np.zeros(n - WINDOW + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(key)]
        sizes = np.diff(ends, prepend=0)
        text = np.repeat(np.arange(len(ends)), sizes)
        key ^= rng.integers(0, 1 << 63, len(ends), np.uint64)[text[: len(key)]]  # equal keys by chance only lengthen a stretch
    whole = text[: len(key)] == text[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(key[at], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.flatnonzero(np.diff(twice.astype(np.int8), prepend=0))
    begin, end = edges[::2], edges[1::2]
    cut = [(b, e) for b, e in zip(begin.tolist(), end.tolist(), strict=True) if e - b > LEAST - WINDOW]
    # Windows across two texts don't recur, so a stretch lies within one.
    return [(int(text[b]), b - int(ends[text[b]] - sizes[text[b]]), e + WINDOW - 1 - int(ends[text[b]] - sizes[text[b]])) for b, e in cut]


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words as the contract's rule has them: of one document in ten the rest from some word on is made periodic."""
    if doc_id is None or not words:
        return words
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return words
    n = len(words)
    a = g % n
    turn = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (turn * ((n - a) // len(turn) + 1))[: n - a]


def summary(words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs; start, length, period and exponent of the run of the greatest exponent; the two digests."""
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, listed, hashlib.sha256(b" ".join(words)).hexdigest()
    best = runs[0]
    for r in runs[1:]:
        if r[1] * best[2] > best[1] * r[2]:  # by start, then period, so the first of equals stays
            best = r
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    kept = b" ".join([words[k] for k in np.flatnonzero(keep).tolist()])
    return len(runs), *best, 1000 * best[1] // best[2], listed, hashlib.sha256(kept).hexdigest()


def _texts_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Of each text (a list of words) its runs."""
    flat = [w for t in texts for w in t]
    if not flat:
        return [[] for _ in texts]
    ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy()
    ends = np.cumsum([len(t) for t in texts])
    found: list[list] = [[] for _ in texts]
    todo = stretches_with_runs(ids, ends)
    at = 0
    while at < len(todo):
        some, held = [], 0
        while at + len(some) < len(todo) and (not some or held < TOGETHER):
            text, a, b = todo[at + len(some)]
            some.append((text, a, b))
            held += b - a
        first = [int(ends[t]) - len(texts[t]) for t, _, _ in some]
        for (text, a, _), runs in zip(some, runs_of([ids[f + a : f + b].astype(np.int64) for f, (_, a, b) in zip(first, some, strict=True)]), strict=True):
            found[text] += [(s + a, n, p) for s, n, p in runs]
        at += len(some)
    return found


def word_runs(df: DataFrame, rewrite: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of the words of each whole text: maximal stretches of at least 24 words and three of their smallest period.

    Returns per row doc_id, n_runs, the start, length, period and exponent_milli of the run with the greatest
    exponent (ties: smallest start, then period; no run: nulls), runs_sha256 and collapsed_sha256, which leaves out
    each run's words after its first turn. Words are what ASCII white space parts. With `rewrite`, one document in
    ten is made periodic first. A null text is one without words; a null id is never rewritten; rows that repeat
    each get their own row; an empty table gives no rows; other columns are neither read nor returned. Nothing is
    shuffled: a text lies in one task, as in the table.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [(t or b"").split() for t in b.column(1).cast(pa.binary()).to_pylist()]
            if rewrite:
                texts = [rewritten(t, i) for t, i in zip(texts, ids, strict=True)]
            out = [(i, *summary(t, r)) for i, t, r in zip(ids, texts, _texts_runs(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names)

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return map_arrow(rows, run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs(table(spark, sf_dir, "documents"), rewrite=True)
