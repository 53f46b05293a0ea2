"""Exact top-k by distributed histogram selection: all pairs are scored, histograms close in on each k-th score."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow, materialize, table

SCALE = 64
#: Bins of a histogram, as a power of two; a pass narrows a query's range of scores by that factor.
BIN_BITS = 7
#: Vectors that share a block row; queries whose scores one matrix product gives.
BLOCK, QUERY_BLOCK, TILE = 8192, 2048, 512
#: The largest component and score.
LARGEST = (1 << 63) - 1


def _packed(x: np.ndarray) -> bytes:
    """The smallest integers that hold x, with their width in front."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _unpacked(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(-1, width)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact: as floats where their whole numbers reach far enough, else by Python's integers, held to longs."""
    most = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) + 1
    bound = most(a) * most(b)  # of a score and of any part of its sum (Cauchy and Schwarz)
    for kind, whole in REACH.items():
        if bound < whole:
            return a.astype(kind) @ b.astype(kind).T
    return np.clip(a.astype(object) @ b.astype(object).T, -LARGEST, LARGEST).astype(np.int64)


#: Floats, and up to where they hold every whole number.
REACH = {np.float32: 1 << 24, np.float64: 1 << 53}


def _alike(low: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """low (a column of longs) in the type of scores, so that comparisons stay right."""
    whole = REACH.get(scores.dtype.type)
    return (low if whole is None else np.clip(low, -whole, whole)).astype(scores.dtype)


def _tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(keys, state rows, scores, candidates' ids) for each tile of each pair of blocks; rows of a query's own id score less than any other."""
    for b in batches:
        for keys, ids, state, queries, others, data in zip(*(b.column(n).to_pylist() for n in range(6)), strict=True):
            a, c = _unpacked(queries, width), _unpacked(data, width)
            own, others = np.frombuffer(ids, np.int64), np.frombuffer(others, np.int64)
            for at in range(0, len(a), TILE):
                rows = slice(at, at + TILE)
                scores = inner_products(a[rows], c)
                first, last = (np.searchsorted(others, own[rows], side) for side in ("left", "right"))
                for r in np.flatnonzero(last > first).tolist():
                    scores[r, first[r] : last[r]] = np.iinfo(np.int64).min if scores.dtype == np.int64 else -np.inf
                yield np.frombuffer(keys, np.int64)[rows], np.frombuffer(state, np.int64).reshape(-1, 3)[rows], scores, others


def _histograms(width: int, k: int, bins: int, first: bool):
    """Counts of scores by bin of each query's range, from the top down to where a task has as many as are sought.

    In the first pass scores under the k-th largest of a few candidates, which the k-th of all is not, aren't counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by first key of a tile: keys, state, counts; pairs of one task share its tiles

        def out() -> Iterator[pa.RecordBatch]:
            for keys, state, counts in held.values():
                above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # within the range, in higher bins
                r, bin_ = np.nonzero((counts > 0) & (above < state[:, 2:3]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[r]), pa.array(bin_, pa.int32()), pa.array(counts[r, bin_])], ["q", "bin", "n"])
            held.clear()

        for keys, state, scores, _ in _tiles(batches, width):
            low, shift = state[:, 0:1], state[:, 1:2]
            least = _alike(low, scores)
            if first and scores.shape[1] > k:
                some = scores[:, : 32 * k]
                least = np.maximum(least, np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k, None])
            r, c = np.nonzero(scores >= least)
            # The difference may pass the largest long, but as an unsigned one it is right.
            bin_ = (scores[r, c].astype(np.int64).view(np.uint64) - low[r, 0].view(np.uint64)) >> shift[r, 0].astype(np.uint64)
            within = bin_ < bins
            flat = np.bincount(r[within] * bins + bin_[within].astype(np.int64), minlength=len(keys) * bins).reshape(len(keys), bins)
            if (got := held.get(int(keys[0]))) is None:
                if len(held) >= 64:
                    yield from out()
                held[int(keys[0])] = [keys, state, flat]
            else:
                got[2] += flat
        yield from out()

    return run


def _selected(width: int):
    """Scores above each query's k-th one, and of those equal to it the smallest ids, so many as places are left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, state, scores, others in _tiles(batches, width):
            low, left = _alike(state[:, 0:1], scores), state[:, 2]
            r, c = np.nonzero(scores >= low)
            exact = scores[r, c].astype(np.int64)
            tied = exact == state[r, 0]
            same = np.flatnonzero(tied)  # by query, then by id, as blocks are in the order of ids
            keep = exact > state[r, 0]
            keep[same[np.arange(len(same)) - np.searchsorted(r[same], r[same]) < left[r[same]]]] = True
            yield pa.RecordBatch.from_arrays([pa.array(keys[r[keep]]), pa.array(others[c[keep]]), pa.array(exact[keep])], ["q", "vec_id", "score"])

    return run


def _of_width(rows: DataFrame, width: int, count: int, asked: int, reach: int, every: int, k: int) -> DataFrame:
    """rows (id, v: whole numbers as bytes) of one width, none twice; their number, the queries among them and a bound of all scores."""
    n_blocks, n_asked = -(-count // BLOCK), -(-asked // QUERY_BLOCK)

    def blocks(df: DataFrame, n: int, name: str) -> DataFrame:
        """A row for about count / n vectors: their keys, ids and vectors."""

        def pack(key: tuple, t: pa.Table) -> pa.Table:
            order = np.lexsort((np.array(t.column("q")), np.array(t.column("id"))))
            x = np.concatenate([_unpacked(v, width) for v in t.column("v").to_pylist()]).reshape(-1, width)[order]
            return pa.table({"b": pa.array([key[0].as_py()], pa.int32()), "keys": [np.array(t.column("q"), np.int64)[order].tobytes()], "ids": [np.array(t.column("id"), np.int64)[order].tobytes()], "v": [_packed(x)]})

        dealt = df.withColumn("b", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int"))
        return materialize(dealt.groupBy("b").applyInArrow(pack, "b int, keys binary, ids binary, v binary"), name)

    queries = materialize(rows.filter(F.pmod("id", F.lit(every)) == 0).withColumn("q", F.monotonically_increasing_id()), "asked")
    candidates = blocks(rows.withColumn("q", F.lit(0).cast("long")), n_blocks, "candidates").select(F.col("b").alias("c"), F.col("ids").alias("others"), F.col("v").alias("data"))
    asking = blocks(queries, n_asked, "queries")
    tasks = min(2 * n_blocks * n_asked, max(2048, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    candidates = candidates.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))).repartition(tasks, "b", "c")
    bits = max(0, (2 * reach + 1).bit_length() - BIN_BITS)
    state = queries.select("q", F.lit(-reach).cast("long").alias("low"), F.lit(bits).cast("long").alias("shift"), F.lit(k).cast("long").alias("left"), F.pmod(F.xxhash64("id", "v"), F.lit(n_asked)).cast("int").alias("b"))

    def pairs(state: DataFrame) -> DataFrame:
        """Each block of queries, with its state in the order of its keys, beside each block of candidates."""

        def join(key: tuple, block: pa.Table, states: pa.Table) -> pa.Table:
            keys = np.frombuffer(block.column("keys")[0].as_py(), np.int64)
            found = np.array(states.column("q"))
            rows_ = np.stack([np.array(states.column(c)) for c in ("low", "shift", "left")], axis=1)
            at = np.argsort(found)
            ordered = rows_[at[np.searchsorted(found, keys, sorter=at)]]
            return block.append_column("state", pa.array([np.ascontiguousarray(ordered).tobytes()], pa.binary()))

        told = asking.groupBy("b").cogroup(state.select("b", "q", "low", "shift", "left").groupBy("b")).applyInArrow(join, "b int, keys binary, ids binary, v binary, state binary")
        told = told.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        return told.repartition(tasks, "b", "c").join(candidates, ["b", "c"]).select("keys", "ids", "state", "v", "others", "data")

    bins, first = 1 << BIN_BITS, True
    while True:
        counts = map_arrow(pairs(state), _histograms(width, k, bins, first), "q long, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        ahead = Window.partitionBy("q").orderBy(F.desc("bin"))
        reached = counts.withColumn("up_to", F.sum("n").over(ahead)).join(state.select("q", "left"), "q").filter(F.col("up_to") >= F.col("left"))
        found = reached.groupBy("q").agg(F.max(F.struct("bin", (F.col("left") - F.col("up_to") + F.col("n")).alias("left"))).alias("at"))
        # Fewer candidates than k: all of them are wanted, down to the lowest score.
        wide = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  the step may exceed a long
        narrowed = F.when(F.col("at").isNull(), F.col("low")).otherwise((wide("low") + wide("at.bin") * (1 << bits)).cast("long"))
        state = state.join(found, "q", "left").select("q", narrowed.alias("low"), F.lit(max(0, bits - BIN_BITS)).cast("long").alias("shift"), F.coalesce("at.left", "left").alias("left"), "b")
        state = materialize(state, "state")
        if not bits:
            break
        bins, first, bits = 1 << min(bits, BIN_BITS), False, max(0, bits - BIN_BITS)
    hits = map_arrow(pairs(state), _selected(width), "q long, vec_id long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    return ranked.join(queries.select("q", F.col("id").alias("query_id")), "q").select("query_id", "rank", "vec_id", "score")


def exact_topk(df: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k largest inner products of each row whose id is divisible by `every` with all other rows: query_id, rank, vec_id, score.

    Components become floor(64 x), held to a long, as is the score. Ties go to the smaller id; all candidates if
    there are fewer than k. Rows of a query's own id are no candidates of its. Vectors that are null or empty or
    hold a null or non-finite component take no part, nor do rows without an id. Vectors of each length are a table
    of their own, since an inner product needs equal lengths. An id that repeats counts once for each of its
    different vectors. An empty table gives no rows; other columns of df are neither read nor returned.
    """
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    rows = df.filter(v.isNotNull() & fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column(1)
                sizes = lists.value_lengths().to_numpy()
                x = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
                x = np.where(np.abs(x) < 2.0**63, x, 0).astype(np.int64) + np.where(x >= 2.0**63, LARGEST, 0) - np.where(x <= -(2.0**63), LARGEST, 0)
                cut = [x[e - s : e] for s, e in zip(sizes.tolist(), np.cumsum(sizes).tolist(), strict=True)]
                norms = [float(np.sqrt((c.astype(np.float64) ** 2).sum())) for c in cut]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array([_packed(c) for c in cut], pa.binary()), pa.array(norms, pa.float64())], ["id", "w", "v", "norm"])

    held = materialize(map_arrow(rows, whole, "id long, w int, v binary, norm double").dropDuplicates(["id", "v"]), "vectors")
    is_query = F.pmod("id", F.lit(every)) == 0
    parts = []
    for r in held.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("asked"), F.max("norm").alias("norm"), F.max(F.when(is_query, F.col("norm"))).alias("own")).orderBy("w").collect():
        if r["asked"]:
            reach = min(int(r["norm"] * r["own"] * (1 + 1e-9)) + 1, LARGEST)
            parts.append(_of_width(held.filter(F.col("w") == r["w"]).select("id", "v"), r["w"], r["n"], r["asked"], reach, every, k))
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""
