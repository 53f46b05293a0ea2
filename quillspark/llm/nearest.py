"""Nearest neighbours by inverted lists and an adaptive dimension scan (Gao and Long, 2023)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bound_batches, first_by_hash, materialize, table

#: Bound of the sample that lists, rotation and number of probes are fitted on; every vector is indexed.
SAMPLE, MAX_LISTS, PROBE_QUERIES, PROBE_RECALL = 20_000, 1024, 200, 0.97
#: Columns of a block of the scan; the error bound of its test; vectors and queries of a list that one task joins.
COLUMNS, EPSILON, BLOCK, QUERY_BLOCK = 16, 2.1, 8192, 2048
#: Queries whose first distances are held together, and vectors after which a query's bound is tightened.
QUERIES_TOGETHER, TILE = 128, 2048
SEED = 7


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1: the same cosines, and no norm that under- or overflows."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_lists(sample: np.ndarray, n: int, k: int) -> tuple[np.ndarray, int]:
    """Centroids by spherical k-means, and the fewest probes that reach PROBE_RECALL within the sample."""
    rng, x = np.random.default_rng(SEED), _unit(sample)
    lists = int(np.clip(np.sqrt(n) / 4, 1, min(MAX_LISTS, len(x))))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(8):
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    near = (x @ centroids.T).argmax(axis=1)
    some = rng.choice(len(x), min(PROBE_QUERIES, len(x)), replace=False)
    sims = x[some] @ x.T
    sims[np.arange(len(some)), some] = -np.inf
    if len(x) <= k + 1:
        return centroids, lists
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(x[some] @ centroids.T), axis=1), axis=1)  # of each list for each query
    needed = np.sort(np.take_along_axis(rank, near[top], axis=1).ravel())
    return centroids, int(needed[min(len(needed) - 1, int(np.ceil(PROBE_RECALL * len(needed))) - 1)]) + 1


def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def adaptive_scan(queries: np.ndarray, vectors: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> Iterator[np.ndarray]:
    """For each rotated unit query: indexes of the vectors that the tests left, its k nearest almost surely among them.

    Partial distances grow by blocks of columns; after d of D columns a vector is abandoned when the estimate
    of its distance exceeds, by more than the test allows, the k-th of the distances known in full, which
    tightens with each tile of vectors. Queries meet vectors so many at a time that a task's memory is bounded.
    """
    width = vectors.shape[1]
    edges = [*range(0, width, columns), width]
    squares = (vectors[:, :columns] ** 2).sum(axis=1)
    for at in range(0, len(queries), QUERIES_TOGETHER):
        some = queries[at : at + QUERIES_TOGETHER]
        first = squares + (some[:, :columns] ** 2).sum(axis=1)[:, None] - 2 * some[:, :columns] @ vectors[:, :columns].T
        for q, partial in zip(some, first, strict=True):
            if len(vectors) <= 4 * k:
                yield np.arange(len(vectors))
                continue
            probe = np.argpartition(partial, 4 * k - 1)[: 4 * k]
            known = ((vectors[probe] - q) ** 2).sum(axis=1)
            nearest_ = np.argpartition(known, k - 1)[:k]
            best, found = known[nearest_], [probe[nearest_]]  # k known in full
            partial[found[0]] = np.inf
            for a in range(0, len(vectors), TILE):
                bound = best.max() * (1 + 1e-9) + 1e-12
                left, now, d = np.arange(a, min(a + TILE, len(vectors))), partial[a : a + TILE], columns
                for n in range(1, len(edges)):
                    keep = now * (width / d) <= bound * (1 + epsilon / np.sqrt(d)) ** 2 if d < width else now <= bound
                    left, now = left[keep], now[keep]
                    if d >= width or not len(left):
                        break
                    diff = vectors[left, edges[n] : edges[n + 1]] - q[edges[n] : edges[n + 1]]
                    now, d = now + (diff * diff).sum(axis=1), edges[n + 1]
                if len(left):
                    found.append(left)
                    best = np.partition(np.append(best, now), k - 1)[:k]
            yield np.concatenate(found)  # k at least


def _decode(column: pa.ChunkedArray | list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column if isinstance(column, list) else column.to_pylist()), np.float64).reshape(-1, width)


def nearest(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest by cosine of each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Nearest first, ties to the smaller id; all candidates if there are fewer; a query's own row is no
    candidate of its. Vectors that are null or zero or hold null or non-finite components take no part, nor do
    rows without an id. Vectors of each length are a table of their own, with lists of their own, since a cosine
    needs equal lengths. Equal vectors are searched once and then stand for all their ids, so any number of
    copies is no burden. An id that repeats counts once for each of its different vectors. An empty table gives
    no rows; other columns of df are neither read nor returned.
    """
    bound_batches(df.sparkSession)
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull()
    rows = df.filter(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("v"))
    widths = [r["w"] for r in rows.groupBy(F.size("v").alias("w")).count().orderBy("w").collect()]  # a row for each length of vectors
    parts = [_of_width(rows.filter(F.size("v") == w), w, k, every) for w in widths]
    return reduce(DataFrame.unionByName, parts, df.sparkSession.createDataFrame([], RESULT)) if len(parts) != 1 else parts[0]


RESULT = "query_id long, rank int, vec_id long, score double"


def _of_width(rows: DataFrame, width: int, k: int, every: int) -> DataFrame:
    """nearest() of rows (id, v) whose vectors have `width` components."""
    spark = rows.sparkSession
    ranked = rows.dropDuplicates(["v", "id"]).withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    groups = ranked.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    to_bytes = lambda it: (pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([np.asarray(x).tobytes() for x in b.column(2).to_pylist()], pa.binary())], ["rep", "ids", "v"]) for b in it)
    groups = materialize(groups.select("rep", "ids", "v").mapInArrow(to_bytes, "rep long, ids array<long>, v binary"), "vectors")
    n = groups.count()
    sample = first_by_hash(groups.select("rep", "v"), SAMPLE, "rep", "v")
    centroids, probes = fit_lists(_decode([r["v"] for r in sample], width), n, k)
    turn = rotation(width)

    def lists(probes_: int, held: np.ndarray | None = None):
        """The nearest `probes_` lists of each vector; if `held`, their sizes, is given, more until k + 1 vectors are in them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    sims = _unit(_decode(b.column(1), width)) @ centroids.T
                    best = np.argsort(-sims, axis=1, kind="stable").astype(np.int32)
                    enough = np.full(len(best), probes_) if held is None else np.maximum(probes_, (np.cumsum(held[best], axis=1) <= k).sum(axis=1) + 1)
                    found = [row[:n].tolist() for row, n in zip(best, enough.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["rep", "v", "lists"])

        return run

    asked = rows.filter(F.col("id") % every == 0)
    listed = materialize(groups.select("rep", "v").mapInArrow(lists(1), "rep long, v binary, lists array<int>").select("rep", "v", F.col("lists")[0].alias("list")), "lists")
    queries = materialize(asked.select("v").distinct().mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([np.asarray(x).tobytes() for x in b.column(0).to_pylist()], pa.binary())], ["v"]) for b in it), "v binary").join(groups.select("rep", "v"), "v"), "queries")
    sizes = {r["list"]: r["count"] for r in listed.groupBy("list").count().collect()}  # MAX_LISTS rows at most
    held = np.array([sizes.get(n, 0) for n in range(len(centroids))], np.int64)
    probed = queries.select("rep", "v").mapInArrow(lists(probes, held), "rep long, v binary, lists array<int>").select("rep", "v", F.explode("lists").alias("list"))
    asking = {r["list"]: r["count"] for r in probed.groupBy("list").count().collect()}
    if not asking:
        return spark.createDataFrame([], RESULT)
    parts = lambda found, most: F.create_map(*[x for key, size in sorted(found.items()) for x in (F.lit(key), F.lit(-(-size // most)))])[F.col("list")]
    blocks, query_blocks = parts(sizes, BLOCK), parts(asking, QUERY_BLOCK)
    block_of = lambda count: F.pmod(F.xxhash64("rep", "v"), count).cast("int")
    left = probed.withColumn("qb", block_of(query_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1)))
    right = listed.withColumn("cb", block_of(blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), query_blocks - 1)))  # lists that no query probes drop out

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if q.num_rows and c.num_rows:
            qv, cv = _scaled(_decode(q.column("v"), width)), _scaled(_decode(c.column("v"), width))
            qr, cr = np.array(q.column("rep")), np.array(c.column("rep"))
            raw_q, raw_c = q.column("v").to_pylist(), c.column("v").to_pylist()
            q_norm, c_norm = np.sqrt((qv * qv).sum(axis=1)), np.sqrt((cv * cv).sum(axis=1))
            for at, found in enumerate(adaptive_scan(_unit(qv) @ turn, _unit(cv) @ turn, k + 1)):
                scores = (cv[found] * qv[at]).sum(axis=1) / (c_norm[found] * q_norm[at])
                for j in np.lexsort((cr[found], -scores))[: k + 1]:
                    for column, x in zip(out, (int(qr[at]), raw_q[at], raw_c[found[j]], float(scores[j])), strict=True):
                        column.append(x)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.float64()), strict=True)], ["rep", "q", "c", "score"])

    keys = ["list", "qb", "cb"]
    found = left.select(*keys, "rep", "v").groupBy(*keys).cogroup(right.select(*keys, "rep", "v").groupBy(*keys)).applyInArrow(search, "rep long, q binary, c binary, score double")
    ids = groups.select(F.col("v").alias("c"), "ids", F.col("rep").alias("least"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    top = found.join(ids, "c").withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    pairs = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))
    merged = top.groupBy("q").agg(F.flatten(F.collect_list(pairs)).alias("near"))  # (k + 1) squared at most
    vectors = asked.select("id", "v").mapInArrow(lambda it: (pa.RecordBatch.from_arrays([b.column(0), pa.array([np.asarray(x).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["id", "q"]) for b in it), "id long, q binary").distinct()
    own = F.slice(F.array_sort(F.filter("near", lambda x: x["id"] != F.col("id"))), 1, k)
    out = vectors.join(merged, "q").select(F.col("id").alias("query_id"), F.posexplode(own).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
