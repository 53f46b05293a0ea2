"""SimHash near-duplicates found by covering locality-sensitive hashing (Pagh, 2016)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow, materialize, table
from quillspark.llm.components import components

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 15
#: Buckets of more distinct fingerprints than this are covered by masks once more.
MAX_BUCKET = 4096
#: As many large buckets are broadcast at most.
MAX_BROADCAST = 10_000


def fingerprint(text: str | None, size: int = 4) -> int:
    """64 bits; a bit is 1 if it is set in over half the XXH64 (seed 42) of the text's word shingles, repeats included."""
    words = text.encode().translate(_LOWER).split() if text else []  # splits at 0x20 and 0x09-0x0D, as bytes do
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - size + 1
    if n <= 1:
        hashes = [h(joined, 42)]
    else:
        starts = [0] * len(words)
        at = 0
        for k, w in enumerate(words):
            starts[k] = at
            at += len(w) + 1
        ends = starts[size:]
        ends.append(at)
        hashes = [h(joined[a : b - 1], 42) for a, b in zip(starts, ends, strict=False)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), _BLOCK):
        bits = np.array(hashes[k : k + _BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """2^(radius+1) - 1 masks of which, for any `radius` positions, one at least leaves all those positions out.

    Position i carries the vector i mod (2^(radius+1) - 1) + 1 over GF(2); mask v holds the positions whose
    vector has an odd inner product with v. `radius` vectors span fewer than radius + 1 dimensions, so some
    v other than 0 is orthogonal to them all.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if (i % n + 1 & v).bit_count() % 2) for v in range(1, n + 1)]


def second_masks(mask: int, radius: int, bits: int = 64) -> list[int]:
    """Masks that hold all of `mask` and cover the positions outside it, as covering_masks does for all positions.

    Of these positions about a half stay out of each: for 64 bits and radius 4 at most 17, so that 2^17 distinct
    values at most agree under one of them, however many rows there are.
    """
    free = [i for i in range(bits) if not mask >> i & 1]
    return [mask | sum(1 << free[j] for j in range(len(free)) if m >> j & 1) for m in covering_masks(radius, len(free))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(fingerprint(t, size)) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return run


def link_bucket(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join each connected part of these distinct values: a walk, each value once against those not yet reached."""
    left, edges = fps, []
    while len(left) > 1:
        front, left = [left[0]], left[1:].copy()
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius  # of signed values it would count those of |x|
            if near.any():
                reached = left[near]
                left = left[~near]
                edges += [(int(x), int(y)) for y in reached]
                front += list(reached)
    return edges


def _link(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (mask, key); a bucket may go on in the next batch."""

        def linked(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            new = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.append(0, new), np.append(new, len(key))
            edges = []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                edges += link_bucket(fp[a:b], radius)
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"]) if edges else None

        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if held and (mask[-1], key[-1]) == (held[0][0][0], held[0][1][0]):
                held.append([mask, key, fp])
                continue
            last = int(np.flatnonzero((mask != mask[-1]) | (key != key[-1]))[-1] + 1) if ((mask != mask[-1]) | (key != key[-1])).any() else 0
            parts = [*held, [mask[:last], key[:last], fp[:last]]]
            mask_, key_, fp_ = (np.concatenate([p[k] for p in parts]) for k in range(3))
            if len(key_) and (out := linked(mask_, key_, fp_)):
                yield out
            held = [[mask[last:], key[last:], fp[last:]]]
        if held and (out := linked(*(np.concatenate([p[k] for p in held]) for k in range(3)))):
            yield out

    return run


def near_links(fps: DataFrame, radius: int, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """fps(fp), distinct longs -> edges (a, b) whose connected parts are those of all pairs within `radius` bits.

    Buckets of up to `max_bucket` values are linked as they are; larger ones are counted first (with partial
    sums, so no task meets all their rows) and dealt by second masks, under which few values can agree.
    """
    spark, masks = fps.sparkSession, covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(n).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for n, m in enumerate(masks)]))
    rows = fps.select("fp", tables.alias("t")).select("t.mask", "t.key", "fp")
    large = materialize(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_bucket).select("mask", "key"), "buckets")
    count = large.count()
    if count:
        large = F.broadcast(large) if count <= MAX_BROADCAST else large
        second = [(n, len(masks) * (n + 1) + k, _signed(m2)) for n, m in enumerate(masks) for k, m2 in enumerate(second_masks(m, radius))]
        again = rows.join(large, ["mask", "key"], "left_semi").join(F.broadcast(spark.createDataFrame(second, "mask int, mask2 int, bits long")), "mask")
        rows = rows.join(large, ["mask", "key"], "left_anti").unionByName(again.select(F.col("mask2").alias("mask"), F.col("fp").bitwiseAND(F.col("bits")).alias("key"), "fp"))
    return map_arrow(rows.repartition("mask", "key").sortWithinPartitions("mask", "key"), _link(radius), "a long, b long")


def simhash_groups(df: DataFrame, radius: int = 4, size: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group whole texts whose fingerprints link at `radius` or fewer differing bits: doc_id, fingerprint, component_id.

    A null text counts as empty: its fingerprint is 0 and links like any other. Copies of a fingerprint are
    one node. component_id is the smallest id reachable; null ids don't count, and a group without ids has
    null. Repeated rows get equal answers; an empty table gives no rows; other columns of df aren't read.
    """
    rows = materialize(map_arrow(df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), _fingerprints(size), "doc_id long, fp long"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(near_links(nodes.select("fp"), radius))
    grouped = nodes.join(found, F.col("fp") == F.col("node"))
    least = grouped.groupBy("root").agg(F.min("first").alias("least"))
    of = nodes.join(found, F.col("fp") == F.col("node"), "left").join(least, "root", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
