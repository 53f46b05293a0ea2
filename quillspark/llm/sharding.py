"""Contiguous sharding with the smallest largest shard: binary search over capacities with a greedy check."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, number_rows, salts, table

#: Hex digits of a group's key that the first summary is grouped by: at most 4,096 rows reach the driver.
FIRST_DIGITS = 3
#: A summary row is opened by one more digit, into at most 16, only where a cut may fall.
MAX_OPEN = 4096


def greedy_ends(sums: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends (exclusive) of shards filled greedily up to capacity; None if they don't hold everything. sums: from 0."""
    ends, at, last = [], 0, len(sums) - 1
    for _ in range(shards):
        at = int(np.searchsorted(sums, sums[at] + capacity, side="right")) - 1
        ends.append(at)
        if at == last:
            return ends
    return None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity at which `shards` contiguous runs hold all sizes."""
    if not len(sizes):
        return 0
    sums = np.concatenate([[0], np.cumsum(sizes)])
    low, high = max(int(sizes.max()), -(-int(sums[-1]) // shards)), int(sums[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy_ends(sums, middle, shards) is not None:
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """The shards - 1 inner cuts (indexes into sizes) of a partition whose largest shard has the smallest capacity.

    Within that capacity each cut is put next to its equal share: not before what the shards behind it can
    hold, not after what its own shard can.
    """
    capacity = smallest_capacity(sizes, shards)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    total, n = int(sums[-1]), len(sizes)
    earliest, at = [n] * (shards + 1), n
    for j in range(shards - 1, -1, -1):  # greedily from the right
        at = int(np.searchsorted(sums, sums[at] - capacity, side="left"))
        earliest[j] = at
    cuts, at = [], 0
    for j in range(1, shards):
        latest = int(np.searchsorted(sums, sums[at] + capacity, side="right")) - 1
        target = total * j / shards
        near = int(np.searchsorted(sums, target))
        if near and target - sums[near - 1] <= sums[min(near, n)] - target:
            near -= 1
        at = min(max(near, earliest[j], at), latest)
        cuts.append(at)
    return cuts


def plan(groups: DataFrame, shards: int) -> tuple[list[str], list[str]]:
    """Keys of the groups that get a shard of their own, and the first keys of the other shards but the first.

    groups(key, size): distinct hex keys of one length. The driver sees sums by leading digits of the keys,
    opened further only where a cut may fall, so what it holds is bounded however many groups there are.
    """
    total = groups.agg(F.sum("size")).first()[0] or 0
    own, left, free, rest = [], total, shards, groups
    while free > 1 and left:
        large = rest.filter(F.col("size") * free >= left).orderBy(F.desc("size"), "key").collect()  # as many as `free` at most
        for key, size in ((r["key"], r["size"]) for r in large):
            if size * free < left or free == 1:
                break
            own.append(key)
            left, free = left - size, free - 1
        if not large:
            break
        rest = groups.filter(~F.col("key").isin(own))

    def summary(digits: int, under: list[str] | None) -> dict[str, tuple[int, int]]:
        part = rest if under is None else rest.filter(F.substring("key", 1, digits - 1).isin(under))
        rows = part.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        return {r["p"]: (int(r["s"]), r["n"]) for r in rows}

    digits, atoms = FIRST_DIGITS, summary(FIRST_DIGITS, None)
    while True:
        keys = sorted(atoms)
        sizes = np.array([atoms[k][0] for k in keys], dtype=np.int64)
        high = smallest_capacity(sizes, free)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        unsure = np.zeros(len(keys), bool)
        for j in range(1, free):  # with the true capacity at most `high`, cut j lies in this window
            unsure |= (starts < j * high) & (ends > left - (free - j) * high)
        opened = [k for k, u in zip(keys, unsure, strict=True) if u and atoms[k][1] > 1]
        if not opened:
            break
        digits += 1
        for at in range(0, len(opened), MAX_OPEN):
            some = opened[at : at + MAX_OPEN]
            for k in some:
                del atoms[k]
            atoms |= _under(summary, some)
    return own, [keys[c] if c < len(keys) else "g" for c in even_cuts(sizes, free)]


def _under(summary, prefixes: list[str]) -> dict[str, tuple[int, int]]:
    found: dict[str, tuple[int, int]] = {}
    for length in {len(p) for p in prefixes}:
        found |= summary(length + 1, [p for p in prefixes if len(p) == length])
    return found


def shard_by_bytes(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into shards 0 to shards - 1 of near equal bytes; rows of equal text stay together.

    Returns doc_id, size (UTF-8 bytes plus 16), text_crc32, law ('bytes'), shard, slot (from 0, no gaps),
    grown_shard (null under this law). A null text has no bytes and is grouped with the empty text. Groups are
    ordered by the SHA-256 of their text; a group as large as an equal share of what is left gets a shard of
    its own. Rows that repeat, or have a null id, each get a slot. With fewer groups than shards some shards
    stay empty; an empty table gives no rows; other columns of df aren't read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key")), "shard-rows")
    groups = materialize(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")
    own, cuts = plan(groups, shards)
    shard = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    for n, key in enumerate(own):
        shard = F.when(F.col("key") == key, F.lit(shards - 1 - n)).otherwise(shard)
    placed = rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), shard.cast("int").alias("shard"))
    return number_rows(placed, ["shard"], ["doc_id", "text_crc32"], "slot", ["doc_id", "text_crc32"], salts(rows.count())).select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 40)
