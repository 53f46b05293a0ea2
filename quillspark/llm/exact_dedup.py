"""Exact de-duplication by Grace hashing: spill files are split until each bucket fits an open-addressing table."""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow, materialize, table

#: Bytes of distinct content that one task's table may hold before the bucket is split into spill files.
TABLE_BYTES = 32 << 20
#: Spill files made of one bucket; each level of the recursion uses the next four bits of the hash.
FAN_OUT_BITS = 4
#: A text that more than one in so many rows have is hot; there are fewer hot texts than this.
HOT_SHARE = 1000
_HEAD = struct.Struct("<QqqBI")  # hash, largest id, rows, whether an id is there, length of the content


class ContentTable:
    """Open addressing with linear probing; a hit needs equal hashes and equal complete content."""

    def __init__(self, capacity: int = 1024):
        self.slots = [-1] * capacity
        self.rows: list[list] = []  # [hash, content, largest id or None, rows]
        self.bytes = 0

    def add(self, digest: int, content: bytes, largest: int | None, rows: int) -> None:
        mask = len(self.slots) - 1
        at = digest & mask
        while (held := self.slots[at]) >= 0:
            row = self.rows[held]
            if row[0] == digest and row[1] == content:
                if largest is not None and (row[2] is None or largest > row[2]):
                    row[2] = largest
                row[3] += rows
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.rows.append([digest, content, largest, rows])
        self.bytes += len(content) + 120
        if len(self.rows) * 5 > len(self.slots) * 3:
            self._grow()

    def _grow(self) -> None:
        slots = [-1] * (2 * len(self.slots))
        mask = len(slots) - 1
        for n, row in enumerate(self.rows):
            at = row[0] & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = n
        self.slots = slots


def _read_spill(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while head := f.read(_HEAD.size):
            digest, largest, rows, has_id, size = _HEAD.unpack(head)
            yield digest, f.read(size), largest if has_id else None, rows
    os.remove(path)


def grace_groups(records: Iterator[tuple], folder: str, table_bytes: int = TABLE_BYTES, level: int = 0) -> Iterator[list]:
    """Groups of equal content among (hash, content, largest id, rows), using spill files in `folder` as needed."""
    held = ContentTable()
    last_level = level * FAN_OUT_BITS >= 64
    for record in records:
        held.add(*record)
        if held.bytes > table_bytes and not last_level and len(held.rows) > 1:
            break
    else:
        yield from held.rows
        return
    paths = [os.path.join(folder, f"{level}-{n}-{id(held):x}") for n in range(1 << FAN_OUT_BITS)]
    files = [open(p, "wb", buffering=1 << 18) for p in paths]
    shift = 64 - FAN_OUT_BITS * (level + 1)

    def spill(digest: int, content: bytes, largest: int | None, rows: int) -> None:
        f = files[(digest >> shift) & ((1 << FAN_OUT_BITS) - 1)]
        f.write(_HEAD.pack(digest, largest or 0, rows, largest is not None, len(content)))
        f.write(content)

    for row in held.rows:
        spill(*row)
    del held
    for record in records:
        spill(*record)
    for f in files:
        f.close()
    for path in paths:
        yield from grace_groups(_read_spill(path), folder, table_bytes, level + 1)


def _local_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within one input task: fold equal texts, so that a very common text leaves each task once."""
    held = ContentTable()

    def out() -> pa.RecordBatch:
        rows = held.rows
        return pa.RecordBatch.from_arrays([pa.array([r[0] - (1 << 63) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], ["h", "content", "largest", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            content = text or b""
            held.add(xxhash.xxh3_64_intdigest(content), content, doc_id, 1)
            if held.bytes > TABLE_BYTES // 2:
                yield out()
                held = ContentTable()
    if held.rows:
        yield out()


def _merged_groups(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for b in batches:
            for h, content, largest, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                yield h + (1 << 63), content, largest, n

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())], ["text_sha256", "keep_id", "group_size"])

    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        rows = []
        for row in grace_groups(records(), folder, table_bytes):
            rows.append(row)
            if len(rows) == 8192:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (largest id), group_size."""
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    partial = map_arrow(rows, _local_groups, "h long, content binary, largest long, n long")
    return map_arrow(partial.repartition("h"), lambda it: _merged_groups(it, table_bytes), "text_sha256 string, keep_id long, group_size long")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Equal whole texts, the largest id of each group stays: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty. Ties: rows that repeat both id and text get the same answer, each counted
    in group_size. A null id never wins over an id; a group without ids has keep_id null and keeps its rows.
    An empty table gives no rows; other columns of df are neither read nor returned.
    """
    groups = materialize(duplicate_groups(df, id_col, text_col, table_bytes).filter("group_size > 1"), "groups")
    is_hot = F.col("group_size") * HOT_SHARE > df.count()
    hot = groups.filter(is_hot).select("text_sha256", F.struct("keep_id", "group_size").alias("hot"))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    marked = docs.join(F.broadcast(hot), "text_sha256", "left")
    spread = F.when(F.col("hot").isNull(), F.col("text_sha256")).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id")))  # rows of hot texts meet no one
    cold = groups.filter(~is_hot).select(F.col("text_sha256").alias("key"), F.struct("keep_id", "group_size").alias("cold"))
    found = F.coalesce("hot", "cold")
    joined = marked.withColumn("key", spread).join(cold, "key", "left").select("doc_id", "text_sha256", found["keep_id"].alias("keep_id"), found["group_size"].alias("group_size"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
