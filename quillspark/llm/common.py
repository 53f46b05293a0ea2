"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What an operator keeps in a Python worker from task to task: its name and itself; see kept().
_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """make(), made once in a Python worker for all tasks in turn that ask for `name`; a task that asks for another lets go of it.

    Workers are used again for later stages, so what one stage has remembered would otherwise stay beside
    what the next ones need.
    """
    if name not in _kept:
        _kept.clear()
        release_memory()
        _kept[name] = make()
    return _kept[name]


def release_memory() -> None:
    """Give back to the system what this process no longer uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


class Memo:
    """What has been found for keys, in two generations of about `most` bytes each; the older goes first."""

    def __init__(self, most: int):
        self.new, self.old, self.held, self.most = {}, {}, 0, most

    def values(self, keys: list[str], make: Callable[[list[str]], dict]) -> list:
        """The values of different keys; make() finds those that neither generation holds."""
        if self.held > self.most:
            self.new, self.old, self.held = {}, self.new, 0
        found = list(map(self.new.get, keys))
        lacking = [n for n, v in enumerate(found) if v is None]
        if lacking:
            moved, get, unseen = {}, self.old.get, []
            for n in lacking:
                key = keys[n]
                if (value := get(key)) is None:
                    unseen.append(n)
                else:
                    found[n] = moved[key] = value
            self.remember(moved)
            made = make([keys[n] for n in unseen])
            self.remember(made)
            for n in unseen:
                found[n] = made[keys[n]]
        return found

    def missing(self, wanted: set[str]) -> list[str]:
        """Those of `wanted` that neither generation holds; those of the older one come into the newer, `new`."""
        if self.held > self.most:
            self.new, self.old, self.held = {}, self.new, 0
        return self.unknown(wanted)

    def unknown(self, wanted: set[str]) -> list[str]:
        """The same without a change of generation, so that what was asked for before stays."""
        wanted, old = wanted.difference(self.new), self.old
        self.remember({k: old[k] for k in wanted.intersection(old)})
        return list(wanted.difference(old))

    def remember(self, found: dict) -> None:
        self.new.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + 180 * len(found)  # 180: of the objects


#: Bytes of an Arrow batch that a task hands to Python: with texts of any length a worker holds few at a time.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on this session hands Python batches of at most BATCH_BYTES, unless less is set."""
    held = spark.conf.get(_BATCH_SETTING, None)
    if held is None or not (size := re.fullmatch(r"(\d+)b?", held)) or not 0 < int(size[1]) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


def map_arrow(df: DataFrame, run: Callable, schema, keep: str | None = None) -> DataFrame:
    """df.mapInArrow(run, schema) by batches of at most BATCH_BYTES, a setting of the session that it makes.

    At its start a task lets go of what operators other than `keep` kept, and at its end of unused memory.
    """
    bound_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name in [n for n in _kept if n != keep]:
            del _kept[name]
        yield from run(batches)
        release_memory()

    return df.mapInArrow(task, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_by_hash(df: DataFrame, limit: int, *hashed: str) -> list[Row]:
    """The first `limit` rows of df in the order of a hash of the columns `hashed`, then of these columns.

    A limit takes that many rows from every task. So only the rows of the lowest hashes are ordered, about four
    times as many as asked for over all tasks; where repeated rows leave fewer than asked for, all rows are.
    """
    order, count = [F.xxhash64(*hashed), *hashed], df.count()
    if count > 4 * limit:
        low = df.filter(F.xxhash64(*hashed) < F.lit((4 * limit << 64) // count - (1 << 63)))
        found = low.orderBy(*order).limit(limit).collect()
        if len(found) == limit:
            return found
    return df.orderBy(*order).limit(limit).collect()


def salts(rows: int) -> int:
    """Sub-groups for number_rows, so that none of a key with so many rows has more than about 250,000."""
    return max(64, -(-rows // 250_000))


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str, salt_from: list[str], salts: int) -> DataFrame:
    """Number the rows of each key from 0 without gaps, also when one key has most rows.

    Rows of a key are split into `salts` sub-groups by a hash of `salt_from`; each is numbered by itself
    and then moved by the number of rows in the sub-groups before it.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys, "_salt").orderBy(*order)
    numbered = salted.withColumn("_own", F.row_number().over(own))
    return numbered.join(offsets, [*keys, "_salt"]).withColumn(out, F.col("_own") - 1 + F.col("_before")).drop("_salt", "_own", "_before")


def by_size(texts: list[str], limit: int) -> Iterator[slice]:
    """Slices of texts of about `limit` characters together, one text at least."""
    start = held = 0
    for n, t in enumerate(texts):
        held += len(t)
        if held >= limit:
            yield slice(start, n + 1)
            start, held = n + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows that agree in the first `keys` columns, from batches sorted by them; a group may span batches."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        start = 0
        for i in range(n):
            key = tuple(c[i] for c in columns)
            if key != at:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield at, pa.Table.from_batches(held)
                held, at, start = [], key, i
        if n > start:
            held.append(batch.slice(start, n - start))
    if held:
        yield at, pa.Table.from_batches(held)
