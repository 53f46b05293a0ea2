"""A data source for results that only count when they are whole: training sets and reports.

`df.write.format("build")` puts one file a task into a folder of its own below `path`, named by the write. Only
when all tasks have ended are the small files written that say what is there: `manifest.json` with the files, their
rows and the counts by `tally`, and any text given as option `note.<name>`. A write that fails removes its folder, so
a reader who starts from the manifest never sees a part of one. Paths are what pyarrow's file systems open.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


@dataclass
class PartWritten(WriterCommitMessage):
    """What a task tells: its file, its rows, and their counts by the tallied column."""

    file: str
    rows: int
    tally: dict[str, int]


class BuildWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("option path is missing")
        self.path, self.tally, self.column, self.suffix = options["path"].rstrip("/"), options.get("tally"), options.get("line"), options.get("suffix", "jsonl")
        self.notes = {k.removeprefix("note."): v for k, v in options.items() if k.startswith("note.")}
        self.folder = f"part-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = self._store()
        store.create_dir(f"{root}/{self.folder}", recursive=True)
        task = TaskContext.get()  # files are named by partition, so that their order is the rows'
        name, rows, tally = f"{self.folder}/{task.partitionId():06d}-{uuid.uuid4().hex}.{self.suffix}", 0, Counter()
        with store.open_output_stream(f"{root}/{name}") as out:
            for row in iterator:
                out.write((row[self.column or 0] + "\n").encode())
                rows += 1
                if self.tally:
                    tally[str(row[self.tally])] += 1
        return PartWritten(name, rows, dict(tally))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._store()
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.file)
        tally = sum((Counter(m.tally) for m in parts), Counter())
        for name, text in {**self.notes, "manifest.json": json.dumps({"files": {m.file: m.rows for m in parts}, "rows": sum(m.rows for m in parts), "tally": dict(sorted(tally.items()))}, ensure_ascii=False, indent=2)}.items():
            with store.open_output_stream(f"{root}/{name}") as out:  # the manifest last
                out.write(text.encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._store()
        if store.get_file_info(f"{root}/{self.folder}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.folder}")


class Build(DataSource):
    """Option path; line: the column that holds a file's lines (the first); tally: a column to count by; note.<name>: texts."""

    @classmethod
    def name(cls) -> str:
        return "build"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BuildWriter(dict(self.options))


def write_build(lines: DataFrame, path: str, line: str = "line", tally: str | None = None, notes: dict[str, str] | None = None, suffix: str = "jsonl") -> None:
    """lines(line, ...) as files below path, and a manifest once all are there."""
    spark = lines.sparkSession
    spark.dataSource.register(Build)
    writer = lines.write.format("build").option("line", line).option("suffix", suffix)
    for name, text in (notes or {}).items():
        writer = writer.option(f"note.{name}", text)
    (writer.option("tally", tally) if tally else writer).mode("append").save(path)


def read_build(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a finished build; what its manifest doesn't name isn't read."""
    manifest = spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0]
    files = [f"{path}/{name}" for name in json.loads(manifest)["files"]]
    return spark.read.text(files).withColumnRenamed("value", "line") if files else spark.createDataFrame([], "line string")


def write_training_set(samples: DataFrame, path: str, rejected: DataFrame | None = None) -> None:
    """samples(messages, source, split) as JSON lines of their messages, train and holdout apart, each with registry and statistics.

    rejected(reason, count) goes into the statistics.
    """
    # The registry's fields of a set of chat samples.
    registry = {"rewriter_train": {"file_name": "manifest.json", "formatting": "sharegpt", "columns": {"messages": "messages"}, "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant", "system_tag": "system"}}}
    reasons = {r["reason"]: r["count"] for r in rejected.collect()} if rejected is not None else {}
    for split in ("holdout", "train"):
        some = samples.filter(F.col("split") == split).select(F.to_json(F.struct("messages")).alias("line"), "source")
        notes = {"build_stats.json": json.dumps({"split": split, "rejected": reasons}, ensure_ascii=False, indent=2)}
        if split == "train":
            notes["dataset_info.json"] = json.dumps(registry, ensure_ascii=False, indent=2)
        write_build(some, f"{path}/{split}", tally="source", notes=notes)


def report_lines(summary: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """A report in Markdown as (part, key, line): the summary's (metric, value), then a table of records by item.

    Parts and keys give the order, so that any number of records can be written.
    """
    text = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-"))
    heads = [("0", "# Report"), ("1", ""), ("2", "## Summary"), ("3", ""), ("4", "| metric | value |"), ("5", "|-|-|")]
    more = [("0", ""), ("1", "## Records"), ("2", ""), ("3", "| item | " + " | ".join(columns) + " |"), ("4", "|" + "-|" * (1 + len(columns)))]
    spark = summary.sparkSession
    head = spark.createDataFrame([(0, *h) for h in heads] + [(2, *h) for h in more], "part int, key string, line string")
    row = lambda first, *cells: F.concat(F.lit("| "), F.concat_ws(" | ", first, *cells), F.lit(" |"))
    return head.unionByName(summary.select(F.lit(1).alias("part"), F.col("metric").alias("key"), row(text("metric"), text("value")).alias("line"))).unionByName(
        records.select(F.lit(3).alias("part"), F.col("item").cast("string").alias("key"), row(text("item"), *map(text, columns)).alias("line"))
    )


def write_report(summary: DataFrame, records: DataFrame, columns: list[str], path: str) -> None:
    """The report as Markdown, in order over its files, and as JSON lines beside it."""
    lines = report_lines(summary, records, columns)
    write_build(records.select(F.to_json(F.struct("item", *columns)).alias("line")), f"{path}/json")
    write_build(lines.orderBy("part", "key").select("line"), f"{path}/markdown", suffix="md")


def jsonl(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows as lines of JSON, for write_build."""
    return df.select(F.to_json(F.struct(*columns)).alias("line"))
