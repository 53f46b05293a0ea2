"""Steps of ingest that stay where the files lie, against plain forms of their rules."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import re

from pyspark.sql import functions as F

from quillspark.functions.text import chunk_id, digit_share, norm_for_match
from quillspark.operators import ingest as steps
from quillspark.operators.ingest import sections_markdown
from quillspark.sources.files import file_reason
from quillspark.streaming import ingest

LINES = ["", "# A", "####### seven", "#no", "## B\r", "#\r", "# a\rb", "# c ", "#\t", "x # y", " # z", "###### six", "#", "# ", " "]


def test_sections_of_markdown_are_split_where_they_lie(spark):
    texts = ["\n".join(p) for p in itertools.product(LINES, repeat=3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    begins = {r.line for r in spark.createDataFrame([(x,) for x in LINES], "line string").filter(F.col("line").rlike(r"^#{1,6}\s+.*$")).collect()}
    want = []
    for d, text in enumerate(texts):
        parts = []
        for line in text.split("\n"):
            parts = [*parts, [line]] if not parts or line in begins else [*parts[:-1], [*parts[-1], line]]
        want += [(d, n, "\n".join(p)) for n, p in enumerate(parts, 1) if re.sub(r"[ \t\n\x0b\f\r]", "", "\n".join(p))]
    found = sections_markdown(docs, "d", "t")
    assert sorted((r.doc, r.section_no, r.text) for r in found.collect()) == sorted(want)
    assert dict(found.dtypes)["section_no"] == "int" and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_the_latest_of_a_name_counts_and_keys_are_those_of_the_contents(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 1, day)
    text = "A paragraph that is long enough to be kept as a section by itself, whatever else there is, number {}, and then some more words to make sure of it, and more."
    rows = [("/a/1.txt", at(1), 9, text.format(1).encode()), ("/b/1.txt", at(2), 9, text.format(2).encode()), ("/a/2.md", at(1), 9, b"# x\n" + text.format(3).encode()), ("/a/3.txt", at(1), 9, b"a\x00b"), ("/c/3.txt", at(1), 9, b"later by its path")]
    files = spark.createDataFrame(rows, ingest.FILES)
    ingest.ingest_batch(files, 0, str(tmp_path))
    assert sorted((r.source, r.path, r.status) for r in ingest.table(spark, str(tmp_path), "papers").collect()) == [("1.txt", "/b/1.txt", "indexed"), ("2.md", "/a/2.md", "indexed"), ("3.txt", "/c/3.txt", "indexed")]
    chunks = {(r.source, r.content): r for r in ingest.table(spark, str(tmp_path), "chunks").collect()}
    assert set(chunks) == {("1.txt", text.format(2)), ("2.md", "# x\n" + text.format(3))}
    made = spark.createDataFrame([(c,) for _, c in chunks], "c string").select("c", chunk_id(F.lit("1.txt"), F.lit("blk"), F.lit("1"), F.col("c"), F.lit(0)).alias("i"))
    assert chunks["1.txt", text.format(2)].chunk_id == {r.c: r.i for r in made.collect()}[text.format(2)]


def test_zero_bytes_and_normal_forms(spark):
    heads = [b"", b"a", b"\x00", b"a\x00", b"\x10\x01", b"\xf0\x0f", b"x" * 4095 + b"\x00", b"x" * 4096 + b"\x00"]
    df = spark.createDataFrame([(n, bytearray(h)) for n, h in enumerate(heads)], "n int, c binary")
    got = {r.n: r.r for r in df.select("n", file_reason(F.lit(".txt"), F.lit(1), F.col("c")).alias("r")).collect()}
    assert [n for n, r in got.items() if r == "binary_text"] == [n for n, h in enumerate(heads) if b"\x00" in h[:4096]]
    texts = [" a  b\t c d 　e\x1c\x1df ", "1, 2 3 ,4", "ﬁ‐‑‒–−—", "a\n\nb\n", "\x1f", "٣ ٤"]
    out = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(norm_for_match("t"), digit_share("t")).collect()]
    assert [r[0] for r in out] == ["a b c d e f", "1234", "fi-----—", "a b", "", "٣٤"]
    assert [r[1] for r in out] == [0.0, 4 / 9, 0.0, 0.0, 0.0, 2 / 3]


def test_copies_follow_their_first_and_make_no_pairs(spark, monkeypatch):
    rand = random.Random(4)
    sets = [sorted(rand.sample("abcdef", rand.randrange(1, 4))) for _ in range(12)]
    given = {n: sets[rand.randrange(12)] for n in range(40)}
    keys = spark.createDataFrame([(n, k) for n, ks in given.items() for k in ks] + [(90, None), (91, None)], "source int, content_key string")
    want = {90: None, 91: None}
    for n, ks in given.items():
        want[n] = min((o for o in range(n) if want[o] is None and 2 * len(set(ks) & set(given[o])) >= len(ks)), default=None)
    asked = []
    whole = steps.containment
    monkeypatch.setattr(steps, "containment", lambda a, b, least: asked.append(a.select("source").distinct().count()) or whole(a, b, least))
    found = steps.batch_duplicates(keys, checkpoint=lambda df: df.localCheckpoint())
    assert {r.source: r.owner for r in found.collect()} == want
    assert asked == [len({tuple(ks) for ks in given.values()}) + 2]
