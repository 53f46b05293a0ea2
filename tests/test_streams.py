from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from quillspark.streaming import ingest, jobs

LONG = "A first paragraph that is long enough to be kept as a section of its own, number {}."


def contents(spark, store):
    return {name: sorted(map(tuple, ingest.table(spark, store, name).collect()), key=str) for name in ingest.SCHEMAS}


def put(folder, name, text):
    with open(folder / name, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def run(spark, folder, store, checkpoint):
    q = ingest.ingest_stream(ingest.file_stream(spark, str(folder)), str(store), str(checkpoint))
    assert q.awaitTermination(180)


def test_files_as_they_arrive(spark, tmp_path):
    folder, store = tmp_path / "files", tmp_path / "store"
    os.mkdir(folder)
    put(folder, "a.txt", "\n\n".join(LONG.format(n) for n in range(40)))
    put(folder, "b.md", "# One\n" + LONG.format("one") + "\n# Two\n" + LONG.format("two"))
    put(folder, "bad.txt", b"x\x00y")
    put(folder, "c.exe", b"MZ")
    put(folder, "d.pdf", b"%PDF-1.7")
    run(spark, folder, store, tmp_path / "cp")
    first = contents(spark, store)
    assert [r[:4] for r in first["ledger"]] == [(5, 3, 0, 2)]
    assert {(r[1], r[2]) for r in first["refused"]} == {("bad.txt", "binary_text"), ("c.exe", "unsupported_extension"), ("d.pdf", "no_decoder")}
    assert {r.source: r.status for r in ingest.current_papers(spark, str(store)).collect()} == {"a.txt": "indexed", "b.md": "indexed"}
    # A copy of a stored work is a duplicate; a file that comes again with another text takes the place of the old one.
    put(folder, "copy.txt", "\n\n".join(LONG.format(n) for n in range(40)))
    put(folder, "new", b"")
    os.makedirs(folder / "later")
    put(folder / "later", "b.md", "# Other\n" + LONG.format("other"))
    run(spark, folder, store, tmp_path / "cp")
    papers = {r.source: (r.status, r.owner, r.batch) for r in ingest.current_papers(spark, str(store)).collect()}
    assert papers["copy.txt"] == ("duplicate", "a.txt", 1) and papers["b.md"] == ("indexed", None, 1) and papers["a.txt"][2] == 0
    chunks = ingest.current_chunks(spark, str(store))
    assert [r.content for r in chunks.filter("source = 'b.md'").collect()] == ["# Other\n" + LONG.format("other")]
    assert chunks.filter("source = 'copy.txt'").count() == 0


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    now = dt.datetime(2024, 1, 1)
    rows = [(f"/in/{n}.txt", now, 100, (LONG.format(n) + "\n\n" + LONG.format("x")).encode()) for n in (1, 1, 2)] + [("/in/no.txt", now, 3, b"a\x00b")]
    files = spark.createDataFrame(rows, ingest.FILES)
    ingest.ingest_batch(files, 7, store)
    first = contents(spark, store)
    assert [r[-1] for r in first["ledger"]] == [7] and {r[0] for r in first["papers"]} == {"1.txt", "2.txt"}
    ingest.ingest_batch(files.unionByName(spark.createDataFrame([("/in/3.txt", now, 1, LONG.encode())], ingest.FILES)), 7, store)
    assert contents(spark, store) == first
    # One that was broken off before its ledger row is done again, and comes out the same.
    import shutil

    shutil.rmtree(f"{store}/ledger")
    shutil.rmtree(f"{store}/papers")
    ingest.ingest_batch(files, 7, store)
    assert contents(spark, store) == first
    ingest.ingest_batch(spark.createDataFrame([], ingest.FILES), 8, store)
    assert ingest.table(spark, store, "ledger").count() == 2


def test_moves_are_judged_in_their_own_order(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda minute: dt.datetime(2024, 1, 1, 0, minute)
    schema = "entity long, ts timestamp, event_id long, status string"
    batches = [
        [(1, at(3), 2, "ACTIVE"), (2, at(1), 3, "ACTIVE"), (3, at(2), 4, "OPEN")],
        [(1, at(2), 1, "OPEN"), (3, at(4), 5, "ANSWERED"), (9, at(30), 99, "OPEN")],  # 1's first move comes after its second
        [(1, at(5), 6, "ANSWERED"), (9, at(59), 100, "ACTIVE")],  # too late: the watermark has passed
        [(9, at(59), 101, "ACTIVE")],
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        allowed = {("OPEN", "ACTIVE"), ("ACTIVE", "ANSWERED")}
        moves = jobs.transition_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), allowed, "OPEN", "10 minutes")
        q = moves.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert (2, 3, None, "ACTIVE", "illegal") in got and (3, 5, "OPEN", "ANSWERED", "illegal") in got
    assert not [r for r in got if r[0] == 1 and r[-1] == "illegal"]
    assert [r for r in got if r[0] == 1] in ([], [(1, 6, None, "ANSWERED", "late")])


def test_stored_names(spark):
    files = spark.createDataFrame([("/x/a b.txt", dt.datetime(2024, 1, 1), 1, b"x")], ingest.FILES)
    assert ingest.stored_name(files).select(F.length("key")).first()[0] == 12 + 1 + len("a_b.txt")
