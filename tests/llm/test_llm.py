from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe_merge, bpe_sql, exact_dedup, language_id, nearest, packing, sharding, simhash, token_count, toxicity, transcripts
from quillspark.llm.common import first_by_hash

LONG = "lorem ipsum dolor " * 20_000
TEXTS = [None, "", "  ", "Hello world", "Hello world", "hello World it's 42", LONG, "été ñandú ß日本", "a" * 3000, "<|endoftext|> x", "word\ttab\nline  two"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, "en", "s", 0, True, "x") for n, t in enumerate(TEXTS)] + [(3, "Hello world", None, None, None, None, None), (None, "no id", "en", "s", 0, True, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(docs, none):
    got = by_id(exact_dedup.exact_dedup(docs))
    assert (got[0].keep_id, got[0].group_size, got[0].kept, got[1].kept) == (1, 2, False, True)
    assert (got[3].keep_id, got[3].group_size) == (4, 3) and got[None].kept
    assert got[6].text_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_grace_spills_and_compares_content(tmp_path):
    records = [(h, b"%d" % (n % 50) * 100, n, 1) for n in range(500) for h in [(n % 3) << 62]]  # clashing hashes
    groups = list(exact_dedup.grace_groups(iter(records), str(tmp_path), table_bytes=2000))
    want = {}
    for h, c, n, _ in records:
        k = want.setdefault((h, c), [0, 0])
        k[0], k[1] = max(k[0], n), k[1] + 1
    assert {(g[0], g[1]): [g[2], g[3]] for g in groups} == want and len(groups) == len(want)
    assert not list(tmp_path.iterdir())


@given(st.lists(st.integers(1, 50), min_size=1, max_size=9), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_smallest_capacity(sizes, shards):
    best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *cuts, len(sizes)))) for cuts in itertools.combinations_with_replacement(range(len(sizes) + 1), shards - 1))
    assert sharding.smallest_capacity(np.array(sizes), shards) == best
    cuts = sharding.even_cuts(np.array(sizes), shards)
    assert max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *cuts, len(sizes)))) == best


def test_sharding(docs, none, spark):
    rows = sharding.shard_by_bytes(docs, 3).collect()
    assert len(rows) == docs.count() and {r.law for r in rows} == {"bytes"}
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"Hello world")}) == 1
    assert sharding.shard_by_bytes(none, 3).count() == 0
    many = spark.createDataFrame([(n, f"text {n} " * (n % 17 + 1)) for n in range(6000)], "doc_id long, text string")
    sums = [r[0] for r in sharding.shard_by_bytes(many, 40).groupBy("shard").sum("size").select("sum(size)").collect()]
    assert len(sums) == 40 and max(sums) - min(sums) <= 2 * 250


@given(st.lists(st.integers(1, 20), max_size=60))
@settings(max_examples=80, deadline=None)
def test_packing_plan(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    runs, n = packing.pack_lengths(dict(counts), 20)
    held: dict[int, list] = {}
    seen = {k: [] for k in counts}
    for r in runs:
        for i in range(r.count):
            held.setdefault(r.sequence + i // r.each, []).append((r.offset + i % r.each * r.length, r.length))
            seen[r.length].append(r.first + i)
    assert all(sorted(v) == list(range(counts[k])) for k, v in seen.items())
    assert sorted(held) == list(range(n))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 20
    assert n <= -(-sum(lengths) * 11 // 90) + 1


def test_pack(docs, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = packing.pack(docs, path).collect()
    tokenizer = Tokenizer.from_file(path)
    for n, t in enumerate(TEXTS):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == n})
        assert pieces == [(k, a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048)) for x in [np.array(ids[a : a + 2048])]]
    assert packing.pack(none, path).count() == 0


def test_token_count(docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    got, tokenizer = by_id(token_count.count_tokens(docs, path)), Tokenizer.from_file(path)
    for n, t in enumerate(TEXTS):
        want = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        assert (got[n].n_tokens, got[n].over_limit, got[n].n_bytes) == (want, want > 512, len((t or "").encode()))
    assert token_count.count_tokens(none, path).count() == 0


@given(st.text(alphabet="abstrevlmd'  \n\t1２é.!　日", max_size=60))
@settings(max_examples=150, deadline=None)
def test_scan_marks_the_pattern_at_any_chunk_size(text):
    import regex

    nxt, out = token_count.splitter()
    classes = np.append(COUNTER.code[[ord(c) for c in text]], token_count.END).astype(np.uint8)
    for chunk in (3, 256):
        marks = token_count.scan(classes, nxt, out, chunk)
        starts = {int(k) for k in np.flatnonzero(marks & token_count.HERE)} | {int(k) - 1 for k in np.flatnonzero(marks & token_count.BACK)}
        assert starts == {m.start() for m in regex.finditer(P.PATTERN, text)}


COUNTER = token_count.TokenCounter(P.path("byte_bpe_50k.json"))


def test_bpe_round_trip(docs, none):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    got = by_id(bpe_sql.bpe_round_trip(docs, path))
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_sql.read_ranks(path), special_tokens={})
    for n, t in enumerate(TEXTS):
        ids = encoding.encode_ordinary(t or "")
        assert (got[n].n_tokens, got[n].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[n].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_sql.bpe_round_trip(none, path).count() == 0
    assert bpe_sql.SqlBpe(path, P.PATTERN).decode([" ".join(map(str, encoding.encode_ordinary("ab été"))), ""]) == ["ab été".encode(), b""]


def odd_texts():
    """Before a contraction, every code point that Python's tables class otherwise than the libraries' do; words of thousands of bytes."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    odd = sorted(SPLIT.stand_ins)
    return ["".join(f"{chr(c)}'ll {chr(c)} " for c in odd[k : k + 500]) for k in range(0, len(odd), 500)] + ["a" * 3000, "ab" * 700, "".join(rng.choice(letters, 1500)), "=" * 999 + "日本" * 300, "!\x1c a\x1f\x00", "　  　 \t\n  a"]


SPLIT = bpe_sql.Splitter(P.PATTERN)


def test_ids_are_those_of_the_library_for_every_code_point_and_long_words():
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_sql.read_ranks(path), special_tokens={})
    coder = bpe_sql.SqlBpe(path, P.PATTERN)
    for text, (ids, content) in zip(odd_texts(), coder.round_trip(odd_texts()), strict=True):
        assert ids == " ".join(map(str, encoding.encode_ordinary(text))) and content == text.encode()
    pairs = {(a, b): (r, r) for a, b, r in coder.con.execute("SELECT l, r, rank FROM merges").fetchall()}
    word = odd_texts()[-4].encode()  # longer than a query's rounds
    assert coder.encode_words([word])[0] == " ".join(map(str, bpe_merge.contract([coder.byte_ids[b] for b in word], pairs)))


def test_counts_are_those_of_the_library_for_every_code_point_and_long_words():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert COUNTER.count(odd_texts()) == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in odd_texts()]


@given(st.binary(min_size=1, max_size=40) | st.text(alphabet="aehinorst ", min_size=1, max_size=60).map(str.encode))
@settings(max_examples=300, deadline=None)
def test_transitions_carry_the_growth_of_merging(word):
    machine = COUNTER.machine
    assert [machine.count(word[:k]) for k in range(1, len(word) + 1)] == [len(bpe_merge.contract([machine.byte_ids[b] for b in word[:k]], machine.pairs)) for k in range(1, len(word) + 1)]


def test_masks_cover_every_four_positions():
    masks = simhash.covering_masks(4)
    assert all(any(not any(m >> i & 1 for i in c) for m in masks) for c in itertools.combinations(range(64), 4))
    for mask in masks[::10]:  # the second masks cover what the first leave out, and hold the first
        second = simhash.second_masks(mask, 4)
        assert all(m & mask == mask and 64 - m.bit_count() <= 17 for m in second)
        free = [1 << i for i in range(64) if not mask >> i & 1]
        assert all(any(not m & sum(c) for m in second) for c in itertools.combinations(free, 4))


def test_simhash(docs, none, spark, monkeypatch):
    got = by_id(simhash.simhash_groups(docs))
    assert got[0].fingerprint == "0" * 16 and got[0].component_id == got[1].component_id == got[2].component_id == 0
    assert got[4].component_id == 3 and got[None].component_id is None
    assert simhash.simhash_groups(none).count() == 0
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 20, dtype=np.int64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 6), replace=False)) for c in centres for _ in range(30)})
    fps += [-x - 1 for x in fps]
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")

    def parts(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {x: find(x) for x in fps}

    expected = parts((a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    links = simhash.near_links(nodes, 4).collect()
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {x: found.get(x, x) for x in fps} == expected
    for bound in (simhash.MAX_BROADCAST, 0):  # buckets of more than three dealt by second masks
        monkeypatch.setattr(simhash, "MAX_BROADCAST", bound)
        again = simhash.near_links(nodes, 4, 3).collect()
        assert parts(again) == expected and all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in again)


def test_first_rows_of_languages(spark):
    """Against all rows in order: a large language, one of repeats only in its lowest hashes, a small one, and none."""
    schema = "lang string, i long, h long"
    many = [("xx", n, n % 7) for n in range(1500)] + [("zz", n, 1) for n in range(5)]
    repeats = [("yy", n % 20, 3) for n in range(600)]
    ids = spark.createDataFrame(many + repeats, schema)
    got = sorted(map(tuple, language_id.first_rows(ids)))
    ranked = {}
    for r in ids.distinct().selectExpr("*", "xxhash64(i) AS x").orderBy("x", "i", "h").collect():
        ranked.setdefault(r.lang, []).append((r.i, r.h))
    assert got == sorted((lang, i, h, n + 1) for lang, rows in ranked.items() for n, (i, h) in enumerate(rows[: language_id.MAX_ROWS]))
    assert language_id.first_rows(spark.createDataFrame([], schema)) == []


def test_nearest(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:600] = x[100]  # a third are copies of one vector
    rows = [(n, v.tolist()) for n, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] + [1.0] * 15), (5150, [None] + [1.0] * 15)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    d = x.astype(float)
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in mine}
        s = np.round(d @ d[q], 12)
        s[q] = -9
        hits += len({r.vec_id for r in mine} & set(np.lexsort((np.arange(1500), -s))[:5].tolist()))
        assert all(r.score == pytest.approx(float(d[q] @ d[r.vec_id])) for r in mine)
    assert hits >= 0.9 * 150 and {r.query_id for r in got} == set(range(0, 1500, 50))
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_of_tiny_and_huge_vectors_repeats_and_clashes(spark):
    rows = [(0, [1e-200, 0.0], "a"), (50, [1e200, 1e200], "b"), (50, [1e200, 1e200], "b"), (1, [3e-300, 4e-300], "c"), (1, [0.0, -5e-324], "d"), (None, [1.0, 0.0], "e")]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), k=3).collect()
    mine = [(r.vec_id, round(r.score, 12)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0]
    assert mine == [(50, round(0.5**0.5, 12)), (1, 0.6), (1, 0.0)]
    assert all(np.isfinite(r.score) for r in got) and {r.query_id for r in got} == {0, 50}


def test_scan_keeps_the_nearest_over_all_tiles(monkeypatch):
    monkeypatch.setattr(nearest, "TILE", 100)
    monkeypatch.setattr(nearest, "QUERIES_TOGETHER", 3)
    rng = np.random.default_rng(2)
    x = nearest._unit(rng.standard_normal((700, 48)))
    found = list(nearest.adaptive_scan(x[:20], x, 6, epsilon=50.0))  # a test that abandons nothing within reach
    for q, left in zip(x[:20], found, strict=True):
        d = ((x - q) ** 2).sum(axis=1)
        assert set(np.argsort(d)[:6].tolist()) <= set(left.tolist()) and len(left) == len(set(left.tolist()))


def test_nearest_finds_k_from_small_lists(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.standard_normal((3, 32)), 667, axis=0)[:2000] + 0.01 * rng.standard_normal((2000, 32))
    x[::50] = rng.standard_normal((40, 32))  # outliers
    got = nearest.nearest(spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>"), every=1)
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {5} and got.select("query_id").distinct().count() == 2000


def test_language(spark, docs, none):
    words = {"en": "the of and to in is was that for it with".split(), "de": "der die und das nicht ein ist mit von zu".split()}
    rng = np.random.default_rng(1)
    rows = [(n, " ".join(rng.choice(words[lang], 40)), lang) for n, lang in enumerate(["en", "de"] * 40)] + [(900, None, "en"), (901, "123 !!", None), (902, "The", None)]
    got = by_id(language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    held = [n for n in range(80) if zlib.crc32(str(n).encode()) % 4 == 2]
    assert held and all(got[n].held_out for n in held) and all(got[n].lang_pred == ("en", "de")[n % 2] for n in held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and 0 <= got[902].score <= 1
    assert language_id.identify(none).count() == 0 and language_id.identify(docs).count() == docs.count()


def test_copies_under_many_ids_take_one_place_of_a_language(spark, monkeypatch):
    from pyspark.sql import functions as F

    found, plain = [], language_id.first_rows
    monkeypatch.setattr(language_id, "first_rows", lambda ids: found.extend(rows := plain(ids)) or rows)
    rows = [(n, "copy of one text", "en") for n in range(3000)] + [(5000 + n, f"text {n}", "en") for n in range(100)]
    language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(found) == len({r["h"] for r in found}) == language_id.MAX_ROWS


def greedy_phrases(text, document):
    n = at = 0
    while at < len(document):
        k = 1
        while at + k < len(document) and document[at : at + k + 1] in text:
            k += 1
        at, n = at + k, n + 1
    return n


def test_phrases_are_those_of_a_greedy_parse(monkeypatch):
    """Also over the edges of blocks, where the guess of a block's first state is wrong, and for unknown characters."""
    parser = language_id.CrossParser({"x": "abcab"})
    for t in ("abcab", "bb", "cabcab", "aabbcc", "zabz", "zzabza", "", "abc" * 9):
        assert parser.phrases([t])[0, 0] == greedy_phrases("abcab", t), t
    rng = np.random.default_rng(0)
    learnt = {"x": "".join(rng.choice(list("abc "), 3000)), "y": "ab" * 500, "z": "".join(map(chr, rng.integers(0x4E00, 0x9000, 2000)))}
    texts = ["".join(rng.choice(list("abcd "), n)) for n in (1, 7, 31, 32, 33, 400)] + ["ab" * 200, "a" * 300, learnt["z"][100:300] + "漢字" * 20, ""]
    parser = language_id.CrossParser(learnt)
    for block, before in ((4096, 256), (32, 8), (16, 1)):
        monkeypatch.setattr(language_id, "BLOCK", block)
        monkeypatch.setattr(language_id, "BEFORE", before)
        assert parser.phrases(texts).tolist() == [[greedy_phrases(learnt[k], t) for k in "xyz"] for t in texts]


def test_ten_scripts_are_told_apart():
    """Every character of the sample has a symbol, however many scripts there are; other scripts are foreign."""
    starts = {"latin": 0x61, "greek": 0x3B1, "cyrillic": 0x430, "hebrew": 0x5D0, "arabic": 0x628, "devanagari": 0x915, "thai": 0xE01, "georgian": 0x10D0, "hangul": 0xAC00, "han": 0x4E00}
    rng = np.random.default_rng(1)

    def text(script, n):
        words = ["".join(chr(starts[script] + k) for k in np.random.default_rng(w).integers(0, 300 if script in ("han", "hangul") else 20, 4)) for w in rng.zipf(1.4, n) % 500]
        return " ".join(words)

    parser = language_id.CrossParser({s: text(s, 2000) for s in starts})
    found = language_id.languages(parser, [text(s, 30) for s in starts] + ["ⴰⴱⴲⴳⴴ ⴵⴶⴷⴸ " * 5, "a", "1 2"])
    assert [x[0] for x in found[:10]] == list(starts) and all(x[2] for x in found[:10])
    assert not found[10][2] and found[11][2] and found[12] == ("und", 0.0, False)
    assert sum(m.owner.nbytes + m.to.nbytes for m in parser.machines) < 60 * sum(m.chars for m in parser.machines)


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for n in range(600):
        bad = n % 6 == 0
        rows.append((n, " ".join([*rng.choice(words, 60), *(["nasty", "vile"] * bad)])))
        labels.append((n, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None)], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(d, y))
    wrong = [n for n in range(600) if got[n].held_out and got[n].predicted != (n % 6 == 0)]
    assert not wrong and got[1].held_out == (zlib.crc32(b"1") % 3 == 1)
    scored = toxicity.toxicity(docs, y).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.toxicity(none, y).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs, y.limit(0)).collect()} == {0}


def test_transcripts(spark):
    turns = [(c, n, "user" if n % 2 == 0 else "assistant", f"Line of turn {n}.\nmore text here") for c in range(40) for n in range(8)] + [(99, n, "user" if n % 2 == 0 else "assistant", f"Turn {n}.") for n in range(1300)] + [(100, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = sorted(transcripts.recover(df).collect(), key=lambda r: (r.conv_id, r.block, r.seq))
    whole = "".join(r.turn for r in got if r.conv_id == 99)
    assert whole.count("<|im_start|>") == whole.count("<|im_end|>") and "Turn 1299." in whole  # over three blocks
    right = sum(sum(1 for r in got if r.conv_id == c) == 8 for c in range(40))
    assert right >= 20 and transcripts.recover(df.limit(0)).count() == 0


def test_no_block_holds_more_lines_than_it_may(spark):
    """Rows without a conversation or a turn number, and a single turn of many lines."""
    rows = [(None, None, "user", "same\ntext")] * 900 + [(None, None, "user", f"text {n}") for n in range(900)] + [(5, 1, "user", "\n".join(f"line {n}" for n in range(2000))), (5, 0, "system", "first")]
    lines = transcripts.transcript_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert lines.groupBy("conv_id", "block").count().agg({"count": "max"}).first()[0] == transcripts.BLOCK
    for conv, size in ((-1, 2700), (5, 2001)):
        mine = lines.filter(lines.conv_id == conv).orderBy("n").collect()
        assert [r["n"] for r in mine] == list(range(size)) and all(r.block == r["n"] // transcripts.BLOCK for r in mine)
        assert all(b.line_no in (0, a.line_no + 1) for a, b in zip(mine, mine[1:], strict=False))
    assert mine[0].line.endswith("first") and [r.line for r in mine[2:]] == [f"line {n}" for n in range(1, 2000)]


def test_blocks_decode_as_the_whole(spark):
    df = spark.createDataFrame([(1, n, "user" if n % 3 else "assistant", f"Text {n}") for n in range(60)], "conv_id long, turn long, role string, text string")
    lines = transcripts.transcript_lines(df)
    model = transcripts.fit(lines)
    rows = lines.orderBy("pos", "line_no").collect()
    f = [transcripts.line_features(r.line) for r in rows]
    a, b = f[:25], f[25:]
    v = model.matrix(a)[transcripts.N_STATES][:, None] + model.matrix(b)[: transcripts.N_STATES]
    last = int(v.max(axis=0).argmax())
    middle = int(v[:, last].argmax())
    whole = model.decode(f, -1, int(model.matrix(f)[transcripts.N_STATES].argmax()))
    assert model.decode(a, -1, middle) + model.decode(b, middle, last) == whole


def test_pipeline_from_end_to_end(spark, tmp_path):
    """Toxic, foreign and copied rows go, the rest is packed; nulls, empties, repeats and clashing names pass through all stages."""
    import corpus_pipeline as c

    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(300)]
    rows = [(n, " ".join([*rng.choice(words, 60), *(["nasty", "vile"] * (n % 6 == 0))]), "en", "k") for n in range(300)]
    rows += [(900, None, "en", "k"), (901, "", None, "k"), (902, "漢字仮名交文" * 9, None, "k"), (903, rows[1][1], "en", "k"), (1, rows[1][1], "en", "k"), (None, rows[2][1], None, None), (None, "w1 w2 w3 another", "en", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row_key string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, int(n % 6 == 0)) for n in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = c.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows if r[0] is None or r[0] >= 300 or r[0] % 6}
    lettered = c.drop_unknown_language(spark, docs, str(tmp_path))
    assert lettered.columns == docs.columns and {r[0] for r in rows} - {r.doc_id for r in lettered.collect()} == {900, 901, 902}
    assert c.drop_unknown_language(spark, docs.withColumn("lang", docs.lang.substr(1, 0)).limit(0), "").count() == 0
    packed = c.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in packed]
    assert len(ids) == len(set(ids)) and None in ids and not {0, 6, 900, 901, 902, 1} & set(ids) and {2, 903} <= set(ids)
    empty = [stage(spark, docs.limit(0), str(tmp_path)).count() for _, stage in c.STAGES]
    assert empty == [0] * 5


def test_pipeline_keeps_columns(spark, docs):
    import corpus_pipeline as c

    assert c.drop_exact_copies(spark, docs, "").columns == docs.columns
    left = c.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns and left.filter("doc_id IS NULL").count() == 1


def test_pipeline_leaves_clashing_columns_alone(spark):
    import corpus_pipeline as c

    names = ["text_sha256", "keep_id", "group_size", "key", "hot", "fp", "component_id", "root"]
    df = spark.createDataFrame([(1, "a b", *names), (2, "a b", *names), (3, None, *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for stage in (c.drop_exact_copies, c.drop_near_copies):
        left = stage(spark, df, "")
        assert left.columns == df.columns and all(tuple(r)[2:] == tuple(names) for r in left.collect()) and left.count() == 2


def test_pipeline_keeps_one_row_of_each_group(spark):
    """Rows that repeat id and text, groups without ids, and one id with a near copy and with another text."""
    import corpus_pipeline as c

    base = " ".join(f"word{n}" for n in range(400))
    near, other = base.replace("word7 ", "wrod7 "), " ".join(f"thing{n * n}" for n in range(300))
    assert (simhash.fingerprint(base) ^ simhash.fingerprint(near)).bit_count() <= 4 < (simhash.fingerprint(base) ^ simhash.fingerprint(other)).bit_count()
    schema = "doc_id long, text string"
    rows = [(1, "a b c")] * 3 + [(2, "a b c"), (2, "a b c"), (None, "a b c")] + [(None, "no one")] * 4 + [(3, None), (3, None), (None, "")]
    left = c.drop_exact_copies(spark, spark.createDataFrame(rows, schema), "")
    assert sorted(map(tuple, left.collect()), key=str) == [(2, "a b c"), (3, None), (None, "no one")]
    rows = [(5, base), (5, base), (6, near), (6, other), (None, near), (None, "no one")] + [(None, "no one")] * 3
    left = c.drop_near_copies(spark, spark.createDataFrame(rows, schema), "")
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(5, base), (6, other), (None, "no one")], key=str)


def test_hot_texts_are_joined_apart(spark, monkeypatch):
    df = spark.createDataFrame([(n, ("hot", f"own {n // 2}")[n % 3 > 0]) for n in range(60)] + [(None, "hot")], "doc_id long, text string")
    plain = sorted(exact_dedup.exact_dedup(df).collect(), key=str)
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 5)
    assert sorted(exact_dedup.exact_dedup(df).collect(), key=str) == plain
    assert {r.keep_id for r in plain if r.text_sha256 == hashlib.sha256(b"hot").hexdigest()} == {57}


def test_first_by_hash_is_the_plain_order(spark):
    from pyspark.sql import functions as F

    for df in (spark.range(5000), spark.createDataFrame([(n % 3,) for n in range(900)], "id long")):
        want = [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(40).collect()]
        assert [r.id for r in first_by_hash(df, 40, "id")] == want
    assert first_by_hash(spark.range(0), 40, "id") == []


def test_states_of_blocks_do_not_depend_on_levels(spark):
    rng = np.random.default_rng(4)
    rows = [(c, b, rng.standard_normal((transcripts.N_STATES + 1) * transcripts.N_STATES).tolist()) for c, n in ((1, 1), (2, 3), (3, 29)) for b in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, block long, m array<double>")
    want = sorted(map(tuple, transcripts.block_states(df).collect()))
    assert len(want) == 33 and sorted(map(tuple, transcripts.block_states(df, 3).collect())) == want
    assert transcripts.block_states(df.limit(0)).count() == 0


def test_large_groups_get_shards_of_their_own(spark):
    rows = [(f"{n:03x}", 10) for n in range(100)] + [("a" * 3, 5000), ("b" * 3, 900), ("c" * 3, 400)]
    own, cuts = sharding.plan(spark.createDataFrame(rows, "key string, size long"), 8)
    assert own == ["aaa", "bbb", "ccc"] and len(cuts) == 4


def test_word_ids_are_the_library_s():
    tokenizers = pytest.importorskip("tokenizers")
    path, r = P.path("word_bpe_49k.json"), random.Random(5)
    library = tokenizers.Tokenizer.from_file(path)
    letters = [*"aAbHsStTIK'|<>.,;:!_-%$09 \n\téÉ×İ̸̱́̇Σẖ　中क", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL"]
    texts = [None, "", " ", "\n", ". ", *("".join(r.choice(letters) for _ in range(r.randrange(1, 14))) for _ in range(5000))]
    want = [library.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]
    assert [ids.tolist() for ids in packing.WordIds(path).encode(pa.array(texts, pa.string()))] == want
    assert [ids.tolist() for ids in packing.WordIds(path).encode(pa.array(texts, pa.string()).slice(3, 4))] == want[3:7]


def test_long_texts_are_cut_behind_blanks(monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "AT_ONCE", 16)
    texts = ["a" * 40 + " b.c " + "Word, " * 9, "x" * 50, "one two", "", " " * 40]
    assert [ids.tolist() for ids in packing.WordIds(path).encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids + [0] for t in texts]
