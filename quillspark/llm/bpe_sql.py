"""Byte-level BPE by recursive SQL: each partition contracts its words, and decodes its documents' ids, in an embedded DuckDB."""

from __future__ import annotations

import base64
import hashlib
import tempfile
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Memo, by_size, kept, map_arrow, table

#: Characters encoded together; bytes of ids that a task remembers, of parts and of words: two generations of so many.
TOGETHER, REMEMBERED = 6_000_000, 64 << 20
#: Words of up to so many bytes contract one pair a round. Longer ones are cut where no token can lie on both sides.
#: Of stretches that are still longer all places of the smallest pair are contracted in a round, so that a run of one
#: letter takes few rounds, and a query does at most ROUNDS of them.
LONGEST, ROUNDS = 256, 64

_ENCODE = """
CREATE OR REPLACE TEMP TABLE coded AS
WITH RECURSIVE s(w, it, pos, tok) AS (
    SELECT w, 0, pos, tok FROM words
    UNION ALL
    SELECT s.w, s.it + 1, s.pos, CASE WHEN s.pos = best.pos THEN best.merged ELSE s.tok END
    FROM s JOIN (
        SELECT w, (min(k) >> 24)::INTEGER AS merged, ((min(k) >> 12) & 4095)::INTEGER AS pos, (min(k) & 4095)::INTEGER AS gone
        FROM (
            SELECT w, (m.rank << 24) | (x.pos << 12) | x.next_pos AS k
            FROM (SELECT w, pos, tok, lead(tok) OVER p AS next_tok, lead(pos) OVER p AS next_pos FROM s WINDOW p AS (PARTITION BY w ORDER BY pos)) x
            JOIN merges m ON m.l = x.tok AND m.r = x.next_tok
        )
        GROUP BY w
    ) best ON best.w = s.w AND s.pos <> best.gone
)
SELECT w, pos, tok FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) last USING (w, it)
"""

#: Of neighbouring places of the smallest pair every second one is contracted, from the left; where a contraction
#: could bring about a smaller pair (not `safe`), only the first place is.
_ENCODE_LONG = """
CREATE OR REPLACE TEMP TABLE coded AS
WITH RECURSIVE s(w, it, pos, tok) AS (
    SELECT w, 0, pos, tok FROM words
    UNION ALL
    SELECT w, it + 1, pos, CASE WHEN hit THEN merged ELSE tok END
    FROM (
        SELECT *, lag(hit, 1, false) OVER (PARTITION BY w ORDER BY pos) AS gone
        FROM (
            SELECT *, here AND row_number() OVER (PARTITION BY w, here, run ORDER BY pos) % 2 = 1 AND (safe OR nth = 1) AS hit
            FROM (
                SELECT *, row_number() OVER (PARTITION BY w, here ORDER BY pos) AS nth, place - row_number() OVER (PARTITION BY w, here ORDER BY pos) AS run
                FROM (
                    SELECT x.w, x.it, x.pos, x.tok, x.place, m.rank AS merged, m.safe, min(m.rank) OVER (PARTITION BY x.w) AS least, coalesce(m.rank = min(m.rank) OVER (PARTITION BY x.w), false) AS here
                    FROM (SELECT w, it, pos, tok, row_number() OVER p AS place, lead(tok) OVER p AS next_tok FROM s WHERE it < {rounds} WINDOW p AS (PARTITION BY w ORDER BY pos)) x
                    LEFT JOIN merges m ON m.l = x.tok AND m.r = x.next_tok
                )
                WHERE least IS NOT NULL
            )
        )
    )
    WHERE NOT gone
)
SELECT w, pos, tok, it FROM s JOIN (SELECT w, max(it) AS it FROM s GROUP BY w) last USING (w, it)
"""

#: Contents are strings of one character a byte.
_DECODE = """
SELECT d, array_to_string(list(t.content ORDER BY pos), '') AS content
FROM rows x JOIN tokens t ON t.id = x.id
GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def members(expression: str) -> set[int]:
    """The code points that the library's own pattern engine puts into a class."""
    import tiktoken

    probe = tiktoken.Encoding("probe", pat_str=expression, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return set(map(ord, probe.decode_bytes(probe.encode_ordinary(every)).decode()))


class Splitter:
    """Splits at a pattern as the library does, whose Unicode tables are not those of the regex package.

    A code point that the two see differently is read as one of the class that the library sees.
    """

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern)
        classes = {r"\p{L}": "a", r"\p{N}": "1", r"\s": "\u3000"}
        theirs = [(members(f"{c}+"), stand_in) for c, stand_in in classes.items()]
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        ours = [set(map(ord, "".join(regex.findall(f"{c}+", every)))) for c in classes]
        differ = set().union(*(t ^ o for (t, _), o in zip(theirs, ours, strict=True)))
        self.stand_ins = {n: next((x for t, x in theirs if n in t), "!") for n in differ}
        self.blank = np.zeros(256, bool)
        self.blank[[n for n in theirs[2][0] if n < 128]] = True
        self.wide_blanks = [np.frombuffer(chr(n).encode(), np.uint8) for n in sorted(theirs[2][0]) if n >= 128]

    def parts(self, data: np.ndarray, starts: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Parts of the texts that lie end to end in `data` (UTF-8) from `starts` on, and how many parts begin before each start.

        A part begins with a text or with ASCII white space behind another character: no match of the pattern
        goes from a run into white space behind it.
        """
        blank = self.blank[data]
        begins = np.zeros(len(data), bool)
        begins[1:] = blank[1:] & ~blank[:-1]
        wide = np.flatnonzero(begins[1:] & (data[:-1] >= 0x80)) + 1  # behind what may be other white space
        for code in self.wide_blanks if len(wide) else ():
            at = wide[wide >= len(code)]
            same = np.ones(len(at), bool)
            for k, byte in enumerate(code):
                same &= data[at - len(code) + k] == byte
            begins[at[same]] = False
        begins[starts[starts < len(data)]] = True
        places = np.flatnonzero(begins)
        offsets = np.append(places, len(data))
        return pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(places, starts)

    def words(self, part: str) -> list[str]:
        if part.isascii():
            return self.find.findall(part)
        read = part.translate(self.stand_ins)
        return self.find.findall(part) if read == part else [part[m.start() : m.end()] for m in self.find.finditer(read)]


class SqlBpe:
    """Encoder of words and decoder of rows of ids; ids are strings of decimals joined by one space."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.split, self.ranks = Splitter(pattern), read_ranks(path)
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.sorted, self.longest, self.reaches = sorted(self.ranks), max(map(len, self.ranks)), {}
        rows = [(ranks_l, ranks_r, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (ranks_l := self.ranks.get(token[:k])) is not None and (ranks_r := self.ranks.get(token[k:])) is not None]
        least: dict[int, int] = {}  # of the pairs that a token is part of
        for a, b, rank in rows:
            least[a], least[b] = min(rank, least.get(a, rank)), min(rank, least.get(b, rank))
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.gettempdir()})
        left, right, rank = (pa.array(c, pa.int32()) for c in zip(*rows, strict=True))
        self._table("merges", {"l": left, "r": right, "rank": rank.cast(pa.int64()), "safe": pa.array([least.get(r, r) >= r for _, _, r in rows])})
        self._table("tokens", {"id": pa.array(self.ranks.values(), pa.int32()), "content": pa.array([t.decode("latin-1") for t in self.ranks], pa.string())})
        self.parts, self.words = Memo(REMEMBERED), Memo(REMEMBERED)

    def _table(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.con.register("arrow_in", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_in")
        self.con.unregister("arrow_in")

    def _give(self, words: dict[int, list[int]]) -> None:
        n = [k for k, ids in words.items() for _ in ids]
        pos = [p for ids in words.values() for p in range(len(ids))]
        self._table("words", {"w": pa.array(n, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array([i for ids in words.values() for i in ids], pa.int32())})

    def _reach(self, ahead: bytes) -> int:
        """The length of the longest token that these bytes begin with."""
        if (found := self.reaches.get(ahead)) is None:
            found, n = 1, 2
            while n <= len(ahead) and (at := bisect_left(self.sorted, part := ahead[:n])) < len(self.sorted) and self.sorted[at].startswith(part):
                if self.sorted[at] == part:
                    found = n
                n += 1
            if len(self.reaches) > 20_000:
                self.reaches.clear()
            self.reaches[ahead] = found
        return found

    def stretches(self, word: bytes) -> list[bytes]:
        """The word cut wherever no token lies on both sides: no contraction goes across, so each stretch is a word of its own."""
        out, start, reach = [], 0, 0
        for k in range(len(word)):
            reach = max(reach, k + self._reach(word[k : k + self.longest]))
            if reach == k + 1:
                out.append(word[start:reach])
                start = reach
        return out

    def encode_words(self, words: list[bytes]) -> list[str]:
        """The ids of words that are matches of the pattern."""
        out, cut, number = [""] * len(words), {}, {}
        for k, w in enumerate(words):
            if (whole := self.ranks.get(w)) is not None:  # as the library does
                out[k] = str(whole)
            else:
                cut[k] = [number.setdefault(x, len(number)) for x in (self.stretches(w) if len(w) > LONGEST else [w])]
        found, short, long = [""] * len(number), {}, {}
        for x, n in number.items():
            (short if len(x) <= LONGEST else long)[n] = [self.byte_ids[b] for b in x]
        if short:
            self._give(short)
            self.con.execute(_ENCODE)
            self._coded(found)
        if long:
            self._give(long)
            rounds = ROUNDS
            while rounds == ROUNDS:  # until no word has a pair left
                self.con.execute(_ENCODE_LONG.format(rounds=ROUNDS))
                rounds = self.con.execute("SELECT max(it) FROM coded").fetchall()[0][0]
                self.con.execute("CREATE OR REPLACE TEMP TABLE words AS SELECT w, pos, tok FROM coded")
            self._coded(found)
        for k, parts in cut.items():
            out[k] = " ".join(map(found.__getitem__, parts))
        return out

    def _coded(self, out: list[str]) -> None:
        for w, ids in self.con.execute("SELECT w, string_agg(tok, ' ' ORDER BY pos) FROM coded GROUP BY w").fetchall():
            out[w] = ids

    def decode(self, rows: list[str]) -> list[bytes]:
        """The bytes of each row of ids, by ordered aggregation over its positions; of no ids, none."""
        out = [b""] * len(rows)
        if not any(rows):
            return out
        ids = [np.fromstring(r, np.int32, sep=" ") for r in rows]
        flat, d = np.concatenate(ids), np.repeat(np.arange(len(ids), dtype=np.int32), list(map(len, ids)))
        self._table("rows", {"d": pa.array(d), "pos": pa.array(np.arange(len(flat))), "id": pa.array(flat)})
        for d, content in self.con.execute(_DECODE).fetchall():
            out[d] = content.encode("latin-1")
        return out

    def _encode_parts(self, parts: list[str]) -> dict[str, str]:
        split = [self.split.words(p) for p in parts]
        unseen = self.words.missing(set().union(*split))
        self.words.remember(dict(zip(unseen, self.encode_words([w.encode() for w in unseen]), strict=True)))
        words = self.words.new.__getitem__
        return {p: " ".join(map(words, ws)) for p, ws in zip(parts, split, strict=True)}

    def encode(self, texts: list[str]) -> Iterator[str]:
        """The ids of each whole text."""
        for some in by_size(texts, TOGETHER):
            _, offsets, data = pa.array(texts[some], pa.large_string()).buffers()
            offsets, data = np.frombuffer(offsets, np.int64)[: len(texts[some]) + 1], np.frombuffer(data or b"", np.uint8)
            parts, number = self.split.parts(data[: offsets[-1]], offsets)
            coded = parts.dictionary_encode()
            found = self.parts.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._encode_parts)
            rows = pa.LargeListArray.from_arrays(number, pa.array(found, pa.large_string()).take(coded.indices))
            yield from pc.binary_join(rows, pa.scalar(" ", pa.large_string())).to_numpy(zero_copy_only=False).tolist()

    def round_trip(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of each whole text and what they decode to."""
        for some in by_size(texts, TOGETHER):
            coded = list(self.encode(texts[some]))
            yield from zip(coded, self.decode(coded), strict=True)


def bpe_round_trip(df: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each row's whole text and decode its ids: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids).

    A null text counts as empty: no ids, digests of nothing. Special tokens aren't known: their strings are
    ordinary text. Repeated rows and null ids are encoded each for itself; an empty table gives no rows;
    other columns of df aren't read.
    """

    name = f"bpe {ranks_path} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(name, lambda: SqlBpe(ranks_path, pattern))
        for b in batches:
            rows = ([], [], [], [])
            for ids, content in coder.round_trip([t or "" for t in b.column(1).to_pylist()]):
                rows[0].append(ids.count(" ") + bool(ids))
                rows[1].append(hashlib.sha256(ids.encode()).hexdigest())
                rows[2].append(hashlib.sha256(content).hexdigest())
                if with_ids:
                    rows[3].append([int(x) for x in ids.split()])
            arrays = [b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(rows[3], pa.list_(pa.int32()))] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_arrow(df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")), run, schema, name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
