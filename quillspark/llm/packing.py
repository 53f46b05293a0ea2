"""Best-fit packing of token pieces after Martello-Toth dominance reduction."""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import Memo, kept, map_arrow, materialize, number_rows, salts, table

CAPACITY = 2048
#: Bytes of ids that a task remembers, with their parts of texts: two generations of so many; the older goes first.
REMEMBERED = 64 << 20
#: Bytes of text that are taken apart at once; longer texts are cut behind a blank.
AT_ONCE = 4 << 20

_LETTER, _MARK, _BLANK = 1, 2, 3


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[c for c in range(128) if chr(c).isalnum()]] = _LETTER
    kinds[[ord(c) for c in string.punctuation if c not in "'|"]] = _MARK  # these two stand within contractions and special tokens
    kinds[[ord(" "), ord("\n")]] = _BLANK
    return kinds


_KINDS = _kinds()


def split_parts(data: np.ndarray, starts: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """Parts of the texts that lie end to end in `data` (UTF-8) from `starts` on, and how many parts begin before each start.

    Ends of parts are blanks, which are dropped, and changes from a letter or digit to a mark, where the
    tokenizer always splits. Letters A-Z are lower-cased as the tokenizer does, except before what may be a
    combining character (with which a capital can compose otherwise) and where special tokens may occur.
    """
    after, before = np.empty_like(data), np.empty_like(data)
    after[:-1], after[-1], before[1:], before[0] = data[1:], 0xFF, data[:-1], 0
    if not ((data == ord("<")) & (after == ord("|"))).any():
        data = data + (((data >= ord("A")) & (data <= ord("Z")) & (after < 0xCC)).view(np.uint8) << 5)
    kinds = _KINDS[data]
    kinds[(before == 0xC3) & (data >= 0x80) & (data != 0x97) & (data != 0xB7)] = _LETTER  # U+00C0 to U+00FF but the signs
    blank = kinds == _BLANK
    begins = np.zeros(len(data), bool)
    begins[starts[starts < len(data)]] = True
    begins[1:] |= blank[:-1] | ((kinds[:-1] == _LETTER) & (kinds[1:] == _MARK))
    begins &= ~blank
    number = np.searchsorted(np.flatnonzero(begins), starts)
    kept_bytes = data[~blank]
    offsets = np.append(np.flatnonzero(begins[~blank]), len(kept_bytes)).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(kept_bytes)), number


class WordIds:
    """Token ids of texts, part by part.

    The tokenizer drops white space and no token spans it or the change from a letter to a mark, so ids of the
    parts, taken one after the other, are the ids of the text. Parts that are letters alone are given to the
    tokenizer many at a time and told apart by the ids that end a word.
    """

    def __init__(self, path: str, end_id: int = 0):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end = end_id
        self.memo = Memo(REMEMBERED)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        groups = [words[at : at + 128] for at in range(0, len(words), 128)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) == len(group):
                data, stops = ids.tobytes(), (4 * ends).tolist()
                out += [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            else:
                out += [i.tobytes() for i in self._ids(group)]
        return out

    def _encode_parts(self, parts: list[str]) -> dict[str, bytes]:
        words, rest = [p for p in parts if p.isalpha()], [p for p in parts if not p.isalpha()]
        found = dict(zip(words, self._encode_words(words), strict=True))
        found.update(zip(rest, (i.tobytes() for i in self._ids(rest)), strict=True))
        return found

    def _encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that lie end to end in data, and the places where those of each text begin, and the end."""
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(len(starts), np.int64)
        parts, number = split_parts(data, starts)
        coded = parts.dictionary_encode()
        found = self.memo.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._encode_parts)
        pool, lengths = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        codes = coded.indices.to_numpy()
        each = lengths[codes]
        stops = np.concatenate([[0], np.cumsum(each)])
        first = np.cumsum(lengths) - lengths
        return pool[np.repeat(first[codes] - stops[:-1], each) + np.arange(stops[-1])], stops[number]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text and the end id, little-endian unsigned 32-bit; a null text has the end id alone."""
        texts = texts.cast(pa.large_string()).fill_null("")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + AT_ONCE, "right")) - 1)
            if offsets[to] - offsets[at] > AT_ONCE:  # one long text
                yield np.concatenate([*self._long(data[offsets[at] : offsets[to]]), np.array([self.end], "<u4")])
            else:
                ids, places = self._encode(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                ids = np.insert(ids, places[1:], self.end)
                places = places + np.arange(len(places))
                for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
                    yield ids[a:b]
            at = to

    def _long(self, data: np.ndarray) -> Iterator[np.ndarray]:
        while len(data):
            blanks = np.flatnonzero(_KINDS[data[:AT_ONCE]] == _BLANK)
            if not len(blanks):  # as far as the next blank
                blanks = np.flatnonzero(_KINDS[data] == _BLANK)[:1]
            to = int(blanks[-1]) + 1 if len(blanks) and len(data) > AT_ONCE else len(data)
            yield self._encode(data[:to], np.array([0, to]))[0]
            data = data[to:]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(f"packing {path}", lambda: WordIds(path))
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc_id, data in zip(ids, coder.encode(batch.column(1)), strict=True):
                for n, at in enumerate(range(0, len(data), capacity)):
                    part = data[at : at + capacity]
                    for column, value in zip(rows, (doc_id, n, at, len(part), zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids of each row's text and its end id: doc_id, piece, start, length, ids_crc32."""
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return map_arrow(rows, _pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long", f"packing {tokenizer_path}")


@dataclass(frozen=True)
class Run:
    """Pieces number first to first + count - 1 of this length go to sequences sequence, sequence + 1, ...: `each` to one, from `offset` on."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


class Packing:
    """Packs a histogram of lengths; the number of runs depends on the capacity, not on the number of pieces."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {k: v for k, v in counts.items() if v}
        self.taken = dict.fromkeys(counts, 0)
        self.capacity, self.sequences, self.runs = capacity, 0, []

    def _put(self, length: int, count: int, sequence: int, each: int, offset: int) -> None:
        self.runs.append(Run(length, self.taken[length], count, sequence, each, offset))
        self.taken[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _new(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _fix(self, pieces: list[int]) -> None:
        """Sequences of exactly these pieces, until one length runs out."""
        need = Counter(pieces)
        n = min(self.left[k] // times for k, times in need.items())
        at, offset = self._new(n), 0
        for k, times in need.items():
            self._put(k, n * times, at, times, offset)
            offset += k * times

    def _dominating(self, w: int) -> list[int] | None:
        """The set with a piece w that is as good as any other: each other one's pieces fit where this one's are.

        With r the room beside w and k the largest piece that fits: w alone if nothing fits; w and k if k fills r, if
        no two pieces fit into r, or if no three do and no two that fit are together longer than k; w, k and the
        largest piece l beside them if no three fit and no two longer than l do. Taking pieces away later leaves this
        true, so a set may be fixed as often as there are pieces for it.
        """
        room = self.capacity - w
        sizes = sorted(k for k, n in self.left.items() if k <= room and n > (k == w))
        if not sizes:
            return [w]
        k, copies = sizes[-1], {x: self.left[x] - (x == w) for x in sizes}

        def smallest(of: list[int], n: int) -> list[int]:
            found: list[int] = []
            for x in of:
                found += [x] * min(copies[x], n - len(found))
                if len(found) == n:
                    break
            return found

        fits = lambda of, n: len(x := smallest(of, n)) == n and sum(x) <= room
        if k == room or not fits(sizes, 2):
            return [w, k]
        if fits(sizes, 3):
            return None
        beside = [x for x in sizes if x <= room - k and copies[x] > (x == k)]
        if beside:
            return None if fits([x for x in sizes if x > beside[-1]], 2) else [w, k, beside[-1]]
        low, high, best = 0, len(sizes) - 1, 0
        while low <= high:  # the longest two that fit
            if sizes[low] + sizes[high] > room or low == high and copies[sizes[low]] < 2:
                high -= 1
            else:
                best = max(best, sizes[low] + sizes[high])
                low += 1
        return [w, k] if best <= k else None

    def reduce(self) -> None:
        """Fix dominating sets of one, two or three pieces for each length, from the largest down."""
        for w in sorted(self.left, reverse=True):
            while w in self.left and (pieces := self._dominating(w)):
                self._fix(pieces)

    def best_fit(self) -> None:
        """Best-fit decreasing of what is left: each piece into the fullest sequence that has room for it."""
        rooms: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)

        def add(room: int, sequence: int, count: int) -> None:
            if room > 0 and count:
                if room not in open_:
                    insort(rooms, room)
                    open_[room] = []
                open_[room].append((sequence, count))

        for w in sorted(self.left, reverse=True):
            while n := self.left.get(w, 0):
                at = bisect_left(rooms, w)
                if at < len(rooms):
                    room = rooms[at]
                    sequence, count = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[at]
                else:
                    room, count = self.capacity, -(-n // (self.capacity // w))
                    sequence = self._new(count)
                each = room // w
                full = min(count, n // each)
                if full:
                    self._put(w, full * each, sequence, each, self.capacity - room)
                    add(room - each * w, sequence, full)
                rest = min(n - full * each, each - 1) if full < count else 0
                if rest:
                    self._put(w, rest, sequence + full, rest, self.capacity - room)
                    add(room - rest * w, sequence + full, 1)
                add(room, sequence + full + bool(rest), count - full - bool(rest))


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    packing = Packing(counts, capacity)
    packing.reduce()
    packing.best_fit()
    return packing.runs, packing.sequences


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all rows into as few sequences of at most `capacity` tokens as it can.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text counts as
    empty and is a piece of the end id alone. Only the histogram of lengths (at most `capacity` rows) reaches
    the driver; the plan it gives back is as bounded and is joined by length. Pieces of equal length are
    interchangeable; rows that repeat, or have a null id, are packed each for itself. An empty table gives no
    rows; other columns of df aren't read.
    """
    pieces = materialize(token_pieces(df, tokenizer_path, capacity, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs, _ = pack_lengths(counts, capacity)
    by_length: dict[int, list] = {k: [] for k in counts}
    for r in runs:
        by_length[r.length].append((r.first, r.first + r.count, r.sequence, r.each, r.offset))
    run_type = "array<struct<a:bigint,b:bigint,sequence:bigint,each:int,offset:int>>"
    plan = df.sparkSession.createDataFrame([(k, v) for k, v in sorted(by_length.items())], f"length bigint, runs {run_type}")
    numbered = number_rows(pieces, ["length"], ["doc_id", "piece"], "rank", ["doc_id", "piece"], salts(max(counts.values(), default=0)))
    run = F.filter("runs", lambda r: (F.col("rank") >= r["a"]) & (F.col("rank") < r["b"]))[0]
    placed = numbered.join(F.broadcast(plan), "length").withColumn("run", run)
    within = F.col("rank") - F.col("run.a")
    each = F.col("run.each").cast("long")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run.sequence") + F.floor(within / each)).cast("long").alias("sequence_id"), (F.col("run.offset") + F.pmod(within, each) * F.col("length")).cast("long").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
