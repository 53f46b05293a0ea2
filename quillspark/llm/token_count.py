"""Token counts by compiled finite-state transducers; the maps of chunks compose through a parallel prefix scan.

Two deterministic machines count the tokens of a byte-level BPE file. The splitter reads character classes and
marks where the words of the file's split pattern begin; a text is cut into chunks, each chunk's map from entry
state to exit state is found for all chunks side by side, and the maps compose by a prefix scan, so a text of
any length is read in parallel. The merge machine reads the bytes of a word; each of its transitions carries by
how many the tokens grow, so a word's tokens are the sum along its path, and a text's by a scan over its words.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe_merge import contract
from quillspark.llm.common import by_size, kept, map_arrow, table

#: Characters of a chunk, characters read side by side, bytes of words whose sums a task keeps (two generations),
#: transitions that it keeps compiled, and pairs of tokens that it remembers.
CHUNK, TOGETHER, KEPT, COMPILED, PAIRS = 256, 3_000_000, 40 << 20, 500_000, 300_000
OVER = 512

# Character classes of the split pattern.
SPACE, BLANK, LETTER, DIGIT, OTHER, QUOTE, SINGLE, R, V, L, E, END = range(12)
# States: at a token's start; in a run of letters, digits or others; in white space that ends with a blank or
# with another space; after a quote at a token's start; after such a quote and r, v or l.
START, LETTERS, DIGITS, OTHERS, AFTER_SPACE, AFTER_BLANK, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(10)
STATES = 10
#: Annotations: a word begins at this character; a word begins at the one before it.
HERE, BACK = 1, 2
_LETTERS = (LETTER, SINGLE, R, V, L, E)


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and annotations [class, state] of 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?others|spaces."""
    nxt, out = np.zeros((12, STATES), np.uint8), np.zeros((12, STATES), np.uint8)

    def put(state: int, cls: int, to: int, mark: int) -> None:
        nxt[cls, state], out[cls, state] = to, mark

    begins = {SPACE: AFTER_SPACE, BLANK: AFTER_BLANK, DIGIT: DIGITS, OTHER: OTHERS, QUOTE: QUOTED} | dict.fromkeys(_LETTERS, LETTERS)
    own = {LETTERS: _LETTERS, DIGITS: (DIGIT,), OTHERS: (OTHER, QUOTE)}
    for state in range(STATES):
        put(state, END, START, BACK if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
    for cls, to in begins.items():
        put(START, cls, to, HERE)
        for state, classes in own.items():
            put(state, cls, state if cls in classes else to, 0 if cls in classes else HERE)
        inside = cls in (SPACE, BLANK)  # the run of white space goes on; else its last character stands for itself
        put(AFTER_SPACE, cls, OTHERS if cls == QUOTE else to, 0 if inside else BACK)
        put(AFTER_BLANK, cls, to, 0 if inside else HERE | BACK)
        put(QUOTED, cls, OTHERS if cls in (OTHER, QUOTE) else to, 0 if cls in (OTHER, QUOTE) else HERE)
        for state in (QUOTED_R, QUOTED_V, QUOTED_L):  # no contraction: the letter began a run
            put(state, cls, nxt[cls, LETTERS], out[cls, LETTERS] | BACK)
    put(QUOTED, SINGLE, START, 0)
    for cls, state, then in ((R, QUOTED_R, E), (V, QUOTED_V, E), (L, QUOTED_L, L)):
        put(QUOTED, cls, state, 0)
        put(state, then, START, 0)
    return nxt, out


def members(expression: str) -> list[int]:
    """The code points that the library's own pattern engine puts into a class, whose Unicode tables are not Python's."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    runs = pre_tokenizers.Split(Regex(f"[^{expression}]+"), "removed").pre_tokenize_str(every)
    return [ord(c) for run, _ in runs for c in run]


def character_classes() -> np.ndarray:
    code = np.full(0x110000, OTHER, np.uint8)
    code[members(r"\p{L}")], code[members(r"\p{N}")], code[members(r"\s")] = LETTER, DIGIT, BLANK
    code[ord(" ")], code[ord("'")] = SPACE, QUOTE
    for ch, cls in (("s", SINGLE), ("t", SINGLE), ("m", SINGLE), ("d", SINGLE), ("r", R), ("v", V), ("l", L), ("e", E)):
        code[ord(ch)] = cls
    return code


def scan(classes: np.ndarray, nxt: np.ndarray, out: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The annotation at each position, from START; chunk maps compose by a parallel prefix scan."""
    n = len(classes)
    chunks = max(1, -(-n // chunk))
    padded = np.full(chunks * chunk, END, np.uint8)
    padded[:n] = classes
    base = np.ascontiguousarray(padded.reshape(chunks, chunk).T).astype(np.int16) * STATES
    table_, marks = nxt.ravel(), out.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for t in range(chunk):
        maps = table_.take(maps + base[t][:, None])
    step = 1
    while step < chunks:  # maps[k] becomes the map of chunks 0 to k
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)])
        step *= 2
    states = np.concatenate([[START], maps[:-1, START]]).astype(np.uint8)
    found = np.empty((chunk, chunks), np.uint8)
    for t in range(chunk):
        at = states + base[t]
        found[t] = marks.take(at)
        states = table_.take(at)
    return np.ascontiguousarray(found.T).ravel()[:n]


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level BPE files: printable ones as they are, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeMachine:
    """A deterministic transducer over the bytes of a word: a transition says by how many its tokens grow.

    Merging never crosses the edge of a token that stays, so the tokens of a prefix are those of a shorter
    prefix and one last token, and a token may follow another exactly if merging the two alone leaves both.
    A state is therefore the longest end of what was read that begins some token, with the last token and
    the relative count at each place within it: a finite number. States and transitions are compiled from
    the merges when they are first met, which spares the many that no text needs.
    """

    def __init__(self, tokens: dict[bytes, int], pairs: dict, byte_ids: list[int]):
        self.tokens, self.pairs, self.byte_ids = tokens, pairs, byte_ids
        self.content = {i: t for t, i in tokens.items()}
        self.begins = {t[:k] for t in tokens for k in range(len(t))}
        self.whole: dict[bytes, int | None] = {}
        self.pair: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {(b"", (None,), (0,)): 0}
        self.keys = list(self.states)
        self.steps: dict[int, tuple[int, int]] = {}  # 256 * state + byte -> the next state times 256, growth

    def _merged(self, content: bytes) -> list[int]:
        return contract([self.byte_ids[b] for b in content], self.pairs)

    def _token(self, content: bytes) -> int | None:
        """The token that these bytes merge into, if it is one."""
        if (token := self.tokens.get(content)) is None:
            return None
        if content not in self.whole:  # never more than there are tokens
            self.whole[content] = token if self._merged(content) == [token] else None
        return self.whole[content]

    def _follows(self, before: int | None, token: int) -> bool:
        if before is None:
            return True
        if (before, token) not in self.pair:
            if len(self.pair) >= PAIRS:
                self.pair.clear()
            self.pair[before, token] = self._merged(self.content[before] + self.content[token]) == [before, token]
        return self.pair[before, token]

    def _compile(self, at: int) -> tuple[int, int]:
        read, lasts, counts = self.keys[at >> 8]
        read += bytes([at & 255])
        start, token = next((k, t) for k in range(len(read)) if (t := self._token(read[k:])) is not None and self._follows(lasts[k], t))
        growth = counts[start] + 1
        lasts, counts = (*lasts, token), (*(c - growth for c in counts), 0)
        k = next(k for k in range(len(read) + 1) if read[k:] in self.begins)
        key = read[k:], lasts[k:], counts[k:]
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        self.steps[at] = self.states[key] << 8, growth
        return self.steps[at]

    def count(self, word: bytes) -> int:
        """The sum of what the transitions along the word's path carry."""
        state, total, get = 0, 0, self.steps.get
        for b in word:
            state, growth = get(state + b) or self._compile(state + b)
            total += growth
        if len(self.steps) > COMPILED:
            self.clear()
        return total


class TokenCounter:
    """Both machines, compiled from a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], _byte_symbols()
        byte_ids = [0] * 256
        for ch, b in symbols.items():
            byte_ids[b] = vocab[ch]
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        tokens = {bytes(map(symbols.__getitem__, t)): i for t, i in vocab.items() if t not in self.special}
        self.machine = MergeMachine(tokens, pairs, byte_ids)
        self.code, (self.next, self.out) = character_classes(), splitter()
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.held = 0

    def words(self, words: set[str]) -> dict[str, int]:
        """The tokens of each word, by its path through the merge machine where they aren't known yet."""
        if self.held > KEPT:
            self.old, self.new, self.held = self.new, {}, 0
        missing, old, count = words.difference(self.new), self.old, self.machine.count
        self.held += sum(map(len, missing)) + 130 * len(missing)  # 130: of the objects
        self.new.update({w: old[w] for w in missing.intersection(old)})
        self.new.update({w: count(w.encode()) for w in missing.difference(old)})
        return self.new

    def count(self, texts: list[str]) -> list[int]:
        totals: list[int] = []
        for some in by_size(texts, TOGETHER):
            totals += self._count(texts[some])
        return totals

    def _count(self, texts: list[str]) -> list[int]:
        totals, parts, owners = [0] * len(texts), [], []
        for n, t in enumerate(texts):
            pieces = [t]
            for s in self.special:  # one token each, and the text on either side stands alone
                if s in t:
                    pieces = [y for x in pieces for y in x.split(s)]
            totals[n] = len(pieces) - 1
            parts += pieces
            owners += [n] * len(pieces)
        joined = "\n".join(parts) + "\n"
        classes = self.code[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        lengths = np.array([len(p) for p in parts], np.int64)
        stops = np.cumsum(lengths + 1) - 1
        classes[stops] = END
        marks = scan(classes, self.next, self.out)
        begins = (marks & HERE).astype(bool)
        begins[:-1] |= (marks[1:] & BACK).astype(bool)
        begins[stops] = True
        at = np.flatnonzero(begins)
        is_word = classes[at] != END
        ends = np.append(at[1:], len(joined))
        words = [joined[a:b] for a, b in zip(at[is_word].tolist(), ends[is_word].tolist(), strict=True)]
        counts = np.fromiter(map(self.words(set(words)).__getitem__, words), np.int64, len(words))
        sums = np.concatenate([[0], np.cumsum(counts)])
        edges = np.searchsorted(at[is_word], stops)
        each = np.diff(sums[np.concatenate([[0], edges])])
        for n, c in zip(owners, each.tolist(), strict=True):
            totals[n] += c
        return totals


def count_tokens(df: DataFrame, tokenizer_path: str, over: int = OVER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each row's whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > over).

    A null text counts as empty: 0 tokens. Strings of special tokens inside a text are one token each, as the
    library's default has it. Repeated rows and null ids are counted each for itself; an empty table gives no
    rows; other columns of df aren't read.
    """

    name = f"token counts {tokenizer_path}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(name, lambda: TokenCounter(tokenizer_path))
        for b in batches:
            counts = counter.count([t or "" for t in b.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("i"), F.octet_length(text).cast("long").alias("n"), text.alias("t"))
    return map_arrow(rows, run, "doc_id long, n_bytes long, n_tokens long", name).withColumn("over_limit", F.col("n_tokens") > over)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
