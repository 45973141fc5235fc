"""Packing token ids into fixed windows, best fit decreasing, without a shuffle.

A task reads its documents in blocks of bounded size. Documents are cut into full windows; the remainders of a block
are placed, longest first, in the open window that they fill most tightly. A segment tree over the remaining
capacities finds that window in log(window) steps.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class OpenWindows:
    """Segment tree over remaining capacities 0..window; each leaf holds the open windows with that much room."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.used = bytearray(2 * self.size)  # 1: some leaf below holds a window
        self.leaves: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, window_id: int) -> None:
        self.leaves[room].append(window_id)
        i = room + self.size
        while i and not self.used[i]:
            self.used[i] = 1
            i >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity >= ``length`` that a window has."""
        used, i = self.used, length + self.size
        if not used[i]:
            while True:  # up to the first right sibling that holds something
                if i == 1:
                    return None
                if not i & 1 and used[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:  # down to its leftmost leaf
                i <<= 1
                if not used[i]:
                    i += 1
        return i - self.size

    def take(self, room: int) -> int:
        window_id = self.leaves[room].pop()
        if not self.leaves[room]:
            i = room + self.size
            self.used[i] = 0
            while i > 1 and not (self.used[i] or self.used[i ^ 1]):
                i >>= 1
                self.used[i] = 0
        return window_id


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece, and the number of windows."""
    where, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    tree = OpenWindows(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        room = tree.tightest(length)
        if room is None:
            room, k, n = window, n, n + 1
        else:
            k = tree.take(room)
        where[i], offset[i] = k, window - room
        if room > length:
            tree.add(room - length, k)
    return where, offset, n


_TOKENIZERS: dict = {}


class _WordCache(dict):
    """Word -> its ids as bytes, filled on demand; words of the generation before are taken over."""

    def __init__(self, tokenizer, older: dict):
        super().__init__({"": b""})
        self.tokenizer, self.older = tokenizer, older

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            # The tokenizer folds case and never merges letters with what follows them. Letters below U+0130 stay
            # single letters when it normalises them.
            base, tail = (word.lower() if word.isascii() and "|" not in word else word), b""
            if len(base) > 1 and base[-1] in ",." and base[-2] < "\u0130" and base[-2].isalpha():
                base, tail = base[:-1], self[base[-1]]
            if base == word:
                found = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
            else:
                found = self[base] + tail
        self[word] = found
        return found


class WordIds:
    """Token ids (little-endian uint32 bytes) of whole texts, through a bounded cache of their words.

    The tokenizer splits on white space before it merges, so the ids of a text are those of its words in order.
    """

    def __init__(self, path: str, max_words: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.half = Tokenizer.from_file(path), max_words // 2
        self.cache = _WordCache(self.tokenizer, {})

    def __call__(self, text: str | None) -> bytes:
        if len(self.cache) > self.half:
            self.cache.older = {}
            self.cache = _WordCache(self.tokenizer, self.cache)
        words = (text or "").replace("\n", " ").split(" ")
        return b"".join(map(self.cache.__getitem__, words))


def _word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 4096,
    end_id: int = 2,
    block_tokens: int = 8_000_000,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers. Every row of the input is a document
    (repeated rows and ids too); null and empty texts give the end id alone; an empty table gives no rows. A
    sequence's pieces are gapless from offset 0 and at most ``window`` long together. ``block_tokens`` bounds what a
    task holds (4 bytes a token) before it packs; sequence ids number the sequences of each task.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = _word_ids(tokenizer_path), array("I", [end_id]).tobytes()
        next_id = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        held_tokens = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held, held_tokens
            doc, start, length, ids, total = [], [], [], [], []
            for d, b in held:
                n = len(b) // 4
                for s in range(0, n, window):
                    doc.append(d)
                    start.append(s)
                    length.append(min(window, n - s))
                    ids.append(b[4 * s : 4 * (s + window)])
                    total.append(n)
            lengths = np.array(length, np.int64)
            where, offset, n_windows = best_fit_decreasing(lengths, window)
            columns = [doc, start, length, ids, total, where + next_id, offset]
            next_id, held, held_tokens = next_id + n_windows, [], 0
            for i in range(0, len(doc), 2_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[i : i + 2_000], t) for c, t in zip(columns, types)], names=names
                )

        types = names = None
        for b in batches:
            types = [b.schema.types[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            keys, texts = b.column(0).to_pylist(), b.column(1)
            for key, text in zip(keys, texts):
                ids = encode(text.as_py()) + end
                held.append((key, ids))
                held_tokens += len(ids) // 4
                if held_tokens >= block_tokens:
                    yield from flush()
        if held:
            yield from flush()

    return src.mapInArrow(run, PIECES.format(id=id_type))
