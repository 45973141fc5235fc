"""Phrase collocations: grams counted in HAT-tries, spilled as sorted runs and merged per prefix partition.

A task numbers the words it meets and counts the gram at each word (that word and the next two; 0 where the piece
ends) in a trie over word numbers whose leaves are hash containers. A container that has grown too large bursts: its
heavy words get children of their own, the others go on sharing it, so the trie stays shallow. Where a task holds too
many grams, whole subtrees leave as sorted runs, the largest first. A run is cut at the borders of the prefix
partitions (ranges in the order of grams) and into blocks of some thousand grams. Each partition merges the blocks of
all runs in the order of their first grams. Shorter phrases are sums over longer ones, so they need no counts of
their own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.shared import stored
from leafmill.llm.slices import byte_table, slices

#: Bits of a word number; a task starts a new numbering beyond.
BITS = 21
WORD = (1 << BITS) - 1
#: Grams that a task holds (some 120 bytes each), grams in a container before it bursts, words and their bytes held.
HELD_GRAMS, BURST, HELD_WORDS, HELD_BYTES = 1_000_000, 100_000, 700_000, 64 << 20
#: Words that are counted at once, grams in a block of a run.
STEP, BLOCK = 1 << 19, 4096
#: Borders are fitted on so many documents and grams (words cut to some bytes); they only balance the partitions.
SAMPLE_DOCS, SAMPLE_GRAMS, SAMPLE_WORD_BYTES = 2_000, 20_000, 64

#: Pieces end at these marks, words at blanks and tabs.
_FOLD = byte_table(b"\t", b".,;:!?\n\x0b\x0c\r")
_BREAK = b"."


class _Numbers(dict):
    """Word to number, by first appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_BREAK: 0})
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.bytes += len(word)
        return n


class Node:
    """Counts of keys of ``words`` word numbers: a shared container, and children for words that burst out of it."""

    def __init__(self, words: int, burst: int):
        self.shift, self.burst, self.limit = BITS * (words - 1), burst, burst
        self.rest: Counter = Counter()
        self.child: dict[int, Node] = {}

    def add(self, keys: np.ndarray) -> None:
        if self.child:
            first = keys >> self.shift
            own = np.fromiter(self.child, np.int64, len(self.child))
            inside = np.isin(first, own)
            keys, moved = keys[~inside], keys[inside]
            moved.sort()  # by first word
            first = moved >> self.shift
            starts = np.flatnonzero(np.diff(first, prepend=-1))
            below = moved & ((1 << self.shift) - 1)
            for s, e in zip(starts, [*starts[1:], len(moved)]):
                self.child[int(first[s])].add(below[s:e])
        self.rest.update(keys.tolist())
        if len(self.rest) > self.limit and self.shift:
            self._split()

    def _split(self) -> None:
        """Words with many grams in the container move to children; without any, the container may grow."""
        keys, counts = self.arrays(self.rest)
        first = keys >> self.shift
        words, n = np.unique(first, return_counts=True)
        heavy = words[n * 32 >= self.burst]
        moved = np.isin(first, heavy)
        for w in heavy.tolist():
            node = self.child.setdefault(w, Node(self.shift // BITS, self.burst))
            mine = first == w
            below = keys[mine] & ((1 << self.shift) - 1)
            for k, c in zip(below.tolist(), counts[mine].tolist()):
                node.rest[k] += c
        self.rest = Counter(dict(zip(keys[~moved].tolist(), counts[~moved].tolist())))
        self.limit = max(self.burst, 2 * len(self.rest))

    @staticmethod
    def arrays(container: Counter) -> tuple[np.ndarray, np.ndarray]:
        n = len(container)
        return np.fromiter(container.keys(), np.int64, n), np.fromiter(container.values(), np.int64, n)

    def size(self) -> int:
        return len(self.rest) + sum(c.size() for c in self.child.values())

    def dump(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys with their counts."""
        parts = [self.arrays(self.rest)]
        for w, node in self.child.items():
            keys, counts = node.dump()
            parts.append((keys | (w << self.shift), counts))
        return tuple(np.concatenate(x) for x in zip(*parts))


class Grams:
    """Tries by language over one numbering of words, fed with texts, giving sorted runs of ``(lang, words, places, counts)``."""

    def __init__(self, longest: int, held: int = HELD_GRAMS, burst: int = BURST, words: int = HELD_WORDS):
        self.longest, self.held, self.burst, self.words = longest, held, burst, words
        self.numbers, self.tries = _Numbers(), {}
        self.waiting: dict[str, list[np.ndarray]] = {}
        self.n_waiting = 0

    def feed(self, lang: str, text: bytes) -> Iterator[tuple]:
        self.waiting.setdefault(lang, [np.zeros(0, np.int64)])
        for piece in slices(text.translate(_FOLD)):
            words = piece.replace(b"\n", b" . ").split()
            self.waiting[lang].append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
            self.n_waiting += len(words)
            if self.n_waiting > STEP:
                yield from self._count(False)
            if len(self.numbers) > self.words or self.numbers.bytes > HELD_BYTES:
                yield from self._renumber()
        self.waiting[lang].append(np.zeros(1, np.int64))  # the text ends

    def finish(self) -> Iterator[tuple]:
        yield from self._count(True)
        yield from self._spill(0)

    def _count(self, last: bool) -> Iterator[tuple]:
        """Count the grams that begin at all waiting words but the last two, which may still be continued."""
        for lang, queue in self.waiting.items():
            w = np.concatenate([*queue, np.zeros(2 if last else 0, np.int64)])
            queue[:] = [w[-2:]]
            one, two, three = w[:-2], w[1:-1], w[2:]
            keys = (one << BITS) | two
            if self.longest == 3:
                keys = (keys << BITS) | np.where(two == 0, 0, three)
            self.tries.setdefault(lang, Node(self.longest, self.burst)).add(keys[one != 0])
        self.n_waiting = 0
        if sum(t.size() for t in self.tries.values()) > self.held:
            yield from self._spill(self.held // 4)

    def _renumber(self) -> Iterator[tuple]:
        """All runs leave; words that wait are numbered anew."""
        yield from self._spill(0)
        old, self.numbers = list(self.numbers), _Numbers()
        for queue in self.waiting.values():
            words = [old[i] for i in np.concatenate(queue).tolist()]
            queue[:] = [np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))]

    def _spill(self, left: int) -> Iterator[tuple]:
        """Whole subtrees as sorted runs, the largest first, until ``left`` grams are held."""
        trees = [(len(t.rest), lang, None) for lang, t in self.tries.items()]
        trees += [(node.size(), lang, w) for lang, t in self.tries.items() for w, node in t.child.items()]
        held, taken = sum(t[0] for t in trees), {}
        for size, lang, w in sorted(trees, key=lambda x: -x[0]):
            if held <= left:
                break
            trie = self.tries[lang]
            if w is None:
                part, trie.rest = trie.arrays(trie.rest), Counter()
            else:
                keys, counts = trie.child.pop(w).dump()
                part = keys | (w << trie.shift), counts
            taken.setdefault(lang, []).append(part)
            held -= size
        every = list(self.numbers)
        every[0] = b""
        for lang, parts in taken.items():
            keys, counts = (np.concatenate(x) for x in zip(*parts))
            numbers = _split_keys(keys, self.longest)
            used = np.unique(np.append(numbers, 0))
            order = sorted(used.tolist(), key=every.__getitem__)
            rank = np.zeros(len(every), np.int64)
            rank[order] = np.arange(len(order))
            ranks = rank[numbers]
            at = np.argsort(_joined(ranks))
            yield lang, [every[i] for i in order], ranks[:, at], counts[at]


def _split_keys(keys: np.ndarray, longest: int) -> np.ndarray:
    """Word numbers of packed keys, one row a place."""
    return np.stack([(keys >> s) & WORD for s in range(BITS * (longest - 1), -1, -BITS)])


def _joined(ranks: np.ndarray) -> np.ndarray:
    keys = ranks[0]
    for r in ranks[1:]:
        keys = (keys << BITS) | r
    return keys


def _starts(ranks: np.ndarray) -> np.ndarray:
    """Where a new gram begins in sorted grams."""
    return np.flatnonzero(np.r_[True, (ranks[:, 1:] != ranks[:, :-1]).any(axis=0)]) if ranks.shape[1] else np.zeros(0, np.int64)


def _before(words: list[bytes], ranks: np.ndarray, gram: tuple[bytes, ...]) -> int:
    """How many of the sorted grams, given by places in the sorted ``words``, come before ``gram``."""
    low, high = 0, ranks.shape[1]
    for row, g in zip(ranks, gram):
        at = bisect_left(words, g)
        start = low + int(np.searchsorted(row[low:high], at, "left"))
        if at == len(words) or words[at] != g:
            return start
        low, high = start, low + int(np.searchsorted(row[low:high], at, "right"))
    return low


def _packed(words: list[bytes], ranks: np.ndarray, counts: np.ndarray) -> bytes:
    """A block: number of words, words by lines, places in them as 16-bit numbers, counts."""
    text = b"\n".join(words)
    head = np.array([len(words), len(text), ranks.shape[1]], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + text + ranks.astype(np.uint16).tobytes() + counts.tobytes())


def _unpacked(data: bytes, longest: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n_words, n_text, n = np.frombuffer(data, np.int64, 3).tolist()
    words = data[24 : 24 + n_text].split(b"\n")
    at = 24 + n_text
    ranks = np.frombuffer(data, np.uint16, longest * n, at).reshape(longest, n).astype(np.int64)
    return words, ranks, np.frombuffer(data[at + 2 * longest * n :], np.int64, n)


def blocks_of(run: tuple, borders: list[tuple[str, tuple[bytes, ...]]], longest: int) -> Iterator[tuple]:
    """``(part, lang, first words.., block)`` of a sorted run; no block crosses a border."""
    lang, words, ranks, counts = run
    before = sum(b[0] < lang for b in borders)
    cuts = [_before(words, ranks, gram) for name, gram in borders if name == lang]
    for i, (start, end) in enumerate(zip([0, *cuts], [*cuts, len(counts)])):
        for at in range(start, end, BLOCK):
            stop = min(at + BLOCK, end)
            used, places = np.unique(ranks[:, at:stop], return_inverse=True)
            own = [words[r] for r in used.tolist()]
            places = places.reshape(longest, -1)
            first = [own[p] for p in places[:, 0].tolist()]
            yield before + i, lang, *first, _packed(own, places, counts[at:stop])


def _first_columns(longest: int) -> list[str]:
    return [f"w{i}" for i in range(1, longest + 1)]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*out) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for row in rows:
        out.append(row)
        if len(out) == size:
            yield batch()
            out = []
    yield batch()


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))


def _runs(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple]:
    grams = Grams(longest)
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            yield from grams.feed(lang.as_py(), text.as_py())
    yield from grams.finish()


def borders(texts: DataFrame, parts: int, longest: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """At most ``parts - 1`` grams that cut the distinct grams of a bounded sample of documents into equal ranges."""
    share = SAMPLE_DOCS / max(texts.count(), 1)
    sample = texts if share >= 1 else texts.sample(share, 42)
    tasks, schema = 8, pa.schema([("lang", pa.string()), *((w, pa.binary()) for w in _first_columns(longest))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for lang, words, ranks, counts in _runs(batches, longest):
                for gram in ranks[:, :: max(1, len(counts) * tasks // SAMPLE_GRAMS)].T.tolist():
                    yield lang, *(words[r][:SAMPLE_WORD_BYTES] for r in gram)

        yield from _batches(rows(), schema, 4096)

    names = ", ".join(f"{w} binary" for w in _first_columns(longest))
    rows = sample.repartition(tasks).mapInArrow(run, f"lang string, {names}").collect()
    found = sorted({(r[0], tuple(bytes(x) for x in r[1:])) for r in rows}, key=lambda x: (x[0].encode(), x[1]))
    return sorted({found[len(found) * i // parts] for i in range(1, parts)}, key=lambda x: (x[0].encode(), x[1])) if found else []


class Merge:
    """Merges the blocks of one partition, which come ordered by language and first gram.

    Grams before the next block's first one are final: they are given out as ``(lang, length, phrase, count)`` where they
    reach ``least``. Shorter phrases are summed as they pass; one that reaches over an end of what is final is given
    out whatever its count, as a part of a sum.
    """

    def __init__(self, longest: int, least: int, held: int = 1 << 18):
        self.longest, self.least, self.held = longest, least, held
        self.lang, self.blocks, self.n, self.next = None, [], 0, held

    def feed(self, lang: str, first: tuple[bytes, ...], block: bytes) -> Iterator[tuple]:
        if lang != self.lang:
            yield from self.finish()
            self.lang = lang
        elif self.n > self.next:
            yield from self._flush(first)
        self.blocks.append(_unpacked(block, self.longest))
        self.n += self.blocks[-1][1].shape[1]

    def finish(self) -> Iterator[tuple]:
        if self.blocks:
            yield from self._flush(None)

    def _flush(self, before: tuple[bytes, ...] | None) -> Iterator[tuple]:
        words = sorted({b""}.union(*(b[0] for b in self.blocks)))
        number = {w: i for i, w in enumerate(words)}
        parts = [np.fromiter(map(number.__getitem__, own), np.int64, len(own))[ranks] for own, ranks, _ in self.blocks]
        ranks, counts = np.concatenate(parts, axis=1), np.concatenate([b[2] for b in self.blocks])
        # As many words as a key can number is the rule; beyond, the places are compared one by one.
        order = np.argsort(_joined(ranks), kind="stable") if len(words) <= WORD else np.lexsort(ranks[::-1])
        ranks, counts = ranks[:, order], counts[order]
        starts = _starts(ranks)
        ranks, counts = ranks[:, starts], np.add.reduceat(counts, starts)
        final = len(counts) if before is None else _before(words, ranks, before)
        yield from self._sums(words, ranks[:, :final], counts[:final])
        self.blocks, self.n = [], len(counts) - final
        self.next = max(self.held, 2 * self.n)  # what overlaps is merged again only when it has doubled
        if self.n:
            used, places = np.unique(ranks[:, final:], return_inverse=True)
            self.blocks = [([words[u] for u in used.tolist()], places.reshape(self.longest, -1), counts[final:])]

    def _sums(self, words: list[bytes], ranks: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        if not len(counts):
            return
        yield self.lang, 0, b"", int(counts.sum())
        for length in range(1, self.longest + 1):
            starts = _starts(ranks[:length])
            sums, prefix = np.add.reduceat(counts, starts), ranks[:length, starts]
            told = sums >= self.least
            if length < self.longest:  # edges may go on elsewhere
                told[[0, -1]] = True
            told &= prefix[-1] != 0
            for p, n in zip(prefix[:, told].T.tolist(), sums[told].tolist()):
                yield self.lang, length, b" ".join(words[i] for i in p), n


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, length, phrase, f)``: exact counts of all phrases of up to ``longest`` (2 or 3) words that occur ``least`` times.

    The row of length 0 has all word occurrences of its language.
    """
    if longest not in (2, 3):
        raise ValueError(f"longest must be 2 or 3, not {longest}")
    texts = _texts(docs, lang, text)
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    cuts = borders(texts, parts, longest)
    firsts = _first_columns(longest)
    run_schema = pa.schema(
        [("part", pa.int32()), ("lang", pa.string()), *((w, pa.binary()) for w in firsts), ("block", pa.binary())]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((row for run in _runs(batches, longest) for row in blocks_of(run, cuts, longest)), run_schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("length", pa.int32()), ("phrase", pa.binary()), ("f", pa.int64())])

        def rows():
            part, state = None, Merge(longest, least)
            for b in batches:
                for i in range(len(b)):
                    values = [b.column(j)[i].as_py() for j in range(len(run_schema))]
                    if values[0] != part:
                        yield from state.finish()
                        part, state = values[0], Merge(longest, least)
                    yield from state.feed(values[1], tuple(values[2:-1]), values[-1])
            yield from state.finish()

        yield from _batches(rows(), schema, 4096)

    columns = ", ".join(f"{w} binary" for w in firsts)
    runs = texts.mapInArrow(count, f"part int, lang string, {columns}, block binary")
    dealt = runs.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "lang", *firsts)
    merged = dealt.mapInArrow(merge, "lang string, length int, phrase binary, f long")
    sums = merged.groupBy("lang", "length", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("f").alias("f"))
    return sums.where((F.col("length") == 0) | (F.col("f") >= least))


def _number(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (l * r)) in whole numbers of 38 digits."""
    return F.expr(f"(1000000 * cast({a} as decimal(16,0)) * cast({a} as decimal(16,0))) div (cast({left} as decimal(16,0)) * cast({right} as decimal(16,0)))")


def collocations(
    docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z) and cut into pieces and words; null texts are empty, null languages ``und``. Rows that
    repeat a document count each. A phrase's score is that of its weakest cut; phrases inside a longer candidate that
    reaches ``cover`` % of their count are dropped. Ties go by count, then by the phrase's bytes, so ranks are unique.
    Tables without words give no rows.
    """
    counts = stored(phrase_counts(docs, longest, least, lang, text))
    known = counts.where("length > 0").select("lang", "phrase", "f")
    words = F.split("phrase", " ", -1)
    asked = counts.where("length > 1").select("lang", "phrase", "length", F.col("f").alias("a"), words.alias("w"))
    cuts = asked.select(
        "lang", "phrase", "length", "a", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"), "w"
    ).select(
        "lang", "phrase", "length", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("length")), " ").alias("right"),
    )
    for side, out in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(out)), ["lang", side])
    weakest = (
        cuts.select("lang", "phrase", "a", F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r").alias("cut"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min("cut").alias("cut"))
    )
    inner = [
        asked.where(F.col("length") == n).select("lang", F.explode(F.expr(
            f"transform(sequence(1, {n} - {m} + 1), i -> array_join(slice(w, i, {m}), ' '))"
        )).alias("phrase"), F.col("a").alias("longer"))
        for n in range(3, longest + 1) for m in range(2, n)
    ]
    if inner:
        covered = inner[0]
        for i in inner[1:]:
            covered = covered.unionByName(i)
        most = covered.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        weakest = weakest.join(most, ["lang", "phrase"], "left").where(
            F.col("longer").isNull() | (100 * _number("longer") < cover * _number("a"))
        )
    order = [F.desc("cut.score"), F.desc("a"), F.col("phrase")]
    ranked = weakest.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("length = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")
    )
