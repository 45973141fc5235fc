"""Near-duplicate documents: SimHash fingerprints joined through a grid over segment popcounts.

A fingerprint is embedded as the number of set bits in each of its 32 two-bit segments. The Manhattan distance of two
embeddings is a lower bound of the Hamming distance. The 32 counts form two parts of 16; fingerprints at most
``distance`` = 3 bits apart lie at most 1 apart in one part. Each fingerprint therefore stands in the cell of each of
its parts (the grid) and looks into the cells one count higher (the range); members of a cell are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.components import components
from leafmill.llm.shared import checkpointed, longs

DISTANCE = 3
_CHUNK = 65_536


def _majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def simhash(text: bytes | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) word shingles of one UTF-8 text; 0 without words."""
    from xxhash import xxh64_intdigest

    w = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII spaces
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else (b" ".join(w),)
    n = max(1, len(w) - words + 1)
    return _majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64, n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fingerprint)``, one row per input row. Null and wordless texts have fingerprint 0."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [simhash(x.as_py(), words) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fingerprint"])

    id_type = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {id_type}, fingerprint long")


def _embedding(fp):
    """Popcounts of the two-bit segments, in place: both bits set gives 2, one gives 1."""
    low, upper = longs(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    two = F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(low), 1)
    return two.bitwiseOR(fp.bitwiseXOR(upper).bitwiseAND(low))


def grid_rows(fps: DataFrame) -> DataFrame:
    """``(key, fp, home)``: the own cell of each part, and the cells one count higher."""
    fp = F.col("fp")
    rows = []
    for part in (0, 1):
        cell = _embedding(fp)
        cell = cell.bitwiseAND(longs(0xFFFFFFFF)) if part == 0 else F.shiftrightunsigned(cell, 32)
        cell = cell.bitwiseOR(longs(part << 33))
        rows.append(F.struct(cell.alias("key"), F.lit(True).alias("home")))
        for i in range(16):
            room = F.shiftrightunsigned(cell, 2 * i).bitwiseAND(longs(3)) < 2
            rows.append(F.when(room, F.struct((cell + longs(1 << (2 * i))).alias("key"), F.lit(False).alias("home"))))
    cells = F.array_compact(F.array(*rows))
    return fps.select("fp", F.explode(cells).alias("c")).select(F.col("c.key").alias("key"), "fp", F.col("c.home").alias("home"))


def segment_rows(fps: DataFrame) -> DataFrame:
    """``(key, fp, home)`` for crowded cells: fingerprints within 3 bits agree on 13 of 16 four-bit segments.

    560 keys each; at most 2**12 fingerprints can share a key, so these groups are bounded by construction.
    """
    masks = [sum(0xF << (4 * s) for s in kept) for kept in combinations(range(16), 13)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(longs(m))) for i, m in enumerate(masks)])
    return fps.select(F.explode(keys).alias("key"), "fp", F.lit(True).alias("home"))


def _forest(fp: np.ndarray, home: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of one cell (home with home, home with guest)."""
    order = np.argsort(~home, kind="stable")
    fp, n_home = fp[order].view(np.uint64), int(home.sum())
    if n_home == 0 or len(fp) < 2:
        return []
    near = np.empty((n_home, len(fp)), bool)
    for i in range(0, n_home, 256):  # bounds what the comparison holds
        near[i : i + 256] = np.bitwise_count(fp[i : min(i + 256, n_home), None] ^ fp[None, :]) <= distance
    seen = np.zeros(len(fp), bool)
    signed, out = fp.view(np.int64), []
    for root in range(n_home):
        if seen[root]:
            continue
        seen[root], todo = True, [root]
        while todo:
            i = todo.pop()
            hit = np.flatnonzero((near[i] if i < n_home else np.r_[near[:, i], np.zeros(len(fp) - n_home, bool)]) & ~seen)
            seen[hit] = True
            out += [(int(signed[i]), int(signed[j])) for j in hit]
            todo += hit.tolist()
    return out


def _link_cells(rows: DataFrame, distance: int) -> DataFrame:
    """Links inside each key; the rows of a key are bounded and come together, sorted, in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links(key, fp, home):
            cuts = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
            many = np.flatnonzero(ends - starts > 1)
            pairs = [p for k in many for p in _forest(fp[starts[k] : ends[k]], home[starts[k] : ends[k]], distance)]
            a = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], schema=schema)

        rest = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(cols[0]):
                continue
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            open_from = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            rest = [x[open_from:] for x in cols]
            if open_from:
                yield links(*(x[:open_from] for x in cols))
        if rest is not None:
            yield links(*rest)

    together = rows.select("key", "fp", "home").repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, crowd: int = 4096) -> DataFrame:
    """``fps(fp)``, distinct -> ``(a, b)``: links that connect exactly what Hamming distance <= ``distance`` connects.

    Cells of more than ``crowd`` rows are not gathered: their fingerprints are keyed anew by ``segment_rows``.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"the grid is built for distances up to {DISTANCE}")
    rows = grid_rows(fps)
    full = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("key"))
    if full.isEmpty():
        return _link_cells(rows, distance)
    crowded = rows.join(full, "key", "left_semi").select("fp").distinct()
    return _link_cells(rows.join(full, "key", "left_anti"), distance).unionByName(
        _link_cells(segment_rows(crowded), distance)
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    distance: int = DISTANCE,
    crowd: int = 4096,
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    ``component_id`` is the smallest id reachable over links of at most ``distance`` differing bits. Null, empty and
    wordless texts share fingerprint 0 and are linked like any other; repeated rows stay repeated; a null id counts
    as larger than any other, and an empty table gives no rows.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, words))
    distinct = checkpointed(fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")))
    comp = components(fingerprint_links(distinct.select("fp"), distance, crowd))
    member = comp.join(distinct, comp.id == distinct.fp)
    roots = member.groupBy("component").agg(F.min("first").alias("root"))
    of = member.join(roots, "component").select(F.col("id").alias("fp"), "root")
    label = distinct.join(of, "fp", "left").select(
        F.col("fp").alias("fingerprint"), F.coalesce("root", "first").alias("component_id")
    )
    return fps.join(label, "fingerprint").select("doc_id", "fingerprint", "component_id")
