r"""Substring deduplication behind a count-min prefilter.

Words are ``[^\x20\x09-\x0D]+``; a window is ``size`` consecutive words of one
document. A word goes when a window that covers it also starts earlier: in a
smaller doc_id, or earlier in the same document.

1. Prefilter. A window is counted under its anchor, the ``gram``-word gram inside
   it with the smallest hash (the leftmost of equals). Equal windows have equal
   anchors at equal offsets, so an anchor's count is never below the count of any
   window it stands for. Each task counts its anchors into two sketch rows and
   sends them sparsely, as the 16-bit places within blocks of 65,536 cells; blocks
   are summed in one task each, with saturation at 2. What goes back to all tasks
   is one bit a cell ("counted twice or more"), 2 x 2**cells bits whatever the size
   of the input (32 MiB at cells=27). Sketches only overestimate: no repeated
   window is lost. On inputs much larger than the sketch more unrepeated windows
   pass; the result stays the same and the second pass gets larger.
2. Exact grouping. Windows that may repeat are reduced within each slice of
   documents: all but the first start of a window are decided on the spot, and the
   first one goes to the task of the window's 128-bit hash (two 64-bit hashes, each of another 64-bit hash of
   the words, so that no pair of words that agrees in one hash makes windows equal), where the earliest start wins. A window in a third of all documents
   therefore costs one row a slice, not one a document.
3. The decided starts meet their document's text, and the words left are joined.

Nulls and odd input: a null or blank text has no words and keeps none. Texts
shorter than a window lose nothing. Rows without doc_id have no place in the
order and are left out. Rows that repeat a doc_id are joined by a space before step 1: their texts
count as one document, in order of text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import WORD_CACHE, gram_starts, mix, ngram_hashes, one_row_each, partitions, row_slices, words_of, written

_BLOCK = 1 << 16
#: Anchors that a task collects before it sends them.
_FLUSH = 1 << 20


class _TwoHashes(dict):
    """Word to the place of its two independent hashes."""

    def __init__(self) -> None:
        self.digests: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.digests.append(xxhash.xxh3_128_digest(word))
        self[word] = len(self.digests) - 1
        return self[word]

    def of(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first hashes, second hashes) of all words of a slice in order, and the number of words of each row."""
        if len(self) > WORD_CACHE:
            self.clear()
            self.digests = []
        rows = [np.fromiter(map(self.__getitem__, words := words_of(t)), np.int64, len(words)) for t in part.column("text").to_pylist()]
        both = np.frombuffer(b"".join(self.digests), np.uint64).reshape(-1, 2)
        at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        return both[at, 0], both[at, 1], np.fromiter(map(len, rows), np.int64, len(rows))


def _anchors(hashes: np.ndarray, lens: np.ndarray, size: int, gram: int):
    """(index, row, start, anchor place, anchor hash) of every window of a slice."""
    index, rows, starts = gram_starts(lens, size)
    grams = ngram_hashes(hashes, gram)
    if not len(index):
        return index, rows, starts, index, np.empty(0, np.uint64)
    span, least, place = size - gram + 1, grams, np.arange(len(grams))
    step = 1
    while step < span:  # the smallest of `span` grams from each place, the left one of equals
        shift = min(step, span - step)
        right, right_place = least[shift:], place[shift:]
        m = len(right)
        smaller = right < least[:m]
        least, place = np.where(smaller, right, least[:m]), np.where(smaller, right_place, place[:m])
        step += shift
    return index, rows, starts, place[index], least[index]


def _cells(anchor: np.ndarray, cells: int) -> list[np.ndarray]:
    mask = np.uint64((1 << cells) - 1)
    return [(anchor & mask).astype(np.int64), (mix(anchor) & mask).astype(np.int64)]


def _sketch(size: int, gram: int, cells: int):
    def send(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        anchor = np.concatenate(found)
        for row, cell in enumerate(_cells(anchor, cells)):
            cell.sort()
            block = cell >> 16
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            low = (cell & 0xFFFF).astype("<u2").tobytes()
            ends = [*cut[1:].tolist(), len(cell)]
            yield pa.RecordBatch.from_pydict(
                {
                    "row": pa.array(np.full(len(cut), row, np.int32)),
                    "block": pa.array(block[cut].astype(np.int32)),
                    "places": pa.array([low[2 * a : 2 * b] for a, b in zip(cut.tolist(), ends, strict=True)], pa.binary()),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, found, n = _TwoHashes(), [], 0
        with np.errstate(over="ignore"):
            for part in row_slices(batches):
                hashes, _, lens = cache.of(part)
                _, _, _, place, anchor = _anchors(hashes, lens, size, gram)
                if len(place):
                    found.append(anchor[np.flatnonzero(np.diff(place, prepend=-1))])
                    n += len(found[-1])
                if n >= _FLUSH:
                    yield from send(found)
                    found, n = [], 0
            if found:
                yield from send(found)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the sketches block by block; memory is one byte for each cell of this task's blocks."""
    counts: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, block, places in zip(*(batch.column(c).to_pylist() for c in ("row", "block", "places")), strict=True):
            cell = np.frombuffer(places, "<u2")
            total = counts.get((row, block))
            if total is None:
                total = counts[(row, block)] = np.zeros(_BLOCK, np.uint8)
            twice = cell[:-1][cell[1:] == cell[:-1]]
            total[cell] = np.minimum(total[cell] + 1, 2)
            total[twice] = 2
    for (row, block), total in counts.items():
        heavy = total >= 2
        if heavy.any():
            yield pa.RecordBatch.from_pydict(
                {"row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(heavy, bitorder="little").tobytes()], pa.binary())}
            )


def repeated_cells(docs: DataFrame, size: int, gram: int, cells: int) -> np.ndarray:
    """Two bit rows of 2**cells bits: which cells were counted twice or more."""
    sent = docs.mapInArrow(_sketch(size, gram, cells), "row int, block int, places binary")
    merged = sent.repartition(partitions(docs.sparkSession), "row", "block").mapInArrow(_merge, "row int, block int, bits binary")
    bits = np.zeros((2, (1 << cells) // 8), np.uint8)
    for row, block, heavy in merged.collect():  # 2 x 2**cells bits at most
        bits[row, block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = np.frombuffer(heavy, np.uint8)
    return bits


def _candidates(size: int, gram: int, cells: int, shared):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("run", pa.int32())])

    def maybe_repeated(anchor: np.ndarray) -> np.ndarray:
        bits, ok = shared.value, np.ones(len(anchor), bool)
        for row, cell in enumerate(_cells(anchor, cells)):
            ok &= (bits[row, cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _TwoHashes()
        with np.errstate(over="ignore"):
            for part in row_slices(batches):
                hashes, others, lens = cache.of(part)
                index, rows, starts, _, anchor = _anchors(hashes, lens, size, gram)
                ok = maybe_repeated(anchor)
                if not ok.any():
                    continue
                index, ids = index[ok], part.column("doc_id").to_numpy(zero_copy_only=False)
                doc, start = ids[rows[ok]], starts[ok].astype(np.int32)
                h1, h2 = ngram_hashes(hashes, size)[index], ngram_hashes(others, size, second=True)[index]
                order = np.lexsort((start, doc, h2, h1))
                a, b = h1[order], h2[order]
                first = np.ones(len(order), bool)
                first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                head = order[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[head].view(np.int64)), pa.array(h2[head].view(np.int64)), pa.array(doc[head]), pa.array(start[head]), pa.array(np.zeros(len(head), np.int32))], schema=schema
                )
                # All later starts of this slice are decided; neighbours form runs.
                late = np.sort(order[~first])
                if len(late):
                    d, s = doc[late], start[late]
                    cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)]))
                    length = np.diff(np.append(cut, len(late))).astype(np.int32)
                    key = mix(d[cut].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + s[cut].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(mix(key).view(np.int64)), pa.array(d[cut]), pa.array(s[cut]), pa.array(length)], schema=schema
                    )

    return run


def _keep(size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            out: list[tuple] = []
            for doc_id, text, runs in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
                words = words_of(text)
                total = len(words)
                if runs:
                    flat = np.array([(r["start"], r["run"]) for r in runs], np.int64)
                    edge = np.zeros(total + 1, np.int64)
                    np.add.at(edge, flat[:, 0], 1)
                    np.add.at(edge, flat[:, 0] + np.maximum(flat[:, 1], 1) - 1 + size, -1)
                    words = [w for w, n in zip(words, np.cumsum(edge).tolist(), strict=False) if not n]
                kept = b" ".join(words)
                row = (doc_id, total, total - len(words), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept.decode("utf-8", "surrogatepass")) if with_text else row)
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def drop_repeated_windows(docs: DataFrame, size: int = 20, gram: int = 12, cells: int = 27, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text)."""
    if not 16 <= cells <= 30 or not 1 <= gram <= size:
        raise ValueError("cells must be 16 to 30 and gram 1 to size")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    docs = one_row_each(docs)
    shared = spark.sparkContext.broadcast(repeated_cells(docs, size, gram, cells))

    found = docs.mapInArrow(_candidates(size, gram, cells, shared), "h1 long, h2 long, doc_id long, start int, run int")
    firsts = F.expr("min(struct(doc_id, start)) OVER (PARTITION BY h1, h2)")
    late = found.withColumn("first", firsts).filter("run > 0 OR first.doc_id != doc_id OR first.start != start")
    runs = late.groupBy("doc_id").agg(F.collect_list(F.struct("start", "run")).alias("runs"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return docs.join(runs, "doc_id", "left").mapInArrow(_keep(size, with_text), schema)
