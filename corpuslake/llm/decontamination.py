r"""Benchmark decontamination by spaced seeds.

Texts are lower-cased and cut into tokens, runs of word characters. A seed is a fixed
mask over token positions; its hash ignores the positions that are 0, so that a
substituted token there leaves it unchanged. All seeds of the benchmark items are
hashed; the documents' seed hashes pass a Bloom filter of them (a fixed number of bits)
and those that stay are joined with the items' by hash. Each hit names a document, an
item and a diagonal (the shift between both). Around the hits of a diagonal the aligned
tokens are compared: the overlap is the longest stretch whose ends match and in which at
least ``agree`` of the tokens match. A document is contaminated by an item when the
overlap covers ``least`` tokens, or the whole item if that is shorter.

Documents are hashed whole, in a single pass; a passage in a third of all documents
gives each of them its own hits and needs no group.

The masks lose nothing: ``complete`` proves for the limits of a call that each stretch which ``agree``
and ``least`` accept contains a mask, of any length; limits for which the masks can't promise that are
refused. Items under 13 tokens must be covered whole and have masks of their own, up to three tokens
without any substitution, as ``agree`` = 0.7 demands. Masks of weight 3 and 4 also meet by chance:
such hits are only compared in vain.

Nulls and odd input: null and empty texts have no token and are clean; items without token
find nothing. Repeated items and documents give repeated matches once each by id. Documents without
doc_id are left out of the matches. Columns of the documents pass through ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import WordHashes, gram_starts, mix, row_slices, without, written

#: 1 is compared, 0 ignored. Each stretch of 13 tokens or more of which 70 % match contains one of them (``complete``).
MASKS = ("1100101", "1011100", "1110010", "1000111", "1111000")
#: From this length on an item is found by MASKS.
_LONG = 13
#: The same for whole items of fewer tokens, by length.
_SHORT = {n: ("1" * n,) for n in (1, 2, 3)} | {4: ("1101", "1011"), 5: ("11001", "10110")} | {n: ("110001", "100110", "101001") for n in range(6, _LONG)}
_TOKEN = re.compile(r"\w+")
_SEED = np.uint64(0x9E3779B97F4A7C15)


def complete(masks: tuple[str, ...], least: int, agree: float, exact: bool = False) -> bool:
    """Whether one of ``masks`` (of one span) lies in every stretch of ``least`` tokens or more (``exact``: of ``least``)
    whose ends match and in which at least ``agree`` of the tokens match.

    A state is what the last span - 1 tokens did; the best gain (matches less agree * length) of a stretch that avoids
    all masks is carried from state to state, until no longer stretch betters it.
    """
    span, up, down = len(masks[0]), round((1 - agree) * 1000), round(agree * 1000)
    if any(m[0] != "1" for m in masks):
        raise ValueError("masks must start with 1")
    never, states = -(1 << 40), 1 << (span - 1)
    seen = np.arange(1 << span)
    hit = np.any([seen & int(m, 2) == int(m, 2) for m in masks], axis=0)
    gain = np.where(hit, never, np.where(seen & 1, up, -down))

    def longer(best: np.ndarray) -> np.ndarray:
        whole = np.maximum(best[seen >> 1] + gain, never)  # the oldest token leaves the state
        return np.maximum(whole[:states], whole[states:])

    def ends_badly(best: np.ndarray) -> bool:
        ends = best[1::2] if states > 1 else best
        return bool(ends.max() >= 0)

    best = np.full(states, never)
    best[0] = 0  # mismatches before the stretch: no mask starts there
    best = longer(best)
    if states > 1:
        best[::2] = never  # the first token matches
    for _ in range(least - 1):
        best = longer(best)
    while not ends_badly(best):
        more = np.maximum(best, longer(best))
        if exact or (more == best).all():
            return True
        best = more
    return False


def _tokens(part: pa.RecordBatch, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    arrays = [cache.of([t.encode() for t in _TOKEN.findall((x or "").lower())]) for x in part.column("text").to_pylist()]
    lens = np.fromiter(map(len, arrays), np.int64, len(arrays))
    return (np.concatenate(arrays) if arrays else np.empty(0, np.uint64)), lens


def _seed_hashes(tokens: np.ndarray, index: np.ndarray, mask: str) -> np.ndarray:
    h = np.full(len(index), np.uint64(int(f"1{mask}", 2)))
    for offset, bit in enumerate(mask):
        if bit == "1":
            h = mix(h * _SEED + tokens[index + offset])
    return h


def _item_rows(masks: tuple[str, ...], long: int):
    """(item_id, tokens, seeds: hash and place) of the benchmark items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        with np.errstate(over="ignore"):
            for part in row_slices(batches):
                tokens, lens = _tokens(part, cache)
                offsets, ids = np.cumsum(lens) - lens, part.column("item_id").to_pylist()
                for i, (at, n) in enumerate(zip(offsets.tolist(), lens.tolist(), strict=True)):
                    own = tokens[at : at + n]
                    seeds = []
                    for mask in masks if n >= long else _SHORT.get(n, ()):
                        starts = np.arange(n - len(mask) + 1)
                        seeds += list(zip(_seed_hashes(own, starts, mask).view(np.int64).tolist(), starts.tolist(), strict=True))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "item_id": pa.array([ids[i]], pa.int64()),
                            "item": pa.array([own.view(np.int64).tolist()], pa.list_(pa.int64())),
                            "seeds": pa.array([[{"hash": h, "at": s} for h, s in seeds]], pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))),
                        }
                    )

    return run


def _bits(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    mask = np.uint64(size - 1)
    return [((hashes >> np.uint64(s)) & mask).astype(np.int64) for s in (0, 13, 26, 39)]


def _doc_rows(masks: list[str], shared, size: int):
    """(doc_id, tokens, seeds) of the documents with a seed that passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bloom = WordHashes(), shared.value
        with np.errstate(over="ignore"):
            for part in row_slices(batches):
                tokens, lens = _tokens(part, cache)
                ids, offsets = part.column("doc_id").to_numpy(zero_copy_only=False), np.cumsum(lens) - lens
                found = []
                for mask in masks:
                    index, rows, starts = gram_starts(lens, len(mask))
                    h = _seed_hashes(tokens, index, mask)
                    for place in range(4):  # each test leaves few for the next
                        bit = _bits(h, size)[place]
                        ok = (bloom[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                        h, rows, starts = h[ok], rows[ok], starts[ok]
                        if not len(h):
                            break
                    if len(h):
                        found.append((rows, starts, h))
                if not found:
                    continue
                rows, starts, h = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(rows, kind="stable")
                rows, starts, h = rows[order], starts[order], h[order]
                cut = np.flatnonzero(np.diff(rows, prepend=-1))
                live = rows[cut]
                seeds = pa.ListArray.from_arrays(
                    pa.array(np.append(cut, len(rows)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(starts.astype(np.int32))], names=["hash", "at"]),
                )
                own = [tokens[offsets[r] : offsets[r] + lens[r]].view(np.int64) for r in live]
                texts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens[live])]).astype(np.int32)), pa.array(np.concatenate(own)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[live]), texts, seeds], names=["doc_id", "tokens", "seeds"])

    return run


def longest_overlap(a: np.ndarray, b: np.ndarray, shift: int, agree: float) -> tuple[int, int, int]:
    """(start in a, length, matches) of the longest stretch of a and b[.. - shift] whose
    ends match and in which at least ``agree`` of the tokens match."""
    low, high = max(0, shift), min(len(a), len(b) + shift)
    same = a[low:high] == b[low - shift : high - shift]
    at = np.flatnonzero(same)
    if not len(at):
        return low, 0, 0
    # With g(i) = matches before i - agree * i, a stretch [i, j] qualifies when its gain is not negative.
    before = np.arange(len(at)) - agree * at
    after = np.arange(1, len(at) + 1) - agree * (at + 1)
    least = np.minimum.accumulate(before)
    best = (0, 0, 0)
    first = np.searchsorted(-least, -(after + 1e-9), "left")  # earliest start whose level is reached
    first = np.minimum(first, np.arange(len(at)))
    spans = at - at[first] + 1
    k = int(np.argmax(spans))
    best = (int(low + at[first[k]]), int(spans[k]), int(k - first[k] + 1))
    return best


def _compare(agree: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, item, shift, a, b in zip(*(batch.column(c) for c in ("doc_id", "item_id", "shift", "tokens", "item")), strict=True):
                x, y = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
                rows.append((doc.as_py(), item.as_py(), *longest_overlap(x, y, shift.as_py(), agree), len(y)))
            names = ["doc_id", "item_id", "start", "overlap", "matches", "item_tokens"]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def contaminations(docs: DataFrame, benchmark: DataFrame, least: int = 13, agree: float = 0.7, masks: tuple[str, ...] = MASKS, bloom_bits: int = 26) -> DataFrame:
    """(doc_id, item_id, start, overlap, matches, item_tokens): the longest overlap of each pair that is long enough."""
    spark = docs.sparkSession
    if len({len(m) for m in masks}) != 1:
        raise ValueError("masks must have one span")
    long = min(least, _LONG)
    if not complete(masks, long, agree):
        raise ValueError(f"masks miss overlaps of {long} tokens or more of which {agree} match: pass masks of lower weight")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).filter("item_id IS NOT NULL")
    seed = "array<struct<hash:long,at:int>>"
    items = written(items.mapInArrow(_item_rows(masks, long), f"item_id long, item array<long>, seeds {seed}"), "items")

    size = 1 << bloom_bits
    bloom = np.zeros(size // 8, np.uint8)  # of one size, whatever the benchmark

    def parts(batches):
        own = np.zeros(size // 8, np.uint8)
        for batch in batches:
            h = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            for bit in _bits(h, size):
                np.bitwise_or.at(own, bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))
        used = np.flatnonzero(own)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own[used].astype(np.int16))], names=["place", "byte"])

    hashes = items.select(F.explode("seeds.hash").alias("hash")).distinct()
    merged = hashes.mapInArrow(parts, "place long, byte short").groupBy("place").agg(F.bit_or("byte").alias("byte")).toArrow()  # at most size / 8 rows
    bloom[merged["place"].to_numpy()] = merged["byte"].to_numpy().astype(np.uint8)
    short = [r[0] for r in items.filter((F.size("item") < long) & (F.size("item") > 0)).select(F.size("item")).distinct().collect()]  # fewer than 13
    if not all(complete(_SHORT[n], n, agree, exact=True) for n in short):
        raise ValueError(f"items of under {long} tokens of which {agree} match would be missed")
    every = list(dict.fromkeys([*masks, *(m for n in sorted(short) for m in _SHORT[n])]))
    shared = spark.sparkContext.broadcast(bloom)
    hit = docs.mapInArrow(_doc_rows(every, shared, size), f"doc_id long, tokens array<long>, seeds {seed}")
    hit = written(hit, "hits")

    there = items.select("item_id", F.explode("seeds").alias("s")).select("item_id", F.col("s.hash").alias("hash"), F.col("s.at").alias("there"))
    here = hit.select("doc_id", F.explode("seeds").alias("s")).select("doc_id", F.col("s.hash").alias("hash"), F.col("s.at").alias("here"))
    lines = here.join(there, "hash").select("doc_id", "item_id", (F.col("here") - F.col("there")).alias("shift")).distinct()
    both = lines.join(hit.select("doc_id", "tokens"), "doc_id").join(items.select("item_id", "item"), "item_id")
    schema = "doc_id long, item_id long, start int, overlap int, matches int, item_tokens int"
    found = both.mapInArrow(_compare(agree), schema).filter(F.col("overlap") >= F.least(F.lit(least), F.col("item_tokens")))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap", "matches", (-F.col("start")).alias("s"), "item_tokens")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).alias("start"), "m.overlap", "m.matches", "m.item_tokens")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """``docs`` without the contaminated documents. Rows that repeat a doc_id are one document, which goes as a whole."""
    dirty = written(contaminations(docs, benchmark, **limits).select(F.col("doc_id").alias("__dirty")).distinct(), "dirty")
    return without(docs, dirty, docs["doc_id"] == dirty["__dirty"])
