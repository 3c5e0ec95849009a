r"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its distinct shingles. Its sketch has
``bands * rows`` coordinates: in round i every shingle is thrown into one coordinate by
a hash of its own and leaves the value (i, hash) there if that is the smallest;
after as many rounds as there are coordinates, shingles go to fixed coordinates,
so none stays empty. A set as large as the sketch fills it within a few rounds.
Each coordinate agrees with probability J, and concentrated around it.

Equal sets form a class with one representative. Bands of equal coordinates put
representatives into buckets; with 6 rows and 40 bands a pair at J = 0.8 misses
all buckets with probability 5e-6. Links are found without the pairs of a bucket:

1. star rounds: each member is compared with one member of its bucket, then with further ones that lie in
   another component; links merge components;
2. cross round: where members of one bucket still lie in different components, they are compared
   across components if they have one of their rarest shingles in common: sets with J >= t share a shingle among the first
   n - ceil(t n) + 1 of any common order, so this loses no link, and the shingles that
   a large group has in common come last in the order. The place of that shingle bounds the pair: nothing before the first
   common one is common, so that of the two sets the smaller must have it among its first n - ceil(2 t n / (1 + t)) + 1, and
   both places must leave room for what a link needs. Documents around one template that aren't links differ in more shingles
   than that, all rarer than the template's, so the template's keys have no smaller side and make no pair. A pair is a row under
   the first shingle it has in common and under few others. Pairs within one component need no comparison, as they can't change it.

Every link is confirmed on the full sets. Components come from
``connected_components``; every loop writes work tables, and nothing of the
documents reaches the driver. The sets of all bucket members are one work table, made once, and whether there are
links is observed as they are written: each job and plan costs the driver memory.

Nulls and odd input: null, empty or blank texts have no shingle and are alone. A
text with fewer words than a shingle is one shingle. Rows without doc_id are left
out. Rows that repeat a doc_id are one document: their texts are joined by a space, in order of text.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpuslake.llm.common import WordHashes, discard, gram_starts, hashed_words, mix, ngram_hashes, one_row_each, row_slices, semi_by_size, written
from corpuslake.llm.components import connected_components

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Longs of a set's parity bitmap: bit i tells whether an odd number of its shingles hash to i.
_BITS = 8
#: Shingles that stand before a rare shingle in its set's order and travel with it.
_BEFORE = 8


def _bits(name: str) -> list[str]:
    return [f"{name}{i}" for i in range(_BITS)]


def shingles(hashes: np.ndarray, lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), sorted and distinct within each row."""
    index, rows, _ = gram_starts(lens, size)
    grams = ngram_hashes(hashes, size)[index]
    for n in range(1, size):  # whole texts that are shorter than a shingle
        short = np.flatnonzero(lens == n)
        if len(short):
            at = (np.cumsum(lens) - lens)[short]
            rows = np.concatenate([rows, short])
            grams = np.concatenate([grams, mix(ngram_hashes(hashes, n)[at] + np.uint64(n))])
    order = np.lexsort((grams, rows))
    rows, grams = rows[order], grams[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
    return rows[new], grams[new]


def sketches(rows: np.ndarray, grams: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """The sketch (size coordinates) of each row's set; rows without shingle keep _NONE."""
    out = np.full((n_rows, size), _NONE)
    flat = out.reshape(-1)
    for i in range(2 * size):
        if not len(rows):
            break
        h = mix(grams + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = (h % np.uint64(size)).astype(np.int64) if i < size else np.full(len(h), i - size)
        value = (np.uint64(i) << np.uint64(48)) | (h >> np.uint64(16))
        np.minimum.at(flat, rows * size + place, value)
        live = np.unique(rows)
        open_ = np.zeros(n_rows, bool)
        open_[live] = (out[live] == _NONE).any(axis=1)
        keep = open_[rows]
        if not keep.all():
            rows, grams = rows[keep], grams[keep]
    return out


def _entries(size: int, bands: int, rows_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        with np.errstate(over="ignore"):
            for part in row_slices(batches):
                hashes, lens = hashed_words(part, cache, lower=True)
                rows, grams = shingles(hashes, lens, size)
                n = np.bincount(rows, minlength=len(lens))
                sketch = sketches(rows, grams, len(lens), bands * rows_).reshape(len(lens), bands, rows_)
                key = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(1)), (len(lens), bands))
                for r in range(rows_):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sketch[:, :, r])
                digests = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):  # sums of independent hashes name a set
                    total = np.zeros(len(lens) + 1, np.uint64)
                    np.cumsum(mix(grams + np.uint64(salt)), out=(sums := np.zeros(len(grams) + 1, np.uint64))[1:])
                    ends = np.cumsum(n)
                    total = sums[ends] - sums[ends - n]
                    digests.append(pa.array(mix(total + n.astype(np.uint64)).view(np.int64)))
                offsets = np.arange(len(lens) + 1, dtype=np.int32) * bands
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n.astype(np.int64)), *digests, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(key).view(np.int64).reshape(-1)))],
                    names=["doc_id", "n", "d1", "d2", "bands"],
                )

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        with np.errstate(over="ignore"):
            for part in row_slices(batches):
                hashes, lens = hashed_words(part, cache, lower=True)
                rows, grams = shingles(hashes, lens, size)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(lens)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(grams.view(np.int64)))], names=["id", "grams"])

    return run


def _rarest(percent: int, shared):
    """The first shingles of each set in one order for all sets: by how often their cell was
    counted. Two sets that link have one of these in common, whatever the order is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            ids, comps, n, tokens, bits, before, at = [], [], [], [], [], [], []
            for id_, comp, grams in zip(batch.column("id").to_pylist(), batch.column("comp").to_pylist(), batch.column("grams"), strict=True):
                g = grams.values.to_numpy(zero_copy_only=False)
                first = len(g) - -(-len(g) * percent // 100) + 1
                order = np.lexsort((g, counts[g & (len(counts) - 1)]))[:first]
                tokens.append(g[order])
                at.append(np.arange(len(order)))
                before += [g[order[max(0, i - _BEFORE) : i]] for i in range(len(order))]
                ids.append(np.full(len(order), id_))
                comps.append(np.full(len(order), comp))
                n.append(np.full(len(order), len(g)))
                odd = np.bincount((g >> 32) & (64 * _BITS - 1), minlength=64 * _BITS).astype(np.uint8) & 1
                bits.append(np.broadcast_to(np.packbits(odd).view(np.int64), (len(order), _BITS)))
            if ids:
                columns = [np.concatenate(x) for x in (tokens, ids, comps, n, at)] + list(np.concatenate(bits).T)
                offsets = np.cumsum([0, *map(len, before)], dtype=np.int32)
                before = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(before)))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in columns), before], names=["key", "rep", "comp", "n", "at", *_bits("x"), "before"])

    return run


def _sets_of(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, grams) of the given documents, from their whole texts; ``docs`` has one row each."""
    ids = written(ids.distinct(), "ids")  # they are counted and joined
    sets = written(semi_by_size(docs, ids, ["doc_id"]).mapInArrow(_sets(size), "id long, grams array<long>"), "sets")
    discard(ids)
    return sets


def _verified(sets: DataFrame, pairs: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """pairs (a, b) with linked: 100 * intersection >= percent * union of the full sets; and how many are."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    seen = Observation()
    out = both.select("a", "b", (common * 100 >= union * percent).alias("linked")).observe(seen, F.count_if("linked").alias("links"))
    return written(out, "verified"), seen.get["links"]


def _close(percent: int):
    """Sets whose sizes alone rule a link out never need a comparison."""
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def _members(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    named = buckets.join(labels, buckets["rep"] == labels["id"], "left")
    return named.select(*buckets.columns, F.coalesce("component", "rep").alias("comp"))


def _pairs(both: DataFrame, percent: int) -> DataFrame:
    return both.filter(_close(percent)).select(F.least("rep", "o").alias("a"), F.greatest("rep", "o").alias("b")).distinct()


def _star_pairs(members: DataFrame, turns: range, percent: int) -> DataFrame:
    """Each member with its bucket's hubs (another one each turn), unless they are joined already."""
    hubs = F.array(*(F.min_by(F.struct("rep", "n", "comp"), F.xxhash64("rep", F.lit(turn))) for turn in turns))
    hubs = members.groupBy("key").agg(hubs.alias("hubs")).select("key", F.explode(F.array_distinct("hubs")).alias("hub"))
    hubs = hubs.select("key", F.col("hub.rep").alias("o"), F.col("hub.n").alias("m"), F.col("hub.comp").alias("other"))
    return _pairs(members.join(hubs, "key").filter("comp != other"), percent)


def _several(members: DataFrame) -> DataFrame:
    """Keys whose members lie in more than one component."""
    return members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("key")


def _rest(sets: DataFrame, buckets: DataFrame, labels: DataFrame, done: DataFrame, percent: int, cells: int = 1 << 20) -> tuple[DataFrame, int]:
    """Comparisons that are left after the star rounds, each pair once; and how many are links."""
    members = _members(buckets, labels)
    open_ = written(members.join(_several(members), "key", "left_semi").select(F.col("rep").alias("id"), "comp").distinct(), "open")
    apart = sets.join(open_, "id")
    cell = F.col("gram").bitwiseAND(F.lit(cells - 1)).cast("int")
    counted = apart.select(F.explode("grams").alias("gram")).groupBy(cell.alias("cell")).agg(F.least(F.count("*"), F.lit(32767)).cast("smallint").alias("n"))
    counts = np.zeros(cells, np.int16)
    found = counted.toArrow()  # one row of six bytes a cell: at most `cells`, whatever the input
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    del found
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    schema = "key long, rep long, comp long, n long, at long, " + ", ".join(f"{c} long" for c in _bits("x")) + ", before array<long>"
    rare = apart.select("id", "comp", "grams").mapInArrow(_rarest(percent, shared), schema)
    members = written(rare.join(_several(rare), "key", "left_semi"), "members")
    shared.destroy()
    out = _verified(sets, _cross_pairs(members, percent).join(done, ["a", "b"], "left_anti"), percent)
    discard(members, open_)
    return out


def _cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of one key that lie in different components and may link; ``members`` is a written table.

    ``at`` shingles stand before the key in a set's order. Where the key is the first that a pair has in common, the sets
    have at most least(n - at) shingles in common, and a link needs t (n + m) / (1 + t): for the smaller set,
    whose partner is as large at least, that bounds its own place. Symmetric differences bound links, too: 2 * |A xor B| / (|A| + |B|) is at most
    2 (1 - t) / (1 + t), and the bitmaps differ in no more bits than the sets in
    shingles. All tests are part of the join, so that pairs which fail them are never
    rows. Nor are pairs that meet under a key although they have a shingle in common shortly before it
    in the order: they meet under that one as well, and under the first one that they have in common in any case.
    """
    smaller = members.filter((F.col("n") - F.col("at")) * (100 + percent) >= F.col("n") * (2 * percent))
    there = members.select("key", F.col("rep").alias("o"), F.col("n").alias("m"), F.col("at").alias("there"), F.col("comp").alias("other"), F.col("before").alias("earlier"), *(F.col(x).alias(y) for x, y in zip(_bits("x"), _bits("y"), strict=True)))
    there = there.join(smaller.select("key").distinct(), "key", "left_semi")
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(_bits("x"), _bits("y"), strict=True)), F.lit(0))
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("there")) * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    near = _close(percent) & room & (apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent))
    once = (F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("rep") != F.col("o"))
    met = smaller.alias("p").join(there.alias("q"), (F.col("p.key") == F.col("q.key")) & (F.col("comp") != F.col("other")) & once & near & ~F.arrays_overlap("before", "earlier"))
    return met.select("rep", "n", "o", "m").transform(_pairs, percent)


def _round(found: DataFrame, links: int, founds: list[DataFrame], labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components with the links of ``found``, and all comparisons so far: ``founds``, to which it is added."""
    founds.append(found)
    if links:
        labels = connected_components(found.filter("linked").select("a", "b").union(labels.select("id", "component")))
    return labels, reduce(DataFrame.unionByName, founds)


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, star_rounds: int = 3
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    docs = one_row_each(docs)
    schema = "doc_id long, n long, d1 long, d2 long, bands array<long>"
    entries = written(docs.mapInArrow(_entries(size, bands, rows), schema), "sketches")

    classes = entries.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    spread = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    buckets = written(spread.join(shared, "key"), "buckets")

    sets = _sets_of(docs, buckets.select(F.col("rep").alias("doc_id")), size)
    done, links = _verified(sets, _star_pairs(buckets.withColumn("comp", F.col("rep")), range(1), percent), percent)
    founds, labels = [done], connected_components(done.filter("linked").select("a", "b"))
    if links and star_rounds > 1:
        pairs = _star_pairs(_members(buckets, labels), range(1, star_rounds), percent).join(done, ["a", "b"], "left_anti")
        labels, done = _round(*_verified(sets, pairs, percent), founds, labels)
    labels, _ = _round(*_rest(sets, buckets, labels, done, percent), founds, labels)
    discard(buckets, sets, *founds)
    return _labelled(entries, classes, labels)


def _labelled(entries: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    names = classes.select("d1", "d2", "rep").join(labels, classes["rep"] == labels["id"], "left")
    names = names.select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = entries.filter("n > 0").select("doc_id", "n", "d1", "d2").join(names, ["d1", "d2"], "left")
    alone = entries.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = out.select("doc_id", "n", "component").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
