r"""Documents in sequences of a fixed length: best fit, then a local search by exchanges.

Each document becomes ids (of a tokenizer's file) and an end id. One that is longer than a sequence is cut into
pieces of a sequence's length, the first may be shorter. Full pieces are sequences of their own; the
others are packed in rounds:

1. Pieces are dealt at random into blocks of about ``block`` pieces. In a block, best fit takes the
   pieces from the longest down, each into the fullest bin that has room.
2. Exchanges between underfull bins follow: a piece moves, one piece is exchanged for a longer one, or two
   for one (either way), as long as the sum of squared fills grows. So full bins get fuller and the emptiest lose
   their pieces until they are empty and go.
3. Full bins are sequences. The pieces of underfull ones are dealt anew, into the fewer blocks that they
   need, for at most ``rounds`` rounds, until one block holds them or a round fills almost none.

A block is bounded whatever the input; a row of pieces has no text or ids, only their number and checksum.
Words are cut by the tokenizer's own pattern and each distinct one is coded once while a worker's cache holds
it; words don't touch in this kind of vocabulary, so that ids equal those of whole texts.
Texts with signs outside of the usual letters, or with a special token, are coded as wholes.

Nulls and odd input: a null or empty text is its end id alone. Rows without or with repeated doc_id are packed like
others, a row each. Ties between bins are broken by their number. An empty table gives an empty
result; further columns aren't read.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import row_slices, written

#: Distinct words whose ids a Python worker keeps, at some 250 bytes each; the cache starts again when it is full.
CACHED_WORDS = 1_000_000
#: Bits for a row within a partition, a bin within a block, and a block within a round.
_ROW_BITS, _BIN_BITS, _BLOCK_BITS = 40, 24, 34

#: Texts of these signs are cut alike by all versions of Unicode: ASCII and the Latin letters from A with grave on.
PLAIN = r"[\t\n\r\x20-\x7eÀ-ɏ]*"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
# The pattern by which byte-level vocabularies of this family cut words, for plain texts; its alternatives exclude
# each other by their first signs, so that the frequent ones may stand first.
WORDS = rf" ?[{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+"


class WordCoder:
    """Texts to their ids as bytes (little-endian, 32 bits each), by way of distinct words."""

    def __init__(self, file: str, cached: int = CACHED_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task a core already
        from tokenizers import Tokenizer

        self.tokenizer, self.cached, self.ids = Tokenizer.from_file(file), cached, {}
        self.words, self.plain = re.compile(WORDS), re.compile(PLAIN)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _coded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def code(self, texts: list[str]) -> list[bytes]:
        by_word = [bool(self.plain.fullmatch(t)) and not any(s in t for s in self.special) for t in texts]
        cut = [self.words.findall(t) if plain else () for t, plain in zip(texts, by_word, strict=True)]
        if len(self.ids) > self.cached:
            self.ids.clear()
        new = list(set().union(*cut).difference(self.ids))
        self.ids.update(zip(new, self._coded(new), strict=True))
        get = self.ids.__getitem__
        return [b"".join(map(get, words)) if plain else self._coded([t])[0] for t, words, plain in zip(texts, cut, by_word, strict=True)]


#: The coders of this Python worker, which runs many tasks one after the other.
_coders: dict[str, WordCoder] = {}


def _coder(file: str) -> WordCoder:
    if file not in _coders:
        _coders[file] = WordCoder(file)
    return _coders[file]


def cut_points(n: int, length: int) -> range | list[int]:
    """Where the pieces of ``n`` ids start: all have ``length`` ids but the first."""
    return [0, *range(n % length or length, n, length)]


_PIECE = "at long, doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(file: str, length: int, end: int):
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, made = _coder(file), TaskContext.get().partitionId() << _ROW_BITS
        for part in row_slices(batches):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), coder.code(part.column("text").to_pylist()), strict=True):
                ids += tail
                points = cut_points(len(ids) // 4, length)
                for i, (a, b) in enumerate(zip(points, [*points[1:], len(ids) // 4], strict=True)):
                    rows.append((made, doc, i, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])))
                    made += 1
            columns = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _PIECE.split(", ")])

    return run


def token_pieces(docs: DataFrame, file: str, length: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece: at (its own number), doc_id, piece, start, length, ids_crc32."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(docs.mapInArrow(_pieces(file, length, end), _PIECE), "pieces")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: items from the largest down, each into the fullest bin with room."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_sizes = 0  # bit f: some bin has exactly f free
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fitting = free_sizes >> sizes[item]
        if fitting:
            free = sizes[item] + (fitting & -fitting).bit_length() - 1
            at = by_free[free].pop()
            if not by_free[free]:
                free_sizes ^= 1 << free
        else:
            free, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        if free > sizes[item]:
            by_free[free - sizes[item]].append(at)
            free_sizes |= 1 << (free - sizes[item])
    return bins


class Exchanges:
    """The local search over underfull bins; ``bins`` change in place, emptied ones stay as empty lists.

    Every step raises the sum of squared fills: with fills a and b and d more in a, by
    2 d (a - b + d), which has to be positive. ``most`` bounds the steps of a search.
    """

    def __init__(self, sizes: list[int], bins: list[list[int]], capacity: int, most: int) -> None:
        self.sizes, self.bins, self.capacity, self.left = sizes, bins, capacity, most
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.under = [b for b, n in enumerate(self.fill) if n < capacity]
        #: size or sum of two sizes to the underfull bins that offer it; the bits tell which there are.
        self.ones: dict[int, set[int]] = {}
        self.twos: dict[int, set[int]] = {}
        self.bits = {id(self.ones): 0, id(self.twos): 0}
        for b in self.under:
            self._offer(b, True)

    def _sums(self, b: int) -> tuple[set[int], set[int]]:
        own = sorted(self.sizes[i] for i in self.bins[b])
        distinct = sorted(set(own))
        two = {x + y for k, x in enumerate(distinct) for y in distinct[k + 1 :]} | {x * 2 for x, y in zip(own, own[1:], strict=False) if x == y}
        return set(distinct), two

    def _offer(self, b: int, offered: bool) -> None:
        for table, sums in zip((self.ones, self.twos), self._sums(b), strict=True):
            for s in sums:
                if offered:
                    table.setdefault(s, set()).add(b)
                    self.bits[id(table)] |= 1 << s
                else:
                    table[s].discard(b)
                    if not table[s]:
                        del table[s]
                        self.bits[id(table)] ^= 1 << s

    def _giver(self, table: dict[int, set[int]], taker: int, gives: int) -> tuple[int, int, int] | None:
        """(gain, sum, bin): the most that ``taker`` can get for ``gives`` from a bin which is emptier afterwards."""
        free = self.capacity - self.fill[taker]
        window = (self.bits[id(table)] >> (gives + 1)) & ((1 << free) - 1)
        while window:
            gain = window.bit_length()
            window ^= 1 << (gain - 1)
            givers = [b for b in table[gives + gain] if b != taker and self.fill[taker] + gain > self.fill[b]]
            if givers:
                return gain, gives + gain, min(givers, key=lambda b: (self.fill[b], b))
        return None

    def _take(self, b: int, total: int, two: bool) -> list[int]:
        """Items of bin ``b`` with this size or sum of two sizes."""
        by_size: dict[int, list[int]] = {}
        for i in self.bins[b]:
            by_size.setdefault(self.sizes[i], []).append(i)
        if not two:
            return [by_size[total][0]]
        for x, items in by_size.items():
            others = by_size.get(total - x, [])
            if x * 2 == total and len(items) > 1:
                return items[:2]
            if x * 2 != total and others:
                return [items[0], others[0]]
        raise KeyError(total)

    def _step(self, taker: int) -> bool:
        """The best exchange of one bin: a move, one for one, two for one or one for two."""
        ones, twos = self._sums(taker)
        options = []
        for gives, kind, tables in [(0, 0, (self.ones,)), *((x, 1, (self.ones, self.twos)) for x in ones), *((x, 2, (self.ones,)) for x in twos)]:
            for table in tables:
                found = self._giver(table, taker, gives)
                if found:
                    options.append((found[0], -gives, kind, table is self.twos, found))
                    if found[0] == self.capacity - self.fill[taker]:
                        break
        if not options:
            return False
        _, gives, kind, two, (gain, total, giver) = max(options)
        away = self._take(taker, -gives, kind == 2) if kind else []
        here = self._take(giver, total, two)
        self._offer(taker, False), self._offer(giver, False)
        for out, into, items in ((taker, giver, away), (giver, taker, here)):
            self.bins[out] = [i for i in self.bins[out] if i not in items]
            self.bins[into] = self.bins[into] + items
        self.fill[taker] += gain
        self.fill[giver] -= gain
        for b in (taker, giver):
            if self.fill[b] < self.capacity and self.bins[b]:
                self._offer(b, True)
        return True

    def search(self) -> None:
        """Bins take turns, the fullest first, until none finds an exchange."""
        queue = [(-self.fill[b], b) for b in self.under]
        heapq.heapify(queue)
        changed = True
        while changed and self.left > 0:
            changed, again = False, []
            while queue and self.left > 0:
                _, b = heapq.heappop(queue)
                while self.bins[b] and self.fill[b] < self.capacity and self.left > 0 and self._step(b):
                    self.left -= 1
                    changed = True
                if self.bins[b] and self.fill[b] < self.capacity:
                    again.append((-self.fill[b], b))
            queue = again
            heapq.heapify(queue)


def pack(sizes: list[int], capacity: int, steps_a_bin: int = 16) -> list[list[int]]:
    """Best fit and the search after it; no empty bins."""
    bins = best_fit(sizes, capacity)
    under = sum(sum(sizes[i] for i in b) < capacity for b in bins)
    Exchanges(sizes, bins, capacity, steps_a_bin * under).search()
    return [b for b in bins if b]


_PLACED = f"{_PIECE}, sequence_id long, offset long, closed boolean"


def _packed_block(capacity: int, turn: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        table = table.select([c.split()[0] for c in _PIECE.split(", ")]).sort_by("at")
        sizes = table.column("length").to_pylist()
        sequence, offset, closed = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for n, items in enumerate(pack(sizes, capacity)):
            ends = np.cumsum([sizes[i] for i in items])
            sequence[items] = (turn << (_BLOCK_BITS + _BIN_BITS)) | (block << _BIN_BITS) | n
            offset[items] = ends - [sizes[i] for i in items]
            closed[items] = ends[-1] == capacity
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("closed", pa.array(closed))

    return run


def packed(pieces: DataFrame, capacity: int = 1024, block: int = 8192, rounds: int = 4) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` is a written table: its ``at`` names the rows."""
    full = pieces.filter(F.col("length") == capacity).select("*", (-1 - F.col("at")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, open_, n = [full], pieces.filter(F.col("length") < capacity), None
    for turn in range(rounds):
        before, n = n, open_.count()
        if not n:
            break
        blocks = -(-n // block)
        dealt = open_.withColumn("block", F.pmod(F.xxhash64("at", F.lit(turn)), F.lit(blocks)))
        placed = written(dealt.groupBy("block").applyInArrow(_packed_block(capacity, turn), _PLACED), "packed")
        last = blocks == 1 or turn == rounds - 1 or before is not None and n > 0.9 * before
        done.append((placed if last else placed.filter("closed")).drop("closed"))
        if last:
            break
        open_ = placed.filter("NOT closed").select(pieces.columns)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, file: str, length: int = 1024, end: int = 2, block: int = 8192) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packed(token_pieces(docs, file, length, end), length, block).drop("at")
