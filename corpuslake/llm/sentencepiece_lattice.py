r"""SentencePiece encoding and decoding as a relational lattice.

A text becomes ``_`` + text with every space as ``_`` (U+2581), and is cut into units, at places that
no piece of the table crosses: before a space, around line ends, and before a sign that follows
none of its kind in any piece. Units are encoded as a lattice:

1. their substrings up to the length of a piece that begins alike are exploded and equi-joined with
   the piece table (a table of fixed size, which is broadcast): the edges of the lattice;
2. the edges are grouped by unit;
3. Spark's ``aggregate`` folds them: for a unigram table it is Viterbi over the
   positions; for a BPE table, whose scores are merge ranks and don't add up, it
   applies, best first, every edge that joins exactly two neighbours. Bounds between
   pieces are the bits of a long.

Characters without piece become the pieces of their UTF-8 bytes.

The most frequent units, ``vocabulary`` at most, are encoded once and broadcast in flat arrays (25 bytes each).
Documents become the codes of their units in it, and each unit without code is a hole: a row
of its own, which is dealt with its document by the document's key and encoded there by the same lattice. So
texts are cut twice (to count, to code; mostly at their spaces alone) and shuffled once, as codes of two bytes a unit, and no number
of rare units reaches the driver. The size of the vocabulary changes no result.
Units of over 60 characters, which the bits of a long can't hold, are folded by the same
rule in a Python helper where they occur.

Decoding maps ids to the bytes of their pieces and removes the leading space. Bytes that are no UTF-8 become U+FFFD.

Nulls and odd input: null and empty texts have no ids and decode to the empty text. U+2581 in a text is
read as a space, as the format has no other. Repeated rows are encoded alike and all returned. An empty table gives an empty result.
Other columns, of any name, pass through; ``ids``, ``n_tokens`` and ``decoded`` are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslake.llm.common import SLICE_BYTES, discard, partitions, row_slices, small_batches, sorted_groups, written

SPACE = "▁"
#: The most characters of a unit whose bounds fit a long.
LONGEST = 60
#: Single characters below this code are looked up in an array, others are edges.
_BASIC = 1 << 10
#: A fourth of the distinct units that a task remembers before it starts again, a sixth of those that it counts.
_UNITS = 50_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: Stands before a unit's key where the unit has no leading space.
_BARE = "\0"


def _key(unit: str) -> str:
    """A unit with plain spaces as it is looked up: without its first space."""
    return unit[1:] if unit[:1] == " " and unit[1:2] != _BARE else _BARE + unit


def _units(keys: pa.Array) -> pa.Array:
    """The units of many keys."""
    units = pc.if_else(pc.starts_with(keys, _BARE), pc.utf8_slice_codeunits(keys, 1), pc.binary_join_element_wise(" ", keys, ""))
    return pc.replace_substring(units, " ", SPACE)


def _cuts(pairs: set[str]) -> tuple[str, set[str], bool]:
    """A pattern of the units, from all neighbours within pieces: never is one cut apart. Then the signs
    that it cuts at, and whether it cuts at line ends."""
    if any(y == SPACE != x for x, y in pairs):
        raise ValueError("a piece holds a space after another sign")
    signs = {c for pair in pairs for c in pair if not c.isalnum()} - {SPACE}
    while held := {y for x, y in pairs if y in signs and x not in signs and x != SPACE}:
        signs -= held
    signs.discard("\n")
    line = "\n" if not any("\n" in pair for pair in pairs) else ""
    sign = "".join(map(re.escape, sorted(signs)))
    plain = f"[^{SPACE}{line}{sign}]"
    rest = f"|{SPACE}*[{sign}]+{plain}*" if sign else ""
    return f"{SPACE}*{plain}+{rest}|{SPACE}+" + (f"|{line}" if line else ""), signs, bool(line)


class PieceTable:
    """(id, piece, score) of the normal pieces, the byte pieces, and where texts may be cut."""

    def __init__(self, rows: list[tuple[int, str, float]], byte_ids: dict[int, int], kind: str = "bpe", unknown: int = 0):
        self.rows, self.byte_ids, self.kind, self.unknown = rows, byte_ids, kind, unknown
        self.index = {p: (i, s) for i, p, s in rows}
        self.longest = max((len(p) for _, p, _ in rows), default=1)
        # Texts are cut with their own spaces: as ASCII they are scanned and hashed faster, and kept in half the memory.
        pattern, signs, self.lines = _cuts({p[i : i + 2] for _, p, _ in rows for i in range(len(p) - 1)})
        self.units = re.compile(pattern.replace(SPACE, " ")).findall
        self.signed = re.compile("[" + "".join(map(re.escape, sorted(signs))) + "]").search if signs else None
        self.ascii_signs = any(c.isascii() for c in signs)

    @classmethod
    def read(cls, path: str, kind: str = "bpe") -> PieceTable:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        rows, byte_ids = [], {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                rows.append((i, sp.id_to_piece(i), sp.get_score(i)))
        return cls(rows, byte_ids, kind, sp.unk_id())

    def spaced(self, text: str | None) -> list[str]:
        """The units of a text in order, with plain spaces."""
        return self.units(" " + text.replace(SPACE, " ")) if text else []

    def keys(self, text: str | None) -> list[str]:
        """The keys of the units of a text in order. Where no sign cuts a word and spaces are single, these are what stands between the spaces."""
        if not text:
            return []
        plain = text.replace(SPACE, " ")
        if _BARE not in plain and plain[0] != " " and (self.signed is None or plain.isascii() and not self.ascii_signs or not self.signed(plain)):
            if self.lines and "\n" in plain:
                plain = plain.replace("\n", f" {_BARE}\n {_BARE}")
            if "  " not in plain:
                keys = plain.split(" ")
                return [k for k in keys if k != _BARE] if f"{_BARE} " in plain or plain[-1] == _BARE else keys
        return [_key(u) for u in self.spaced(text)]

    def split(self, texts: pa.Array) -> tuple[pa.Array, list[str | None]]:
        """The keys of all texts that ``keys`` splits at their spaces, and the other texts."""
        plain = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        odd = pc.or_(pc.match_substring(plain, _BARE), pc.or_(pc.starts_with(plain, " "), pc.equal(pc.binary_length(plain), 0)))
        if self.signed is not None:
            signed = np.zeros(len(plain), bool)
            there = np.arange(len(plain)) if self.ascii_signs else np.flatnonzero(~np.asarray(pc.string_is_ascii(plain)))
            signed[there] = [self.signed(t) is not None for t in plain.take(pa.array(there)).to_pylist()]
            odd = pc.or_(odd, pa.array(signed))
        if self.lines:
            plain = pc.replace_substring(plain, "\n", f" {_BARE}\n {_BARE}")
        odd = pc.or_(odd, pc.match_substring(plain, "  "))
        keys = pc.split_pattern(plain.filter(pc.invert(odd)), " ").flatten()
        if self.lines:
            keys = keys.filter(pc.not_equal(keys, _BARE))
        return keys, texts.filter(odd).to_pylist()

    def cut(self, text: str | None) -> list[str]:
        """The units of a text in order."""
        return [u.replace(" ", SPACE) for u in self.spaced(text)]

    def fallback(self, text: str) -> list[int]:
        return [self.byte_ids.get(b, self.unknown) for b in text.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]

    def lengths(self, spark: SparkSession) -> DataFrame:
        """(begin, lengths): how long the pieces are that begin with these three characters, and two."""
        found: dict[str, set[int]] = {}
        for _, p, _ in self.rows:
            found.setdefault(p[:3], {2}).add(len(p))
        return spark.createDataFrame([(b, sorted(n)) for b, n in found.items() if len(b) == 3] or [("", [2])], "begin string, lengths array<int>")

    def ordered(self) -> list[tuple[int, str, float]]:
        """The rows from the best score on."""
        return sorted(self.rows, key=lambda r: (-r[2], r[0]))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, place): the pieces with their places in that order and, in the lower 20 bits, their ids."""
        return spark.createDataFrame([(p, (k << 20) + i) for k, (i, p, _) in enumerate(self.ordered())], "piece string, place long")

    def bytes_of(self) -> dict[int, bytes]:
        out = {i: p.replace(SPACE, " ").encode() for i, p, _ in self.rows}
        return out | {i: bytes([b]) for b, i in self.byte_ids.items()}


def _count_units(table: PieceTable):
    def counts(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("key", use_threads=False).aggregate([("n", "sum")]).rename_columns(["key", "n"])

    def flushed(counted: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in counted.to_batches():
            units = _units(batch.column("key"))
            yield pa.RecordBatch.from_arrays([units, batch.column("n")], names=["unit", "n"]).filter(pc.less_equal(pc.utf8_length(units), LONGEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in row_slices(batches):
            keys, rest = table.split(part.column("text"))
            for own in (keys, pa.array(chain.from_iterable(map(table.keys, rest)), pa.string())):
                found = own.value_counts()
                held.append(pa.table({"key": found.field("values"), "n": found.field("counts")}))
            if sum(map(len, held)) >= 12 * _UNITS:
                held = [counts(held)]
                if len(held[0]) >= 6 * _UNITS:
                    yield from flushed(held.pop())
        if held:
            yield from flushed(counts(held))
        held.clear()
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


#: Of an edge ``e``: the bits of its two ends, those of the places between them, and whether both ends are bounds.
_STOP, _START = "CAST(e & 63L AS INT)", "CAST(shiftright(e, 6) & 63L AS INT)"
_ENDS, _INNER = f"(shiftleft(1L, {_STOP}) | shiftleft(1L, {_START}))", f"(shiftleft(1L, {_STOP}) - shiftleft(2L, {_START}))"
_BOUND = "(shiftright({0}, " + _START + ") & shiftright({0}, " + _STOP + ") & 1L) = 1L"
_ALL = "shiftleft(1L, length(unit) + 1) - 1"

#: One walk over the edges, best first. An edge that waits, as more than one bound lies within it, and whose inner
#: bounds fall to one later on would have come first then: such units (-1) are folded by _MERGES instead.
_WALK = f"""aggregate(packed, named_struct('bounds', {_ALL}, 'waits', CAST(array() AS array<bigint>), 'joined', CAST(array() AS array<bigint>)), (s, e) ->
  CASE WHEN NOT {_BOUND.format("s.bounds")} THEN s
       WHEN bit_count(s.bounds & {_INNER}) = 1 THEN named_struct('bounds', s.bounds & ~{_INNER}, 'waits', s.waits, 'joined', array_append(s.joined, e))
       WHEN (s.bounds & {_INNER}) = 0L THEN s
       ELSE named_struct('bounds', s.bounds, 'waits', array_append(s.waits, e), 'joined', s.joined) END,
  s -> IF(exists(s.waits, e -> bit_count(s.bounds & {_INNER}) <= 1), named_struct('bounds', -1L, 'joined', packed), named_struct('bounds', s.bounds, 'joined', s.joined)))"""

#: At each step the best edge that joins exactly two neighbours, until there is none; edges that
#: a merge has crossed or completed are dropped.
_MERGES = f"""aggregate(sequence(1, length(unit)), named_struct('bounds', {_ALL}, 'live', packed), (s, step) ->
  IF(size(s.live) = 0, s, get(transform(array(filter(s.live, e -> (s.bounds & {_ENDS}) = {_ENDS} AND (s.bounds & {_INNER}) != 0L)), live ->
    get(transform(array(get(filter(live, e -> bit_count(s.bounds & {_INNER}) = 1), 0)), e -> named_struct(
      'bounds', IF(e IS NULL, s.bounds, s.bounds & ~{_INNER}), 'live', IF(e IS NULL, slice(live, 1, 0), live))), 0)), 0)),
  s -> s.bounds)"""

#: For each position the best score and where its last piece starts; then the path back as bounds.
_VITERBI = """aggregate(sequence(1, length(unit)), array(struct(0D AS score, 0 AS start)), (best, j) ->
    concat(best, array(array_max(concat(
      array(struct(best[j - 1].score + {unknown}D AS score, j - 1 AS start)),
      transform(filter(packed, e -> (e & 63L) = j), e -> struct(best[CAST(shiftright(e, 6) & 63L AS INT)].score + scores[CAST(shiftright(e, 32) AS INT)] AS score,
        CAST(shiftright(e, 6) & 63L AS INT) AS start)))))),
  best -> aggregate(sequence(1, length(unit)), struct(shiftleft(1L, length(unit)) AS bounds, length(unit) AS at), (s, step) ->
    IF(s.at = 0, s, struct(s.bounds | shiftleft(1L, best[s.at].start) AS bounds, best[s.at].start AS at)), s -> s.bounds))"""


_FOLDED = ("packed", "single", "walked", "bounds", "scores")


def _constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(str(values)), f"array<{kind}>")


def lattice_ids(rows: DataFrame, table: PieceTable, keys: list[str], carried: list[str] | None = None, *more: Column) -> DataFrame:
    """``keys``, ``carried`` and ids of each group of ``keys``, which has one unit (of at most 60 characters) in the column ``unit``.

    The rows of a group are alike. Where unit is null, so are the ids.
    """
    spark, carried = rows.sparkSession, carried or []
    pieces = F.broadcast(table.frame(spark))
    size, start, stop = F.length("unit"), F.col("start"), F.col("stop")
    lattice = rows.select("*", F.explode(F.sequence(F.lit(0), F.coalesce(size, F.lit(1)) - 1)).alias("start"))
    # Only lengths of pieces that begin like the text here; single characters of a BPE table are looked up by their code.
    lattice = lattice.withColumn("begin", F.substr("unit", start + 1, F.lit(3))).join(F.broadcast(table.lengths(spark)), "begin", "left")
    lengths = F.coalesce("lengths", F.array(F.lit(2)))
    if table.kind == "bpe":
        one = (start == 0) | (F.ascii("begin") >= _BASIC)  # the row (0, 1) keeps a unit without edge
        lengths = F.when(one, F.concat(F.array(F.lit(1)), lengths)).otherwise(lengths)
    else:
        lengths = F.concat(F.array(F.lit(1)), lengths)
    lattice = lattice.select("*", F.explode(lengths).alias("length")).withColumn("stop", start + F.col("length")).filter((stop <= size) | (size.isNull() & (stop == 1)))
    lattice = lattice.withColumn("piece", F.substr("unit", start + 1, stop - start))
    lattice = lattice.join(pieces, "piece", "left").filter("place IS NOT NULL OR (start = 0 AND stop = 1)")
    # An edge is one long: the place of its piece in the table's order, its id, where it starts and where it stops.
    edge = F.col("place") * 4096 + start * 64 + stop  # null places are left out
    held = [c for c in dict.fromkeys(["unit", *carried]) if c not in keys]
    sorted_groups(spark)
    grouped = lattice.sortWithinPartitions(*keys).groupBy(*keys).agg(F.sort_array(F.collect_set(edge)).alias("packed"), *(F.first(c).alias(c) for c in held), *more)
    order = table.ordered()
    single = [-1] * _BASIC
    for i, p, _ in table.rows:
        if len(p) == 1 and ord(p) < _BASIC:
            single[ord(p)] = i
    grouped = grouped.withColumn("single", _constant(single, "int"))
    if table.kind == "bpe":
        grouped = grouped.withColumn("walked", F.expr(_WALK)).withColumn("bounds", F.expr(f"IF(walked.bounds = -1L, {_MERGES}, walked.bounds)"))
    else:
        grouped = grouped.withColumn("scores", _constant([x for _, _, x in order], "double"))
        grouped = grouped.withColumn("bounds", F.expr(_VITERBI.format(unknown=min((x for _, _, x in order), default=0.0) - 10.0)))
    # Tokens as longs that sort by place: pieces of several characters from the edges, single ones by their code or as bytes.
    sign, at = "substr(unit, p + 1, 1)", "shiftleft(CAST(p AS BIGINT), 40)"
    spelled = f"array({at} + {table.unknown}L)"
    if table.byte_ids:
        codes = ", ".join(str(table.byte_ids.get(b, table.unknown)) for b in range(256))
        raw = f"hex(encode({sign}, 'UTF-8'))"
        spelled = f"transform(sequence(1, length({raw}), 2), b -> {at} + shiftleft(CAST(b AS BIGINT), 32) + element_at(array({codes}), CAST(conv(substr({raw}, b, 2), 16, 10) AS INT) + 1))"
    found = f"""IF(ascii({sign}) < {_BASIC}, single[ascii({sign})],
                   coalesce(CAST(shiftright(get(filter(packed, e -> (e & 4095L) = p * 64 + p + 1), 0), 12) & 1048575L AS INT), -1))"""
    ids = f"""transform(sort_array(concat(
        transform(filter({"walked.joined" if table.kind == "bpe" else "packed"}, e -> {_BOUND.format("bounds")} AND (bounds & {_INNER}) = 0L AND {_INNER} != 0L), e -> shiftleft(shiftright(e, 6) & 63L, 40) + (shiftright(e, 12) & 1048575L)),
        IF((bounds & shiftright(bounds, 1)) = 0L, CAST(array() AS array<bigint>), flatten(transform(filter(sequence(0, length(unit) - 1), p -> (shiftright(bounds, p) & 3L) = 3L), p ->
          get(transform(array({found}), id -> IF(id >= 0, array({at} + id), {spelled})), 0)))))), x -> CAST(x & 4294967295L AS INT))"""
    gone = {*_FOLDED, *keys, *({"unit"} - set(carried))}
    return grouped.select(*keys, *[c for c in grouped.columns if c not in gone], F.expr(ids).alias("ids"))


def encode_units(units: DataFrame, table: PieceTable) -> DataFrame:
    """``units`` (column unit, distinct, of at most 60 characters) with ids.

    They are dealt and grouped by a hash, as a single long is sorted without comparisons. Units that have one hash
    in common, if there are any, are left out: to ``encode`` they are units without code.
    """
    dealt = units.withColumn("__hash", F.xxhash64("unit")).repartition(partitions(units.sparkSession), "__hash")  # edges are many times their units: nothing is coalesced
    alone = (F.count_if((F.col("start") == 0) & (F.col("stop") == 1)) == 1).alias("__alone")  # the row that every unit has
    return lattice_ids(dealt, table, ["__hash"], units.columns, alone).filter("__alone").drop("__hash", "__alone")


def merge(unit: str, table: PieceTable) -> list[int]:
    """The fold of one unit: a heap of the possible joins for BPE, Viterbi otherwise."""
    index = table.index
    if table.kind != "bpe":
        worst = min((s for _, s in index.values()), default=0.0) - 10
        best: list[tuple[float, int]] = [(0.0, 0)]
        for j in range(1, len(unit) + 1):
            options = [(best[j - 1][0] + worst, j - 1)]
            options += [(best[i][0] + index[unit[i:j]][1], i) for i in range(max(0, j - table.longest), j) if unit[i:j] in index]
            best.append(max(options))
        parts, at = [], len(unit)
        while at:
            parts.append(unit[best[at][1] : at])
            at = best[at][1]
        parts.reverse()
    else:
        stop = list(range(1, len(unit) + 1))  # where the symbol that starts here ends; 0: joined
        before = list(range(-1, len(unit) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = stop[a]
            if b < len(unit) and unit[a : stop[b]] in index:
                heapq.heappush(heap, (-index[unit[a : stop[b]]][1], a, b, stop[b]))

        for a in range(len(unit) - 1):
            offer(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if stop[a] != b or stop[b] != c:
                continue
            stop[a], stop[b] = c, 0
            if c < len(unit):
                before[c] = a
            offer(a)
            if a:
                offer(before[a])
        parts, at = [], 0
        while at < len(unit):
            parts.append(unit[at : stop[at]])
            at = stop[at]
    out: list[int] = []
    for part in parts:
        out += [index[part][0]] if part in index else table.fallback(part)
    return out


def unit_hashes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64 bits of each unit to look it up by, and 32 others that must agree."""
    raw = b"".join([xxhash.xxh3_128_digest(u.encode("utf-8", "replace")) for u in units])
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return both[:, 1].copy(), both[:, 0].astype(np.uint32)


def _packed_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded units as flat blobs: counts, hashes, numbers of ids, ids."""
    for batch in batches:
        if batch.num_rows:
            ids, n = batch.column("ids"), np.minimum(np.asarray(batch.column("n")), 0xFFFFFFFF).astype(np.uint32)
            hashes, checks = unit_hashes(batch.column("unit").to_pylist())
            parts = (n, hashes, checks, np.diff(np.asarray(ids.offsets)).astype(np.uint16), np.asarray(ids.flatten()).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["n", "hash", "check", "size", "ids"])


class Vocabulary:
    """Encoded units in flat arrays. A unit's code is its rank by frequency; hashes are sorted, with their codes."""

    def __init__(self, blobs: list, largest: int):
        def joined(k: str, kind, to=None) -> np.ndarray:
            parts = [np.frombuffer(b[k], kind).astype(to or kind) for b in blobs]
            return np.concatenate(parts) if parts else np.empty(0, to or kind)

        hashes, sizes = joined("hash", np.uint64), joined("size", np.uint16)
        rank = np.lexsort((hashes, ~joined("n", np.uint32))).astype(np.uint32)
        ids, starts = joined("ids", np.uint32, np.uint16 if largest < 1 << 16 else np.uint32), (np.cumsum(sizes, dtype=np.uint32) - sizes)[rank]
        sizes = sizes[rank]
        step = 1 << 17  # bounds what is held besides the result
        self.ids = np.concatenate([ids[_ragged(starts[i : i + step].astype(np.int64), sizes[i : i + step].astype(np.int64))] for i in range(0, len(rank), step)] or [ids])
        self.ends = np.concatenate([np.zeros(1, np.uint32), np.cumsum(sizes, dtype=np.uint32)])
        hashes = hashes[rank]
        self.codes = np.argsort(hashes, kind="stable").astype(np.uint32)
        self.hashes, self.checks = hashes[self.codes], joined("check", np.uint32)[rank][self.codes]

    def find(self, units: list[str]) -> np.ndarray:
        """Code + 1 of each unit; 0 where it is not held."""
        wanted, checks = unit_hashes(units)
        if not len(self.hashes):
            return np.zeros(len(units), np.int64)
        at = np.minimum(self.hashes.searchsorted(wanted), len(self.hashes) - 1)
        return np.where((self.hashes[at] == wanted) & (self.checks[at] == checks), self.codes[at].astype(np.int64) + 1, 0)


class _Known(dict):
    """A unit's key to code + 1; units that are met for the first time get a place in ``new`` instead (-1, -2, ...)."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        self.new.append(unit)
        self[unit] = -len(self.new)
        return -len(self.new)

    def codes(self, units: list[str], vocabulary: Vocabulary) -> np.ndarray:
        if len(self) > 4 * _UNITS:
            self.clear()
        out = np.fromiter(map(self.__getitem__, units), np.int64, len(units))
        if self.new:
            found = vocabulary.find(_units(pa.array(self.new, pa.string())).to_pylist())
            first = out < 0
            out[first] = found[-out[first] - 1]
            for unit, code in zip(self.new, found.tolist(), strict=True):  # units without code are rare: they are not kept
                if code:
                    self[unit] = code
                else:
                    del self[unit]
            self.new = []
        return out


#: The vocabulary that this Python worker looked units up in last, and what it remembers of it: tasks of a worker follow each other.
_remembered: list = []


def _known_of(vocabulary: Vocabulary) -> _Known:
    if not _remembered or _remembered[0] is not vocabulary:
        _remembered[:] = [vocabulary, _Known()]
    return _remembered[1]


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i] .. starts[i] + sizes[i] - 1 of all i in order."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _varints(codes: np.ndarray, lens: np.ndarray) -> list[bytes]:
    """The codes of each row (``lens`` of them) as bytes of seven bits, the lowest first."""
    width = 1 + sum((codes >= 1 << k).astype(np.int64) for k in (7, 14, 21, 28))
    ends = np.cumsum(width)
    first, out = ends - width, np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max()) if len(width) else 0):
        more = width > k
        out[first[more] + k] = (codes[more] >> 7 * k & 127) | np.where(width[more] > k + 1, 128, 0)
    raw, cut = out.tobytes(), np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lens)])].tolist()
    return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _codes(raw: np.ndarray) -> np.ndarray:
    """The numbers of all rows' bytes."""
    last = raw < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    codes, width = np.zeros(len(ends), np.int64), ends - starts + 1
    for k in range(int(width.max()) if len(width) else 0):
        more = width > k
        codes[more] |= (raw[starts[more] + k].astype(np.int64) & 127) << 7 * k
    return codes


def _coded(table: PieceTable, shared, schema: pa.Schema):
    """Each text as the codes of its units, and one row for each unit without code, a hole (code 0). Rows of a slice that are equal are one, with their number."""
    passed = [f.name for f in schema if f.name not in _OWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        known = _known_of(vocabulary)
        for part in row_slices(batches, "__text", SLICE_BYTES // 4):
            keys = list(zip(part.column("__k1").to_pylist(), part.column("__k2").to_pylist(), strict=True))
            copies = Counter(keys)
            if len(copies) < len(keys):
                part = part.take(pa.array(sorted({k: i for i, k in reversed(list(enumerate(keys)))}.values())))
                keys = list(zip(part.column("__k1").to_pylist(), part.column("__k2").to_pylist(), strict=True))
            cut = [table.keys(t) for t in part.column("__text").to_pylist()]
            lens = np.fromiter(map(len, cut), np.int64, len(cut))
            codes = known.codes(list(chain.from_iterable(cut)), vocabulary)
            holes = np.flatnonzero(codes == 0)
            rows = np.searchsorted(np.cumsum(lens), holes, "right")
            ats = holes - (np.cumsum(lens) - lens)[rows]
            units = _units(pa.array([cut[row][at] for row, at in zip(rows.tolist(), ats.tolist(), strict=True)], pa.string())).to_pylist()
            n = part.num_rows
            body = {"__at": pa.array(np.full(n, -1, np.int32)), "__codes": pa.array(_varints(codes, lens), pa.binary()), "__n": pa.array([copies[k] for k in keys], pa.int64())}
            body |= {c: part.column(c) for c in ("__k1", "__k2", *passed)}
            yield pa.RecordBatch.from_arrays([body[f.name].cast(f.type) if f.name in body else pa.nulls(n, f.type) for f in schema], schema=schema)
            if len(holes):
                hole = {"__at": pa.array(ats, pa.int32()), "unit": pa.array([u if len(u) <= LONGEST else None for u in units], pa.string())}
                hole["__ids"] = pa.array([None if len(u) <= LONGEST else merge(u, table) for u in units], pa.list_(pa.int32()))
                hole |= {c: part.column(c).take(pa.array(rows)) for c in ("__k1", "__k2")}
                yield pa.RecordBatch.from_arrays([hole[f.name].cast(f.type) if f.name in hole else pa.nulls(len(holes), f.type) for f in schema], schema=schema)

    return run


def _assembled(shared, names: list[str]):
    """The ids of each row from its codes and from the ids of its holes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for part in row_slices(batches, "__codes", SLICE_BYTES // 8):
            rows = part.column("__codes").to_pylist()
            raw = np.frombuffer(b"".join(rows), np.uint8)
            codes = _codes(raw)
            hole = codes == 0
            known = codes[~hole] - 1
            size = np.empty(len(codes), np.int64)
            starts = vocabulary.ends[known].astype(np.int64)
            size[~hole] = vocabulary.ends[known + 1] - starts
            size[hole] = np.asarray(part.column("__sizes").flatten())
            of_hole = np.repeat(hole, size)
            out = np.empty(len(of_hole), np.int32)
            out[of_hole] = np.asarray(part.column("__fills").flatten())
            out[~of_hole] = vocabulary.ids[_ragged(starts, size[~hole])]
            units = np.concatenate([[0], np.cumsum(raw < 128)])[np.cumsum([0, *map(len, rows)])]  # units before each row's end
            offsets = np.concatenate([[0], np.cumsum(size)])[units]
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), ids, pa.array(np.diff(offsets))], names=[*names, "ids", "n_tokens"])

    return run


#: Columns that rows have on their way.
_OWN = {"__k1": "long", "__k2": "long", "__at": "int", "unit": "string", "__ids": "array<int>", "__codes": "binary", "__n": "long"}


def _frequent(counted: DataFrame, most: int) -> DataFrame:
    """At most ``most`` units, the most frequent ones; of equally frequent units all or none."""
    if counted.count() <= most:
        return counted
    reached = 0
    for row in counted.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).toLocalIterator():
        reached += row["c"]
        if reached > most:
            return counted.filter(F.col("n") > row["n"])
    return counted


def encode(docs: DataFrame, table: PieceTable, vocabulary: int = 1_500_000, keep_text: bool = True) -> DataFrame:
    """``docs`` (column text) with ids (array<int>) and n_tokens; without text if not ``keep_text``."""
    spark, text = docs.sparkSession, F.coalesce("text", F.lit(""))
    small_batches(spark)
    counted = docs.select(text.alias("text")).mapInArrow(_count_units(table), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    often = encode_units(_frequent(written(counted, "units"), vocabulary), table)
    packed = written(often.mapInArrow(_packed_units, "n binary, hash binary, check binary, size binary, ids binary"), "vocabulary")
    blobs = list(packed.toLocalIterator())  # at most `vocabulary` units; the driver's JVM holds those of one partition at a time
    discard(packed)
    shared = spark.sparkContext.broadcast(Vocabulary(blobs, max((i for i, _, _ in table.rows), default=0)))
    del blobs

    # A row is dealt by its own values, so that it goes the same way if a task runs again.
    known = [F.col(f"`{f.name}`") for f in docs.schema if not _has_map(f.dataType)]
    names = [c for c in docs.columns if c not in ("ids", "n_tokens", *["text"] * (not keep_text))]
    inner = [f"__c{i}" for i in range(len(names))]
    keyed = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in zip(names, inner, strict=True)), F.xxhash64(*known).alias("__k1"), F.xxhash64(F.lit(1), *known).alias("__k2"), text.alias("__text"))
    schema = T.StructType([*(T.StructField(c, keyed.schema[c].dataType) for c in inner), *(T.StructField(c, T._parse_datatype_string(k)) for c, k in _OWN.items())])
    rows = keyed.mapInArrow(_coded(table, shared, to_arrow_schema(schema)), schema).repartition(partitions(spark), "__k1", "__k2")
    keys = ["__k1", "__k2", "__at"]  # a document's rows come in this order already
    rows = rows.withColumn("__row", F.when(F.col("__at") < 0, F.struct("__codes", "__n", *inner))).select(*keys, "unit", "__ids", "__row")
    parts = lattice_ids(rows, table, keys, ["__ids", "__row"], F.sum("__row.__n").alias("__n"))
    hole = F.when(F.col("__at") >= 0, F.struct("__at", F.coalesce("ids", "__ids").alias("ids")))
    texts = parts.sortWithinPartitions("__k1", "__k2").groupBy("__k1", "__k2").agg(F.array_sort(F.collect_list(hole)).alias("__holes"), F.max("__n").alias("__n"), F.first("__row", ignorenulls=True).alias("__row"))
    sizes, fills = F.transform("__holes", lambda h: F.size(h["ids"])), F.flatten(F.transform("__holes", lambda h: h["ids"]))
    texts = texts.select(*(F.col(f"__row.{c}") for c in inner), F.col("__row.__codes").alias("__codes"), sizes.alias("__sizes"), fills.alias("__fills"), F.explode(F.sequence(F.lit(1).cast("long"), "__n")).alias("__copy"))
    out = T.StructType([*schema.fields[: len(inner)], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType())])
    return texts.mapInArrow(_assembled(shared, inner), out).toDF(*names, "ids", "n_tokens")


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def decode(rows: DataFrame, table: PieceTable, ids: str = "ids") -> DataFrame:
    """``rows`` with decoded, the text of the ids."""
    small_batches(rows.sparkSession)
    spelling = table.bytes_of()
    spelled = [spelling.get(i, b"") for i in range(max(spelling, default=0) + 1)]
    flat, ends = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum([0, *map(len, spelled)])

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        out: list[str] = []
        for i in range(0, len(column), 64):  # bounds what is held besides the result
            part = column.slice(i, 64)
            own = np.asarray(part.flatten())
            sizes = ends[own + 1] - ends[own]
            raw = flat[_ragged(ends[own], sizes)].tobytes()
            lens = np.asarray(pc.fill_null(pc.list_value_length(part), 0))
            cut = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *lens])].tolist()
            out += [raw[a + raw.startswith(b" ", a, b) : b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]
        pa.default_memory_pool().release_unused()
        return pa.array(out, pa.string())

    return rows.withColumn("decoded", text(F.col(ids)))
