"""Stateful operators of streams: a chunker fed by sections (CHK-04) and a bounded buffer (STR-04).

Both keep what is open in the state store between triggers (RocksDB: set ``spark.sql.streaming.stateStore.providerClass``
for a live stream, see ``STORE``), so that a restart goes on where it was. Over a table they need no store: the rows of a key come in order in one
partition, and the same rules run along them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpuslake.operators.chunk import LEAST, MOST, OVERLAP, SEPARATORS, TARGET, chunk_id, cleaned

#: The state store that arbitrary state needs, as a setting of the session that starts the stream.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_CHUNKS = "document_id string, page_number int, chunk_index int, content string"
_RULED = re.compile(SEPARATORS)


def _share(n: int, of: int) -> float:
    return int(n / of * 1000 + 0.5) / 1000


def _furniture(text: str) -> bool:
    """The rule of ``chunk.furniture`` for text without placeholders."""
    dense = max(len("".join(text.split())), 1)
    ruled = sum(map(len, _RULED.findall(text)))
    letters = sum(ch.isascii() and ch.isalpha() for ch in text)
    return _share(ruled, dense) > 0.3 and _share(letters, dense) < 0.35


class _Chunker:
    """Where a document's chunking stands. A full block is held until the next one is full or the document ends: a short last block still joins it."""

    FIELDS = "block string, held string, page int, index int, tail string, seen long"

    def __init__(self, state: tuple | None) -> None:
        self.block, self.held, self.page, self.index, self.tail, self.seen = state or (None, None, 0, 0, None, -1)

    @property
    def state(self) -> tuple:
        return self.block, self.held, self.page, self.index, self.tail, self.seen

    def _released(self) -> Iterator[tuple[int, int, str]]:
        """Chunks of the held block."""
        block, start = self.held, 0
        while block is not None:
            own = block[start : start + MOST].strip()
            if own and (self.index == 0 or len(own) >= LEAST and not _furniture(own)):
                before = f"{self.tail}\n\n" if start == 0 and self.tail else ""
                yield self.page, self.index, before + own
                self.index, self.tail = self.index + 1, own[-OVERLAP:]
            if start + MOST >= len(block):
                break
            start += MOST - OVERLAP
        if block is not None:
            self.page, self.held = self.page + 1, None

    def section(self, text: str) -> Iterator[tuple[int, int, str]]:
        if text:
            self.block = f"{self.block}\n\n{text}" if self.block else text
            if len(self.block) >= TARGET:
                yield from self._released()
                self.held, self.block = self.block, None

    def end(self) -> Iterator[tuple[int, int, str]]:
        if self.block and self.held is not None and len(self.block) < LEAST:
            self.held = f"{self.held}\n\n{self.block}"
        elif self.block:
            yield from self._released()
            self.held = self.block
        self.block = None
        yield from self._released()


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows of a key by ``seq``: what a trigger brings of it is sorted here."""
    return pd.concat(list(rows)).sort_values("seq").itertuples()


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """A table by key and order: a key's rows follow each other in one partition."""
    return rows.repartition(key).sortWithinPartitions(key, "seq")


def _fed(chunker: _Chunker, seq: int | None, section: str | None, last: bool, out: list[tuple]) -> _Chunker:
    """A row's section, its chunks added to ``out``; the chunker that takes the next row."""
    if seq is not None and seq <= chunker.seen:
        return chunker  # was here before a restart of the source
    chunker.seen = chunker.seen if seq is None else seq
    out += chunker.section(section or "")
    if last:
        out += chunker.end()
        return _Chunker(None)
    return chunker


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents whose rows follow each other."""
    now, chunker = [], _Chunker(None)
    for batch in batches:
        made: list[tuple] = []
        for document, seq, section, last in zip(*(batch.column(c).to_pylist() for c in ("document_id", "seq", "section", "last")), strict=True):
            if now != [document]:
                now, chunker = [document], _Chunker(None)
            out: list[tuple] = []
            chunker = _fed(chunker, seq, section, last, out)
            made += [(document, *c) for c in out]
        columns = list(zip(*made, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["document_id", "page_number", "chunk_index", "content"])


class SectionChunker(StatefulProcessor):
    """State of an open document: one full block and one open one at most."""

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", _Chunker.FIELDS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        chunker, out = _Chunker(self.open.get() if self.open.exists() else None), []
        for row in _in_order(rows):
            chunker = _fed(chunker, row.seq, row.section, bool(row.last), out)
        if chunker.seen < 0:
            self.open.clear()
        else:
            self.open.update(chunker.state)
        yield pd.DataFrame([(key[0], *c) for c in out], columns=["document_id", "page_number", "chunk_index", "content"])

    def close(self) -> None:
        pass


def chunk_sections(sections: DataFrame) -> DataFrame:
    """Chunks of documents that arrive in sections (document_id, seq, section, last): id, document_id, page_number, chunk_index, content.

    The chunks of a document are those of ``chunk.chunk_documents`` over its sections joined by blank lines, however they are split over triggers. Sections
    arrive in order of ``seq`` from trigger to trigger (within one in any order); ``last`` ends a document and drops its state; repeated ones are skipped while it is open. A section may
    be blank, null or hold blank lines itself.
    """
    whole = sections.select(F.col("document_id").cast("string").alias("document_id"), F.col("seq").cast("long").alias("seq"), "section", F.coalesce("last", F.lit(False)).alias("last"))
    whole = whole.select("document_id", "seq", "last", F.split(F.coalesce("section", F.lit("")), "\n{2,}").alias("parts"))
    at = F.struct(F.col("pos"), F.col("col"))
    cut = whole.select("document_id", "seq", "last", F.size("parts").alias("n"), "parts")  # below the explosion, so that no part carries its whole section
    cut = cut.select("document_id", "seq", "last", "n", F.posexplode("parts")).select("document_id", "seq", "last", "n", at.alias("part"))
    # A section of several blocks: its parts come after one another, and the last one carries the end.
    rows = cut.select("document_id", (F.col("seq") * (1 << 20) + F.col("part.pos")).alias("seq"), cleaned(F.col("part.col")).alias("section"), (F.col("last") & (F.col("part.pos") == F.col("n") - 1)).alias("last"))
    if rows.isStreaming:
        made = rows.groupBy("document_id").transformWithStateInPandas(statefulProcessor=SectionChunker(), outputStructType=_CHUNKS, outputMode="append", timeMode="None")
    else:
        made = _dealt(rows, "document_id").mapInArrow(_chunked, _CHUNKS)
    return made.select(chunk_id(F.col("document_id"), F.col("page_number"), F.col("chunk_index")).alias("id"), "document_id", "page_number", "chunk_index", "content")


class Buffer(StatefulProcessor):
    """Rows of a stream until they are a batch: as many rows or bytes as a batch may have, or until the first of them has waited."""

    def __init__(self, most_rows: int, most_bytes: int, wait_ms: int) -> None:
        self.most_rows, self.most_bytes, self.wait_ms = most_rows, most_bytes, wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "seq long, row string")
        self.counts = handle.getValueState("counts", "batch long, rows int, bytes long, due long")

    def _frame(self, key, batch: int, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"stream": [key[0]] * len(rows), "batch": batch, "seq": [r[0] for r in rows], "row": [r[1] for r in rows]}).astype({"batch": "int64", "seq": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, n, size, due = self.counts.get() if self.counts.exists() else (0, 0, 2, -1)
        open_, before = (list(self.rows.get()) if n else []), batch
        for arrived in _in_order(rows):
            seq, row = arrived.seq, arrived.row
            own = len(row.encode()) + 1
            if n and (n >= self.most_rows or size + own > self.most_bytes):
                yield self._frame(key, batch, open_)
                batch, n, size, open_ = batch + 1, 0, 2, []
            open_.append((int(seq), row))
            n, size = n + 1, size + own
        if n >= self.most_rows:
            yield self._frame(key, batch, open_)
            batch, n, size, open_ = batch + 1, 0, 2, []
        if batch != before or due < 0:  # the open batch has another first row
            if due >= 0:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms if n else -1
            if n:
                self.handle.registerTimer(due)
        if n:
            self.rows.put(open_)
        elif before != batch:
            self.rows.clear()
        self.counts.update((batch, n, size, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batch, n, _, _ = self.counts.get() if self.counts.exists() else (0, 0, 2, -1)
        if n:
            yield self._frame(key, batch, list(self.rows.get()))
            self.rows.clear()
            self.counts.update((batch + 1, 0, 2, -1))

    def close(self) -> None:
        pass


def _batched(most_rows: int, most_bytes: int):
    """Rows of streams that follow each other, each with the number of its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, n, size = [], 0, 0, 2
        for part in batches:
            numbers = []
            for stream, length in zip(part.column("stream").to_pylist(), pc.binary_length(part.column("row")).to_pylist(), strict=True):
                own = length + 1
                if now != [stream]:
                    now, number, n, size = [stream], 0, 0, 2
                elif n >= most_rows or size + own > most_bytes:
                    number, n, size = number + 1, 0, 2
                n, size = n + 1, size + own
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([part.column("stream"), pa.array(numbers, pa.int64()), part.column("seq"), part.column("row")], names=["stream", "batch", "seq", "row"])

    return run


_BATCHES = "stream string, batch long, seq long, row string"


def buffered(rows: DataFrame, stream: str, seq: str, row: str, most_rows: int = 100, most_bytes: int = 800_000, wait_ms: int = 1000) -> DataFrame:
    """(stream, batch, seq, row): rows in batches that are sent together.

    A batch ends before a row that would exceed either bound (a byte between two rows and two around them count, too), when it is full, or when its first row has waited ``wait_ms``: on a table the
    end of a stream closes its batch. State is the open batch. A key is one stream, as its batches follow each other.
    """
    named = rows.select(F.col(stream).cast("string").alias("stream"), F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(row), F.lit("")).alias("row"))
    if not rows.isStreaming:
        return _dealt(named, "stream").mapInArrow(_batched(most_rows, most_bytes), _BATCHES)
    return named.groupBy("stream").transformWithStateInPandas(statefulProcessor=Buffer(most_rows, most_bytes, wait_ms), outputStructType=_BATCHES, outputMode="append", timeMode="ProcessingTime")
