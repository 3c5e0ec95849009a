"""A dump of whole rows as JSON lines, appended once however often a task runs (SNK-12)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class JsonLines(DataSource):
    """``df.write.format("jsonl").mode("append").save(folder)``.

    A task writes a hidden file of its own. When all tasks are through, the files get their names; files of attempts that
    failed or ran twice are not among them and are removed. Every column is kept, nulls too; dates and times are ISO text, bytes hexadecimal.
    The folder may be of any file system that Arrow knows by its URI, and has to be seen by all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "jsonl"

    def writer(self, schema, overwrite: bool) -> JsonLinesWriter:
        return JsonLinesWriter(self.options["path"], overwrite)


class JsonLinesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = _place(self.path)
        files.create_dir(base, recursive=True)
        name, rows = f"_{self.job}-{uuid.uuid4().hex}.jsonl", 0
        with files.open_output_stream(f"{base}/{name}") as out:
            for batch in iterator:
                rows += batch.num_rows
                out.write("".join(json.dumps(row, ensure_ascii=False, default=_text) + "\n" for row in batch.to_pylist()).encode())
        return Written(name, rows)

    def _own(self, files, base: str) -> list[str]:
        from pyarrow import fs

        found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
        return [f.path for f in found if f.base_name.startswith(f"_{self.job}-")]

    def commit(self, messages: list[Written]) -> None:
        from pyarrow import fs

        files, base = _place(self.path)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if f.base_name.startswith("part-"):
                    files.delete_file(f.path)
        for i, message in enumerate(m for m in messages if m is not None and m.rows):
            files.move(f"{base}/{message.file}", f"{base}/part-{self.job}-{i:05}.jsonl")
        for left in self._own(files, base):
            files.delete_file(left)

    def abort(self, messages: list[Written]) -> None:
        files, base = _place(self.path)
        for left in self._own(files, base):
            files.delete_file(left)


def _text(value) -> str:
    return value.hex() if isinstance(value, bytes) else value.isoformat() if hasattr(value, "isoformat") else str(value)
