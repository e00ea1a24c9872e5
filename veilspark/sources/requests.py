"""Request bodies as a source, in batch and on a stream, and a result for each request.

A folder holds files of JSON lines, a request body a line: {"text": ...} or {"texts": [...]}, with "language" and "config" if
wanted. Files are put there whole and are not changed after; on a stream a new file's name sorts after all earlier ones, as
names that begin with a time do. Executors read the files, in ranges of bytes; the offset of a stream is the last file's name.

    spark.dataSource.register(requests.Requests)
    spark.read.format("requests").load(folder)          # or readStream

Rows: request (file and byte where the body starts), nth (place of the text in the body), text, language (en by default),
config, error. Defined results: a line that is no JSON object, a body without a text and an empty list of texts give one row
with a null text and an error; a null in a list, or what is not a string, is a row with an error of its own; blank lines are
passed over; a value of config that is not a string is its JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.rules import Profile
from ..plans import pipeline

SCHEMA = "request string, nth int, text string, language string, config map<string,string>, error string"
SPLIT = 32 << 20


@dataclass
class Range(InputPartition):
    """Lines that start in the bytes [start, end) of a file."""

    file: str
    start: int
    end: int


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def rows_of(line: bytes, request: str) -> Iterator[tuple]:
    """The rows of one body."""
    try:
        body = json.loads(line)
    except ValueError:  # also what is no UTF-8
        body = None
    if not isinstance(body, dict):
        yield request, 0, None, "en", {}, "not a JSON object"
        return
    language, config = body.get("language"), body.get("config")
    language = language if isinstance(language, str) and language else "en"
    config = {k: v if isinstance(v, str) else json.dumps(v) for k, v in config.items()} if isinstance(config, dict) else {}
    texts = body["texts"] if isinstance(body.get("texts"), list) else [body.get("text")]
    for nth, text in enumerate(texts or [None]):
        good = isinstance(text, str)
        yield request, nth, text if good else None, language, config, None if good else "no text"


class _Files:
    """What both readers share: the files of a folder in order of their names, cut into ranges of bytes."""

    def __init__(self, options):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))

    def files(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        where, root = _filesystem(self.path)
        found = where.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted((f.base_name, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith((".", "_")))

    def ranges(self, files: list[tuple[str, int]]) -> list[Range]:
        return [Range(f, a, min(a + self.split, size)) for f, size in files for a in range(0, size, self.split)]

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # no file at all
            return
        where, root = _filesystem(self.path)
        with where.open_input_file(f"{root}/{partition.file}") as raw:
            at = partition.start
            if at:  # a line that starts before is the range's before, which reads it to its end
                raw.seek(at - 1)
                at += len(_line(raw)) - 1
            raw.seek(at)
            for line in _lines(raw, partition.end - at):
                if line.strip():
                    yield from rows_of(line, f"{partition.file}:{at}")
                at += len(line)


def _line(raw) -> bytes:
    """Bytes up to and with the next line feed, or the file's end."""
    out = []
    while block := raw.read(1 << 16):
        end = block.find(b"\n")
        if end >= 0:
            out.append(block[: end + 1])
            break
        out.append(block)
    return b"".join(out)


def _lines(raw, length: int) -> Iterator[bytes]:
    """The lines that start in the next `length` bytes, read in blocks; only the last may go beyond."""
    rest: list[bytes] = []
    while length > 0 and (block := raw.read(min(1 << 20, length))):
        length -= len(block)
        *whole, last = block.split(b"\n")
        for part in whole:
            yield b"".join((*rest, part, b"\n"))
            rest = []
        if last:
            rest.append(last)
    if rest:
        yield b"".join((*rest, _line(raw)))


class _Batch(_Files, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges(self.files())


class _Stream(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        files = self.files()
        return {"last": files[-1][0] if files else ""}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges([f for f in self.files() if start["last"] < f[0] <= end["last"]])


class Requests(DataSource):
    """Options: path; splitBytes, the bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "requests"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def answered(rows: DataFrame, name: str | Profile = "light", **options) -> DataFrame:
    """Each text of the requests with its entities and its masked form; rows with an error have none."""
    return pipeline.analyze(rows, name, lang="language", **options)


def batch_results(rows: DataFrame, name: str | Profile = "light", **options) -> DataFrame:
    """A row for each request: config, results in order, total_processed, success_count, error_count and errors.

    A request's results are as large as its body, which is one line.
    """
    done = answered(rows, name, **options)
    good = F.col("error").isNull()
    result = F.struct("nth", "language", "has_pii", "masked_text", "entities")
    out = done.groupBy("request").agg(
        F.first("config").alias("config"),
        F.array_sort(F.collect_list(F.when(good, result))).alias("results"),
        F.count("*").alias("total_processed"),
        F.count_if(good).alias("success_count"),
        F.count_if(~good).alias("error_count"),
        F.array_sort(F.collect_list(F.when(~good, F.struct("nth", "error")))).alias("errors"),
    )
    return out
