"""Landed query results as a data source: a file is read binding by binding, not as one row.

A response of any size takes the memory of a block and of its longest binding. Files are the
partitions; one that is lost is read again by itself.
"""

import codecs
import json
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from placeweave.schema import PLACE_COLUMNS

# Bytes read at a time, and characters of a batch that is handed to Spark.
BLOCK = 1 << 16
BATCH = 1 << 22

_SPACE = re.compile(r"[ \t\r\n]*")
_DECODER = json.JSONDecoder()


class _Text:
    """JSON text of which only the part that is not used yet is held."""

    def __init__(self, stream: BinaryIO):
        self._stream = stream
        self._decoder = codecs.getincrementaldecoder("utf-8-sig")()
        self._held, self._at, self._ended = "", 0, False

    def _more(self, size: int) -> None:
        data = self._stream.read(size)
        self._ended = not data
        self._held = self._held[self._at :] + self._decoder.decode(data, self._ended)
        self._at = 0

    def peek(self) -> str:
        """The next sign that is no white space, or nothing at the end."""
        while True:
            self._at = _SPACE.match(self._held, self._at).end()
            if self._at < len(self._held) or self._ended:
                return self._held[self._at : self._at + 1]
            self._more(BLOCK)

    def take(self, signs: str) -> str:
        found = self.peek()
        if not found or found not in signs:
            raise ValueError(f"expected one of {signs!r} in a response, found {found!r}")
        self._at += 1
        return found

    def value(self):
        """The next value, whole. Twice as much is read at each try, so a long one takes linear time."""
        self.peek()
        size = BLOCK
        while True:
            try:
                found, end = _DECODER.raw_decode(self._held, self._at)
                if end < len(self._held) or self._ended:
                    self._at = end
                    return found
            except json.JSONDecodeError:
                if self._ended:
                    raise
            self._more(size)
            size *= 2


def _members(text: _Text) -> Iterator[str]:
    """The keys of an object, each before its value, which the caller takes."""
    text.take("{")
    if text.peek() == "}":
        text.take("}")
        return
    while True:
        if text.peek() != '"':
            raise ValueError(f"expected a key in a response, found {text.peek()!r}")
        key = text.value()
        text.take(":")
        yield key
        if text.take(",}") == "}":
            return


def _elements(text: _Text) -> Iterator:
    text.take("[")
    if text.peek() == "]":
        text.take("]")
        return
    while True:
        yield text.value()
        if text.take(",]") == "]":
            return


def bindings(stream: BinaryIO) -> Iterator[dict]:
    """The bindings of all responses in a stream, which may follow each other."""
    text = _Text(stream)
    while text.peek():
        for key in _members(text):
            if key != "results" or text.peek() != "{":
                text.value()
                continue
            for inner in _members(text):
                if inner == "bindings" and text.peek() == "[":
                    yield from _elements(text)
                else:
                    text.value()


def cell(binding: dict, variable: str) -> str | None:
    """A variable's value as text; half a surrogate pair, which is no character, becomes `?`."""
    bound = binding.get(variable)
    value = bound.get("value") if isinstance(bound, dict) else None
    if value is None:
        return None
    if not isinstance(value, str):
        return json.dumps(value)
    return value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, variables: list[str]):
        self._path, self._variables = path, variables

    def partitions(self) -> list[_File]:
        store, path = fs.FileSystem.from_uri(self._path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self._path)
        if found.type == fs.FileType.Directory:
            inside = store.get_file_info(fs.FileSelector(path))
            files = [f for f in inside if f.is_file and f.size and not f.base_name.startswith(("_", "."))]
        else:
            files = [found]
        return [_File(f.path) for f in sorted(files, key=lambda f: f.path)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so for a folder without files.
            return
        store = fs.FileSystem.from_uri(self._path)[0]
        with store.open_input_stream(partition.value) as stream:
            rows, held = [], 0
            for binding in bindings(stream):
                row = [cell(binding, v) for v in self._variables]
                rows.append(row)
                held += sum(map(len, filter(None, row))) + len(row)
                if held >= BATCH:
                    yield self._batch(rows)
                    rows, held = [], 0
            if rows:
                yield self._batch(rows)

    def _batch(self, rows: list[list[str | None]]) -> pa.RecordBatch:
        columns = [pa.array(column, pa.string()) for column in zip(*rows)]
        return pa.RecordBatch.from_arrays(columns, self._variables)


class ResponseSource(DataSource):
    """Format `query_responses`: the columns of the read schema are the variables."""

    @classmethod
    def name(cls) -> str:
        return "query_responses"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in PLACE_COLUMNS)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.fieldNames())


def read_responses(spark: SparkSession, path: str, variables: list[str] | None = None) -> DataFrame:
    """Landed query results as one string column per variable; unbound variables are null.

    `path` is a file or a folder, local or by a URI. A file holds any number of JSON responses
    after each other and is one task, which holds no more of it than a block and one binding, so
    `tables.read_bindings` is for files of small responses and this for large ones. What is not
    such a response is an error; empty files and empty folders have no rows.
    """
    spark.dataSource.register(ResponseSource)
    schema = ", ".join(f"`{v}` string" for v in variables or PLACE_COLUMNS)
    return spark.read.format(ResponseSource.name()).schema(schema).load(path)
