"""Token ids in Arrow stream files of equal-length sequences and masks, and reading them back.

A file holds the documents of one range of doc_id, ids in a row, as record batches of fixed-size
lists: `ids` and `mask`, which is false where the last sequence is padded. Every batch but the last
has the same number of sequences, so the place of an id gives its batch and its position in the
batch's buffer, and a mapped file is read without a copy. A second stream file beside it lists the
documents with their first id and number of ids. Files are written under a name of their own for
each attempt of a task, and only those of successful attempts are in the list of files.
"""

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeweave.llm.rows import slices
from placeweave.llm.tokens import encoder
from placeweave.staging import Stage

# Sequences in a batch; with 1024 ids each, a batch has half a megabyte of 16-bit ids.
BATCH_SEQUENCES = 256
DOCUMENT_ROWS = 10_000

_FILE = "part int, ids_file string, documents_file string, n_ids long, n_documents long"


class Index(NamedTuple):
    """A file's documents: doc_id, first id in the file, number of ids."""

    doc_id: list
    start: list
    n_tokens: list


def write(
    docs: DataFrame, stage: Stage, tokenizer: str, length: int = 1024, end_id: int = 2
) -> DataFrame:
    """Write the ids of `docs` (doc_id, text) and return the list of files, in order of doc_id.

    A document is its ids and then `end_id`; a null or empty text is the end id alone. Rows are
    ordered by doc_id, null first, and rows of one doc_id by their texts; rows that repeat stay.
    Other columns are ignored. Without rows there are no files.
    """
    folder = stage.path("sequences")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id"), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = slices(batches)
        batch = next(batches, None)
        if batch is None:
            return
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        wide = max(encode.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16
        kind, name = pa.uint32() if wide else pa.uint16(), uuid.uuid4().hex
        with _Writer(folder, name, kind, length) as writer:
            while batch is not None:
                for doc_id, ids in zip(batch.column("doc_id"), encode.column(batch.column("text"))):
                    writer.add(doc_id.as_py(), np.frombuffer(ids + end, "<u4"))
                batch = next(batches, None)
        part = TaskContext.get().partitionId()
        columns = [[part], [writer.ids_file], [writer.documents_file], [writer.n_ids], [writer.n_documents]]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(columns, kinds)],
            ["part", "ids_file", "documents_file", "n_ids", "n_documents"],
        )

    return stage.keep(dealt.mapInArrow(run, _FILE), "files")


def read(files: DataFrame) -> DataFrame:
    """The documents of the files: doc_id, start (ids of all documents before), n_tokens, ids.

    `ids` are little-endian unsigned 32-bit numbers. A file is read by a task of its own, batch by
    batch.
    """
    # One row per file, of numbers only.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.to_pylist():
                sequences = Sequences(file["ids_file"])
                with _input(file["documents_file"]) as source, pa.ipc.open_stream(source) as index:
                    for listed in index:
                        starts = listed.column("start").to_numpy()
                        numbers = listed.column("n_tokens").to_numpy()
                        ids = [
                            sequences.ids(a, n).astype("<u4").tobytes()
                            for a, n in zip(starts.tolist(), numbers.tolist())
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [
                                listed.column("doc_id"),
                                pa.array(starts + file["base"]),
                                listed.column("n_tokens"),
                                pa.array(ids, pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )

    # As many partitions as files: by a key alone, Spark would merge the few bytes of their names.
    dealt = placed.select("ids_file", "documents_file", "base").repartition(max(1, files.count()))
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


class Sequences:
    """Random access to the ids of a file."""

    def __init__(self, path: str):
        with _input(path) as source, pa.ipc.open_stream(source) as stream:
            self.batches = list(stream)
        self.length = self.batches[0].column("ids").type.list_size if self.batches else 1
        self.flat = [b.column("ids").flatten().to_numpy() for b in self.batches]
        self.masks = [b.column("mask").flatten() for b in self.batches]
        self.each = len(self.flat[0]) if self.flat else 1

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence k of the file, both views of the file."""
        number, at = divmod(k, self.each // self.length)
        ids = self.flat[number][at * self.length : (at + 1) * self.length]
        return ids, self.masks[number].slice(at * self.length, self.length)

    def ids(self, start: int, number: int) -> np.ndarray:
        """Ids from place `start` on; a view of the file unless they reach into another batch."""
        parts = []
        while number > 0:
            batch, at = divmod(start, self.each)
            part = self.flat[batch][at : at + number]
            parts.append(part)
            start, number = start + len(part), number - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.empty(0, np.uint32)])


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _input(path: str) -> pa.NativeFile:
    system, plain = _filesystem(path)
    if isinstance(system, fs.LocalFileSystem):
        return pa.memory_map(plain)
    return system.open_input_file(plain)


class _Writer:
    """Writes a file and its index as documents come, holding one batch of each."""

    def __init__(self, folder: str, name: str, kind: pa.DataType, length: int):
        self.kind, self.length = kind, length
        self.ids_file, self.documents_file = f"{folder}/{name}.ids", f"{folder}/{name}.documents"
        self.n_ids = self.n_documents = 0
        self.waiting: list[np.ndarray] = []
        self.waiting_ids = 0
        self.index = Index([], [], [])
        lists = [("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))]
        numbers = [(c, pa.int64()) for c in Index._fields]
        system, plain = _filesystem(folder)
        system.create_dir(plain, recursive=True)
        self.ids_schema, self.index_schema = pa.schema(lists), pa.schema(numbers)
        self.outputs = [system.open_output_stream(f"{plain}/{name}.{x}") for x in ("ids", "documents")]
        schemas = (self.ids_schema, self.index_schema)
        self.streams = [pa.ipc.new_stream(o, s) for o, s in zip(self.outputs, schemas)]

    def __enter__(self) -> "_Writer":
        return self

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for column, value in zip(self.index, (doc_id, self.n_ids, len(ids))):
            column.append(value)
        self.n_ids, self.n_documents = self.n_ids + len(ids), self.n_documents + 1
        self.waiting.append(ids)
        self.waiting_ids += len(ids)
        if self.waiting_ids >= BATCH_SEQUENCES * self.length:
            self._flush(whole_batches=True)
        if len(self.index.doc_id) >= DOCUMENT_ROWS:
            self._flush_index()

    def _flush(self, whole_batches: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        each = BATCH_SEQUENCES * self.length
        full = len(ids) // each * each if whole_batches else len(ids)
        for start in range(0, full, each):
            part = ids[start : min(start + each, full)]
            padding = -len(part) % self.length
            mask = np.arange(len(part) + padding) < len(part)
            values = np.pad(part, (0, padding)).astype(self.kind.to_pandas_dtype())
            arrays = [
                pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (values, mask)
            ]
            self.streams[0].write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.ids_schema))
        self.waiting, self.waiting_ids = [ids[full:]], len(ids) - full

    def _flush_index(self) -> None:
        arrays = [pa.array(x, pa.int64()) for x in self.index]
        self.streams[1].write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.index_schema))
        self.index = Index([], [], [])

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self._flush(whole_batches=False)
            self._flush_index()
        for opened in (*self.streams, *self.outputs):
            opened.close()
