"""Token ids in Arrow files of fixed-size lists.

Documents are range-partitioned by doc_id and each task writes one file in the
Arrow IPC file format (random access by record batch). A row is one sequence:

* ``ids``   fixed_size_list<uint16 or uint32>[length]
* ``mask``  fixed_size_list<uint8>[length]: 0 on the padding, which only the last
  row of a file can have, 2 on the last id of a document, 1 on all others; a byte
  an id, since bits would have to be copied to be read
* ``doc_ids`` list<int64>: the documents that end in the row, in order

All rows of a file have one size, so sequence i is batch ``i // rows_per_batch``,
row ``i % rows_per_batch``, and a memory-mapped reader gets ids and mask without copying.
A file is written under a temporary name and then renamed, so a task that is run
again after an executor is lost replaces its own file and nothing else. The
manifest (one row per file) has been saved before any reader starts.

Defined cases: a null or empty text is its end id alone; rows that repeat a
doc_id are written one after the other, ordered by a hash of the text (which may
cut them into several files), each with its own end id; a null doc_id sorts first and is written as the smallest number; an empty
table has an empty manifest. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabsmith.llm.store import documents, new_path, save, ship
from tabsmith.llm.textbatch import string_buffers
from tabsmith.llm.units import text_groups, unit_encoder

ROWS_PER_BATCH = 64
PACKED_GROUP = 1 << 20              # bytes of compressed texts that are encoded together
PADDING, INSIDE, END = 0, 1, 2      # values of the mask
NO_DOC = -(1 << 63)
MANIFEST = "shard long, path string, n_docs long, n_tokens long, n_rows long, first_doc long, last_doc long"


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def file_schema(length: int, width: int) -> pa.Schema:
    ids = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.uint8(), length)),
                      ("doc_ids", pa.list_(pa.int64()))])


class SequenceWriter:
    """Cuts a stream of documents into rows and writes them, a batch of rows at a time."""

    def __init__(self, stream, length: int, width: int):
        self.length, self.dtype = length, np.dtype(f"<u{width}")
        self.schema = file_schema(length, width)
        self.out = pa.ipc.new_file(stream, self.schema)
        self.ids: list[np.ndarray] = []
        self.held = 0                                  # ids not yet written
        self.doc_ids: list[int] = []                   # of documents that end in them
        self.end_at: list[int] = []                    # where, counted from the first of them
        self.rows = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.held += len(ids)
        self.doc_ids.append(doc_id)
        self.end_at.append(self.held - 1)
        if self.held >= self.length * ROWS_PER_BATCH:
            self._write(self.held // (self.length * ROWS_PER_BATCH) * ROWS_PER_BATCH)

    def _write(self, rows: int) -> None:
        """Write the first ``rows`` rows of what is held; the last may need padding."""
        flat = np.concatenate(self.ids) if self.ids else np.zeros(0, self.dtype)
        size, have = rows * self.length, min(rows * self.length, len(flat))
        ids = np.zeros(size, self.dtype)
        ids[:have] = flat[:have]
        mask = np.full(size, PADDING, np.uint8)
        mask[:have] = INSIDE
        at = np.array(self.end_at, np.int64)
        inside = int(np.searchsorted(at, have))
        mask[at[:inside]] = END
        starts = np.searchsorted(at[:inside], np.arange(rows + 1) * self.length)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        columns.append(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(self.doc_ids[:inside], pa.int64())))
        for i in range(0, rows, ROWS_PER_BATCH):
            self.out.write_batch(pa.RecordBatch.from_arrays([c.slice(i, ROWS_PER_BATCH) for c in columns], schema=self.schema))
        self.ids, self.held = [flat[have:]], len(flat) - have
        self.doc_ids, self.end_at = self.doc_ids[inside:], (at[inside:] - have).tolist()
        self.rows += rows

    def close(self) -> None:
        if self.held:
            self._write(-(-self.held // self.length))
        self.out.close()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 2, length: int = 2048, width: int = 2) -> DataFrame:
    """Write all documents in ascending doc_id order; returns the manifest."""
    spark = docs.sparkSession
    ship(spark)

    def run(batches):
        encoder = unit_encoder(tokenizer, "byte", width)
        end = np.array([end_id], encoder.dtype).tobytes()
        unpack = zstandard.ZstdDecompressor().decompress
        shard = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        final = f"{base}/shard-{shard:07d}.arrow"
        part = f"{base}/.shard-{shard:07d}-{TaskContext.get().taskAttemptId()}"
        docs_n = tokens_n = 0
        lo = hi = None
        with fs.open_output_stream(part) as stream:
            writer = SequenceWriter(stream, length, width)
            for b in _chain(first, batches):
                for keys, packed in text_groups(b.column(0).to_pylist(), b.column(2).to_pylist(), PACKED_GROUP):
                    for key, ids in zip(keys, encoder.encode([unpack(p).decode() for p in packed])):
                        writer.add(key, np.frombuffer(ids + end, encoder.dtype))
                        docs_n, tokens_n = docs_n + 1, tokens_n + len(ids) // width + 1
                        lo, hi = key if lo is None else lo, key
            writer.close()
        fs.move(part, final)
        yield pa.RecordBatch.from_pydict({
            "shard": [shard], "path": [folder.rstrip("/") + f"/shard-{shard:07d}.arrow"], "n_docs": [docs_n],
            "n_tokens": [tokens_n], "n_rows": [writer.rows], "first_doc": [lo], "last_doc": [hi]})

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_DOC)).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = (rows.select("doc_id", F.xxhash64("text").alias("key"), "text")
            .mapInArrow(_packed, "doc_id long, key long, packed binary")
            .repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key", "packed"))
    return save(rows.mapInArrow(run, MANIFEST), "token-manifest")


def _packed(batches) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, so that the shuffle leaves disk to the files."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        raw, offsets = string_buffers(b.column(2))
        raw, at = memoryview(raw), offsets.tolist()
        packed = pa.array([pack(raw[i:j]) for i, j in zip(at, at[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], names=["doc_id", "key", "packed"])


def _chain(first, rest) -> Iterator:
    yield first
    yield from rest


def read_sequence(path: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the mask of one row, read by its place; a local file is memory-mapped, and both are views of it."""
    fs, p = _filesystem(path)
    source = pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(p)
    batch = pa.ipc.open_file(source).get_batch(row // ROWS_PER_BATCH)
    at = row % ROWS_PER_BATCH
    ids, mask = (batch.column(i)[at].values.to_numpy(zero_copy_only=True) for i in (0, 1))
    return ids, mask


def file_documents(path: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, first id's place in the file, ids) of each document of a file, batch by batch."""
    fs, p = _filesystem(path)
    source = pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(p)
    file = pa.ipc.open_file(source)
    parts: list[np.ndarray] = []
    start = 0
    for k in range(file.num_record_batches):
        b = file.get_batch(k)
        ids = b.column(0).flatten().to_numpy()
        mask = b.column(1).flatten().to_numpy()
        ends = np.flatnonzero(mask == END)
        ids = ids[:np.count_nonzero(mask)]
        at = 0
        for doc, e in zip(b.column(2).flatten().to_pylist(), ends.tolist()):
            parts.append(ids[at:e + 1])
            whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
            yield doc, start, whole
            start, at, parts = start + len(whole), e + 1, []
        if at < len(ids):
            parts.append(ids[at:].copy())


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read back from the files.

    ``start`` counts the ids of all documents before it, ``ids`` is binary
    (little-endian unsigned 32-bit)."""
    ship(manifest.sparkSession)
    before = Window.orderBy("first_doc", "shard").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                rows, size = [], 0
                for doc, start, ids in file_documents(path):
                    rows.append((doc, base + start, len(ids), ids.astype("<u4").tobytes()))
                    size += 4 * len(ids)
                    if size >= 8 << 20:
                        yield _document_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _document_batch(rows)

    # by number, so that the few small rows of the manifest aren't put together into one task
    return files.repartition(max(1, manifest.count()), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _document_batch(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      names=["doc_id", "start", "n_tokens", "ids"])


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    manifest = write_token_files(documents(spark, sf_dir), new_path(spark, "token-files"),
                                 public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
