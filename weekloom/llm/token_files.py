"""Token ids as Arrow files of equal-length sequences and masks.

Each task writes one Arrow IPC file whose record batches hold two columns of fixed-size
lists, ``ids`` and ``mask`` (false on the padding of the last sequence), uncompressed, so a
reader maps the file and reaches sequence i of any batch without copying. A second file
holds where each document begins. A manifest table names the files of finished tasks only:
the file of a lost attempt is never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.llm.common import table, written
from weekloom.llm.tokens import encoded, encoder
from weekloom.session import fresh_path

SEQUENCE = 2048
BATCH = 256
END_ID = 0
MANIFEST = "part int, path string, index_path string, n_docs long, n_tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class _SequenceFile:
    """Takes ids in any portions and writes full batches of sequences."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, dtype: np.dtype, sequence: int):
        self.sequence, self.dtype, self.held, self.n = sequence, dtype, [], 0
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= BATCH * self.sequence:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids, size = np.concatenate([*self.held, np.zeros(0, self.dtype)]), BATCH * self.sequence
        while len(ids) >= size or (last and len(ids)):
            part, ids = ids[:size], ids[size:]
            rows = -(-len(part) // self.sequence)
            full = np.zeros(rows * self.sequence, self.dtype)
            full[: len(part)] = part
            mask = np.arange(len(full)) < len(part)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (full, mask)]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        self.held, self.n = [ids], len(ids)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.sink.close()


def _open(path: str) -> pa.NativeFile:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return pa.memory_map(inner) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(inner)


def write_sequences(docs: DataFrame, tokenizer: str, folder: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` below ``folder``; returns the manifest.

    Documents go in ascending doc_id order, each followed by ``end_id``. Texts are sorted
    and shuffled, not ids, which take more room. A null text is empty and gives the end id
    alone; a null doc_id sorts first; rows with the same doc_id stand side by side, ordered
    by text. Other columns are ignored; an empty table gives an empty manifest. ``folder``
    is a URI that all executors reach and pyarrow's file systems open.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        paths = [f"{folder}/part-{part:05d}-{name}.{end}" for end in ("arrow", "index.arrow")]
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out = index = sink = None
        n_docs = n_tokens = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                dtype = np.dtype(encoder(tokenizer).dtype)
                out = _SequenceFile(fs, f"{base}/{paths[0].rpartition('/')[2]}", dtype, sequence)
                sink = fs.open_output_stream(f"{base}/{paths[1].rpartition('/')[2]}")
                index = pa.ipc.new_file(sink, index_schema())
                end = np.array([end_id], dtype)
            sizes = []
            for ids in encoded(tokenizer, batch.column(1).to_pylist()):
                out.add(ids)
                out.add(end)
                sizes.append(len(ids) + 1)
            starts = n_tokens + np.cumsum([0, *sizes[:-1]])
            index.write_batch(pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(starts), pa.array(sizes, pa.int64())], schema=index_schema()))
            n_docs, n_tokens = n_docs + len(sizes), n_tokens + sum(sizes)
        if out is not None:
            out.close()
            index.close()
            sink.close()
            values = [[part], paths[:1], paths[1:], [n_docs], [n_tokens]]
            yield pa.record_batch([pa.array(values[0], pa.int32()), *map(pa.array, values[1:])], names=["part", "path", "index_path", "n_docs", "n_tokens"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def index_schema() -> pa.Schema:
    """Columns of an index file; ``start`` counts ids in the file."""
    return pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def read_documents(path: str, index_path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of the index with the ids of their documents, read in place.

    A document inside one record batch is a view of the mapped file.
    """
    with _open(path) as file, _open(index_path) as index_file:
        sequences, index = pa.ipc.open_file(file), pa.ipc.open_file(index_file)
        size = BATCH * sequences.schema.field("ids").type.list_size
        flat: dict[int, np.ndarray] = {}

        def batch(i: int) -> np.ndarray:
            if i not in flat:
                got = sequences.get_batch(i)
                ids = got.column(0).flatten().to_numpy(zero_copy_only=True)
                used = int(np.count_nonzero(got.column(1).flatten().to_numpy(zero_copy_only=False)))
                if len(flat) > 1:
                    flat.pop(min(flat))
                flat[i] = ids[:used]
            return flat[i]

        for k in range(index.num_record_batches):
            rows, out = index.get_batch(k), []
            for start, n in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                first, last = start // size, (start + n - 1) // size
                parts = [batch(i)[max(0, start - i * size) : start + n - i * size] for i in range(first, last + 1)]
                out.append(parts[0] if len(parts) == 1 else np.concatenate(parts))
            yield rows, out


def documents_from_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids, all read back from the files.

    ``start`` counts the ids of all documents before it: the files before its own, summed
    over the manifest (a row for each file, so one small window), plus its place there.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            for rows, ids in read_documents(row["path"], row["index_path"]):
                sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                starts = pa.array(np.array(rows.column(1).to_pylist(), np.int64) + row["base"])
                yield pa.record_batch([rows.column(0), starts, pa.array([len(x) for x in ids], pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return based.repartition(max(1, manifest.count()), "path").mapInArrow(read, DOCS)


def token_documents(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as sequence files and describe its documents from those files."""
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    return documents_from_files(write_sequences(docs, tokenizer, folder))


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents in byte-level BPE ids."""
    import public_tokenizers

    return token_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
