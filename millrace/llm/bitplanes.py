"""Token ids in files of shuffled bit planes.

A shard file holds fixed-size blocks of ids. Each block is transposed into bit
planes (all lowest bits, then all second-lowest ones, …) or byte planes; each
plane is compressed with zstandard on its own, and planes without a set bit take
no room. The footer holds the chunk index (offset, ids and plane sizes of every
block) and the documents' ids and lengths, so that a reader can start at any
block. Documents are written in ascending order of their ids: shards are ranges,
and rows are sorted inside them.

Layout: ``MAGIC``, planes of block 0, planes of block 1, …, footer, 8 bytes with
the footer's length, ``MAGIC``. The footer is an Arrow stream with two batches in
binary form, compressed with zstandard.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import slices, stored, texts_of
from millrace.llm.tokens import tokenizer

MAGIC = b"MRBP0001"
BLOCK_IDS = 1 << 16
#: A shard is closed at a document's end beyond so many ids or documents; its index stays in memory until then.
SHARD_IDS, SHARD_DOCUMENTS = 1 << 26, 1 << 20
HAND_ON = 4_000_000


def planes_of(ids: np.ndarray, kind: str) -> list[bytes]:
    """The bit or byte planes of a block, lowest first."""
    columns = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    if kind == "byte":
        return [np.ascontiguousarray(c).tobytes() if c.any() else b"" for c in columns]
    found = []
    for column in columns:
        if not column.any():
            found += [b""] * 8
            continue
        bits = np.unpackbits(column[:, None], axis=1, bitorder="little").T
        found += [np.packbits(row).tobytes() if row.any() else b"" for row in bits]
    return found


def ids_of(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    """The block that ``planes_of`` took apart."""
    columns = np.zeros((4, count), dtype=np.uint8)
    for k, plane in enumerate(planes):
        if not plane:
            continue
        own = np.frombuffer(plane, dtype=np.uint8)
        if kind == "byte":
            columns[k] = own
        else:
            columns[k // 8] |= np.unpackbits(own, count=count) << np.uint8(k % 8)
    return np.ascontiguousarray(columns.T).view("<u4").ravel()


class ShardWriter:
    """One file; ``add`` takes documents in order, ``close`` writes the index."""

    def __init__(self, sink, kind: str, level: int):
        self.sink, self.kind = sink, kind
        self.press = zstandard.ZstdCompressor(level=level).compress
        self.at = self.sink.write(MAGIC)
        self.blocks: list[tuple] = []
        self.pending: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.documents, self.lengths = [], []

    def add(self, document, ids: np.ndarray) -> None:
        self.documents.append(document)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= BLOCK_IDS:
            flat = np.concatenate(self.pending)
            whole = len(flat) // BLOCK_IDS * BLOCK_IDS
            for k in range(0, whole, BLOCK_IDS):
                self._block(flat[k : k + BLOCK_IDS])
            self.pending, self.waiting = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.press(p) if p else b"" for p in planes_of(ids, self.kind)]
        self.blocks.append((self.at, len(ids), [len(p) for p in packed]))
        self.at += self.sink.write(b"".join(packed))

    def close(self, id_type: pa.DataType) -> int:
        if self.waiting:
            self._block(np.concatenate(self.pending))
        index = pa.table(
            {"offset": pa.array([b[0] for b in self.blocks], pa.int64()), "ids": pa.array([b[1] for b in self.blocks], pa.int64()), "planes": pa.array([b[2] for b in self.blocks], pa.list_(pa.int64()))}
        )
        listing = pa.table({"id": pa.array(self.documents, id_type), "length": pa.array(self.lengths, pa.int64())})
        parts = [_stream(index), _stream(listing)]
        footer = self.press(struct.pack("<Q", len(parts[0])) + parts[0] + parts[1])
        self.at += self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return self.at


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def file_system(root: str) -> tuple[fs.FileSystem, str]:
    """Where a folder named the way Hadoop names it lies, for Arrow."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return (fs.LocalFileSystem(), root) if root.startswith("/") else fs.FileSystem.from_uri(root)


def write_shards(
    documents: DataFrame,
    root: str,
    tokenizer_path: str,
    end_id: int | None = None,
    kind: str = "byte",
    level: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode every whole text and write shard files below ``root``; the manifest comes back.

    ``root`` is a folder that all executors and the driver share. Ids are those
    of the tokenizers library without its special tokens around a text, and
    ``end_id`` after each document. Null and empty texts hold nothing but the end
    id; documents without an id come first; rows with one id stand together,
    ordered by text. An empty table gives an empty manifest. Other columns are
    not looked at.

    A task writes files under names of its own attempt and returns their names;
    only the names of tasks that succeeded get into the manifest (one row a file:
    file, part, piece, documents, ids, bytes), which is stored, so that a lost
    executor costs the attempt and leaves at most a file that nothing names.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    system, folder = file_system(root)
    system.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path)
        system, folder = file_system(root)
        part = TaskContext.get().partitionId()
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        writer, piece, arrow_type = None, 0, pa.int64()

        def closed() -> pa.RecordBatch:
            size = writer.close(arrow_type)
            writer.sink.close()
            return pa.RecordBatch.from_pylist(
                [{"file": name, "part": part, "piece": piece, "documents": len(writer.documents), "ids": writer.total, "bytes": size}],
                schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]),
            )

        for batch in batches:
            arrow_type = batch.column(0).type
            names, texts = batch.column(0).to_pylist(), texts_of(batch, "text")
            for first, last in slices(batch, [len(t) for t in texts], HAND_ON):
                for document, ids in zip(names[first:last], own.encode(texts[first:last]), strict=True):
                    if writer is None:
                        name = f"part-{part:06d}-{piece:04d}-{uuid.uuid4().hex}.planes"
                        writer = ShardWriter(system.open_output_stream(f"{folder}/{name}"), kind, level)
                    writer.add(document, np.concatenate([ids, tail]))
                    if writer.total >= SHARD_IDS or len(writer.documents) >= SHARD_DOCUMENTS:
                        yield closed()
                        writer, piece = None, piece + 1
        if writer is not None:
            yield closed()

    dealt = rows.repartitionByRange(F.col("id")).sortWithinPartitions("id", "text")
    schema = "file string, part int, piece int, documents bigint, ids bigint, bytes bigint"
    manifest = stored(dealt.mapInArrow(run, schema), "shard-manifest")
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select(
        "*", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"), F.lit(id_type).alias("id_type")
    )


def read_shards(manifest: DataFrame, root: str, id_type: str = "bigint", kind: str = "byte") -> DataFrame:
    """Documents of the files in a manifest: ``id, start, n_tokens, ids_le``.

    ``start`` counts the ids of all documents before it, ``ids_le`` holds the ids
    as little-endian unsigned 32-bit integers. Each file is read by its chunk
    index, block by block; a task holds one block and the document it is in.
    """

    def documents(name: str, start: int) -> Iterator[tuple]:
        system, folder = file_system(root)
        unpress = zstandard.ZstdDecompressor().decompress
        with system.open_input_file(f"{folder}/{name}") as file:
            size = file.size()
            length, magic = struct.unpack("<Q8s", file.read_at(16, size - 16))
            if magic != MAGIC:
                raise ValueError(f"{name} is no shard file")
            footer = unpress(file.read_at(length, size - 16 - length))
            cut = 8 + struct.unpack_from("<Q", footer)[0]
            index = pa.ipc.open_stream(footer[8:cut]).read_all().to_pylist()
            listing = pa.ipc.open_stream(footer[cut:]).read_all()
            blocks = iter(index)
            held = np.empty(0, "<u4")
            for document, n in zip(listing["id"].to_pylist(), listing["length"].to_pylist(), strict=True):
                got = [held]
                have = len(held)
                while have < n:
                    block = next(blocks)
                    data = file.read_at(sum(block["planes"]), block["offset"])
                    planes, at = [], 0
                    for width in block["planes"]:
                        planes.append(unpress(data[at : at + width]) if width else b"")
                        at += width
                    got.append(ids_of(planes, block["ids"], kind))
                    have += block["ids"]
                held = np.concatenate(got)
                yield document, start, n, held[:n].tobytes()
                start, held = start + n, held[n:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, total = [], 0
                for x in documents(row["file"], row["start"]):
                    rows.append(x)
                    total += x[2]
                    if total >= HAND_ON:
                        yield packed(rows)
                        rows, total = [], 0
                if rows:
                    yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [None, pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["id", "start", "n_tokens", "ids_le"]
        )

    files = max(1, manifest.count())
    return (
        manifest.select("file", "start")
        .repartition(files)
        .mapInArrow(run, f"id {id_type}, start bigint, n_tokens bigint, ids_le binary")
    )
