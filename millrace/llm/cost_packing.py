"""Cost-balanced packing of token ids into training sequences.

The cost of a piece is estimated as linear in its tokens plus quadratic for
attention inside the piece. In a window of documents, whole sequences are cut off
long documents first; the rests are taken in descending length, and each goes to
the sequence of lowest cost among those with room for it. What fits nowhere is
cut over the sequences with room left, again lowest cost first. A window uses the
fewest sequences its tokens can fill, so that it pads less than one sequence.

Windows are bounded runs of documents inside a partition: packing needs no
shuffle, a task holds one window, and a repeated task packs the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import slices, texts_of
from millrace.llm.tokens import tokenizer

#: Tokens after which a window is packed; it then holds that many and one document more.
WINDOW_TOKENS = 4_000_000
HAND_ON = 4_000_000


def cost_of(length, quadratic: float):
    """Estimated cost of a piece, in units of one token's linear part."""
    return length + quadratic * np.square(length, dtype=np.float64)


def pack(lengths: list[int], capacity: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths."""
    pieces, sequence, rests = [], 0, []
    for document, total in enumerate(lengths):
        for start in range(0, total - capacity + 1, capacity):
            pieces.append((document, start, capacity, sequence, 0))
            sequence += 1
        if total % capacity:
            rests.append((total % capacity, document))
    count = -(-sum(n for n, _ in rests) // capacity)
    room = np.full(count, capacity, dtype=np.int64)
    cost = np.zeros(count)

    def put(document: int, start: int, length: int, at: int) -> None:
        pieces.append((document, start, length, sequence + at, capacity - int(room[at])))
        room[at] -= length
        cost[at] += cost_of(length, quadratic)

    rests.sort(key=lambda x: (-x[0], x[1]))
    left = []
    for length, document in rests:
        fits = np.where(room >= length, cost, np.inf)
        at = int(fits.argmin())
        if fits[at] == np.inf:
            left.append((length, document))
        else:
            put(document, lengths[document] - length, length, at)
    for length, document in left:
        while length:
            at = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(length, int(room[at]))
            put(document, lengths[document] - length, part, at)
            length -= part
    return pieces


def pack_documents(
    documents: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    quadratic: float = 1 / 4096,
    window_tokens: int = WINDOW_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every id of every whole text, and ``end_id`` after it, in one piece of one sequence.

    One row per piece: ``id, start`` (the document's ids before it), ``length,
    doc_tokens, sequence_id, offset, ids_le`` (little-endian unsigned 32-bit
    integers). Sequence numbers are unique, with gaps between partitions. Null
    and empty texts consist of the end id. Rows with one id, or without, are
    documents of their own. An empty table gives no piece. Other columns are not
    looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path)
        number = TaskContext.get().partitionId() << 33
        tail = np.array([end_id], dtype="<u4")
        names, held, total, kind = [], [], 0, pa.int64()

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal number
            pieces = pack([len(x) for x in held], capacity, quadratic)
            for k in range(0, len(pieces), 2000):
                part = pieces[k : k + 2000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[d] for d, *_ in part], type=kind),
                        pa.array([s for _, s, *_ in part], type=pa.int64()),
                        pa.array([p[2] for p in part], type=pa.int64()),
                        pa.array([len(held[d]) for d, *_ in part], type=pa.int64()),
                        pa.array([number + p[3] for p in part], type=pa.int64()),
                        pa.array([p[4] for p in part], type=pa.int64()),
                        pa.array([held[d][s : s + n].tobytes() for d, s, n, *_ in part], type=pa.binary()),
                    ],
                    names=["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_le"],
                )
            number += max((p[3] for p in pieces), default=-1) + 1

        for batch in batches:
            kind = batch.column(0).type
            ids, texts = batch.column(0).to_pylist(), texts_of(batch, "text")
            for first, last in slices(batch, [len(t) for t in texts], HAND_ON):
                for name, tokens in zip(ids[first:last], own.encode(texts[first:last]), strict=True):
                    names.append(name)
                    held.append(np.concatenate([tokens, tail]))
                    total += len(held[-1])
                    if total >= window_tokens:
                        yield from packed()
                        names, held, total = [], [], 0
        if held:
            yield from packed()

    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"id {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids_le binary",
    )
