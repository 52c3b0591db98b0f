"""Token packing: best-fit decreasing, with a segment tree over the bins' free room.

Documents are encoded (by tiktoken; the operator is about packing) where they are read; those of a block of at least BLOCK tokens (or what a task has left) are packed
together, so packing moves nothing and holds one block at a time. Longer documents are split, without loss, into whole rows and
a rest. Pieces go, longest first, to the bin with the least room that holds them, which the tree finds in steps of its height.

A bin is a row of an id matrix: ids and position_ids hold seq_len little-endian unsigned numbers (positions start anew with each
piece; rows are filled up with the pad id and position 0), cu_seqlens the pieces' cumulative lengths from 0, doc_ids and starts
each piece's document and its first token there. Pieces of one length go in the order of their documents, and of bins with the same
room the one filled last is taken. Which documents share a bin, and pack_id, depend on how rows are dealt to tasks; each task
leaves one block that may fill its last bins in part. A text without tokens, null texts among them, is in no bin. Repeated rows
are packed each. An empty table gives an empty result; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from synteny_spark.llm.common import texts

VOCABULARY = "byte_bpe_50k.tiktoken"
SEQ_LEN, BLOCK, PAD = 2048, 4_000_000, 50256
SCHEMA = "pack_id long, n_tokens int, ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, starts array<int>"


_LOADED: dict[str, object] = {}


def encoder(path: str):
    """tiktoken's encoding by a rank file, its end-of-text string being the id after the last; one for all tasks of a worker."""
    import base64

    import public_tokenizers
    import tiktoken

    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _LOADED[path]


class Room:
    """Bins by free room; a tree tells which rooms have any."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.tree = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _count(self, room: int, by: int) -> None:
        k = room + self.width
        while k:
            self.tree[k] += by
            k >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._count(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """A bin with the least room that isn't below least, and that room."""
        k = least + self.width
        if not self.tree[k]:
            while k > 1 and (k & 1 or not self.tree[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.width:
                k = 2 * k if self.tree[2 * k] else 2 * k + 1
        room = k - self.width
        self._count(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """The items of each bin."""
    room, bins = Room(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if found := room.take(lengths[i]):
            at, free = found
            bins[at].append(i)
        else:
            at, free = len(bins), capacity
            bins.append([i])
        if free > lengths[i]:
            room.put(free - lengths[i], at)
    return bins


def pieces(lengths: list[int], seq_len: int) -> list[tuple[int, int, int]]:
    """document, first token and length of each piece."""
    return [(d, a, min(seq_len, n - a)) for d, n in enumerate(lengths) for a in range(0, n, seq_len)]


def pack_block(doc_ids: list[int], ids: list[np.ndarray], seq_len: int, pad: int) -> Iterator[tuple]:
    kind = np.dtype("<u2") if pad < 1 << 16 and seq_len <= 1 << 16 else np.dtype("<u4")
    parts = pieces([len(x) for x in ids], seq_len)
    for bin_ in best_fit_decreasing([n for _, _, n in parts], seq_len):
        row, positions, ends = np.full(seq_len, pad, kind), np.zeros(seq_len, kind), [0]
        for i in bin_:
            d, a, n = parts[i]
            row[ends[-1] : ends[-1] + n] = ids[d][a : a + n]
            positions[ends[-1] : ends[-1] + n] = np.arange(n)
            ends.append(ends[-1] + n)
        yield ends[-1], row.tobytes(), positions.tobytes(), ends, [doc_ids[parts[i][0]] for i in bin_], [parts[i][1] for i in bin_]


def pack(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, pad: int = PAD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each bin; pack_id is the task's number, times 2^40, and the bin's in the task."""
    if not path:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoding, number = encoder(path), TaskContext.get().partitionId() << 40
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, size
            rows = []
            for row in pack_block(held_ids, held, seq_len, pad):
                rows.append((number, *row))
                number += 1
                if len(rows) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
            held_ids.clear()
            held.clear()
            size = 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoding.encode_to_numpy(text, allowed_special="all")
                held_ids.append(doc)
                held.append(ids.astype(np.uint16 if pad < 1 << 16 else np.uint32))
                size += len(ids)
            if size >= block:
                yield from flush()
        yield from flush()

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def matrix(rows: list, seq_len: int = SEQ_LEN, pad: int = PAD, column: str = "ids") -> np.ndarray:
    """The id (or position) matrix of collected or streamed rows."""
    kind = "<u2" if pad < 1 << 16 and seq_len <= 1 << 16 else "<u4"
    return np.frombuffer(b"".join(bytes(r[column]) for r in rows), kind).reshape(-1, seq_len)


def save(packs: DataFrame, path: str) -> None:
    """Writes bins as Parquet: a task's bins are a file, each the rows of an id and a position matrix with their segments."""
    packs.write.mode("error").parquet(path)


def saved(spark: SparkSession, path: str, seq_len: int = SEQ_LEN, pad: int = PAD, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[int]]]]:
    """What `save` has written, in the order of pack_id and at most so many rows at once: ids, positions and cumulative lengths."""
    part: list = []
    for row in spark.read.parquet(path).select("pack_id", "ids", "position_ids", "cu_seqlens").orderBy("pack_id").toLocalIterator():
        part.append(row)
        if len(part) == rows:
            yield matrix(part, seq_len, pad), matrix(part, seq_len, pad, "position_ids"), [r.cu_seqlens for r in part]
            part = []
    if part:
        yield matrix(part, seq_len, pad), matrix(part, seq_len, pad, "position_ids"), [r.cu_seqlens for r in part]
