"""Token-id files in patched frame-of-reference blocks.

File format (little-endian), one file image per row of the shard table:

* header: magic ``PFR1``, then u32 block length, documents, blocks, exceptions, and u64 ids;
* documents: i64 doc_id, u8 "doc_id is null", u32 ids, one array each;
* block index: u32 minimum, u8 width, u32 byte offset of the packed block, u32 first exception, one array each;
* exceptions: u8 place in the block, u32 value above the minimum, one array each;
* packed blocks, from the next multiple of four bytes: the low ``width`` bits of every value above the block's
  minimum, one after the other from the lowest bit on.

The width of a block holds the value at a chosen percentile of the block; larger values are
exceptions.  The index lets a reader decode any block alone.

Cases: a null text is the empty text, whose record holds only the end id; documents with a null
doc_id come first; repeated doc_ids keep one record each, in the order of a hash of the text; an
empty table gives no files and no rows; further columns are ignored.  A document is never split
between files, whatever its length.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roundsmith.llm.common import stored, text_or_empty
from roundsmith.llm.encoding import encoder
from roundsmith.llm.words import slices

BLOCK = 128
_HEADER = struct.Struct("<4sIIIIQ")


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.where(values == 0, 0, np.frexp(values.astype(np.float64))[1]).astype(np.uint8)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each row's values, one after the other, as rows of 32-bit words."""
    n, size = values.shape
    columns = np.ascontiguousarray(values.T).astype(np.uint64) & np.uint64((1 << width) - 1)
    words = np.zeros((width * size // 32 + 1, n), np.uint32)
    for i in range(size):
        word, shift = divmod(i * width, 32)
        moved = columns[i] << np.uint64(shift)
        words[word] |= moved.astype(np.uint32)
        if shift + width > 32:
            words[word + 1] |= (moved >> np.uint64(32)).astype(np.uint32)
    return words[:-1].T


def unpack_bits(words: np.ndarray, width: int, size: int) -> np.ndarray:
    """``size`` values of ``width`` bits from each row of 32-bit words."""
    rows = np.ascontiguousarray(words.T).astype(np.uint64)
    out, mask = np.empty((size, words.shape[0]), np.uint32), np.uint64((1 << width) - 1)
    for i in range(size):
        word, shift = divmod(i * width, 32)
        value = rows[word] >> np.uint64(shift)
        if shift + width > 32:
            value |= rows[word + 1] << np.uint64(32 - shift)
        out[i] = value & mask
    return out.T


def encode_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """The file image of documents whose ids lie one after the other in ``ids``."""
    n_blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(n_blocks * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    if n_blocks:
        grid[len(ids):] = ids[-1]
    grid = grid.reshape(n_blocks, BLOCK)
    low = grid.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    above = grid - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = _bit_lengths(np.partition(above, at, axis=1)[:, at]) if n_blocks else np.zeros(0, np.uint8)
    over = (above >> width[:, None].astype(np.uint32)) > 0
    rows, places = np.nonzero(over)
    offset = np.zeros(n_blocks + 1, np.int64)
    np.cumsum(width.astype(np.int64) * (BLOCK // 8), out=offset[1:])
    packed = np.zeros(int(offset[-1]) // 4, "<u4")
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        at = offset[some, None] // 4 + np.arange(w * BLOCK // 32)
        packed[at] = pack_bits(above[some], w)
    first_exception = np.searchsorted(rows, np.arange(n_blocks))
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    parts = [
        _HEADER.pack(b"PFR1", BLOCK, len(doc_ids), n_blocks, len(rows), len(ids)),
        keys.tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), lengths.astype("<u4").tobytes(),
        low.astype("<u4").tobytes(), width.tobytes(), offset[:-1].astype("<u4").tobytes(), first_exception.astype("<u4").tobytes(),
        places.astype(np.uint8).tobytes(), above[rows, places].astype("<u4").tobytes(),
    ]
    parts.append(bytes(-sum(map(len, parts)) % 4))
    return b"".join([*parts, packed.tobytes()])


def decode_file(image: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and all ids of a file image."""
    magic, block, n_docs, n_blocks, n_over, n_ids = _HEADER.unpack_from(image)
    if magic != b"PFR1":
        raise ValueError("not a token-id file")
    at = _HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(image, kind, n, at)
        at += got.nbytes
        return got

    keys, none, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs)
    low, width, offset, first = take("<u4", n_blocks), take("u1", n_blocks), take("<u4", n_blocks), take("<u4", n_blocks)
    places, values, packed = take("u1", n_over), take("<u4", n_over), np.frombuffer(image, "<u4", offset=at + -at % 4)
    grid = np.zeros((n_blocks, block), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        some = np.flatnonzero(width == w)
        grid[some] = unpack_bits(packed[offset[some, None] // 4 + np.arange(w * block // 32)], w, block)
    rows = np.repeat(np.arange(n_blocks), np.diff(np.append(first, n_over).astype(np.int64)))
    grid[rows, places] = values
    grid += low[:, None]
    return [None if z else int(k) for k, z in zip(keys, none)], lengths, grid.reshape(-1)[:n_ids]


SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("image", pa.binary())])


def write_token_files(docs: DataFrame, tokenizer: str, kind: str, end_id: int, ids_per_file: int = 1 << 20) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in ascending doc_id order into file images; the table of them.

    ``start`` counts the ids before a file within its ``part``; parts follow each other by number.
    """
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, kind).encode, TaskContext.get().partitionId()
        keys, parts, size, shard, start = [], [], 0, 0, 0

        def image() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            lengths = np.array([len(p) // 4 for p in parts], np.uint32)
            row = [part, shard, start, len(keys), len(ids), encode_file(keys, lengths, ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SHARD)], schema=SHARD)

        for batch in slices(batches, keep=(tokenizer, kind)):
            for key, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text"))):
                keys.append(key)
                parts.append(ids + end)
                size += len(parts[-1]) // 4
                if size >= ids_per_file:
                    yield image()
                    shard, start = shard + 1, start + size
                    keys, parts, size = [], [], 0
        if keys:
            yield image()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")  # rows of one doc_id may be many, null ones above all
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
    )
    return stored(ordered.mapInArrow(run, "part int, shard int, start long, n_docs long, n_ids long, image binary"), "token-files")


DOCUMENT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document, read from the file images: doc_id, start, n_tokens, ids_crc32."""
    # One small row for each part, that is for each task of the writing stage.
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, begin = 0, {}
    for part, n in totals:
        begin[part], before = before, before + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, image in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "image"))):
                keys, lengths, ids = decode_file(image)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(ends - lengths + (begin[part] + start), pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], schema=DOCUMENT
                )

    return files.select("part", "start", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
