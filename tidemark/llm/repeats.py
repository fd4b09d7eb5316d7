"""What the operators on repeated text share: exact-copy classes, hashes of words and grams, bounded bitmaps."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, materialize

#: Most rows (of 24 bytes) of a counted table that is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: log2 of the bits that mark repeated values, and bytes of text whose values one bucket counts.
MARK_BITS, BUCKET_BYTES = 27, 16 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)
MULT2 = np.uint64(0xBF58476D1CE4E5B9)


def side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if counted to be within the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, k1, k2, body: the text as bytes (null: empty) under a 128-bit key of it; a null id sorts last."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("k1"),
        F.xxhash64(F.lit(7), text).alias("k2"),
        text.cast("binary").alias("body"),
    )


def copy_classes(base: DataFrame) -> DataFrame:
    """k1, k2, first (smallest id; null ids count as largest), copies: one row per text that has two rows or more."""
    last = F.lit((1 << 63) - 1)
    classes = base.groupBy("k1", "k2").agg(F.min(F.coalesce("doc_id", last)).alias("first"), F.count(F.lit(1)).alias("copies"))
    return materialize(classes.where("copies > 1"), "copies")


def with_copies(base: DataFrame, classes: DataFrame) -> DataFrame:
    """base with `copies` (1 for a text alone) and `first` (null for a text alone)."""
    c = side(classes).withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    return base.join(c, (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")), "left").drop("__k1", "__k2").withColumn("copies", F.coalesce("copies", F.lit(1)))


def is_first() -> Column:
    """True for the rows that stand for their text."""
    return F.col("first").isNull() | (F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)) == F.col("first"))


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(body: bytes, cache: WordHashes) -> np.ndarray:
    """Hashes of the words: bytes.split() parts at exactly the six ASCII white-space characters."""
    words = body.split()
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * MULT2
    return h ^ (h >> np.uint64(27))


def gram_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values, from each position on that has them."""
    m = len(w) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(m, np.uint64)
    for i in range(k):
        h = (h * MULT) ^ (h >> np.uint64(29))
        h += w[i : i + m]
    return finish(h)


def bitmap(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for each value of hashes.column modulo 2 ** bits, gathered as words: 2 ** bits / 8 bytes at any size of
    input. A bit set by another value (the more, the fuller) only sends more rows to the exact stage that follows."""
    slots = hashes.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("s"))
    found = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b")).toArrow()
    out = np.zeros(max(1, 1 << (bits - 6)), np.uint64)
    if found.num_rows:
        out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def mark_repeats(firsts: DataFrame, values: Callable[[], Callable[[bytes], np.ndarray]], bytes_: int, frequent: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of 2 ** MARK_BITS bits: values that occur twice or more, and more often than `frequent`. firsts: body;
    values() makes the function from a body to its 64-bit values; bytes_: about the size of all bodies.

    A batch sends its values, each once with its count and cut to 32 bits below the bucket's, in a row for each bucket;
    a bucket counts its values and returns its part of the bitmaps. Buckets grow in number with the text, so each
    counts about as much, and what reaches the driver, packed, is no larger than the bitmaps at any size of input. A value that is marked for
    another one's sake only sends more rows to the exact stage that follows.
    """
    bits = min(20, max(4, math.ceil(math.log2(max(1, bytes_ / BUCKET_BYTES)))))
    low, rest = MARK_BITS - bits, 5 + bits  # bits of a slot within its bucket, and bits beside the slot

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = values()
        for b in batched(batches):
            found = [of(x.as_py()) for x in b.column(0)]
            v = np.concatenate(found) if found else np.zeros(0, np.uint64)
            if not len(v):
                continue
            slot = v & np.uint64((1 << MARK_BITS) - 1)
            packed = (slot << np.uint64(rest)) | ((v >> np.uint64(MARK_BITS)) & np.uint64((1 << rest) - 1))
            packed, n = np.unique(packed, return_counts=True)  # by bucket, then by what is left of the value
            bucket = (packed >> np.uint64(32)).astype(np.int32)
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            short, most = packed.astype(np.uint32), np.minimum(n, frequent + 1).astype(np.uint32)
            pieces = [slice(a, z) for a, z in zip(at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True)]
            counts = [b"" if most[p].max() == 1 else most[p].tobytes() for p in pieces]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array([short[p].tobytes() for p in pieces], pa.binary()), pa.array(counts, pa.binary())], ["bucket", "packed", "counts"])

    def count(held: pa.Table) -> pa.Table:
        v = [np.frombuffer(x.as_buffer(), np.uint32) for x in held.column("packed")]
        n = [np.frombuffer(c, np.uint32) if c else np.ones(len(x), np.uint32) for x, c in zip(v, held.column("counts").to_pylist(), strict=True)]
        v, n = np.concatenate(v), np.concatenate(n).astype(np.int64)
        order = np.argsort(v, kind="stable")
        v, n = v[order], n[order]
        start = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n, slot = np.add.reduceat(n, start), v[start] >> np.uint32(32 - low)
        marks = []
        for often in (n > 1, n > frequent):
            flags = np.zeros(1 << low, np.uint8)
            flags[slot[often]] = 1
            marks.append(zlib.compress(np.packbits(flags, bitorder="little").tobytes(), 1))
        return pa.table({"bucket": held.column("bucket")[:1].cast(pa.int32()), "shared": pa.array([marks[0]], pa.binary()), "frequent": pa.array([marks[1]], pa.binary())})

    rows = firsts.select("body").mapInArrow(pack, "bucket int, packed binary, counts binary")
    marked = rows.groupBy("bucket").applyInArrow(count, "bucket int, shared binary, frequent binary").toArrow()
    out = [np.zeros(1 << (MARK_BITS - 6), np.uint64) for _ in range(2)]
    for k, *marks in zip(*(c.to_pylist() for c in marked.columns), strict=True):
        for bitmap_, part in zip(out, marks, strict=True):
            words = np.frombuffer(zlib.decompress(part), np.uint64)
            bitmap_[k * len(words) : (k + 1) * len(words)] = words
    del marked
    pa.default_memory_pool().release_unused()
    return out[0], out[1]


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    s = h & np.uint64(len(words) * 64 - 1)
    return (words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    f = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return f[::2], f[1::2] - 1
