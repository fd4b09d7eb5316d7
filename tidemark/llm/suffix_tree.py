"""Repeated passages by prefix-partitioned suffix trees over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialize, scratch, small_batches, table
from .repeats import WordHashes, copy_classes, gram_hashes, in_bitmap, is_first, keyed, mark_repeats, side, with_copies, word_hashes

#: Words of a repeated passage, where the trees end; words of the shortest prefix that partitions the suffixes.
DEPTH, PREFIX = 13, 7
#: Most suffixes under one prefix; where there are more the prefix is lengthened by a word.
GROUP = 200_000
NO_ID = (1 << 63) - 1


def least_grams(w: np.ndarray, depth: int = DEPTH, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """(grams of prefix words, least gram of each window of depth words)."""
    g = gram_hashes(w, prefix)
    width = depth - prefix + 1
    if len(g) < width:
        return g, np.zeros(0, np.uint64)
    return g, np.lib.stride_tricks.sliding_window_view(g, width).min(axis=1)


def paths(w: np.ndarray, at: np.ndarray, depth: int = DEPTH, prefix: int = PREFIX) -> np.ndarray:
    """The words of the suffixes at these places below the prefix, down to depth: a row of 4 bytes for each, in an order
    that is the same for the bytes."""
    short = w.astype(np.uint32).astype(">u4")
    return np.stack([short[at + k] for k in range(prefix, depth)], axis=1) if len(at) else np.zeros((0, depth - prefix), ">u4")


def common_depths(prefix: np.ndarray, below: np.ndarray, shortest: int = PREFIX) -> np.ndarray:
    """Words that each suffix has in common with the one before it, in tree order: 0, or from the prefix on down."""
    same = np.cumprod(below[1:] == below[:-1], axis=1).sum(axis=1) if below.shape[1] else np.zeros(max(0, len(below) - 1), np.int64)
    return np.concatenate([[0], np.where(prefix[1:] == prefix[:-1], shortest + same, 0)])[: len(prefix)]


def internal_nodes(common: np.ndarray) -> list[tuple[int, int, int]]:
    """(depth, first leaf, last leaf) of the branching nodes of the tree whose leaves have these common depths."""
    out, open_ = [], [(0, 0)]  # depth and first leaf of the nodes on the rightmost path
    for leaf, depth in enumerate([*common[1:].tolist(), 0], 1):
        first = leaf - 1
        while open_[-1][0] > depth:
            d, first = open_.pop()
            out.append((d, first, leaf - 1))
        if open_[-1][0] < depth:
            open_.append((depth, first))
    return sorted(out)


def later_windows(docs: DataFrame, bytes_: int, depth: int = DEPTH, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, k1, pos: windows whose word sequence also starts in a document with a smaller id; docs: doc_id, k1,
    body.

    A sieve comes first: the least gram of a window is the same wherever the window occurs, so windows whose least
    gram stands in one document only are no suffix worth a leaf. Suffixes (window starts) that remain are dealt out by
    their first `prefix` words. A prefix of more than `group` suffixes is lengthened word by word until it has fewer,
    so groups fit a task however skewed the text is. In a group the suffixes are sorted by their further words, which
    is the order of the leaves; common depths of neighbours give the tree, cut off at `depth` words, as deeper nodes
    cover no other words. Its nodes of that depth are the passages that repeat: the leaf with the smallest id stays. A
    passage of more than `group` suffixes is one node, whose smallest id partial aggregation finds.
    """
    spark = docs.sparkSession

    def grams() -> Callable[[bytes], np.ndarray]:
        cache = WordHashes()
        return lambda body: np.unique(least_grams(word_hashes(body, cache), depth, prefix)[1])

    marks = spark.sparkContext.broadcast(mark_repeats(docs, grams, bytes_, group)[0])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batched(batches):
            cols: list[list] = [[], [], [], [], []]
            for doc, key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                w = word_hashes(body.as_py(), cache)
                g, least = least_grams(w, depth, prefix)
                at = np.flatnonzero(in_bitmap(marks.value, least)) if len(least) else least
                if len(at):
                    n = len(at)
                    for col, v in zip(cols, (g[at].view(np.int64), paths(w, at, depth, prefix), np.full(n, NO_ID if doc is None else doc), np.full(n, key), at.astype(np.int32)), strict=True):
                        col.append(v)
            if not cols[0]:
                continue
            below = np.concatenate(cols[1])
            path = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * (depth - prefix)), len(below), [None, pa.py_buffer(below.tobytes())]).cast(pa.binary())
            rest = [pa.array(np.concatenate(c)) for c in (cols[0], *cols[2:])]
            yield pa.RecordBatch.from_arrays([rest[0], path, *rest[1:]], ["prefix", "path", "doc_id", "k1", "pos"])

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leaves come in tree order, those of one node by id; the first leaf of a node goes from batch to batch."""
        last = first = None
        for b in batches:
            if not b.num_rows:
                continue
            top, doc = b.column(0).to_numpy(), b.column(2).to_numpy()
            below = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u4").reshape(len(top), -1)
            new = common_depths(top, below, prefix) < depth
            new[0] = last is None or last[0] != top[0] or last[1] != below[0].tobytes()
            node = np.cumsum(new)
            firsts = np.concatenate([[doc[0] if first is None else first], doc[new]])
            later = pa.array(doc > firsts[node])
            last, first = (top[-1], below[-1].tobytes()), firsts[node[-1]]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(later) for c in (2, 3, 4)], ["doc_id", "k1", "pos"])

    found = materialize(docs.select("doc_id", "k1", "body").mapInArrow(suffixes, "prefix long, path binary, doc_id long, k1 long, pos int"), "suffixes")
    # key: what deals a suffix out; long: the words of its prefix
    rest, parts, deep = found, [], None
    for k in range(depth - prefix + 1):
        key = [F.col("prefix"), F.substring("path", 1, 4 * k).alias("key")]
        wide = materialize(rest.groupBy(*key).count().where(F.col("count") > group).select("prefix", "key"), "wide")
        rest = rest.withColumn("key", key[1])
        if wide.isEmpty():
            parts.append(rest)
            break
        wide = side(wide)
        parts.append(rest.join(wide, ["prefix", "key"], "left_anti"))
        rest = rest.join(wide, ["prefix", "key"], "left_semi").drop("key")
    else:
        deep = rest
    leaves = parts[0]
    for p in parts[1:]:
        leaves = leaves.unionByName(p)
    columns = ["prefix", "path", "doc_id", "k1", "pos"]
    out = leaves.repartition("prefix", "key").sortWithinPartitions("prefix", "path", "doc_id").select(*columns).mapInArrow(subtrees, "doc_id long, k1 long, pos int")
    if deep is not None:
        nodes = deep.groupBy("prefix", "path").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("prefix", "path", "first")
        out = out.unionByName(deep.join(side(nodes), ["prefix", "path"]).where("doc_id > first").select("doc_id", "k1", "pos"))
    return out


def remove_passages(docs: DataFrame, id_col="doc_id", text_col="text", depth: int = DEPTH, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text), one row per input row.

    Null text has no words; texts under `depth` words lose nothing; exact copies of longer texts lose all their words
    but in the rows with the smallest id, which stand for the text in the search. A null id counts as larger than all
    others. Rows that share an id but not a text are kept apart by the text's key; as the id is the same, neither is
    earlier. Windows are equal if 64-bit hashes of their first words and 32-bit hashes of each further word are. Columns
    but the two named are not read; an empty table gives no rows; very long texts are read whole.
    """
    base = keyed(docs, id_col, text_col)
    flagged = with_copies(base, copy_classes(base.select("doc_id", "k1", "k2")))
    firsts = flagged.where(is_first())
    bytes_ = base.agg(F.sum(F.length("body"))).first()[0] or 0
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        found = later_windows(firsts.select("doc_id", "k1", "body"), bytes_, depth, prefix, group)
        spans = keep(materialize(found.groupBy("doc_id", "k1").agg(F.collect_list("pos").alias("pos")), "passages"))
    keys = spans.select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k"))
    on = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("__id")) & (F.col("k1") == F.col("__k"))
    none = F.lit(None).cast("array<int>")
    parts = side(keys)
    hit = firsts.join(parts, on, "left_semi").join(spans.withColumnsRenamed({"doc_id": "__id", "k1": "__k"}), on).select("doc_id", "body", F.lit(False).alias("copy"), "pos")
    clean = firsts.join(parts, on, "left_anti").select("doc_id", "body", F.lit(False).alias("copy"), none.alias("pos"))
    copied = flagged.where(~is_first()).select("doc_id", "body", F.lit(True).alias("copy"), none.alias("pos"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            out: list[list] = [[], [], []]
            for body, copy, pos in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                words = body.split()
                n, kept = len(words), words
                if copy and n >= depth:
                    kept = []
                elif pos:
                    starts = np.zeros(n + 1, np.int64)
                    np.add.at(starts, pos, 1)
                    np.add.at(starts, np.minimum(np.asarray(pos) + depth, n), -1)
                    gone = np.cumsum(starts[:-1]) > 0
                    kept = [w for w, g in zip(words, gone, strict=True) if not g]
                for col, v in zip(out, (n, n - len(kept), b" ".join(kept).decode("utf-8", "replace")), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return hit.unionByName(clean).unionByName(copied).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def op10_suffix_tree(spark, sf_dir: str) -> DataFrame:
    found = remove_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM later),
agg AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string([w[p] FOR p IN range(1, len(w) + 1) IF ps IS NULL OR NOT list_contains(ps, p)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id)
"""
